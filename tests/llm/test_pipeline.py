import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from llm_fixtures import clashing
from test_models import ENGLISH, corpus
from veriframe.llm import merge_replay


def test_stages_take_effect(spark, tmp_path):
    item = " ".join(random.Random(8).choice(ENGLISH) for _ in range(24))
    docs = corpus(spark, 260)
    rows = docs.collect()
    long = " ".join(r.text for r in rows if r.lang == "en")[:4000]
    extra = [(7000, rows[10].text, "en", "s", 1), (7001, long, "en", "s", 1), (7002, long, "en", "s", 1), (7003, long.upper(), "en", "s", 1), (7004, "12 34 !!", "en", "s", 1), (7005, None, None, None, None),
             (7006, rows[11].text + " " + item, "en", "s", 1), (7007, rows[12].text, None, "s", 1), (None, "the house and the river", "en", "s", 1), (7001, long, "en", "s", 1)]
    docs = clashing(docs.unionByName(spark.createDataFrame(extra, docs.schema)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r.doc_id, 1, 0) for r in rows if r.doc_id < 5000], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == docs.columns, name
        seen.append({r.doc_id for r in left.select("doc_id").collect()})
    language, quality, dedup, clean = seen
    assert {7004, 7005}.isdisjoint(language) and set(range(1000, 1260)) <= language
    assert all(i not in quality for i in range(5000, 5020)) and set(range(1000, 1260)) <= quality
    assert 7002 not in dedup and 7003 not in dedup and 7001 in dedup and left.where("doc_id = 7001").count() == 1
    assert 7006 in dedup and 7006 not in clean and dedup - clean == {7006}
    texts = {r.text for r in docs.where("doc_id BETWEEN 1000 AND 1259").collect()}
    assert texts <= {r.text for r in left.collect()}  # every clean text is still there once
    vocabulary = merge_replay.load_ranks(merge_replay.read_local(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    want = sorted((str(r.doc_id), len(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in left.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got) == want
    assert left.where(F.col("doc_id").isNull()).count() == 1


def test_every_operator_is_registered_once():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
