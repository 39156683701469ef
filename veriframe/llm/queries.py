"""The registered queries of the pipeline operators, with production parameters, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (kneser_ney, licenses, merge_replay, rank_index, simhash, spaced_seeds, string_kernel, style_tree, tandem_runs, token_counts, trie_join, url_aliases,
               vafile)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(vafile.top_k_sql())
def op1_exact_top_k(spark, folder):
    return vafile.top_k(table(spark, folder, "embeddings"))


@query(url_aliases.judge_sql())
def op2_url_filter(spark, folder):
    return url_aliases.judge(table(spark, folder, "pages"))


@query()
def op3_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op4_simhash_near_dedup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op5_quality_classifier(spark, folder):
    trusted = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(table(spark, folder, "documents"), trusted)


@query(spaced_seeds.contaminated_sql())
def op6_benchmark_decontamination(spark, folder):
    return spaced_seeds.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op7_language_id(spark, folder):
    return string_kernel.identify(table(spark, folder, "documents"))


@query()
def op8_byte_bpe(spark, folder):
    return merge_replay.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query()
def op9_main_text(spark, folder):
    return style_tree.extract(table(spark, folder, "pages"))


@query(licenses.scan_sql())
def op10_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query(rank_index.fill_in_middle_sql())
def op11_fill_in_middle(spark, folder):
    return rank_index.digest(rank_index.fill_in_middle(table(spark, folder, "documents")))


@query(tandem_runs.summary_sql())
def op12_periodic_runs(spark, folder):
    return tandem_runs.summary(tandem_runs.periodic_runs(table(spark, folder, "documents"), rewrite=tandem_runs.planted))


@query(trie_join.join_classes_sql())
def op13_ngram_jaccard_join(spark, folder):
    return trie_join.join_classes(table(spark, folder, "documents")).drop("set_id")
