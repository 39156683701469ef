import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from veriframe.sources import csv_lines


def some_cell(rng):
    return "".join(rng.choice(["a", "b c", '"', '""', ",", "\n", "x\ny", "é", " ", "", "long words " * 3]) for _ in range(rng.randrange(6)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_the_csv_module_over_small_splits(spark, tmp_path, end):
    rng, want = random.Random(5), {}
    for f in range(3):
        rows = [[some_cell(rng) for _ in range(3)] for _ in range(150)]
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator=end).writerows(rows)
        (tmp_path / f"f{f}.csv").write_bytes(buffer.getvalue().encode())
        want[f"f{f}.csv"] = [r for r in rows if any(x.strip() for x in r) or len(r) > 1]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path)).select("value", *csv_lines.provenance())
        assert lines.rdd.getNumPartitions() > 30
        got = csv_lines.csv_rows(lines).select("source_file", "source_block", "source_seq", csv_lines.split_fields(F.col("record")).alias("f")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    for name, rows in want.items():
        mine = [r.f for r in sorted((r for r in got if r.source_file.endswith(name)), key=lambda r: (r.source_block, r.source_seq))]
        assert mine == rows


def test_headers_are_data(spark, tmp_path):
    for i in range(30):
        head, row = [("﻿Title,DOI,Authors", 't{0},10.{0},"Roe, A; Poe"'), ("doi,Article Title,EID", '10.{0},"a ""t"", {0}",e'), ("Journal,title\n", "j,t{0}")][i % 3]
        (tmp_path / f"x{i:02}.csv").write_text(head + "\n\n" + row.format(i) + "\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    df = csv_lines.read_csv_records(spark, str(tmp_path))
    rows = {r.title: r for r in df.collect()}
    assert len(rows) == df.count() == 30
    assert rows["t0"].doi == "10.0" and rows["t0"].authors == ["Roe, A", "Poe"] and rows["t0"].source_database == ""
    assert rows['a "t", 1'].source_database == "Scopus" and rows['a "t", 1'].authors == [] and rows["t2"].journal == "j" and rows["t2"].doi == ""
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(df) == plan(csv_lines.read_csv_records(spark, str(tmp_path / "x00.csv")))
