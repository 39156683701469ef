"""Deterministic writes, content fingerprints and freezes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content digest: row count, and the sums of the four 64-bit parts of each row's SHA-256.

    Columns are taken by name. A cell is written with its length before it, so no two rows are written alike; NULL and '' differ.
    Sums are decimals of 38 digits, which hold 10^18 rows. One row; nothing is collected or sorted.
    """
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in sorted(df.columns)]
    h = F.sha2(F.concat(*cells), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, i, 16), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string") for i in (1, 17, 33, 49)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *parts).alias("digest"))


def write_sorted(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", files: int | None = None,
                 partition_by: list[str] = (), **options: str) -> None:
    """Write in key order: range-partitioned, sorted inside files, so equal tables give equal files."""
    out = (df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    w = out.write.mode("overwrite").options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, columns: list[str], keys: list[str], files: int | None = None, gzip: bool = False) -> None:
    """Headered CSV with fixed columns in key order."""
    write_sorted(df.select(*columns), path, keys, "csv", files, header="true", escape='"', **({"compression": "gzip"} if gzip else {}))


def write_jsonl(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    write_sorted(df, path, keys, "json", files, compression="gzip", ignoreNullFields="false")


def _manifest_path(path: str) -> str:
    return path.rstrip("/") + "_manifest"


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest written next to a table, or None."""
    try:
        return json.loads(spark.read.text(_manifest_path(path)).first().value)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def freeze(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", **extra: str) -> bool:
    """Write a table and its manifest, unless the stored content is already the same. True if written."""
    spark = df.sparkSession
    now = {**fingerprint(df).first().asDict(), "columns": sorted(df.columns), **extra}
    if read_manifest(spark, path) == now:
        return False
    write_sorted(df, path, keys, fmt)
    spark.range(1).select(F.lit(json.dumps(now, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(_manifest_path(path))
    return True


def verify_frozen(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The frozen table, or an error if its content is not what its manifest says."""
    df, m = spark.read.format(fmt).load(path), read_manifest(spark, path)
    if m is None:
        raise ValueError(f"{path}: no manifest")
    if fingerprint(df).first().asDict() != {k: m[k] for k in ("rows", "digest")}:
        raise ValueError(f"{path}: content differs from its manifest")
    return df


def write_id_lists(df: DataFrame, path: str, ids: list[str], slice_by: str) -> None:
    """One list of distinct non-empty ids per kind and slice."""
    long = df.select(slice_by, F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(i).cast("string").alias("id")) for i in ids])).alias("x"))
    out = long.select(slice_by, "x.kind", "x.id").where("id <> ''").distinct()
    write_sorted(out, path, ["kind", slice_by, "id"], "csv", partition_by=["kind", slice_by], header="false")
