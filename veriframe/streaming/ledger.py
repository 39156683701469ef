"""Latest state, windowed totals and exactly-once intake over an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import latest


def read_log(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """An append-only folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def latest_state(stream: DataFrame, keys: list[str], order_by: list[str], changes: str, checkpoint: str) -> StreamingQuery:
    """Keep the last write per key. The state lives in the distributed state store; every micro-batch
    writes only the keys it touched.

    A batch that is run again overwrites its own folder, so a lost executor or a restart changes nothing.
    """
    rest = [c for c in stream.columns if c not in keys]
    state = (stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
             .select(*keys, *[F.col("_row")[c].alias(c) for c in rest]))

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")
    return (state.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_state(spark: SparkSession, changes: str, keys: list[str], order_by: list[str], schema) -> DataFrame:
    """The current row per key: the latest of its recorded changes."""
    return latest(spark.read.schema(schema).parquet(f"{changes}/batch=*"), keys, order_by)


def compact_state(spark: SparkSession, changes: str, target: str, keys: list[str], order_by: list[str], schema) -> None:
    """Write the current rows to ``target`` as batch 0 of a shorter log; the old log is left as it is."""
    read_state(spark, changes, keys, order_by, schema).write.parquet(f"{target}/batch=0")


def daily_totals(stream: DataFrame, ts: str, by: list[str], value: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Totals per window; rows later than the watermark are dropped, and a window is emitted once it is closed."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), *by, "n", "total")


def totals_log(stream: DataFrame, ts: str, by: list[str], value: str, changes: str, checkpoint: str, late: str = "1 day", width: str = "1 day") -> StreamingQuery:
    """Totals per window as a log of changes, open windows included: every micro-batch writes the windows it touched."""
    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")
    return (daily_totals(stream, ts, by, value, late, width).writeStream.outputMode("update").foreachBatch(step)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_totals(spark: SparkSession, changes: str, by: list[str]) -> DataFrame:
    """The totals of every window so far: the last change of each."""
    return latest(spark.read.parquet(changes), ["start", *by], ["batch"]).drop("batch")


def late_rows(log: DataFrame, totals: DataFrame) -> DataFrame:
    """``late``: rows of the log that came after their window was closed, and so are in no total."""
    counts = log.agg(F.count(F.lit(1)).alias("late")).unionByName(totals.agg(F.coalesce(-F.sum("n"), F.lit(0)).alias("late")))
    return counts.agg(F.sum("late").alias("late"))


def unique_intake(stream: DataFrame, ts: str, content: list[str], late: str = "1 day") -> DataFrame:
    """Drop repeats of the same content, by digest, within the watermark."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in content]), 256)
    return stream.withColumn("digest", digest).withWatermark(ts, late).dropDuplicatesWithinWatermark(["digest"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet with exactly-once file commits, for all data available now."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
