"""Incremental landing: each file once, through the same transforms as the batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def land(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet", partition: list[str] | None = None) -> StreamingQuery:
    """Reads the files that are new since the last run, transforms them and appends them; ends when all are done.

    The file sink and the checkpoint make it exactly once, also after a
    failure in the middle.
    """
    stream = transform(spark.readStream.schema(schema).format(fmt).load(source))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*partition) if partition else writer).start()


def land_each(spark: SparkSession, source: str, schema, write: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """As `land`, with the caller's own write for each batch of new files."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)


def running_kpi(events: DataFrame, time: str, window: str, late: str, id_: str) -> DataFrame:
    """Per time window: rows and an estimate of the distinct ids, over a stream (or a table) with a watermark; the state of a window has a fixed size."""
    rows = _timed(events, time, late).groupBy(F.window("_t", window).alias("w")).agg(F.count(F.lit(1)).alias("records"), F.approx_count_distinct(id_).alias("ids"))
    return rows.select(F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "records", "ids")


def running_ids(events: DataFrame, time: str, window: str, late: str, id_: str) -> DataFrame:
    """Per time window and id: rows. The state has a row of its own for each, dealt out by both, so no window's ids lie in one place."""
    rows = _timed(events, time, late).groupBy(F.window("_t", window).alias("w"), F.col(id_).alias("id")).agg(F.count(F.lit(1)).alias("records"))
    return rows.select(F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "id", "records")


def run_kpi(spark: SparkSession, source: str, schema, time: str, window: str, late: str, id_: str, out: str, checkpoint: str, approximate: bool = False, fmt: str = "parquet") -> StreamingQuery:
    """Updates of `running_ids` (or of `running_kpi`, if approximate) over the files that are new since the last run; ends when all are done.

    The state of open windows lies in the checkpoint, so a run goes on where
    the last one ended. Rows later than the watermark of earlier batches are
    dropped, as their windows are closed. Each batch writes what changed below
    its own number, so one that is run again after a failure replaces itself;
    `latest` reads the counts as they stand.
    """
    updates = (running_kpi if approximate else running_ids)(spark.readStream.schema(schema).format(fmt).load(source), time, window, late, id_)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame) -> DataFrame:
    """from_time, to_time, records, ids of every window: the last word on each window and id, counted by window; null ids count as rows only."""
    keys = [c for c in ("from_time", "to_time", "id") if c in updates.columns]
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")
    return last.groupBy("from_time", "to_time").agg(F.sum("records").alias("records"), F.count("id").alias("ids")) if "id" in keys else last


def closed_kpi(spark: SparkSession, source: str, schema, time: str, window: str, late: str, id_: str, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Windows as they close, each once and for all: rows and exact distinct ids.

    Two aggregates in a row, by window and id and then by window; the second
    gets the ids of a window only when the first has closed it, so it holds
    counts alone. Windows that the watermark hasn't passed stay in the
    checkpoint.
    """
    events = _timed(spark.readStream.schema(schema).format(fmt).load(source), time, late)
    by_id = events.groupBy(F.window("_t", window).alias("w"), F.col(id_).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = by_id.groupBy(F.window("w", window).alias("w")).agg(F.sum("n").alias("records"), F.count("id").alias("ids"))
    flat = rows.select(F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "records", "ids")
    return flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
