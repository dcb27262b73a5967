"""New period files as a stream: classified into the fact, and the indicator tables kept up with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregate as agg
from ..plans import star
from ..sources import files

#: Indicator tables that are kept by period, with the keys of their first grain.
KEPT = {"kpi_period": star.PERIOD_KEYS, "kpi_category": star.CATEGORY_KEYS}
#: What the file source tells of a file; the content is not read.
LISTING = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, source: str, dim: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes up the period files (or folders of parts) of a pattern that are new since the last run; ends when all are done.

    The stream is the list of files: their schemas differ, so each batch reads
    its own by spelling. The checkpoint gives every file to one batch, and
    `take` may run again for a batch that failed half-way. A folder of parts
    has to be there as a whole when it is seen, as one that is renamed into
    place is.
    """
    listed = spark.readStream.schema(LISTING).format("binaryFile").option("recursiveFileLookup", False).load(source).select("path")

    def write(batch: DataFrame, number: int) -> None:
        found = sorted({r.path for r in batch.distinct().collect()})  # names of the batch's files
        take(batch.sparkSession, sorted({p.rsplit("/", 1)[0] if p.rsplit("/", 1)[1].startswith("part-") else p for p in found}), number, dim, out)

    return listed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take(spark: SparkSession, paths: list[str], number: int, dim: DataFrame, out: str) -> None:
    """One batch: its fact rows, its rows of the first grain, and the indicators of the periods that it touches.

    Fact and grain are partitioned by batch and overwritten as such, so a
    batch that is run again replaces itself. The indicators of a touched period
    are computed anew from the grain rows of all its batches, a row for each
    key and complaint, and replace that period's partition; other periods are
    neither read nor written.
    """
    if not paths:
        return
    _put(star.build_fact(files.read_period_files(spark, paths), dim).withColumn("batch", F.lit(number)), f"{out}/fact", "ano", "batch")
    fact = spark.read.parquet(f"{out}/fact").filter(F.col("batch") == number)
    touched = [(r.ano, r.semestre) for r in fact.select("ano", "semestre").distinct().collect()]  # a row for each period of the batch
    for name, keys in KEPT.items():
        _put(star.grain_rows(fact, keys).withColumn("batch", F.lit(number)), f"{out}/grain_{name}", "ano", "semestre", "batch")
        here = F.lit(False)
        for year, half in touched:
            here = here | ((F.col("ano") == year) & (F.col("semestre") == half))
        rows = grain(spark, out, name).filter(here)
        counts = star.counted(agg.merge_first(rows, keys, star.SUMS), keys)
        _put(dim.join(counts, "ibge_code") if name == "kpi_period" else star.category(counts), f"{out}/{name}", "ano", "semestre")


def _put(df: DataFrame, path: str, *partition: str) -> None:
    """Replaces the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partition).parquet(path)


def _longs(df: DataFrame) -> DataFrame:
    """Partition columns come back as the narrowest type."""
    return df.withColumns({c: F.col(c).cast("long") for c in ("ano", "semestre") if c in df.columns})


def grain(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The first grain of a kept table, of all batches."""
    return _longs(spark.read.parquet(f"{out}/grain_{name}"))


def tables(spark: SparkSession, out: str, dim: DataFrame) -> dict[str, DataFrame]:
    """fact and indicator tables as they stand. The municipal one, over all periods, is summed from the first grain of the periods, in which a complaint of several of them is one."""
    whole = agg.merge_first(grain(spark, out, "kpi_period"), ["ibge_code"], star.SUMS)
    return {"fact": _longs(spark.read.parquet(f"{out}/fact")).drop("batch"), "kpi_municipality": star.municipal(star.counted(whole, ["ibge_code"]), dim)} | {n: _longs(spark.read.parquet(f"{out}/{n}")) for n in KEPT}
