"""Consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations.

Every shard owns `vnodes` positions of a ring; a key belongs to the first
position clockwise of its hash. A shard takes at most its capacity: keys past
it go on clockwise to the next shards with room, so loads are bounded whatever
the hash does, and only overflowing keys leave their own shard.

The rows of a whole corpus are only ever counted: a table of `shards * vnodes`
arcs (a size that the parameters fix) says which ranks of an arc go to which
shard, and every row finds its shard by its rank in its arc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, spread, stored, table

SHARDS = 40
VNODES = 64
#: Cells of the ring; every cell lies in one arc. The parameters alone fix their number, so the cell map may be broadcast.
CELLS = 1 << 16
#: Cells for each virtual node at least.
SPACING = 4
#: An arc's rows are ranked in this many parts, so one key with many texts does not meet in one task.
PARTS = 16


def _hash(*cols: Column) -> Column:
    return F.xxhash64(F.lit("ring"), *cols)


def cells_for(shards: int, vnodes: int) -> int:
    return max(CELLS, 1 << (SPACING * shards * vnodes - 1).bit_length())


def _cell(hashed: Column, cells: int) -> Column:
    """The upper bits: twice as many cells leave every hash at its place on the ring."""
    return F.shiftrightunsigned(hashed, 65 - cells.bit_length())


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """cell, arc, shard: for every cell of the ring the next virtual node clockwise.

    No two nodes share a cell: one that finds its cell taken stands in the
    next free one, so every shard keeps all its nodes.
    """
    cells = cells_for(shards, vnodes)
    wanted = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("int").alias("v"))
        .withColumn("cell", _cell(F.xxhash64(F.lit("vnode"), "shard", "v"), cells))
    )
    # the k-th node stands k cells after the one from which no cell was free, or at its own cell
    in_order = Window.orderBy("cell", "shard", "v")
    k = F.row_number().over(in_order)
    seated = wanted.withColumn("k", k).withColumn("cell", F.max(F.col("cell") - F.col("k")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k"))
    inside = seated.filter(F.col("cell") < cells).select("cell", "shard")
    # those past the end go on at the beginning, each to the next free cell
    past = seated.filter(F.col("cell") >= cells).select("shard", F.row_number().over(Window.orderBy("cell")).alias("n"))
    free = spark.range(cells).withColumnRenamed("id", "cell").join(inside, "cell", "left_anti").select("cell", F.row_number().over(Window.orderBy("cell")).alias("n"))
    nodes = inside.unionByName(free.join(past, "n").select("cell", "shard"))
    # one row holds the first node: cells past the last node belong to it
    first = nodes.agg(F.min(F.struct("cell", "shard")).alias("first"))
    ahead = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("shard").isNotNull(), F.struct(F.col("cell").alias("arc"), "shard")), ignorenulls=True)
    return (
        spark.range(cells)
        .withColumnRenamed("id", "cell")
        .join(nodes, "cell", "left")
        .withColumn("at", own.over(ahead))
        .crossJoin(F.broadcast(first))
        .select("cell", F.coalesce("at.arc", "first.cell").alias("arc"), F.coalesce("at.shard", "first.shard").alias("shard"))
    )


def allotment(arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """arc, from_rank, to_rank, shard, slot: which ranks of an arc go to which shard, from which slot on.

    arcs: arc, shard, n for every arc of the ring, empty ones too; its size is
    fixed by the parameters. With slack 0 the capacities are as equal as whole
    numbers can be; with slack e each is ceil((1 + e) * mean).
    """
    total = F.sum("n").over(Window.partitionBy())
    by_shard = Window.partitionBy("shard")
    before = by_shard.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    even = F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    planned = (
        arcs.withColumn("total", total)
        .withColumn("room", even if slack == 0 else F.ceil(F.col("total") * (1 + slack) / shards))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("stays", F.greatest(F.lit(0), F.least("n", F.col("room") - F.col("before"))))
        .withColumn("spare", F.col("room") - F.sum("stays").over(by_shard))
        .withColumn("kept", F.sum("stays").over(by_shard))
    )
    home = planned.filter("stays > 0").select("arc", F.lit(0).cast("long").alias("from_rank"), F.col("stays").alias("to_rank"), "shard", F.col("before").alias("slot"))

    # Two laps clockwise. `carried` counts the overflow that looks for room; each node gives what its shard has left.
    shard_state = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.coalesce(F.aggregate(F.filter("nodes", lambda x: x.shard == s), F.lit(0).cast("long"), lambda _, x: x.spare), F.lit(0).cast("long")),
    )
    node = F.struct("arc", "shard", (F.col("n") - F.col("stays")).alias("extra"), "spare", "kept")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("lap"), F.lit(0).cast("long").alias("carried"), F.lit(0).cast("long").alias("placed"), F.col("spares").alias("spares"), none.alias("taken"))

    def step(s: Column, x: Column) -> Column:
        left = F.element_at(s.spares, x.shard + 1)
        waiting = s.carried + x.extra
        takes = F.least(waiting, left)
        entry = F.struct(s.placed.alias("lo"), (s.placed + takes).alias("hi"), x.shard.alias("shard"), (x.kept + x.spare - left).alias("slot"))
        return F.struct(
            s.lap.alias("lap"),
            (waiting - takes).alias("carried"),
            (s.placed + takes).alias("placed"),
            F.when(takes > 0, F.transform(s.spares, lambda v, i: F.when(i == x.shard, v - takes).otherwise(v))).otherwise(s.spares).alias("spares"),
            F.when(takes > 0, F.concat(s.taken, F.array(entry))).otherwise(s.taken).alias("taken"),
        )

    second = F.transform("nodes", lambda x: F.struct(x.arc.alias("arc"), x.shard.alias("shard"), F.lit(0).cast("long").alias("extra"), x.spare.alias("spare"), x.kept.alias("kept")))
    taken = (
        planned.agg(F.sort_array(F.collect_list(node)).alias("nodes"))
        .withColumn("spares", shard_state)
        .select(let(F.aggregate(F.concat("nodes", second), zero, step), lambda s: s.taken).alias("taken"))
        .select(F.explode("taken").alias("t"))
        .select("t.*")
    )
    # Overflow is first come, first served: the k-th overflowing key of the ring has the k-th place taken.
    walk = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    over = (
        planned.filter("n > stays")
        .select("arc", "stays", (F.col("n") - F.col("stays")).alias("over"))
        .withColumn("start", F.coalesce(F.sum("over").over(walk), F.lit(0)))
    )
    moved = (
        over.join(taken, (F.col("lo") < F.col("start") + F.col("over")) & (F.col("hi") > F.col("start")))
        .withColumn("lo2", F.greatest("lo", "start"))
        .select(
            "arc",
            (F.col("stays") + F.col("lo2") - F.col("start")).alias("from_rank"),
            (F.col("stays") + F.least("hi", F.col("start") + F.col("over")) - F.col("start")).alias("to_rank"),
            "shard",
            (F.col("slot") + F.col("lo2") - F.col("lo")).alias("slot"),
        )
    )
    return home.unionByName(moved)


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key as doc_id, bytes, text_crc32, home_shard, shard and slot.

    home_shard is the ring's own choice, shard the one after overflow. Slots
    run from 0 without gaps in each shard. With slack 0 any two shards differ
    by at most one row.

    Defined cases: a null key hashes as a key of its own; a null text counts
    as empty (16 bytes, crc32 0); repeated rows are rows like any other; an
    empty table gives an empty result; other columns, whatever their names,
    are not read. Rows of one key with different texts are ranked in PARTS
    tasks; only rows equal in key and text meet in one.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 16).alias("bytes"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
    ).withColumns(
        {
            "hash": _hash(F.col("doc_id")),
            "cell": _cell(_hash(F.col("doc_id")), cells_for(shards, vnodes)),
            "part": F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text_crc32"), F.lit(PARTS)).cast("int"),
        }
    )
    slim = stored(slim, "shard-keys")  # the texts are read once
    around = stored(ring(spark, shards, vnodes), "shard-ring")
    cells = F.broadcast(around)  # as many rows as the parameters say, at any size of input
    parts = slim.join(cells, "cell").groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(parts, "shard-counts")  # shards * vnodes * PARTS rows at most
    arcs = around.select("arc", "shard").distinct().join(parts.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").fillna(0, "n")
    earlier = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("arc", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    plan = stored(allotment(arcs, shards, slack), "shard-plan").withColumnRenamed("shard", "to_shard")
    placed, there = plan.agg(F.sum(F.col("to_rank") - F.col("from_rank"))).first()[0], parts.agg(F.sum("n")).first()[0]
    if placed != there:
        raise ValueError(f"{there} rows, but places for {placed}")

    in_part = Window.partitionBy("arc", "part").orderBy("hash", "doc_id", "text_crc32", "bytes")
    ranked = (
        slim.join(cells, "cell")
        .withColumn("nth", F.row_number().over(in_part))
        .join(F.broadcast(starts), ["arc", "part"])
        .withColumn("rank", F.col("start") + F.col("nth") - 1)
    )
    here = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("arc", "of_arc")), (F.col("arc") == F.col("of_arc")) & here)
        .select("doc_id", "bytes", "text_crc32", F.col("shard").alias("home_shard"), F.col("to_shard").alias("shard"), (F.col("slot") + F.col("rank") - F.col("from_rank")).alias("slot"))
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_rows(spread(table(spark, sf_dir, "documents")), SHARDS, VNODES)
    return placed.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
