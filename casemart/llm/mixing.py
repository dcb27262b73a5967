"""Mixing sources to target weights by temperature, as DataFrame operations.

Every source's share of the tokens is raised to an exponent between 0 (all
sources alike) and 1 (as they are). The exponent is bisected until the weights
reach a target entropy, or until no source has to repeat more than a limit.
The normalised weights become token budgets, and a budget is realised by
passes over the source's blocks: every pass visits all blocks in an order of
its own, and the last pass ends where the budget does.

Only sources and blocks are ever ranked. Blocks hold about `BLOCK_TOKENS`
tokens, dealt by a hash, so a source with a third of all rows is as many
blocks as it needs and lies in no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, spread, stored, table

#: Share of the largest possible entropy that the weights reach.
TARGET_ENTROPY = 0.92
#: Passes over a source at most.
REPEAT_LIMIT = 4.0
BLOCK_TOKENS = 16_384
#: Blocks of one source at most; larger sources have larger blocks.
MOST_BLOCKS = 1 << 16
#: Exponents tried in one pass over the shares; a pass narrows the interval as six halvings do.
TRIED = 63
PASSES = 6
#: Parts of a source's stream that `turn` counts.
TURNS = 1_000_000
SEED = "mix"


def tokens(text: Column) -> Column:
    """Words between white space, the token count of the weights."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def hashed(*parts: Column) -> Column:
    """52 bits of an MD5 as a whole number: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", *[p.cast("string") for p in parts]), "utf-8")), 1, 13), 16, 10).cast("long")


def named(source: Column) -> Column:
    """A key for every source, null and empty ones apart."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def bisect(shares: DataFrame, target_entropy: float, repeat_limit: float, budget_share: float, cover: bool = False) -> float:
    """The largest exponent in [0, 1] whose weights reach the target, to about 1e-11.

    shares: one row a source with its `share`. Entropy falls and repetition
    falls as the exponent grows: the entropy target bounds it from above, the
    repetition limit from below, and the limit wins where they disagree. Every
    pass evaluates TRIED exponents and brings back one number for each.

    A source is passed p^a / (z p) * budget_share times. With `cover` the
    budget is that of plan(), so the smallest source is passed as often as the
    raised budget makes it. A budget of more than repeat_limit corpora passes
    every source more often whatever the exponent: then it is 1.
    """
    n = shares.count()
    if n <= 1:
        return 1.0

    def search(good, low: float, high: float) -> float:
        """The boundary in [low, high] of a condition that holds at low and not at high."""
        for _ in range(PASSES):
            step = (high - low) / (TRIED + 1)
            power = F.pow("share", F.lit(low) + F.lit(step) * F.col("k"))
            # sums of p^a, and of p^a ln p for the entropy; the largest p^a / p is that of the smallest source
            sums = shares.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(TRIED)))).groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("slope")).collect()
            held = max((r.k for r in sums if good(low + step * r.k, r.z, r.slope)), default=0)
            low, high = low + step * held, low + step * (held + 1)
        return low

    def spread(a: float, z: float, slope: float) -> bool:
        return math.log(z) - a * slope / z >= target_entropy * math.log(n)

    def repeats(a: float, z: float, _slope: float = 0.0) -> bool:
        spent = max(budget_share, most ** (1 - a) * z) if cover else budget_share
        return least ** (a - 1) / z * spent > repeat_limit  # holds where the limit is passed

    whole, least, most = shares.agg(F.sum(-F.col("share") * F.log("share")), F.min("share"), F.max("share")).first()
    highest = 1.0 if whole >= target_entropy * math.log(n) else search(spread, 0.0, 1.0)
    if repeats(0.0, n):
        lowest = search(repeats, 0.0, 1.0)
        highest = max(highest, min(1.0, lowest + 1e-9))
    return round(highest, 9)


def plan(sizes: DataFrame, target_entropy: float, repeat_limit: float, budget_tokens: int | None, cover: bool) -> DataFrame:
    """source_key, n_tokens, n_blocks, weight, budget of every source with tokens.

    sizes: source_key, n_tokens. The budget is budget_tokens (all tokens if
    None); with `cover` it is raised to the least with which every source is
    passed once. No source with a positive budget is passed more than
    repeat_limit times, up to the rounding of its budget to whole tokens.
    """
    sizes = stored(sizes.filter("n_tokens > 0"), "mix-sources")
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return sizes.select("source_key", "n_tokens", F.lit(0).alias("n_blocks"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    shares = sizes.withColumn("share", F.col("n_tokens") / F.lit(float(total)))
    wanted = total if budget_tokens is None else budget_tokens
    exponent = bisect(shares, target_entropy, repeat_limit, wanted / total, cover)
    z, most = shares.agg(F.sum(F.pow("share", F.lit(exponent))), F.max("share")).first()
    if cover:
        wanted = max(wanted, round(total * most ** (1 - exponent) * z))
    weight = F.round(F.pow("share", F.lit(exponent)) / F.lit(z), 12)
    block = F.greatest(F.lit(BLOCK_TOKENS), F.ceil(F.col("n_tokens") / F.lit(MOST_BLOCKS)))
    return shares.select(
        "source_key",
        "n_tokens",
        F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / block)).cast("int").alias("n_blocks"),
        weight.alias("weight"),
        # with `cover` rounding never takes the last document of the largest source
        (F.greatest(F.round(weight * wanted), F.col("n_tokens")) if cover else F.round(weight * wanted)).cast("long").alias("budget"),
    )


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, repeat_limit: float = REPEAT_LIMIT, budget_tokens: int | None = None, cover: bool = False, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, turn: one row for each time that a document is taken.

    turn places the row's block in its source's stream, in millionths; rows
    sorted by (turn, source, epoch, block, doc_id) interleave the sources evenly.

    Defined cases: null is a source of its own; a document without tokens is
    taken whenever its whole block is, as it costs nothing, and a source
    without any tokens is passed once; repeated rows are rows like any other; an empty table gives
    an empty result; further columns are not read.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), named(F.col(source)).alias("source_key"), tokens(F.col(text)).alias("n_tokens"))
    slim = stored(slim, "mix-rows")  # the texts are read once
    sources = stored(plan(slim.groupBy("source_key").agg(F.sum("n_tokens").alias("n_tokens")), target_entropy, repeat_limit, budget_tokens, cover), "mix-plan")
    # one row a source: Spark broadcasts it where it is small and splits a large source where it is not
    dealt = (
        slim.join(sources.select("source_key", "n_blocks", "budget"), "source_key", "left")
        .withColumn("block", F.coalesce(F.pmod(hashed(F.lit(seed), F.col("source_key"), F.col("doc_id")), F.col("n_blocks")), F.lit(0)).cast("int"))
        .drop("n_blocks")
    )
    blocks = dealt.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    passes = (
        blocks.join(sources.select("source_key", F.col("n_tokens").alias("of_source"), "budget"), "source_key", "left")
        .withColumn("full", F.coalesce(F.floor(F.col("budget") / F.col("of_source")), F.lit(1)))
        .withColumn("rest", F.coalesce(F.col("budget") % F.col("of_source"), F.lit(0)))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
        .withColumn("order", hashed(F.lit(seed), F.col("source_key"), F.col("epoch"), F.col("block")))
    )
    visits = Window.partitionBy("source_key", "epoch").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    passes = (
        passes.withColumn("before", F.coalesce(F.sum("block_tokens").over(visits), F.lit(0)))
        # what the pass has left for this block: all of it in a full pass
        .withColumn("room", F.when(F.col("epoch") < F.col("full"), F.col("block_tokens")).otherwise(F.col("rest") - F.col("before")))
        .filter("(epoch < full) or room > 0")
        .withColumn("turn", F.coalesce(F.floor((F.col("epoch") * F.col("of_source") + F.col("before")) / F.nullif("budget", F.lit(0)) * TURNS), F.lit(0)).cast("long"))
        .select("source_key", "block", "epoch", "turn", "room", (F.col("room") >= F.col("block_tokens")).alias("entire"))
    )
    in_block = Window.partitionBy("source_key", "block").orderBy(hashed(F.lit(seed), F.col("doc_id")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.withColumn("upto", F.sum("n_tokens").over(in_block)).drop("budget")
    return (
        upto.join(passes, ["source_key", "block"])
        .filter("entire or (upto <= room and n_tokens > 0)")
        .select("doc_id", "source", "n_tokens", "epoch", "block", "turn")
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents themselves, each as often as `mix` takes it, all columns unchanged. Rows that repeat id, source and length are taken together."""
    taken = mix(docs, key=key, text=text, source=source, **options)
    times = taken.select("doc_id", named(F.col("source")).alias("s"), "n_tokens", "epoch").distinct().groupBy("doc_id", "s", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("n"))
    free = "mix_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    times = times.toDF(*[free + c for c in times.columns])
    same = docs[key].eqNullSafe(times[free + "doc_id"]) & (named(docs[source]) == times[free + "s"]) & (tokens(docs[text]) == times[free + "n_tokens"])
    again = docs.join(times.hint("merge"), same).withColumn(free, F.explode(F.sequence(F.lit(1), F.col(free + "n"))))
    return again.select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spread(table(spark, sf_dir, "documents")))


#: With the parameters above.
OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS k, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT k, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY k HAVING sum(n_tokens) > 0), t AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS sources FROM s),
p AS (SELECT k, n, n / CAST(total AS DOUBLE) AS share, sources, total FROM s, t),
bis AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2)) >= {TARGET_ENTROPY} * ln(max(sources)) AS ok
    FROM bis, p WHERE i < 50 GROUP BY i, lo, hi)),
lim AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL SELECT i + 1, CASE WHEN over_ THEN mid ELSE lo END, CASE WHEN over_ THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow(min(share), (lo + hi) / 2 - 1) / sum(pow(share, (lo + hi) / 2)) > {REPEAT_LIMIT} AS over_
    FROM lim, p WHERE i < 50 GROUP BY i, lo, hi)),
a AS (SELECT CASE WHEN max(sources) <= 1 THEN 1.0 ELSE round(greatest(
    CASE WHEN -sum(share * ln(share)) >= {TARGET_ENTROPY} * ln(max(sources)) THEN 1.0 ELSE (SELECT lo FROM bis WHERE i = 50) END,
    CASE WHEN 1 / (max(sources) * min(share)) > {REPEAT_LIMIT} THEN least(1.0, (SELECT lo FROM lim WHERE i = 50) + 1e-9) ELSE 0.0 END), 9) END AS a FROM p),
z AS (SELECT sum(pow(share, a)) AS z FROM p, a),
pl AS (SELECT k, n, CAST(round(round(pow(share, a) / z, 12) * total) AS BIGINT) AS budget, CAST(greatest(1, ceil(n / greatest({BLOCK_TOKENS}, ceil(n / {MOST_BLOCKS}.0)))) AS BIGINT) AS n_blocks FROM p, a, z),
dl AS (SELECT d.*, coalesce(('0x' || substr(md5('{SEED}:' || d.k || ':' || doc_id), 1, 13))::BIGINT % n_blocks, 0) AS block FROM d LEFT JOIN pl USING (k)),
b AS (SELECT k, block, CAST(sum(n_tokens) AS BIGINT) AS bt FROM dl GROUP BY ALL),
e AS (SELECT b.*, n, budget, coalesce(budget // n, 1) AS full_, coalesce(budget % n, 0) AS rest, unnest(range(0, coalesce(budget // n, 1) + 1)) AS epoch FROM b LEFT JOIN pl USING (k)),
o AS (SELECT *, coalesce(sum(bt) OVER (PARTITION BY k, epoch ORDER BY ('0x' || substr(md5('{SEED}:' || k || ':' || epoch || ':' || block), 1, 13))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
r AS (SELECT *, CASE WHEN epoch < full_ THEN bt ELSE rest - before END AS room, coalesce(floor((epoch * n + before) / CAST(nullif(budget, 0) AS DOUBLE) * {TURNS}), 0) AS turn FROM o),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY k, block ORDER BY ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM dl)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(u.block AS INTEGER) AS block, CAST(turn AS BIGINT) AS turn FROM u JOIN r ON u.k = r.k AND u.block = r.block
WHERE (epoch < full_ OR room > 0) AND (room >= bt OR (upto <= room AND n_tokens > 0))
"""
