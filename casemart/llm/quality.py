"""Quality rules as a short-circuit cascade of native expressions.

Every rule is one Boolean expression over a text and its words, which are
split once for all rules. A pilot of a few hundred rows from all partitions
gives each rule's cost (seconds a row, without those of an empty job) and,
among the rows that earlier rules leave, its rejections; the next rule is
always the one with the most rejections per cost. The verdict is a `when`
chain in that order, which Spark evaluates lazily, so a text that an early
rule rejects costs no later rule. The order decides the cost only: the verdict
is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, let, spread, stored, table

#: Rows of the pilot that orders the rules, about, how often each is judged when a rule is timed, and the longest texts in it. It never decides a verdict.
PILOT_ROWS, PILOT_TIMES, PILOT_CHARS = 400, 5, 50_000
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, ""))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _marked(s: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The elements of a sorted array that are the same as one of their neighbours."""
    return F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))


def _covered(starts: Column) -> Column:
    """Words in the 3-word windows that start at these places, ascending."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).cast("long").alias("last"))
    return F.aggregate(starts, zero, lambda t, p: F.struct((t.n + F.least(F.lit(3).cast("long"), p - t["last"])).alias("n"), p.alias("last")), lambda t: t.n)


def window_hashes(w: Column) -> Column:
    """A hash of every 3-word window, in their order."""
    numbers = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(numbers)


def _bits(h: Column) -> Column:
    return F.length(F.bin(F.size(h)))


def window_codes(h: Column) -> Column:
    """The windows as whole numbers, sorted: the place in the lowest bits, as many as their number needs, and the hash above it."""
    return F.sort_array(F.transform(h, lambda x, i: F.coalesce(F.call_function("shiftleft", x, _bits(h)).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))))


def _by_words(w: Column) -> Column:
    """The count by the windows' words themselves, for a text in which two different windows have one code."""

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("p")))
    return let(F.sort_array(windows), lambda s: _covered(F.sort_array(F.transform(_marked(s, same), lambda x: x.p))))


def repeat_words_of(w: Column, codes: Column) -> Column:
    """Words in windows found twice or more. Windows of one code stand side by side; the words tell whether they are the same."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), _bits(codes)) - 1
    alike = lambda x, y: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), _bits(codes)) == 0, F.lit(False))

    def counted(again: Column) -> Column:
        def differ(i: Column) -> Column:
            x, y = F.get(again, i), F.get(again, i - 1)
            p, q = x.bitwiseAND(mask), y.bitwiseAND(mask)
            return alike(x, y) & ((F.get(w, p) != F.get(w, q)) | (F.get(w, p + 1) != F.get(w, q + 1)) | (F.get(w, p + 2) != F.get(w, q + 2)))

        clash = F.exists(F.sequence(F.lit(1), F.size(again) - 1), differ)
        places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask)))
        return F.when(F.size(again) == 0, F.lit(0).cast("long")).when(clash, _by_words(w)).otherwise(_covered(places))

    return let(_marked(codes, alike), counted)


def _repeats(w: Column, h: Column) -> Column:
    # most texts repeat no window: as many hashes as windows say so
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(window_codes(h), lambda codes: repeat_words_of(w, codes)))


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Codes of windows are sorted, so the work is n log n in the words."""
    return let(window_hashes(w), lambda h: _repeats(w, h))


@dataclass(frozen=True)
class Rule:
    """`rejects` takes the text and its words and is true for a text to reject; it is never null. `by_counts` says the same by the counts of report(), where they tell."""

    name: str
    rejects: Callable[[Column, Column], Column]
    by_counts: str | None = None


RULES = (
    Rule("short", lambda t, w: F.size(w) < 50, "n_words < 50"),
    Rule("repeats", lambda t, w: 100 * n_repeat_words(w) > 50 * F.size(w), "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", lambda t, w: 10 * n_symbols(t) > F.size(w), "10 * n_symbols > n_words"),
    Rule("word_length", lambda t, w: ~let(word_chars(w), lambda n: n.between(3 * F.size(w), 15 * F.size(w))), "word_chars not between 3 * n_words and 15 * n_words"),
    Rule("repeated_lines", lambda t, w: let(lines(t), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 5 * F.size(x)), "10 * n_dup_lines > 5 * n_lines"),
    Rule("shouting", lambda t, w: 10 * F.regexp_count(t, F.lit(r"[!?]{2,}")) > F.size(w)),
)


def plan(docs: DataFrame, rules=RULES, text: str = "text", pilot_rows: int = PILOT_ROWS) -> list[dict]:
    """The rules in the order in which the cascade runs them, with the pilot's cost and rejections. Texts over PILOT_CHARS are not in the pilot, which bounds its bytes."""
    n = docs.count()
    bodies = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.length("t") <= PILOT_CHARS)
    pilot = stored(bodies.sample(min(1.0, pilot_rows / max(n, 1)), 7).withColumn("w", words(F.col("t"))).repartition(1), "rule-pilot")
    said = pilot.select(*(r.rejects(F.col("t"), F.col("w")).alias(r.name) for r in rules)).collect()
    if not said:
        return [{"rule": r, "cost": 0.0, "rejected": 0} for r in rules]
    again = pilot.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(PILOT_TIMES))))

    def seconds(verdict: Column) -> float:
        runs = []
        for _ in range(3):  # the first run also compiles
            began = time.perf_counter()
            again.agg(F.count_if(verdict)).first()
            runs.append(time.perf_counter() - began)
        return min(runs)

    empty = seconds((F.length("t") < 0) & (F.size("w") < 0))
    cost = {r.name: max(seconds(r.rejects(F.col("t"), F.col("w"))) - empty, 1e-4) / len(said) / PILOT_TIMES for r in rules}
    order, left, rows = [], list(rules), said
    while left:
        best = max(left, key=lambda r: sum(x[r.name] for x in rows) / cost[r.name])
        order.append({"rule": best, "cost": cost[best.name], "rejected": sum(x[best.name] for x in rows)})
        rows = [x for x in rows if not x[best.name]]
        left.remove(best)
    discard(pilot)
    return order


def _first_of(rules, rejects: Callable[[Rule], Column]) -> Column:
    """The name of the first of these rules that rejects, or null; later ones are not evaluated then."""
    chain = F
    for r in rules:
        chain = chain.when(rejects(r), F.lit(r.name))
    return chain.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def first_failed(text: Column, rules) -> Column:
    """The name of the first of these rules that rejects the text, or null."""
    return let(words(text), lambda w: _first_of(rules, lambda r: r.rejects(text, w)))


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, all columns unchanged.

    A null text counts as empty. An empty table stays empty, repeated rows
    are judged alike, and further columns pass through whatever their names.
    """
    order = [x["rule"] for x in plan(docs, rules, text)]
    return docs.filter(first_failed(F.coalesce(docs[text], F.lit("")), order).isNull())


def report(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed, the first rule of the cascade that rejects it, and kept.

    The counts are asked of every text, so rules that they decide cost nothing
    more; the others are evaluated on texts that no earlier rule rejects.

    Null and empty texts have no words and fail; repeated rows and ties get
    equal results; an empty table gives an empty one; all other columns are
    ignored.
    """
    order = [x["rule"] for x in plan(docs, rules, text)]
    # a projection for each step: Spark does not fold one into the next where its columns are used more than once
    split = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("doc_id", "t", words(F.col("t")).alias("w"), lines(F.col("t")).alias("x"))
    counted = split.select(
        "doc_id", "t", "w",
        F.size("w").cast("long").alias("n_words"),
        word_chars(F.col("w")).cast("long").alias("word_chars"),
        n_symbols(F.col("t")).cast("long").alias("n_symbols"),
        F.size("x").cast("long").alias("n_lines"),
        (F.size("x") - F.size(F.array_distinct("x"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("w")).alias("h"),
    )
    counted = counted.withColumn("n_repeat_words", _repeats(F.col("w"), F.col("h")))
    base = F.expr(RULES[0].by_counts) | F.expr(RULES[1].by_counts)
    rejected = _first_of(order, lambda r: r.rejects(F.col("t"), F.col("w")) if r.by_counts is None else F.expr(r.by_counts))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rejected.alias("rejected_by"), (~base & rejected.isNull()).alias("kept")
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return report(spread(table(spark, sf_dir, "documents"))).drop("rejected_by")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3),
gram AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS n FROM pos),
hit AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM gram WHERE n >= 2),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             len(regexp_extract_all(t, '[!?]{2,}')) AS shouts
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 15 * n_words
                                OR 10 * n_dup_lines > 5 * n_lines OR 10 * shouts > n_words) AS kept
FROM b
"""
