import random
import re

from pyspark.sql import functions as F

from casemart.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(spark):
    texts = ["", None, "a b c a b c", "a b c b a", "x\nx\n\n y\nx", "# * é|ß <b>\x0b\x0c w", "a a a a", "one two", " \n\t", "a b c d a b c\nq\nq"]
    got = quality.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_verdict_ignores_order(messy, rows):
    a = quality.report(messy).collect()
    b = quality.report(messy, rules=tuple(reversed(quality.RULES))).collect()
    assert sorted((str(r.doc_id), r.kept) for r in a) == sorted((str(r.doc_id), r.kept) for r in b)
    assert len(a) == len(rows)
    assert sum(r.kept for r in a) == quality.keep_good(messy).count()
    assert quality.keep_good(messy).columns == messy.columns


def test_plan_has_every_rule_once(messy, nothing):
    assert {x["rule"].name for x in quality.plan(messy)} == {r.name for r in quality.RULES}
    assert quality.keep_good(nothing).count() == 0 and quality.report(nothing).count() == 0


def test_windows_with_one_code_are_told_apart_by_their_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", quality.words(F.col("t")).alias("w"))
    # the same upper bits for every window
    clashing = F.when(F.size("w") >= 3, F.sequence(F.lit(0).cast("long"), (F.size("w") - 3).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    got = docs.select("id", quality.repeat_words_of(F.col("w"), quality.window_codes(quality.window_hashes(F.col("w")))).alias("a"), quality.repeat_words_of(F.col("w"), clashing).alias("b"), quality.n_repeat_words(F.col("w")).alias("c"))
    for r in got.collect():
        assert r.a == r.b == r.c == brute(texts[r.id])[4]


def test_the_cascade_stops_at_the_first_rejection(spark):
    """A rule that fails on sight is never reached by a text that an earlier rule rejects."""
    bomb = quality.Rule("bomb", lambda t, w: F.raise_error("reached").isNotNull())
    short = quality.RULES[0]
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert docs.filter(quality.first_failed(F.col("text"), [short, bomb]).isNull()).count() == 0


def test_cheap_rules_that_reject_much_come_first(spark):
    slow = quality.Rule("slow", lambda t, w: F.size(F.array_distinct(F.sort_array(F.transform(w, lambda x: F.sha2(x, 512))))) < 0)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") % 200).cast("int")).alias("text"))
    order = quality.plan(docs, (slow, quality.RULES[0]))
    assert [x["rule"].name for x in order] == ["short", "slow"] and order[0]["cost"] < order[1]["cost"]
