import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, bucket string, rank int, start int, shard int, node long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "ke", "su", "no", "li"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    texts = [*base, base[0], base[0].replace(" ", "  \n"), base[1] + " " + prose(rng, 4), " ".join(base[2].split()[5:]) + " " + prose(rng, 5)]
    texts += [None, None, "", "   \n\t ", "one", "é 日本 🎉 ß", "x " * 30_000, prose(rng, 9_000), "!!! ###" * 20, "a b c d"]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}", f"{prose(rng, 25)} {passage} {prose(rng, 70)}"]
    out = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 0, 9, "b", 1, 2, 3, 4) for k, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base[4], None, "s1", 0, 9, "b", 1, 2, 3, 4))
    return out


@pytest.fixture(scope="session")
def messy(spark, rows):
    """Also with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark, rows):
    """The same without null and repeated ids."""
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return spark.createDataFrame(out, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
