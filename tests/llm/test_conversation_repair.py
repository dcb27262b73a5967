import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from casemart.llm import conversation_repair as repair
from casemart.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part int, block long, mark string, audit string"
ROLES = ("user", "assistant", "system", "tool", "", None)


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def best(rows):
    """The least (cost, audit, repaired lines) of all edits; deleting every row is always possible and bounds the cost."""
    most, found = 2 * len(rows), []

    def go(at, cost, audit, roles, lines):
        if cost > most:
            return
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit, lines))
        else:
            role, text, fault = rows[at]
            go(at + 1, cost + 2, audit + "D", roles, lines)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                go(at + 1, cost + extra, audit + "K", roles + (role[:1] or "-"), [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(at + 1, cost + 1 + extra, audit + "R", roles + new[0], [*lines, f"{new}:{text}"])
        for new in ("user", "assistant"):
            go(at, cost + 5, audit + "I", roles + new[0], [*lines, f"{new}:"])

    go(0, 0, "", "", [])
    return min(found)


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            role = "user" if fate == 4 else role
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            yield from [(conv, turn, role, text)] * (1 + (fate == 3))


def expected(rows, harm=True):
    """Results by conversation, by brute force."""
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in damage(rows) if harm else ((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows):
        groups[conv].append((turn, role, text))
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1], r[2])))
        seen, marked, counts = set(), [], defaultdict(int)
        for _, role, text in group:
            body = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = {t for t, _, _ in group if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = best(marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "four", "five ", "six.\n", " ", "", None, "\x0b\x0c", "sevén", "\x1c"]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(ROLES) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.1 else turn + (rng.random() < 0.2), role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."))
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "m", "a") for r in rows], SCHEMA).repartition(5)


def results(spark, rows):
    plan = repair.plans(frame(spark, rows))
    sums = {r.conv_id: r.repaired_sha256 for r in repair.line_digests(repair.repaired(frame(spark, rows), plan)).collect()}
    return {r.conv_id: (*tuple(r)[1:], sums.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in plan.collect()}


def test_agenda_against_all_edits():
    rng = random.Random(1)
    for _ in range(1_500):
        rows = [(rng.choice("suat"), "", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 4))]
        final = repair.lightest([(r, f == "truncated", int(f in ("blank", "duplicate"))) for r, _, f in rows], "E", repair.GOALS)
        assert min(final.values()) == best(rows)[:2], rows


def test_spans_join_to_the_same_weights():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.random() < 0.3, rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(2, 12))]
        cut = rng.randint(0, len(rows))
        left, right = ({p + q: w for p in repair.STATES for q, w in repair.lightest(part, p).items()} for part in (rows[:cut], rows[cut:]))
        assert repair.joined(left, right) == {p + q: w for p in repair.STATES for q, w in repair.lightest(rows, p).items()}


@pytest.mark.parametrize("block", [256, 2, 1])
def test_awkward_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "JOINED", 64 if block > 2 else 2)
    rows = random_rows(block, 60, 5)
    assert results(spark, rows) == expected(rows, harm=False)


def test_one_long_conversation_in_blocks(spark, monkeypatch):
    """Blocks over all tasks give what one agenda gives."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"T{t}.", f"T{t}", "same.", ""])) for t in range(600)]
    monkeypatch.setattr(repair, "BLOCK", 16)
    monkeypatch.setattr(repair, "JOINED", 4)
    in_blocks = results(spark, rows)
    marks, seen = [], set()
    for _, _, role, text in rows:
        go = not text or (role, text) in seen
        seen.add((role, text))
        marks.append((role[0], not text.endswith("."), int(go)))
    assert in_blocks[7][5:7] == min(repair.lightest(marks, "E", repair.GOALS).values())
    assert in_blocks[7][1] == sum(not r[3] for r in rows)


def test_long_text_and_nothing(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "Yes.")]
    got = results(spark, rows)
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "KK")
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.plans(empty).count() == 0
    assert repair.repaired(empty, repair.plans(empty)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rows = random_rows(9, 150, 4)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert got.dtypes == [("conv_id", "bigint"), *((c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string")]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(rows)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})
