"""Conversations repaired by Knuth's lightest derivation.

A repaired conversation has the roles (s?(ua)+)?: perhaps a system turn, then
user and assistant in turn, or nothing. An item says that the rows up to some
place can be edited so that the roles so far end in a state. From an item and
the next row's edits follow further items, each with a cost and an audit, the
initials of the edits so far. The agenda pops the item of least (cost, audit);
no edit makes an item lighter, so what is popped first is final, and the
derivation ends when the goal does. Two derivations of one item never have the
same cost and one audit that begins with the other, since the difference would
be insertions alone, which cost something: so adding edits keeps their order,
as Knuth's superior functions must.

Rows are dealt over the tasks by range of conversation and turn. A
conversation inside a task is one agenda. A longer one, however many rows it
has, is cut into blocks; each gives items that span it from any state to any
other, and neighbouring spans are joined two by two, the lightest way through
the state between them. Only the rows' marks travel for that, not their texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stored, table

#: Costs of the edits; an open end is a text whose last character closes no sentence.
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Where a role leads: nothing yet, a system turn, a user's, an assistant's.
MOVES = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
GOALS = ("E", "A")
STATES = "ESUA"
LEGAL = frozenset(("su", "ua", "au"))
#: Rows of a block.
BLOCK = 256
#: Spans of one conversation that a task joins at a time.
JOINED = 64

Row = tuple[str, bool, int]  # role's initial, whether the end is open, 0 or the number of copies that must go
Weight = tuple[int, str]


def edits(row: Row, state: str) -> Iterator[tuple[int, str, str]]:
    """Cost, initial and next state of each edit of a row."""
    initial, is_open, must_go = row
    yield DELETE * max(1, must_go), "D" * max(1, must_go), state
    if not must_go:
        extra = OPEN_END * is_open
        if (state, initial) in MOVES:
            yield KEEP + extra, "K", MOVES[state, initial]
        for role in ROLES:
            if (state, role) in MOVES:
                yield REROLE + extra, "R", MOVES[state, role]


def lightest(rows: list[Row], start: str, goals: tuple[str, ...] = ()) -> dict[str, Weight]:
    """The lightest (cost, audit) from `start` over all rows to each state, or to the first of `goals` that is final."""
    final: dict[tuple[int, str], Weight] = {}
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final[at, state] = cost, audit
        if at == len(rows):
            if state in goals:
                return {state: (cost, audit)}
        else:
            for more, initial, to in edits(rows[at], state):
                if (at + 1, to) not in final:
                    heapq.heappush(agenda, (cost + more, audit + initial, at + 1, to))
        for role in ROLES:
            to = MOVES.get((state, role))
            if to and (at, to) not in final:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", at, to))
    return {state: final[len(rows), state] for state in STATES if (len(rows), state) in final}


def joined(left: dict[str, Weight], right: dict[str, Weight]) -> dict[str, Weight]:
    """Spans side by side, by their two states: the lightest way through any state between them."""
    out: dict[str, Weight] = {}
    for (a, b), (c1, a1) in ((tuple(k), v) for k, v in left.items()):
        for (c, d), (c2, a2) in ((tuple(k), v) for k, v in right.items()):
            if b == c and (a + d not in out or (c1 + c2, a1 + a2) < out[a + d]):
                out[a + d] = c1 + c2, a1 + a2
    return out


def slim(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, one space for a null role or text, and the hash of both."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), mark.alias("mark"))


def marked(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: what the repair needs to know of them, their number, and whether an earlier turn has the same role and text.

    The numbers of equal rows are summed before they are dealt out, and first
    places are joined by conversation, turn and hash, which no two rows share.
    """
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    light = slim(rows).select("conv_id", "turn", "mark", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"))
    counted = light.groupBy("conv_id", "turn", "mark").agg(F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("open").alias("open"), F.count("*").alias("copies"))
    counted = stored(counted, "conversation-marks")
    firsts = counted.groupBy("conv_id", "mark").agg(F.min(F.struct("turn")).alias("spot")).select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), F.col("spot.turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("mark") == F.col("m"))
    return counted.join(firsts, same, "left").select("conv_id", "turn", "mark", "initial", "blank", "open", "copies", F.col("m").isNotNull().alias("first"))


SPAN = "conv_id long, part int, block long, done boolean, spans map<string, struct<cost: long, audit: string>>, blank long, duplicate long, truncated long, illegal long, initials string, turns long, least long, most long"
SPAN_TYPE = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("done", pa.bool_()), ("spans", pa.map_(pa.string(), pa.struct([("cost", pa.int64()), ("audit", pa.string())]))),
        *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("initials", pa.string()), *((c, pa.int64()) for c in ("turns", "least", "most")),
    ]
)
LINE = "conv_id long, position long, edit string, role string, text string"
LINE_TYPE = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _span(group: list[dict], block: int, begins: bool, ends: bool) -> dict:
    """What one block of a conversation gives; `begins` and `ends`: no rows of it come before, or after."""
    rows: list[Row] = []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    before = None
    for m in group:
        n, initial, clean = m["copies"], m["initial"], m["first"] and not m["blank"]
        counts["illegal"] += (before is not None and before + initial not in LEGAL) + n - 1  # no role may follow itself
        before = initial
        counts["blank" if m["blank"] else "duplicate"] += n - clean
        counts["truncated"] += clean and m["open"]
        if clean:
            rows.append((initial, m["open"], 0))
        if n > clean:
            rows.append((initial, False, n - clean))
    turns = [m["turn"] for m in group if m["turn"] is not None]
    alone = begins and ends
    spans = {p + q: {"cost": c, "audit": a} for p in ("E" if begins else STATES) for q, (c, a) in lightest(rows, p, GOALS if alone else ()).items()}
    return {
        "conv_id": group[0]["conv_id"], "part": group[0]["part"], "block": block, "done": alone, "spans": list(spans.items()), **counts,
        "initials": group[0]["initial"].ljust(1) + group[-1]["initial"].ljust(1), "turns": len(set(turns)), "least": turns[0] if turns else None, "most": turns[-1] if turns else None,
    }


def _pair(a: dict, b: dict) -> dict:
    """Two neighbouring spans of a conversation as one."""
    left, right = ({k: (v["cost"], v["audit"]) for k, v in x["spans"]} for x in (a, b))
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["initials"][1] + b["initials"][0] not in LEGAL
    known = [x for x in (a, b) if x["least"] is not None]
    out["turns"] -= len(known) == 2 and a["most"] == b["least"]
    return a | out | {
        "spans": [(k, {"cost": c, "audit": w}) for k, (c, w) in joined(left, right).items()], "initials": a["initials"][0] + b["initials"][1],
        "least": known[0]["least"] if known else None, "most": known[-1]["most"] if known else None,
    }


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _batched(rows: Iterable[dict], kind: pa.Schema, size: int = 1_000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a task's rows, which come by conversation and turn. The first and the last conversation may go on in other tasks."""

    def spans() -> Iterator[dict]:
        group: list[dict] = []
        n, whole = 0, False  # blocks of this conversation so far; whether it began in this task
        for row in _records(batches):
            if group and (row["conv_id"] != group[0]["conv_id"] or len(group) == BLOCK):
                ends = row["conv_id"] != group[0]["conv_id"]
                yield _span(group, n, whole and not n, ends)
                n, whole, group = (0, True, []) if ends else (n + 1, whole, [])
            group.append(row)
        if group:
            yield _span(group, n, whole and not n, False)

    return _batched(spans(), SPAN_TYPE)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slot's spans, JOINED at most and in their order, as one."""

    def spans() -> Iterator[dict]:
        for (_, slot), group in groupby(_records(batches), key=lambda r: (r["conv_id"], r["slot"])):
            some = list(group)
            while len(some) > 1:
                some = [_pair(*some[k : k + 2]) if k + 1 < len(some) else some[k] for k in range(0, len(some), 2)]
            yield {k: v for k, v in some[0].items() if k != "slot"} | {"block": slot}

    return _batched(spans(), SPAN_TYPE, 100)


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation with rows: gaps, the faults' counts, cost and audit of the cheapest repair.

    Rows are taken by turn, nulls first; rows of one turn by the hash of role
    and text. A row is blank if its text has white space only, else duplicate
    if role and text were there before, else truncated if its last character
    that is no white space is none of .!? (the first that holds counts). Null
    roles and texts are one space; an empty role has no initial, so it can
    only be changed or go. A null conv_id is a conversation of its own. `gaps`
    are the turns missing between the least and the greatest; null ones don't
    count. Repeated rows are duplicates; very long texts are hashed and never
    gathered; further columns are not read; an empty table gives an empty one.
    """
    n = parallelism(rows.sparkSession)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("mark")]
    dealt = stored(marked(rows), "conversation-rows").repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stored(dealt.drop("mark").withColumn("part", F.spark_partition_id()).mapInArrow(_blocks, SPAN), "conversation-spans")
    # blocks get their numbers in a conversation from the counts of the tasks before; then each JOINED become one, until one is left
    rest = found.filter("not done")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    tasks = rest.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    spans = stored(rest.join(tasks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("block", F.col("block") + F.col("before")).drop("c", "p", "before"), "conversation-blocks")
    most = spans.agg(F.max("block")).first()[0] or 0
    while most:
        spans = spans.withColumn("slot", F.floor(F.col("block") / JOINED)).repartition(n, "conv_id", "slot").sortWithinPartitions("conv_id", "slot", "block").mapInArrow(_folded, SPAN)
        most //= JOINED
    whole = found.filter("done").unionByName(spans)
    best = F.array_min(F.filter(F.array(F.col("spans")["EE"], F.col("spans")["EA"]), lambda w: w.isNotNull()))
    return stored(
        whole.select(
            "conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("best")
        ).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit"),
        "conversation-plans",
    )


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that each conversation's audit leaves of its rows, which come one by one after it."""

    def lines() -> Iterator[dict]:
        for conv_id, group in groupby(_records(batches), key=lambda r: r["conv_id"]):
            audit = next(group)["audit"]
            at, position, state = 0, 0, "E"

            def line(edit: str, row: dict | None) -> dict:
                nonlocal position, state
                role = row["role"] if edit == "K" else ROLES["a" if state == "U" else "u"]
                state, position = MOVES[state, role[:1]], position + 1
                return {"conv_id": conv_id, "position": position - 1, "edit": edit, "role": role, "text": row["text"] if row else ""}

            for row in group:
                while audit[at] == "I":
                    yield line("I", None)
                    at += 1
                if audit[at] != "D":
                    yield line(audit[at], row)
                at += 1
            for _ in audit[at:]:  # insertions at the end
                yield line("I", None)

    return _batched(lines(), LINE_TYPE)


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (K, R or I), role, text, in order within a task and no conversation in two.

    Texts are dealt out once, by conversation, and pass by one at a time, so a
    task holds one audit, however long a conversation is.
    """
    texts = slim(rows).withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")})
    heads = plan.select("conv_id", "audit", F.lit(0).alias("kind"))
    both = texts.unionByName(heads, allowMissingColumns=True).repartition(parallelism(rows.sparkSession), "conv_id")
    return both.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "mark").select("conv_id", "role", "text", "audit").mapInArrow(_applied, LINE)


def line_digests(lines: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines, joined by line feeds. Takes the rows as repaired() deals them; a line is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[dict]:
            for conv_id, group in groupby(_records(batches), key=lambda r: r["conv_id"]):
                sha = hashlib.sha256()
                for n, r in enumerate(group):
                    sha.update(f"{chr(10) * bool(n)}{r['role']}:{r['text']}".encode())
                yield {"conv_id": conv_id, "repaired_sha256": sha.hexdigest()}

        return _batched(sums(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return lines.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The query's rows: by the CRC-32 of conversation and turn some are lost, emptied, robbed of their stops, told twice, or given to the user."""
    role, text, conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text", "conv_id", "turn"))
    fate = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    hit = rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fate.alias("fate"),
    )
    return hit.filter("fate <> 0").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("fate", "again")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(conversations)
    plan = plans(rows)
    sums = line_digests(repaired(rows, plan)).withColumnRenamed("conv_id", "s")
    found = plan.withColumnRenamed("conv_id", "c")
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("s")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same in SQL: four states with cost, audit and text each, carried over the rows of a conversation one by one."""

    def then(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} END"

    def least(*weights: str) -> str:
        return f"list_min([{', '.join(weights)}])"

    kept, extra = "chr(10) || role || ':' || text", "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
    into = {"s": "e", "u": "esa", "a": "u"}

    def at(role: str) -> str:
        state = {"s": "s", "u": "u", "a": "a"}[role]
        ways = [then(state, "2", "D")]
        for before in into[role]:
            ways.append(f"CASE WHEN clean AND initial = '{role}' THEN {then(before, extra, 'K', kept)} END")
            if role in ROLES:
                ways.append(f"CASE WHEN clean THEN {then(before, f'(1 + {extra})', 'R', f"chr(10) || '{ROLES[role]}:' || text")} END")
        return least(*ways)

    new = {r: f"chr(10) || '{role}:'" for r, role in ROLES.items()}
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM fated
), marked AS (
  SELECT *, left(role, 1) AS initial, sha256(length(role)::VARCHAR || ':' || role || text) AS mark, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS i FROM marked
), faults AS (
  SELECT *,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, mark ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), rows_ AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS clean, coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults
), steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS e, CASE WHEN false THEN {{'c': 0, 'a': '', 't': ''}} END AS s,
    {{'c': 5, 'a': 'I', 't': {new["u"]}}} AS u, {{'c': 10, 'a': 'II', 't': {new["u"]} || {new["a"]}}} AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, e, s, u, {least("a", then("u", "5", "I", new["a"]))} FROM (
    SELECT conv_id, i, e, s, {least("u", *(then(x, "5", "I", new["u"]) for x in "esa"))} AS u, a FROM (
      SELECT rows_.conv_id, rows_.i, {then("e", "2", "D")} AS e, {at("s")} AS s, {at("u")} AS u, {at("a")} AS a
      FROM steps JOIN rows_ ON rows_.conv_id IS NOT DISTINCT FROM steps.conv_id AND rows_.i = steps.i + 1
    )
  )
), best AS (
  SELECT conv_id, list_min([arg_max(e, i), arg_max(a, i)]) AS w, max(i) AS n FROM steps GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows_ GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  w.c::BIGINT AS cost, w.a AS audit, sha256(substr(w.t, 2)) AS repaired_sha256
FROM best AS b LEFT JOIN counts AS k ON b.conv_id IS NOT DISTINCT FROM k.conv_id
"""


OP12_SQL = _sql()
