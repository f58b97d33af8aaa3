"""Repair of conversations: cheapest edits that give alternating turns, by shortest paths.

Places between rows, times what came last (nothing, a system, user or assistant turn), are the
nodes of a graph; keeping, giving another role, deleting and inserting are its arcs.  Costs are small
integers, so distances to the end come from Dial's queue of buckets, one for each distance.  From
the start the audit then walks arcs that are tight (an arc's cost is what the distance falls by),
each time the one of the least letter, which gives the least audit of all cheapest ones.

A conversation of usual length is repaired by one task, streamed in order.  One of very many rows
is cut into spans that different tasks take: the costs between the nodes at both ends of a span
are a table of four by four, tables of spans give the distances at their borders, and then each
span walks on its own.  Only its digest, which is sequential by nature, reads all its lines in one
task, without holding them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.core import hot_join, staged, table
from quillstream.llm.importance import CRC_TABLE_SQL, crc_sql
from quillstream.shipping import ship

#: A conversation with more rows is cut into spans, each of so many rows about.
LONG_ROWS = 50_000
FAR = 1 << 60
RENAME, DELETE, INSERT, MEND = 3, 4, 3, 3
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What came last; where an initial is kept, or a user or assistant turn is inserted, leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NODES = 4
KEEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
SOUND = {"su", "ua", "au"}
#: Distances at the very end: nothing at all, or an assistant's turn, needs no more.
END = [0, FAR, FAR, 0]
NOT_WHITE = re.compile(r"[^\x20\x09-\x0D]")
WHITE = " \t\n\x0b\x0c\r"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def row_arcs(initial: str, fault: int, node: int):
    """(letter, cost, next node) of the edits that use up a row, in order of their letters."""
    yield "D", DELETE, node
    if fault in (OK, TRUNCATED):
        more = MEND if fault == TRUNCATED else 0
        if node in KEEPS.get(initial, ()):
            yield "K", more, KEEPS[initial][node]
        yield "R", RENAME + more, NEXT[node]


def distances(initials: list[str], faults: list[int], end: list[int]) -> list[int]:
    """Distance of node q before row i to the end, at 4 * i + q, by Dial's bucket queue; ``end`` has
    those of the four nodes behind the last row."""
    n = len(initials)
    out = [FAR] * (NODES * (n + 1))
    near = [d for d in end if d < FAR]
    low = min(near)
    buckets: list[list[int]] = [[] for _ in range(max(near) - low + DELETE * n + 3 * INSERT + RENAME + MEND + 1)]
    for q, d in enumerate(end):
        if d < FAR:
            out[NODES * n + q] = d
            buckets[d - low].append(NODES * n + q)
    into: dict[tuple[str, int], list[list[tuple[int, int]]]] = {}  # arcs of a row by the node they lead to
    for d, bucket in enumerate(buckets, low):
        for at in bucket:  # grows while it is read: keeping a row costs nothing
            if out[at] != d:
                continue
            i, q = divmod(at, NODES)
            for p, there in NEXT.items():
                if there == q and d + INSERT < out[at - q + p]:
                    out[at - q + p] = d + INSERT
                    buckets[d + INSERT - low].append(at - q + p)
            if not i:
                continue
            kind = (initials[i - 1], faults[i - 1])
            arcs = into.get(kind)
            if arcs is None:
                arcs = into[kind] = [[(p, c) for p in range(NODES) for _, c, t in row_arcs(*kind, p) if t == goal] for goal in range(NODES)]
            base = NODES * (i - 1)
            for p, c in arcs[q]:
                if d + c < out[base + p]:
                    out[base + p] = d + c
                    buckets[d + c - low].append(base + p)
    return out


def walk(initials: list[str], faults: list[int], far: list[int], node: int, last: bool) -> tuple[str, list[int], int]:
    """(letters, the node that each leads to, the last node) along tight arcs, the least letter first.
    Insertions behind the last row are left to the next span, if there is one."""
    letters, nodes, i, n = [], [], 0, len(initials)
    while True:
        d = far[NODES * i + node]
        if i == n and (not last or d == 0):
            return "".join(letters), nodes, node
        tight = [("I", NEXT[node])] if far[NODES * i + NEXT[node]] + INSERT == d else []
        if i < n:
            tight += [(x, t) for x, c, t in row_arcs(initials[i], faults[i], node) if far[NODES * (i + 1) + t] + c == d]
        letter, node = min(tight)
        letters.append(letter)
        nodes.append(node)
        i += letter != "I"


def line_of(letter: str, node: int, role: str, text: str) -> str | None:
    """The repaired line of an edit, or None for a deleted row."""
    if letter == "D":
        return None
    if letter == "I":
        return NAMES[node] + ":"
    return f"{role if letter == 'K' else NAMES[node]}:{text}"


def fault_of(text: str, seen: bool) -> int:
    bare = text.rstrip(WHITE)
    if not bare:
        return BLANK
    if seen:
        return DUPLICATE
    return OK if bare[-1] in ".!?" else TRUNCATED


def repair(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The result's columns for one conversation, whose rows are in order."""
    seen, faults = set(), []
    for role, text in zip(roles, texts):
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    initials = [r[:1] for r in roles]
    far = distances(initials, faults, END)
    letters, nodes, _ = walk(initials, faults, far, NOTHING, True)
    lines, i = [], 0
    for letter, node in zip(letters, nodes):
        line = line_of(letter, node, "" if letter == "I" else roles[i], "" if letter == "I" else texts[i])
        i += letter != "I"
        if line is not None:
            lines.append(line)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in SOUND for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, far[NOTHING], letters, digest


NOTHING_LEFT = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of the rows after damage; dropped rows stay with a null role,
    so that a conversation of which nothing is left is not forgotten.  Null roles and texts are one
    space, and so is a null id or turn in the key."""
    as_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(F.concat(as_key("conv_id"), F.lit(":"), as_key("turn")).cast("binary")) % 20
    out = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return out.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


#: Rows of a conversation in order, nulls first; rows of one turn by role and text, so that copies
#: are neighbours.
ORDER = ["conv_id", "turn", "role", "text", "copy"]


def _repair_sorted(batches):
    """Conversations of sorted rows, one after the other; one may go on in the next batch."""
    out: list[tuple] = []
    held: list[tuple] = []

    def flush():
        rows = [r for r in held if r[2] is not None]
        found = repair([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]) if rows else NOTHING_LEFT
        out.append((held[0][0], *found))

    names = ["conv_id", *(c.split()[0] for c in RESULT.split(", "))]
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            if held and row[0] != held[0][0]:
                flush()
                held.clear()
            held.append(row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_SCHEMA)
            out.clear()
    if held:
        flush()
    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_SCHEMA)


_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in ("conv_id long, " + RESULT).split(", "))])


def repair_conversations(df: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each
    conversation of ``df`` (conv_id, turn, role, text), after the damage its rows get.

    Rows without an id are one conversation; rows of one turn are ordered by role and text; repeated
    rows are duplicates; roles of any other initial can't be kept; empty texts are blank.  A
    conversation whose rows were all dropped has zeros and an empty audit; an empty table stays
    empty.  Only the four columns are read.  Conversations of more than ``long_rows`` rows are told
    by a count, of which there are less than rows / long_rows, and are cut into spans.
    """
    ship(df.sparkSession)
    rows = damage(df)
    sizes = df.groupBy(F.col("conv_id").cast("long").alias("conv_id")).count().where(F.col("count") > long_rows)
    long_ids = [r["conv_id"] for r in sizes.collect()]
    if not long_ids:
        return _repair_usual(rows)
    is_long = F.coalesce(F.col("conv_id").isin([i for i in long_ids if i is not None]), F.lit(None in long_ids))
    return _repair_usual(rows.where(~is_long)).unionByName(_repair_long(rows.where(is_long), long_rows))


def _repair_usual(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(_repair_sorted, "conv_id long, " + RESULT)


# Long conversations.  A span is the part of one that a range partition holds.

SPAN = "conv_id long, span long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>"


def _span_tables(batches, *names):
    """The columns of one span after the other, of sorted rows."""
    names = ("conv_id", "span", *names)
    held: dict[str, list] = {n: [] for n in names}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held["span"] and (held["conv_id"][0], held["span"][0]) != row[:2]:
                yield held
                held = {n: [] for n in names}
            for n, v in zip(names, row):
                held[n].append(v)
    if held["span"]:
        yield held


def _measure(batches):
    """A row for each span: its counts, and the costs from each node before it to each behind it."""
    for rows in _span_tables(batches, "initial", "fault"):
        initials, faults = rows["initial"], rows["fault"]
        to = [distances(initials, faults, [0 if q == goal else FAR for q in range(NODES)])[:NODES] for goal in range(NODES)]
        illegal = sum(a + b not in SOUND for a, b in zip(initials, initials[1:]))
        row = {
            "conv_id": rows["conv_id"][0], "span": rows["span"][0], "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": illegal, "first": initials[0], "last": initials[-1], "costs": [to[goal][q] for q in range(NODES) for goal in range(NODES)],
        }
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, pa.list_(pa.int64()) if t == "array<long>" else pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in SPAN.split(", "))]))


def _borders(spans: pd.DataFrame) -> pd.DataFrame:
    """Distances behind each span of a conversation, from its last one backwards."""
    spans = spans.sort_values("span", ignore_index=True)
    behind = distances([], [], END)
    out = []
    for row in spans.iloc[::-1].itertuples():
        out.append(behind)
        costs = np.array(row.costs, np.int64).reshape(NODES, NODES)
        behind = [int(min(c + d for c, d in zip(costs[q], behind))) for q in range(NODES)]
    spans["behind"] = out[::-1]
    spans["ends_it"] = spans["span"] == spans["span"].max()
    firsts, lasts = spans["first"].tolist(), spans["last"].tolist()
    spans["illegal"] += [0, *(int(a + b not in SOUND) for a, b in zip(lasts, firsts[1:]))]
    spans["cost"] = behind[NOTHING]
    return spans[["conv_id", "span", "blank", "duplicate", "truncated", "illegal", "behind", "ends_it", "cost"]]


def _exits(batches):
    """For each span and each node before it, the node behind it on the walk."""
    for rows in _span_tables(batches, "initial", "fault", "behind", "ends_it"):
        initials, faults = rows["initial"], rows["fault"]
        far = distances(initials, faults, rows["behind"][0])
        exits = [walk(initials, faults, far, q, rows["ends_it"][0])[2] for q in range(NODES)]
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(rows["conv_id"][:1], pa.int64()), "span": pa.array(rows["span"][:1], pa.int64()), "exits": pa.array([exits], pa.list_(pa.int32()))})


def _entries(spans: pd.DataFrame) -> pd.DataFrame:
    spans = spans.sort_values("span", ignore_index=True)
    node, entry = NOTHING, []
    for exits in spans["exits"]:
        entry.append(node)
        node = exits[node]
    return pd.DataFrame({"conv_id": spans["conv_id"], "span": spans["span"], "entry": entry})


def _edit(batches):
    """(conv_id, span, step, letter, line) of every edit of a span, from the node it is entered by."""
    for rows in _span_tables(batches, "initial", "fault", "role", "text", "behind", "ends_it", "entry"):
        conv, span, behind, ends_it, entry = (rows[c][0] for c in ("conv_id", "span", "behind", "ends_it", "entry"))
        letters, nodes, _ = walk(rows["initial"], rows["fault"], distances(rows["initial"], rows["fault"], behind), entry, ends_it)
        lines, i = [], 0
        for letter, node in zip(letters, nodes):
            lines.append(line_of(letter, node, rows["role"][i] if letter != "I" else "", rows["text"][i] if letter != "I" else ""))
            i += letter != "I"
        for a in range(0, len(lines), 5000):
            part = lines[a : a + 5000]
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([conv] * len(part), pa.int64()), "span": pa.array([span] * len(part), pa.int64()), "step": pa.array(range(a, a + len(part)), pa.int64()), "letter": pa.array(list(letters[a : a + 5000])), "line": pa.array(part, pa.string()),
            })


def _digest(batches):
    """(conv_id, audit, repaired_sha256) of sorted edits: lines are hashed as they come by."""
    key, letters, digest, some = False, [], None, False

    def done():
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([key], pa.int64()), "audit": pa.array(["".join(letters)]), "repaired_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for conv, letter, line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "letter", "line"))):
            if digest is None or conv != key:
                if digest is not None:
                    yield done()
                key, letters, digest, some = conv, [], hashlib.sha256(), False
            letters.append(letter)
            if line is not None:
                digest.update(("\n" if some else "").encode() + line.encode("utf-8", "surrogatepass"))
                some = True
    if digest is not None:
        yield done()


def _repair_long(rows: DataFrame, long_rows: int) -> DataFrame:
    """As ``repair``, for conversations that no task should take whole."""
    n = rows.count()
    ids = rows.select("conv_id").distinct()
    left = rows.where("role IS NOT NULL").withColumn("said", F.sha2(F.concat_ws("\0", "conv_id", "role", "text").cast("binary"), 256))
    left = left.repartitionByRange(1 + n // long_rows, *ORDER).sortWithinPartitions(*ORDER).withColumn("at", F.monotonically_increasing_id())
    left = staged(left.withColumn("span", F.shiftright("at", 33)), "turns")
    firsts = staged(left.groupBy("said").agg(F.min("at").alias("first_at"), F.count("*").alias("said_n")), "said")
    met = hot_join(left, firsts, "said", "said_n", n)
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    fault = F.when(bare == "", BLANK).when(F.col("at") > F.col("first_at"), DUPLICATE).when(bare.rlike(r"[.!?]\z"), OK).otherwise(TRUNCATED)
    met = met.select("conv_id", "turn", "role", "text", "at", "span", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))
    at = ["span", "conv_id", "at"]
    tasks = 1 + n // long_rows
    met = staged(met, "faults")
    dealt = lambda x: x.repartition(tasks, "span").sortWithinPartitions("span", "conv_id", "at")
    spans = staged(dealt(met.select(*at, "initial", "fault")).select("conv_id", "span", "initial", "fault").mapInArrow(_measure, SPAN), "spans")
    borders = "conv_id long, span long, blank long, duplicate long, truncated long, illegal long, behind array<long>, ends_it boolean, cost long"
    borders = staged(spans.groupBy("conv_id").applyInPandas(_borders, borders), "borders")  # one small row for each span
    told = F.broadcast(borders.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "behind", "ends_it"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s"))
    bordered = met.join(told, same).drop("c", "s")
    exits = dealt(bordered.select(*at, "initial", "fault", "behind", "ends_it")).mapInArrow(_exits, "conv_id long, span long, exits array<int>")
    entries = staged(exits.groupBy("conv_id").applyInPandas(_entries, "conv_id long, span long, entry int"), "entries")
    entered = bordered.join(F.broadcast(entries.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "entry")), same).drop("c", "s")
    edits = dealt(entered).mapInArrow(_edit, "conv_id long, span long, step long, letter string, line string")
    texts = edits.repartition("conv_id").sortWithinPartitions("conv_id", "span", "step").mapInArrow(_digest, "conv_id long, audit string, repaired_sha256 string")
    turns = left.select("conv_id", "turn").where("turn IS NOT NULL").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counts = borders.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in COUNTS[1:]), F.max("cost").alias("cost"))
    out = ids
    for other in (turns, counts, texts):  # a few conversations: null ids meet, too
        other = other.withColumnRenamed("conv_id", "c")
        out = out.join(F.broadcast(other), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    none = dict(zip([c.split()[0] for c in RESULT.split(", ")], NOTHING_LEFT))
    return out.select("conv_id", *(F.coalesce(F.col(c), F.lit(v)).cast("string" if isinstance(v, str) else "long").alias(c) for c, v in none.items()))


def op13_conversation_repair(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))


#: Of candidates {cost, audit, lines} the cheapest and of those the least audit, with up to two insertions.
_CLOSED = {
    0: "list_min([g0, {c: g2.c + 3, a: 'I' || g2.a, l: list_prepend('user:', g2.l)}, {c: g3.c + 6, a: 'II' || g3.a, l: list_prepend('user:', list_prepend('assistant:', g3.l))}])",
    1: "list_min([g1, {c: g2.c + 3, a: 'I' || g2.a, l: list_prepend('user:', g2.l)}, {c: g3.c + 6, a: 'II' || g3.a, l: list_prepend('user:', list_prepend('assistant:', g3.l))}])",
    2: "list_min([g2, {c: g3.c + 3, a: 'I' || g3.a, l: list_prepend('assistant:', g3.l)}])",
    3: "list_min([g3, {c: g2.c + 3, a: 'I' || g2.a, l: list_prepend('user:', g2.l)}])",
}


def _row_sql(node: int) -> str:
    """The best of a row's edits from a node, over the closed nodes f0 to f3 behind the row."""
    kept = [f"WHEN initial = '{i}' THEN {{c: f{to[node]}.c + more, a: 'K' || f{to[node]}.a, l: list_prepend(role || ':' || text, f{to[node]}.l)}}" for i, to in KEEPS.items() if node in to]
    role = NAMES[NEXT[node]]
    there = f"f{NEXT[node]}"
    return f"""list_min([
      {{c: f{node}.c + 4, a: 'D' || f{node}.a, l: f{node}.l}},
      CASE WHEN fault IN (1, 2) THEN NULL {" ".join(kept)} END,
      CASE WHEN fault IN (1, 2) THEN NULL ELSE {{c: {there}.c + 3 + more, a: 'R' || {there}.a, l: list_prepend('{role}:' || text, {there}.l)}} END])"""


OP13_SQL = rf"""
WITH RECURSIVE crcs AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS v),
hit AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')", "v")} % 20 AS kind
  FROM conversations, crcs
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE kind <> 0
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial, count(*) OVER (PARTITION BY conv_id) AS n,
    substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair, lag(i) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN regexp_matches(text, '[.!?][ 	-
]*\z') THEN 0 ELSE 3 END AS fault
  FROM numbered
),
paths AS (
  SELECT conv_id, max(i) + 1 AS i, {{c: 0::BIGINT, a: '', l: []::VARCHAR[]}} AS f0, {{c: 6::BIGINT, a: 'II', l: ['user:', 'assistant:']}} AS f1,
    {{c: 3::BIGINT, a: 'I', l: ['assistant:']}} AS f2, {{c: 0::BIGINT, a: '', l: []::VARCHAR[]}} AS f3
  FROM faults GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_CLOSED[0]}, {_CLOSED[1]}, {_CLOSED[2]}, {_CLOSED[3]} FROM (
    SELECT p.conv_id, x.i, {_row_sql(0)} AS g0, {_row_sql(1)} AS g1, {_row_sql(2)} AS g2, {_row_sql(3)} AS g3
    FROM paths p JOIN (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM faults) x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.i = p.i - 1
  )
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.a, '') AS audit,
  sha256(coalesce(array_to_string(f0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN paths p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.i = 1
"""
