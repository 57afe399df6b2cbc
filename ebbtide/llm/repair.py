"""Conversation structure repair: the cheapest edits that turn a damaged conversation into ``system? (user assistant)+`` (or nothing).

The edits are a walk over a lattice of (rows read, what stands last in the output). Two Dijkstra searches run towards each other, one from
the start and one from both ends; when their costs meet, all crossings of that cost are finished and the one whose audit (the edits' initials
in order) is the least text is taken. Only one byte for each row goes into the search; texts are streamed past the found edits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.common import saved, ship

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2   # costs
LEFT_TRUNCATED = 1                          # for each truncated row that isn't deleted
KINDS = "sua"                               # initials of the roles; anything else can't be kept
TRUNCATED, FAULTY = 4, 8                    # bits of a row's code beside the number of its initial (3: another)
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)                                    # what stands last
_AFTER = ({0: _SYSTEM, 1: _USER}, {1: _USER}, {2: _ASSISTANT}, {1: _USER})         # by state: initial -> next state
_GIVEN = (_USER, _USER, _ASSISTANT, _USER)                                         # by state: what an inserted or reroled turn becomes
_BEFORE = ((), (), (_NOTHING, _SYSTEM, _ASSISTANT), (_USER,))                      # by state: where such a turn may come from
ROLES = {_USER: "user", _ASSISTANT: "assistant"}
PAIRS = {"su", "ua", "au"}


# ---------------------------------------------------------------- the search
class Lattice:
    """Nodes are 4 * rows read + state. Edges go (node, edit, cost)."""

    def __init__(self, codes: bytes):
        self.codes, self.n = codes, len(codes)
        self.goals = (4 * self.n + _NOTHING, 4 * self.n + _ASSISTANT)

    def onward(self, node: int) -> Iterator[tuple[int, str, int]]:
        i, q = divmod(node, 4)
        yield 4 * i + _GIVEN[q], "I", INSERT
        if i < self.n:
            code = self.codes[i]
            yield node + 4, "D", DELETE
            if not code & FAULTY:
                extra = LEFT_TRUNCATED if code & TRUNCATED else 0
                kept = _AFTER[q].get(code & 3)
                if kept is not None:
                    yield 4 * i + 4 + kept, "K", KEEP + extra
                yield 4 * i + 4 + _GIVEN[q], "R", REROLE + extra

    def back(self, node: int) -> Iterator[tuple[int, str, int]]:
        i, q = divmod(node, 4)
        for p in _BEFORE[q]:
            yield 4 * i + p, "I", INSERT
        if i:
            code = self.codes[i - 1]
            yield node - 4, "D", DELETE
            if not code & FAULTY:
                extra = LEFT_TRUNCATED if code & TRUNCATED else 0
                for p in range(4):
                    if _AFTER[p].get(code & 3) == q:
                        yield 4 * i - 4 + p, "K", KEEP + extra
                for p in _BEFORE[q]:
                    yield 4 * i - 4 + p, "R", REROLE + extra


class Side:
    """One of the two searches: the least cost of each node seen and, among equal costs, the step of the least text of edits.

    A free step (keeping a sound row) always reads a row, so within one cost nodes are finished in the order of their rows: a finished
    node's text is final. Texts are not stored: ``step`` leads one edit back (or on), and two texts are compared where their walks differ.
    """

    def __init__(self, lattice: Lattice, sources: tuple[int, ...], forward: bool):
        self.edges, self.sign = (lattice.onward, 1) if forward else (lattice.back, -1)
        self.forward = forward
        self.cost = dict.fromkeys(sources, 0)
        self.step: dict[int, tuple[int, str] | None] = dict.fromkeys(sources)
        self.size = dict.fromkeys(sources, 0)
        self.done: set[int] = set()
        self.heap = [(0, self.sign * (s // 4), s) for s in sources]
        heapq.heapify(self.heap)

    def top(self) -> int | None:
        while self.heap and (self.heap[0][2] in self.done or self.heap[0][0] > self.cost[self.heap[0][2]]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def text(self, node: int) -> str:
        found = []
        while (s := self.step[node]) is not None:
            found.append(s[1])
            node = s[0]
        return "".join(reversed(found) if self.forward else found)

    def less(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        """Whether the edits by step a are a lesser text than those by step b."""
        if not self.forward:
            while a is not None and b is not None and a[1] == b[1]:
                if a[0] == b[0]:
                    return False
                a, b = self.step[a[0]], self.step[b[0]]
            return b is not None and (a is None or a[1] < b[1])
        left, right = [a[1]], [b[1]]
        x, y = a[0], b[0]
        while x != y:   # back to where both walks part
            longer = self.size[x] - self.size[y]
            if longer >= 0:
                x, edit = self.step[x]
                left.append(edit)
            if longer <= 0:
                y, edit = self.step[y]
                right.append(edit)
        return left[::-1] < right[::-1]

    def settle(self, other: Side) -> int | None:
        """Finishes the next node; the least cost of a whole walk seen by it."""
        cost, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        met = [cost + other.cost[node]] if node in other.cost else []
        for to, edit, price in self.edges(node):
            if to in self.done:
                continue
            new, by = cost + price, (node, edit)
            if to not in self.cost or new < self.cost[to] or (new == self.cost[to] and self.step[to] is not None and self.less(by, self.step[to])):
                fresh = self.cost.get(to) != new
                self.cost[to], self.step[to], self.size[to] = new, by, self.size[node] + 1
                if fresh:
                    heapq.heappush(self.heap, (new, self.sign * (to // 4), to))
            if to in other.cost:
                met.append(new + other.cost[to])
        return min(met, default=None)


def search(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of rows given by their codes; of equally cheap ones those with the least audit."""
    lattice = Lattice(codes)
    ahead, behind = Side(lattice, (_NOTHING,), True), Side(lattice, lattice.goals, False)
    best: int | None = None
    while (f := ahead.top()) is not None and (r := behind.top()) is not None and (best is None or f + r <= best):
        side, other = (ahead, behind) if f <= r else (behind, ahead)
        met = side.settle(other)
        best = met if best is None else best if met is None else min(best, met)
    # every cheapest walk ends inside the forward search or leaves it by an edge into what the other one has finished
    found = [ahead.text(g) for g in lattice.goals if g in ahead.done and ahead.cost[g] == best]
    for node in ahead.done:
        for to, edit, price in lattice.onward(node):
            if to not in ahead.done and to in behind.done and ahead.cost[node] + price + behind.cost[to] == best:
                found.append(ahead.text(node) + edit + behind.text(to))
    return best, min(found)


_short = lru_cache(maxsize=1 << 16)(search)


def cheapest(codes: bytes) -> tuple[int, str]:
    """``search``; short conversations of the same shape are searched once in a worker."""
    return _short(codes) if len(codes) <= 32 else search(codes)


# ---------------------------------------------------------------- rows
def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and: key (of role and text), code, blank, truncated; a projection.

    A null role or text counts as one space. Other columns are not read."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    last = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    first = F.substring(role, 1, 1)
    number = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), key.alias("key"), first.alias("initial"), number.alias("number"),
                       (last == "").alias("blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("truncated"))


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]


_SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, one row a conversation of the ``marked`` rows.

    Rows stand by turn (null first), then role and key; rows that agree in all of them are equal. Rows with a null conv_id are one
    conversation of their own. A worker holds one byte for each row of one conversation; duplicates are found by a window over (conv_id, key), so
    a conversation of any size is dealt over all tasks there.
    """
    spark = rows.sparkSession
    ship(spark)
    again = F.row_number().over(W.partitionBy("conv_id", "key").orderBy(F.col("turn").asc_nulls_first())) > 1
    small = rows.select("conv_id", "turn", "role", "key", "initial", "number", "blank", "truncated").withColumn("duplicate", ~F.col("blank") & again)
    code = F.col("number") + F.when(F.col("blank") | F.col("duplicate"), FAULTY).when(F.col("truncated"), TRUNCATED).otherwise(0)
    sent = small.select("conv_id", "turn", "role", "key", "initial", code.alias("code"), "blank", "duplicate").repartition("conv_id").sortWithinPartitions(*_order())
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in _SUMMARY], T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)
        state: dict | None = None
        out: list[tuple] = []

        def close() -> None:
            cost, audit = cheapest(bytes(state["codes"]))
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            out.append((state["conv"], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost, audit))

        for batch in batches:
            for conv, turn, initial, code, blank, duplicate in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "code", "blank", "duplicate")), strict=True):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        close()
                    state = {"conv": conv, "codes": bytearray(), "low": turn, "high": turn, "turns": 0, "last": None, "before": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                if turn is not None and turn != state["last"]:
                    state["low"] = turn if state["last"] is None else state["low"]
                    state["high"] = state["last"] = turn
                    state["turns"] += 1
                state["codes"].append(code)
                state["blank"] += blank
                state["duplicate"] += duplicate
                state["truncated"] += bool(code & TRUNCATED)
                state["illegal"] += state["before"] is not None and state["before"] + initial not in PAIRS
                state["before"] = initial
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), shape, strict=True)], schema=shape)
                out.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), shape, strict=True)], schema=shape)

    return sent.mapInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit, role and text of the repaired conversations, from ``marked`` rows and their ``audits``.

    A conversation's rows come one after the other in one partition. Texts are moved once and streamed: the audit comes first in the
    sort, then the rows it speaks of; no conversation is held in memory.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    texts = rows.select("conv_id", F.lit(1).alias("what"), "turn", "role", "key", "text", F.lit(None).cast("string").alias("audit"))
    edits = found.select("conv_id", F.lit(0).alias("what"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), "audit")
    conv, *rest = _order()
    sent = texts.unionByName(edits).repartition("conv_id").sortWithinPartitions(conv, "what", *rest).select("conv_id", "what", "role", "text", "audit")
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)
        audit, at, position, state, conv = "", 0, 0, _NOTHING, None
        out: list[tuple] = []

        def inserted() -> None:
            nonlocal at, position, state
            while at < len(audit) and audit[at] == "I":
                state = _GIVEN[state]
                out.append((conv, position, "I", ROLES[state], ""))
                at, position = at + 1, position + 1

        for batch in batches:
            for now, what, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "what", "role", "text", "audit")), strict=True):
                if not what:
                    audit, at, position, state, conv = edits, 0, 0, _NOTHING, now
                    inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = _AFTER[state][KINDS.index(role[0])]
                    out.append((conv, position, edit, role, text))
                elif edit == "R":
                    state = _GIVEN[state]
                    out.append((conv, position, edit, ROLES[state], text))
                position += edit != "D"
                inserted()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), shape, strict=True)], schema=shape)
                out.clear()

    return sent.mapInArrow(run, schema)


# ---------------------------------------------------------------- the query
def damaged(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) as crc32(conv_id:turn) % 20 damages them; nulls of the four count as one space there."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    way = F.crc32(named.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(way == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(way != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text``, joined by line ends, of rows that come as ``repaired`` gives them; no shuffle."""
    schema = T.StructType([repaired_rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)
        conv, state = None, None
        for batch in batches:
            done = []
            for now, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if not position:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = now, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), shape, strict=True)], schema=shape)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], shape[0].type), pa.array([state.hexdigest()])], schema=shape)

    return repaired_rows.select("conv_id", "position", "role", "text").mapInArrow(run, schema)


def repair_report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every conv_id of turns (null included, if it occurs): the audit of its rows and the digest of its repair.

    Conversations without rows and those of which nothing stays have the digest of an empty text; without rows all counts are 0.
    """
    spark = turns.sparkSession
    spoken = marked(rows)
    found = saved(audits(spoken), "audits")
    digest = digests(repaired(spoken, found)).withColumnRenamed("conv_id", "_c")
    ids = turns.select("conv_id").distinct()
    both = found.join(digest, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c").withColumnRenamed("conv_id", "_c")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return ids.join(both, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMMARY], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(turns, damaged(turns))


#: One step of the recursion reads one row in all four states; an insertion in front of or behind a row is a step of its own table.
SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS b FROM conversations),
crcs AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i::INT + 1, 2))::BIGINT)),
                                      lambda x, y: xor(x // 256, t[(xor(x, y) % 256)::INT + 1])), 4294967295) % 20 AS way FROM keyed, crc_table),
rowed AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
               CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM crcs, (SELECT unnest([1, 2]) AS copy) k WHERE way <> 0 AND (copy = 1 OR way = 3)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS n,
                regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM rowed),
flags AS (SELECT *, final = '' AS blank, final <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
                 left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS earlier FROM seen),
d AS (SELECT *, NOT blank AND NOT duplicate AND final NOT IN ('.', '!', '?') AS truncated FROM flags),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate,
                  sum(truncated::INT) AS truncated, coalesce(sum((earlier || initial NOT IN ('su', 'ua', 'au'))::INT), 0) AS illegal, max(n) AS n FROM d GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (3, 2, 2, 'I'), (2, 3, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')) v(q, q2, price, op)),
edit AS (SELECT * FROM (VALUES ('D', '', 0, 0, 3), ('D', '', 1, 1, 3), ('D', '', 2, 2, 3), ('D', '', 3, 3, 3), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0),
                               ('K', 'a', 2, 3, 0), ('R', '', 0, 2, 2), ('R', '', 1, 2, 2), ('R', '', 3, 2, 2), ('R', '', 2, 3, 2)) v(op, initial, q, q2, price)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, ins.q2 AS q, ins.price::BIGINT AS cost, ins.op AS audit FROM counts, ins WHERE ins.q = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, ins.q2, min(w.cost + edit.price + ins.price + CASE WHEN d.truncated AND edit.op <> 'D' THEN 1 ELSE 0 END),
         arg_min(w.audit || edit.op || ins.op, lpad((w.cost + edit.price + ins.price + CASE WHEN d.truncated AND edit.op <> 'D' THEN 1 ELSE 0 END)::VARCHAR, 12, '0') || w.audit || edit.op || ins.op)
  FROM walk w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.n = w.i + 1
  JOIN edit ON edit.q = w.q AND (edit.initial = '' OR edit.initial = d.initial) AND (edit.op = 'D' OR NOT (d.blank OR d.duplicate)) JOIN ins ON ins.q = edit.q2
  GROUP BY w.conv_id, w.i, ins.q2),
best AS (SELECT c.conv_id, min(cost) AS cost, arg_min(audit, lpad(cost::VARCHAR, 12, '0') || audit) AS audit
         FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n AND w.q IN (0, 3) GROUP BY c.conv_id),
chars AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best),
ops AS (SELECT conv_id, pos, substr(audit, pos::INT, 1) AS op, length(replace(left(audit, pos::INT), 'I', '')) AS skipped, length(replace(left(audit, pos::INT), 'D', '')) AS place FROM chars),
lines AS (SELECT o.conv_id, o.pos, o.op, o.place, d.role, d.text, bool_or(o.op = 'K' AND o.place = 1 AND d.initial = 's') OVER (PARTITION BY o.conv_id) AS led
          FROM ops o LEFT JOIN d ON o.op <> 'I' AND d.conv_id IS NOT DISTINCT FROM o.conv_id AND d.n = o.skipped WHERE o.op <> 'D'),
told AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (place - coalesce(led, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END,
                                 chr(10) ORDER BY pos)) AS digest FROM lines GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM k.conv_id
"""
