"""Repair of conversation structure at least cost, by shortest paths with Dial's bucket queue.

A conversation is repaired by edits of its turns until their role initials read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn, or nothing. A node of the graph is a position
between turns and a state of that pattern (start, after s, after u, after a). Keep, Rerole and Delete
lead over a turn, Insert stays at the position. Costs are small whole numbers, so the distances to the
end are found with a ring of a few buckets in place of a heap. The audit, the edits' initials, is
the least string of all cheapest ones: from the start on, of the arcs that keep to a shortest path
(the tight ones) the one with the least letter is taken. Each state has one next role, so letters tell arcs
apart and the walk never turns back.

Turns are range-sorted by conversation, turn, role and text, so a conversation of any length is spread
over ranges, and handled in blocks of turns. Nearly all conversations lie within a block and are
finished there. For the others a block gives the least costs from each state at its begin to each at its
end; these chain backwards to the distances at every block's end, with which each block is walked from all
four states, and forwards to the state that it is really entered in. Of a conversation only these few numbers
a block and, for the digest of the repaired text, which is one sequence, a stream of its turns in order
meet in one task; nothing of it is held but the audit.

Duplicates are found by (conversation, role, text digest): the first place of each is an aggregate, and
meets the turns by place, which is spread evenly whatever repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_shuffles, table

#: A block has 2**SHIFT turns: places are numbered by range and row, and a block is as many rows of a range.
SHIFT = 10
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a truncated turn that stays.
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
CUT = 1
FAR = 1 << 60
#: By state: the state after an inserted or reroled turn, its role, and states by the initial of a kept one.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
OPEN = [0, FAR, FAR, 0]  # distances at the end of a conversation: it may be empty or end with the assistant
LEGAL = ("su", "ua", "au")
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of "conv_id:turn" modulo 20, nulls read as one space there and in role and text.

    0 drops the turn, which leaves a row with a null text; 1 empties its text, 2 takes ``.!?`` out of
    it, 3 repeats it, 4 makes it the user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(how == 0, F.lit(None)).when(how == 1, F.lit("")).when(how == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    role = F.when(how == 4, F.lit("user")).otherwise(one("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def as_they_are(rows: DataFrame) -> DataFrame:
    """The turns without damage, with nulls of role and text as one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _fault(text: Column) -> Column:
    """Blank, truncated or sound, from the last character that isn't white space."""
    end = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)


def arcs(turn: tuple[str, int] | None, state: int) -> list[tuple[str, int, int, bool]]:
    """(letter, cost, next state, whether it passes the turn) by letter; ``turn`` is (role initial, fault), None at the end."""
    out = []
    if turn is not None:
        initial, fault = turn
        out.append((DELETE, COST[DELETE], state, True))
        if fault in (SOUND, TRUNCATED):
            more = CUT if fault == TRUNCATED else 0
            if (kept := KEPT[state].get(initial)) is not None:
                out.append((KEEP, COST[KEEP] + more, kept, True))
            out.append((REROLE, COST[REROLE] + more, NEXT[state], True))
    out.append((INSERT, COST[INSERT], NEXT[state], False))
    return sorted(out)


def _into(turns: list[tuple[str, int]]) -> list[list[list[tuple[int, int]]]]:
    """For each position and state the arcs that lead there from the position before: (state, cost)."""
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in range(4)]]
    for turn in turns:
        here: list[list[tuple[int, int]]] = [[] for _ in range(4)]
        for state in range(4):
            for _, cost, to, passes in arcs(turn, state):
                if passes:
                    here[to].append((state, cost))
        out.append(here)
    return out


_INSERTED = [[s for s in range(4) if NEXT[s] == t] for t in range(4)]


def distances(turns: list[tuple[str, int]], end: list[int], last: bool, into: list | None = None) -> list[list[int]]:
    """Least costs from every position and state to the end of the block, where the way on costs ``end`` by state.

    Dial's algorithm against the arcs' direction: a ring of buckets, one for each cost that is less than
    the largest arc away. Turns are inserted before each turn of the block and, in the ``last`` one, at its end.
    """
    n, into = len(turns), into or _into(turns)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    widest = max(COST.values()) + CUT + 1
    ring: list[list[tuple[int, int]]] = [[] for _ in range(widest)]
    ready = sorted((d, s) for s, d in enumerate(end) if d < FAR)
    at, left, now = 0, 0, ready[0][0] if ready else 0
    while at < len(ready) or left:
        if not left:
            now = max(now, ready[at][0])
        while at < len(ready) and ready[at][0] <= now:  # where the way on begins at this distance
            d, s = ready[at]
            at += 1
            if d < dist[n][s]:
                dist[n][s] = d
                ring[d % widest].append((n, s))
                left += 1
        bucket = ring[now % widest]
        while bucket:
            i, s = bucket.pop()
            left -= 1
            if dist[i][s] != now:
                continue  # met again at a lower cost
            back = [(i - 1, f, now + c) for f, c in into[i][s]]
            if i < n or last:
                back += [(i, f, now + COST[INSERT]) for f in _INSERTED[s]]
            for j, f, d in back:
                if d < dist[j][f]:
                    dist[j][f] = d
                    ring[d % widest].append((j, f))
                    left += 1
        now += 1
    return dist


def walk_arcs(turns: list[tuple[str, int]], dist: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """(edits, state at the end): of the tight arcs the one with the least letter at every step."""
    n, i, out = len(turns), 0, []
    if dist[0][state] >= FAR:
        return "", state
    while i < n or (last and dist[i][state] > 0):
        for letter, cost, to, passes in arcs(turns[i] if i < n else None, state):
            j = i + passes
            if dist[j][to] + cost == dist[i][state]:
                out.append(letter)
                i, state = j, to
                break
        else:
            raise AssertionError("no tight arc")
    return "".join(out), state


def repaired(turns: list[tuple[str, str]], edits: str, state: int, initials: list[str]) -> Iterator[str]:
    """The lines ``role:text`` that the edits make of (role, text)."""
    k = 0
    for letter in edits:
        if letter == INSERT:
            yield f"{ROLE[state]}:"
            state = NEXT[state]
            continue
        role, text = turns[k]
        if letter == KEEP:
            yield f"{role}:{text}"
            state = KEPT[state][initials[k]]
        elif letter == REROLE:
            yield f"{ROLE[state]}:{text}"
            state = NEXT[state]
        k += 1


class _Tally:
    """What is counted along a conversation; two neighbouring parts can be added."""

    NAMES = ("blank", "duplicate", "truncated", "illegal", "distinct")

    def __init__(self):
        self.n = dict.fromkeys(self.NAMES, 0)
        self.first = self.final = None  # initials of the first and last turn
        self.low = self.high = None  # least and greatest turn number

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        one = _Tally()
        one.first = one.final = initial
        one.low = one.high = turn
        one.n["distinct"] = int(turn is not None)
        if fault != SOUND:
            one.n[("", "blank", "duplicate", "truncated")[fault]] = 1
        self.plus(one)

    def plus(self, other: _Tally) -> None:
        if other.first is None:
            return
        for c in self.NAMES:
            self.n[c] += other.n[c]
        if self.first is None:
            self.first = other.first
        else:
            self.n["illegal"] += self.final + other.first not in LEGAL
        self.final = other.final
        if other.low is not None:
            if self.low is None:
                self.low = other.low
            else:
                self.n["distinct"] -= self.high == other.low  # in order of turns
            self.high = other.high

    def packed(self) -> str:
        return repr((self.n, self.first, self.final, self.low, self.high))

    @classmethod
    def of(cls, text: str) -> _Tally:
        from ast import literal_eval

        out = cls()
        out.n, out.first, out.final, out.low, out.high = literal_eval(text)
        return out

    def result(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.n["distinct"], (1 << 63) - 1)
        return gaps, self.n["blank"], self.n["duplicate"], self.n["truncated"], self.n["illegal"]


#: Of a finished conversation.
_DONE = [*((c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
#: Besides, of a part of an open one: its block, the kind of row, the turns' (initial, fault), tally, place, role and text.
_PART = [("block", T.LongType()), ("kind", T.IntegerType()), ("code", T.ArrayType(T.StringType())), ("tally", T.StringType()), ("place", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("fault", T.IntegerType())]
FINISHED, PART, TURN = range(3)


def _turns(code: list[str]) -> list[tuple[str, int]]:
    return [(c[1:], int(c[0])) for c in code]


def _batches(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)


def _blocks(names: list[str], types: list[pa.DataType], shift: int):
    """Over rows sorted by place, each first occurrence preceded by a row without role: finished conversations, and parts of those that may go on in another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, block, held, first = None, None, [], True  # held: rows of one conversation in one block
        marked = None

        def close(opened: bool) -> None:
            nonlocal held
            if not held:
                return
            conv, tally, turns, lines = held[0][0], _Tally(), [], []
            for _, turn, role, text, fault, place in held:
                if text is None:
                    continue
                initial = role[:1]
                tally.add(turn, initial, fault)
                turns.append((initial, fault))
                lines.append((role, text))
            if opened:
                code = [f"{f}{i}" for i, f in turns]
                out.append((conv, *[None] * len(_DONE), block, PART, code, tally.packed(), None, None, None, None))
                out.extend((conv, *[None] * len(_DONE), block, TURN, None, None, place, role, text, fault) for _, _, role, text, fault, place in held if text is not None)
            else:
                dist = distances(turns, OPEN, True)
                edits, _ = walk_arcs(turns, dist, START, True)
                text = "\n".join(repaired(lines, edits, START, [i for i, _ in turns]))
                digest = hashlib.sha256(text.encode()).hexdigest()
                out.append((conv, *tally.result(), dist[0][START], edits, digest, None, FINISHED, None, None, None, None, None, None))
            held = []

        size = 0
        for batch in batches:
            for conv, turn, role, text, fault, place, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mark:
                    marked = place
                    continue
                at = place >> shift
                if at != block:
                    close(True)
                    now, block, first = conv, at, True
                elif conv != now:
                    close(first)  # the first of a block may have begun before it
                    now, first = conv, False
                if text is not None and fault != BLANK and marked != place:
                    fault = DUPLICATE
                held.append((conv, turn, role, text, fault, place))
                size += len(text or "")
                if len(out) >= 1 << shift or size >= 1 << 24:
                    yield from _batches(names, types, out)
                    out, size = [], 0
        close(True)
        yield from _batches(names, types, out)

    return run


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the 16 least costs from state to state through it."""
    for batch in batches:
        rows = []
        for conv, block, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = _turns(code)
            into, cost = _into(turns), [[FAR] * 4 for _ in range(4)]
            for to in range(4):
                dist = distances(turns, [0 if s == to else FAR for s in range(4)], False, into)
                for s in range(4):
                    cost[s][to] = dist[0][s]
            rows.append((conv, block, [c for x in cost for c in x]))
        yield from _batches(batch.schema.names[:2] + ["costs"], [batch.schema.types[0], pa.int64(), pa.list_(pa.int64())], rows)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over blocks from a conversation's last to its first: distances at each one's end, and whether it is the last."""
    now, end = object(), OPEN
    for batch in batches:
        rows = []
        for group, block, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = group != now
            if last:
                now, end = group, distances([], OPEN, True)[0]  # turns are inserted at the very end too
            rows.append((group, block, end, last))
            end = [min(costs[4 * s + t] + end[t] for t in range(4)) for s in range(4)]
        yield from _batches(["conv_id", "block", "end", "last"], [batch.schema.types[0], pa.int64(), pa.list_(pa.int64()), pa.bool_()], rows)


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block its edits, cost and state at the end, for each state that it may be entered in."""
    for batch in batches:
        rows = []
        for conv, block, code, tally, end, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = _turns(code)
            dist = distances(turns, OPEN if last else end, last)
            got = [walk_arcs(turns, dist, s, last) for s in range(4)]
            rows.append((conv, block, tally, [e for e, _ in got], [s for _, s in got], dist[0][START]))
        yield from _batches(["conv_id", "block", "tally", "edits", "exits", "cost"], [batch.schema.types[0], pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64()], rows)


def _joined(names: list[str], types: list[pa.DataType]):
    """Over each block's walk followed by its turns, in order: the finished conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some = None, False
        digest, audit, tally, cost, state, empty = hashlib.sha256(), [], _Tally(), 0, START, True
        todo, at, begin = "", 0, START  # edits of this block, place in them and state there

        def lines(found: list[str]) -> None:
            nonlocal empty
            for line in found:
                digest.update(line.encode() if empty else b"\n" + line.encode())
                empty = False

        def advance(turn: tuple[str, str] | None) -> None:
            """Edits up to and with the one that passes ``turn``; all that are left without one."""
            nonlocal at, begin
            while at < len(todo):
                letter = todo[at]
                if letter == INSERT:
                    lines([f"{ROLE[begin]}:"])
                    begin = NEXT[begin]
                    at += 1
                elif turn is None:
                    raise AssertionError("edits beyond the turns")
                else:
                    lines(list(repaired([turn], letter, begin, [turn[0][:1]])))
                    begin = begin if letter == DELETE else NEXT[begin] if letter == REROLE else KEPT[begin][turn[0][:1]]
                    at += 1
                    return

        def finish() -> tuple:
            advance(None)
            return (now, *tally.result(), cost, "".join(audit), digest.hexdigest())

        for batch in batches:
            rows = []
            for conv, known, edits, exits, least, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not some or conv != now:
                    if some:
                        rows.append(finish())
                    now, some = conv, True
                    digest, audit, tally, cost, state, empty = hashlib.sha256(), [], _Tally(), None, START, True
                    todo, at, begin = "", 0, START
                if known is not None:
                    advance(None)
                    tally.plus(_Tally.of(known))
                    cost = least if cost is None else cost
                    todo, at, begin = edits[state], 0, state
                    audit.append(todo)
                    state = exits[state]
                else:
                    advance((role, text))
            yield from _batches(names, types, rows)
        if some:
            yield from _batches(names, types, [finish()])

    return run


def repair(turns: DataFrame, shift: int = SHIFT) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A row with a null text stands for a conversation's id only. Turns are taken by number, nulls first, then by
    role and digest of the text; a null conv_id is a conversation of its own. Without turns the
    numbers are 0, the audit is empty and the digest is that of the empty string. ``gaps`` ends at the
    largest long. Repeated rows are duplicates; an empty table gives no rows. Blocks have 2**shift turns.
    """
    scratch = Scratch(turns.sparkSession, "conversations")
    text_id = F.unhex(F.sha2(F.col("text"), 256))
    keyed = turns.select("conv_id", "turn", "role", "text", _fault(F.col("text")).alias("fault"), text_id.alias("digest"), F.rand(13).alias("any"))
    order = ["conv_id", "turn", "role", "digest", "any"]  # the last one tells rows apart that are alike, so that no range has to hold them all
    placed = scratch.write(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("any").withColumn("place", F.monotonically_increasing_id()), "placed")
    firsts = placed.where("text IS NOT NULL").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
    one = placed.schema["conv_id"].dataType
    marks = firsts.select(F.lit(None).cast(one).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("fault"), "place", F.lit(True).alias("mark"))
    rows = placed.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", "place", F.lit(False).alias("mark")).union(marks)
    block = F.shiftright("place", shift)
    ordered = rows.repartition(block).sortWithinPartitions("place", F.desc("mark"))
    schema = T.StructType([T.StructField("conv_id", one), *(T.StructField(c, k) for c, k in (*_DONE, *_PART))])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    parts = scratch.write(ordered.mapInArrow(_blocks(kinds.names, kinds.types, shift), schema), "parts")
    scratch.drop("placed")
    done = ["conv_id", *(c for c, _ in _DONE)]
    finished = parts.where(F.col("kind") == FINISHED).select(*done)
    opened = parts.where(F.col("kind") == PART)
    of = T.StructField("conv_id", one)
    costs = opened.select("conv_id", "block", "code").mapInArrow(_costs, T.StructType([of, T.StructField("block", T.LongType()), T.StructField("costs", T.ArrayType(T.LongType()))]))
    ends = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_ends, T.StructType([of, *T.StructType.fromDDL("block long, end array<long>, last boolean").fields]))
    ends = scratch.write(ends.withColumnsRenamed({"conv_id": "conv_of", "block": "block_of"}), "ends")
    known = opened.select("conv_id", "block", "code", "tally").join(ends, (F.col("block") == F.col("block_of")) & F.col("conv_id").eqNullSafe(F.col("conv_of"))).select("conv_id", "block", "code", "tally", "end", "last")
    walks = known.mapInArrow(_walks, T.StructType([of, *T.StructType.fromDDL("block long, tally string, edits array<string>, exits array<int>, cost long").fields]))
    none = lambda kind: F.lit(None).cast(kind)
    heads = walks.select("conv_id", "block", F.lit(-1).cast("long").alias("place"), "tally", "edits", "exits", "cost", none("string").alias("role"), none("string").alias("text"))
    lines = parts.where(F.col("kind") == TURN).select("conv_id", "block", "place", none("string"), none("array<string>"), none("array<int>"), none("long"), "role", "text")
    stream = heads.union(lines).repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").drop("block", "place")
    shape = T.StructType([schema[c] for c in done])
    shown = to_arrow_schema(shape)
    rest = stream.mapInArrow(_joined(shown.names, shown.types), shape)
    free_shuffles(turns.sparkSession)
    return finished.union(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op13_conversation_repair": query}
SQL = {
    "op13_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
src AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS key FROM conversations),
how AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS h FROM src, crc),
hurt AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM how WHERE h <> 0),
num AS (SELECT k, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS f,
    lag(ini) OVER (PARTITION BY k ORDER BY i) AS prior FROM num),
n AS (SELECT k, any_value(conv_id) AS conv_id, coalesce(any_value(m), 0) AS m FROM src LEFT JOIN (SELECT k, count(*) AS m FROM t GROUP BY k) USING (k) GROUP BY k),
dist(k, i, d0, d1, d2, d3) AS (SELECT k, m + 1, 0, 4, 2, 0 FROM n UNION ALL
  SELECT k, i, least(r0, 2 + r2, 4 + r3), least(r1, 2 + r2, 4 + r3), least(r2, 2 + r3), least(r3, 2 + r2) FROM (
    SELECT t.k, t.i, least(3 + d0, CASE WHEN f IN (0, 3) THEN least(CASE ini WHEN 's' THEN d1 WHEN 'u' THEN d2 END, 2 + d2) + (f = 3)::INT END) AS r0,
      least(3 + d1, CASE WHEN f IN (0, 3) THEN least(CASE ini WHEN 'u' THEN d2 END, 2 + d2) + (f = 3)::INT END) AS r1,
      least(3 + d2, CASE WHEN f IN (0, 3) THEN least(CASE ini WHEN 'a' THEN d3 END, 2 + d3) + (f = 3)::INT END) AS r2,
      least(3 + d3, CASE WHEN f IN (0, 3) THEN least(CASE ini WHEN 'u' THEN d2 END, 2 + d2) + (f = 3)::INT END) AS r3
    FROM dist JOIN t ON t.k = dist.k AND t.i = dist.i - 1)),
g AS (SELECT dist.k, dist.i, [d0, d1, d2, d3] AS d, role, text, ini, f FROM dist LEFT JOIN t ON t.k = dist.k AND t.i = dist.i),
walk(k, i, s, audit, out) AS (SELECT k, CAST(1 AS BIGINT), 0, '', CAST(NULL AS VARCHAR) FROM n UNION ALL
  SELECT k, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE nx END, audit || e, CASE WHEN e = 'D' THEN out ELSE coalesce(out || chr(10), '') || CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN nr || ':' || text ELSE nr || ':' END END FROM (
    SELECT *, CASE WHEN f IS NOT NULL AND here = 3 + after[s + 1] THEN 'D' WHEN here = 2 + d[nx + 1] THEN 'I' WHEN f IN (0, 3) AND here = after[kept + 1] + (f = 3)::INT THEN 'K' ELSE 'R' END AS e FROM (
      SELECT w.*, a.d, a.role, a.text, a.f, a.d[s + 1] AS here, b.d AS after, CASE WHEN s = 2 THEN 3 ELSE 2 END AS nx, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS nr,
        CASE WHEN s = 0 AND a.ini = 's' THEN 1 WHEN s <> 2 AND a.ini = 'u' THEN 2 WHEN s = 2 AND a.ini = 'a' THEN 3 END AS kept
      FROM walk w JOIN g a ON a.k = w.k AND a.i = w.i LEFT JOIN g b ON b.k = w.k AND b.i = w.i + 1 WHERE a.f IS NOT NULL OR a.d[s + 1] > 0))),
ended AS (SELECT k, arg_max(audit, length(audit)) AS audit, arg_max(coalesce(out, ''), length(audit)) AS out FROM walk GROUP BY k),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
    count(*) FILTER (WHERE i > 1 AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(d0 AS BIGINT) AS cost, audit, sha256(out) AS repaired_sha256
FROM n JOIN ended USING (k) JOIN dist ON dist.k = n.k AND dist.i = 1 LEFT JOIN counts ON counts.k = n.k
"""
}
