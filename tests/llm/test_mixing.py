"""The mix against a plain loop over queues and copies."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from tidewatch.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, source string, size long, row long, target string, place long"


def plain(rows, budget=None):
    """[(doc_id, size, source_size, target, taken)] by serving every queue word by word up to its target."""
    sizes = defaultdict(int)
    items = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    for *_, s, n in items:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    budget = sum(sizes.values()) if budget is None else budget
    held, target = set(), {}
    while True:
        left, of = budget - sum(3 * sizes[s] for s in held), sum(weight[s] for s in order if s not in held)
        target = {s: Fraction(3 * sizes[s]) if s in held else Fraction(weight[s] * left, of) for s in order}
        above = {s for s in order if target[s] > 3 * sizes[s]}
        if not above:
            break
        held |= above
    out = []
    for s in order:
        queue = sorted((x for x in items if x[2] == s), key=lambda x: hashlib.md5(f"{'' if x[0] is None else x[0]}:{x[1] or ''}".encode()).hexdigest())
        took, room = [0] * len(queue), int(target[s])
        for _ in range(3):
            for k, x in enumerate(queue):
                n = min(room, x[3])
                took[k] += n
                room -= n
        out += [(x[0], x[3], sizes[s], float(target[s]), n) for x, n in zip(queue, took, strict=True)]
    return out


def key(rows):
    return sorted(((-1 if r[0] is None else r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in rows)


def got(df, **more):
    queues, mixed = mixing.mix(df, **more)
    return mixing.taken(queues, mixed).select("doc_id", "size", "source_size", "target", "taken").collect(), mixed.orderBy("place").collect()


def test_mix_equals_plain_queues(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows, mixed = got(df)
    assert key(rows) == key(plain([(r.doc_id, r.text, r.source) for r in df.collect()]))
    assert [r.place for r in mixed] == list(range(1, len(mixed) + 1))
    assert [r.finish for r in mixed] == sorted(r.finish for r in mixed)
    total = 0
    for r in mixed:
        total += r.words
        assert r.total == total
    budget, sources = sum(r["size"] for r in rows), df.select("source").distinct().count()
    assert budget - sources <= total <= budget
    again, order = got(df.repartition(7))
    assert key(again) == key(rows) and [(r.doc_id, r.copy) for r in order] == [(r.doc_id, r.copy) for r in mixed]


def test_shares_hold_at_any_point(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "substring(text, 1, 300) AS text", "concat('s', doc_id % 3) AS source")
    rows, mixed = got(df)
    source, target = {r.doc_id: r.doc_id % 3 for r in rows}, {r.doc_id % 3: r.target for r in rows}
    had, most = defaultdict(int), max(r["size"] for r in rows)
    for r in mixed:
        had[source[r.doc_id]] += r.words
        for s, t in target.items():
            assert abs(had[s] - r.finish * t) <= 2 * most


def test_odd_sources(spark):
    rows = [(k, f"w{k} " * (k % 7), "abc"[k % 3]) for k in range(40)] + [(100, "one word more " * 50, None), (None, "no id", "a"), (None, "no id", "a"), (101, None, "b"), (102, "", "zero"), (103, " \n\t", "é"), (104, "a", "Z"), (5, "w5 " * 5, "c")]
    df = spark.createDataFrame([(*r, 7, 7, "mine", 7) for r in rows], SHAPE)
    for budget in (None, 0, 1, 17, 10_000):
        result, mixed = got(df, budget=budget)
        assert len(result) == len(rows) and all(r.taken <= 3 * r["size"] for r in result)
        assert sum(r.words for r in mixed) == sum(r.taken for r in result) <= (sum(r["size"] for r in result) if budget is None else budget)
        if budget is None or budget < 300:
            assert key(result) == key(plain(rows, budget))
    none = spark.createDataFrame([], SHAPE)
    assert got(none) == ([], [])
    blank = spark.createDataFrame([(1, None, None, 1, 1, "", 1), (2, " ", "a", 1, 1, "", 1)], SHAPE)
    result, mixed = got(blank)
    assert [(r["size"], r.source_size, r.target, r.taken) for r in result] == [(0, 0, 0.0, 0)] * 2 and mixed == []


def test_one_source_of_many_alike_rows(spark):
    df = spark.range(3000).selectExpr("CAST(1 AS LONG) AS doc_id", "'two words' AS text", "IF(id < 2000, 'hot', concat('s', id % 4)) AS source")
    result, _ = got(df)
    assert key(result) == key(plain([(r.doc_id, r.text, r.source) for r in df.collect()]))
