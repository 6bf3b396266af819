"""Repeated byte strings over a whole corpus, by a sparse suffix order refined with bucket pointers.

The question: which bytes lie in a string of ``length`` (200) bytes that also starts anywhere
else. With q = length / 2, the suffix at p is told apart from others in steps.

1. Initial buckets. A position's bucket pointer is the identifier of its q-gram. Suffixes are
   sampled: a string of 200 bytes has q + 1 of these pointers and the smallest is its bucket,
   which depends on nothing but the string. Neighbouring starts with the same bucket make a
   *run* (about one per 50 bytes), the unit that is shuffled.
2. A bucket with one run is final: none of its starts repeats (but for repeats within the run,
   which are found on the spot).
3. The runs of a larger bucket are refined by the identifier of all the bytes that they span.
   Runs alike in it repeat as a whole: the update holds for all their starts at once and none
   is looked at again. A bucket whose runs are all alike is final, as is one whose classes all
   have several runs.
4. Of buckets that are still mixed, one run of each class is split by offset: starts whose first
   q-gram of the bucket lies ``STEP`` offsets apart at most stay together. The new bucket is the
   identifier of the bytes that all starts of such a piece share; pieces that differ there have
   no string in common. Then steps 2 and 3 are used again on the pieces.
5. Once more for what is mixed even so, with single starts: the bucket is the start's own pointer
   and it is refined by its whole string. The rounds end as soon as nothing is mixed.

Two kinds of identifiers are compared together. A bucket pointer is a polynomial modulo 2**64, fast
enough for each byte; as strings can be made that such sums don't tell apart (Thue-Morse), what a
bucket is refined by are polynomials modulo two primes over the whole span. Strings count as equal
on both, 64 and 62 bits. Groups of copies stay in one class of runs, which partial aggregation
counts; a class is never gathered, and no pairs are made. Buckets and classes of over ``HOT`` rows
are few and joined apart from the others, by a broadcast where Spark finds their table small enough.
Matches can't cross documents, as no start within ``length`` bytes of a text's end has a string.
Texts are handled in blocks with an overlap, and what is removed is merged as intervals, so no array
is as long as a text but its bytes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, flat_bytes, free_shuffles, table, walk

LENGTH = 200
#: Offsets that stay together in the second round.
STEP = 8
#: Bytes whose identifiers are in memory at once.
BLOCK = 1 << 19
#: Rows of a bucket or class from which on it is joined apart.
HOT = 4096
#: Moduli and bases of the second kind of identifiers.
_PRIMES = (((1 << 31) - 1, 1_150_286_909), ((1 << 31) - 19, 842_003_191))
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads high and low bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit number for each byte.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


class _Powers:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))
        return cls.up, cls.down


class Prefix:
    """Identifiers of any substrings of ``data``: equal for equal bytes, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, down = _Powers.of(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * down[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.up[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.up[:n])


class PrimePrefix:
    """As ``Prefix``, modulo two primes: slower, and without strings that are known to meet."""

    _powers: dict = {}

    @classmethod
    def powers(cls, prime: int, base: int, n: int) -> np.ndarray:
        known = cls._powers.get((prime, base), np.ones(1, np.uint64))
        while len(known) < n:
            step = np.uint64(pow(base, len(known), prime))
            known = np.concatenate([known, known[: n - len(known)] * step % np.uint64(prime)])
        cls._powers[prime, base] = known
        return known

    def __init__(self, data: np.ndarray):
        n, self.parts = len(data), []
        for prime, base in _PRIMES:
            p = np.uint64(prime)
            digits = _BYTES % p
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(digits[data] * self.powers(prime, pow(base, -1, prime), n + 1)[:n] % p, out=sums[1:])
            self.parts.append((p, sums, self.powers(prime, base, n + 1)))

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """For strings of different lengths the length counts too."""
        out = np.zeros(len(start), np.uint64)
        for p, sums, up in self.parts:
            out = out << np.uint64(31) | (sums[start + length] - sums[start]) % p * up[start] % p
        return _mixed(out) + np.asarray(length).astype(np.uint64) * np.uint64(_MULTIPLIER)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick() over each window of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _blocks(total: int, length: int, block: int):
    """(first start, end of starts) of blocks of starts."""
    at = 0
    while at + length <= total:
        yield at, min(at + block, total - length + 1)
        at += block


def _row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, block: int = BLOCK):
    """Runs (row, first start in the row, starts, bucket, span id), and starts that repeat within a run (row, first, starts)."""
    q = length // 2
    found, own = [], []
    starts_total = len(data)
    for first, stop in _blocks(starts_total, length, block):
        part = data[first : stop + length - 1]
        ids = Prefix(part)
        grams = ids.every(q)
        least = _sliding(grams, length - q + 1, np.minimum)
        row = _row_of(offsets, np.arange(first, stop))
        ok = offsets[row + 1] - np.arange(first, stop) >= length
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        bucket = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        lo, n = at[head], np.diff(np.append(head, len(at)))
        whole = PrimePrefix(part)
        span = whole.at(lo, n - 1 + length)
        found.append((row[lo], lo + first - offsets[row[lo]], n, bucket[head], span))
        # a bucket's q-gram that stands twice within a run's span: only then can the run hold equal starts
        most = _sliding(np.concatenate([np.zeros(length - q, np.uint64), least, np.zeros(length - q, np.uint64)]), length - q + 1, np.maximum)
        marks = np.flatnonzero(most == grams)
        twice = marks[:-1][(grams[marks[1:]] == grams[marks[:-1]]) & (np.diff(marks) <= length - q + 1)]
        if len(twice):
            k = np.clip(np.searchsorted(lo, twice, side="right") - 1, 0, len(lo) - 1)
            k = np.unique(np.concatenate([k, np.maximum(k - 1, 0), np.minimum(k + 1, len(lo) - 1)]))
            run, p = _spread(lo[k], n[k])
            a, b = ids.at(p, q), whole.at(p, length)
            order = np.lexsort((b, a, run))
            same = (run[order][1:] == run[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            hit = np.zeros(len(p), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            p = np.sort(p[hit])
            if len(p):
                cut = np.ones(len(p), bool)
                cut[1:] = (p[1:] != p[:-1] + 1) | (row[p[1:]] != row[p[:-1]])
                s = np.flatnonzero(cut)
                own.append((row[p[s]], p[s] + first - offsets[row[p[s]]], np.diff(np.append(s, len(p)))))
    join = lambda parts, k: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * k
    return join(found, 5), join(own, 3)


def _spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the interval and the number, for every number in [lo, lo + n)."""
    index = np.repeat(np.arange(len(lo)), n)
    return index, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _runs_batch(length: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat_bytes(batch.column(2))
        (row, lo, n, bucket, span), (row2, lo2, n2) = runs_of(data, offsets, length)
        none = np.zeros(len(row2), np.int64)
        rows = np.concatenate([row, row2]).astype(np.int64)
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(take),
                batch.column(1).take(take),
                pa.array(np.concatenate([lo, lo2]).astype(np.int32)),
                pa.array(np.concatenate([n, n2]).astype(np.int32)),
                pa.array(np.concatenate([bucket.view(np.int64) if len(bucket) else none[:0], none])),
                pa.array(np.concatenate([span.view(np.int64) if len(span) else none[:0], none])),
                pa.array(np.concatenate([np.zeros(len(row), bool), np.ones(len(row2), bool)])),
            ],
            ["id", "key", "lo", "n", "bucket", "span", "own"],
        )

    return run


def _pieces(part: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int, step: int):
    """Pieces of runs (run, first start, starts, bucket, span id); with step 1 single starts."""
    q, ids, whole = length // 2, Prefix(part), PrimePrefix(part)
    run, p = _spread(lo, n)
    if step == 1:
        return run, p, np.ones(len(p), np.int64), ids.at(p, q), whole.at(p, length)
    grams = ids.every(q)
    # a run's bucket is the smallest gram of any of its starts
    wide, j = _spread(lo, n + length - q)
    begin = np.cumsum(n + length - q) - (n + length - q)
    first_window = _spread(lo, np.full(len(lo), length - q + 1))[1].reshape(len(lo), -1)
    bucket = grams[first_window].min(axis=1)
    big = np.int64(1) << 40
    where = np.where(grams[j] == bucket[wide], wide * big + j, (wide + 1) * big)
    following = np.minimum.accumulate(where[::-1])[::-1] - wide * big  # the next place of the bucket's gram
    offset = following[np.repeat(begin, n) + p - lo[run]] - p
    new = np.ones(len(p), bool)
    new[1:] = (run[1:] != run[:-1]) | (offset[1:] // step != offset[:-1] // step) | (offset[1:] + 1 != offset[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(p)))
    gram_at = p[head] + offset[head]
    slot = offset[head] // step
    # shared by all starts that a piece of this slot can have, whether this one has them or not
    core = ids.at(gram_at - slot * step, length - step + 1)
    span = whole.at(p[head], size - 1 + length) + offset[head].astype(np.uint64)
    return run[head], p[head], size, core, span


def _split_batch(length: int, step: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat_bytes(batch.column(2))
        runs = pa.concat_arrays([batch.column(3)])
        per = np.diff(np.asarray(runs.offsets))
        flat = runs.flatten()
        lo, n, need = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "n", "need"))
        row = np.repeat(np.arange(batch.num_rows), per)
        lo, n = offsets[row] + lo, n.astype(np.int64)
        out = []
        for first, stop in _blocks(len(data), length, BLOCK):
            a, b = np.maximum(lo, first), np.minimum(lo + n, stop)
            inside = np.flatnonzero(a < b)
            if len(inside):
                of, p, size, bucket, span = _pieces(data[first : stop + length - 1], a[inside] - first, (b - a)[inside], length, step)
                out.append((inside[of], p + first, size, bucket.view(np.int64), span.view(np.int64)))
        of, p, size, bucket, span = (np.concatenate(x) for x in zip(*out, strict=True))
        rows = row[of]
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array((p - offsets[rows]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(bucket), pa.array(span), pa.array(need[of])],
            ["id", "key", "lo", "n", "bucket", "span", "need"],
        )

    return run


def merged(offsets: np.ndarray, spans: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the maximal runs of bytes in repeated strings, in order; begin and end count from the first text."""
    per = np.diff(np.asarray(spans.offsets)) if len(spans) else np.zeros(0, np.int64)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(per)), per)
    lo, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "n"))
    begin = offsets[row] + lo
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], (begin + n - 1 + length)[order]
    reach = np.maximum.accumulate(end) if len(end) else end  # rows follow one another, so an earlier row reaches no further
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return row[head], begin[head], reach[np.append(head[1:], len(row)) - 1] if len(head) else end


_UNIT = ["id", "key", "lo", "n"]


def _matched(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to a written ``table`` of (on..., c, ...), one row a key with the number ``c`` of its rows: keys of many rows apart."""
    hot = table.where(F.col("c") > HOT)
    return rows.join(hot.drop("c"), on, how).unionByName(rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col("c") <= HOT).drop("c"), on, how))


def _refine(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """One round over (id, key, lo, n, bucket, span, need): what repeats as a whole, and one of each class that is still open.

    ``need`` marks rows of which it isn't known yet; the others only stand for their class.
    """
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("span").alias("s0"), F.max("span").alias("s1"), F.bool_or("need").alias("asked"))
    buckets = scratch.write(buckets.where("c > 1 AND asked").select("bucket", "c", (F.col("s0") != F.col("s1")).alias("mixed")), f"{name}-buckets")
    shared = scratch.write(_matched(rows, buckets, ["bucket"]), f"{name}-shared")
    mixed = shared.where("mixed")
    classes = mixed.groupBy("bucket", "span").agg(F.count(F.lit(1)).alias("c"), F.bool_or("need").alias("asked"), F.min(F.struct(*_UNIT)).alias("one"))
    classes = scratch.write(classes.select("bucket", "span", "c", (F.col("asked") & (F.col("c") == 1)).alias("need"), "one.*"), f"{name}-classes")
    alike = _matched(mixed.where("need"), classes.where("c > 1").select("bucket", "span", "c"), ["bucket", "span"], "left_semi")
    known = shared.where("need AND NOT mixed").select("key", "lo", "n").union(alike.select("key", "lo", "n"))
    unsettled = classes.where("need").select("bucket").distinct()
    return known, classes.join(unsettled, "bucket", "left_semi").select(*_UNIT, "need")


def _cover(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(key, spans): starts whose strings repeat, for each text that has some; ``docs`` has id, key, text."""
    spark = docs.sparkSession
    cols = docs.select("id", "key", "text")
    shape = [cols.schema["id"], cols.schema["key"], *(T.StructField(c, k) for c, k in (("lo", T.IntegerType()), ("n", T.IntegerType()), ("bucket", T.LongType()), ("span", T.LongType())))]
    runs = scratch.write(walk(cols, _runs_batch(length), T.StructType([*shape, T.StructField("own", T.BooleanType())])), "runs")
    own = scratch.write(runs.where("own").select("key", "lo", "n"), "own")
    known, left = _refine(runs.where("NOT own").drop("own").withColumn("need", F.lit(True)), scratch, "runs")
    found = [own, known]
    scratch.drop("runs")
    free_shuffles(spark)
    texts = docs.select("id", "key", "text")
    for step in (STEP, 1):
        if left.isEmpty():
            break
        ends = left.groupBy("id", "key").agg(F.collect_list(F.struct("lo", "n", "need")).alias("runs")).withColumnsRenamed({"id": "id2", "key": "key2"})
        same_row = (F.col("key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2"))
        texts = scratch.write(texts.join(ends, same_row).select("id", "key", "text", "runs"), f"texts-{step}")
        free_shuffles(spark)
        pieces = scratch.write(walk(texts, _split_batch(length, step), T.StructType([*shape, T.StructField("need", T.BooleanType())])), f"pieces-{step}")
        texts = texts.drop("runs")
        known, left = _refine(pieces, scratch, f"pieces-{step}")
        found.append(known)
        scratch.drop(f"pieces-{step}")
        free_shuffles(spark)
    spans = reduce(DataFrame.union, found)
    cover = scratch.write(spans.groupBy("key").agg(F.collect_set(F.struct("lo", "n")).alias("spans")), "cover")
    for name in ("own", *(f"{x}-{y}" for x in ("runs", f"pieces-{STEP}", "pieces-1") for y in ("buckets", "shared", "classes")), f"texts-{STEP}", "texts-1"):
        scratch.drop(name)
    free_shuffles(spark)
    return cover


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None, text: bool = False) -> DataFrame:
    """Row for row: ``id_col``, the ``keep`` columns, n_bytes, n_removed, n_spans and kept_sha256.

    With ``text`` there is ``kept_text`` besides: the remaining bytes as text, less characters
    that a removed span has cut. Texts are UTF-8 bytes, null is empty; texts under ``length``
    bytes lose nothing; of a string that repeats every occurrence goes, in repeated rows too.
    Null ids are allowed. An empty table gives no rows.
    """
    if length % 2:
        raise ValueError("the length must be even")
    keep = [c for c in keep or [] if c != id_col]
    scratch = Scratch(docs.sparkSession, "suffix")
    filled = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(filled.cast("binary"))).alias("key"), filled.alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    cover = _cover(known, length, scratch)
    joined = known.join(cover, "key", "left").select("text", F.coalesce("spans", F.array().cast("array<struct<lo:int,n:int>>")).alias("spans"), "id", *(f"k{i}" for i in range(len(keep))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat_bytes(batch.column(0))
        row, begin, end = merged(offsets, pa.concat_arrays([batch.column(1)]), length)
        count = batch.num_rows
        n_removed, n_spans = np.bincount(row, weights=end - begin, minlength=count).astype(np.int64), np.bincount(row, minlength=count)
        size, view, at = np.diff(offsets), memoryview(data), np.concatenate([[0], np.cumsum(n_spans)]).tolist()
        edges, borders = np.column_stack([begin, end]).tolist(), offsets.tolist()
        kept = []
        for k in range(count):
            cuts = [borders[k], *(x for pair in edges[at[k] : at[k + 1]] for x in pair), borders[k + 1]]
            kept.append(b"".join(view[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        out = [pa.array(size), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        out += [pa.array([x.decode(errors="ignore") for x in kept], pa.string())] if text else []
        return pa.RecordBatch.from_arrays([*batch.columns[2:], *out], names)

    fields = [joined.schema["id"], *(joined.schema[f"k{i}"] for i in range(len(keep)))]
    fields += [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] if text else []
    names = [f.name for f in fields]
    done = walk(joined, run, T.StructType(fields))
    return done.select(F.col("id").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names[len(keep) + 1 :])  # "cover" is read by whoever reads the result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_dedup": query}
SQL = {
    "op10_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT r, p, md5_number(array_slice(b, p, p + 199)) AS h FROM (SELECT r, b, unnest(range(1, n - 198)) AS p FROM d WHERE n >= 200)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
edge AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200, true) AS new FROM hit),
island AS (SELECT r, min(p) AS a, max(p) + 199 AS z FROM (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM edge) GROUP BY r, k),
gap AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM island UNION ALL SELECT d.r, coalesce(max(z), 0) + 1, any_value(d.n) FROM d LEFT JOIN island USING (r) GROUP BY d.r),
kept AS (SELECT r, sha256(unhex(coalesce(string_agg(hex(array_slice(b, a, z)), '' ORDER BY a) FILTER (WHERE z >= a), ''))) AS kept_sha256 FROM gap JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM island GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
}
