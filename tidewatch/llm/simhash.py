"""Near-duplicate groups by SimHash, candidates by the pigeonring principle; and by shingle similarity.

Fingerprint: a 64-bit SimHash over word shingles hashed with XXH64.

Links: two fingerprints link when they differ in at most ``max_bits`` (2) bits. Cut 64 bits into
a ring of three segments. If the differences sum to at most 2, then some segment starts a chain
in which the first l segments together differ in at most floor(l * 2 / 3) bits: none in the
first, at most one in the first two. That is the strong (pigeonring) form of the pigeonhole
filter. A chain's first step makes an equality key of 21 or 22 bits; its second step allows one
difference, so one half of the second segment is equal too, which lengthens the key to about 32
bits. Six keys per fingerprint therefore find every link; the whole chain is tested before the
full Hamming distance.

Distinct fingerprints only: copies are folded before any join and unfolded at the end. A key
with more than ``BUCKET`` fingerprints isn't paired: there each fingerprint is sent to itself
and to its one-bit neighbours outside the key's fixed bits; two of them are within two bits just
when they meet in such a node, and at most 65 can meet in one. So a bucket of any size costs a
number of rows in proportion to its size, and no link is lost.

Components: alternating large-star and small-star steps over the links.

Similarity (``similar_texts``): two texts link when their sets of word shingles have a Jaccard
similarity of ``percent`` or more. Fingerprints of the sets come first: those that the pigeonring
links are checked on their sets, and what they join isn't compared again. No bit budget is exact
there: at 80 % fingerprints differ in 5 to 11 bits and more, where keys of a 64-bit ring no longer
select. So further candidates come from prefix filters: of two sets that overlap enough, the k first common shingles lie within the
first n - ceil(n * percent / 100) + k of each, in any one order. First in hash order with k about a
tenth of n, which leaves the texts that share enough with any other; then over these in order of
rarity with k = 1. A shingle of more than ``BUCKET`` sets isn't paired, as its sets are mostly copies of
one text: there each is first compared with a pivot, the set with the smallest share of shingles that
stand nowhere else, as the text is that others are changed copies of; and what is in one component
already isn't compared again. After ``ROUNDS`` of these, each with other pivots, most such shingles have
all their sets in one component, which ends them; in the others, each set outside the largest component
is compared once with those of other components. So no link between components is missed, and no
group is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import Scratch, free_shuffles, table, texts_of, walk

#: (first bit, bits) of the three segments, lowest first.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints under one key that are compared in pairs; larger buckets go by neighbours.
BUCKET = 32
#: Rounds in which the sets of a common shingle are compared with one of them each; shingles of a set that take part in one.
ROUNDS, CHOSEN = 3, 2
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text, unsigned; 0 without words."""
    hashes = shingles(text, shingle)
    return majority(hashes) if len(hashes) else 0


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each word shingle in order; a shorter text is one shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) <= shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype="<u8")


def majority(hashes: np.ndarray, block: int = 1 << 14) -> int:
    """Each bit that is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", cols.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return walk(cols, run, schema)


def _bits(fp, first: int, n: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1))


def _keys(fp) -> list:
    """(key, free-bit mask) of the six chain starts."""
    out = []
    for i in range(3):
        first, n = SEGMENTS[i]
        second, m = SEGMENTS[(i + 1) % 3]
        half = m // 2
        for k, (at, width) in enumerate(((second, half), (second + half, m - half))):
            number = 2 * i + k
            key = F.shiftleft(_bits(fp, first, n), 32).bitwiseOR(F.shiftleft(_bits(fp, at, width), 8)).bitwiseOR(F.lit(number).cast("long"))
            out.append(F.struct(key.alias("key"), F.lit(number).alias("chain")))
    return out


def _chain_ok(diff, chain):
    """Cumulative differences of the chain's first two segments within the budget, then all of them."""
    seconds = [SEGMENTS[(i + 1) % 3] for i in range(3)]
    second = F.lit(None)
    for i in range(3):
        second = F.when(F.floor(chain / 2) == i, F.bit_count(_bits(diff, *seconds[i]))).otherwise(second)
    return (second <= 1) & (F.bit_count(diff) <= 2)


def _fixed(number: int) -> int:
    i, k = divmod(number, 2)
    first, n = SEGMENTS[i]
    second, m = SEGMENTS[(i + 1) % 3]
    half = m // 2
    at, width = (second, half) if k == 0 else (second + half, m - half)
    return (((1 << n) - 1) << first) | (((1 << width) - 1) << at)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a > b: links that join the distinct fingerprints ``fp`` as all pairs within two bits would.

    Fingerprints within two bits of each other are always in one component of these links.
    """
    fp = F.col("fp")
    keyed = fps.select("fp", F.explode(F.array(*_keys(fp))).alias("k")).select("fp", "k.key", "k.chain")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.write(keyed.join(sizes, "key"), "shared")
    few = shared.where(F.col("n") <= BUCKET)
    a, b = few.alias("a"), few.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")) & _chain_ok(diff, F.col("a.chain"))).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b")
    )
    flips = F.lit(None).cast("array<bigint>")
    for number in range(6):
        free = [0] + [1 << k for k in range(64) if not _fixed(number) >> k & 1]
        flips = F.when(F.col("chain") == number, F.array(*(F.lit(_signed(x)) for x in free))).otherwise(flips)
    nodes = shared.where(F.col("n") > BUCKET).select("fp", "key", F.explode(flips).alias("flip"))
    nodes = nodes.select("fp", "key", fp.bitwiseXOR(F.col("flip")).alias("node"))
    met = nodes.groupBy("key", "node").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most meet in a node
    stars = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a != b").select("a", "b")
    return pairs.union(stars).distinct()


def _classes(distinct: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, component_id) of ``distinct`` (fp, least): the smallest id that the links lead to."""
    linked = components(edges).join(distinct, F.col("node") == F.col("fp")).select("fp", "label", "least")
    lowest = linked.groupBy("label").agg(F.min("least").alias("lowest"))
    linked = linked.join(lowest, "label").select("fp", "lowest")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id"))
    return scratch.write(classes, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: (id_col, fingerprint as 16 hex digits, component_id).

    ``component_id`` is the smallest id among documents reachable by links of two bits or fewer,
    itself included. Without words (null, empty, blank) the fingerprint is zero and links like
    any other. Rows with a null id get a row too; a component's id is null only if all its ids
    are. Repeated rows stay repeated. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    edges = links(distinct.select("fp"), scratch)
    classes = _classes(distinct, edges, scratch)
    scratch.drop("shared")
    free_shuffles(spark)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _least_overlap(n, percent: int):
    """Shingles that a set of ``n`` shares at least with a set that it links to."""
    return -(-n * percent // 100)


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int | None) -> DataFrame:
    """(id, fp, n, hashes, sim): fp names the shingle set, n is its size, hashes its first ones for ``percent``, all without it, and then sim is its SimHash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(t, shingle)) for t in texts_of(batch.column(1))]
        names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        sizes = [len(x) for x in sets]
        sims = [_signed(majority(x)) if len(x) else 0 for x in sets] if percent is None else [None] * len(sets)
        if percent is not None:
            sets = [x[: len(x) - _least_overlap(len(x), percent) + 1 + len(x) // 10] for x in sets]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(sizes, pa.int64()), hashes, pa.array(sims, pa.int64())], schema.names)

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", cols.schema["id"].dataType), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("sim", T.LongType())])
    return walk(cols, run, schema)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) with the sizes of their sets and how many shingles they share."""
    one, two = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("h_a", "h_b")).cast("long").alias("both"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the ``pairs`` whose sets are similar."""
    return _overlaps(pairs, sets).where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b")


def _may_be_alike(n, known, n2, known2, percent: int):
    """Whether sets of these sizes can be similar when they have nothing in common but what is known from other sets too."""
    return _enough(F.least(known, known2), n, n2, percent)


def _enough(both, n, n2, percent: int):
    return both * (100 + percent) >= (n + n2) * percent


def _common_links(common: DataFrame, sets: DataFrame, edges: DataFrame, scratch: Scratch, percent: int) -> list[DataFrame]:
    """Links of sets under common shingles (h, fp, n, known: shingles that other sets have too) that join what ``edges`` leave apart, as tables of (a, b)."""
    known, columns = components(edges), ["h", "fp", "n", "known"]
    at = scratch.write(common.join(known, F.col("fp") == F.col("node"), "left").select(*columns, F.coalesce("label", "fp").alias("label")), "common-0")
    found, used = [], None

    def still_open(at: DataFrame) -> DataFrame:
        several = at.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
        return at.join(several, "h", "left_semi")

    def merged(at: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """``at`` with new labels; the links are kept in ``found``."""
        links = scratch.write(_verified(pairs.select("a", "b").distinct(), sets, percent), f"links-{name}")
        found.append(links)
        label = at.select("fp", "label").distinct()
        ends = links.join(label.select(F.col("fp").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("fp").alias("b"), F.col("label").alias("lb")), "b")
        renamed = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("new"))
        return scratch.write(still_open(at.join(renamed, "label", "left").select(*columns, F.coalesce("new", "label").alias("label"))), f"common-{name}")

    at = still_open(at)
    for k in range(1, ROUNDS + 1):
        if at.isEmpty():
            return found
        fresh = at if used is None else at.join(used, ["h", "fp"], "left_anti")
        pivots = scratch.write(fresh.groupBy("h").agg(F.min(F.struct((1 - F.col("known") / F.col("n")).alias("own"), "fp", "n", "known", "label")).alias("p")), f"pivots-{k}")
        now = pivots.select("h", "p.fp")
        used = now if used is None else used.union(now)
        few = at.withColumn("turn", F.row_number().over(Window.partitionBy("fp").orderBy(F.xxhash64("h", F.lit(k)), "h"))).where(F.col("turn") <= CHOSEN)
        met = few.join(pivots, "h").where((F.col("label") != F.col("p.label")) & _may_be_alike(F.col("n"), F.col("known"), F.col("p.n"), F.col("p.known"), percent))
        at = merged(at, met.select(F.greatest("fp", "p.fp").alias("a"), F.least("fp", "p.fp").alias("b")), str(k))
        if found[-1].isEmpty():
            break
    if not at.isEmpty():
        # What two sets share lies in the pivot, of which neither has more than it shares with that, or outside,
        # where neither has more than it shares with any set: most sets outside the largest component are
        # too far from the pivot for all that have little of their own but unknown shingles.
        pivots = scratch.write(at.groupBy("h").agg(F.min(F.struct((1 - F.col("known") / F.col("n")).alias("own"), "fp")).alias("p")).select("h", F.col("p.fp").alias("pivot")), "pivots-rest")
        at = at.join(pivots, "h")
        shared = _overlaps(at.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), sets).select(F.col("a").alias("fp"), F.col("b").alias("pivot"), "both")
        at = scratch.write(at.join(shared, ["fp", "pivot"]).withColumn("both", F.least("both", "known")), "common-rest-0")
        sizes = at.groupBy("h", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("h").agg(F.max(F.struct("size", "label")).alias("largest"))
        # a set's own common shingles: a pair meets under the smallest that both have
        named = at.drop("pivot").join(sizes.select("h", F.col("largest.label").alias("main")), "h").join(at.groupBy("fp").agg(F.collect_set("h").alias("all")), "fp")
        outside = named.where("label <> main").select("h", F.col("fp").alias("f2"), F.col("n").alias("n2"), F.col("known").alias("known2"), F.col("label").alias("l2"), F.col("both").alias("both2"), F.col("all").alias("all2"))
        once = F.array_min(F.array_intersect("all", "all2")) == F.col("x.h")
        most = F.least(F.col("both") + F.col("known2") - F.col("both2"), F.col("both2") + F.col("known") - F.col("both"))
        near = _may_be_alike(F.col("n"), F.col("known"), F.col("n2"), F.col("known2"), percent) & _enough(most, F.col("n"), F.col("n2"), percent)
        met = named.alias("x").join(outside.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("label") != F.col("l2")) & near & once)
        merged(at, met.select(F.greatest("fp", "f2").alias("a"), F.least("fp", "f2").alias("b")), "rest")
    return found


def _print_links(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b), a > b: similar ``sets`` (fp, sim, n, hashes) among those whose fingerprints are equal or within two bits."""
    named = sets.select("fp", "sim")
    heads = scratch.write(named.groupBy("sim").agg(F.min("fp").alias("head")), "heads")
    equal = named.join(heads, "sim").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    one, two = (heads.select(F.col("sim").alias(c), F.col("head").alias(f"h_{c}")) for c in "ab")
    near = links(heads.select(F.col("sim").alias("fp")), scratch).join(one, "a").join(two, "b")
    near = near.select(F.greatest("h_a", "h_b").alias("a"), F.least("h_a", "h_b").alias("b"))
    found = scratch.write(_verified(equal.union(near), sets, percent), "near")
    scratch.drop("shared")
    return found


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that ``edges`` don't join."""
    label = components(edges)
    one, two = (label.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")) for c in "ab")
    ends = pairs.join(one, "a", "left").join(two, "b", "left")
    return ends.where(F.coalesce(F.col("l_a") != F.col("l_b"), F.lit(True))).select("a", "b")


def similar_links(docs: DataFrame, prints: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """(a, b), a > b: links between the sets of ``prints`` (id, fp, n, hashes in ``_sets``' prefix)."""
    # texts that share enough with any other set
    keyed = prints.select("fp", "n", F.explode("hashes").alias("h"))
    several = keyed.groupBy("h").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y").select("h")
    need = F.expr(f"1 + (n * {percent} + 99) div 100 div 10")  # k of the smallest set that links to it
    some = keyed.join(several, "h").groupBy("fp", "n").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= need).select("fp")
    some = scratch.write(some, "some")
    reps = prints.join(some, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id")).select("id").distinct()
    id_col, text_col = docs.columns
    again = docs.join(reps, docs[id_col] == reps["id"], "left_semi")
    sets = _sets(again, id_col, text_col, shingle, None).join(some, "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "sim", "n", "hashes")
    sets = scratch.write(sets, "sets")
    alike = _print_links(sets, scratch, percent)
    # the rarest shingles of each
    keyed = sets.select("fp", "n", F.explode("hashes").alias("h"))
    common = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    w = Window.partitionBy("fp")
    ranked = keyed.join(common, "h").withColumns({"rank": F.row_number().over(w.orderBy("df", "h")), "known": F.count(F.lit(1)).over(w)})
    least = F.expr(f"(n * {percent} + 99) div 100")
    prefix = scratch.write(ranked.where(F.col("n") - F.col("known") + F.col("rank") <= F.col("n") - least + 1).select("h", "fp", "n", "known"), "prefix")
    sizes = prefix.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.write(prefix.join(sizes, "h"), "shared")
    few = shared.where(F.col("size") <= BUCKET)
    a, b = few.alias("a"), few.alias("b")
    near = _may_be_alike(F.col("a.n"), F.col("a.known"), F.col("b.n"), F.col("b.known"), percent)
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.fp") > F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()
    edges = alike.union(scratch.write(_verified(_apart(pairs, alike), sets, percent), "pairs"))
    for more in _common_links(shared.where(F.col("size") > BUCKET).select("h", "fp", "n", "known"), sets, edges, scratch, percent):
        edges = edges.union(more)
    return edges.distinct()


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (id_col, component_id), by links of ``percent`` Jaccard similarity or more.

    Similarity is that of the sets of ``shingle``-word shingles; texts without words are alike.
    Rows, nulls and component ids as in ``near_duplicates``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    prints = scratch.write(_sets(docs, id_col, text_col, shingle, percent), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    edges = scratch.write(similar_links(docs.select(id_col, text_col), prints, scratch, shingle, percent), "links")
    classes = _classes(distinct, edges, scratch)
    for name in ("some", "sets", "heads", "near", "prefix", "shared", "pairs", *(f"{x}-{k}" for x in ("common", "links", "pivots") for k in (0, *range(1, ROUNDS + 1), "rest", "rest-0"))):
        scratch.drop(name)
    free_shuffles(spark)
    return prints.select("id", "fp").join(classes, "fp").select(F.col("id").alias(id_col), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_duplicates) -> DataFrame:
    """The documents with one of each near-duplicate group: the one with the smallest id (null ids last).

    ``groups`` is ``near_duplicates`` or ``similar_texts``. Returns the columns of ``docs``. A row is told
    apart by its id and text, both hashed to 128 bits: of unlike texts with one id each counts for
    itself, rows with a null id count like any other, and of rows alike in id and text the one stays whose
    other columns come first as JSON. Columns of ``docs`` may have any names.
    Texts aren't shuffled while the list of rows that go is small enough to be broadcast.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    k1, k2 = F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*docs.columns).alias("doc"))
    last = F.struct(F.col(f"doc.`{id_col}`").isNull().alias("last"), F.col(f"doc.`{id_col}`").alias("id"), "k1", "k2").alias("row")
    found = groups(keyed.select(last, F.col(f"doc.`{text_col}`").alias("text")), "row", "text").groupBy("row").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = scratch.write(found.where("n > 1 OR row <> first").select("row.k1", "row.k2", F.expr("row = first").alias("stays")), "rows")
    single = keyed.join(found.select("k1", "k2"), ["k1", "k2"], "left_anti").select("doc")
    repeated = keyed.join(found.where("stays").select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc")
    return single.union(repeated).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_dedup": query}
SQL: dict[str, str] = {}
