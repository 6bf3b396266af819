"""A mix of sources at target weights, by weighted fair queueing.

Every source is a queue: its documents in shuffled order, and again in that order for each further
pass, ``MOST`` passes at most. A copy of a document that ends at word c of its queue has the virtual
finish time c / target. Copies of all queues are sorted by finish time, so at any time each source has
had its share of what was taken, and the mix ends where the total budget is used up. That is at
virtual time 1, where queue s has had its target of words: copies that finish by then are taken whole,
and the one of each queue that is then being served is cut there, as a document of very many words
would otherwise take its source far from its target.

Shuffled order is the order of md5 of id and text. The words before a document in its queue are those
before it in its range of a range-sorted table and those of the ranges before, of which there is one
number for each range and source; so no source is gathered, however large. The same is done for the
running total of the mix. What is sorted is written first: ranges drawn twice need not be the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ranks import numbered

from .common import Scratch, free_shuffles, table

WEIGHTS, MOST = (1, 2, 3), 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """Words between ASCII white space; none in null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares of the budget (all words by default) by weight.

    Sources by code point, null last, have the ``weights`` in turn. A source above ``most`` times its size
    is held there, and what is over is shared by the others by weight, until none is above. Sizes are
    read again for each such step; only sums come to the driver.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.expr(f"CAST((place - 1) % {len(weights)} AS INT) + 1"))
    ranked = Scratch(sizes.sparkSession, "targets").write(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) if budget is None else budget
    most_of = F.col("source_size") * most
    share, full, left = None, F.lit(False), (budget, 0)
    while True:
        r = ranked.agg(F.coalesce(F.sum(F.when(full, most_of)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")).first()
        if left == (budget - r.full, r.open) or not r.open:
            break
        left = (budget - r.full, r.open)
        share = F.col("weight").cast("double") * float(left[0]) / float(left[1])
        full = share > most_of
    target = most_of.cast("double") if share is None else F.when(full, most_of.cast("double")).otherwise(share)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted (source, size, ...) of one range the words of its source up to and with each row."""
    source, total = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names, size = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        # 1 where a source begins
        codes = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        new[0] = names[0].as_py() != source
        sums = np.cumsum(size)
        before = np.where(new, sums - size, 0)
        base = np.maximum.accumulate(before)  # sums never fall, so the last start counts
        first = np.flatnonzero(new)
        carried = first[0] if len(first) else len(codes)
        sums = sums - base
        sums[:carried] += total
        source, total = names[len(names) - 1].as_py(), int(sums[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], [*batch.schema.names, "inside"])


def queued(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, id, size, source, ends): each of ``rows`` (id, text, source) with a number of its own and the words of its queue up to and with it."""
    # the last key tells rows apart that are alike in everything, so that no range has to hold them all
    keyed = rows.select(F.col("source").cast("string").alias("source"), words("text").alias("size"), F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))).alias("order"), "id", F.rand(11).alias("any"))
    order = [F.col("source").asc_nulls_last(), F.col("order"), F.col("any")]
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("order", "any")
    fields = [*spread.schema.fields, T.StructField("inside", T.LongType())]
    sums = spread.mapInArrow(_running, T.StructType(fields)).withColumn("row", F.monotonically_increasing_id())
    sums = scratch.write(sums.withColumn("range", F.shiftright("row", 33)), "queued")
    # a row for each range and source in it
    parts = sums.groupBy("source", "range").agg(F.max("inside").alias("own"))
    before = parts.select(F.col("source").alias("of"), "range", (F.sum("own").over(Window.partitionBy("source").orderBy("range")) - F.col("own")).alias("before"))
    return sums.join(before, sums["source"].eqNullSafe(before["of"]) & (sums["range"] == before["range"])).select("row", "id", "size", "source", (F.col("inside") + F.col("before")).alias("ends"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The queues and the mix.

    The first has a row for each document: row, id_col, size, source, source_size, target. The second has the
    copies taken in their order: place (from 1), row, id_col, copy (from 0), finish, words (all of the document, or
    its first ones where it is cut), total (words of the mix up to and with it).

    Null and empty texts have no words and aren't taken; a null source is one of its own, after the
    others. Repeated rows and null ids count each. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    queues = scratch.write(queued(rows, scratch), "queues")
    scratch.drop("queued")
    sizes = scratch.write(queues.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    budget = (sizes.agg(F.sum("source_size")).first()[0] or 0) if budget is None else budget
    aims = targets(sizes, weights, most, budget).withColumnRenamed("source", "of")
    aimed = scratch.write(queues.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight"), "aimed")
    scratch.drop("queues")
    whole = F.floor("target").cast("long")
    begins = F.col("ends") - F.col("size")
    # passes of the queue that reach this document before the target
    passes = F.expr("CAST((floor(target) - (ends - size) + source_size - 1) div source_size AS INT)")
    copies = aimed.where((F.col("size") > 0) & (begins < whole)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), passes - 1))))
    end = F.col("copy").cast("long") * F.col("source_size") + F.col("ends")
    copies = copies.select("row", "id", "source", "copy", (end.cast("double") / F.col("target")).alias("finish"), F.least("size", whole - end + F.col("size")).alias("words"))
    order = [F.col("finish"), F.col("row"), F.col("copy")]
    spread = copies.repartitionByRange(*order).sortWithinPartitions(*order)
    one = spread.select(F.lit("").alias("all"), F.col("words"), "row", "id", "copy", "finish")
    fields = [*one.schema.fields, T.StructField("inside", T.LongType())]
    placed = one.mapInArrow(_running, T.StructType(fields)).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.write(placed.withColumn("range", F.shiftright("at", 33)).drop("all"), "placed")
    parts = placed.groupBy("range").agg(F.max("inside").alias("own"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("range")  # a row for each range
    before = parts.select("range", (F.sum("own").over(w) - F.col("own")).alias("before"), (F.sum("n").over(w) - F.col("n")).alias("earlier"))
    total = F.col("before") + F.col("inside")
    place = F.col("earlier") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    mixed = placed.join(F.broadcast(before), "range").select(place.alias("place"), "row", F.col("id").alias(id_col), "copy", "finish", "words", total.alias("total"))
    limit = F.lit(budget).cast("long")
    mixed = mixed.where(F.col("total") - F.col("words") < limit).withColumns({"words": F.least("words", limit - F.col("total") + F.col("words")), "total": F.least("total", limit)})
    free_shuffles(docs.sparkSession)
    return aimed.select("row", F.col("id").alias(id_col), "size", "source", "source_size", "target"), mixed


def taken(queues: DataFrame, mixed: DataFrame) -> DataFrame:
    """``queues`` with the words that the mix takes of each document, repeats counted."""
    words_of = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    return queues.join(words_of, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues, mixed = mix(table(spark, sf_dir, "documents"))
    return taken(queues, mixed).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op11_source_mix": query}
SQL = {
    "op11_source_mix": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS o, row_number() OVER () AS r FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
levels AS (SELECT 0 AS k, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) AS rest, CAST((SELECT sum(weight) FROM s) AS DOUBLE) AS of
  UNION ALL SELECT k + 1, b.rest, b.of FROM levels l, LATERAL (SELECT CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (WHERE weight * l.rest / l.of > 3 * source_size), 0) AS DOUBLE) AS rest,
    CAST(sum(weight) FILTER (WHERE weight * l.rest / l.of <= 3 * source_size) AS DOUBLE) AS of FROM s) b WHERE k < (SELECT count(*) FROM s) AND b.of > 0 AND b.of < l.of),
aims AS (SELECT source, source_size, CASE WHEN weight * rest / of > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight AS DOUBLE) * rest / of END AS target FROM s, (SELECT * FROM levels ORDER BY k DESC LIMIT 1)),
q AS (SELECT d.*, source_size, target, floor(target) AS whole, sum(size) OVER (PARTITION BY d.source ORDER BY o, r) AS ends FROM d JOIN aims ON d.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, whole - ends + size)) + greatest(0, least(size, whole - source_size - ends + size)) + greatest(0, least(size, whole - 2 * source_size - ends + size)) AS BIGINT) AS taken FROM q
"""
}
