"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

Longest first, a document goes to the bin that it fills best among the compatible ones. Open bins
are ordered by what is left of them; the search starts at the first that has room and goes on to
its successors until one is compatible, which is then the tightest compatible bin. A bin carries
bitmaps of its sources and of its duplicate clusters: documents of one cluster never share a bin,
and of one source at most ``per_source`` do (a bitmap for each of the first ``per_source``).

Documents are dealt by a hash into blocks of about ``BLOCK`` rows, each packed on its own, so the
work is parallel, bounded and the same for any number of partitions. No bin spans blocks, so
conflicts hold everywhere. A source or cluster of any size is spread over all blocks, and so are rows
that repeat: alike ones are counted first and each gets a number that counts in its hash.

A document longer than a bin is cut into pieces of a whole bin each and a rest, which is packed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table
from .token_counts import token_counts

#: Tokens of a bin, documents of a source in it, documents of a block on average.
CAPACITY, PER_SOURCE, BLOCK = 4096, 1, 2048
#: Rows alike that are dealt out at once.
_LOT = 1024


class Packer:
    """Bins of one block, for items that come longest first."""

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE):
        self.capacity, self.per_source = capacity, per_source
        self.bins = 0
        self.open: list[tuple[int, int]] = []  # (room left, bin), ascending
        self.sources: dict[int, list[int]] = {}
        self.clusters: dict[int, int] = {}
        self.source_bits: dict = {}
        self.cluster_bits: dict = {}

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset in it) for an item of 1 to ``capacity`` tokens; a null source or cluster conflicts with nothing."""
        s = 0 if source is None else 1 << self.source_bits.setdefault(source, len(self.source_bits))
        c = 0 if cluster is None else 1 << self.cluster_bits.setdefault(cluster, len(self.cluster_bits))
        for k in range(bisect_left(self.open, (size, -1)), len(self.open)):
            room, number = self.open[k]
            if self.clusters[number] & c or self.sources[number][-1] & s:
                continue
            del self.open[k]
            break
        else:
            room, number = self.capacity, self.bins
            self.bins += 1
            self.clusters[number], self.sources[number] = 0, [0] * self.per_source
        self.clusters[number] |= c
        layers = self.sources[number]
        for k in range(self.per_source):
            if not layers[k] & s:
                layers[k] |= s
                break
        if room > size:
            insort(self.open, (room - size, number))
        else:
            del self.clusters[number], self.sources[number]
        return number, self.capacity - room

    def pieces(self, size: int, source, cluster) -> list[tuple[int, int, int, int, int]]:
        """(piece, first token, tokens, bin, offset) of a document."""
        out = []
        whole, rest = divmod(size, self.capacity)
        for k in range(whole):
            out.append((k, k * self.capacity, self.capacity, self.bins, 0))
            self.bins += 1
        if rest:
            out.append((whole, whole * self.capacity, rest, *self.place(rest, source, cluster)))
        return out


def pack(
    docs: DataFrame, size_col: str, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster",
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, block: int = BLOCK,
) -> DataFrame:
    """One row per piece: id, piece, first_token, n_tokens, bin_id, bin_offset.

    Sizes are tokens; a document of none (or of null size) gets one row with piece 0 and a null
    bin. Null sources and clusters conflict with nothing. Repeated rows are packed each; ties go
    by id, then source and cluster. An empty table gives no rows; other columns are ignored.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    blocks = max(1, -(-rows.count() // block))
    alike = rows.groupBy("id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("n"))
    lots = alike.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_LOT}"))))
    each = lots.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(_LOT), F.col("n") - F.col("lot") * _LOT) - 1)))
    number = F.col("lot") * _LOT + F.col("place")
    dealt = each.select(*rows.columns, F.pmod(F.when(number == 0, F.xxhash64("id", "cluster")).otherwise(F.xxhash64("id", "cluster", number)), F.lit(blocks)).alias("block"))
    ordered = dealt.repartition("block").sortWithinPartitions("block", F.desc("size"), "id", "source", "cluster")
    made = [("piece", T.IntegerType()), ("first_token", T.LongType()), ("n_tokens", T.LongType()), ("bin_id", T.LongType()), ("bin_offset", T.LongType())]
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, k) for c, k in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for batch in batches:
            index, out = [], []
            for k, (size, source, cluster, number) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                if number != now:
                    now, packer = number, Packer(capacity, per_source)
                got = [(p, f, n, number << 32 | b, o) for p, f, n, b, o in packer.pieces(size, source, cluster)] or [(0, 0, 0, None, None)]
                index += [k] * len(got)
                out += got
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], schema.names)

    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """Packs by token counts. ``cluster_col`` names duplicate clusters, such as the component ids of near-duplicates; without it copies of a text are one."""
    cluster = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if cluster_col is None else F.col(cluster_col)
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), cluster.alias("cluster"))
    counted = token_counts(keyed, keep=["doc", "source", "cluster"], out="size")
    # the counts are read twice, to size the blocks and to pack; the texts once
    counted = Scratch(docs.sparkSession, "packing").write(counted, "sizes")
    return pack(counted, "size", "doc").withColumnRenamed("doc", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": query}
SQL: dict[str, str] = {}
