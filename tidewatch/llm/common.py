"""What the text operators share: scratch tables, Arrow batch walking, flat word arrays.

Conventions used by every operator here

* A null text is read as the empty text unless the operator says otherwise.
* Operators select the columns they need by name, so other columns of the input - also those
  that bear the name of a result column - neither reach the result nor disturb it.
* Repeated rows stay repeated: one result row per input row.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; bounds the worker's memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """A folder of intermediate tables under ``spark.checkpoint.dir``.

    Written tables cut the lineage and outlive executors. ``write`` returns the table as read
    back, ``drop`` deletes one that nothing reads any more. What is left when the application
    ends lies under a folder named by the application's id.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        self.root = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark deletes shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


def walk(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` in slices of about ``slice_bytes`` text bytes each.

    ``fn`` maps a record batch to a record batch (or None for no rows). A single longer text is
    a slice of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = part = out = None
        for batch in batches:
            for part in slices(batch, text_col, slice_bytes):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        del batch, part, out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task, perhaps of another stage, would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text_col: str, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < n:
        limit = (ends[lo - 1] if lo else 0) + slice_bytes
        hi = max(lo + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n+1 offsets of its rows in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def words_of(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space: ids in order, the distinct words, words per row."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    lists = lists.cast(pa.large_list(pa.large_string()))
    flat = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    if "" in names:  # stands before leading and after trailing white space
        void = names.index("")
        keep = ids != void
        ids, rows = ids[keep], rows[keep]
        ids = ids - (ids > void)
        names.pop(void)
    return ids, names, np.bincount(rows, minlength=len(lists)).astype(np.int64)


def crc32_mod(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def sample_by_hash(df: DataFrame, id_col: str, bound: int, *more: str) -> DataFrame:
    """At most ``bound`` rows that differ in the id and the ``more`` columns, the same ones on every run: those with the smallest hashes.

    Rows alike in these columns count once, so a text of very many copies takes the place of one row.
    The result is empty only where ``df`` is.
    """
    keys = [id_col, *more]
    hashed = F.pmod(F.xxhash64(F.lit(17), *(F.col(c) for c in keys)), F.lit(1 << 62))
    count, most = df.count(), 1 << 62
    if count <= bound:
        return df.dropDuplicates(keys)
    share = (most // count) * bound
    while True:
        # only as many hashes as are looked for come to the driver, eight bytes each
        least = df.where(hashed < share).select(hashed.alias("h")).distinct().orderBy("h").limit(bound).collect()
        if len(least) >= min(bound, 64) or share >= most:
            break
        share = min(most, share * 8)
    return df.where(hashed <= (least[-1].h if least else -1)).dropDuplicates(keys)
