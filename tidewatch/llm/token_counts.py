"""Token counts for a SentencePiece BPE model, by a two-tier map-side lookup.

A pre-token is a run of spaces and what follows up to the next space. No piece of the model goes
on past a space after a non-space (checked when the model is loaded), and merges are local, so a
text has as many tokens as its pre-tokens have together. Tier one is a compact table of frequent
pre-tokens and their lengths, made from a bounded sample of texts of all partitions and broadcast;
a worker reads it as it is and never changes it. Tier two, asked for what the table lacks, is each
worker's own cache, filled by encoding. Nothing is shuffled. The sample only decides what is looked up
where; it has no part in the counts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_of, walk

MODEL = "piece_bpe_32k.model"
#: Texts sampled for the broadcast table (as many on average) and their greatest size, its entries, the longest entry, and entries of a worker's cache.
SAMPLE_ROWS, SAMPLE_BYTES, TABLE_ENTRIES, ENTRY_CHARS, CACHE_ENTRIES = 1000, 1 << 16, 1 << 15, 40, 1 << 19
_SPACE = "▁"  # the model's own mark of a space
_PRE_TOKENS = re.compile(" *[^ ]+| +").findall


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a non-empty text; the model puts one space before the text."""
    return _PRE_TOKENS(" " + text.replace(_SPACE, " "))


class Lengths(dict):
    """Worker's cache, pre-token -> number of tokens: encodes and keeps what is missing. ``known`` is the table that is asked first."""

    def __init__(self, model_path: str, known: dict[str, int] | None = None):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.known, self.limit = known or {}, CACHE_ENTRIES
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("the model has pieces that go on past a space; its texts can't be cut there")
        self.lone = len(self.model.encode(" ")) - 1 or 1  # a space at the end, without what follows

    def __missing__(self, pre_token: str) -> int:
        # encode() puts the first space back
        n = len(self.model.encode(pre_token[1:], num_threads=1)) if len(pre_token) > 1 else self.lone
        if len(self) >= self.limit:
            self.clear()
        if len(pre_token) <= 256:
            self[pre_token] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = pre_tokens(text)
        found = list(map(self.known.get, parts))
        if None not in found:
            return sum(found)
        return sum(self[p] if n is None else n for p, n in zip(parts, found, strict=True))


_WORKER: dict = {}


def frequent(texts: DataFrame, model_path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table: the pre-tokens end to end, where each ends, and their numbers of tokens.

    From about ``SAMPLE_ROWS`` texts of ``SAMPLE_BYTES`` at most each, drawn alike from all partitions.
    """
    seen: Counter = Counter()
    share = min(1.0, SAMPLE_ROWS / max(texts.count(), 1))
    short = texts.where((F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES))
    for row in short.sample(share, seed=17).collect():
        seen.update(p for p in pre_tokens(row.text) if len(p) <= ENTRY_CHARS)
    names = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]
    lengths = Lengths(model_path)
    ends = np.cumsum([len(p) for p in names], dtype=np.int64) if names else np.zeros(0, np.int64)
    return "".join(names).encode(), ends.astype(np.uint32), np.array([lengths[p] for p in names], np.uint16)


def opened(packed: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, ends, sizes = packed
    text, stops = blob.decode(), ends.tolist()
    return {text[a:b]: n for a, b, n in zip([0, *stops], stops, sizes.tolist(), strict=False)}


def token_counts(docs: DataFrame, text_col: str = "text", model_path: str | None = None, keep: list[str] | None = None, out: str = "n_tokens") -> DataFrame:
    """``keep`` columns of each row plus the token count ``out`` of the whole text.

    Without begin, end or special tokens; special strings inside a text are ordinary text, as is
    the library's default. Null and empty texts have 0 tokens. A text of any length is counted
    whole. Row for row; an empty table gives no rows.
    """
    path = model_path or public_tokenizers.path(MODEL)
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(frequent(texts, path))
    keep, made = keep or [], uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if _WORKER.get("id") != made:
            _WORKER.clear()
            _WORKER.update(id=made, lengths=Lengths(path, opened(shared.value)))
        count = _WORKER["lengths"].count
        counts = [count(t) for t in texts_of(batch.column(0))]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names)

    picked = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    names = [f"k{i}" for i in range(len(keep))] + ["n"]
    schema = T.StructType([*picked.schema.fields[1:], T.StructField("n", T.LongType())])
    counted = walk(picked, run, schema)
    return counted.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("n").alias(out))


def query(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(docs, keep=["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)


QUERIES = {"op3_token_counts": query}
SQL: dict[str, str] = {}
