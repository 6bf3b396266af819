"""Vector table: embedding, upsert, filtered cosine top-k, facets, citations."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

REFUSAL = "Not supported by available sources."
CONTEXT_CHARS = 14_000
#: Scores of a pair of blocks that a worker holds at once.
SCORES = 1 << 17
_SPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "chunks.tidewatch.invalid")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Word counts by hash; the same for the same words everywhere. It knows no meaning: a stand-in for tests and dry runs."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                out[k, int.from_bytes(hashlib.sha1(word.encode()).digest()[:4], "big") % self.dim] += 1
        return out


def embedded(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Adds each text's vector, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([t or "" for t in texts])))

    return df.withColumn(out, vector(F.col(text_col)))


@F.pandas_udf(T.StringType())
def point_id(chunk_ids: pd.Series) -> pd.Series:
    """The same id for the same chunk, whenever it is written."""
    return chunk_ids.map(lambda c: None if c is None else str(uuid.uuid5(_SPACE, c)))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", version: str = "ingested_at") -> DataFrame:
    """Rows by key; new ones replace old ones, the latest of several new ones counts."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(version)))).where("_n = 1").drop("_n")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if either has no length."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = d(a), d(b)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def payload_filter(filters: dict | None, columns: dict[str, str]) -> Column:
    """Scalars equal, lists any-of, None nothing; values as text; all keys together. ``columns``: name to type name."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        if value is None:
            continue
        values = [str(v) for v in (value if isinstance(value, list | tuple | set) else [value])]
        if columns.get(key, "string").startswith("array"):
            out = out & F.arrays_overlap(F.transform(F.col(key), lambda v: v.cast("string")), F.array(*(F.lit(v) for v in values)))
        else:
            out = out & F.col(key).cast("string").isin(values)
    return out


def top_k(vectors: DataFrame, query: list[float], k: int = 8, filters: dict | None = None, min_score: float | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k best by cosine, after the filters and at or above the floor; ties by id. Each task keeps k rows."""
    score = cosine(F.col(vector_col), F.array(*(F.lit(float(v)) for v in query)))
    rows = vectors.where(payload_filter(filters, dict(vectors.dtypes))).withColumn("score", score)
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows.orderBy(F.desc_nulls_last("score"), id_col).limit(k)


def top_k_batch(vectors: DataFrame, queries: np.ndarray, query_ids: list, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best for each of a stated set of queries, by blocks of rows against all queries; each block passes on k per query."""
    q = np.asarray(queries, np.float64)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

    def run(frames):
        for f in frames:
            f = f[f["v"].notna()]
            if f.empty:
                continue
            x = np.stack(f["v"].to_numpy()).astype(np.float64)
            s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ q.T
            ids = f["id"].to_numpy()
            for j, name in enumerate(query_ids):
                best = np.lexsort((ids, -s[:, j]))[:k]
                yield pd.DataFrame({"query_id": name, "id": ids[best], "score": s[best, j]})

    found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def _packed(df: DataFrame, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """(ids, x): vectors of unit length as matrices of ``rows`` rows at most, task by task; null vectors are left out."""
    cols = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    kind = cols.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def matrix() -> pa.RecordBatch:
            x = np.stack(parts[:rows])
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return pa.RecordBatch.from_arrays([pa.array([ids[:rows]], to_arrow_schema(schema).types[0]), pa.array([unit.tobytes()], pa.binary())], names=schema.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):  # a matrix' rows as Python objects at most
                part = batch.slice(lo, rows)
                ids += part.column(0).to_pylist()
                parts += [np.array(v, np.float64) for v in part.column(1).to_pylist()]
                while len(ids) >= rows:
                    yield matrix()
                    ids, parts = ids[rows:], parts[rows:]
        if ids:
            yield matrix()

    return cols.mapInArrow(run, schema)


def top_k_join(vectors: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "vec_id", query_rows: int = 512, vector_rows: int = 4096) -> DataFrame:
    """(query_id, id_col, score, rank): the k best of ``vectors`` for each of ``queries`` by cosine, ties by id.

    Both sides are packed into blocks; each pair of blocks is one product of matrices, of which k rows a query go on, and
    those are merged by query. Neither side passes through the driver. A worker holds ``SCORES`` scores
    at once beside its Arrow batch, whatever the tables' sizes. Null vectors are left out, zero vectors score 0.
    """
    asked = _packed(queries, query_id, vector_col, query_rows).select(F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    pairs = _packed(vectors, id_col, vector_col, vector_rows).crossJoin(asked)  # of blocks: a stated set of queries against all rows
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    kinds = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, q_ids, q = (c[row].as_py() for c in batch.columns)
                wanted, rows = np.frombuffer(q).reshape(len(q_ids), -1), np.frombuffer(x).reshape(len(ids), -1)
                names = np.array(ids)
                order = np.argsort(names, kind="stable")  # ties by id
                step, kept, best = max(1, SCORES // len(ids)), [], []
                for lo in range(0, len(q_ids), step):
                    s = (wanted[lo : lo + step] @ rows.T)[:, order]
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    kept.append(order[top])
                    best.append(np.take_along_axis(s, top, axis=1))
                at, best = np.concatenate(kept), np.concatenate(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(q_ids, object), at.shape[1]).tolist(), kinds[0]), pa.array(names[at].ravel().tolist(), kinds[1]), pa.array(best.ravel())], names=schema.names)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return pairs.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def facets(df: DataFrame, key: str) -> DataFrame:
    """(value, n), most first; each value of a list counts, nulls don't."""
    value = F.explode(key) if dict(df.dtypes)[key].startswith("array") else F.col(key)
    return df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def context(chunks: DataFrame, *by: str, order: str = "rank", budget: int = CONTEXT_CHARS) -> DataFrame:
    """The chunks that fit, in order, as labelled blocks; from the first that doesn't fit on none is taken."""
    block = F.format_string("[%s] (%s) %s\n%s", F.col("chunk_id"), F.col("classification"), F.coalesce("title", F.substring_index("chunk_id", "#", 1)), F.col("text"))
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(running)).where(F.col("used") <= budget)


def verify_claims(claims: DataFrame, retrieved: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(claims with the citations that were retrieved, dropped citations).

    ``claims`` has ``by``, claim_no, text, chunk_ids; ``retrieved`` has ``by`` and chunk_id. A claim
    without text or without a citation left goes; citations keep their order, each once.
    """
    keys = [*by, "claim_no"]
    named = claims.where(F.length(F.trim("text")) > 0).select(*keys, F.trim("text").alias("text"), F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    known = retrieved.select(*by, "chunk_id").distinct().withColumn("known", F.lit(True))
    checked = named.join(known, [*by, "chunk_id"], "left")
    cited = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]))
    kept = checked.where("known").groupBy(*keys, "text").agg(cited.alias("chunk_ids"))
    dropped = checked.where("known IS NULL").select(*by, "chunk_id").distinct()
    return kept, dropped


def answered(claims: DataFrame, asked: DataFrame, *by: str) -> DataFrame:
    """Per question (``asked``: ``by``, supported): answered if it says so and a claim is left; else the refusal."""
    left = claims.select(*by).distinct().withColumn("_left", F.lit(True))
    ok = F.coalesce("supported", F.lit(False)) & F.coalesce("_left", F.lit(False))
    return asked.join(left, list(by), "left").withColumn("answered", ok).withColumn("refusal", F.when(~F.col("answered"), REFUSAL)).drop("_left", "supported")
