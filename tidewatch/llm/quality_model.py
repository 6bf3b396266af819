"""Quality scores: histogram gradient-boosted trees over statistics of a text.

Labels come from a bounded sample of labelled documents. Their features are cut into at most
``BINS`` bins at quantiles; trees grow level by level on per-bin sums of gradients. The ensemble is
flattened into arrays, through which all texts of a batch go down at once with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, flat_bytes, sample_by_hash, table, texts_of, walk, words_of
from .quality import CLASSES, base_counts, class_counts

#: Labelled documents to learn from, at most about; trees, their depth, learning rate, bins, regularisation.
SAMPLE_ROWS, TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 20_000, 160, 5, 0.1, 64, 1.0, 5.0
FEATURES = ("log_words", "word_chars", "symbols", "dup_lines", "repeats", *CLASSES, "distinct", "line_words", "runs", "plain_ends", "short_words", "upper_words")


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES); shares of a text without words are 0."""
    texts = texts_of(column)
    data, offsets = flat_bytes(column)
    ids, names, per = words_of(column)
    n = len(texts)
    row = np.repeat(np.arange(n), per)
    counts = base_counts(texts, data, offsets, ids, names, per)
    hist = class_counts(data, offsets)
    words, chars = np.maximum(per, 1), np.maximum(hist.sum(axis=1), 1)
    lines = np.array([t.count("\n") + 1 for t in texts])
    pairs = np.unique(np.stack([row, ids]), axis=1)[0] if len(ids) else np.zeros(0, np.int64)
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
    kinds = np.array([(w[-1].isalnum(), len(w) <= 3, w.isupper() and len(w) > 1) for w in names], float).reshape(-1, 3)
    share = [np.bincount(row, weights=kinds[ids, k], minlength=n) / words if len(ids) else np.zeros(n) for k in range(3)]
    return np.column_stack(
        [
            np.log1p(per), counts["word_chars"] / words, counts["n_symbols"] / chars, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words,
            *(hist[:, k] / chars for k in range(len(CLASSES))),
            np.bincount(pairs, minlength=n) / words, np.log1p(per / lines), np.bincount(row[again], minlength=n) / words, *share,
        ]
    )


@dataclass
class Forest:
    """All trees end to end: node k splits at ``feature[k] <= threshold[k]`` into left[k] and right[k]; leaves lead to themselves."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Newton boosting of the logistic loss."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)]) if n else np.zeros((0, width), np.int64)
    mean = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(n, start)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    slots = np.arange(width) * bins
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        level, at = [len(nodes) - 1], np.zeros(n, np.int64)  # at: index in the level, -1 in a leaf
        for d in range(depth + 1):
            inside = at >= 0
            size = len(level)
            gs, hs = (np.bincount(at[inside], weights=v[inside], minlength=size) for v in (g, h))
            for k, node in enumerate(level):
                nodes[node][4] = -rate * gs[k] / (hs[k] + RIDGE)
            if d == depth:
                break
            key = (at[inside][:, None] * width * bins + slots + binned[inside]).ravel()
            sums = [np.bincount(key, weights=np.repeat(v[inside], width), minlength=size * width * bins).reshape(size, width, bins).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = (s[:, :, :-1] for s in sums)
            right_g, right_h = gs[:, None, None] - left_g, hs[:, None, None] - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (gs**2 / (hs + RIDGE))[:, None, None]
            gain = np.where((left_h >= LEAST) & (right_h >= LEAST), gain, 0).reshape(size, -1)
            best, following, new_level = gain.argmax(axis=1), np.full((size, 3), -1), []
            for k, node in enumerate(level):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, best[k]] <= 1e-6 or b >= len(cuts[f]):
                    continue
                nodes[node][:4] = [f, float(cuts[f][b]), len(nodes), len(nodes) + 1]
                following[k] = f, b, len(new_level)
                for _ in range(2):
                    new_level.append(len(nodes))
                    nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            f, b, child = (following[at[inside], k] for k in range(3))
            goes = binned[inside][np.arange(len(f)), np.maximum(f, 0)] > b
            at[inside] = np.where(f >= 0, child + goes, -1)
            level = new_level
            if not level:
                break
        if roots[-1] == len(nodes) - 1:  # no split is worth it any more
            margin = margin + nodes[roots[-1]][4]
        else:
            flat = _flat(start, roots[-1:], nodes, depth)
            margin = margin + _leaf(flat, x)
    return _flat(start, roots, nodes, depth)


def _flat(start: float, roots: list[int], nodes: list[list], depth: int) -> Forest:
    if not roots:
        roots, nodes = [0], [[0, np.inf, 0, 0, 0.0]]
    f, t, left, right, v = zip(*nodes, strict=True)
    return Forest(start, np.array(roots), np.array(f), np.array(t), np.array(left), np.array(right), np.array(v), depth)


def _leaf(tree: Forest, x: np.ndarray) -> np.ndarray:
    at = np.full(len(x), tree.roots[0])
    rows = np.arange(len(x))
    for _ in range(tree.depth):
        at = np.where(x[rows, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
    return tree.value[at]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from a bounded sample of the labels, by hash of the id.

    An id that is labelled more than once counts with its majority, a tie as 1; ids, labels and
    texts that are null don't count; of repeated documents one does.
    """
    votes = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    chosen = sample_by_hash(votes, "id", sample_rows)
    # bounded by sample_rows, so small enough to be sent to every task; the texts stay where they are
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).join(F.broadcast(chosen), "id").select("text", "id", "y")
    schema = T.StructType([texts.schema["id"], T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0))
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = walk(texts, run, schema).groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("id").select("y", "x").collect()  # sample_rows at most
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r.y for r in rows], float))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, limit: float = 0.3) -> DataFrame:
    """Row for row: the id, the ``keep`` columns, score (0 to 1, higher is better) and predicted (1 from ``limit`` on).

    Null is scored as the empty text. Null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    keep = [c for c in keep or [] if c != id_col]
    cols = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    schema = T.StructType([*cols.schema.fields[1:], T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.score(features(batch.column(0))))], schema.names)

    done = walk(cols, run, schema)
    return done.select(F.col("id").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = fit(docs, labels.where(crc32_mod("doc_id", 5) != 0))
    return score(docs.select("doc_id", "text", (crc32_mod("doc_id", 5) == 0).alias("held_out")), forest, keep=["held_out"])


QUERIES = {"op4_quality_model": query}
SQL: dict[str, str] = {}
