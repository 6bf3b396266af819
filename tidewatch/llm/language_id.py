"""Language identification of mixed text: script ranges, word scores, Viterbi with a switching penalty.

A word's script leaves as candidates the languages that are written in it, and only these are scored:
by the word's frequency in the language or, for unknown words, by its character trigrams. The
best labelling of a text's words, where every change of language costs ``SWITCH``, cuts the text
into spans of one language; the text's language is the one with most letters in its spans.

The model is fitted on a bounded sample of labelled texts (``SAMPLE_ROWS``) with all their languages
and all their words that stand there ``LEAST`` times. Words x languages numbers are held for a slice of
texts at a time, which is the smaller the more languages there are; a longer text goes through in
blocks, forward once for the values at their starts and once more from the last block back.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc32_mod, sample_by_hash, slices, table, texts_of, walk, words_of
from .quality import class_table

#: Labelled texts of the sample, occurrences in it that make a word known, slots of trigrams.
SAMPLE_ROWS, LEAST, TRIGRAMS = 20_000, 5, 1 << 15
#: Words times languages that are scored at once.
CELLS = 1 << 23
#: Cost of a change of language; greatest disadvantage of a language in one word; one of another script. In nats.
SWITCH, WORST, FOREIGN = 9.0, 7.0, 14.0
#: Share of a language's words from which on a script is one of its scripts.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# First code points of script ranges, and the script that starts there (Unicode, fixed values; "" is no single script).
_RANGES = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""), (0x00BA, "latin"), (0x00BB, ""), (0x00C0, "latin"), (0x02B9, ""),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, ""), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""), (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, ""),
    (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, ""), (0xA720, "latin"), (0xA800, ""), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"), (0x32000, ""),
]
_STARTS = [a for a, _ in _RANGES]
_NAMES = sorted({s for _, s in _RANGES})  # "" comes first
_KINDS = np.array([_NAMES.index(s) for _, s in _RANGES])


def script_of(word: str) -> str:
    """The script of most letters of a word; "" without letters of a known script."""
    seen = Counter(_RANGES[bisect_right(_STARTS, ord(c)) - 1][1] for c in word if c.isalpha())
    del seen[""]
    return max(sorted(seen), key=seen.__getitem__) if seen else ""


def letters(word: str) -> str:
    """A word in lower case, from its first to its last letter; empty without one."""
    word = word.lower()
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between marks of start (2) and end (3), and where each begins."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    return points, np.cumsum(sizes) - sizes


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character trigrams of non-empty words, and where each word's begin."""
    points, begin = _points(words)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    slots = (h >> np.uint64(40)).astype(np.int64) % TRIGRAMS
    inner = np.ones(len(slots), bool)  # not those over a border between words
    border = begin[1:]
    inner[border - 1] = inner[border - 2] = False
    first = begin - 2 * np.arange(len(words))
    return slots[inner], first


def _partial(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task, counted as they come and passed on when there are many."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        merged: Counter = Counter()
        for lang, c in counts.items():
            for w, n in c.items():
                if w := letters(w.decode()):
                    merged[lang, w] += n
        counts.clear()
        if merged:
            langs, words = zip(*merged, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(merged.values(), pa.int64(), size=len(merged))], ["lang", "word", "n"])

    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            for lang, text in zip(batch.column(1).to_pylist(), texts_of(batch.column(0)), strict=True):
                counts[lang].update(text.encode().split())
            if sum(map(len, counts.values())) > most:
                yield from flush()
    yield from flush()


def _spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, value) from (lang, word, n): trigrams by the root of n, as a frequent word says less about spelling, and scripts (slots below 0) by n."""
    for batch in batches:
        langs, words, n = batch.column(0).dictionary_encode(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        if not words:
            continue
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        slots, first = trigrams(words)
        per = np.diff(np.append(first, len(slots)))
        span = TRIGRAMS + len(_NAMES)
        keys = np.concatenate([np.repeat(lang, per) * span + len(_NAMES) + slots, lang * span + np.array([_NAMES.index(script_of(w)) for w in words])])
        sums = np.bincount(keys, weights=np.concatenate([np.repeat(np.sqrt(n), per), n]))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(at // span)), pa.array((at % span - len(_NAMES)).astype(np.int32)), pa.array(sums[at])], ["lang", "slot", "value"])


class Model:
    """Word and trigram scores by language; ``score`` gives a word's vector. Known words are held sparsely."""

    def __init__(self, langs: list[str], known: dict[str, dict[int, float]], floor: np.ndarray, grams: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs, self.floor, self.grams = langs, floor.astype(np.float32), grams.astype(np.float32)
        self.known = {w: k for k, w in enumerate(known)}
        self.ends = np.cumsum([0, *map(len, known.values())])
        self.at = np.array([k for x in known.values() for k in x], np.int64)
        self.values = np.array([v for x in known.values() for v in x.values()], np.float32)
        self.written = np.array([scripts.get(s, np.zeros(len(langs), bool)) for s in _NAMES])

    def _frequencies(self, rows: np.ndarray) -> np.ndarray:
        """(words, languages) of known words."""
        out = np.repeat(self.floor[None, :], len(rows), axis=0)
        per = self.ends[rows + 1] - self.ends[rows]
        place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.ends[rows], per)
        out[np.repeat(np.arange(len(rows)), per), self.at[place]] = self.values[place]
        return out

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) nats, 0 for the best and everywhere for a word without a letter; letters of each word."""
        n, width = len(words), len(self.langs)
        cores = [letters(w) for w in words]
        out, weights = np.zeros((n, width), np.float32), np.zeros(n, np.int64)
        some = np.array([k for k, c in enumerate(cores) if c], np.int64)
        if not len(some):
            return out, weights
        lettered = [c for c in cores if c]
        points, begin = _points(lettered)
        is_letter = class_table()[points] <= 2
        weights[some] = np.add.reduceat(is_letter, begin)
        if not width:
            return out, weights
        kind = np.where(is_letter, _KINDS[np.searchsorted(_STARTS, points, side="right") - 1], 0)
        low, high = np.minimum.reduceat(np.where(kind > 0, kind, len(_NAMES)), begin), np.maximum.reduceat(kind, begin)
        for k in np.flatnonzero((low != high) & (high > 0)):  # letters of several scripts
            high[k] = _NAMES.index(script_of(lettered[k]))
        at = np.array([self.known.get(c, -1) for c in lettered], np.int64)
        for script in np.unique(high):
            group = np.flatnonzero(high == script)
            candidates = np.flatnonzero(self.written[script])
            if not len(candidates):
                candidates = np.arange(width)
            if len(candidates) < width:
                out[some[group]] = -FOREIGN
            if len(candidates) == 1:  # nothing to tell apart
                out[some[group], candidates[0]] = 0
                continue
            listed = at[group] >= 0
            own = np.empty((len(group), len(candidates)), np.float32)
            if listed.any():
                own[listed] = self._frequencies(at[group[listed]])[:, candidates]
            if not listed.all():
                slots, first = trigrams([lettered[k] for k in group[~listed]])
                own[~listed] = np.add.reduceat(self.grams[slots][:, candidates], first, axis=0)
            out[np.ix_(some[group], candidates)] = np.maximum(own - own.max(axis=1, keepdims=True), -WORST)
        return out, weights


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled texts of a bounded sample by hash of the id and the text."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = sample_by_hash(labelled, "id", sample_rows, "text").where(F.col("text").isNotNull()).select("text", "lang")
    counts = sample.mapInArrow(_partial, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "language").write(counts, "counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language of the sample
    langs = sorted(totals)
    index = {x: k for k, x in enumerate(langs)}
    # words of the sample that stand in it LEAST times
    words = counts.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("word", "by").toPandas()
    spelled = counts.mapInArrow(_spelling, "lang string, slot int, value double").groupBy("lang", "slot").agg(F.sum("value").alias("value")).toPandas()
    total = np.array([totals[x] for x in langs], float)
    grams, written = np.zeros((TRIGRAMS, len(langs))), np.zeros((len(_NAMES), len(langs)))
    if len(spelled):
        slot, lang = spelled["slot"].to_numpy(), spelled["lang"].map(index).to_numpy()
        above = slot >= 0
        grams[slot[above], lang[above]] = spelled["value"].to_numpy()[above]
        written[slot[~above] + len(_NAMES), lang[~above]] = spelled["value"].to_numpy()[~above]
    grams = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * TRIGRAMS)) if langs else grams
    known = {w: {index[x["lang"]]: float(np.log((x["n"] + 0.2) / (totals[x["lang"]] + 1))) for x in by} for w, by in sorted(zip(words["word"], words["by"], strict=True), key=lambda x: x[0])}
    return Model(langs, known, np.log(0.2 / (total + 1)), grams, {s: c >= SCRIPT_SHARE * total for s, c in zip(_NAMES, written, strict=True) if s and c.any()})


def viterbi(scores: np.ndarray, per: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; ``scores`` (words, labels) of texts end to end, ``per`` words each.

    All texts go forward in step, longest first, so the work of one step covers every text that is
    still as long.
    """
    total, k = scores.shape
    out = np.zeros(total, np.int64)
    if not total or k < 2:
        return out
    order = np.argsort(-per, kind="stable")
    order = order[per[order] > 0]
    lengths = per[order]
    steps = int(lengths[0])
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")  # texts longer than t
    first = np.concatenate([[0], np.cumsum(active)])
    begin = (np.cumsum(per) - per)[order]
    rank = np.repeat(np.arange(len(order)), lengths)
    t = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place, source = first[t] + rank, np.repeat(begin, lengths) + t
    by_step = np.empty_like(scores)
    by_step[place] = scores[source]
    stays, best = np.empty((total, k), bool), np.empty(total, np.int16)
    value = by_step[: first[1]].copy()
    for s in range(1, steps):
        a, b = first[s], first[s + 1]
        value = value[: b - a]
        top = value.argmax(axis=1)
        jump = value[np.arange(b - a), top][:, None] - switch
        np.greater_equal(value, jump, out=stays[a:b])
        best[a:b] = top
        value = np.maximum(value, jump) + by_step[a:b]
        value -= value.max(axis=1, keepdims=True)
        by_step[a:b] = value  # the last one of each text is read below
    labels = np.empty(total, np.int64)
    state = np.empty(0, np.int64)
    for s in range(steps - 1, -1, -1):
        a, b = first[s], first[s + 1]
        n = len(state)
        now = np.empty(b - a, np.int64)
        if n:  # texts that go on after this step
            u, v = first[s + 1], first[s + 1] + n
            now[:n] = np.where(stays[u:v][np.arange(n), state], state, best[u:v])
        if b - a > n:
            now[n:] = by_step[a + n : b].argmax(axis=1)
        labels[a:b] = state = now
    out[source] = labels[place]
    return out


def _steps(value: np.ndarray | None, scores: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values after the words of ``scores`` from those before, whether each label stays, and the best before each word."""
    stays, best = np.ones(scores.shape, bool), np.zeros(len(scores), np.int64)
    for t in range(len(scores)):
        if value is None:
            value = scores[t].copy()
            continue
        best[t] = value.argmax()
        jump = value[best[t]] - switch
        stays[t] = value >= jump
        value = np.maximum(value, jump) + scores[t]
        value -= value.max()
    return value, stays, best


def long_labels(model: Model, ids: np.ndarray, names: list[str], switch: float = SWITCH, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Labels and letters of a long text's words as ``viterbi`` gives them, holding one block of it at a time."""

    def scores(first: int) -> tuple[np.ndarray, np.ndarray]:
        distinct, at = np.unique(ids[first : first + block], return_inverse=True)
        vectors, weights = model.score([names[k] for k in distinct])
        return vectors[at], weights[at]

    starts, values, weights, value = range(0, len(ids), block), [], [], None
    for first in starts:
        values.append(value)
        own, letters_of = scores(first)
        weights.append(letters_of)
        value = _steps(value, own, switch)[0]
    labels, state = np.empty(len(ids), np.int64), int(value.argmax())
    for first, value in zip(reversed(starts), reversed(values), strict=True):
        _, stays, best = _steps(value, scores(first)[0], switch)
        for t in range(len(best) - 1, -1, -1):
            labels[first + t] = state
            if not stays[t, state]:
                state = best[t]
    return labels, np.concatenate(weights)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, spans: bool = False, switch: float = SWITCH) -> DataFrame:
    """Row for row: the id, the ``keep`` columns, lang_pred, score, n_spans.

    ``score`` is the share of letters in spans of the predicted language. Without a letter (null
    and empty texts too) or without any learned language it is ``und`` at 0. With ``spans`` there
    is an array of (first word, words, lang) besides. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or [] if c != id_col]
    back = text_col in keep  # the text goes to Python once, also where it comes back
    cols = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep) if c != text_col))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())]
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("lang", T.StringType())])
    made += [T.StructField("spans", T.ArrayType(span))] if spans else []
    schema = T.StructType([*cols.schema.fields[1:], *([T.StructField("text", T.StringType())] if back else []), *made])
    # a word has about four bytes at least
    slice_bytes = min(4 << 20, max(1 << 16, 4 * CELLS // max(len(model.langs), 1)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        langs, n = own.langs, batch.num_rows
        ids, names, per = words_of(batch.column(0))
        width = len(langs)
        row = np.repeat(np.arange(n), per)
        if len(ids) * max(width, 1) > 2 * CELLS:
            labels, letters_of = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for a, b in zip(np.cumsum(per) - per, np.cumsum(per), strict=True):
                if a < b:
                    labels[a:b], letters_of[a:b] = long_labels(own, ids[a:b], names, switch, max(1, CELLS // max(width, 1)))
        else:
            vectors, weights = own.score(names)
            letters_of = weights[ids] if len(ids) else np.zeros(0, np.int64)
            labels = viterbi(vectors[ids], per, switch) if width else np.zeros(len(ids), np.int64)
        by = np.bincount(row * max(width, 1) + labels, weights=letters_of, minlength=n * max(width, 1)).reshape(n, -1)
        total, best = by.sum(axis=1), by.argmax(axis=1)
        some = (total > 0) & (width > 0)
        heads = np.ones(len(ids), bool)
        heads[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
        pred = [langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        score = np.where(some, by[np.arange(n), best] / np.maximum(total, 1), 0.0)
        out = [pa.array(pred, pa.string()), pa.array(score), pa.array(np.bincount(row[heads], minlength=n) * (width > 0))]
        if spans:
            at = np.flatnonzero(heads) if width else np.zeros(0, np.int64)
            size = np.diff(np.append(at, len(ids))) if len(at) else at
            start = (np.cumsum(per) - per)[row[at]]
            rows = [[] for _ in range(n)]
            for r, a, m, k in zip(row[at].tolist(), (at - start).tolist(), size.tolist(), labels[at].tolist(), strict=True):
                rows[r].append({"first": a, "words": m, "lang": langs[k]})
            out.append(pa.array(rows, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *([batch.column(0)] if back else []), *out], schema.names)

    done = walk(cols, run, schema, slice_bytes=slice_bytes)
    kept = [F.col("text" if c == text_col else f"k{i}").alias(c) for i, c in enumerate(keep)]
    return done.select(F.col("id").alias(id_col), *kept, *(f.name for f in made))


def learned(docs: DataFrame) -> Model:
    """The model of the rows that aren't held out."""
    return fit(docs.where(crc32_mod("doc_id", 4) != 2))


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language for at least ``least`` of its letters, with the columns of ``docs``; a null lang is filled in."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select(F.struct(*others).alias("row"), "doc_id", "text")
    found = identify(packed, learned(docs), keep=["row", "text"]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    fields = [F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in others]
    return found.select("doc_id", "text", *fields).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", (crc32_mod("doc_id", 4) == 2).alias("held_out"))
    return identify(rows, learned(docs), keep=["held_out"])


QUERIES = {"op1_language_id": query}
SQL: dict[str, str] = {}
