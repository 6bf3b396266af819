"""Quality rules: base counts, then divergence from language references.

The references are gathered from every document that has a language: how its characters spread
over classes, and its common words, those with a share of ``COMMON_SHARE`` or more, with their
shares. A first pass over all texts finds candidates: what each slice leaves out has less than a
quarter of that share in it, so a common word comes to three quarters of it at least in what is
left, and there can't be many such. A second pass counts them exactly. A document is compared to each
reference by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of both
histograms; it has to be near one language in both at once. A short text says little: the
character test needs ``MIN_CHARS`` characters, the word test ``MIN_WORDS`` words, and below these
the test counts as passed. Above, a limit is ``base + slack / sqrt(n)`` for n characters or words,
as a small sample lies far from any reference by chance alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, Scratch, flat_bytes, slices, table, texts_of, walk, words_of

CLASSES = ("lower", "upper", "letter", "mark", "digit", "space", "stop", "symbol", "other")
#: Share of a language's words that makes a word common.
COMMON_SHARE = 0.001
#: Guards, and (base, slack) of the greatest distances to the nearest reference.
MIN_CHARS, MIN_WORDS, CHAR_LIMIT, WORD_LIMIT = 200, 50, (0.14, 1.3), (0.20, 2.7)
_SYMBOLS = b"#*$%&|<>"
_BLANKS = " \t\n\r\x0b\f"


@cache
def class_table() -> np.ndarray:
    """Code point -> index in CLASSES."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 3, "Mc": 3, "Me": 3, "Nd": 4, "Nl": 4, "No": 4, "Zs": 5, "Zl": 5, "Zp": 5}
    out = np.array([kinds.get(unicodedata.category(chr(c)), 8) for c in range(0x110000)], np.uint8)
    for c in range(0x110000):
        if out[c] == 8:
            kind = unicodedata.category(chr(c))
            out[c] = 6 if kind[0] == "P" else 7 if kind[0] == "S" else 8
    out[[ord(c) for c in _BLANKS]] = 5
    out[list(_SYMBOLS)] = 7
    return out


def core(word: str) -> str:
    """A word in lower case without what isn't a letter or digit at its ends."""
    word = word.lower()
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class for each text of a slice."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(n), np.diff(chars))
    return np.bincount(row * len(CLASSES) + class_table()[points], minlength=n * len(CLASSES)).reshape(n, -1)


def repeated_words(ids: np.ndarray, per: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text, its words in windows of ``width`` words that stand twice or more in it."""
    n, total = len(per), len(ids)
    if total < width:
        return np.zeros(n, np.int64)
    ends = np.cumsum(per)
    row = np.repeat(np.arange(n), per)
    at = np.flatnonzero(np.arange(total) + width <= ends[row])
    if not len(at):
        return np.zeros(n, np.int64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        h = h * np.uint64(0x2545F4914F6CDD1D) + x[at + k]
    order = np.argsort(h, kind="stable")
    a, b = at[order][:-1], at[order][1:]
    same = np.flatnonzero((h[order][1:] == h[order][:-1]) & (row[a] == row[b]))
    a, b = a[same], b[same]
    for k in range(width):  # the hash only brings windows together
        equal = ids[a + k] == ids[b + k]
        a, b = a[equal], b[equal]
    edges = np.zeros(total + 1, np.int64)
    both = np.unique(np.concatenate([a, b]))
    np.add.at(edges, both, 1)
    np.add.at(edges, both + width, -1)
    return np.bincount(row, weights=np.cumsum(edges[:-1]) > 0, minlength=n).astype(np.int64)


def base_counts(texts: list[str], data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, names: list[str], per: np.ndarray) -> dict[str, np.ndarray]:
    n = len(texts)
    row = np.repeat(np.arange(n), per)
    lengths = np.array([len(w) for w in names], np.int64)
    is_symbol = np.zeros(256, np.int64)
    is_symbol[list(_SYMBOLS)] = 1
    symbols = np.concatenate([[0], np.cumsum(is_symbol[data])])[offsets]
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(_BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": per,
        "word_chars": np.bincount(row, weights=lengths[ids] if len(ids) else None, minlength=n).astype(np.int64),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeated_words(ids, per),
    }


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[str]]]:
    """(lang, class counts, counts of words by number, words) of the languages in a slice of (text, lang)."""
    langs = batch.column(1).to_pylist()
    data, offsets = flat_bytes(batch.column(0))
    ids, names, per = words_of(batch.column(0))
    known = sorted(set(langs))
    code = {x: k for k, x in enumerate(known)}
    lang = np.array([code[x] for x in langs])
    hist, of = class_counts(data, offsets), np.repeat(lang, per)
    numbers: dict[str, int] = {}
    core_of = np.array([numbers.setdefault(core(w), len(numbers)) for w in names], np.int64)
    word, listed = core_of[ids], list(numbers)
    for x, k in code.items():
        n = np.bincount(word[of == k], minlength=len(listed))
        if "" in numbers:  # words of signs only
            n[numbers[""]] = 0
        yield x, hist[lang == k].sum(axis=0), n, listed


def _counted(rows: list) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "name", "n"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, name, n) of each slice: kind 0 character classes, 1 its more frequent words, 2 all words."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            rows = []
            for lang, classes, n, names in _by_language(batch):
                total = int(n.sum())
                rows += [(lang, 0, CLASSES[k], int(c)) for k, c in enumerate(classes) if c]
                rows += [(lang, 1, names[k], int(n[k])) for k in np.flatnonzero((n > 0) & (n * 4 >= COMMON_SHARE * total))]
                rows.append((lang, 2, "", total))
            yield from _counted(rows)


def _exact(words: dict[str, dict[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {x: np.zeros(len(w), np.int64) for x, w in words.items()}
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                for lang, _, n, names in _by_language(batch):
                    if own := words.get(lang):
                        at = np.array([own.get(x, -1) for x in names], np.int64)
                        np.add.at(sums[lang], at[at >= 0], n[at >= 0])
        yield from _counted([(x, 1, w, int(sums[x][k])) for x, own in words.items() for w, k in own.items() if sums[x][k]])

    return run


class References:
    """``classes`` of each language, and for each word that is common in some language these languages and its shares in them."""

    def __init__(self, langs: list[str], classes: np.ndarray, words: list[list[str]], shares: list[np.ndarray]):
        self.langs, self.classes = langs, classes
        by: dict[str, list[tuple[int, float]]] = {}
        for k, (own, share) in enumerate(zip(words, shares, strict=True)):
            for w, q in zip(own, share, strict=False):
                by.setdefault(w, []).append((k, float(q)))
        self.index = {w: n for n, w in enumerate(by)}
        self.ends = np.cumsum([0, *map(len, by.values())])
        self.lang = np.array([k for x in by.values() for k, _ in x], np.int64)
        self.share = np.array([q for x in by.values() for _, q in x])
        self.rest = np.array([x[-1] for x in shares])
        #: entropy term of all of a language's common words
        self.whole = np.array([_entropy(x[:-1]) for x in shares]) if shares else np.zeros(0)


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> References:
    """Histograms of each language over all documents that have one; of a bounded size."""
    texts = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shape, key = "lang string, kind int, name string, n long", ["lang", "kind", "name"]
    scratch = Scratch(docs.sparkSession, "references")
    found = scratch.write(texts.mapInArrow(_candidates, shape).groupBy(*key).agg(F.sum("n").alias("n")), "found")
    totals = found.where("kind = 2").select("lang", F.col("n").alias("total"))  # a row a language
    # for each language its classes, its total, and words with 3/4 of the share: a bounded number
    frequent = found.where("kind = 1").join(totals, "lang").where(F.col("n") >= 0.75 * COMMON_SHARE * F.col("total")).select(*found.columns)
    rows = found.where("kind <> 1").union(frequent).collect()
    scratch.drop("found")
    words_in = {r.lang: r.n for r in rows if r.kind == 2 and r.n}
    langs = sorted(words_in)
    at = {x: k for k, x in enumerate(langs)}
    named: dict[str, list[str]] = {x: [] for x in langs}
    classes = np.zeros((len(langs), len(CLASSES)))
    for r in rows:
        if r.lang in at and r.kind == 1:
            named[r.lang].append(r.name)
        elif r.lang in at and r.kind == 0:
            classes[at[r.lang], CLASSES.index(r.name)] = r.n
    maybe = {x: {w: k for k, w in enumerate(sorted(w))} for x, w in named.items()}
    counts = texts.mapInArrow(_exact(maybe), shape).groupBy(*key).agg(F.sum("n").alias("n")).collect() if langs else []
    common: dict[str, list] = {x: [] for x in langs}
    for r in sorted(counts, key=lambda r: r.name):
        if r.n >= COMMON_SHARE * words_in[r.lang]:
            common[r.lang].append((r.name, r.n / words_in[r.lang]))
    shares = [np.array([s for _, s in common[x]] + [max(0.0, 1 - sum(s for _, s in common[x]))]) for x in langs]
    return References(langs, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), [[w for w, _ in common[x]] for x in langs], shares)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, along the last axis."""
    divergence = _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2
    return np.sqrt(np.maximum(divergence, 0))


def distances(refs: References, hist: np.ndarray, ids: np.ndarray, names: list[str], per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) distances of characters and of words; a text without any is at 0."""
    n = len(per)
    row = np.repeat(np.arange(n), per)
    share = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    chars = np.zeros((n, len(refs.langs)))
    some = hist.sum(axis=1) > 0
    for k in range(len(refs.langs)):
        chars[:, k] = np.where(some, js_distance(share, refs.classes[k]), 0)
    cores = [core(w) for w in names]
    blank = np.array([not c for c in cores], bool)  # words of signs only aren't words here
    counted = ~blank[ids] if len(ids) else np.zeros(0, bool)
    total = np.maximum(np.bincount(row[counted], minlength=n), 1)
    # (text, common word) pairs with their counts, then each with the languages in which the word is common
    listed = np.array([refs.index.get(c, -1) for c in cores], np.int64)
    of = listed[ids] if len(ids) else np.zeros(0, np.int64)
    size = max(len(refs.index), 1)
    pairs = row[of >= 0] * size + of[of >= 0]
    if n * size <= 1 << 22:  # a table of all pairs is quicker than sorting
        table = np.bincount(pairs, minlength=n * size)
        pairs = np.flatnonzero(table)
        times = table[pairs]
    else:
        pairs, times = np.unique(pairs, return_counts=True)
    text, word = pairs // size, pairs % size
    per_word = refs.ends[word + 1] - refs.ends[word] if len(word) else word
    at = np.arange(per_word.sum()) - np.repeat(np.cumsum(per_word) - per_word, per_word) + np.repeat(refs.ends[word], per_word) if len(word) else word
    p, q, lang, text = np.repeat(times / total[text], per_word), refs.share[at], refs.lang[at], np.repeat(text, per_word)
    cell, cells, width = text * len(refs.langs) + lang, n * len(refs.langs), len(refs.langs)
    plus = lambda x: np.bincount(cell, weights=x, minlength=cells).reshape(n, width)
    h = lambda x: -x * np.log2(np.where(x > 0, x, 1))
    mine = plus(p)
    # of words that a text doesn't have, half of their share is mixed with nothing
    absent = h(refs.share / 2)
    mixed = plus(h((p + q) / 2) - absent[at]) + np.bincount(refs.lang, weights=absent, minlength=width)
    apart = plus(h(p)) + refs.whole
    other = np.maximum(1 - mine, 0)
    divergence = mixed + h((other + refs.rest) / 2) - (apart + h(other) + h(refs.rest)) / 2
    words = np.where((np.bincount(row[counted], minlength=n) > 0)[:, None], np.sqrt(np.maximum(divergence, 0)), 0)
    return chars, words


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None,
    char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Row for row: the id, the ``keep`` columns, COUNTS, base_failed, kept, char_distance and word_distance.

    The distances are those to the language with the smallest larger one of the two, relative to
    their limits; null where a guard leaves them out or there is no reference. Null texts have no
    words and fail the base rules, as do empty ones. Null languages only keep a document from
    counting in a reference. An empty table gives no rows.
    """
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, lang_col, text_col))
    keep = [c for c in keep or [] if c != id_col]
    back = text_col in keep  # the text goes to Python once, also where it comes back
    cols = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep) if c != text_col))
    made = [*((c, T.LongType()) for c in COUNTS), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("char_distance", T.DoubleType()), ("word_distance", T.DoubleType())]
    schema = T.StructType([*cols.schema.fields[1:], *([T.StructField("text", T.StringType())] if back else []), *(T.StructField(c, k) for c, k in made)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = refs.value
        texts = texts_of(batch.column(0))
        data, offsets = flat_bytes(batch.column(0))
        ids, names, per = words_of(batch.column(0))
        counts = base_counts(texts, data, offsets, ids, names, per)
        failed = (per < 20) | (100 * counts["n_repeat_words"] > 30 * per)
        hist = class_counts(data, offsets)
        n = len(texts)
        n_chars = hist.sum(axis=1)
        no_chars, no_words = n_chars < min_chars, per < min_words
        if known.langs:
            chars, words = distances(known, hist, ids, names, per)
            c, w = (
                np.where(short[:, None], 0, d / (base + slack / np.sqrt(np.maximum(size, 1)))[:, None])
                for short, d, size, (base, slack) in ((no_chars, chars, n_chars, char_limit), (no_words, words, per, word_limit))
            )
            best = np.argmin(np.maximum(c, w), axis=1)
            rows = np.arange(n)
            near = np.maximum(c, w)[rows, best] <= 1
            chars, words = chars[rows, best], words[rows, best]
        else:
            near, chars, words = np.ones(n, bool), np.zeros(n), np.zeros(n)
            no_chars, no_words = np.ones(n, bool), np.ones(n, bool)
        out = [*(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(near & ~failed), pa.array(chars, mask=no_chars), pa.array(words, mask=no_words)]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *([batch.column(0)] if back else []), *out], schema.names)

    done = walk(cols, run, schema)
    kept = [F.col("text" if c == text_col else f"k{i}").alias(c) for i, c in enumerate(keep)]
    return done.select(F.col("id").alias(id_col), *kept, *(c for c, _ in made))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    judged = quality_rules(docs.select(F.struct(*others).alias("row"), F.col(id_col), F.col(text_col), F.col(lang_col)), id_col, text_col, lang_col, keep=["row", text_col])
    return judged.where("kept").select(F.col(id_col), F.col(text_col), *(F.col("row").getField(c).alias(c) for c in others)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


QUERIES = {"op2_quality_rules": query}
_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, text IS NOT NULL AND lang IS NOT NULL AS refers, lang FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
nw AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, string_agg(word, ' ') OVER z AS gram, count(*) OVER z AS n FROM w WINDOW z AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM win WHERE n = 8) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) t(k) GROUP BY r),
base AS (SELECT d.r, doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS n_chars FROM d LEFT JOIN nw USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
patterns(class, pattern) AS (VALUES ('lower', '\p{Ll}'), ('upper', '[\p{Lu}\p{Lt}]'), ('letter', '[\p{Lm}\p{Lo}]'), ('mark', '\p{M}'), ('digit', '\p{N}'), ('space', '[\p{Z}\x09-\x0D]'), ('symbol', '[\p{S}#*$%&|<>]'), ('points', '\p{P}'), ('pointsigns', '[#*%&]')),
raw AS (SELECT r, class, length(text) - length(regexp_replace(text, pattern, '', 'g')) AS n FROM d, patterns),
known AS (SELECT r, CASE WHEN class IN ('points', 'pointsigns') THEN 'stop' ELSE class END AS class, sum(CASE WHEN class = 'pointsigns' THEN -n ELSE n END) AS n FROM raw GROUP BY ALL),
hist AS (SELECT r, class, n FROM known UNION ALL SELECT base.r, 'other', n_chars - coalesce(sum(n), 0) FROM base LEFT JOIN known USING (r) GROUP BY base.r, n_chars),
refc AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM hist JOIN d USING (r) WHERE refers GROUP BY lang, class),
cores AS (SELECT r, core, count(*) AS n FROM (SELECT r, regexp_replace(lower(word), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS core FROM w) WHERE core <> '' GROUP BY r, core),
tot AS (SELECT r, sum(n) AS total FROM cores GROUP BY r),
langs AS (SELECT lang, sum(n) AS total FROM cores JOIN d USING (r) WHERE refers GROUP BY lang),
common AS (SELECT lang, core, sum(n) / any_value(total) AS q FROM cores JOIN d USING (r) JOIN langs USING (lang) WHERE refers GROUP BY lang, core HAVING sum(n) >= @share@ * any_value(total)),
rest AS (SELECT lang, greatest(0, 1 - sum(q)) AS q FROM common GROUP BY lang),
cd AS (SELECT h.r, c.lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist
  FROM (SELECT r, class, n / greatest(n_chars, 1) AS p FROM hist JOIN base USING (r)) h JOIN refc c USING (class) GROUP BY h.r, c.lang),
bins AS (SELECT t.r, c.lang, c.core, coalesce(n, 0) / total AS p, q FROM tot t CROSS JOIN common c LEFT JOIN cores x ON x.r = t.r AND x.core = c.core),
allbins AS (SELECT r, lang, p, q FROM bins UNION ALL SELECT b.r, b.lang, greatest(0, 1 - sum(b.p)), any_value(rest.q) FROM bins b JOIN rest USING (lang) GROUP BY b.r, b.lang),
wd AS (SELECT r, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist FROM allbins GROUP BY r, lang),
near AS (SELECT base.r, bool_or((n_chars < @min_chars@ OR cd.dist <= @c0@ + @c1@ / sqrt(n_chars)) AND (n_words < @min_words@ OR coalesce(wd.dist, 0) <= @w0@ + @w1@ / sqrt(n_words))) AS ok FROM base JOIN cd USING (r) LEFT JOIN wd ON wd.r = cd.r AND wd.lang = cd.lang GROUP BY base.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  coalesce(ok, true) AND NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS kept FROM base LEFT JOIN near USING (r)
"""
for _name, _value in {"min_chars": MIN_CHARS, "min_words": MIN_WORDS, "c0": CHAR_LIMIT[0], "c1": CHAR_LIMIT[1], "w0": WORD_LIMIT[0], "w1": WORD_LIMIT[1], "share": COMMON_SHARE}.items():
    _SQL = _SQL.replace(f"@{_name}@", str(_value))
SQL = {"op2_quality_rules": _SQL}
