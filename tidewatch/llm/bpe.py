"""Exact BPE by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one last token in its BPE encoding. An automaton with
suffix links gives all vocabulary tokens that end at a position; of these exactly one is
compatible with the last token of the prefix before it, where two tokens are compatible if BPE of
their joined strings is just these two. The last tokens are stored per prefix and the encoding is
read off by following them backwards from the end. Cost is linear in the length.

The end-of-word mark belongs to a word's last symbol, so that symbol is a letter of its own in
the automaton's alphabet.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_of, walk

MODEL = "word_bpe_49k.json"
#: Words and pre-tokens a worker keeps, the longest that it keeps, and successors of a token whose compatibility it keeps.
CACHE_ENTRIES, CACHE_CHARS, PAIR_ENTRIES = 1 << 19, 64, 1 << 10
_END = 0x10000  # added to a symbol's code when it ends a word
#: Texts of printable characters below this are split here; there all Unicode versions agree, characters are composed already and lower case goes character by character.
_PLAIN = "\u0250"


class PrefixBpe:
    """Encoder and decoder for a tokenizer file with a BPE model and an end-of-word suffix."""

    def __init__(self, path: str, unreachable: frozenset[int] | None = None):
        """``unreachable``: tokens whose own string BPE encodes otherwise, if they are known already."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or not self.suffix or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("a plain BPE model with an end-of-word suffix is needed")
        if spec.get("decoder"):
            raise ValueError("a tokenizer file without a decoder is needed")
        library = tokenizers.Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        pattern = next((p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split" and p["invert"] and p["behavior"] == "Removed"), None)
        steps = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        self.pieces_of = regex.compile(pattern).findall if pattern and steps == ["NFC", "Replace", "Lowercase"] else None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # the byte alphabet: these stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._ranks(model["merges"])
        single = {s: k for k, s in enumerate(self.strings) if len(s) == 1}
        if unreachable is None:
            unreachable = frozenset(k for k, (a, _) in enumerate(self.parts) if a != k and self._whole(self.strings[k], single) != [k])
        self.unreachable = unreachable
        self.pairs: list[dict[int, bool]] = [{} for _ in self.parts]
        self.matches = ahocorasick.Automaton()
        for k, s in enumerate(self.strings):
            if k not in unreachable:
                self.matches.add_word(s, (k, len(s)))
        self.matches.make_automaton()

    def _word(self, token: str) -> str:
        """A token's string in the automaton's alphabet."""
        if token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def _ranks(self, merges: list) -> None:
        """Tokens numbered in merge order; single symbols come before all merges."""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        made = {a.removesuffix(self.suffix) + b if not a.endswith(self.suffix) else a + b for a, b in pairs}
        basic = [t for t in self.vocab if t not in made]
        self.rank = {t: k for k, t in enumerate(basic)}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(len(basic))]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            token = a + b
            if token in self.rank or a not in self.rank or b not in self.rank:
                raise ValueError("each merge must make a new token of earlier ones")
            self.merged[self.rank[a], self.rank[b]] = self.rank[token] = len(self.parts)
            self.parts.append((self.rank[a], self.rank[b]))
        self.ids = [self.vocab[t] for t in self.rank]
        self.strings = [self._word(t) for t in self.rank]
        self.sizes = [len(s) for s in self.strings]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joined string is these two tokens.

        Walks down the border between them in the order of merges: a merge across it that comes
        before the merges that made either side would have been taken.
        """
        limit = len(self.parts)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True

    def _whole(self, word: str, single: dict[str, int]) -> list[int]:
        """Merge by merge, for one short token."""
        row = [single[c] for c in word]
        while len(row) > 1:
            best = min((self.merged.get(p, len(self.parts)) for p in zip(row, row[1:], strict=False)), default=len(self.parts))
            if best == len(self.parts):
                break
            out, k = [], 0
            while k < len(row):
                if k + 1 < len(row) and self.merged.get((row[k], row[k + 1])) == best:
                    out.append(best)
                    k += 2
                else:
                    out.append(row[k])
                    k += 1
            row = out
        return row

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given in the byte alphabet and not empty."""
        word = piece[:-1] + chr(ord(piece[-1]) + _END)
        last = [-1] * (len(word) + 1)
        pairs = self.pairs
        for end, (token, size) in self.matches.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            if end != size:
                before = last[end - size]
                if before < 0:
                    continue
                known = pairs[before]
                fits = known.get(token)
                if fits is None:
                    fits = self.compatible(before, token)
                    if len(known) < PAIR_ENTRIES:
                        known[token] = fits
                if not fits:
                    continue
            last[end] = token
        out, at = [], len(word)
        while at:
            token = last[at]
            out.append(self.ids[token])
            at -= self.sizes[token]
        return out[::-1]

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens in the byte alphabet, of a text without special strings."""
        if self.pieces_of and text.isprintable() and (text.isascii() or (max(text) < _PLAIN and "\u0130" not in text)):
            got = self.pieces_of(text.lower())
            return got if text.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet) for p in got]
        return [p for p, _ in self.split(self.normalize(text))]

    def written(self, piece: str) -> tuple[int, str, str]:
        """(tokens, ids joined by spaces, decoded text) of a pre-token."""
        got = self.kept.get(piece)
        if got is None:
            ids = self.encode_piece(piece)
            got = len(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(self.kept) >= CACHE_ENTRIES:
                self.kept.clear()
            if len(piece) <= CACHE_CHARS:
                self.kept[piece] = got
        return got

    def word(self, word: str) -> tuple[int, str, str]:
        """The same of a text without white space that matters; special strings become their ids."""
        parts = [word]
        for s in self.special:
            if s in word:
                parts = [y for x in parts for y in (_cut(x, s) if x not in self.special else [x])]
        got = []
        for x in parts:
            if x in self.special:
                got.append((1, str(self.special[x]), x))
            elif x:
                got += map(self.written, self._pieces(x))
        if len(got) == 1:
            return got[0]
        return sum(g[0] for g in got), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in text.encode().split() for i in self.word(w.decode())[1].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: token strings joined by spaces."""
        return " ".join(self.names[i] for i in ids)


def _cut(text: str, mark: str) -> list[str]:
    out = []
    for x in text.split(mark):
        out += [x, mark]
    return out[:-1]


class Words(dict):
    """White-space word (bytes) -> (tokens, ids as text, decoded text)."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: bytes) -> tuple[int, str, str]:
        got = self.bpe.word(word.decode())
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = got
        return got


_WORKER: dict[str, Words] = {}


def worker_words(path: str, unreachable: frozenset[int]) -> Words:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Words(PrefixBpe(path, unreachable))
    return _WORKER[path]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, full: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with ``full`` the ids and the decoded text instead of digests.

    Null and empty texts have no tokens; their digests are those of the empty string. White space
    separates words and is otherwise dropped, as the tokenizer does. Row for row; a null id stays
    null; an empty table gives no rows.
    """
    path = model_path or public_tokenizers.path(MODEL)
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    unreachable = PrefixBpe(path).unreachable  # found once, here; at most the vocabulary

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, rows = worker_words(path, unreachable), []
        for t in texts_of(batch.column(1)):
            got = [w for w in map(words.__getitem__, t.encode().split()) if w[0]]
            ids, text = " ".join([w[1] for w in got]), " ".join([w[2] for w in got])
            if full:
                rows.append((sum(w[0] for w in got), [int(x) for x in ids.split()], text))
            else:
                rows.append((sum(w[0] for w in got), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        n, a, b = zip(*rows, strict=True)
        kind = pa.list_(pa.int32()) if full else pa.string()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, kind), pa.array(b, pa.string())], ["id", "n_tokens", *names])

    names = ["ids", "decoded"] if full else ["ids_sha256", "decoded_sha256"]
    schema = T.StructType(
        [T.StructField("id", cols.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField(names[0], T.ArrayType(T.IntegerType()) if full else T.StringType()), T.StructField(names[1], T.StringType())]
    )
    return walk(cols, run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


QUERIES = {"op8_bpe": query}
SQL: dict[str, str] = {}
