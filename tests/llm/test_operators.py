"""The ten operators against brute force, libraries and round trips, with nulls, empty and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import bpe, common, html_text, language_id, matroska, packing, quality, quality_model, simhash, suffix_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "A b", "é" * 400, "<s> ▁▁ x", "日本語 テスト", "x" * 5000, "ab " * 3000, "same text twice " * 30, "same text twice " * 30, "\x00\x1c q", "don't  stop\t1234"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with a repeated row, a null id and columns named like results."""
    rows = [(k, t, "en" if k % 2 else None, "s", k, "mine", 1.0, "x") for k, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id here", "de", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, id string")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def empty(df):
    return df.where("false")


# -- shared -------------------------------------------------------------------------------------

def test_words_and_bytes():
    column = pa.array(["a b", None, "", "  x\ty \n", "é"])
    ids, names, per = common.words_of(column)
    assert [names[i] for i in ids] == ["a", "b", "x", "y", "é"] and per.tolist() == [2, 0, 0, 2, 1]
    data, offsets = common.flat_bytes(column.slice(3))
    assert data.tobytes().decode() == "  x\ty \né" and offsets.tolist() == [0, 7, 9]


# -- 1 language ---------------------------------------------------------------------------------

def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(30):
        per = rng.integers(0, 8, 5)
        scores = rng.normal(size=(per.sum(), 3)).astype(np.float32) * 2
        got, at = language_id.viterbi(scores, per, 1.5), 0
        for n in per:
            x = scores[at : at + n]
            value = lambda z: sum(x[i][z[i]] for i in range(n)) - 1.5 * sum(z[i] != z[i - 1] for i in range(1, n))  # noqa: B023, E731
            best = max((value(z) for z in np.ndindex(*[3] * n)), default=0) if n else 0
            assert n == 0 or abs(value(got[at : at + n]) - best) < 1e-4
            at += n


def test_scripts():
    assert language_id.script_of("жизнь") == "cyrillic" and language_id.script_of("12-") == "" and language_id.script_of("日本") == "han"


def test_language_held_out_accuracy(spark, docs):
    got = language_id.identify(docs.withColumn("held", common.crc32_mod("doc_id", 4) == 2), language_id.learned(docs), keep=["held", "lang"]).where("held").toPandas()
    assert len(got) > 30 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_spans_and_odd_rows(spark, docs, odd):
    model = language_id.learned(docs)
    mixed = spark.createDataFrame([(1, "the and of that with from this are have the of and " * 4 + "der die und nicht von den ist ein zu der und die " * 4)], "doc_id long, text string")
    row = language_id.identify(mixed, model, spans=True).first()
    assert row.n_spans == 2 and [s.lang for s in row.spans] == ["en", "de"] and sum(s.words for s in row.spans) == 96
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count() and all((r.lang_pred == "und") == (r.score == 0) for r in got)
    none = {r.doc_id: r.lang_pred for r in got}
    assert none[0] == none[1] == none[3] == "und"
    assert language_id.identify(empty(docs), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.limit(5), language_id.fit(empty(docs))).collect()} == {"und"}


# -- 2 quality rules ----------------------------------------------------------------------------

def _base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_base_counts(docs, odd):
    for df in (docs.select("doc_id", "text", "lang"), odd):
        text = [r.text for r in df.collect()]
        got = quality.quality_rules(df, keep=["text"]).collect()
        assert Counter((t, *_base(t)) for t in text) == Counter((r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_references_and_distance(docs):
    refs = quality.references(docs)
    counts = {}
    for r in docs.collect():
        counts.setdefault(r.lang, Counter()).update(c for c in map(quality.core, WORD.findall(r.text)) if c)
    assert refs.langs == sorted(counts)
    for k, lang in enumerate(refs.langs):
        rows = {w: slice(refs.ends[n], refs.ends[n + 1]) for w, n in refs.index.items()}
        own = {w: refs.share[at][refs.lang[at] == k] for w, at in rows.items()}
        index = {w: n for n, w in enumerate(w for w, x in own.items() if len(x))}
        shares = np.array([own[w].item() for w in index])
        total = sum(counts[lang].values())
        assert set(index) == {w for w, n in counts[lang].items() if n >= quality.COMMON_SHARE * total}
        assert all(abs(shares[k] - counts[lang][w] / total) < 1e-12 for w, k in index.items())
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert abs(quality.js_distance(p, q) - np.sqrt(0.5)) < 1e-12 and quality.js_distance(p, p) == 0


def test_quality_keeps_clean_documents(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1")
    good = quality.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert good.kept.mean() > 0.95
    assert set(quality.keep_good(docs).columns) == set(docs.columns)
    assert quality.quality_rules(empty(docs)).count() == 0


# -- 3 token counts -----------------------------------------------------------------------------

def test_token_counts_equal_the_library(docs, odd):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    for df in (docs, odd):
        got = token_counts.token_counts(df, keep=["doc_id", "text"]).collect()
        assert len(got) == df.count()
        assert all(r.n_tokens == len(model.encode(r.text or "")) for r in got)
    assert token_counts.token_counts(empty(docs), keep=["doc_id"]).count() == 0


def test_pre_tokens_fuzz():
    import public_tokenizers
    import sentencepiece

    model, own, rnd = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL)), token_counts.Lengths(public_tokenizers.path(token_counts.MODEL)), random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice("ab  \n\t▁é日<s>/1") for _ in range(rnd.randint(0, 40)))
        assert own.count(text) == len(model.encode(text)), repr(text)


# -- 4 quality model ----------------------------------------------------------------------------

def test_trees_learn_and_flat_traversal_is_right():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality_model.train(x[:2000], y[:2000], trees=40, depth=3)
    p = forest.score(x)
    assert ((p[2000:] > 0.5) == y[2000:]).mean() > 0.95
    for k in range(50):  # one text, node by node
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[k, forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(1 / (1 + np.exp(-total)) - p[k]) < 1e-9
    assert quality_model.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality_model_held_out(spark, small, docs, odd):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    forest = quality_model.fit(docs, labels.where(common.crc32_mod("doc_id", 5) != 0).union(labels.limit(3)).union(spark.createDataFrame([(None, 1, 1), (4, None, 0)], labels.schema)))
    got = quality_model.score(docs, forest).join(labels, "doc_id").where(common.crc32_mod("doc_id", 5) == 0).toPandas()
    assert (got.predicted == got.quality).mean() > 0.8
    scored = quality_model.score(odd, forest).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert quality_model.score(empty(docs), forest).count() == 0


# -- 5 Matroska ---------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", range(4))
def test_mux_and_read_back(kind):
    for n in (0, 1, 576, 577, 576 * 9, 576 * 515):
        payload, _ = matroska.padded("x" * n)
        got, media = matroska.read_back(matroska.mux(payload, kind))
        assert got == payload and [p[1] for p in media.packets] == [12_000_000 * k for k in range(len(payload) // 576)]
        assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and len(media.cues) == len(media.clusters)


def test_lacing_of_unlike_frames():
    rnd = random.Random(4)
    for kind in (matroska.XIPH_LACING, matroska.EBML_LACING):
        for _ in range(30):
            frames = [bytes(rnd.randrange(0, 3000)) for _ in range(rnd.randint(2, 12))]
            data = matroska.lace(frames, kind)
            sizes, at = matroska.laces(data, 0, len(data), kind)
            assert sizes == [len(f) for f in frames] and data[at:] == b"".join(frames)


def test_unknown_sizes_and_broken_files():
    data = matroska.mux(matroska.padded("y" * 2000)[0])
    at = data.index(matroska._id(matroska.SEGMENT)) + 4
    length = 9 - data[at].bit_length()
    open_ended = data[:at] + b"\x01" + b"\xff" * 7 + data[at + length :]
    assert matroska.read_back(open_ended)[0] == matroska.read_back(data)[0]
    for bad in (b"RIFF1234", data[: len(data) // 2]):
        with pytest.raises(ValueError):
            matroska.parse(bad)


def test_media_digests(spark, odd):
    got = matroska.media_digests(odd, store=True)
    rows = got.collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        payload, n = matroska.padded(by_id[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and hashlib.sha256(r.media).hexdigest() == r.media_sha256
    table = matroska.packets(got)
    assert table.agg(F.sum("size")).first()[0] == sum(r.payload_bytes for r in rows)
    assert matroska.packets(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


# -- 6 packing ----------------------------------------------------------------------------------

def _brute_pack(items, capacity, per_source):
    """The tightest compatible bin by looking at all."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and cluster not in b["clusters"] and (source is None or b["sources"].count(source) < per_source)]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "clusters": [], "sources": []})
        b = bins[k]
        out.append((k, capacity - b["room"]))
        b["room"] -= size
        b["clusters"] += [cluster] if cluster is not None else []
        b["sources"].append(source)
    return out


@pytest.mark.parametrize("per_source", [1, 2])
def test_packer_takes_the_tightest_compatible_bin(per_source):
    rnd = random.Random(per_source)
    items = sorted(((rnd.randint(1, 100), rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, *range(40)])) for _ in range(400)), key=lambda x: -x[0])
    packer = packing.Packer(100, per_source)
    assert [packer.place(*i) for i in items] == _brute_pack(items, 100, per_source)


def test_pack_keeps_everything_and_all_conflicts(spark):
    rnd = random.Random(9)
    rows = [(k if k % 50 else None, rnd.randint(0, 9000), rnd.choice(["hot", "hot", f"s{k % 7}", None]), k % 300 if k % 3 else None) for k in range(3000)] + [(7, 10, "hot", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long")
    got = packing.pack(df, "size", block=200).toPandas()
    assert got.n_tokens.sum() == sum(r[1] for r in rows)
    assert (got.bin_id.isna() == (got.n_tokens == 0)).all()
    full = got[got.n_tokens > 0].groupby("bin_id")
    assert (full.n_tokens.sum() <= packing.CAPACITY).all()
    info = {r[0]: r for r in rows if r[0] is not None}
    for _, b in full:
        ends = sorted(zip(b.bin_offset, b.bin_offset + b.n_tokens, strict=True))
        assert all(a[1] <= c[0] for a, c in zip(ends, ends[1:], strict=False))
        if b.doc_id.notna().all() and 7 not in set(b.doc_id):
            own = [info[int(d)] for d in b.doc_id]
            for c in (2, 3):
                named = [o[c] for o in own if o[c] is not None]
                assert len(named) == len(set(named))
    again = packing.pack(df.repartition(9), "size", block=200).toPandas()
    key = ["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert packing.pack(empty(df), "size").count() == 0


def test_pack_documents(odd):
    got = packing.pack_documents(odd)
    assert got.where("piece = 0").count() == odd.count()


# -- 7 main text --------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
<nav><a href=a>Home</a> <a href=b>News</a></nav><div class="cookie-notice">We use cookies, accept them all now please.</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First  paragraph<br>goes on<p>Second with <a href=q>a link</a> &lt;tag&gt; and quite some words in it.
<ul><li>one<li>two</ul><form><p>Your name <input></form><script>var a = "<p>no</p>"</script><pre>a
 b</pre></article><div id="comments"><p>Great article, I have a very long opinion on everything that was said in it, and more.</p></div>
<aside><p>Read this too</p></aside><footer>&copy; all</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph goes on\nSecond with a link <tag> and quite some words in it.\none\ntwo\na b"


def test_main_text_edges():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("just text &amp; more") == "just text & more"
    assert html_text.main_text("<p>cut off <b>here") == "cut off here"
    assert html_text.main_text("<p>a</p><!-- no --><p>b < c</p><script>if (a<b) x()") == "a\nb < c"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    long = "word " * 100_000
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_density_is_characters_per_tag_lessened_by_links():
    page = html_text.Page("<div><p>" + "x" * 90 + "</p><p>" + "y" * 30 + "</p></div><div><a>" + "z" * 40 + "</a></div>")
    density, sums = page.densities()
    tags = page.tag
    first, link = tags.index("p"), tags.index("a")
    assert density[first] > density[first + 1] > density[link] and sums[tags.index("div")] == pytest.approx(density[first] + density[first + 1])


def test_extract_pages(spark, small):
    import html

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages.withColumn("text", F.lit("mine"))).collect()}
    for p in pages.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", p.html)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)
    assert html_text.extract(pages.withColumn("html", F.lit(None).cast("string"))).where("text = '' AND n_chars = 0").count() == pages.count()


def test_html_wrapped_pages():
    """An open head, a form or a named wrapper around the page doesn't take the page with it."""
    text = "<article><p>Some words that make up the text of the page.</p><p>And a second paragraph of it.</p></article>"
    want = "Some words that make up the text of the page.\nAnd a second paragraph of it."
    aside = '<div class="sidebar"><p>Beside it.</p></div>'
    assert html_text.main_text(f"<html><head><title>t</title><body>{text}") == want
    assert html_text.main_text(f"<html><head><meta charset=x><title>t</title>{text}") == want
    assert html_text.main_text("<head><title>t</title> only words") == "only words"
    assert html_text.main_text(f"<body><form action=x>{aside}{text}<form><p>Search</p></form></form></body>") == want
    assert html_text.main_text(f'<body><div class="layout sidebar-right">{aside}{text}</div></body>') == want
    assert html_text.main_text('<div class="menu"><ul><li>Longer</li><li>than the text</li></ul></div><article><p>Short.</p></article>') == "Short."
    assert html_text.main_text(f"<body>{text}<form><p>Your name</p></form>{aside}</body>") == want


def test_densities_by_definition():
    """Densities and sums against their formula over explicit subtrees."""
    import math
    import random

    rng = random.Random(3)

    def some(depth: int) -> str:
        parts = []
        for _ in range(rng.randint(1, 4)):
            name = rng.choice(["div", "section", "a", "span", "ul"])
            inner = some(depth - 1) if depth and name != "a" else ""
            parts.append(f"<{name}>{'w' * rng.randint(0, 60)}{inner}</{name}>")
        return "".join(parts)

    for _ in range(20):
        page = html_text.Page(some(3))
        density, sums = page.densities()
        n = len(page.tag)
        ancestors = []
        for k in range(n):
            line, at = [], k
            while at >= 0:
                line.append(at)
                at = page.parent[at]
            ancestors.append(line)
        below = lambda k: [x for x in range(n) if k in ancestors[x]]
        links = lambda xs, k: [x for x in xs if any(page.tag[a] == "a" for a in ancestors[x][: ancestors[x].index(k) + 1])]
        count = lambda xs: sum(page.chars[x] for x in xs)
        body = count(links(range(n), 0)) / (count(range(n)) or 1)
        for k in range(n):
            xs = below(k)
            c, t, inside = count(xs), len(xs), links(xs, k)
            lc, lt = count(inside), len(inside)
            want = 0 if not c else c / t * math.log(c / (lc or 1) * t / (lt or 1)) / math.log(math.log(c / ((c - lc) or 1) * lc + body * c + math.e)) if math.log(c / ((c - lc) or 1) * lc + body * c + math.e) > 1.001 and c / (lc or 1) * t / (lt or 1) > 1 else density[k]
            assert density[k] == pytest.approx(want)
            assert sums[k] == pytest.approx(sum(density[x] for x in range(n) if page.parent[x] == k))


def test_density_decides_on_pages(spark, small):
    """Without the choice by density most pages differ; without hints few do; nothing is quadratic."""
    import time

    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    own = [html_text.main_text(p) for p in pages]

    class Whole(html_text.Page):
        def inside(self):
            return [True] * len(self.tag)

    assert sum(Whole(p).main_text() != t for p, t in zip(pages, own, strict=True)) > 0.9 * len(pages)
    hints = html_text._HINTS
    try:
        html_text._HINTS = frozenset()
        assert sum(html_text.main_text(p) != t for p, t in zip(pages, own, strict=True)) <= 0.1 * len(pages)
    finally:
        html_text._HINTS = hints
    text = "<p>Some words that make up the text of the page.</p><p>And a second paragraph of it.</p>"
    want = "Some words that make up the text of the page.\nAnd a second paragraph of it."
    for wrap in ('<div class="promo">{}</div>', '<div class="menu">{}</div>', "<form>{}</form>", '<div class="promo"><article>{}</article></div>', "<section>{}</section><div>Buy this now, it is cheap.</div>", "<div>" * 40 + "{}", '{}<ul class=share><li><a href=x>Share on one</a><li><a href=y>Share on two</a></ul>'):
        assert html_text.main_text(wrap.format(text)) == want
    assert html_text.main_text(f"<div>{text}</div><div>{text.replace('second', 'third')}</div><div><a>x</a> <a>y</a></div>").count("\n") == 3
    assert html_text.main_text('<div class="menu">only text</div>') == "only text"
    for page in ("<div>" * 50_000 + "x", "<p><object>" + "<div>" * 50_000 + "x", "<p><b>x" * 50_000, "<ul><li>x" * 20_000, "<td>" * 20_000 + "<p>x" * 20_000):
        at = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - at < 10


# -- 8 BPE --------------------------------------------------------------------------------------

def test_bpe_equals_the_library(docs, odd):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path(bpe.MODEL)
    library, own, rnd = tokenizers.Tokenizer.from_file(path), bpe.PrefixBpe(path), random.Random(6)
    texts = ["".join(rnd.choice("abAB  \té'sre12日ßΣς🙂́İ<|>") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += ["<|startoftext|>x<|endoftext|> <|ENDOFTEXT|>", "<|endoftext|>" * 3, "a" * 3000, "ab" * 2000, "don't we're I'LL"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t[:80])
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for df in (docs.limit(60), odd):
        known = {r.doc_id: r.text for r in df.collect()}
        for r in bpe.encode_decode(df, full=True).collect():
            ids = library.encode(known[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    digest = bpe.encode_decode(odd).where("doc_id = 0").first()
    assert digest.n_tokens == 0 and digest.ids_sha256 == digest.decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_every_prefix_has_one_last_token():
    import public_tokenizers

    own = bpe.PrefixBpe(public_tokenizers.path(bpe.MODEL))
    single = {s: k for k, s in enumerate(own.strings) if len(s) == 1}
    for piece in ("internationalisation", "aaaaaaaaaa", "thethethe"):
        word = piece[:-1] + chr(ord(piece[-1]) + bpe._END)
        assert own.encode_piece(piece) == [own.ids[k] for k in own._whole(word, single)]


# -- 9 SimHash ----------------------------------------------------------------------------------

def _fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(ids, fps):
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps, strict=True):
            low = min(label[j] for j, b in zip(ids, fps, strict=True) if (a ^ b).bit_count() <= 2)
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_simhash_groups(docs, odd):
    rows = docs.select("doc_id", "text").collect()
    fps = [_fingerprint(r.text) for r in rows]
    want = _groups([r.doc_id for r in rows], fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{f:016x}" for r, f in zip(rows, fps, strict=True)}
    some = simhash.near_duplicates(odd).collect()
    assert len(some) == odd.count() and {r.component_id for r in some if r.doc_id in (0, 1, 2, 3)} == {0}
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_links_join_what_all_pairs_join(spark, bucket, monkeypatch):
    """Dense clouds of fingerprints, through pairs and through neighbours."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(bucket)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(20):
            y = x
            for _ in range(rnd.randint(0, 3)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
    signed = [simhash._signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = common.Scratch(spark, "test")
    got = {r.node: r.label for r in simhash.components(simhash.links(df, scratch)).collect()}
    want = _groups(signed, [f & (1 << 64) - 1 for f in signed])
    label = {f: got.get(f, f) for f in signed}
    assert all((label[a] == label[b]) == (want[a] == want[b]) for a in signed for b in signed)


def test_keep_first(docs, odd):
    kept = simhash.keep_first(docs)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values())) and kept.columns == docs.columns
    assert simhash.keep_first(odd).where("doc_id IS NULL").count() == 1 and simhash.keep_first(odd).where("doc_id = 5").count() <= 1


def _alike(texts, shingle=5, percent=80):
    """Smallest index of each text's component, by all pairs."""
    sets = [set(simhash.shingles(t, shingle).tolist()) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.fixture(scope="module")
def families():
    """Texts with copies of one to six changed words, among texts that share a line; short and blank ones."""
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(4000)}"
    out, line = ["", None, " ", "a b", "A  b", "a b c d e f", "a b c d e g"], " ".join(word() for _ in range(12))
    for size, copies in ((300, 12), (120, 40), (60, 40), (25, 12), (40, 0), (40, 0)):
        base = [word() for _ in range(size)]
        out.append(" ".join(base) + " " + line)
        for _ in range(copies):
            some = list(base)
            for _ in range(rnd.randint(0, 6)):
                some[rnd.randrange(size)] = word()
            out.append(" ".join(some) + " " + line)
    return out


@pytest.mark.parametrize("bucket", [1, 5, 1000])
def test_similar_texts_are_those_of_all_pairs(spark, docs, families, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    df = spark.createDataFrame(list(enumerate(families)), "doc_id long, text string").repartition(3)
    want = _alike(families)
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()} == dict(enumerate(want))
    if bucket == 5:
        rows = sorted(docs.select("doc_id", "text").collect())
        want = {r.doc_id: rows[k].doc_id for r, k in zip(rows, _alike([r.text for r in rows]), strict=True)}
        assert {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()} == want
        assert simhash.similar_texts(empty(docs)).count() == 0


def test_similar_texts_link_by_fingerprints(spark, families, monkeypatch):
    """The pigeonring's links are used, none of them joins unlike sets, and the result is that of all pairs."""
    texts = [*families, *(f"{families[7]} tail{k}" for k in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, plain = [], simhash._print_links
    monkeypatch.setattr(simhash, "_print_links", lambda *a: found.append(plain(*a)) or found[-1])
    kept = []
    drop = common.Scratch.drop
    monkeypatch.setattr(common.Scratch, "drop", lambda self, name: kept.append(name) if name in ("near", "sets") else drop(self, name))
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()} == dict(enumerate(_alike(texts)))
    assert {"near", "sets"} <= set(kept) and len(found) == 1

    sets = {xxhash.xxh64_intdigest(np.unique(simhash.shingles(t, 5)).tobytes(), simhash.SEED): np.unique(simhash.shingles(t, 5)) for t in texts}
    sets = {simhash._signed(k): v for k, v in sets.items()}
    sims = {k: simhash.majority(v) if len(v) else 0 for k, v in sets.items()}
    links = [(r.a, r.b) for r in found[0].collect()]
    assert len(links) >= 20
    for a, b in links:
        assert a > b and (sims[a] ^ sims[b]).bit_count() <= 2
        both = len(np.intersect1d(sets[a], sets[b]))
        assert both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both)


def test_pipeline_stage_drops_near_copies(spark, docs):
    """Every word shingle but five is shared; fingerprints are more than two bits apart."""
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(100))
    near = text.replace("w50 ", "other ").replace("w51 ", "words ")
    assert (simhash.fingerprint(text) ^ simhash.fingerprint(near)).bit_count() > 2
    df = spark.createDataFrame([(3, near), (2, text), (1, "quite another text " * 9)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 2]


# -- 10 repeated strings ------------------------------------------------------------------------

def _repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def _soup(seed, n=70):
    rnd = random.Random(seed)
    text = lambda k, a="abcdefghij é": "".join(rnd.choice(a) for _ in range(k))
    passages = [text(rnd.randint(100, 700)) for _ in range(6)]
    out = [None, "", "short", "a" * 200, "a" * 201, "a" * 1000, "ab" * 400, "xyz" * 80 + text(300)]
    for _ in range(n):
        t = text(rnd.randint(0, 400))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            t += p[a : rnd.randint(a, len(p))] + text(rnd.randint(0, 200))
        out.append(t)
    return out + out[10:14] + ["und " * rnd.randint(40, 200) + text(30) for _ in range(5)]


def test_repeated_strings_equal_brute_force(spark):
    texts = _soup(5)
    df = spark.createDataFrame([(k if k % 9 else None, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == Counter(_repeats(texts, 200))
    assert suffix_dedup.remove_repeats(empty(df)).count() == 0


def test_repeated_strings_of_other_lengths(spark):
    texts = [t for t in _soup(8, 25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=60).collect()}
    assert [got[k] for k in range(len(texts))] == _repeats(texts, 60)


def test_runs_and_pieces_do_not_depend_on_blocks():
    text = np.frombuffer(("".join(_soup(3)[5:30])).encode(), np.uint8)
    offsets = np.array([0, len(text)])
    per_start = []
    for block in (300, 1 << 20):
        (row, lo, n, bucket, _), _ = suffix_dedup.runs_of(text, offsets, 200, block)
        per_start.append({p: b for a, k, b in zip(lo, n, bucket, strict=True) for p in range(a, a + k)})
    assert per_start[0] == per_start[1] and len(per_start[0]) == len(text) - 199
    run, p, n, core, span = suffix_dedup._pieces(text, lo, n, 200, suffix_dedup.STEP)
    assert n.sum() == len(text) - 199 and n.max() <= suffix_dedup.STEP


def test_strings_that_meet_in_a_polynomial(spark):
    """A Thue-Morse string and its complement meet modulo 2**64; they aren't repeats of each other."""
    morse = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    texts = ["x" + morse[:1024] + "y", "z" + morse[1024:2048] + "w"]  # the second half is the first one's complement
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert [got[k] for k in range(2)] == _repeats(texts, 200)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    whole = suffix_dedup.PrimePrefix(data)
    a, b = whole.at(np.array([1, 1027]), np.array([1024, 1024]))
    plain = suffix_dedup.Prefix(data).at(np.array([1, 1027]), np.array([1024, 1024]))
    assert plain[0] == plain[1] and a != b


@pytest.mark.parametrize("hot", [0, 2])
def test_hot_buckets_are_joined_apart(spark, hot, monkeypatch):
    """The result doesn't depend on where a bucket counts as hot."""
    rnd = random.Random(4)
    line = "".join(rnd.choice("abcdef ") for _ in range(260))
    texts = [f"{k} " * rnd.randint(0, 40) + line[: rnd.randint(190, 260)] + f" {rnd.random()}" * rnd.randint(0, 20) for k in range(40)] + [line] * 5 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    usual = sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect())) == usual and sum(r[2] for r in usual) > 0


def test_merged_runs():
    spans = pa.array([[{"lo": 5, "n": 3}, {"lo": 0, "n": 1}], [], [{"lo": 0, "n": 2}, {"lo": 11, "n": 1}]], pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())])))
    row, begin, end = suffix_dedup.merged(np.array([0, 20, 30, 60]), spans, 10)
    assert (row.tolist(), begin.tolist(), end.tolist()) == ([0, 2], [0, 30], [17, 51])


def test_rows_that_repeat_are_spread_over_blocks(spark):
    df = spark.createDataFrame([(None, 100, "s", "c")] * 3000 + [(k, 50, None, None) for k in range(100)], "doc_id long, size long, source string, cluster string")
    got = packing.pack(df, "size", block=200).toPandas()
    assert len(got) == 3100 and (got[got.n_tokens == 100].groupby("bin_id").size() == 1).all()
    blocks = (got.bin_id // (1 << 32)).value_counts()
    assert len(blocks) == 16 and blocks.max() < 300
    assert got.groupby("bin_id").n_tokens.sum().max() <= packing.CAPACITY


def test_packing_fills_its_bins(spark, docs):
    got = packing.pack_documents(docs.withColumn("source", F.lit(None).cast("string"))).toPandas()
    full = got.groupby("bin_id").n_tokens.sum()
    assert full.sum() / packing.CAPACITY / len(full) > 0.85  # a lower bound of bins is their tokens by capacity


def test_keep_first_of_unlike_texts_with_one_id(spark):
    df = spark.createDataFrame([(1, "one text here", "a"), (1, "quite another one", "b"), (1, "one text here", "c"), (None, "third", "d"), (None, "third", "e"), (None, "fourth", "f"), (2, "third", "g")], "doc_id long, text string, other string")
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(df, groups=simhash.similar_texts).collect())
    assert kept == [(0, "fourth"), (1, "one text here"), (1, "quite another one"), (2, "third")]


def test_many_languages(spark):
    """More languages than any cap: each is known, and a long text goes through in blocks."""
    rows = [(f"{k}-{j}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{w}x" for w in "abcdefgh" * 3), f"l{k:03d}") for k in range(300) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = language_id.fit(df)
    assert len(model.langs) == 300
    got = language_id.identify(df, model, keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)
    refs = quality.references(df)
    assert len(refs.langs) == 300 and quality.quality_rules(df).count() == 600


def test_long_texts_are_labelled_in_blocks(docs):
    model = language_id.learned(docs)
    words = " ".join(r.text for r in docs.where("text IS NOT NULL").limit(30).collect()).split()
    names = sorted(set(words))
    ids = np.array([names.index(w) for w in words])
    vectors, weights = model.score(names)
    want = language_id.viterbi(vectors[ids], np.array([len(ids)]))
    labels, letters_of = language_id.long_labels(model, ids, names, block=101)
    assert (labels == want).all() and (letters_of == weights[ids]).all()


def test_distances_are_those_of_the_definition():
    rng = np.random.default_rng(0)
    words, shares = [["a", "b", "c"], ["b", "d"], []], [np.array([0.2, 0.1, 0.3, 0.4]), np.array([0.5, 0.2, 0.3]), np.array([1.0])]
    classes = rng.dirichlet(np.ones(len(quality.CLASSES)), 3)
    names, ids, per = ["A", "b!", "d", "zz", "--", "c"], rng.integers(0, 6, 60), np.array([20, 0, 30, 10])
    hist, row = rng.integers(0, 9, (4, len(quality.CLASSES))), np.repeat(np.arange(4), per)
    chars, got = quality.distances(quality.References(["x", "y", "z"], classes, words, shares), hist, ids, names, per)
    for t in range(4):
        own = [c for c in (quality.core(names[i]) for i in ids[row == t]) if c]
        for k in range(3):
            p = np.array([own.count(w) for w in words[k]] + [sum(c not in words[k] for c in own)], float) / max(len(own), 1)
            assert got[t, k] == pytest.approx(quality.js_distance(p, shares[k]) if own else 0, abs=1e-9)
            assert chars[t, k] == pytest.approx(quality.js_distance(hist[t] / hist[t].sum(), classes[k]))


# -- no row or answer lost by size ---------------------------------------------------------------

def test_sample_of_repeats_is_never_empty(spark):
    rows = spark.createDataFrame([(k % 2, f"copied text {k % 2}", "en" if k % 2 else "de") for k in range(200)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in common.sample_by_hash(rows, "doc_id", 20, "text").collect()) == [0, 1]
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    first, again = (sorted(r.doc_id for r in common.sample_by_hash(many.repartition(n), "doc_id", 100, "text").collect()) for n in (1, 5))
    assert first == again and len(first) == 100
    assert language_id.fit(rows, sample_rows=20).langs == ["de", "en"]
    assert common.sample_by_hash(many.where("false"), "doc_id", 10).count() == 0


def test_keep_first_with_clashing_names_and_ties(spark):
    shape = "doc_id long, text string, k1 string, k2 string, row string, doc string, _k1 string"
    rows = [(1, "one two three four five", "mine", *"bcde"), (1, "one two three four five", "mine", *"acde"), (2, "one two three four five", "mine", *"acde"), (3, "else", "x", *"acde")]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_first(spark.createDataFrame(order, shape), groups=simhash.similar_texts)
        assert sorted(map(tuple, kept.collect())) == [rows[1], rows[3]]


def test_broken_files_have_a_fault(spark):
    good = matroska.mux(b"\x01" * 576)
    files = [(1, good), (2, bytes.fromhex("1A45DFA3") + b"garbage"), (3, good[: len(good) // 2]), (4, b"no such file"), (5, None), (6, b"")]
    got = matroska.packets(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    whole = [r for r in got if r.doc_id == 1]
    assert whole and all(r.fault is None for r in whole)
    assert {r.doc_id for r in got if r.fault} >= {2, 4} and {r.doc_id for r in got} <= {1, 2, 3, 4}


# -- 7 pages of other shapes ---------------------------------------------------------------------

_LONG = "Words that make up a paragraph of the article, one after another, as there are some more of them. " * 2
_AROUND = '<div class="side"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div>'


def _text(body):
    return html_text.main_text(f"<html><body>{_AROUND}{body}{_AROUND}</body></html>").split("\n")


def test_an_article_keeps_what_is_in_it():
    p = f"<p>{_LONG}</p>"
    want = _LONG.strip()
    sources = "<ul><li><a href=x>First source</a></li><li><a href=y>Second source</a></li></ul>"
    assert _text(f"<article>{p}{p}{sources}</article>") == [want, want, "First source", "Second source"]
    assert _text(f'<article>{p}<div class="notice-board related"><p>On the notice board.</p></div>{p}</article>') == [want, "On the notice board.", want]
    assert _text(f"<article>{p}<p>It holds that <math><mi>a</mi><mo>=</mo><mi>b</mi></math> here.</p></article>") == [want, "It holds that a=b here."]
    # what the article's text is not
    assert _text(f'<article>{p}{p}<div class="ad"><p>Buy it</p></div><div class="related"><a href=z>More of this</a></div><section class="comments"><p>Nice!</p></section></article>') == [want, want]


def test_boxes_beside_each_other():
    p = f"<p>{_LONG}</p>"
    want = _LONG.strip()
    assert _text(f"<div><h1>The title of it all</h1><div>{p}{p}{p}</div><div><p>A last short box with some words of its own.</p></div></div>") == ["The title of it all", want, want, want, "A last short box with some words of its own."]
    assert _text(f'<div><div>{p}{p}{p}</div><div class="promo"><p>A short box with some words about an offer.</p></div></div>') == [want] * 3
    assert _text(f"<table><tr><td>{p}{p}</td></tr></table>") == [want, want]
    assert _text(f"<main><section><h2>One</h2>{p}</section><section><h2>Two</h2>{p}{p}</section></main>") == ["One", want, "Two", want, want]
    assert _text(f"<blockquote>{p}{p}</blockquote>") == [want, want]


@pytest.mark.parametrize("seed", range(12))
def test_heart_and_threshold_by_their_definition(seed):
    """The choice on random trees: heart, threshold and sums worked out again from the densities, node by node."""
    rng = random.Random(seed)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["<p>{}</p>", "<div>{}</div>", "<span>{}</span>", "<a href=x>{}</a>"]).format("word " * rng.randrange(1, 40))
        return "<div>" + "".join(some(depth - 1) for _ in range(rng.randrange(1, 4))) + "</div>"

    page = html_text.Page(some(4))
    density, sums = page.densities()
    n, parent = len(page.tag), page.parent
    kids = [[k for k in range(1, n) if parent[k] == j] for j in range(n)]
    assert all(abs(sums[j] - sum(density[k] for k in kids[j])) < 1e-9 for j in range(n))
    containers = [k for k in range(n) if page.tag[k] not in html_text._NO_CONTAINER]
    heart = min((k for k in containers if sums[k] == max(sums[j] for j in containers)))
    path = [heart]
    while parent[path[-1]] >= 0:
        path.append(parent[path[-1]])
    threshold = min(density[k] for k in path)

    def most(k):
        return max([sums[k], *(most(j) for j in kids[k])])

    def below(k):
        return [k, *(x for j in kids[k] for x in below(j))]

    links = {k: sum(page.tag[j] == "a" for j in below(k)) for k in range(n)}
    want = set(below(heart))
    for up in path[1:]:
        for k in kids[up]:
            own = up == parent[heart] and not links[k] and (page.tag[k] in html_text._PROSE or any(page.tag[j] in html_text._PROSE for j in kids[k]))
            if k not in path and density[k] >= threshold > 0 and (own or most(k) >= threshold):
                want |= set(below(k))
    # less what is mostly links and thin
    total = page.links[0][1]
    for k in sorted(want - set(path)):
        lc, c, lt = page.links[k]
        if density[k] < threshold and lt > 1 and 2 * lc > c and page.tag[k] not in html_text._INLINE and 2 * c <= total:
            want -= set(below(k))
    assert {k for k, x in enumerate(page.inside()) if x and page.chars[k]} == {k for k in want if page.chars[k]}
