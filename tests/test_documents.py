"""Documents, chunks, markings, vectors, citations and reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as rules
from tidewatch.operators import documents, report, vectors

MEMO = "---\ndoc_id: m1\ntitle: A memo\nclassification: UNCLASSIFIED // SYNTHETIC\npublisher: P\ndoc_type: memo\nlanguage: en\naoi: [north, south]\n---\n# Head\n\nText.\n"


def test_memo(spark, tmp_path):
    got = documents.parse_memo(MEMO)
    assert got["doc_id"] == "m1" and got["aoi"] == ["north", "south"] and got["origin"] == "real" and got["text"].startswith("# Head")
    for bad in ("no front matter", MEMO.replace("title: A memo\n", ""), MEMO.replace("UNCLASSIFIED", "ODD"), MEMO.split("# Head")[0]):
        with pytest.raises(documents.CorpusError):
            documents.parse_memo(bad)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text(MEMO)
    (tmp_path / "sub" / "b.md").write_text(MEMO.replace("m1", "m0"))
    assert [r.doc_id for r in documents.read_corpus(spark, str(tmp_path)).collect()] == ["m0", "m1"]
    (tmp_path / "c.md").write_text(MEMO)
    with pytest.raises(documents.CorpusError, match="m1"):
        documents.read_corpus(spark, str(tmp_path))


def test_markings(spark):
    df = spark.createDataFrame([("unclassified",), ("UNCLASSIFIED // SYNTHETIC",), ("Secret // noforn // NOFORN",)], "m string")
    assert [r[0] for r in df.select(rules.checked_marking(F.col("m"))).collect()] == ["UNCLASSIFIED", "UNCLASSIFIED // SYNTHETIC", "SECRET // NOFORN"]
    assert df.agg(rules.combined_marking(F.col("m"))).first()[0] == "SECRET // NOFORN // SYNTHETIC"
    assert df.where("false").agg(rules.combined_marking(F.col("m"))).first()[0] == "UNCLASSIFIED"
    with pytest.raises(Exception, match="unknown marking"):
        spark.range(1).select(rules.checked_marking(F.lit("odd"))).collect()


def cleaned(spark, pages):
    return documents.clean_pages(spark.createDataFrame([(1, pages)], "id int, pages array<string>")).first().text


def test_page_cleaning(spark):
    pages = [f"\nOfficial Journal L 229/{k}\n\nBody of page {'abcdefghij'[k]} with words\nmore of it\nand more\nstill more\nthe end of it\n{k}" for k in range(10)]
    text = cleaned(spark, pages)
    assert "Journal" not in text and "Body of page c" in text and "\n7\n" not in text
    assert cleaned(spark, pages[:2]) == cleaned(spark, ["\n".join(pages[:2])]) and "229/1" in cleaned(spark, pages[:2])
    assert cleaned(spark, ["INHERENT LIMITS\nThe ves-\nsel is\nseen.\n\n(a) one\n(b) two"]) == "## INHERENT LIMITS\n\nThe vessel is seen.\n\n(a) one\n(b) two"
    df = spark.createDataFrame([("HAS ADOPTED THIS REGULATION:",), ("AB",), ("Mixed CASE",)], "line string")
    assert [r[0] for r in df.select(rules.is_caps_heading(F.col("line"))).collect()] == [True, False, False]
    md = '!!! note "Mind"\n    inside\nafter ![x](y.png) text [@key2020] <br> {.wide}\n\n\n\nend'
    rows = spark.createDataFrame([(1, md, "same"), (1, md, "same"), (2, None, None), (3, "", "x"), (4, "??? my_note\n\n\tdeep\nout", None)], "id int, text string, other string")
    plain = "**Mind:**\ninside\nafter  text\n\nend"
    got = documents.clean_markdown(rows).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, plain, "same"), (1, plain, "same"), (2, None, None), (3, "", "x"), (4, "**My_Note:**\n\ndeep\nout", None)]
    assert documents.clean_markdown(rows.where("false")).count() == 0


def test_page_cleaning_of_odd_documents(spark):
    odd = [(1, None), (2, []), (3, [None, "a-\n-\nb", ""]), (4, ["x\r\n\r\ny\u2028z"]), (5, ["12", "text here", "Page 3/9", "- 4 -"])]
    df = spark.createDataFrame(odd, "id int, pages array<string>")
    assert {r.id: r.text for r in documents.clean_pages(df.union(df)).collect()} == {1: None, 2: "", 3: "ab", 4: "x\n\ny z", 5: "text here"}
    assert documents.clean_pages(df.union(df)).count() == 10


def blocks_of(spark, text):
    rows = documents.blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("block").collect()
    return [(r.text, tuple(r.path)) for r in rows]


def chunks_of(spark, text):
    rows = documents.chunk_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("ordinal").collect()
    return [(r.text, r.heading, r.char_start, r.char_end) for r in rows]


def test_blocks_and_chunks(spark):
    text = "# A\n\npara one\n\n## B\n\n| t |\n| u |\n\n```\ncode\n\n# no head\n```\ntail"
    assert blocks_of(spark, text) == [("para one", ("A",)), ("| t |\n| u |", ("A", "B")), ("```\ncode\n\n# no head\n```", ("A", "B")), ("tail", ("A", "B"))]
    assert blocks_of(spark, "### C\na\n~~~~\n```\n~~~\nb\n~~~~\nc\n## D\n#### E\n# F\nd\n```\nopen") == [("a", ("C",)), ("~~~~\n```\n~~~\nb\n~~~~", ("C",)), ("c", ("C",)), ("d", ("F",)), ("```\nopen", ("F",))]
    long = "# H\n\n" + "\n\n".join(f"Sentence number {k} of the text. " * 9 for k in range(20)) + "\n\n" + "x" * 4000
    chunks = chunks_of(spark, long)
    assert all(len(c[0]) <= 1500 + 202 for c in chunks) and "".join(c[0] for c in chunks).count("x") >= 4000
    assert chunks[0][2:] == (0, len(chunks[0][0])) and all(a[3] == b[2] for a, b in zip(chunks, chunks[1:], strict=False)) and chunks[0][1] == "H"
    two = chunks_of(spark, "# A\n\n" + "a " * 250 + "\n\nshort tail\n\n# B\n\nnext")
    assert [c[1] for c in two] == ["A", "A"] and two[1][0] == "short tail\n\nnext"
    assert [len(c[0]) for c in chunks_of(spark, "\n\n".join(["z" * 1490] * 2))] == [1490]  # the last says the same
    df = spark.createDataFrame([("d", long), ("e", None), ("f", ""), ("d2", long)], "doc_id string, text string")
    rows = documents.chunk_documents(df).orderBy("doc_id", "chunk_id").collect()
    assert [r.chunk_id for r in rows] == [f"{d}#{k:04d}" for d in ("d", "d2") for k in range(len(chunks))]
    pieces = spark.createDataFrame([("a. " * 600 + "\n" + "b" * 1600,)], "t string").select(documents.pieces(F.col("t"))).first()[0]
    assert [len(p) for p in pieces] == [1499, 1500, 401] and "".join(pieces).count("b") == 1600


def test_rates(spark):
    said = ["25% of detections were dark", "One in four detections had no AIS", "75 percent of detections matched", "the dark-vessel rate is high", "25% of detections do not have correspondence"]
    fine = ["15 of 60 detections had no AIS correspondence", "The vessel was dark", "rates of exchange", "10% of the sea is deep", None]
    df = spark.createDataFrame([(t,) for t in said + fine], "text string")
    kept, removed = report.scrub(df)
    assert {r.text for r in removed.collect()} == set(said) and kept.count() == len(fine)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"c{k:03d}", [float(v) for v in x[k]], "de" if k % 2 else "en", ["a", "b"] if k % 3 else ["c"]) for k in range(200)], "chunk_id string, embedding array<float>, language string, aoi array<string>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit[5]
    got = vectors.top_k(df, x[5].tolist(), 8).collect()
    assert [r.chunk_id for r in got] == [f"c{k:03d}" for k in np.argsort(-score)[:8]] and got[0].score == pytest.approx(1)
    only = vectors.top_k(df, x[5].tolist(), 300, {"language": "de", "aoi": ["c", "z"], "none": None}, min_score=0.0).collect()
    assert {int(r.chunk_id[1:]) for r in only} == {k for k in range(200) if k % 2 and k % 3 == 0 and score[k] >= 0}
    batch = vectors.top_k_batch(df, x[:3], [0, 1, 2], 4, "chunk_id").where("query_id = 2").orderBy("rank").collect()
    assert [r.chunk_id for r in batch] == [f"c{k:03d}" for k in np.argsort(-(unit @ unit[2]))[:4]]
    zero = df.union(spark.createDataFrame([("zero", [0.0] * 8, "de", ["a"]), ("null", None, "de", ["a"])], df.schema)).repartition(3)
    joined = vectors.top_k_join(zero, df.where("chunk_id < 'c007'"), 4, "chunk_id", query_id="chunk_id", query_rows=3, vector_rows=16).collect()
    for j in range(7):
        best = sorted((r["rank"], r.chunk_id, r.score) for r in joined if r.query_id == f"c{j:03d}")
        order = np.argsort(-(unit @ unit[j]))[:4]
        assert [b[1] for b in best] == [f"c{k:03d}" for k in order] and [b[2] for b in best] == pytest.approx((unit @ unit[j])[order], abs=1e-6)
    assert vectors.top_k_join(df, df.where("false"), 4, "chunk_id", query_id="chunk_id").count() == 0
    assert {r.value: r.n for r in vectors.facets(df, "aoi").collect()} == {"a": 133, "b": 133, "c": 67}
    made = vectors.embedded(spark.createDataFrame([("a b b",), (None,)], "text string"), vectors.HashingEmbedder(16)).collect()
    assert sum(made[0].embedding) == 3 and sum(made[1].embedding) == 0
    ids = spark.createDataFrame([("c",), ("c",), ("d",)], "c string").select(vectors.point_id("c")).distinct().count()
    assert ids == 2


def test_citations_and_context(spark):
    claims = spark.createDataFrame([(1, 1, "good", ["a", "zz", "b", "a"]), (1, 2, "invented", ["yy"]), (1, 3, " ", ["a"]), (1, 4, "none", [])], "q long, claim_no long, text string, chunk_ids array<string>")
    known = spark.createDataFrame([(1, "a"), (1, "b")], "q long, chunk_id string")
    kept, dropped = vectors.verify_claims(claims, known, "q")
    assert [(r.claim_no, r.chunk_ids) for r in kept.collect()] == [(1, ["a", "b"])] and {r.chunk_id for r in dropped.collect()} == {"zz", "yy"}
    asked = spark.createDataFrame([(1, True), (2, True), (3, False)], "q long, supported boolean")
    assert {r.q: (r.answered, r.refusal) for r in vectors.answered(kept, asked, "q").collect()} == {1: (True, None), 2: (False, vectors.REFUSAL), 3: (False, vectors.REFUSAL)}
    chunks = spark.createDataFrame([(k, f"d#{k:04d}", "UNCLASSIFIED", "T", "x" * n) for k, n in enumerate((10, 5000, 9000, 10))], "rank int, chunk_id string, classification string, title string, text string").withColumn("q", F.lit(1))
    assert [r.rank for r in vectors.context(chunks, "q").orderBy("rank").collect()] == [0, 1]


def test_report(spark):
    matches = spark.createDataFrame([("d1", "matched", "1", True, "archive", 30.0), ("d2", "dark", None, False, "archive", 50.0)], "detection_id string, status string, mmsi string, source_is_ground_truth boolean, source string, length_m double")
    chunks = spark.createDataFrame([("a", "UNCLASSIFIED // SYNTHETIC"), ("b", "SECRET")], "chunk_id string, classification string")
    claims = spark.createDataFrame([(1, "A vessel was seen", ["a"]), (2, "50% of detections were dark", ["b"])], "claim_no long, text string, chunk_ids array<string>")
    r = report.report(matches, chunks, claims, "north", "2026-07-17").first()
    assert r.claims == ["A vessel was seen"] and r.removed_claims == 1 and r.leads == ["d2"] and r.classification == "UNCLASSIFIED // SYNTHETIC"
    assert not r.releasable and not r.quotable and len(r.reasons) == 2 and r.unmatched.startswith("1 of 2")


def test_joined_top_k_in_slices_of_scores(spark, monkeypatch):
    """A pair of blocks is scored a few queries at a time; what is found doesn't depend on the slices, ties included."""
    from tidewatch.operators import vectors

    rows = [(k, [float((k * 7) % 5), float(k % 3), 1.0]) for k in range(60, 0, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    for scores in (1, 25, 1 << 17):
        monkeypatch.setattr(vectors, "SCORES", scores)
        got = vectors.top_k_join(df, df.where("vec_id % 4 = 0"), 3, query_rows=5, vector_rows=8).collect()
        assert len(got) == 45
        for q in range(4, 61, 4):
            want = sorted(unit, key=lambda k: (-round(float(unit[k] @ unit[q]), 9), k))[:3]
            assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_columns_not_selected_are_not_carried(spark):
    df = spark.createDataFrame([(1, ["A\nb", "c"], "x"), (2, None, "y")], "id int, pages array<string>, other string")
    cleaned = documents.clean_pages(df)
    assert sorted((r.id, r.pages, r.other) for r in cleaned.collect()) == [(1, ["A\nb", "c"], "x"), (2, None, "y")]
    plan = cleaned.select("id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max(") == 1  # of the id only
