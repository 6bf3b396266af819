"""The pipeline's stages on a small corpus, each against the plain statement of what it does."""

import hashlib

import corpus_pipeline
import __spark_entry__
from tidewatch.llm import language_id, quality, simhash, suffix_dedup


def first_of_each(docs) -> list:
    """Smallest id of each group of texts linked by 80 % of their five-word shingles, by all pairs."""
    rows = sorted((r.doc_id, set(simhash.shingles(r.text, 5).tolist())) for r in docs.select("doc_id", "text").collect())
    label = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [rows[k][0] for k in sorted(set(label))]


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stage["quality rules"](spark, docs, small).cache()
    assert good.columns == docs.columns and ids(good) == ids(quality.quality_rules(docs).where("kept"))
    named = stage["language ID"](spark, good, small).cache()
    assert named.columns == docs.columns and ids(named) == ids(language_id.identify(good, language_id.learned(good)).where("lang_pred <> 'und' AND score >= 0.5"))
    single = stage["SimHash near-dedup"](spark, named, small).cache()
    assert single.columns == docs.columns and ids(single) == first_of_each(named)
    left = stage["suffix-array dedup"](spark, single, small).cache()
    assert left.columns == docs.columns and ids(left) == ids(single)
    digest = {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(single).collect()}
    cut = sum(hashlib.sha256(r.text.encode()).hexdigest() != digest[r.doc_id] for r in left.collect())
    assert cut <= left.count() // 10  # only where a removed span cuts a character
    packed = stage["best-fit packing"](spark, left, small)
    assert ids(packed.where("piece = 0")) == ids(left)


def test_run_and_registration(spark, small):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 11)} <= {q[: q.index("_") + 1] for q in __spark_entry__.queries() if q.startswith("op")}
    assert corpus_pipeline.run(spark, small).count() > 0


def test_empty_and_odd_input(spark, small, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (2, "x " * 60, "en", None, 120), (2, "x " * 60, "en", None, 120)]
    for k, data in enumerate(([], rows)):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame(data, shape).write.parquet(f"{path}/documents.parquet")
        corpus_pipeline.run(spark, path).collect()
