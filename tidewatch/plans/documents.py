"""Queries of documents, vectors, citations, reports and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as rules
from ..operators import documents, manifest, report, vectors
from .derived import read


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return read(spark, sf_dir, "embeddings").join(docs, "vec_id", "left")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 6).alias("score"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(vectors.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 8, id_col="vec_id"))


def cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(vectors.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 8, {"lang": ["de", "fr"], "source": None}, id_col="vec_id"))


def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(vectors.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 8, min_score=0.2, id_col="vec_id"))


def cosine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all."""
    rows = read(spark, sf_dir, "embeddings")
    found = vectors.top_k_join(rows, rows.where("vec_id % 100 = 0"), 5)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.facets(read(spark, sf_dir, "documents"), "source")


def facets_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.array("lang", F.concat("lang", F.lit("-"), "source")).alias("aoi"))
    return vectors.facets(d, "aoi")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("long").alias("v"), F.lit(0).alias("ingested_at"))
    new = read(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 100000).cast("string").alias("chunk_id"), (F.col("label") + 10).cast("long").alias("v"), F.lit(1).alias("ingested_at"))
    return vectors.upsert(old, new.union(new.withColumn("v", F.col("v") + 5).withColumn("ingested_at", F.lit(2))))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("doc-"), ((c + k * F.col("turn")) % 40).cast("string"), F.lit("#0000")))
    return read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("claim_no"), "text", ids.alias("chunk_ids"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("item_id")
    return read(spark, sf_dir, "benchmark").where("item_id % 3 <> 1").select(F.concat(F.lit("doc-"), (b % 40).cast("string"), F.lit("#0000")).alias("chunk_id"))


def _known(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(conv_id, chunk_id): of what a conversation's claims cite, what was retrieved; the same chunks for every conversation."""
    cited = claims.select("conv_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    return cited.join(retrieved.distinct(), "chunk_id", "left_semi")


def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    kept, _ = vectors.verify_claims(claims, _known(claims, _retrieved(spark, sf_dir)), "conv_id")
    return kept.select("conv_id", "claim_no", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def citation_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    return vectors.verify_claims(claims, _known(claims, _retrieved(spark, sf_dir)), "conv_id")[1]


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit("#0000")).alias("chunk_id"), F.lit("UNCLASSIFIED").alias("classification"), F.lit(None).cast("string").alias("title"), "text", F.col("doc_id").alias("rank"))
    return vectors.context(d, "source").select("source", "chunk_id", "used")


def _marked(k: Column) -> Column:
    level = F.when(k % 97 == 0, "secret").when(k % 31 == 0, "Confidential").otherwise("UNCLASSIFIED")
    return F.concat(level, F.when(k % 5 == 0, " // synthetic").otherwise(""), F.when(k % 13 == 0, " // NOFORN // SYNTHETIC").otherwise(""))


def marking_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(rules.combined_marking(_marked(F.col("doc_id"))).alias("marking"))


def cited_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marking of what each conversation cites, its chunks being those of the documents."""
    chunks = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("#0000")).alias("chunk_id"), _marked(F.col("doc_id")).alias("classification"))
    return report.cited_marking(_claims(spark, sf_dir), chunks, "conv_id")


def digit_blind_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("source", rules.digit_blind(F.trim("line")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3 AND length(key) BETWEEN 1 AND 100")


def caps_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(rules.is_caps_heading(F.col("line"))).select("doc_id", "pos")


def rate_claim_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    claim = F.concat(F.col("source"), F.when(k % 4 == 0, " saw 12.5 % of detections unmatched").when(k % 4 == 1, ": 15 of 60 detections had no AIS correspondence").when(k % 4 == 2, ": the dark-vessel rate is one in four").otherwise(": rates of exchange"))
    kept, _ = report.scrub(read(spark, sf_dir, "documents").select("doc_id", claim.alias("text")))
    return kept


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_documents(read(spark, sf_dir, "documents"))


def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.clean_markdown(read(spark, sf_dir, "documents").select("doc_id", "text"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\.\n").alias("pages"))
    return documents.clean_pages(d).select("doc_id", "text")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("publisher"), F.lit("real").alias("origin"), F.col("lang").alias("language"), "text")
    return documents.stats(d)


def manifest_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("o_orderkey"), F.col("l_orderkey")
    listed = read(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(k.cast("string").alias("path"), (k % 1000).alias("bytes"), F.sha2(k.cast("string"), 256).alias("sha256"))
    there = read(spark, sf_dir, "lineitem").where("l_linenumber = 1 OR l_orderkey % 50 = 0").select(line.cast("string").alias("path"), ((line + F.when(line % 11 == 0, 1).otherwise(0)) % 1000).alias("bytes"), F.sha2(F.when(line % 13 == 0, F.concat(line.cast("string"), F.lit("x"))).otherwise(line.cast("string")), 256).alias("sha256"))
    return manifest.verify(listed, there).select("path", "want_bytes", "found_bytes", "copies", "refusal")


def manifest_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.by_kind(read(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("bytes")))


QUERIES = {f.__name__: f for f in (cosine_topk, cosine_filtered, score_floor, cosine_batch, facets, facets_list, vector_upsert, citation_verify, citation_dropped, context_budget, marking_combine, cited_marking, digit_blind_heads, caps_headings, rate_claim_scrub, chunk_documents, clean_markdown, clean_pages, corpus_stats, manifest_set_equality, manifest_kinds)}

_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_TOP = f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE %s ORDER BY {_COS} DESC, e.vec_id LIMIT 8"
_CLAIMS = """claims AS (SELECT conv_id, turn AS claim_no, trim(text) AS text, unnest([0, 1, 2]) AS pos, unnest(['doc-' || (conv_id % 40) || '#0000', 'doc-' || ((conv_id + turn) % 40) || '#0000', 'doc-' || ((conv_id + 2 * turn) % 40) || '#0000']) AS chunk_id FROM conversations WHERE length(trim(text)) > 0),
  known AS (SELECT DISTINCT 'doc-' || (item_id % 40) || '#0000' AS chunk_id FROM benchmark WHERE item_id % 3 <> 1)"""
_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"regexp_replace(%s, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_CLOSED = _STRIP % r"regexp_replace(%s, '\n{3,}', chr(10) || chr(10), 'g')"
_CAPS = r"length(s) BETWEEN 3 AND 80 AND length(regexp_replace(s, '\P{L}', '', 'g')) >= 3 AND regexp_full_match(regexp_replace(s, '\P{L}', '', 'g'), '\p{Lu}+') AND NOT regexp_matches(s, '^(?:[-*•]|\(\w{1,3}\)|\d{1,3}[.)]|\|)\s')"
_CLEAN_PAGES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(text, '\\.\\n') AS ps FROM documents),
pg AS (SELECT r, len(ps) AS n, generate_subscripts(ps, 1) AS page, unnest(ps) AS t FROM d),
ln AS (SELECT r, n, page, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT *, regexp_split_to_array(t || CASE WHEN n >= 3 THEN chr(10) ELSE '' END, '{_END}') AS ls FROM pg)),
st AS (SELECT r, n, page, pos, {_STRIP % "line"} AS s FROM ln),
rk AS (SELECT *, row_number() OVER (PARTITION BY r, page, s <> '' ORDER BY pos) AS up, row_number() OVER (PARTITION BY r, page, s <> '' ORDER BY pos DESC) AS down, greatest(1, least(6, count(*) OVER (PARTITION BY r, page, s <> '') // 3)) AS m FROM st),
ed AS (SELECT *, s <> '' AND up <= m AS top, s <> '' AND down <= m AS foot, regexp_replace(s, '[0-9]+', '#', 'g') AS key FROM rk),
se AS (SELECT *, sum(top::INT + foot::INT) OVER (PARTITION BY r, key) AS seen FROM ed),
kp AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN {_CAPS} THEN 'heading' WHEN regexp_matches(s, '^(?:[-*•]|\\(\\w{{1,3}}\\)|\\d{{1,3}}[.)]|\\|)\\s') THEN 'item' ELSE 'text' END AS kind FROM se
  WHERE NOT (n >= 3 AND (top OR foot) AND ((seen >= greatest(3, floor(n * 0.3)) AND length(key) <= 100) OR regexp_matches(s, '(?i)^\\s*[-—–\\[(]?\\s*(?:page\\s*)?\\d{{1,4}}\\s*(?:/\\s*\\d{{1,4}})?\\s*[-—–\\])]?\\s*$')))),
nx AS (SELECT *, kind = 'text' AND lead(kind) OVER (PARTITION BY r ORDER BY page, pos) IS NOT DISTINCT FROM 'text' AS on_ FROM kp),
mk AS (SELECT r, page, pos, CASE WHEN kind = 'heading' THEN chr(10) || '## ' || s || chr(10) || chr(10) WHEN on_ AND regexp_matches(s, '[\\x{{ad}}-]$') THEN regexp_replace(s, '[\\x{{ad}}-]+$', '') WHEN on_ THEN s || ' ' ELSE s || chr(10) END AS part FROM nx),
jn AS (SELECT r, string_agg(part, '' ORDER BY page, pos) AS t FROM mk GROUP BY r)
SELECT doc_id, CASE WHEN ps IS NULL THEN NULL ELSE coalesce({_CLOSED % "t"}, '') END AS text FROM d LEFT JOIN jn USING (r)"""
_LEAD = r"^(\s*)(?:!!!|\?\?\?\+?)\s+(\w+)(?:\s+\"([^\"]*)\")?\s*$"
_CLEAN_MARKDOWN = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_split_to_array(text, '{_END}') AS ls FROM documents),
ln AS (SELECT r, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
ld AS (SELECT *, regexp_matches(line, '{_LEAD}') AS leads, length(line) - length(regexp_replace(line, '^{_SPACE}+', '')) AS indent, {_STRIP % "line"} AS s FROM ln),
of AS (SELECT *, max(CASE WHEN leads THEN pos END) OVER (PARTITION BY r ORDER BY pos) AS lead_at FROM ld),
dp AS (SELECT *, first_value(indent) OVER (PARTITION BY r, lead_at ORDER BY pos) AS depth FROM of),
ins AS (SELECT *, lead_at IS NOT NULL AND NOT bool_or(NOT leads AND s <> '' AND indent <= depth) OVER (PARTITION BY r, lead_at ORDER BY pos) AS inside FROM dp),
mk AS (SELECT r, pos, CASE WHEN leads THEN '**' || CASE WHEN regexp_extract(line, '{_LEAD}', 3) <> '' THEN regexp_extract(line, '{_LEAD}', 3)
    ELSE list_aggregate(list_transform(regexp_extract_all(regexp_extract(line, '{_LEAD}', 2), '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') END || ':**'
  WHEN inside THEN s ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[@[^\\]]+\\]', '', 'g'), '(?i)</?(?:figure|figcaption|div|span|br|small)[^>]*>', '', 'g'), '\\{{\\s*[.#][^}}]*\\}}\\s*$', ''), '{_SPACE}+$', '') END AS part FROM ins),
jn AS (SELECT r, string_agg(part, chr(10) ORDER BY pos) AS t FROM mk GROUP BY r)
SELECT doc_id, {_CLOSED % "t"} AS text FROM d LEFT JOIN jn USING (r)"""
_MARK, _HEAD = r"^\s*(```+|~~~+)", r"^(#{1,6})\s+(.*?)\s*#*\s*$"
# Fences, headings, cuts and chunks, each as a recursion that goes through a document in order.
_CHUNK_DOCUMENTS = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS VARCHAR) AS doc_id, regexp_split_to_array(text, '{_END}') AS ls FROM documents),
ln AS (SELECT r, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
mk AS (SELECT r, pos, regexp_extract(line, '{_MARK}', 1) AS mark, {_STRIP % "line"} AS s, row_number() OVER (PARTITION BY r ORDER BY pos) AS k FROM ln WHERE regexp_matches(line, '{_MARK}')),
fence(r, k, pos, held, opens, closes) AS (SELECT r, k, pos, mark, true, false FROM mk WHERE k = 1 UNION ALL
  SELECT m.r, m.k, m.pos, CASE WHEN f.held = '' THEN m.mark WHEN starts_with(m.s, f.held) THEN '' ELSE f.held END, f.held = '', f.held <> '' AND starts_with(m.s, f.held) FROM fence f JOIN mk m ON m.r = f.r AND m.k = f.k + 1),
fl AS (SELECT ln.*, coalesce(opens, false) AS opens, coalesce(closes, false) AS closes, coalesce(last_value(held IGNORE NULLS) OVER (PARTITION BY ln.r ORDER BY ln.pos), '') <> '' AS fenced FROM ln LEFT JOIN fence f ON f.r = ln.r AND f.pos = ln.pos),
hd AS (SELECT *, CASE WHEN NOT fenced AND NOT closes AND regexp_matches(line, '{_HEAD}') THEN length(regexp_extract(line, '{_HEAD}', 1)) END AS level, {_STRIP % f"regexp_extract(line, '{_HEAD}', 2)"} AS title, {_STRIP % "line"} AS s FROM fl),
hn AS (SELECT r, pos, level, title, row_number() OVER (PARTITION BY r ORDER BY pos) AS k FROM hd WHERE level IS NOT NULL),
path(r, k, pos, p) AS (SELECT r, k, pos, [title] FROM hn WHERE k = 1 UNION ALL SELECT h.r, h.k, h.pos, list_append(p[1 : h.level - 1], h.title) FROM path q JOIN hn h ON h.r = q.r AND h.k = q.k + 1),
bd AS (SELECT hd.r, hd.pos, line, fenced OR closes OR (level IS NULL AND s <> '') AS body, opens, closes, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY hd.r ORDER BY hd.pos), []) AS p FROM hd LEFT JOIN path q ON q.r = hd.r AND q.pos = hd.pos),
bs AS (SELECT *, body AND (opens OR NOT coalesce(lag(body AND NOT closes) OVER (PARTITION BY r ORDER BY pos), false)) AS starts FROM bd),
bn AS (SELECT *, sum(starts::INT) OVER (PARTITION BY r ORDER BY pos) AS block FROM bs),
bt AS (SELECT r, block, {_STRIP % "string_agg(line, chr(10) ORDER BY pos)"} AS t, first(p ORDER BY pos) AS p FROM bn WHERE body GROUP BY r, block),
cut(r, block, part, piece, rest) AS (SELECT r, block, 0, NULL::VARCHAR, t FROM bt WHERE t <> '' UNION ALL
  SELECT r, block, part + 1, CASE WHEN length(rest) <= 1500 THEN rest ELSE {_STRIP % "rest[1 : upto]"} END, CASE WHEN length(rest) <= 1500 THEN '' ELSE regexp_replace(rest[upto + 1 :], '^{_SPACE}+', '') END
  FROM (SELECT *, CASE WHEN b >= 500 THEN b + 1 ELSE 1500 END AS upto FROM (SELECT *, length(regexp_extract(rest[1 : 1500], '(?s)^(.*)(?:\\n|[.;] )', 1)) AS b FROM cut WHERE rest <> ''))),
pc AS (SELECT r, list(piece ORDER BY block, part) AS ts, list(length(piece) ORDER BY block, part) AS ns, list(p ORDER BY block, part) AS ps FROM cut JOIN bt USING (r, block) WHERE part > 0 GROUP BY r),
pack(r, i, a, b0, b1) AS (SELECT r, 1, 1, NULL::BIGINT, NULL::BIGINT FROM pc UNION ALL
  SELECT r, i + 1, CASE WHEN NOT ends THEN a WHEN k = i - a + 1 THEN i + 1 ELSE i + 1 - k END, CASE WHEN ends THEN a END, CASE WHEN ends THEN i END FROM (
    SELECT *, size + ns[i + 1] + 2 > 1500 OR (ps[i + 1] <> ps[i] AND size >= 400) AS ends, len(list_filter(range(1, least(i - a + 1, 100) + 1), lambda k: list_sum(ns[i - k + 1 : i]) + 2 * greatest(k - 2, 0) <= 200)) AS k
    FROM (SELECT pack.r, i, a, ns, ps, list_sum(ns[a : i]) + 2 * (i - a) AS size FROM pack JOIN pc USING (r) WHERE i < len(ns)))),
ends AS (SELECT r, b0 AS a, b1 AS b FROM pack WHERE b0 IS NOT NULL UNION ALL SELECT r, pack.a, i FROM pack JOIN pc USING (r) WHERE i = len(ns)),
ch AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY b) - 1 AS ordinal, count(*) OVER (PARTITION BY r) AS n, array_to_string(ts[a : b], chr(10) || chr(10)) AS text, array_to_string(ps[a], ' › ') AS heading FROM ends JOIN pc USING (r)),
nb AS (SELECT *, lag(text) OVER (PARTITION BY r ORDER BY ordinal) AS was, sum(length(text)) OVER (PARTITION BY r ORDER BY ordinal) AS stop FROM ch)
SELECT doc_id, doc_id || '#' || CASE WHEN ordinal < 10000 THEN lpad(CAST(ordinal AS VARCHAR), 4, '0') ELSE CAST(ordinal AS VARCHAR) END AS chunk_id, CAST(ordinal AS INTEGER) AS ordinal, text, heading, CAST(stop - length(text) AS INTEGER) AS char_start, CAST(stop AS INTEGER) AS char_end
FROM nb JOIN d USING (r) WHERE ordinal < n - 1 OR text IS DISTINCT FROM was"""
SQL = {
    "clean_pages": _CLEAN_PAGES,
    "clean_markdown": _CLEAN_MARKDOWN,
    "chunk_documents": _CHUNK_DOCUMENTS,
    "cosine_topk": _TOP % "true",
    "cosine_filtered": _TOP % "d.lang IN ('de', 'fr')",
    "score_floor": _TOP % f"{_COS} >= 0.2",
    "cosine_batch": f"SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 5",
    "facets": "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "facets_list": "SELECT value, count(*) AS n FROM (SELECT unnest([lang, lang || '-' || source]) AS value FROM documents) WHERE value IS NOT NULL GROUP BY 1",
    "vector_upsert": """WITH new AS (SELECT CAST(CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE vec_id + 100000 END AS VARCHAR) AS chunk_id, CAST(label + 15 AS BIGINT) AS v, 2 AS ingested_at FROM embeddings WHERE vec_id % 3 = 0)
        SELECT * FROM new UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(label AS BIGINT), 0 FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT chunk_id FROM new)""",
    "citation_verify": f"WITH {_CLAIMS}, firsts AS (SELECT conv_id, claim_no, chunk_id, min(pos) AS pos FROM claims JOIN known USING (chunk_id) GROUP BY ALL) SELECT conv_id, claim_no, string_agg(chunk_id, ',' ORDER BY pos) AS chunk_ids FROM firsts GROUP BY ALL",
    "citation_dropped": f"WITH {_CLAIMS} SELECT DISTINCT conv_id, chunk_id FROM claims WHERE chunk_id NOT IN (SELECT chunk_id FROM known)",
    "context_budget": """WITH b AS (SELECT source, doc_id, doc_id || '#0000' AS chunk_id, length('[' || doc_id || '#0000] (UNCLASSIFIED) ' || doc_id || chr(10) || text) AS n FROM documents),
        r AS (SELECT source, chunk_id, CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM b) SELECT * FROM r WHERE used <= 14000""",
    "marking_combine": """WITH m AS (SELECT source, CASE WHEN doc_id % 97 = 0 THEN 3 WHEN doc_id % 31 = 0 THEN 2 ELSE 0 END AS rank, doc_id % 5 = 0 OR doc_id % 13 = 0 AS syn, doc_id % 13 = 0 AS nof FROM documents)
        SELECT source, ['UNCLASSIFIED', 'RESTRICTED', 'CONFIDENTIAL', 'SECRET'][max(rank) + 1] || CASE WHEN bool_or(nof) THEN ' // NOFORN' ELSE '' END || CASE WHEN bool_or(syn) THEN ' // SYNTHETIC' ELSE '' END AS marking FROM m GROUP BY 1""",
    "cited_marking": """WITH c AS (SELECT DISTINCT conv_id, unnest([conv_id % 40, (conv_id + turn) % 40, (conv_id + 2 * turn) % 40]) AS doc_id FROM conversations),
        m AS (SELECT conv_id, CASE WHEN doc_id % 97 = 0 THEN 3 WHEN doc_id % 31 = 0 THEN 2 ELSE 0 END AS rank, doc_id % 5 = 0 OR doc_id % 13 = 0 AS syn, doc_id % 13 = 0 AS nof FROM c JOIN documents USING (doc_id))
        SELECT conv_id, ['UNCLASSIFIED', 'RESTRICTED', 'CONFIDENTIAL', 'SECRET'][max(rank) + 1] || CASE WHEN bool_or(nof) THEN ' // NOFORN' ELSE '' END || CASE WHEN bool_or(syn) THEN ' // SYNTHETIC' ELSE '' END AS classification FROM m GROUP BY 1""",
    "digit_blind_heads": f"WITH {_LINES} SELECT source, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS key, count(*) AS n FROM lines GROUP BY 1, 2 HAVING n >= 3 AND length(key) BETWEEN 1 AND 100",
    "caps_headings": rf"""WITH {_LINES}, s AS (SELECT doc_id, pos, trim(line) AS s, regexp_replace(trim(line), '\P{{L}}', '', 'g') AS letters FROM lines)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM s WHERE length(s) BETWEEN 3 AND 80 AND length(letters) >= 3 AND regexp_full_match(letters, '\p{{Lu}}+') AND NOT regexp_matches(s, '^(?:[-*•]|\(\w{{1,3}}\)|\d{{1,3}}[.)]|\|)\s')""",
    "rate_claim_scrub": "SELECT doc_id, source || CASE WHEN doc_id % 4 = 1 THEN ': 15 of 60 detections had no AIS correspondence' ELSE ': rates of exchange' END AS text FROM documents WHERE doc_id % 4 IN (1, 3)",
    "corpus_stats": "SELECT source AS publisher, 'real' AS origin, lang AS language, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 3",
    "manifest_set_equality": """WITH listed AS (SELECT o_orderkey AS k, o_orderkey % 1000 AS want_bytes, sha256(CAST(o_orderkey AS VARCHAR)) AS want FROM orders WHERE o_orderkey % 7 <> 0),
        there AS (SELECT l_orderkey AS k, count(*) AS copies, min((l_orderkey + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 1000) AS found_bytes, min(sha256(CAST(l_orderkey AS VARCHAR) || CASE WHEN l_orderkey % 13 = 0 THEN 'x' ELSE '' END)) AS got
          FROM lineitem WHERE l_linenumber = 1 OR l_orderkey % 50 = 0 GROUP BY 1)
        SELECT CAST(coalesce(l.k, t.k) AS VARCHAR) AS path, want_bytes, found_bytes, coalesce(copies, 0) AS copies, CASE WHEN copies > 1 THEN 'duplicate' WHEN l.k IS NULL THEN 'unexpected' WHEN copies IS NULL THEN 'missing'
          WHEN found_bytes <> want_bytes THEN 'size' WHEN got <> want THEN 'digest' END AS refusal FROM listed l FULL JOIN there t ON l.k = t.k""",
    "manifest_kinds": "SELECT p_brand AS kind, count(*) AS entries, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1",
}
