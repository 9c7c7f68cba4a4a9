"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import fingerprints, language, license_scan, maxscore, mixing, near_dup, piece_bpe, quality, toxicity, warc
from graphloom.llm.common import fold, fresh_folder, table

#: A word [^\x20\x09-\x0D]+
WORD = r"[^\x20\x09-\x0D]+"


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_with_edit(table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out_of = table(spark, sf_dir, "documents"), 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold("doc_id", 4) != out_of)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 4) == out_of).alias("held_out"), "score", F.col("accepted").cast("int").alias("predicted"))


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder, least_bytes=1000)
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_union("base_labels", F.transform("spans", lambda s: s["label"]))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), "score")


def op7_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 5) != 0))
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op8_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def words_of(text: str) -> Column:
    """Number of words of a column of texts."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.pareto_mix(table(spark, sf_dir, "documents"), words_of("text"))
    return out.select("doc_id", "size", "source_size", "target", F.round("rank", 9).alias("pareto_rank"), "taken")


def tokenizer_model(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_model())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_bradley_terry_quality,
        op3_maxscore_top_k,
        op4_minhash_near_dedup,
        op5_warc_dictionary,
        op6_license_diagonals,
        op7_centroid_language,
        op8_boosted_toxicity,
        op9_pareto_mix,
        op10_piece_bpe,
    )
}



def _template_rows() -> str:
    """The word 3-grams of the notice templates as rows (template, place, a, b, c)."""
    out = []
    for n, (_, text) in enumerate(license_scan.TEMPLATES):
        words = text.split()
        out += [f"({n}, {i}, '{words[i]}', '{words[i + 1]}', '{words[i + 2]}')" for i in range(len(words) - 2)]
    return ", ".join(out)


_ABOUT = ", ".join(f"({n}, '{label}', {len(text.split())})" for n, (label, text) in enumerate(license_scan.TEMPLATES))
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op3_maxscore_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: hash(list_slice(w, i, i + 3)))
    WHEN len(w) > 0 THEN [hash(w)] ELSE [] END) AS h FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
same AS (SELECT list(h ORDER BY h) AS hs, doc_id FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY hs) AS cls FROM same),
k AS (SELECT s.doc_id, s.h FROM s JOIN cls ON s.doc_id = cls.doc_id AND cls.doc_id = cls.cls),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS u, a AS v FROM d UNION SELECT u, b FROM reach JOIN d ON v = a),
low AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.low, cls.cls, w.doc_id) AS component_id,
  w.doc_id = coalesce(low.low, cls.cls, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN cls ON cls.doc_id = w.doc_id LEFT JOIN low ON low.u = cls.cls""",
    "op5_warc_dictionary": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages
), h AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS head FROM p),
r AS (SELECT *, coalesce(payload_bytes >= 1000 AND page_id < head, false) AS again FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN head END AS refers_to FROM r""",
    "op6_license_diagonals": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS pos FROM d),
g AS (
  SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM (
    SELECT doc_id, pos, unnest(list_filter([
      CASE WHEN a = 'gnu' AND b = 'general' AND c = 'public' AND e = 'license' THEN 'gpl' END, CASE WHEN a = 'apache' AND b = 'license' THEN 'apache' END,
      CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' END, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' END], lambda x: x IS NOT NULL)) AS label FROM g
  ) GROUP BY doc_id
), m(template, place, a, b, c) AS (VALUES {_template_rows()}),
about AS (
  SELECT v.*, grams FROM (VALUES {_ABOUT}) v(template, label, words) JOIN (SELECT template, count(DISTINCT (a, b, c)) AS grams FROM m GROUP BY 1) USING (template)
), votes AS (
  SELECT DISTINCT doc_id, template, pos, place, pos - place AS diagonal, (a, b, c) AS gram FROM g JOIN m USING (a, b, c)
), diagonals AS (
  SELECT doc_id, template, diagonal, min(pos) AS lo, max(pos) AS hi FROM votes GROUP BY ALL
), parted AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {license_scan.SLACK} THEN 0 ELSE 1 END AS fresh FROM diagonals
), merged AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM parted
), spans AS (
  SELECT doc_id, template, span, min(lo) AS first, max(hi) + {license_scan.GRAM - 1} AS last, count(DISTINCT gram) AS hits
  FROM votes JOIN merged USING (doc_id, template, diagonal) GROUP BY ALL
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(hits AS DOUBLE) / CAST(grams AS DOUBLE)) AS best FROM spans JOIN about USING (template)
  WHERE CAST(hits AS DOUBLE) / CAST(grams AS DOUBLE) >= {license_scan.COVERAGE} AND last - first + 1 <= 2 * words GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best, CAST(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_pareto_mix": f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS drawn
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w, sum(source_size) OVER () AS total FROM s
), c AS (
  SELECT *, 2 * coalesce(sum(source_size) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w FROM w
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, w * (3 * total - 2 * capped) >= 4 * source_size * left_w AS over FROM c
), l AS (
  SELECT *, min(CASE WHEN NOT over THEN {{'r': CAST(source_size AS DOUBLE) / w, 'n': source IS NULL, 's': source, 'c': capped, 'l': left_w}} END) OVER () AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN over OR level IS NULL THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(w * (3 * total - 2 * level.c) AS DOUBLE) / CAST(2 * level.l AS DOUBLE) END AS target FROM l
), k AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t
), r AS (
  SELECT d.*, source_size, target, copies, CAST(round(target) AS BIGINT) - copies * source_size AS rest FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
), z AS (
  SELECT source, size, rest, count(*) AS n FROM r WHERE size > 0 GROUP BY ALL
), y AS (
  SELECT source, size, rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
    sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM z
), x AS (
  SELECT *, CAST(open AS DOUBLE) * CAST(size AS DOUBLE) >= CAST(below AS DOUBLE) AS certain FROM y
), g AS (
  SELECT *, max(CASE WHEN NOT certain THEN {{'s': size, 'o': open, 'b': below}} END) OVER (PARTITION BY source) AS level FROM x
), p AS (
  SELECT source, size, CASE WHEN certain OR level IS NULL THEN CAST(1 AS DOUBLE)
    ELSE greatest(CAST(0 AS DOUBLE), CAST(level.o AS DOUBLE) * CAST(size AS DOUBLE) / CAST(level.b AS DOUBLE)) END AS p FROM g
), q AS (
  SELECT r.*, p.p, (CAST(drawn AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM r LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.size = p.size
), v AS (
  SELECT *, CASE WHEN p >= 1 THEN CAST(0 AS DOUBLE) WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM q
), o2 AS (
  SELECT *, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, drawn, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM v
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, round(rank, 9) AS pareto_rank,
  CAST(copies * size + CASE WHEN rank IS NULL THEN 0 ELSE greatest(0, least(size, open)) END AS BIGINT) AS taken FROM o2""",
}
