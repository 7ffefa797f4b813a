"""The registered queries of this subpackage: thin, each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read_table
from .decontaminate import contamination
from .filter_audit import audit_filters
from .language_id import held_out, identify_languages
from .license_scan import scan_licenses
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality_rules import judge_quality
from .substring_dedup import drop_repeated_passages
from .token_binary import token_files_round_trip
from .token_counts import token_counts
from .tokenizer_alignment import align_tokenizers
from .warc import warc_round_trip


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_round_trip(read_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs, docs.where(~held_out(F.col("doc_id"))))
    return found.withColumn("held_out", held_out(F.col("doc_id")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents")).drop("row")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents")).drop("row")


QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_binary": op8_token_binary,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.p = b.p AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
  e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
  m AS (SELECT a, MIN(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id"""

_OP2 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
  y AS (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY p ORDER BY doc_id, i) AS n FROM x),
  g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM y WHERE n > 1),
  k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
  t AS (SELECT doc_id, STRING_AGG(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(z.n, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY 1) z USING (doc_id)"""

_OP4 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), f AS (SELECT *, MIN(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(s, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_OP9 = f"""WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
  q AS (SELECT item, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  x AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS p FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
  h AS (SELECT r, i, k, item FROM x JOIN q USING (k, p)),
  n AS (SELECT r, COUNT(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM h) GROUP BY 1),
  t AS (SELECT r, COUNT(DISTINCT item) AS n_items, STRING_AGG(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""

_OP11 = f"""WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
  d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  x AS (SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > MIN(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM d LEFT JOIN l USING (doc_id)),
  m AS (SELECT part, fails, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
  c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
  o AS (SELECT a.f || b.f || c1.f || d1.f || e.f AS filter_order FROM c a, c b, c c1, c d1, c e WHERE a.bit + b.bit + c1.bit + d1.bit + e.bit = 31 AND (a.bit | b.bit | c1.bit | d1.bit | e.bit) = 31),
  s AS (SELECT filter_order, CAST(step AS INT) AS step, (SELECT COALESCE(SUM(bit), 0) FROM c WHERE contains(left(filter_order, step - 1), f)) AS before, (SELECT bit FROM c WHERE f = substr(filter_order, step, 1)) AS own FROM o, range(1, 6) r(step)),
  y AS (SELECT part, filter_order, step, own, SUM(n * ((fails & (before + own)) = 0)::INT) AS kept,
    SUM(n * ((fails & before) = 0 AND (fails & own) <> 0)::INT) AS removed, SUM(n * ((fails & before) <> 0 AND (fails & own) <> 0)::INT) AS redundant,
    SUM(n * (fails = own)::INT) AS unique_fails, SUM(good * ((fails & before) = 0 AND (fails & own) <> 0)::INT) AS good_lost, SUM(toxic * ((fails & before) = 0 AND (fails & own) <> 0)::INT) AS toxic_lost
    FROM (SELECT part, CAST(fails AS BIGINT) AS fails, n, good, toxic FROM m), (SELECT filter_order, step, CAST(before AS BIGINT) AS before, CAST(own AS BIGINT) AS own FROM s) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y"""

#: What the contracts fix as a whole. The other queries learn, draw or tokenize; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_near_dup": _OP1, "op2_substring_dedup": _OP2, "op4_warc": _OP4, "op9_decontaminate": _OP9, "op11_filter_audit": _OP11}
