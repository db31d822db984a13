"""The registered queries opN_* and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, classifier, decontamination, licenses, linejoin, minhash, mixing, mjpeg, sharding, substring, variants, warc, weighted

SHARDS = [f"shard-{i:03d}" for i in range(64)]
TABLE_SIZE = 10_007
DOMAIN_WEIGHTS = {"clean": 0.94, "toxic": 0.03, "junk": 0.03}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_decontamination`` with the items that occur nearly, which its SQL has no columns for."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontamination.SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near_items").cast("bigint").alias("n_near_items"), "near_items")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.features(mjpeg.media_column(table(spark, sf_dir, "documents"))).withColumn("n_clips", F.size("clips"))


def op2_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of ``op2_media``, a row each."""
    return mjpeg.clip_rows(mjpeg.features(mjpeg.media_column(table(spark, sf_dir, "documents"))))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents")).drop("kept")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.line_dedup(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), DOMAIN_WEIGHTS, columns=["doc_id"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("doc_id", F.col("__n_words").alias("n_tokens"), F.col("__probabilities").alias("posterior"), "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def op7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op7_mixing`` reaches: targets and shares of the domains before and after."""
    return mixing.domain_totals(mixed(spark, sf_dir), DOMAIN_WEIGHTS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, "doc_id", SHARDS, TABLE_SIZE)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op1_near": op1_near, "op2_media": op2_media, "op2_clips": op2_clips, "op3_licenses": op3_licenses, "op4_minhash": op4_minhash, "op5_substring": op5_substring, "op6_quality": op6_quality, "op7_mixing": op7_mixing, "op7_totals": op7_totals, "op8_warc": op8_warc, "op9_sharding": op9_sharding, "op10_lines": op10_lines, "op11_alignment": op11_alignment, "op12_variants": op12_variants, "op13_fingerprints": op13_fingerprints}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(len(t), 10) AS n, array_to_string(t[i : i + 9], ' ') AS g
  FROM (SELECT item_id, t, unnest(range(1, greatest(len(t) - 8, 2))) AS i FROM b WHERE len(t) > 0)
), o AS (
  SELECT x.doc_id, x.i, x.n, w.item_id
  FROM (SELECT doc_id, n, i, array_to_string(t[i : i + n - 1], ' ') AS g
        FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(t) >= n)) x
  JOIN w ON w.n = x.n AND w.g = x.g
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM o)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.t) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(t[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 2))) AS i FROM w WHERE len(t) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 75 * (na.n + nb.n - p.k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), k AS (
  SELECT sha256(html) AS d, min(page_id) AS keeper FROM p GROUP BY html
)
SELECT p.page_id, p.n AS payload_bytes, k.d AS payload_digest,
       CASE WHEN p.n >= 100 AND p.page_id <> k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM p JOIN k ON sha256(p.html) = k.d
"""


def op9_sql() -> str:
    owners = ",".join(map(str, sharding.fill_table(SHARDS, TABLE_SIZE)))
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owners),
k AS (SELECT doc_id, source, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, source, slot, CAST(owners[slot + 1] AS INTEGER) AS shard FROM k, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op4_minhash": OP4_SQL, "op8_warc": OP8_SQL, "op9_sharding": op9_sql()}
