"""WARC archive addressed by content.

``write_archive`` makes two tables in the shared folder: ``payloads`` (digest, payload), which holds
each distinct payload once, and ``records`` (page_id, header, digest), which holds the exact header
bytes of every record: the WARC header and the HTTP head of its block. ``read_records`` joins them again, verifies every stored
payload against its SHA-256 and parses the headers; ``reconstruct`` gives the full original record bytes. A payload that
is missing or damaged stops the query.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest page_id
is the response, the others are revisits that refer to it; smaller payloads are always responses
(and still stored once).

Payloads cross the shuffle once, dealt by page_id and digest, so a payload shared by a third of all
pages is no hot key; the digest groups are pre-aggregated before they are shuffled.

Defined results: null html is the empty payload; a null url gives a header without target; line
breaks in a url are percent-encoded; a null page_id makes a record of its own and comes last as a keeper; repeated rows give
repeated records; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import clear, fresh_path

MIN_REVISIT = 100
ID_PREFIX = "urn:wordtide:page:"
EPOCH = "1970-01-01T00:00:00Z"
_LINE = "\r\n"


@dataclass(frozen=True)
class Archive:
    payloads: str
    records: str


def _headers(rows: DataFrame) -> DataFrame:
    """Adds ``header``: the bytes of the record's header and of the HTTP head, their blank lines included."""
    url = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_LINE))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}"), field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", F.col("n_bytes").cast("string")), F.lit(_LINE))
    bracket = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), c.cast("string"), F.lit(">"))
    return rows.withColumn(
        "header",
        F.concat(
            F.lit(f"WARC/1.1{_LINE}"),
            field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            field("WARC-Record-ID", bracket(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
            field("WARC-Date", F.lit(EPOCH)),
            F.coalesce(field("WARC-Target-URI", url), F.lit("")),
            field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.coalesce(field("WARC-Refers-To", bracket(F.col("refers_to"))), F.lit("")),
            F.when(revisit, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
            field("Content-Type", F.lit("application/http; msgtype=response")),
            field("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))).cast("string")),
            F.lit(_LINE),
            http,
        ).cast("binary"),
    )


def write_archive(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> Archive:
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("bigint")})
    narrow = rows.select("page_id", "url", "digest", "n_bytes")
    keepers = narrow.groupBy("digest").agg(F.min("page_id").alias("keeper"))

    archive = Archive(fresh_path(spark, "payloads"), fresh_path(spark, "records"))
    # Both steps go by the same two columns, so payloads are shuffled once.
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    wanted = keepers.select(name("keeper").alias("k_name"), F.col("digest").alias("k_digest"))
    named = rows.select(name("page_id").alias("name"), "digest", "payload")
    once = named.join(wanted, (F.col("name") == F.col("k_name")) & (F.col("digest") == F.col("k_digest")), "left_semi")
    once = once.groupBy("name", "digest").agg(F.first("payload").alias("payload")).select("digest", "payload")
    once.write.option("compression", "zstd").parquet(archive.payloads)
    clear(spark)

    records = narrow.join(keepers, "digest", "left")
    is_revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    records = _headers(records.withColumn("refers_to", F.when(is_revisit, F.col("keeper"))))
    records.select("page_id", "header", "digest").write.option("compression", "zstd").parquet(archive.records)
    clear(spark)
    return archive


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """digest, payload and the size and SHA-256 of the bytes read; a stored payload that does not match its digest stops the query."""
    stored = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    found = F.sha2("payload", 256)
    checked = F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("digest"))).cast("string"))
    return stored.select("digest", "payload", checked.alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))


def read_records(spark: SparkSession, archive: Archive, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, record_type, refers_to and target_uri as parsed from the header, payload_bytes and payload_digest of the stored bytes, header."""
    records = spark.read.schema("page_id bigint, header binary, digest string").parquet(archive.records)
    payloads = read_payloads(spark, archive)
    if not with_payload:
        payloads = payloads.drop("payload")
    text = F.decode("header", "UTF-8")
    of = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))  # noqa: E731  WARC fields come before those of HTTP
    parsed = records.select(
        of("WARC-Record-ID", f"<{ID_PREFIX}(-?[0-9]+)>").cast("bigint").alias("page_id"),
        of("WARC-Type", "([a-z]+)").alias("record_type"),
        of("WARC-Refers-To", f"<{ID_PREFIX}(-?[0-9]+)>").cast("bigint").alias("refers_to"),
        of("WARC-Target-URI", "([^\r\n]*)").alias("target_uri"),
        of("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("digest"),
        "header",
    )
    joined = parsed.join(payloads, "digest", "left")
    missing = F.raise_error(F.concat(F.lit("the archive has no payload "), F.coalesce("digest", F.lit("(no digest in the header)"))))
    return joined.withColumn("payload_digest", F.when(F.col("payload_digest").isNull(), missing.cast("string")).otherwise(F.col("payload_digest"))).drop("digest")


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id and ``record``: header, HTTP head, payload (none for a revisit) and the two closing line breaks, as bytes."""
    rows = read_records(spark, archive, with_payload=True)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))
