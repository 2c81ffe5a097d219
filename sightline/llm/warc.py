"""A content-addressed WARC archive in two tables.

headers: one row per record with its exact header bytes (WARC header and HTTP header); payloads: each payload's bytes once, under
its SHA-256. reconstruct() joins them back into the original records; the digest is recomputed on the way, and `verified` says
whether it still holds. Of records with equal payloads of at least min_bytes, the one with the smallest page_id is the response
and the others are revisits that refer to it.

The payload never travels with a hot digest: who owns a digest is settled over digests alone, and the payload table is an
aggregation that every task reduces to one row per digest before the shuffle.

Defined results: a null html is an empty payload. Rows with one page_id and equal payloads are one capture given several times: all
of them have its record type. A null page_id never owns a digest that another page has; where all are null, all are responses. A
null url is written as urn:unknown; line ends in urls are percent-encoded, so a url cannot forge a header line. Other columns are
ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.shared import shared_dir, written

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Base32 (RFC 4648) of a 40-digit hexadecimal string: five hex digits are four base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def write_archive(df: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the tables path/headers and path/payloads."""
    rows = df.select(
        F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")
    ).withColumn("strong", F.sha2("payload", 256))
    sums = rows.select("page_id", "url", "strong", base32(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    # written, so that the join can split a digest that very many pages have
    owners = written(sums.where(F.col("bytes") >= min_bytes).groupBy("strong").agg(F.min("page_id").alias("owner")), "owners")
    r = sums.join(owners, "strong", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("urn:unknown")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2)
    )
    owner = F.when(revisit, F.col("owner").cast("string"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("unknown")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), owner, F.lit(">"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
    )
    r.select("page_id", "strong", header.cast("binary").alias("warc_header"), http.cast("binary").alias("http_header")).write.parquet(f"{path}/headers")
    rows.groupBy("strong").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the stored bytes: page_id, url, record_type, refers_to, payload_digest, payload_bytes, verified."""
    stored = spark.read.parquet(f"{path}/payloads").select(
        "strong", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("stored_digest"), (F.sha2("payload", 256) == F.col("strong")).alias("intact")
    )
    got = spark.read.parquet(f"{path}/headers").join(stored, "strong", "left")
    head = F.decode("warc_header", "UTF-8")
    field = lambda name, value=r"([^\r\n]*)": F.nullif(F.regexp_extract(head, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    digest = field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})")
    return got.select(
        "page_id", field("WARC-Target-URI").alias("url"), "payload_bytes", F.col("stored_digest").alias("payload_digest"), field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        F.coalesce(F.col("intact") & (digest == F.col("stored_digest")), F.lit(False)).alias("verified"),
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact WARC record, payload included unless it is a revisit."""
    got = spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads"), "strong", "left")
    revisit = F.decode("warc_header", "UTF-8").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return got.select("page_id", F.concat("warc_header", "http_header", body, F.lit(b"\r\n\r\n")).alias("record"))


def op1_warc_archive(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    path = f"{shared_dir(spark)}/warc"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT html, min(page_id) AS owner FROM p GROUP BY html),
d AS (SELECT page_id, html, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT) AS q FROM p)
SELECT page_id, octet_length(encode(d.html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(q, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to, true AS verified
FROM d JOIN o USING (html)
"""
