"""Content-addressed WARC archive.

``write_archive`` stores two tables below one path: ``payloads`` holds the bytes
of every distinct payload once, addressed by SHA-256; ``records`` holds the
exact header block of every record and the digest of its payload. A WARC record
is given back by joining the two. Reading verifies the stored bytes against
their address.

A page whose payload (at least ``REVISIT_FROM`` bytes) is stored under another
record becomes a ``revisit`` of it. Digests, grouping, headers and parsing are
DataFrame functions; the page bytes cross the network once, when each distinct
payload goes to its row in the store, and a hot payload is reduced to one
candidate per task before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Smaller payloads never become revisits.
REVISIT_FROM = 1000
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """``Name: value`` and its line end, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _safe_uri(url: Column) -> Column:
    """Control characters and spaces of a URI percent-encoded, so that it stays on its header line; nothing else changes."""
    one = lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.hex(F.encode(c, "UTF-8")))).otherwise(c)
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(F.transform(F.split(url, ""), one), "")).otherwise(url)


def write_archive(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages(page_id, url, html)``; other columns are not read.

    Payload: html in UTF-8, null as empty. Of equal payloads of at least ``REVISIT_FROM`` bytes the largest
    page_id is the response, the rest revisit it. A null page_id is smaller than any other; of rows
    that repeat the response's page_id and payload all are responses. A null url leaves the URI line out.
    An empty table writes an empty archive.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("address"),
                       F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    # one row per distinct payload; the rank limit keeps a single candidate per task and address before the shuffle
    first = Window.partitionBy("address").orderBy(F.col("page_id").desc_nulls_last())
    (rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
     .select("address", F.col("page_id").alias("response_id"), "n_bytes", "payload")
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads"))
    store = pages.sparkSession.read.parquet(f"{path}/payloads").select(F.col("address").alias("_address"), "response_id")
    rec = rows.select("page_id", "url", "address", "sha1", "n_bytes").join(store, F.col("address") == F.col("_address"))
    revisit = (F.col("n_bytes") >= REVISIT_FROM) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    sha1 = F.concat(F.lit("sha1:"), F.col("sha1"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("address"))),
        _line("WARC-Target-URI", _safe_uri(F.col("url"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", sha1),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                 _line("WARC-Refers-To", _record_id(F.col("response_id"), F.col("address"))),
                                 _line("X-Refers-To-Page", F.col("response_id").cast("string")))).otherwise(F.lit("")),
        _line("X-Page", F.col("page_id").cast("string")),
        _line("X-Payload-Length", F.col("n_bytes").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF))
    (rec.select(F.encode(header, "UTF-8").alias("header"), "address")
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/records"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(address, payload, payload_bytes, payload_digest)`` with length and SHA-1 taken from the stored bytes.
    Bytes that do not hash to their address stop the read."""
    rows = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("address"))).cast("string"))
    return rows.select(checked.alias("address"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.sha1("payload").alias("payload_digest"))


def _field(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records, header fields parsed and payload joined back: ``(page_id, record_type, refers_to, uri,
    header, payload, payload_bytes, payload_digest, declared_digest)``. A revisit gets the payload of the record it refers to."""
    head = F.decode("header", "UTF-8")
    rec = spark.read.parquet(f"{path}/records").select(
        F.col("address").alias("_address"), "header",
        _field(head, "X-Page").cast("long").alias("page_id"),
        _field(head, "WARC-Type").alias("record_type"),
        _field(head, "X-Refers-To-Page").cast("long").alias("refers_to"),
        _field(head, "WARC-Target-URI").alias("uri"),
        F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"))
    return rec.join(read_payloads(spark, path), F.col("_address") == F.col("address")).drop("_address", "address")


def warc_bytes(records: DataFrame) -> DataFrame:
    """``(page_id, record)``: each record as it stands in a WARC file (a revisit has an empty block)."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return records.select("page_id", F.concat(F.col("header"), block, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))
