"""Content-addressed WARC archive.

Three things are stored: every payload once, by its SHA-256; the exact header block of every
record; nothing else. Records come back by joining headers to payloads, and every payload is
hashed again on the way. `export_warc` lays the records out as plain WARC files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 1000
END = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")


def _clean(value: Column) -> Column:
    """A header value: line ends cannot occur in one."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def _record_id(page_id: Column) -> Column:
    """A stable record URI: the MD5 of the page's id in UUID form."""
    return F.regexp_replace(
        F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary")),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "<urn:uuid:$1-$2-$3-$4-$5>",
    )


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row per page: page_id, address (SHA-256 of the payload), header (the exact header block), payload.

    Among records with equal payloads of MIN_REVISIT_BYTES or more, the one with the largest
    page_id is the response and the others are revisits of it; a smaller payload always makes a
    response. A null html is an empty payload. A null page_id never wins over an id; payloads
    known only from rows without page_id are all responses. Repeated rows with the largest id
    are responses each.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1")
    )
    last = (
        rows.where(F.col("n") >= MIN_REVISIT_BYTES)
        .groupBy("address")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
        .where("copies > 1 and kept is not null")
        .select("address", "kept")
    )
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    kind = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, F.col("kept"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("kept")))),
        _line("WARC-Refers-To-Page-ID", refers.cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(END),
    )
    return rows.join(last, "address", "left").select("page_id", "address", header.alias("header"), "payload", "kept")


def write_archive(pages: DataFrame, path: str) -> None:
    """Write headers/ and payloads/ under path.

    Copies of a payload meet in an aggregate that keeps one of them before the shuffle already,
    so a group of copies is never gathered.
    """
    rows = records(pages)
    rows.select("page_id", "address", "header").write.parquet(f"{path}/headers")
    rows.select("address", "payload").groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(
        f"{path}/payloads"
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload of every record; a payload that is not what its address says stops the read."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = payloads.where(
        F.when(F.sha2("payload", 256) == F.col("address"), True).otherwise(
            F.raise_error(F.concat(F.lit("payload damaged: "), F.col("address"))).cast("boolean")
        )
    )
    return headers.join(checked, "address").select("page_id", "header", "payload")


def field(name: str) -> Column:
    """A header's value, null where the record has none."""
    value = F.regexp_extract("header", rf"(?dm)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Plain WARC files: header block, block (none for revisits), two line ends."""
    body = F.when(field("WARC-Type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    read_archive(spark, path).select(F.concat("header", body).alias("value")).write.option("lineSep", END * 2).text(to)


def page_records(pages: DataFrame, path: str) -> DataFrame:
    """Archive the pages under path, read them back, and describe each record from what was read."""
    spark = pages.sparkSession
    write_archive(pages, path)
    return read_archive(spark, path).select(
        field("WARC-Page-ID").cast(pages.schema["page_id"].dataType).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-ID").cast(pages.schema["page_id"].dataType).alias("refers_to"),
    )
