"""WARC as a content-addressed archive.

The archive is two tables. payloads holds every payload once under its digest, verified;
headers holds the exact header bytes of every record apart. Records are put together again
by joins on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, join_counted, scratch_path, written

#: Digits of base 32 as Java prints them, and the base32 alphabet of RFC 4648.
JAVA_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Pages have no time of capture; records name this one unless another is given.
NO_DATE = "1970-01-01T00:00:00Z"


def base32_of_hex(hex_digest: Column) -> Column:
    """Base32 of a 40-digit hex string: each 5 hex digits are 4 base32 digits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * g, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*groups), JAVA_DIGITS, BASE32)


def _record_id(page: Column, copy: Column, digest: Column) -> Column:
    """Pages of one id differ in their payloads or are numbered copies, so no two records share an id."""
    known = F.coalesce(page["id"].cast("string"), F.lit("none"))
    return F.concat(F.lit("<urn:page:"), known, F.lit(":"), copy.cast("string"), F.lit(":"), digest, F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = NO_DATE) -> None:
    """Writes path/headers and path/payloads for one record per row of pages.

    Of records with equal payloads of at least min_bytes bytes the one with the smallest id is a
    response and holds the payload; the others revisit it. Smaller payloads are all responses, and
    are still stored once. Equality is of two strong digests (SHA-1, SHA-256) and the length.

    Null payload: empty. Null url: an empty target. Null ids sort after all others. Rows that repeat an id and a
    payload are numbered by url: the first keeps the response, the rest revisit it (they then refer to their own id).
    Empty table: empty tables. Other columns are ignored. date: the WARC-Date of all records.

    Scale: the group of a digest is reduced to its smallest id on the map side, and a digest with a large share of the
    rows meets its pages by broadcast; payloads move once, spread by digest and id, and only those that are stored.
    """
    page = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).cast("long").alias("id"))
    src = pages.select(
        page.alias("page"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns(
        {
            "sha1": F.sha1("payload"),
            "sha256": F.sha2("payload", 256),
            "n": F.octet_length("payload").cast("long"),
        }
    )
    spark, content = pages.sparkSession, ["sha256", "sha1", "n"]
    # rows that repeat in every respect are counted; those of one id and payload follow each other by url
    each = src.groupBy(*content, "page", "url").agg(F.count(F.lit(1)).alias("copies"))
    own = Window.partitionBy(*content, "page").orderBy("url").rowsBetween(Window.unboundedPreceding, -1)
    scratch = [scratch_path(spark, "records"), scratch_path(spark, "first")]
    each = written(each.withColumn("before", F.coalesce(F.sum("copies").over(own), F.lit(0))), scratch[0])
    first = written(each.groupBy(*content).agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("rows")), scratch[1])
    records = (
        join_counted(each, first, content, "rows")
        .withColumn("copy", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))))
        .withColumn("response", (F.col("n") < min_bytes) | ((F.col("page") == F.col("first")) & (F.col("copy") == 1)))
        .withColumn("digest", base32_of_hex(F.col("sha1")))
    )
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        F.lit("WARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit"), F.lit(CRLF),
        F.lit("WARC-Record-ID: "), _record_id(F.col("page"), F.col("copy"), F.col("digest")), F.lit(CRLF),
        F.lit("WARC-Date: " + date + CRLF),
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]+", " "), F.lit(CRLF),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
    )
    refers = F.when(F.col("response"), F.lit("")).otherwise(
        F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first"), F.lit(1), F.col("digest")), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF))
    )
    length = F.concat(F.lit("Content-Length: "), F.when(F.col("response"), F.col("n")).otherwise(F.lit(0)).cast("string"), F.lit(CRLF + CRLF))
    records.select(
        F.encode(F.concat(head, refers, length), "UTF-8").alias("header"),
        F.unhex("sha256").alias("address"),
    ).write.parquet(f"{path}/headers")
    # plain columns, so that rows which repeat meet in the join's own partitions
    place = lambda page: [F.col(f"{page}.unknown").alias("unknown"), F.coalesce(F.col(f"{page}.id"), F.lit(0)).alias("number")]
    at = ["sha256", "unknown", "number"]
    stored = src.select("sha256", *place("page"), "payload").join(first.select("sha256", *place("first")), at, "left_semi")
    stored = stored.groupBy(*at).agg(F.first("payload").alias("payload"))
    stored.select(F.unhex("sha256").alias("address"), "payload").write.parquet(f"{path}/payloads")
    for table in scratch:
        drop_path(spark, table)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The fields of every header, parsed from its bytes: record_id, record_key (the page's id), record_type, url, digest, date, refers_to (a page's id), header, address."""
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"(?m)^{name}: {value}\r?$", 1), F.lit(""))
    return spark.read.parquet(f"{path}/headers").select(
        field("WARC-Record-ID", r"(\S+)").alias("record_id"),
        field("WARC-Record-ID", r"<urn:page:(-?\d+):\S+").cast("long").alias("record_key"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        field("WARC-Payload-Digest", r"sha1:([A-Z2-7]{32})").alias("digest"),
        field("WARC-Date", r"(\S+)").alias("date"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+):\S+").cast("long").alias("refers_to"),
        "header",
        "address",
    )


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; a payload that does not hash to its address fails the read."""
    got = F.unhex(F.sha2("payload", 256))
    return spark.read.parquet(f"{path}/payloads").select(
        F.when(got == F.col("address"), F.col("address")).otherwise(F.raise_error(F.lit("payload does not match its address"))).alias("address"),
        base32_of_hex(F.sha1("payload")).alias("stored_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload",
    )


def with_payloads(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """headers joined with the payloads at their addresses. An address with a large share of the headers goes to them by broadcast of its payload's row."""
    uses = headers.groupBy("address").agg(F.count(F.lit(1)).alias("uses"))
    return join_counted(headers, payloads.join(uses, "address"), ["address"], "uses").drop("uses")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record's original bytes: header, then the payload for responses, then two line ends; and the payload itself."""
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return read_headers(spark, path).join(verified_payloads(spark, path), "address").withColumn("record", F.concat("header", body, end))
