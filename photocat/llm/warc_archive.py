"""Content-addressed web archive: payloads once, headers apart, records by joins.

An archive is a folder with two tables.  ``payloads`` holds every distinct payload
once, under its SHA-256.  ``headers`` holds the exact header bytes of every WARC
record with the digest of its payload.  ``read_records`` joins them, recomputes
both digests and the length of each stored payload and refuses a mismatch, so a
wrongly shared payload cannot be read unnoticed.

Nulls, ties and the like
    A null payload is empty.  Of equal payloads of at least ``min_bytes`` the
    smallest id is a ``response`` and all others are ``revisit``; rows that share
    that smallest id are all responses, over one stored payload.  If all ids of a
    group are null, all its rows are responses.  A null URL leaves its header
    line out; line ends in a URL are percent-encoded.  An empty table gives an
    empty archive.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import Scratch, utf8

# Fixed values of the WARC 1.1 and RFC 4648 formats.
VERSION = "WARC/1.1"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 without prefix.

    160 bits are eight groups of five hexadecimal digits, each four base32 digits.
    """
    digest = F.sha1(data)
    alphabet = F.lit(BASE32)

    def four(group):
        value = F.conv(F.substring(digest, group * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(
            *[F.substring(alphabet, F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        )

    return F.concat(*[four(F.lit(g)) for g in range(8)])


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Writes ``pages`` as an archive below ``path``, one record per row."""
    scratch = Scratch(pages.sparkSession, "warc")
    data = utf8(F.col(payload_col))
    records = scratch.save(
        pages.select(
            F.col(id_col).alias("_id"),
            F.col(url_col).cast("string").alias("_url"),
            F.sha2(data, 256).alias("key"),
            base32_sha1(data).alias("_sha1"),
            F.octet_length(data).cast("bigint").alias("_bytes"),
        ),
        "records",
    )
    first = scratch.save(
        records.where(F.col("_bytes") >= min_bytes).groupBy("key").agg(F.min("_id").alias("_first")), "first"
    )
    # Both sides are written tables, so a payload with very many records is split at run time.
    marked = records.join(first, "key", "left").withColumn(
        "_refers", F.when(F.col("_id").isNull() | (F.col("_id") != F.col("_first")), F.col("_first"))
    )
    marked.select("key", _header(date).alias("header")).write.parquet(f"{path}/headers")
    # Equal digests meet inside each task before the shuffle, so copies are not moved.
    pages.select(F.sha2(data, 256).alias("key"), data.alias("payload")).groupBy("key").agg(
        F.first("payload").alias("payload")
    ).write.parquet(f"{path}/payloads")
    scratch.drop("records", "first")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: its fields, full payload and exact record bytes."""
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.col("key").alias("_key"),
        "payload",
        F.sha2("payload", 256).alias("_sha256"),
        base32_sha1(F.col("payload")).alias("_sha1"),
        F.octet_length("payload").cast("bigint").alias("_bytes"),
    )
    head = spark.read.parquet(f"{path}/headers")
    fields = head.select(
        "key",
        "header",
        _field("Record-Number").cast("bigint").alias("record"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field("Payload-Length").cast("bigint").alias("payload_bytes"),
        _field("Refers-To-Record-Number").cast("bigint").alias("refers_to"),
    )
    # A full left side: a header whose payload is missing fails the check as well.
    joined = fields.join(stored, F.col("key") == F.col("_key"), "left")
    sound = (
        F.coalesce(F.col("_sha256") == F.col("key"), F.lit(False))
        & (F.col("_sha1") == F.col("payload_digest"))
        & (F.col("_bytes") == F.col("payload_bytes"))
    )
    whole = F.when(sound, F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload does not match its record: "), F.col("key")))
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.select(
        "record",
        "url",
        "record_type",
        whole.alias("payload_digest"),
        F.col("_bytes").alias("payload_bytes"),
        "refers_to",
        "payload",
        F.concat(F.col("header"), body, F.lit(EOL * 2).cast("binary")).alias("record_bytes"),
    )


def _header(date: str) -> Column:
    revisit = F.col("_refers").isNotNull()

    def uuid_of(number):
        h = F.md5(F.concat(F.lit("record "), number.cast("string")))
        parts = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))

    def optional(name, value):
        return F.coalesce(line(name, value), F.lit(""))

    url = F.replace(F.replace(F.col("_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    own = F.coalesce(F.col("_id").cast("string"), F.concat_ws(" ", "key", "_url"))
    text = F.concat(
        F.lit(VERSION + EOL),
        line("WARC-Type", kind),
        line("WARC-Record-ID", uuid_of(own)),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(F.lit("")),
        optional("WARC-Refers-To", F.when(revisit, uuid_of(F.col("_refers").cast("string")))),
        optional("Record-Number", F.col("_id").cast("string")),
        optional("Refers-To-Record-Number", F.col("_refers").cast("string")),
        line("Payload-Length", F.col("_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("_bytes").cast("string"))),
        F.lit(EOL),
    )
    return text.cast("binary")


def _field(name: str) -> Column:
    """Value of a header line, null when there is none."""
    found = F.regexp_extract(F.col("header").cast("string"), f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(found != "", found)
