"""Operator 9: a content-addressed web archive.

``write_archive`` stores every distinct payload once, under its SHA-256, and
the exact bytes of each record's header apart from it. The payload with the
smallest page id is a response; equal ones are revisits that name it.
``original_records`` joins headers and payloads into the full records again,
after checking each stored payload against both digests, and ``read_archive``
tells from the rebuilt records what they say: a response's payload is cut out of
its record by the header's length, and measured and digested anew.

A header's values are escaped, so that a line break in a url opens no field:
backslash, CR and LF become ``\\\\``, ``\\r`` and ``\\n`` and are read back so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialise

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1; five hex digits are four of its characters."""
    digest, alphabet, parts = F.sha1(payload), F.lit(BASE32), []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substr(alphabet, F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


#: What a header value may not hold, and what stands for it; the backslash first.
ESCAPES = (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"))


def escaped(value: Column) -> Column:
    for bad, good in ESCAPES:
        value = F.replace(value, F.lit(bad), F.lit(good))
    return value


def unescaped(value: Column) -> Column:
    """The value that ``escaped`` was given; no lone backslash is left to be misread."""
    parts = F.split(value, r"\\\\")  # between two of these, a backslash only opens CR or LF
    breaks = lambda x: F.replace(F.replace(x, F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(parts, breaks), "\\")


def _header(columns: dict[str, Column]) -> Column:
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), escaped(value), F.lit("\r\n"))).otherwise("")
    return F.concat(F.lit("WARC/1.1\r\n"), *(line(k, v) for k, v in columns.items()), F.lit("\r\n")).cast("binary")


def _join_digests(rows: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """``rows`` joined to ``first`` (digest, copies, ...) by digest, without a hot digest in one task.

    Fewer than ``width`` digests hold more than 1/width of the rows each: their
    few light columns are broadcast; all others are joined by hash.
    """
    total = first.select(F.sum("copies")).scalar()
    is_hot = F.col("copies") * width > total
    hot = materialise(first.where(is_hot), "hot-digests")
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(first.where(~is_hot), "digest")
    return cold.unionByName(rows.join(F.broadcast(hot), "digest"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``path/payloads`` and ``path/records`` for all rows of (page_id, url, html).

    A null html is an empty payload; a null url leaves its header line out.
    Rows that repeat the page id of a payload's response are responses too, but
    its payload is stored once. Payloads below ``min_bytes`` are all responses.
    An empty table writes two empty tables; further columns are not read.
    Payloads are pre-aggregated by digest before the shuffle, so a third of all
    rows with one payload moves that payload once for each task at most, and
    the few hot digests are joined by broadcast. A very long payload is one cell
    throughout. A backslash or line break in a url is escaped in the header.
    """
    spark = pages.sparkSession
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    (keyed.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.any_value("payload").alias("payload"),
                                 F.count(F.lit(1)).alias("copies"))
        .withColumn("sha1", base32_sha1(F.col("payload")))
        .write.parquet(f"{path}/payloads"))
    first = spark.read.parquet(f"{path}/payloads").select("digest", "first_page", "sha1", "copies")
    light = keyed.select("page_id", "url", "digest", F.octet_length("payload").alias("size"))
    joined = _join_digests(light, first, int(spark.conf.get("spark.sql.shuffle.partitions")))
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = _header({
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
        "WARC-Record-ID": urn(F.col("page_id")),
        "WARC-Date": F.lit(WARC_DATE),
        "WARC-Target-URI": F.col("url"),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("sha1")),
        "WARC-Refers-To": F.when(revisit, urn(F.col("first_page"))),
        "WARC-Profile": F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        "Content-Type": F.lit("text/html; charset=utf-8"),
        "Content-Length": F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")),
    })
    joined.select("page_id", "digest", header.alias("header")).write.parquet(f"{path}/records")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; one that does not match its digest stops the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (base32_sha1(F.col("payload")) == F.col("sha1"))
    return stored.withColumn("payload", F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary")))


def _field(name: str) -> Column:
    """A header field as it was given; the empty string where the record has none."""
    return unescaped(F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1))


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, digest, record): each record's exact bytes; a revisit has no body of its own."""
    records = spark.read.parquet(f"{path}/records")
    # One response for each payload, and rows that repeat its page id: the bodies are moved no more often than stored.
    body = _payloads(spark, path).select("digest", "payload")
    end = F.lit("\r\n\r\n").cast("binary")
    is_response = _field("WARC-Type") == "response"
    full = records.where(is_response).join(body, "digest").select(
        "page_id", "digest", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(records.where(~is_response).select(
        "page_id", "digest", F.concat("header", end).alias("record")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, as the rebuilt record says; a revisit's length is that of the response it names."""
    page = lambda name: F.regexp_extract(_field(name), r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    # The header is all up to the first empty line, the payload as many bytes after that line as the header states.
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    records = original_records(spark, path).withColumn("header", F.concat(head, F.lit("\r\n")))
    length = _field("Content-Length").cast("int")
    payload = F.substring("record", F.octet_length("header") + 3, length)
    common = [number(page("WARC-Record-ID")).alias("page_id")]
    responses = records.where(_field("WARC-Type") == "response").select(*common, payload.alias("payload")).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    sizes = _payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "copies")
    revisits = records.where(_field("WARC-Type") == "revisit").select(
        *common, "digest", F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), number(page("WARC-Refers-To")).alias("refers_to"))
    revisits = _join_digests(revisits, sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return responses.unionByName(revisits.select(responses.columns))
