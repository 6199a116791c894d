"""WARC archives in which equal payloads are stored once.

Headers alone are shuffled by payload digest to find each payload's original; pages are
then written as response or revisit records with fresh headers, read back from the
archives, and revisits are resolved by joining them to the responses they refer to.

The archives are written and read by Spark's text source, so they may lie in any store.
A record ends in two line breaks, which is what the source puts between rows. Payloads may
hold such breaks, or whole records, themselves: every record therefore starts with the
identifier of its archive, a new random number, and is told from payload by it.

Cases: a null page is an empty payload. Null addresses are written as empty. A null
``page_id`` is never preferred as original. Rows that repeat page, address and payload
count one by one: one of them can be the response, the others revisit it.
Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm.common import new_folder, written

MIN_BYTES = 1000  # smaller payloads are always stored
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = "\r\n"


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per page: what its record will say, with the payload where it is stored."""
    page = F.md5(F.to_json(F.struct("page_id", "url"), {"ignoreNullFields": "false"}))
    digest = F.sha1(_payload())
    headers = pages.select(
        F.concat(page, digest).alias("page_key"),
        "page_id",
        "url",
        digest.alias("payload_digest"),
        F.octet_length(_payload()).cast("long").alias("payload_bytes"),
    )
    # headers shuffle by digest; a payload that a third of the pages share is combined first
    originals = (
        headers.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "url", "page_key")).alias("original"))
        .select("payload_digest", "original.*")
        .withColumnsRenamed({"page_id": "original_page", "url": "original_url", "page_key": "original_key"})
    )
    decided = headers.select("page_key", "payload_digest").distinct().join(originals, "payload_digest", "left")
    payloads = pages.select(F.concat(page, digest).alias("page_key"), "page_id", "url", _payload().alias("payload"))
    payloads = payloads.groupBy("page_key").agg(
        F.first("page_id").alias("page_id"),
        F.first("url").alias("url"),
        F.first("payload").alias("payload"),
        F.count("*").cast("int").alias("copies"),
    )
    rows = payloads.join(decided, "page_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    stored = F.col("original_key").isNull() | ((F.col("original_key") == F.col("page_key")) & (F.col("copy") == 1))
    return rows.withColumn("stored", stored)


def _urn(*parts) -> Column:
    """A record identifier that follows from what it names."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _address(column: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "[\r\n]", "%0A")


def _start(archive: str) -> str:
    return f"WARC/1.1{_BREAK}WARC-Warcinfo-ID: <urn:uuid:{archive}>{_BREAK}"


def write_archives(records: DataFrame, folder: str, archive: str) -> None:
    """Write planned records as WARC files."""
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(_BREAK * 2),
    )
    block = F.when(F.col("stored"), F.concat(http, F.col("payload"))).otherwise("")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_BREAK))

    key = F.col("page_key")
    own = _urn(F.lit(archive), key, F.col("copy").cast("string"))
    refers = F.concat(
        field("WARC-Profile", F.lit(PROFILE)),
        field("WARC-Refers-To", _urn(F.lit(archive), F.col("original_key"), F.lit("1"))),
        field("WARC-Refers-To-Target-URI", _address("original_url")),
    )
    record = F.concat(
        F.lit(_start(archive)),
        field("WARC-Type", F.when(F.col("stored"), "response").otherwise("revisit")),
        field("WARC-Record-ID", own),
        field("WARC-Date", F.lit(now)),
        field("WARC-Target-URI", _address("url")),
        F.when(F.col("page_id").isNotNull(), field("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("stored"), F.lit("")).otherwise(refers),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_BREAK),
        block,
    )
    records.select(record.alias("value")).write.option("lineSep", _BREAK * 2).option("compression", "gzip").text(folder)
    info = f"software: curbflow{_BREAK}format: WARC File Format 1.1"
    text = (
        f"{_start(archive)}WARC-Type: warcinfo{_BREAK}WARC-Record-ID: <urn:uuid:{archive}>{_BREAK}WARC-Date: {now}{_BREAK}"
        f"Content-Type: application/warc-fields{_BREAK}Content-Length: {len(info)}{_BREAK * 2}{info}"
    )
    head = records.sparkSession.range(1, numPartitions=1).select(F.lit(text).alias("value"))
    head.write.mode("append").option("lineSep", _BREAK * 2).option("compression", "gzip").text(folder)


def read_archives(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """One row per response or revisit record, with the payload that it holds."""
    rows = spark.read.option("lineSep", _BREAK * 2 + _start(archive)).text(folder)
    start = _start(archive)
    value = F.when(F.col("value").startswith(start), F.substring("value", len(start) + 1, 2**31 - 1)).otherwise(F.col("value"))
    rows = rows.select(value.alias("value")).withColumn("gap", F.instr("value", _BREAK * 2))
    head = F.concat(F.lit("\n"), F.substring("value", F.lit(1), F.col("gap") + 1))
    rows = rows.select(head.alias("head"), F.substring("value", F.col("gap") + 4, F.lit(2**31 - 1)).alias("block"))

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(found != "", found)

    rows = rows.select(
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("url"),
        field("X-Page-ID").cast("long").alias("page_id"),
        F.substring(field("WARC-Payload-Digest"), 6, 40).alias("digest"),
        field("WARC-Refers-To").alias("refers_to_id"),
        field("Content-Length").cast("int").alias("length"),
        "block",
    ).where("record_type in ('response', 'revisit')")
    # the last record of a file still has its closing breaks
    whole = F.when(
        F.octet_length("block") == F.col("length") + 4, F.expr("substring(block, 1, char_length(block) - 4)")
    ).otherwise(F.col("block"))
    rows = rows.withColumn("block", whole).withColumn("gap", F.instr("block", _BREAK * 2))
    payload = F.when(F.col("record_type") == "response", F.substring("block", F.col("gap") + 4, F.lit(2**31 - 1)))
    return rows.select("record_type", "record_id", "url", "page_id", "digest", "refers_to_id", payload.alias("payload"))


def resolve(records: DataFrame) -> DataFrame:
    """Size and digest of every record's full payload; a revisit takes the size of the
    response it refers to, and only if that has the digest it names. The payload
    itself is digested again, not taken from the header."""
    seen = written(
        records.select(
            "page_id",
            "record_type",
            "record_id",
            "digest",
            "refers_to_id",
            F.sha1("payload").alias("payload_digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        ),
        "warc-headers",
    )
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = seen.where("record_type = 'response'")
    direct = responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    targets = responses.select(
        F.col("record_id").alias("refers_to_id"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_digest").alias("digest"),
        F.col("payload_bytes").alias("target_bytes"),
    )
    revisits = seen.where("record_type = 'revisit'").select("page_id", "record_type", "digest", "refers_to_id")
    revisits = revisits.join(targets, ["refers_to_id", "digest"], "left")
    revisits = revisits.withColumnsRenamed({"target_bytes": "payload_bytes", "digest": "payload_digest"}).select(*columns)
    return direct.unionByName(revisits)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages as deduplicated archives, read these and report every record."""
    spark = pages.sparkSession
    folder, archive = new_folder(spark, "warc"), str(uuid.uuid4())
    write_archives(plan_records(pages, min_bytes), folder, archive)
    return resolve(read_archives(spark, folder, archive))
