"""Derivative WARC records: metadata and plain-text conversion of HTML responses.

A record is a row: record_id, type, target_uri, date, refers_to, content_type, headers (the source's own
named fields that a derivative carries), block, block_digest. All columns are built by SQL functions,
so derivatives are made where the responses are, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["record_id", "type", "target_uri", "date", "refers_to", "content_type", "headers", "block", "block_digest"]

# The character references that occur in running text.
ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def uuid_urn(*parts: Column) -> Column:
    """A record id that depends on its parts only, so that a repeated task names the record the same."""
    h = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, block ends become line ends, other tags blanks.

    Runs of blanks shrink to one and empty lines go; character references are resolved last.
    """
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"[\r\n\t]+", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|footer|header|title|head)>|<br[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for k, v in ENTITIES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.regexp_replace(t, r" +", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(t, r"^\n|\n$", ""))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records with an HTTP header block.

    A null page takes an empty payload; the id of a record comes from page_id, url and payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, html)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        uuid_urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit("")), F.md5(html)).alias("record_id"),
        F.lit("response").alias("type"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.create_map(F.lit("WARC-Payload-Digest"), digest(html)).alias("headers"),
        block.alias("block"),
        digest(block).alias("block_digest"),
    )


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response: metadata (warc-fields) and conversion (text/plain).

    Both refer to the response by WARC-Refers-To and carry its target, date, payload and block digest;
    metadata quotes the HTTP header lines. A response without a header end is all payload; a null block
    counts as empty. Records of other types are passed over. Every response gives its own two records,
    equal ones too; `keep` names further columns to carry.
    """
    block = F.coalesce(F.col("block"), F.lit(""))
    # text before the first empty line, and what follows it
    at = F.locate("\r\n\r\n", block)
    parted = responses.filter(F.col("type") == "response").select(
        *keep, "record_id", "target_uri", "date", "headers", "block_digest",
        F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise("").alias("http"),
        F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(block).alias("payload"),
    )
    payload_digest = F.coalesce(F.col("headers")["WARC-Payload-Digest"], digest(F.col("payload")))
    typed = F.regexp_extract("http", r"(?im)^Content-Type:[ \t]*([^;\r\n]*)", 1)
    source = F.create_map(F.lit("WARC-Refers-To-Target-URI"), F.coalesce("target_uri", F.lit("")), F.lit("WARC-Refers-To-Date"), F.coalesce("date", F.lit("")), F.lit("WARC-Refers-To-Block-Digest"), F.coalesce("block_digest", F.lit("")), F.lit("WARC-Refers-To-Payload-Digest"), payload_digest)
    text = html_text(F.col("payload"))
    fields = F.concat(
        F.lit("title: "), F.regexp_replace(title_of(F.col("payload")), r"\s+", " "), F.lit("\r\nsource-content-type: "), typed,
        F.lit("\r\nsource-payload-digest: "), payload_digest, F.lit("\r\nsource-header: "), F.replace("http", F.lit("\r\n"), F.lit("\r\nsource-header: ")), F.lit("\r\n"),
    )
    made = parted.select(
        *keep, F.col("record_id").alias("source_id"), "target_uri", "date", source.alias("headers"),
        F.explode(F.array(F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")), F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")))).alias("r"),
    )
    return made.select(
        *keep, uuid_urn(F.col("r.type"), F.col("source_id")).alias("record_id"), F.col("r.type").alias("type"), "target_uri", "date", F.col("source_id").alias("refers_to"),
        F.col("r.content_type").alias("content_type"), "headers", F.col("r.block").alias("block"), digest(F.col("r.block")).alias("block_digest"),
    )


def serialize(records: DataFrame) -> DataFrame:
    """WARC/1.1 text of each record (column warc): named fields, an empty line, the block, two line ends."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    block = F.coalesce(F.col("block"), F.lit(""))
    more = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.col("headers")[k], F.lit("\r\n"))), "")
    text = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")), F.coalesce(more, F.lit("")), line("Content-Type", F.col("content_type")), line("WARC-Block-Digest", F.col("block_digest")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    )
    return records.select("record_id", text.alias("warc"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one a partition, compressed by gzip; the two line ends after a block separate the rows."""
    rows = serialize(records).select(F.expr("substring(warc, 1, length(warc) - 4)").alias("warc"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC/1.1 text files (plain or gzip), one row each, split at the version line.

    Blocks are cut by Content-Length. A block that holds the version line itself is cut short there.
    """
    raw = spark.read.option("lineSep", "WARC/1.1\r\n").text(path).filter(F.length("value") > 0)
    at = F.locate("\r\n\r\n", F.col("value"))
    parted = raw.select(F.substring("value", F.lit(1), at - 1).alias("head"), F.substring("value", at + 4, F.length("value")).alias("rest"))
    pairs = F.transform(F.split("head", "\r\n"), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substring(x, F.locate(": ", x) + 2, F.length(x)).alias("v")))
    named = parted.select(F.map_from_entries(pairs).alias("h"), "rest")
    length = F.col("h")["Content-Length"].cast("int")
    own = ["WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "Content-Type", "WARC-Block-Digest", "Content-Length"]
    return named.select(
        F.col("h")["WARC-Record-ID"].alias("record_id"), F.col("h")["WARC-Type"].alias("type"), F.col("h")["WARC-Target-URI"].alias("target_uri"), F.col("h")["WARC-Date"].alias("date"),
        F.col("h")["WARC-Refers-To"].alias("refers_to"), F.col("h")["Content-Type"].alias("content_type"), F.map_filter("h", lambda k, _: ~k.isin(own)).alias("headers"),
        F.substring(F.col("rest").cast("binary"), F.lit(1), length).cast("string").alias("block"), F.col("h")["WARC-Block-Digest"].alias("block_digest"),
    )
