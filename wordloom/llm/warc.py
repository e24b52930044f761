"""WARC derivatives: linked metadata and plain-text conversion records of response records.

`responses` makes response records of a table of pages, `read_warc` reads them from WARC files,
`derive` gives each response's two derivatives, `serialised` their bytes. Both derivatives refer
to the response (WARC-Refers-To) and the metadata record is concurrent to the conversion; source
headers, date, target and payload digest are preserved: a digest that the source record itself
states (columns payload_digest and block_digest, as `read_warc` gives them) is kept as it stands,
else the payload's own is made. Record ids come from the response's id, so a repeated run gives
the same records.

Edge cases: a null payload converts to the empty text (its digest is that of no bytes); a null
target stays null; a response without an id gives derivatives that refer to null; repeated
responses give repeated derivatives; an empty table gives none; payloads may be of any length that
one row can hold; a stated digest that is null or blank counts as not stated.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

#: Tags that end a line of text, and the character references that are resolved (&amp; last).
LINE_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
LINE = rf"(?i)\s*</?(?:{LINE_TAGS})\b[^>]*>\s*"
TAG = r"</?[A-Za-z!][^>]*>"
TITLE, LANG, LINK = r"(?is)<title\b[^>]*>(.*?)</title", r'(?i)<html\b[^>]*\blang="([^"]*)"', r'(?i)<a\s[^>]*?href="([^"]*)"'
CRLF = "\r\n"


def resolved(text: Column) -> Column:
    for reference, char in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Visible text, one line a block: hidden parts and tags removed, references resolved, blanks folded."""
    t = F.regexp_replace(html, HIDDEN, "")
    t = F.regexp_replace(t, LINE, "\n")
    t = resolved(F.regexp_replace(t, TAG, ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _uuid(seed: Column) -> Column:
    h = F.md5(seed.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html): record_id, target_uri, date, http_headers, payload. Dates count seconds from 2024 by page."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    return pages.select(
        F.col("page_id"),
        _uuid(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), "url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), size.cast("string")).alias("http_headers"),
        F.col("html").alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two rows per response row (record_id, target_uri, date, http_headers, payload and others, which are kept but for these).

    type, record_id, refers_to, concurrent_to, target_uri, date, content_type, source_headers,
    source_payload_digest, block_digest, content_length, block.
    """
    own = ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest")
    made = ("type", "refers_to", "concurrent_to", "content_type", "source_headers", "source_payload_digest", "block_digest", "content_length", "block")
    others = [c for c in source.columns if c.lower() not in own + made]
    html = F.coalesce(F.col("payload"), F.lit(""))
    title = F.btrim(F.regexp_replace(resolved(F.regexp_extract(html, TITLE, 1)), r"\s+", " "))
    links = F.regexp_extract_all(html, F.lit(LINK), 1)
    stated = {c.lower() for c in source.columns}
    digest = F.concat(F.lit("sha256:"), F.sha2(html, 256))
    if "payload_digest" in stated:
        digest = F.coalesce(F.when(F.trim(F.col("payload_digest")) != "", F.col("payload_digest")), digest)
    kept = F.when(F.trim(F.col("block_digest")) != "", F.col("block_digest")) if "block_digest" in stated else F.lit(None).cast("string")
    base = source.select(
        *others,
        *(F.col(c) for c in own[:4]),
        plain_text(html).alias("text"),
        title.alias("title"),
        F.regexp_extract(html, LANG, 1).alias("lang"),
        links.alias("links"),
        digest.alias("digest"),
        kept.alias("record_digest"),
    )
    conversion_id, metadata_id = (_uuid(F.concat_ws("|", F.lit(k), "record_id")) for k in ("conversion", "metadata"))
    fields = F.concat(
        F.concat_ws(
            CRLF,
            F.concat(F.lit("title: "), "title"),
            F.concat(F.lit("language: "), "lang"),
            F.concat(F.lit("source-payload-digest: "), "digest"),
            F.concat(F.lit("source-block-digest: "), "record_digest"),
            F.concat(F.lit("outlink-count: "), F.size("links").cast("string")),
            F.transform("links", lambda x: F.concat(F.lit("outlink: "), x)),
        ),
        F.lit(CRLF),
    )
    two = F.array(
        F.struct(F.lit("conversion").alias("type"), conversion_id.alias("id"), F.lit(None).cast("string").alias("with"), F.lit("text/plain; charset=utf-8").alias("kind"), F.col("text").alias("block")),
        F.struct(F.lit("metadata").alias("type"), metadata_id.alias("id"), conversion_id.alias("with"), F.lit("application/warc-fields").alias("kind"), fields.alias("block")),
    )
    each = base.select(*others, *own[:4], "digest", F.explode(two).alias("r"))
    return each.select(
        *others,
        F.col("r.type").alias("type"),
        F.col("r.id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("r.with").alias("concurrent_to"),
        "target_uri",
        "date",
        F.col("r.kind").alias("content_type"),
        F.col("http_headers").alias("source_headers"),
        F.col("digest").alias("source_payload_digest"),
        F.concat(F.lit("sha256:"), F.sha2("r.block", 256)).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        F.col("r.block").alias("block"),
    )


def serialised() -> Column:
    """The bytes of a derived record in a WARC file; each line of the source's headers is a field WARC-Source-Header."""
    field = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        field("WARC-Type", "type"),
        field("WARC-Record-ID", "record_id"),
        field("WARC-Refers-To", "refers_to"),
        field("WARC-Concurrent-To", "concurrent_to"),
        field("WARC-Target-URI", "target_uri"),
        field("WARC-Date", "date"),
        field("WARC-Source-Payload-Digest", "source_payload_digest"),
        F.when(F.col("source_headers").isNotNull(), F.concat(F.lit("WARC-Source-Header: "), F.replace(F.col("source_headers"), F.lit(CRLF), F.lit(f"{CRLF}WARC-Source-Header: ")))),
        field("WARC-Block-Digest", "block_digest"),
        field("Content-Type", "content_type"),
        field("Content-Length", "content_length"),
    )
    return F.concat(head, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2)).cast("binary")


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names lower-cased) and block of each record of a WARC file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = dict(x.split(":", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        size = int(fields.get("content-length", "0"))
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files: record_id, target_uri, date, http_headers, payload (UTF-8, invalid bytes replaced), payload_digest, block_digest.

    Digests are the records' own; a payload without one gets that of its bytes as they are in the file.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in _records(data.as_py()):
                    if fields.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        rows.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode("utf-8", "replace"), body.decode("utf-8", "replace"), fields.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest(), fields.get("warc-block-digest")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, block_digest string")
