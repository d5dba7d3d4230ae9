"""Content-addressed WARC archive.

Payload bytes are stored once, under a verified SHA-256 digest; record headers are
stored apart, exactly, with the digest of their payload. The record of a page is
its header followed by the payload (``response``) or by nothing (``revisit``, which
names the response). Joining headers to payloads gives back every record, and
every page's payload, byte for byte.

The first page (smallest id) with a payload is its response. Which page that is
comes from an aggregate over digests, so payloads are not grouped. A payload of one
page alone is stored where it is read; only those that more pages share are shuffled,
to meet the page they belong to. A payload that a third of all pages share is one row
of the store. A reader joins headers to payloads and rebuilds every page's record; what it
tells of a payload (size and digest) is counted from the rebuilt bytes. That join is
split by adaptive skew handling.

Edge cases: a null html is an empty payload; a null url gives no target URI; line
breaks in a url are percent-encoded; a very long payload is one row, whole; rows that repeat the id and payload of a
response are responses too; pages with a null id sort last, and are responses only
where no page with the same payload has an id; an empty table gives empty stores;
extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.common import discard, materialize, table
from priorframe.llm.node_filter import maybe_among

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """headers: page_id, digest, header. payloads: digest, payload, n_bytes."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: each 20 bits are 5 hex digits and 4 characters."""
    hex_ = F.sha1(payload)
    out = []
    for group in range(8):
        bits = F.conv(F.substring(hex_, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substr(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*out)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_header(page_id: Column, url: Column, n_bytes: Column, digest: Column, is_response: Column, refers_to: Column, date: str) -> Column:
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        line("WARC-Record-ID", record_id(page_id)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(is_response, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", record_id(refers_to)), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_response, n_bytes).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Store pages. Payloads of fewer than min_bytes are never revisited: each is stored with its own page."""
    page = F.col(id_col)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(page.alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    content = F.sha2("payload", 256)
    # Below min_bytes the id is part of the address, so that nothing is shared.
    address = F.when(F.octet_length("payload") >= min_bytes, content).otherwise(F.concat_ws("-", content, F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    facts = rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"), address.alias("digest"))
    facts = materialize(facts, "warc-facts")
    first = materialize(facts.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "warc-first")
    known = facts.join(first, "digest")
    is_response = F.col("page_id").eqNullSafe(F.col("first_id"))
    header = record_header(F.col("page_id"), F.col("url"), F.col("n_bytes"), F.col("sha1"), is_response, F.col("first_id"), date)
    headers = materialize(known.select("page_id", "digest", header.alias("header")), "warc-headers")
    # The stored bytes are those of the first page. Rows that repeat it have the same
    # key, so they fold into one where the join has already brought them together.
    key = lambda digest, page_id: F.concat_ws("/", digest, F.coalesce(page_id.cast("string"), F.lit("null")))
    many = first.filter("n > 1")
    place = F.xxhash64("digest")
    stored = rows.select(key(address, F.col("page_id")).alias("key"), address.alias("digest"), "payload")
    stored = stored.withColumn("place", place).withColumn("shared", maybe_among(many.select(place.alias("node")), "place"))
    alone = stored.filter("not shared").select("digest", "payload")
    owner = first.select(key(F.col("digest"), F.col("first_id")).alias("key")).hint("merge")
    owned = stored.filter("shared").drop("shared").join(owner, "key", "left_semi").dropDuplicates(["key"]).select("digest", "payload")
    payloads = materialize(alone.unionByName(owned).withColumn("n_bytes", F.octet_length("payload").cast("long")), "warc-payloads")
    discard(facts, first)
    return Archive(headers, payloads)


def header_field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1).try_cast("long")


def verified_payloads(archive: Archive) -> DataFrame:
    """The payload store, failing where bytes don't have the digest they are stored under."""
    same = F.sha2("payload", 256) == F.substring("digest", 1, 64)
    return archive.payloads.withColumn("payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest")))))


def read_archive(archive: Archive) -> DataFrame:
    """Records read back: page_id, record_type, refers_to, url, original (the header with the page's whole payload), payload, payload_bytes and payload_digest, and record (the exact bytes).

    A page's payload is cut out of its rebuilt original, behind the header, and its size
    and digest are those of these bytes. Fails where the digest that a header states is
    not theirs.
    """
    stored = verified_payloads(archive).select("digest", F.col("payload").alias("stored"))
    joined = archive.headers.join(stored.hint("merge"), "digest")
    is_response = header_field("WARC-Type") == "response"
    end, n_end = F.lit("\r\n\r\n").cast("binary"), 4
    header = F.col("header").cast("binary")
    joined = joined.withColumn("original", F.concat(header, "stored", end))
    joined = joined.withColumn("payload", F.substring("original", F.octet_length(header) + 1, F.octet_length("original") - F.octet_length(header) - n_end))
    joined = joined.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    record = F.when(is_response, F.col("original")).otherwise(F.concat(header, end))
    stated = F.substring(header_field("WARC-Payload-Digest"), 6, 32)
    return joined.select(
        page_of(header_field("WARC-Record-ID")).alias("page_id"),
        header_field("WARC-Type").alias("record_type"),
        page_of(header_field("WARC-Refers-To")).alias("refers_to"),
        "payload_bytes",
        F.when(stated == F.col("payload_digest"), stated).otherwise(F.raise_error(F.lit("header and payload have different digests"))).alias("payload_digest"),
        header_field("WARC-Target-URI").alias("url"),
        "original",
        "payload",
        record.alias("record"),
    )


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first_id FROM p),
g AS (SELECT page_id, n, first_id, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)) AS v FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM g
"""

QUERIES = {"op5_warc_archive": op5_warc_archive}
SQL = {"op5_warc_archive": OP5_SQL}
