"""Resolution of not-modified revisit records of WARC files.

A crawler that gets "304 Not Modified" stores a revisit record without payload. It is resolved by an as-of join: the
latest full response (``response`` with status 200) of the same canonical URL whose date is earlier. The
validators are then checked (RFC 9110: entity tags by weak comparison, else Last-Modified), and the stored
headers are updated by those of the 304 that may replace them (RFC 9111, section 3.2).

The join keeps no URL in one task, however often it was fetched: dates are cut at their quantiles into ``BLOCKS`` blocks,
each record looks back within its URL and block, and blocks look back over one row per URL and block. Payloads aren't
shuffled, only their digests; ``with_payloads`` brings them at the end.

Records have record_id, record_type, target_uri, warc_date (timestamp), http_headers (the header block as
text) and payload_digest; other columns are ignored. Nulls: a revisit with a null URL or date has no earlier response, a null
header block has no headers. Ties: of full responses of one date the greatest record_id counts; one of the
revisit's own date is not earlier. Repeated rows are each resolved; repeated full responses count once. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

BLOCKS = 256
#: Query parameters that name a visitor's way, not a page.
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid)(=.*)?$"
#: Header fields of a 304 that don't replace stored ones: they speak of this message or of a body it hasn't.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www and default port; path without last slash; sorted query without tracking."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[0-9]*\\.", ""), ":(80|443)?$", "")
    rest = F.regexp_replace(plain, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.split(F.regexp_replace(rest, "^[^?]*[?]?", ""), "&")
    query = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def header_fields(block: Column) -> Column:
    """(name in lower case, value) of each field of a header block, in order."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.rlike("^[^: ]+:"))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.substring_index(x, ":", 1)).alias("name"),
            F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"),
        ),
    )


def field(fields: Column, name: str) -> Column:
    """The last value of a field, or null."""
    return F.try_element_at(F.filter(fields, lambda f: f["name"] == name), F.lit(-1))["value"]


def status_code(block: Column) -> Column:
    return F.regexp_extract(F.coalesce(block, F.lit("")), "^HTTP/[0-9.]+ ([0-9]{3})", 1)


def merge_fields(stored: Column, fresh: Column) -> Column:
    """Stored fields, updated by the permitted ones of a 304, as sorted ``name: value`` lines."""
    kept = F.array(*[F.lit(n) for n in KEPT_FIELDS])
    news = F.filter(fresh, lambda f: ~F.array_contains(kept, f["name"]))
    names = F.transform(news, lambda f: f["name"])
    old = F.filter(stored, lambda f: ~F.array_contains(names, f["name"]))
    lines = F.transform(F.concat(old, news), lambda f: F.concat(f["name"], F.lit(": "), f["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url, referred_id, status, payload_digest and headers.

    ``status`` is resolved, validator_mismatch, no_validator (neither side has one in common, so the response
    stands) or no_earlier_response. Digest and headers are null unless the response stands.
    """
    dated = records.select(
        "record_id",
        canonical_url(F.col("target_uri")).alias("url"),
        F.unix_micros(F.col("warc_date").cast("timestamp")).alias("at"),
        "http_headers",
        "payload_digest",
        ((F.col("record_type") == "response") & (status_code(F.col("http_headers")) == "200")).alias("full"),
        (F.col("record_type") == "revisit").alias("revisit"),
    ).filter("full or revisit")
    dated = write_table(dated, "captures")
    marks = [i / BLOCKS for i in range(1, BLOCKS)]
    ends = dated.agg(F.percentile_approx("at", marks, 10_000)).first()[0] or []
    ends = F.array(*[F.lit(e).cast("long") for e in sorted(set(ends))])
    block = F.size(F.filter(ends, lambda e: e <= F.col("at")))
    light = dated.filter("url is not null and at is not null").select("record_id", "url", "at", "full", "revisit", block.alias("block"))
    latest = F.max(F.when(F.col("full"), F.struct("at", "record_id")))
    back = Window.partitionBy("url", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    blocks_back = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        light.groupBy("url", "block")
        .agg(latest.alias("last"))
        .select("url", "block", F.max("last").over(blocks_back).alias("from_earlier"))
    )
    referred = (
        light.withColumn("from_own", latest.over(back))
        .filter("revisit")
        .join(earlier, ["url", "block"])
        .select("record_id", "url", "at", F.coalesce("from_own", "from_earlier")["record_id"].alias("referred_id"))
        .distinct()
    )
    responses = (
        dated.filter("full")
        .groupBy(F.col("record_id").alias("referred_id"))
        .agg(F.first("http_headers").alias("stored_headers"), F.first("payload_digest").alias("stored_digest"))
    )
    revisits = dated.filter("revisit").select("record_id", "url", "at", "http_headers")
    joined = (
        revisits.join(
            referred.select("record_id", F.col("url").alias("u"), F.col("at").alias("t"), "referred_id"),
            (F.col("u") == F.col("url")) & (F.col("t") == F.col("at")) & revisits["record_id"].eqNullSafe(referred["record_id"]),
            "left",
        )
        .select(revisits["record_id"], "url", "http_headers", "referred_id")
        .join(responses, "referred_id", "left")
    )
    stored, fresh = F.col("stored"), F.col("fresh")
    same_tag = _weak(field(stored, "etag")) == _weak(field(fresh, "etag"))
    same_date = field(stored, "last-modified") == field(fresh, "last-modified")
    matches = F.coalesce(same_tag, same_date)
    stands = F.col("status").isin("resolved", "no_validator")
    return (
        joined.withColumn("stored", header_fields(F.col("stored_headers")))
        .withColumn("fresh", header_fields(F.col("http_headers")))
        .withColumn(
            "status",
            F.when(F.col("referred_id").isNull(), "no_earlier_response")
            .when(matches, "resolved")
            .when(~matches, "validator_mismatch")
            .otherwise("no_validator"),
        )
        .select(
            "record_id",
            "url",
            "referred_id",
            "status",
            F.when(stands, F.col("stored_digest")).alias("payload_digest"),
            F.when(stands, merge_fields(stored, fresh)).alias("headers"),
        )
    )


def with_payloads(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the ``payload`` of the response each refers to."""
    payloads = records.filter("record_type = 'response'").select(F.col("record_id").alias("referred_id"), "payload")
    return resolved.join(payloads, "referred_id", "left")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records of two crawls of ``pages``: every page in full, every third again in a new version, and all revisited.

    Visits are seconds apart in the order of page_id, a revisit is to a variant of the URL, and some revisits come before any response or
    carry another version's entity tag, or only a date.
    """
    start = F.lit(1_700_000_000).cast("long")
    n = F.col("page_id")
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    modified = F.concat(F.lit("day "), F.pmod(n, F.lit(400)).cast("string"))
    bare = F.regexp_replace(F.col("url"), "^[a-z]+://(www[.])?", "")

    def block(status: str, *fields: Column) -> Column:
        return F.concat_ws("\r\n", F.lit(f"HTTP/1.1 {status}"), *fields, F.lit(""))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    size = F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    first = F.struct(
        (4 * n).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.timestamp_seconds(start + n).alias("warc_date"),
        block(
            "200 OK", line("ETag", F.concat(F.lit('"'), tag, F.lit('"'))), line("Last-Modified", modified),
            line("Content-Type", F.lit("text/html")), line("Content-Length", size), line("Cache-Control", F.lit("max-age=60")),
        ).alias("http_headers"),
        tag.alias("payload_digest"),
    )
    second = F.struct(
        (4 * n + 1).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.concat(F.lit("https://www."), bare).alias("target_uri"),
        F.timestamp_seconds(start + n + 5_000_000).alias("warc_date"),
        block("200 OK", line("ETag", F.concat(F.lit('W/"2-'), tag, F.lit('"'))), line("Server", F.lit("second"))).alias("http_headers"),
        F.md5(F.concat(F.lit("2"), tag)).alias("payload_digest"),
    )
    shift = F.when(n % 11 == 0, -1).when(n % 2 == 0, 2_000_000).otherwise(9_000_000)
    old_tag = line("ETag", F.concat(F.lit('"'), tag, F.lit('"')))
    new_tag = line("ETag", F.concat(F.lit('"2-'), tag, F.lit('"')))
    validator = F.when(n % 7 == 0, line("Last-Modified", modified)).when((n % 3 == 0) & (n % 2 == 1) & (n % 5 != 0), new_tag).otherwise(old_tag)
    revisit = F.struct(
        (4 * n + 2).alias("record_id"),
        F.lit("revisit").alias("record_type"),
        F.concat(F.lit("http://"), bare, F.lit("#again")).alias("target_uri"),
        F.timestamp_seconds(start + n + shift).alias("warc_date"),
        block("304 Not Modified", validator, line("Content-Length", F.lit("0")), line("Cache-Control", F.lit("max-age=9"))).alias("http_headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    records = F.filter(F.array(first, second, revisit), lambda r: (r["record_id"] % 4 != 1) | (F.shiftright(r["record_id"], 2) % 3 == 0))
    return pages.select(F.explode(records).alias("r")).select("r.*")
