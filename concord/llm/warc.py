"""Not-modified revisits of a web archive, resolved to the response they repeat.

A revisit record says that a server answered *304 Not Modified*. It is joined as
of its time to the latest earlier full response of the same canonical URL; the
validators decide whether that response is the one meant, and the headers that
a 304 may update are merged over the stored ones.

The as-of join works in two steps, so that a URL with very many captures is no
task of its own: inside buckets of time a window finds the latest response, and
the last response of each bucket (one row per URL and bucket) is carried to the
buckets that follow. Payloads are not moved; the result names the response.

Defined cases: a record without URL or time is never resolved nor resolved to;
*earlier* is strict; of responses at one time the greater record id counts;
repeated rows are resolved one by one; of header names that differ in case only,
the first in the order of their bytes counts (``ETag`` before ``etag``); headers
may be null; an empty table gives an empty result; extra columns are ignored,
and payloads of any length are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: The header fields that a 304 answer may carry for the stored response (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query fields that name no content.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` and default port, no scheme, no fragment, sorted query without tracking fields."""
    bare = F.regexp_replace(F.btrim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\d*\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda f: (f != "") & ~f.rlike(TRACKING)))
    query = F.array_join(fields, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with the permitted ones of the 304 put over them; names in lower case."""
    def low(headers: Column) -> Column:
        entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("given"), e["value"].alias("value"))))
        once = F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]))
        return F.map_from_entries(F.transform(once, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    empty = F.create_map().cast("map<string,string>")
    stored, update = F.coalesce(low(stored), empty), F.coalesce(low(update), empty)
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """One row per revisit of ``records``: record_id, warc_type, uri, ts, etag, last_modified, headers.

    ``verdict``: *etag* or *last_modified* (what agreed), *changed* (a validator
    disagrees), *unchecked* (no validator on both sides), *missing* (no earlier
    response). Only the first two carry merged headers.
    """
    seen = materialize(
        records.select(
            "record_id", "warc_type", canonical_url(F.col("uri")).alias("url"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "etag", "last_modified", "headers",
        ).withColumn("bucket", F.floor(F.col("us") / (bucket_seconds * 1_000_000))).filter("warc_type IN ('response', 'revisit')"),
        "captures",
    )
    told = F.struct("us", "record_id", "ts", "etag", "last_modified", F.map_entries("headers").alias("headers"))
    latest = seen.filter("url IS NOT NULL AND us IS NOT NULL").groupBy("url", "bucket").agg(F.max(F.when(F.col("warc_type") == "response", told)).alias("_last"))
    earlier = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("url", "bucket", F.max("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy("url", "bucket").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    near = seen.filter("url IS NOT NULL AND us IS NOT NULL").withColumn("_near", F.max(F.when(F.col("warc_type") == "response", told)).over(inside))
    dated = near.filter("warc_type = 'revisit'").join(carried, ["url", "bucket"], "left").withColumn("_found", F.coalesce("_near", "_carried")).drop("_near", "_carried")
    undated = seen.filter("warc_type = 'revisit' AND (url IS NULL OR us IS NULL)").withColumn("_found", F.lit(None).cast(dated.schema["_found"].dataType))
    found = dated.unionByName(undated)
    strong = lambda tag: F.regexp_replace(tag, "^W/", "")  # noqa: E731  304 answers compare weakly
    verdict = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("etag").isNotNull() & F.col("_found.etag").isNotNull(), F.when(strong(F.col("etag")) == strong(F.col("_found.etag")), "etag").otherwise("changed"))
        .when(F.col("last_modified").isNotNull() & F.col("_found.last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("_found.last_modified"), "last_modified").otherwise("changed"))
        .otherwise("unchecked")
    )
    merged = merge_headers(F.map_from_entries("_found.headers"), F.col("headers"))
    return found.withColumn("verdict", verdict).select(
        "record_id", "url", "ts", F.col("_found.record_id").alias("response_id"), F.col("_found.ts").alias("response_ts"), "verdict",
        F.when(F.col("verdict").isin("etag", "last_modified"), merged).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records that follow from the rows of ``pages`` alone.

    Each page is one response; every fifth was captured again with another
    body; every second one was revisited later under a variant of its URL, with
    its entity tag, a stale one, or only its modification time.
    """
    host = F.regexp_extract("url", r"^(https?://)([^/?#]*)(.*)$", 2)
    shown = F.concat(F.lit("HTTP://"), F.upper(host), F.regexp_replace("url", r"^https?://[^/?#]*", ""))
    first = F.col("page_id") * 7919 % 525_600
    at = lambda minutes: F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60)
    tag = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    row = lambda kind, letter, uri, ts, etag, modified, headers: F.struct(
        F.concat(F.lit(letter), F.col("page_id").cast("string")).alias("record_id"), F.lit(kind).alias("warc_type"), uri.alias("uri"), ts.alias("ts"),
        etag.cast("string").alias("etag"), modified.cast("string").alias("last_modified"), headers.alias("headers"),
    )
    header = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)])
    page, size = F.col("page_id"), F.octet_length(F.col("html")).cast("string")
    stamp = lambda minutes: F.date_format(at(minutes), "yyyy-MM-dd HH:mm:ss")
    again, later = first + (page % 50 + 1) * 1440, first + page % 97 * 60
    rows = F.array(
        row("response", "r", F.col("url"), at(first), tag(F.col("body")), stamp(first), header(Content_Type=F.lit("text/html"), Content_Length=size, Date=stamp(first), Cache_Control=F.lit("max-age=60"))),
        F.when(page % 5 == 0, row("response", "s", F.col("url"), at(again), tag(F.substring("body", 1, 16)), stamp(again), header(Content_Type=F.lit("text/html"), Content_Length=size, Date=stamp(again), Cache_Control=F.lit("no-cache")))),
        F.when(
            page % 2 == 0,
            row(
                "revisit", "v", F.when(page % 4 == 0, F.concat(shown, F.lit("#seen"))).otherwise(F.col("url")), at(later),
                F.when(page % 10 == 2, F.lit('"stale"')).when(page % 10 != 4, tag(F.col("body"))),
                F.when(page % 10 == 4, stamp(first)), header(Date=stamp(later), Cache_Control=F.lit("max-age=600"), Content_Length=F.lit("0")),
            ),
        ),
    )
    based = pages.select("page_id", "url", "html", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("body"))
    return based.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")
