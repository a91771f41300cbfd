"""WARC not-modified revisits: as-of join to the latest earlier full response.

Records share a canonical URL; each revisit takes the latest response captured
strictly earlier, its validators are checked, and the permitted headers of the
not-modified answer replace the stored ones.

The as-of join is two-level: within ``url, time bucket`` a window finds the latest
earlier response, and the last response of each bucket (one row a bucket, combined
before the shuffle) is carried to later buckets of the URL.  A URL with a large
share of all captures is thereby split by time.

Defined cases: records without a URL or a capture time match nothing; responses at
the very same time don't count as earlier; of several responses at one time the largest
``record_id`` wins; null headers are none, and a header without a name is no one's predecessor; repeated revisits are resolved one by one; a revisit without
validators is ``unverified``; an empty table gives no rows.  Columns that aren't named in
``RECORD`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = ("record_id", "url", "ts", "kind", "etag", "last_modified", "headers", "payload_digest")

#: Header fields that a 304 answer may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

#: Query parameters that don't select content.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without closing
    slashes, content-selecting parameters in order; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers in their order; where a name of the not-modified answer is permitted, its fields stand in the
    place of the first stored one of that name, and those of names that aren't stored follow at the end."""

    def named(x: Column, y: Column) -> Column:
        return F.lower(x["name"]) == F.lower(y["name"])

    old = F.coalesce(stored, F.array())
    allowed = F.filter(F.coalesce(fresh, F.array()), lambda h: F.lower(h["name"]).isin(*PERMITTED))

    def placed(h: Column, i: Column) -> Column:
        updates = F.filter(allowed, lambda f: named(f, h))
        again = F.exists(F.slice(old, F.lit(1), i), lambda x: named(x, h))
        return F.when(F.size(updates) == 0, F.array(h)).when(again, F.slice(updates, 1, 0)).otherwise(updates)

    added = F.filter(allowed, lambda f: ~F.exists(old, lambda h: named(f, h)))
    return F.concat(F.flatten(F.transform(old, placed)), added)


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3_600) -> DataFrame:
    """One row a revisit: ``record_id, canonical_url, ts, outcome, ref_id, ref_ts,
    payload_digest, headers``.

    ``outcome`` is ``resolved``, ``validator_mismatch``, ``unverified`` or
    ``no_earlier_response``; digest and headers are filled where it is ``resolved``.
    """
    known = records.select(*RECORD).withColumn("canonical_url", canonical_url(F.col("url"))).drop("url")
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    split = known.where(usable).withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    # the struct that the latest response is found by: time first, then id
    found = F.struct(*[F.col(c).alias(c) for c in ("ts", "record_id", "etag", "last_modified", "payload_digest", "headers")])
    response = F.when(F.col("kind") == "response", found)

    earlier = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = split.withColumn("inside", F.max(response).over(earlier)).where("kind = 'revisit'")

    ends = split.groupBy("canonical_url", "bucket").agg(F.max(response).alias("end"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical_url", "bucket", F.last("end", ignorenulls=True).over(before).alias("carried")).where("carried is not null")

    joined = inside.join(carried, ["canonical_url", "bucket"], "left").withColumn("ref", F.coalesce("inside", "carried"))
    lost = known.where(~usable & (F.col("kind") == "revisit"))
    return _checked(joined.drop("bucket", "inside", "carried").unionByName(lost.withColumn("ref", F.lit(None).cast(joined.schema["ref"].dataType))))


def _checked(revisits: DataFrame) -> DataFrame:
    def strong(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    by_tag, by_date = F.col("etag").isNotNull(), F.col("last_modified").isNotNull()
    same = F.when(by_tag, strong(F.col("etag")) == strong(F.col("ref.etag"))).when(by_date, F.col("last_modified") == F.col("ref.last_modified"))
    outcome = (
        F.when(F.col("ref").isNull(), "no_earlier_response")
        .when(~by_tag & ~by_date, "unverified")
        .when(F.coalesce(same, F.lit(False)), "resolved")
        .otherwise("validator_mismatch")
    )
    good = F.col("outcome") == "resolved"
    return revisits.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "ts",
        "outcome",
        F.col("ref.record_id").alias("ref_id"),
        F.col("ref.ts").alias("ref_ts"),
        F.when(good, F.col("ref.payload_digest")).alias("payload_digest"),
        F.when(good, merged_headers(F.col("ref.headers"), F.col("headers"))).alias("headers"),
    )
