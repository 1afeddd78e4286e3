"""Resolution of not-modified revisit records in web captures.

A revisit is matched with the latest earlier full response of the same canonical URL, its
validators are checked against that response, and the headers that a 304 answer may renew
replace the old ones. The as-of join sorts all records by (URL, time) over range
partitions, fills forward inside each partition, and carries each partition's last
response over the boundary; a URL with a third of all captures spreads over many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize

#: Headers that a 304 answer may renew (fixed values, RFC 9110 section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, www prefix, default port, fragment, campaign parameters and closing slashes go; host lower-cased, parameters sorted.

    Null stays null.
    """
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(r"(?i)^(utm_[a-z]+|fbclid|gclid|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of the table ``pages``: each page fetched, and asked for again one pass later.

    The first visit is a full response at time page_id; the second a revisit without
    payload, under the URL with a campaign parameter and a fragment, at time page_id + 1e9,
    with a renewed date and expiry. Its ETag is weak, and one in seven names another
    version. Columns: record_id, kind, url, ts, headers (names in lower case), digest, n_bytes.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sum", F.md5("html"))
    text = lambda x: F.lit(x).cast("string")
    full = p.select(
        (F.col("page_id") * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        F.col("page_id").cast("long").alias("ts"),
        F.create_map(
            text("content-type"), text("text/html"), text("etag"), F.concat(F.lit('"'), "sum", F.lit('"')),
            text("date"), F.col("page_id").cast("string"), text("content-length"), F.octet_length("html").cast("string"),
        ).alias("headers"),
        F.sha2("html", 256).alias("digest"),
        F.octet_length("html").cast("long").alias("n_bytes"),
    )
    changed = F.col("page_id") % 7 == 0
    again = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat("url", F.when(F.col("url").contains("?"), F.lit("")).when(F.col("url").contains("#"), F.lit("")).otherwise(F.lit("?utm_source=again#top"))).alias("url"),
        (F.col("page_id") + 1_000_000_000).cast("long").alias("ts"),
        F.create_map(
            text("etag"), F.concat(F.lit('W/"'), F.when(changed, F.lit("other")).otherwise(F.col("sum")), F.lit('"')),
            text("date"), (F.col("page_id") + 1_000_000_000).cast("string"), text("expires"), text("never"),
            text("content-length"), text("0"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("long").alias("n_bytes"),
    )
    return full.unionByName(again)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of ``records`` (record_id, kind, url, ts, headers, digest, n_bytes; more columns are dropped).

    Returns record_id, canonical_url, ts, original_id, status, headers, digest, n_bytes.
    status is "resolved" (a validator agrees: ETag by weak comparison, else last-modified,
    else payload digest), "unchecked" (the two share no validator), "changed" (they differ)
    or "missing" (no earlier response). Headers, digest and size are those of the merged
    record for the first two, else the revisit's own. Earlier means a smaller (ts,
    record_id). A null or empty URL or a null time has no original; a null kind is no
    record of either sort. Rows that repeat a record are resolved each.
    """
    info = F.struct("record_id", "headers", "digest", "n_bytes")
    d = records.select("record_id", "kind", "url", "ts", "headers", "digest", "n_bytes").where("kind in ('response', 'revisit')")
    d = d.withColumn("canonical_url", F.nullif(canonical_url(F.col("url")), F.lit("")))
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    d = d.withColumn("full", F.when((F.col("kind") == "response") & usable, info)).drop("url")
    d = d.repartitionByRange("canonical_url", "ts", "record_id").withColumn("part", F.spark_partition_id())
    d = materialize(d, "captures")
    before = Window.partitionBy("part", "canonical_url").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("near", F.last("full", ignorenulls=True).over(before))
    # Only a URL cut by a partition boundary needs a carry: at most two URLs a partition.
    last = F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("last")
    ends = d.where("canonical_url is not null").groupBy("canonical_url", "part").agg(last)
    cut = ends.groupBy("canonical_url").count().where("count > 1").select("canonical_url")
    over = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(cut, "canonical_url").select("part", "canonical_url", F.last("last", ignorenulls=True).over(over).alias("far")).where("far is not null")
    d = d.where("kind = 'revisit'").join(carried, ["part", "canonical_url"], "left")
    d = d.withColumn("original", F.when(usable, F.coalesce("near", "far")))
    return _merge(d)


def _merge(d: DataFrame) -> DataFrame:
    old = lambda name: F.try_element_at(F.col("original.headers"), F.lit(name))
    new = lambda name: F.try_element_at(F.col("headers"), F.lit(name))
    opaque = lambda tag: F.regexp_replace(tag, "^W/", "")
    agrees = F.coalesce(
        opaque(new("etag")) == opaque(old("etag")),
        new("last-modified") == old("last-modified"),
        F.col("digest") == F.col("original.digest"),
    )
    status = (
        F.when(F.col("original").isNull(), "missing").when(agrees, "resolved").when(~agrees, "changed").otherwise("unchecked")
    )
    d = d.withColumn("status", status).withColumn("taken", F.col("status").isin("resolved", "unchecked"))
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    renewed = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("original.headers", F.create_map().cast("map<string,string>")), lambda k, _: F.try_element_at(renewed, k).isNull())
    return d.select(
        "record_id",
        "canonical_url",
        "ts",
        F.col("original.record_id").alias("original_id"),
        "status",
        F.when(F.col("taken"), F.map_concat(kept, renewed)).otherwise(own).alias("headers"),
        F.when(F.col("taken"), F.col("original.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("taken"), F.col("original.n_bytes")).otherwise(F.col("n_bytes")).alias("n_bytes"),
    )


#: DuckDB's account of resolve_revisits(captures(pages)), with headers as sorted "name: value" lines.
ORACLE = r"""
with p as (select page_id, url, coalesce(html, '') as html, md5(coalesce(html, '')) as sum from pages),
r as (
  select page_id * 2 as record_id, false as again, url, page_id as ts, sum as tag, sum,
         sha256(html) as digest, strlen(html) as n_bytes, page_id from p
  union all
  select page_id * 2 + 1, true, case when contains(url, '?') or contains(url, '#') then url else url || '?utm_source=again#top' end,
         page_id + 1000000000, case when page_id % 7 = 0 then 'other' else sum end, sum, null, null, page_id from p),
u as (
  select *, regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') as bare from r),
v as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
         lambda x: x <> '' and not regexp_matches(x, '^((?i)utm_[a-z]+|fbclid|gclid|ref)(=|$)'))), '&'), ''), '') as canonical_url from u),
w as (
  select *, last_value(case when not again then struct_pack(id := record_id, tag := tag, digest := digest, n := n_bytes, at := page_id) end ignore nulls)
    over (partition by canonical_url order by ts, record_id rows between unbounded preceding and 1 preceding) as o from v)
select record_id, canonical_url, o.id as original_id,
  case when o is null then 'missing' when o.tag = tag then 'resolved' else 'changed' end as status,
  case when o.tag = tag
    then 'content-length: ' || o.n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/"' || tag || '"' || chr(10) || 'expires: never'
    else 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/"' || tag || '"' || chr(10) || 'expires: never' end as headers,
  case when o.tag = tag then o.digest end as digest, cast(case when o.tag = tag then o.n end as bigint) as n_bytes
from w where again
"""
