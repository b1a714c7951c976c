"""Operator 10: WARC not-modified revisits resolved against full responses.

A revisit record holds no body: it says that a resource had not changed.  Each one is
joined, as of its time, to the latest earlier full response of the same canonical URL;
the validators must agree (the entity tag where the revisit has one, else the
modification date), and of the revisit's headers only those that a 304 answer may
update replace the response's.

The as-of join is a window over the capture times of a URL (no headers), cut into ranges
of (url, time) that Spark's range partitioner makes equal by counts, so a URL with very
many captures is worked on by many tasks however its times lie: inside a range the last
response is carried forward; each range's last response, one row, is carried to the
later ranges and joined to the revisits that found none in their own.  Headers join last,
by the keys found.

Defined cases: a null URL or time finds nothing (status ``orphan``); of responses at one
time the one with the largest record id is the latest, one without an id is none; a
response at the revisit's own time is not earlier; a revisit without validators matches
nothing it can check (``unchecked``); null header maps are empty; a repeated revisit gives
a row each time, a repeated response counts once; of different responses with one id, time
and URL the one whose sorted headers have the least hash counts; other columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

# The header fields a 304 answer updates (RFC 9110, section 15.4.5).
UPDATED_BY_304 = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, ``/`` for an empty path."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    tail = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(head, "^(http://[^/?]*):80$", "$1"), "^(https://[^/?]*):443$", "$1")
    return F.concat(host, F.when((head != "") & ~tail.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail))


def _merged(full: Column, update: Column) -> Column:
    """Headers of the response, updated by the permitted ones of the revisit."""
    allowed = F.map_filter(update, lambda k, _: k.isin(UPDATED_BY_304))
    return F.map_concat(F.map_filter(full, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row a revisit: record_id, url, target_id, target_ts, status, headers.

    ``records``: record_id long, kind ('response' or 'revisit'), url, ts long,
    headers map<string,string> with lower-case names.  ``status`` is resolved, changed
    (validators disagree), unchecked (no validator) or orphan (no earlier response).
    ``ranges``: their number, the session's shuffle partitions by default."""
    empty = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts",
                          F.coalesce("headers", empty).alias("headers"))
    known = F.col("url").isNotNull() & F.col("ts").isNotNull()
    is_response, is_revisit = F.col("kind") == "response", F.col("kind") == "revisit"
    # One row a URL and time: the latest response of it, and whether a revisit asks for it.
    times = rows.where(known).groupBy("url", "ts").agg(
        F.max(F.when(is_response, F.col("record_id"))).alias("response"), F.max(is_revisit).alias("asked"))
    dealt = times.repartitionByRange("url", "ts") if ranges is None else times.repartitionByRange(ranges, "url", "ts")
    # Written, so that the number of a row's range is the same for all that read it.
    times = C.cut(records.sparkSession, dealt.withColumn("range", F.spark_partition_id()), "op10-times")
    newest = F.when(F.col("response").isNotNull(), F.struct("ts", F.col("response").alias("record_id")))
    before = Window.partitionBy("url", "range").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    inside = times.withColumn("near", F.max(newest).over(before)).where("asked").select("url", "ts", "range", "near")
    # The last response of each range, carried to the later ones.
    last = times.where("response IS NOT NULL").groupBy("url", "range").agg(F.max(newest).alias("newest"))
    need = inside.where("near IS NULL").select("url", "range").distinct()
    later = Window.partitionBy("url").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    carried = need.withColumn("newest", F.lit(None).cast("struct<ts:bigint,record_id:bigint>")).unionByName(last) \
        .groupBy("url", "range").agg(F.max("newest").alias("newest")) \
        .withColumn("carried", F.max("newest").over(later)).where("carried IS NOT NULL").select("url", "range", "carried")
    at = inside.join(carried, ["url", "range"], "left").select("url", "ts", F.coalesce("near", "carried").alias("at"))
    asked = rows.where(is_revisit).select("record_id", "url", "ts", "headers")
    found = asked.where(known).join(at, ["url", "ts"], "left").select("record_id", "url", "ts", "headers", "at")
    found = found.unionByName(asked.where(~known).withColumn("at", F.lit(None).cast("struct<ts:bigint,record_id:bigint>")))
    # Grouped by the keys of the join: no exchange of its own.
    responses = rows.where(is_response & known).groupBy(
        F.col("record_id").alias("target_id"), F.col("ts").alias("target_ts"), F.col("url").alias("target_url")) \
        .agg(F.min_by("headers", F.xxhash64(F.array_sort(F.map_entries("headers")))).alias("full"))
    both = found.join(responses, (F.col("at.record_id") == F.col("target_id")) & (F.col("at.ts") == F.col("target_ts"))
                      & (F.col("url") == F.col("target_url")), "left")
    tag, since = F.col("headers")["etag"], F.col("headers")["last-modified"]
    agrees = F.when(tag.isNotNull(), tag.eqNullSafe(F.col("full")["etag"])).otherwise(since.eqNullSafe(F.col("full")["last-modified"]))
    status = F.when(F.col("target_id").isNull(), "orphan").when(tag.isNull() & since.isNull(), "unchecked") \
        .when(agrees, "resolved").otherwise("changed")
    return both.withColumn("status", status).select(
        "record_id", "url", "target_id", "target_ts", "status",
        F.when(F.col("status") == "resolved", _merged(F.col("full"), F.col("headers"))).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages`` (page_id is the capture time).

    Every page is a full response.  Every third is asked for again 700 later by a written
    variant of its URL: most carry the page's entity tag, some an older tag, some only a
    date, some no validator at all."""
    page = F.col("page_id")
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12)
    date = lambda c: F.concat(F.lit("day-"), c.cast("string"))
    response = F.create_map(
        F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-type"), F.lit("text/html"), F.lit("date"), date(page),
        F.lit("etag"), tag, F.lit("last-modified"), date(page.cast("long") - F.pmod(page, F.lit(10))))
    again = page + 700
    sent = F.when(page % 7 == 0, F.create_map(F.lit("date"), date(again), F.lit("etag"), F.lit("stale"))) \
        .when(page % 11 == 0, F.create_map(F.lit("date"), date(again), F.lit("last-modified"), date(page.cast("long") - F.pmod(page, F.lit(10))))) \
        .when(page % 13 == 0, F.create_map(F.lit("date"), date(again))) \
        .otherwise(F.create_map(F.lit("cache-control"), F.lit("max-age=120"), F.lit("date"), date(again), F.lit("etag"), tag,
                                F.lit("server"), F.lit("cache")))
    kinds = F.array(
        F.struct((2 * page).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), page.alias("ts"), response.alias("headers")),
        F.struct((2 * page + 1).alias("record_id"), F.lit("revisit").alias("kind"),
                 F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit("#again")).alias("url"), again.alias("ts"), sent.alias("headers")))
    return pages.select(F.explode(F.when(page % 3 == 0, kinds).otherwise(F.slice(kinds, 1, 1))).alias("r")).select("r.*")


def op10_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived revisit of ``pages`` with its response; headers as sorted lines."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return resolve_revisits(records_of_pages(C.table(spark, sf_dir, "pages"))).withColumn("headers", lines)


_CANONICAL_SQL = """CASE WHEN head <> '' AND NOT starts_with(tail, '/') THEN host || '/' || tail ELSE host || tail END"""
OP10_SQL = f"""
WITH p AS (
    SELECT page_id, url, substring(md5(coalesce(html, '')), 1, 12) AS tag, 'day-' || (page_id - page_id % 10) AS modified FROM pages
), r AS (
    SELECT 2 * page_id AS record_id, 'response' AS kind, url, page_id AS ts, tag, modified, 'max-age=60' AS cache FROM p
    UNION ALL
    SELECT 2 * page_id + 1, 'revisit', regexp_replace(url, '^http', 'HTTP') || '#again', page_id + 700,
           CASE WHEN page_id % 7 = 0 THEN 'stale' WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN NULL ELSE tag END,
           CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN modified END,
           CASE WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 13 <> 0 THEN 'max-age=120' END FROM p WHERE page_id % 3 = 0
), u AS (
    SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM r
), h AS (
    SELECT *, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) AS head,
           regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS tail FROM u
), c AS (
    SELECT * REPLACE ({_CANONICAL_SQL} AS url) FROM (
        SELECT *, regexp_replace(regexp_replace(head, '^(http://[^/?]*):80$', '\\1'), '^(https://[^/?]*):443$', '\\1') AS host FROM h)
), f AS (
    SELECT v.record_id, v.url, arg_max(t.record_id, (t.ts, t.record_id)) AS target_id
    FROM c v LEFT JOIN c t ON t.kind = 'response' AND t.url = v.url AND t.ts < v.ts
    WHERE v.kind = 'revisit' GROUP BY v.record_id, v.url
), j AS (
    SELECT f.record_id, f.url, f.target_id, t.ts AS target_ts,
           CASE WHEN f.target_id IS NULL THEN 'orphan' WHEN v.tag IS NULL AND v.modified IS NULL THEN 'unchecked'
                WHEN v.tag = t.tag OR (v.tag IS NULL AND v.modified = t.modified) THEN 'resolved' ELSE 'changed' END AS status,
           'cache-control: ' || coalesce(v.cache, t.cache) || chr(10) || 'content-type: text/html' || chr(10) || 'date: day-' || v.ts || chr(10)
           || 'etag: ' || t.tag || chr(10) || 'last-modified: ' || t.modified AS lines
    FROM f JOIN c v ON v.record_id = f.record_id LEFT JOIN c t ON t.record_id = f.target_id AND t.kind = 'response'
)
SELECT record_id, url, target_id, target_ts, status, CASE WHEN status = 'resolved' THEN lines END AS headers FROM j
"""
