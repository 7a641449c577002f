"""Temporal URL lists: dated entries become validity intervals; captures meet those in force when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty where there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r"(:[0-9]*|\.)+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``list, pattern, valid_from, valid_to`` of dated entries ``list, pattern, action, day``.

    An entry holds from its day until the list's next entry for the pattern, the last one for ever (null). ``add``
    entries open intervals, any other action ends them. Of several entries on one day ``add`` wins. Entries with a
    null list, pattern or day are left out; patterns compare in lower case.
    """
    known = entries.select("list", F.lower("pattern").alias("pattern"), F.col("day").cast("date").alias("day"), F.coalesce(F.col("action") == "add", F.lit(False)).alias("added")).dropna()
    daily = known.groupBy("list", "pattern", "day").agg(F.max("added").alias("added"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    turned = daily.withColumn("was", F.lag("added", 1, False).over(order)).where(F.col("added") != F.col("was"))
    return turned.withColumn("valid_to", F.lead("day").over(order)).where("added").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, *keys: str) -> DataFrame:
    """Each capture (``url``, ``fetched``) with the lists that held its host, or a parent domain, on that day.

    Returns the key columns, ``host``, ``day``, ``lists`` (names, sorted, comma-joined; empty if none), ``n_entries``
    in force, ``since`` (start of the oldest) and ``blocked``. A URL without host or a null date meets no entry.
    One row for each capture, repeated rows and null keys too; other columns are left out.

    Captures are reduced to distinct pairs of host and day before they meet the list, so a frequent host costs a row
    a day; a host has as many parent domains as labels. Both joins are on keys with sizes known only at run time,
    so Spark chooses: small sides are broadcast below its threshold, large partitions are split.
    """
    seen = captures.select(*keys, F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.col("fetched").cast("date").alias("day"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = seen.select("host", "day").where("host <> '' AND day IS NOT NULL").distinct().withColumn("pattern", F.explode(parents))
    valid = intervals(entries)
    hit = asked.join(valid, (asked["pattern"] == valid["pattern"]) & (asked["day"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (asked["day"] < valid["valid_to"])))
    found = hit.groupBy("host", "day").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("n_entries"), F.min("valid_from").alias("since"))
    out = seen.join(found, ["host", "day"], "left")
    return out.select(*keys, "host", "day", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "since", F.col("lists").isNotNull().alias("blocked"))


def _digit(text: Column, at: int) -> Column:
    """Two hexadecimal digits of a digest as a number: a choice that any engine can repeat."""
    return F.conv(F.substring(F.md5(text), at, 2), 16, 10).cast("int")


def sample_lists(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts of the pages: about one host in eight enters ``spam`` and about one in sixteen
    ``adult``; half leave again, and a quarter of those return. Every ``spam-farm`` domain is on ``spam`` from the start."""
    host = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    d = lambda n: _digit(F.col("pattern"), n)
    base = F.lit("2024-01-01").cast("date")
    on = lambda name, action, day, when: host.where(when).select(F.lit(name).alias("list"), "pattern", F.lit(action).alias("action"), day.alias("day"))
    spam, adult = d(1) < 32, d(3) < 16
    farm = host.where("pattern LIKE '%spam-farm.%'").select(F.lit("spam").alias("list"), F.regexp_extract("pattern", r"(spam-farm\..*)$", 1).alias("pattern"), F.lit("add").alias("action"), base.alias("day")).distinct()
    return (
        on("spam", "add", F.date_add(base, d(5)), spam)
        .union(on("spam", "remove", F.date_add(base, d(5) + d(7)), spam & (d(9) < 128)))
        .union(on("spam", "add", F.date_add(base, d(5) + d(7) + d(11)), spam & (d(9) < 32)))
        .union(on("adult", "add", F.date_add(base, d(13)), adult))
        .union(farm)
    )


def fetched(page_id: Column) -> Column:
    """A fetch day within a year for each page: the table has none."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.pmod(page_id, F.lit(366)) * 7919, F.lit(366)).cast("int"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` evaluated against the lists in force on its fetch day."""
    pages = common.table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", fetched(F.col("page_id")).alias("fetched"))
    return evaluate(captures, sample_lists(pages), "page_id").withColumns({"day": F.col("day").cast("string"), "since": F.col("since").cast("string")})


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), '(:[0-9]*|\.)+$', '')) AS host,
    DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS day FROM pages
), h AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) AS d1, CAST('0x' || substr(md5(host), 3, 2) AS INTEGER) AS d3,
    CAST('0x' || substr(md5(host), 5, 2) AS INTEGER) AS d5, CAST('0x' || substr(md5(host), 7, 2) AS INTEGER) AS d7,
    CAST('0x' || substr(md5(host), 9, 2) AS INTEGER) AS d9, CAST('0x' || substr(md5(host), 11, 2) AS INTEGER) AS d11,
    CAST('0x' || substr(md5(host), 13, 2) AS INTEGER) AS d13
  FROM (SELECT DISTINCT host FROM p WHERE host <> '')
), e AS (
  SELECT 'spam' AS list, host AS pattern, DATE '2024-01-01' + d5 AS day, true AS added FROM h WHERE d1 < 32
  UNION ALL SELECT 'spam', host, DATE '2024-01-01' + d5 + d7, false FROM h WHERE d1 < 32 AND d9 < 128
  UNION ALL SELECT 'spam', host, DATE '2024-01-01' + d5 + d7 + d11, true FROM h WHERE d1 < 32 AND d9 < 32
  UNION ALL SELECT 'adult', host, DATE '2024-01-01' + d13, true FROM h WHERE d3 < 16
  UNION ALL SELECT DISTINCT 'spam', regexp_extract(host, '(spam-farm\..*)$', 1), DATE '2024-01-01', true FROM h WHERE host LIKE '%spam-farm.%'
), daily AS (SELECT list, pattern, day, bool_or(added) AS added FROM e GROUP BY ALL),
a AS (SELECT p.page_id, p.host, p.day, e.list, e.pattern, max(e.day) AS last_day
  FROM p JOIN daily e ON (p.host = e.pattern OR ends_with(p.host, '.' || e.pattern)) AND e.day <= p.day GROUP BY ALL),
active AS (SELECT a.*, (SELECT coalesce(max(r.day), DATE '1900-01-01') FROM daily r WHERE r.list = a.list AND r.pattern = a.pattern AND r.day <= a.day AND NOT r.added) AS off_day
  FROM a JOIN daily d ON d.list = a.list AND d.pattern = a.pattern AND d.day = a.last_day AND d.added),
held AS (SELECT x.page_id, x.list, x.pattern, min(d.day) AS since FROM active x JOIN daily d ON d.list = x.list AND d.pattern = x.pattern AND d.added AND d.day > x.off_day AND d.day <= x.day GROUP BY ALL),
f AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n_entries, min(since) AS since FROM held GROUP BY page_id)
SELECT p.page_id, p.host, CAST(p.day AS VARCHAR) AS day, coalesce(lists, '') AS lists, coalesce(n_entries, 0) AS n_entries, CAST(since AS VARCHAR) AS since, lists IS NOT NULL AS blocked
FROM p LEFT JOIN f USING (page_id)
"""
