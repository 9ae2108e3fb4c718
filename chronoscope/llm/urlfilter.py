"""URL filters that were in force when a page was fetched.

Dated entries put a domain on a list or take it off. They become validity
intervals, and every capture is matched with the intervals that hold its host,
or a domain above it, at its fetch time. Captures are first reduced to distinct
pairs of host and day, so a host that has a third of all pages costs no more
than its days, and pages meet their verdict in one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; empty for null and for what is no URL with a host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def domains_of(host: Column) -> Column:
    """The host and every domain above it of two labels or more."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(host))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, domain, since, until`` while a domain is listed, from dated entries ``list, domain, since, listed``.

    Of entries of one list, domain and day, one that lists it wins, so a
    domain's history has a row for each day at most. Entries without a domain,
    day or list are left out.
    """
    e = entries.select("list", F.lower("domain").alias("domain"), F.col("since").cast("date").alias("since"), F.coalesce("listed", F.lit(False)).alias("listed")).dropna()
    daily = e.groupBy("list", "domain", "since").agg(F.max("listed").alias("listed"))
    w = Window.partitionBy("list", "domain").orderBy("since")
    return daily.withColumn("until", F.coalesce(F.lead("since").over(w), F.lit(FOREVER).cast("date"))).where("listed").drop("listed")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, ``lists``, ``n_active`` and ``listed_since`` added.

    A capture without host or fetch day is not blocked; rows that repeat are
    judged alike; without entries nothing is blocked, and without captures there
    are no rows; a long URL is one like any other. Other columns pass through
    whatever their names, those of a name that is added are replaced.

    Days meet intervals of their domain within a month, so the history of a
    domain that has many hosts is spread over its months.
    """
    kept = [c for c in captures.columns if c not in ("host", "blocked", "lists", "n_active", "listed_since")]
    c = captures.select(F.struct(*[F.col(f"`{x}`") for x in kept]).alias("_row"), host_of(F.col(url)).alias("host"), F.col(fetched).cast("date").alias("_day"))
    pairs = c.where("host <> '' and _day is not null").select("host", "_day").distinct()
    keys = pairs.select("host", "_day", _month(F.col("_day")).alias("_m"), F.explode(domains_of(F.col("host"))).alias("domain"))
    seen = pairs.agg(F.min(_month(F.col("_day"))).alias("lo"), F.max(_month(F.col("_day"))).alias("hi"))
    first, last = F.greatest(_month(F.col("since")), seen.select("lo").scalar()), F.least(_month(F.date_sub("until", 1)), seen.select("hi").scalar())
    monthly = intervals(entries).withColumn("_m", F.explode(F.when(first <= last, F.sequence(first, last))))
    active = keys.join(monthly, ["domain", "_m"]).where((F.col("since") <= F.col("_day")) & (F.col("_day") < F.col("until")))
    verdict = active.groupBy("host", "_day").agg(F.sort_array(F.collect_set("list")).alias("_lists"), F.count("*").alias("_n"), F.max("since").alias("_since"))
    verdict = verdict.select(F.col("host").alias("_host"), F.col("_day").alias("_on"), "_lists", "_n", "_since")
    out = c.join(verdict, (F.col("host") == F.col("_host")) & (F.col("_day") == F.col("_on")), "left")
    own = [F.col(f"_row.`{x}`") for x in kept]
    return out.select(*own, "host", F.col("_n").isNotNull().alias("blocked"), F.array_join(F.coalesce("_lists", F.array().cast("array<string>")), ",").alias("lists"), F.coalesce("_n", F.lit(0)).alias("n_active"), F.col("_since").alias("listed_since"))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


# --- the registered query: pages carry no fetch time and no list comes with them, so both are made from the rows themselves


def _number(c: Column, digits: int = 7) -> Column:
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def _day(c: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(_number(c), F.lit(366)).cast("int"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day that follows from their id."""
    return pages.select("page_id", "url", _day(F.col("page_id").cast("string")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Six dated entries on two lists for a third of the domains that the pages' hosts are in."""
    domains = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().select(F.explode(domains_of(F.col("host"))).alias("domain")).distinct()
    d = domains.where(F.pmod(_number(F.col("domain")), F.lit(3)) == 0).select("domain", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    key = F.concat("domain", F.lit("#"), F.col("k").cast("string"))
    return d.select(F.when(F.col("k") < 3, "ads").otherwise("malware").alias("list"), "domain", _day(key).alias("since"), (F.pmod(_number(F.concat(key, F.lit("?"))), F.lit(3)) > 0).alias("listed"))


SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, DATE '2024-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT % 366)::INTEGER AS fetched FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host <> ''),
s AS (SELECT host, CASE WHEN len(l) > 1 THEN list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) ELSE [host] END AS ds FROM h),
hd AS (SELECT host, unnest(ds) AS domain FROM s),
dom AS (SELECT DISTINCT domain FROM hd WHERE ('0x' || substr(md5(domain), 1, 7))::BIGINT % 3 = 0),
e0 AS (SELECT domain, k, domain || '#' || k::VARCHAR AS key FROM dom, range(6) r(k)),
e AS (SELECT CASE WHEN k < 3 THEN 'ads' ELSE 'malware' END AS list, domain, DATE '2024-01-01' + (('0x' || substr(md5(key), 1, 7))::BIGINT % 366)::INTEGER AS since, bool_or(('0x' || substr(md5(key || '?'), 1, 7))::BIGINT % 3 > 0) AS listed FROM e0 GROUP BY 1, 2, 3),
v AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY list, domain ORDER BY since), DATE '9999-12-31') AS until FROM e),
a AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n, max(since) AS since FROM p JOIN hd USING (host) JOIN v USING (domain) WHERE listed AND since <= fetched AND fetched < until GROUP BY page_id)
SELECT page_id, strftime(fetched, '%Y-%m-%d') AS fetched, host, a.n IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(n, 0)::BIGINT AS n_active, strftime(a.since, '%Y-%m-%d') AS listed_since FROM p LEFT JOIN a USING (page_id)
"""


def digest(pages: DataFrame) -> DataFrame:
    out = judge(captures_of(pages), entries_of(pages)).drop("url")
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed_since")})
