"""URL filters over time, in DataFrame operations only.

A list is a log of dated entries (pattern, action, listed): on that day the pattern (a host, which stands for its subdomains too) got the
action `block`, `allow` or `remove`. A window over each pattern turns the log into validity intervals [listed, until).
Each capture's host is expanded to itself and all its parent domains (a name in DNS has 127 labels at most), which are equi-joined with the intervals that hold the
fetch day; of the entries active then, the longest pattern decides. The hot side of that join is the captures; a pattern has
as many rows as its log, so Spark can split a host with a third of all captures, or broadcast the list where it is small.

Fetch days aren't in the table: capture_days() derives one from page_id, and host_list() a list from the hosts that occur, both
plainly, so that the query has dated entries to meet; the operator takes any.

Defined results: null URL, or one without a host: host null, verdict `pass`. Null fetch day: nothing is active. Two entries for one pattern and day:
`remove` yields to the others, `block` to `allow`. Upper case in hosts is lowered; userinfo and port are no part of it. Repeated rows: one result each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import table

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"


def host(url):
    found = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(F.length(found) > 0, found)


def intervals(log: DataFrame) -> DataFrame:
    """pattern, action, listed, until (null: still) of a log of entries."""
    rank = F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)
    day = log.where("pattern is not null and listed is not null").groupBy(F.rtrim(F.lower("pattern"), F.lit(".")).alias("pattern"), "listed").agg(F.max_by("action", rank).alias("action"))
    until = F.lead("listed").over(Window.partitionBy("pattern").orderBy("listed"))
    return day.withColumn("until", until).where("action in ('block', 'allow')")


def filtered(captures: DataFrame, log: DataFrame) -> DataFrame:
    """page_id, host, fetched, verdict (block, allow or pass), pattern and listed of every row of captures(page_id, url, fetched)."""
    rows = captures.select("page_id", host(F.col("url")).alias("host"), "fetched")
    # What holds for a host on a day holds for all its captures of that day.
    days = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = days.select("host", "fetched", F.explode(parents).alias("p"))
    active = each.join(intervals(log), (F.col("p") == F.col("pattern")) & (F.col("fetched") >= F.col("listed")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = active.groupBy("host", "fetched").agg(F.max_by(F.struct("action", "pattern", "listed"), F.struct(F.length("pattern"), "pattern")).alias("hit"))
    out = rows.join(best, ["host", "fetched"], "left")
    return out.select("page_id", "host", "fetched", F.coalesce("hit.action", F.lit("pass")).alias("verdict"), F.col("hit.pattern").alias("pattern"), F.col("hit.listed").alias("listed"))


def capture_days(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched"))


def host_list(pages: DataFrame) -> DataFrame:
    """Of each host that occurs, by the length of its name: blocked on a day, removed later or allowed again; and of the top two labels, blocked from October."""
    hosts = pages.select(host(F.col("url")).alias("h")).where("h is not null").distinct()
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.length("h") * 11) % 200)
    day = hosts.select("h", first.alias("d"), (F.length("h") % 3).alias("k"))
    log = day.where("k > 0").select(F.col("h").alias("pattern"), F.lit("block").alias("action"), F.col("d").alias("listed"))
    log = log.unionByName(day.where("k = 1").select(F.col("h").alias("pattern"), F.lit("remove").alias("action"), F.date_add("d", 60).alias("listed")))
    log = log.unionByName(day.where("k = 2").select(F.col("h").alias("pattern"), F.lit("allow").alias("action"), F.date_add("d", 90).alias("listed")))
    tops = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> '' and length(pattern) % 2 = 1").distinct()
    return log.unionByName(tops.select("pattern", F.lit("block").alias("action"), F.lit("2024-10-01").cast("date").alias("listed")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filtered(capture_days(pages), host_list(pages))


SQL = r"""
with c as (
  select page_id, nullif(rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '.'), '') as host,
         (date '2024-01-01' + ((page_id * 37) % 365)::int)::date as fetched, row_number() over () as rn from pages
), h as (select distinct host as h from c where host is not null),
d as (select h, (date '2024-01-01' + ((length(h) * 11) % 200)::int)::date as d, length(h) % 3 as k from h),
log as (
  select h as pattern, 'block' as action, d as listed from d where k > 0
  union all select h, 'remove', (d + 60)::date from d where k = 1
  union all select h, 'allow', (d + 90)::date from d where k = 2
  union all select distinct regexp_extract(h, '([^.]+\.[^.]+)$', 1), 'block', date '2024-10-01' from h
    where regexp_extract(h, '([^.]+\.[^.]+)$', 1) <> '' and length(regexp_extract(h, '([^.]+\.[^.]+)$', 1)) % 2 = 1
), u as (
  select pattern, listed, arg_max(action, case action when 'allow' then 2 when 'block' then 1 else 0 end) as action from log group by pattern, listed
), i as (select *, lead(listed) over (partition by pattern order by listed) as until from u),
a as (
  select c.rn, i.action, i.pattern, i.listed, row_number() over (partition by c.rn order by length(i.pattern) desc, i.pattern desc) as best
  from c join i on (c.host = i.pattern or ends_with(c.host, '.' || i.pattern))
   and c.fetched >= i.listed and (i.until is null or c.fetched < i.until) and i.action in ('block', 'allow')
)
select c.page_id, c.host, c.fetched, coalesce(a.action, 'pass') as verdict, a.pattern, a.listed
from c left join a on a.rn = c.rn and a.best = 1
"""
