"""URL filtering against dated lists: entries become validity intervals, captures are judged as of their fetch time.

A list entry is (pattern, action, day): `add` puts a pattern on the list from that day, `remove` takes it off. A pattern is a domain
(example.org, which covers its subdomains) or a domain with a path prefix that ends in a slash (example.org/ads/). Of entries
with one pattern each holds from its day until the day before the next one's.

A capture has the keys that could match it: every suffix of its host of two labels or more, and its host with the directories
of its path, down to the depth of the deepest pattern on the list. Keys join intervals by equality, as of the fetch day. Intervals up to `most_broadcast` are broadcast after their
number is checked; more are joined by a shuffle in which both sides are salted, so that a domain that holds a third
of all captures is spread over `salts` tasks. Only DataFrame functions are used.

Entries of one pattern and one day: `remove` wins. A null url, day or one without a host has no keys and is not blocked; a null
pattern, action or day in a list is left out. Repeated rows are judged each for itself. A very long url has no
more keys than others. An empty list blocks nothing; an empty table gives an empty result. Columns of captures other than those named are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtext.llm.common import materialize, table

#: Intervals, of about 60 bytes each, that may be broadcast.
MOST_BROADCAST = 200_000
END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.regexp_replace(host, r"\.$", ""))


def keys_of(host: Column, url: Column, deepest: int) -> Column:
    """All patterns of at most `deepest` folders that could match."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.when((host != "") & (n > 1), F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))
    path = F.split(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/")
    depth = F.least(F.size(path) - 2, F.lit(deepest))
    folders = F.when((host != "") & (depth > 0), F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 2, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(suffixes, folders)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until): the days on which each pattern is listed, until exclusive."""
    clean = entries.select("pattern", "action", F.col("day").cast("date").alias("day")).dropna().filter("action in ('add', 'remove')")
    daily = clean.groupBy("pattern", "day").agg(F.max("action").alias("action"))  # 'remove' is the greater
    until = F.coalesce(F.lead("day").over(W.partitionBy("pattern").orderBy("day")), F.to_date(F.lit(END)))
    return daily.select("pattern", "action", F.col("day").alias("since"), until.alias("until")).filter("action = 'add'").drop("action")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", most_broadcast: int = MOST_BROADCAST, salts: int = 16) -> DataFrame:
    """captures (id, url, fetched_on) with host, blocked, and the most specific pattern active on the day and since when."""
    listed = materialize(intervals(entries), "intervals")
    known = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("pattern", "/")) - 2).alias("deepest")).first()
    small = known["n"] <= most_broadcast
    rows = captures.select(F.col(f"`{id_col}`").alias("id"), "url", F.col("fetched_on").cast("date").alias("fetched_on"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("host", host_of(F.coalesce("url", F.lit(""))))
    keyed = rows.select("rid", "id", "host", "fetched_on", F.explode_outer(keys_of(F.col("host"), F.coalesce("url", F.lit("")), max(0, known["deepest"] or 0))).alias("pattern"))
    on = (F.col("c.pattern") == F.col("l.pattern")) & (F.col("c.fetched_on") >= F.col("l.since")) & (F.col("c.fetched_on") < F.col("l.until"))
    if small:
        joined = keyed.alias("c").join(F.broadcast(listed).alias("l"), on, "left")
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
        spread = listed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = keyed.alias("c").join(spread.alias("l"), on & (F.col("c.salt") == F.col("l.salt")), "left")
    match = F.when(F.col("l.pattern").isNotNull(), F.struct(F.length("l.pattern").alias("n"), F.col("l.pattern").alias("pattern"), F.col("l.since").alias("since")))
    found = joined.groupBy("rid").agg(F.first("c.id").alias(id_col), F.first("c.host").alias("host"), F.first("c.fetched_on").alias("fetched_on"), F.max(match).alias("match"))
    return found.select(id_col, "host", "fetched_on", F.col("match").isNotNull().alias("blocked"), F.col("match.pattern").alias("matched_pattern"), F.col("match.since").alias("listed_since"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list for tables that come without one: from the hosts of pages, by lengths and first letters alone."""
    hosts = pages.select(host_of(F.coalesce("url", F.lit(""))).alias("host")).filter("host <> ''").distinct()
    keyed = hosts.select("host", (F.length("host") * 7 + F.ascii("host")).alias("h"))
    start = lambda days: F.date_add(F.to_date(F.lit("2024-01-01")), days)
    add = keyed.filter("h % 3 = 0").select(F.col("host").alias("pattern"), F.lit("add").alias("action"), start((F.col("h") * 31 % 200).cast("int")).alias("day"))
    gone = keyed.filter("h % 6 = 0").select(F.col("host").alias("pattern"), F.lit("remove").alias("action"), start((F.col("h") * 31 % 200 + 45).cast("int")).alias("day"))
    again = keyed.filter("h % 12 = 0").select(F.col("host").alias("pattern"), F.lit("add").alias("action"), start((F.col("h") * 31 % 200 + 120).cast("int")).alias("day"))
    folder = keyed.filter("h % 3 = 1").select(F.concat("host", F.lit("/de/")).alias("pattern"), F.lit("add").alias("action"), start((F.col("h") % 90).cast("int")).alias("day"))
    wide = hosts.select(F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("pattern")).filter("pattern like '%.%'").distinct()
    on = wide.select("pattern", F.lit("add").alias("action"), start(F.lit(300)).alias("day"))
    off = wide.select("pattern", F.lit("remove").alias("action"), start(F.lit(320)).alias("day"))
    return add.unionAll(gone).unionAll(again).unionAll(folder).unionAll(on).unionAll(off)


def op5_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") * 37 % 366).cast("int")))
    return filter_captures(captures, derived_entries(pages))


OP5_SQL = r"""
with p as (select page_id, coalesce(url, '') as url, date '2024-01-01' + cast(page_id * 37 % 366 as integer) as fetched_on,
  lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', '')) as host from pages),
hosts as (select distinct host, length(host) * 7 + ascii(host) as h from p where host <> ''),
wide as (select distinct regexp_extract(host, '[^.]+\.[^.]+$') as pattern from hosts where host like '%.%'),
entries as (
  select host as pattern, 'add' as action, date '2024-01-01' + cast(h * 31 % 200 as integer) as day from hosts where h % 3 = 0
  union all select host, 'remove', date '2024-01-01' + cast(h * 31 % 200 + 45 as integer) from hosts where h % 6 = 0
  union all select host, 'add', date '2024-01-01' + cast(h * 31 % 200 + 120 as integer) from hosts where h % 12 = 0
  union all select host || '/de/', 'add', date '2024-01-01' + cast(h % 90 as integer) from hosts where h % 3 = 1
  union all select pattern, 'add', date '2024-01-01' + 300 from wide
  union all select pattern, 'remove', date '2024-01-01' + 320 from wide),
daily as (select pattern, day, max(action) as action from entries group by all),
spans as (select pattern, action, day as since, coalesce(lead(day) over (partition by pattern order by day), date '9999-12-31') as until from daily),
best as (
  select page_id, arg_max({'p': s.pattern, 's': s.since}, length(s.pattern)) as m
  from p join spans s on s.action = 'add' and fetched_on >= s.since and fetched_on < s.until
   and (host = s.pattern or (s.pattern not like '%/%' and ends_with(host, '.' || s.pattern))
     or (s.pattern like '%/%' and starts_with(host || regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), s.pattern)))
  group by page_id)
select p.page_id, host, fetched_on, m is not null as blocked, m.p as matched_pattern, m.s as listed_since from p left join best using (page_id)
"""
