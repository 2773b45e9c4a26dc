"""URL filters by a temporal list join.

A list is a sequence of dated entries: on a day a pattern is added to a list or removed from it. Entries become
validity intervals (from an addition to the next change of the same pattern), and every capture is joined to the
intervals that hold its host, a parent domain or a leading part of its path, and that were active when it was
fetched: an as-of join, as an equality on the key and a range on the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut

#: Intervals up to which the list is broadcast (some 100 bytes each); beyond, it is joined by shuffle, split where skewed.
BROADCAST_INTERVALS = 100_000

#: Entries of the generated list, and the parts that its rule puts together: names of invented sites as the synthetic
#: pages have them, and many that they do not have.
LISTED = 12_000
HEADS = ("th", "thth", "ther", "tion", "thon", "anth", "erin", "nder", "casino-", "cheap-", "free-", "spam-", "ads-", "adult-")
TAILS = ("th", "he", "in", "er", "an", "re", "on", "nd", "at", "en", "es", "or", "ed", "st", "nt", "ha", "ing", "tion", "ble", "ly", "ou", "sh", "wh", "ea", "ti", "win", "pills", "bets", "farm", "track", "x")
ENDS = ("com", "net", "org")
SUBS = ("", "www.", "m.", "blog.")
TONGUES = ("en", "de", "fr", "es")


def entries(spark: SparkSession, rows: tuple) -> DataFrame:
    """A list of dated entries from rows (list, kind, pattern, day, action)."""
    return spark.createDataFrame([tuple(r) for r in rows], "list string, kind string, pattern string, day string, action string").withColumn("at", F.to_timestamp("day")).drop("day")


def generated(spark: SparkSession, n: int = LISTED) -> DataFrame:
    """A list of n dated entries by rule: everything about entry i follows from the MD5 of its number."""
    told = spark.range(n).select(F.md5(F.concat(F.lit("list:"), F.col("id").cast("string"))).alias("h"))

    def number(k: int) -> Column:
        return F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int")

    def one_of(values: tuple, k: int) -> Column:
        return F.get(F.array(*[F.lit(x) for x in values]), number(k) % len(values))

    domain = F.concat(one_of(HEADS, 0), one_of(TAILS, 1), F.lit(".example."), one_of(ENDS, 2))
    host = F.concat(one_of(SUBS, 6), domain)
    kind = F.when(number(3) % 10 < 6, "domain").when(number(3) % 10 < 8, "host").otherwise("prefix")
    pattern = F.when(kind == "domain", domain).when(kind == "host", host).otherwise(F.concat(host, F.lit("/"), one_of(TONGUES, 7)))
    at = F.timestamp_add("DAY", number(4) % 366, F.lit("2024-01-01").cast("timestamp"))
    return told.select(F.when(number(5) % 8 == 0, "allow").otherwise("block").alias("list"), kind.alias("kind"), pattern.alias("pattern"), F.when(number(5) % 3 == 0, "remove").otherwise("add").alias("action"), at.alias("at"))


def intervals(dated: DataFrame) -> DataFrame:
    """list, key, since, until (null: still active) from list, kind, pattern, at, action.

    Of changes to one pattern at one moment, a removal holds. Patterns are lower-cased. Rows with a null in any
    column say nothing.
    """
    clean = dated.dropna(subset=["list", "kind", "pattern", "at", "action"]).select("list", F.concat_ws(":", "kind", F.lower("pattern")).alias("key"), "at", "action")
    single = clean.groupBy("list", "key", "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    after = Window.partitionBy("list", "key").orderBy("at")
    told = single.withColumn("until", F.lead("at").over(after))
    return told.filter(~F.col("removed")).select("list", "key", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or final dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column, labels: Column, steps: Column) -> Column:
    """Everything that an entry may name: the host, its domains of so many labels at most, and the host with each
    leading part of the path of so many steps at most."""
    host = host_of(url)
    names = F.split(host, r"\.")
    path = F.slice(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), F.lit(1), steps)
    most = F.least(F.size(names), labels)
    suffixes = F.transform(F.slice(names, F.lit(1), most), lambda x, i: F.concat(F.lit("domain:"), F.array_join(F.slice(names, -(i + 1), i + 1), ".")))
    heads = F.transform(path, lambda x, i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), i + 1), "/")))
    return F.concat(F.array(F.concat(F.lit("host:"), host)), suffixes, heads)


def _depths(held: DataFrame) -> tuple[int, int]:
    """Labels of the longest domain and steps of the longest prefix on the list: longer keys can meet no entry."""
    body = F.col("key")
    labels = F.max(F.when(body.startswith("domain:"), F.size(F.split(body, r"\."))))
    steps = F.max(F.when(body.startswith("prefix:"), F.size(F.split(body, "/")) - 1))
    told = held.agg(F.coalesce(labels, F.lit(0)), F.coalesce(steps, F.lit(0))).first()
    return told[0], told[1]


def judge(captures: DataFrame, dated: DataFrame, url: str = "url", fetched: str = "fetched_at", id_column: str = "page_id") -> DataFrame:
    """One row for each capture: id, url, fetched_at, host, n_active, n_allow, blocked.

    n_active counts the active intervals of block lists that hold the capture, n_allow those of allow lists; it is
    blocked if there is one of the former and none of the latter. A null or malformed url has an empty host and
    meets no entry; a null time meets none. Of a very long url only those leading parts are looked up that are no deeper
    than the deepest entry of the list: others can meet none. Changes at one moment: a removal holds. Repeated
    captures are each told; an empty table gives an empty one, and an empty list blocks nothing. Other columns are
    left out.
    """
    held = cut(intervals(dated))
    labels, steps = _depths(held)
    few = held.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    # Equal captures are judged once, which also takes the weight off a capture that is repeated very often.
    once = captures.groupBy(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").cast("timestamp").alias("fetched_at")).agg(F.count("*").alias("rows"))
    keyed = once.select("*", host_of(F.col("url")).alias("host"), F.explode(keys_of(F.col("url"), F.lit(labels), F.lit(steps))).alias("key"))
    held = F.broadcast(held) if few else held
    met = keyed.join(held, (keyed["key"] == held["key"]) & (keyed["fetched_at"] >= held["since"]) & (held["until"].isNull() | (keyed["fetched_at"] < held["until"])), "left")
    judged = met.groupBy(id_column, "url", "fetched_at", "rows", "host").agg(F.count_if(F.col("list") == "block").alias("n_active"), F.count_if(F.col("list") == "allow").alias("n_allow"))
    told = judged.select("*", ((F.col("n_active") > 0) & (F.col("n_allow") == 0)).alias("blocked"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_")).drop("_", "rows")
    return told


def filtered(captures: DataFrame, dated: DataFrame, url: str = "url", fetched: str = "fetched_at", id_column: str = "page_id") -> DataFrame:
    """The captures that are not blocked, with all their columns (ids tell captures apart; null ids stay)."""
    bad = judge(captures, dated, url, fetched, id_column).filter("blocked").select(F.col(id_column).alias("_groundwork_id"), F.col("url").alias("_groundwork_url"), F.col("fetched_at").alias("_groundwork_at")).distinct()
    return captures.join(bad, F.col(f"`{id_column}`").eqNullSafe(F.col("_groundwork_id")) & F.col(f"`{url}`").eqNullSafe(F.col("_groundwork_url")) & F.col(f"`{fetched}`").cast("timestamp").eqNullSafe(F.col("_groundwork_at")), "left_anti")


def fetch_time(page_id: Column) -> Column:
    """The synthetic pages carry no time: their ids stand for the days of 2024, over and over."""
    return F.timestamp_add("DAY", F.pmod(page_id, F.lit(366)).cast("int"), F.lit("2024-01-01").cast("timestamp"))


def _one_of(values: tuple, k: int) -> str:
    return f"([{', '.join(repr(x) for x in values)}])[{_number(k)} % {len(values)} + 1]"


def _number(k: int) -> str:
    return f"('0x' || substr(h, {4 * k + 1}, 4))::INTEGER"


#: The same judgement in SQL over the view pages.
JUDGE_SQL = f"""
WITH rule AS (SELECT {_one_of(HEADS, 0)} || {_one_of(TAILS, 1)} || '.example.' || {_one_of(ENDS, 2)} AS domain, {_one_of(SUBS, 6)} AS sub, {_one_of(TONGUES, 7)} AS tongue,
      {_number(3)} % 10 AS k, {_number(4)} % 366 AS day, {_number(5)} AS x FROM (SELECT md5('list:' || i) AS h FROM range({LISTED}) t(i))),
dated AS (SELECT CASE WHEN x % 8 = 0 THEN 'allow' ELSE 'block' END AS list, CASE WHEN k < 6 THEN 'domain' WHEN k < 8 THEN 'host' ELSE 'prefix' END AS kind,
      CASE WHEN k < 6 THEN domain WHEN k < 8 THEN sub || domain ELSE sub || domain || '/' || tongue END AS pattern,
      TIMESTAMP '2024-01-01' + to_days(day::INTEGER) AS day, CASE WHEN x % 3 = 0 THEN 'remove' ELSE 'add' END AS action FROM rule),
single AS (SELECT list, kind, lower(pattern) AS pattern, day::TIMESTAMP AS since, max(action = 'remove') AS removed FROM dated GROUP BY ALL),
told AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since) AS until FROM single),
held AS (SELECT * FROM told WHERE NOT removed),
p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id % 366)::INTEGER) AS fetched_at,
      regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host,
      rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages),
m AS (SELECT p.page_id, p.url, p.fetched_at, p.host, h.list FROM p LEFT JOIN held h
      ON p.fetched_at >= h.since AND (h.until IS NULL OR p.fetched_at < h.until) AND CASE h.kind
      WHEN 'host' THEN p.host = h.pattern
      WHEN 'domain' THEN p.host = h.pattern OR ends_with(p.host, '.' || h.pattern)
      ELSE starts_with(p.host || p.path || '/', h.pattern || '/') END)
SELECT page_id, url, fetched_at, host, count(*) FILTER (list = 'block') AS n_active, count(*) FILTER (list = 'allow') AS n_allow,
       count(*) FILTER (list = 'block') > 0 AND count(*) FILTER (list = 'allow') = 0 AS blocked
FROM m GROUP BY page_id, url, fetched_at, host
"""
