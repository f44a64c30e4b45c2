"""URL filters: dated list entries become validity intervals, and an as-of join judges every capture by the entries active at its fetch time.

A list is a log of events (pattern, ts, action, category); the action of the latest event at or before a time holds then. Patterns are
``d:host`` (the host and all below it), ``p:host/dir/`` (all below a directory) and ``u:host/path`` (one address).

Time is cut into buckets of ``days``. Per (pattern, bucket) the events become disjoint intervals, with the last event before the bucket carried in,
so neither a pattern with a very long history nor a host with very many captures meets on one key: they meet per
bucket, and the interval condition picks at most one row per capture and pattern. Captures are judged once per distinct address and
time, so copies do not multiply.

Defined cases: events without pattern, time or action are left out; of several events of a pattern at one time, "add" wins, then the smallest
category; a capture without a time or a readable address matches nothing; repeated captures repeat their verdict; hosts are
compared in lower case, without port, user and trailing dot; the query and fragment of an address play no part; empty tables give no rows
or no matches. Other columns of the captures pass through; a clash with a result column raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 30
RESULTS = ("blocked", "n_active", "pattern", "category")


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def keys_of(host: Column, path: Column) -> Column:
    """All patterns that cover an address: its host and the domains above but the last label, its directories, and itself."""
    labels, parts = F.split(host, r"\.", -1), F.split(path, "/", -1)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
                          lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("p:"), host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.array_distinct(F.concat(domains, folders, F.array(F.concat(F.lit("u:"), host, path))))


def bucket_of(ts: Column, days: int) -> Column:
    return F.floor(F.unix_micros(ts) / (days * 86_400_000_000)).cast("long")


def intervals(events: DataFrame, until: int, days: int = DAYS) -> DataFrame:
    """pattern, bucket, valid_from, valid_to, category of every stretch in which a pattern is listed, cut at the buckets.

    Nothing is carried on after the bucket ``until``, the last with captures.
    """
    whole = events.where(F.col("pattern").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin("add", "remove"))
    single = whole.groupBy("pattern", "ts").agg(F.min(F.struct("action", F.col("category").isNull().alias("none"), "category")).alias("e")).select(
        "pattern", "ts", (F.col("e.action") == "add").alias("listed"), "e.category", bucket_of(F.col("ts"), days).alias("bucket"))
    # the state at the end of every bucket with events holds until the next such bucket, and is carried into those between
    last = single.groupBy("pattern", "bucket").agg(F.max_by(F.struct("listed", "category"), "ts").alias("state"))
    following = F.lead("bucket").over(Window.partitionBy("pattern").orderBy("bucket"))
    held = last.withColumn("next", following).where("state.listed").withColumn("end", F.least(F.coalesce("next", F.lit(until)), F.lit(until))).where("end > bucket")
    start = F.timestamp_micros(F.col("bucket") * (days * 86_400_000_000))
    carried = held.select("pattern", F.explode(F.sequence(F.col("bucket") + 1, F.col("end"))).alias("bucket"), F.col("state.category").alias("category"))
    carried = carried.select("pattern", start.alias("ts"), F.lit(True).alias("listed"), "category", "bucket", F.lit(0).alias("own"))
    every = carried.unionByName(single.withColumn("own", F.lit(1)))
    order = Window.partitionBy("pattern", "bucket").orderBy("ts", "own")
    ends = F.coalesce(F.lead("ts").over(order), F.timestamp_micros((F.col("bucket") + 1) * (days * 86_400_000_000)))
    return every.withColumn("valid_to", ends).where("listed and valid_to > ts").select("pattern", "bucket", F.col("ts").alias("valid_from"), "valid_to", "category")


def judge(captures: DataFrame, events: DataFrame, days: int = DAYS, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, n_active, and the most telling active pattern with its category: the longest address, then folder, then domain."""
    clash = [c for c in RESULTS if c in captures.columns]
    if clash:
        raise ValueError(f"captures has columns {clash} already")
    spots = captures.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_at")).where("_url is not null and _at is not null").distinct()
    spots = spots.withColumn("_host", host_of(F.col("_url"))).where("_host <> ''").withColumn("bucket", bucket_of(F.col("_at"), days))
    keyed = spots.select("_url", "_at", "bucket", F.explode(keys_of(F.col("_host"), path_of(F.col("_url")))).alias("pattern"))
    until = spots.agg(F.max("bucket")).first()[0]
    active = keyed.join(intervals(events, -1 if until is None else until, days), ["pattern", "bucket"]).where("_at >= valid_from and _at < valid_to")
    rank = F.struct(F.when(F.col("pattern").startswith("u:"), 0).when(F.col("pattern").startswith("p:"), 1).otherwise(2).alias("kind"), (-F.length("pattern")).alias("long"), "pattern")
    verdict = active.groupBy("_url", "_at").agg(F.count("*").alias("n_active"), F.min(F.struct(rank.alias("rank"), F.col("category").alias("category"))).alias("best"))
    verdict = verdict.select("_url", "_at", "n_active", F.col("best.rank.pattern").alias("pattern"), F.col("best.category").alias("category"))
    joined = captures.join(verdict, (captures[url_col] == verdict["_url"]) & (captures[time_col] == verdict["_at"]), "left")
    return joined.select(*captures.columns, F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "pattern", "category")


def number_of(text: Column) -> Column:
    """A number below 2^24 from a text, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def dated(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time: ``pages`` has none, so a minute of the year 2024 follows from the page's id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + 60 * (number_of(F.col("page_id").cast("string")) % 525_600)).alias("fetched_at"))


def listing(pages: DataFrame) -> DataFrame:
    """A dated list made from all pages: each proposes its host, folder or address on some day of 2024, and takes it back within 90 days."""
    seed = number_of(F.concat(F.lit("list"), F.col("url")))
    day = number_of(F.concat(F.lit("day"), F.col("url"))) % 366
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    folder = F.regexp_extract(path, "^(.*/)", 1)
    pattern = F.when(seed % 16 == 0, F.concat(F.lit("d:"), host)).when(seed % 16 < 8, F.concat(F.lit("p:"), host, folder)).otherwise(F.concat(F.lit("u:"), host, path))
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), seed % 3 + 1)
    proposed = pages.where(F.col("url").isNotNull()).select(pattern.alias("pattern"), category.alias("category"), day.alias("day"), (1 + seed % 90).alias("length"))
    moment = lambda days: F.timestamp_seconds(F.lit(1_704_067_200) + 86_400 * days)
    return proposed.select("pattern", F.inline(F.array(
        F.struct(moment(F.col("day")).alias("ts"), F.lit("add").alias("action"), F.col("category").alias("category")),
        F.struct(moment(F.col("day") + F.col("length")).alias("ts"), F.lit("remove").alias("action"), F.lit(None).cast("string").alias("category")))))


SQL = r"""
WITH p AS (SELECT page_id, url, to_timestamp(1704067200 + 60 * (('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 525600))::TIMESTAMP AS fetched_at,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
        CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END AS path,
        ('0x' || substr(md5('list' || url), 1, 6))::BIGINT AS seed, ('0x' || substr(md5('day' || url), 1, 6))::BIGINT % 366 AS day FROM pages),
l AS (SELECT CASE WHEN seed % 16 = 0 THEN 'd:' || host WHEN seed % 16 < 8 THEN 'p:' || host || regexp_extract(path, '^(.*/)', 1) ELSE 'u:' || host || path END AS pattern,
        ['adult', 'malware', 'spam'][seed % 3 + 1] AS category, day, 1 + seed % 90 AS length FROM p),
e AS (SELECT pattern, to_timestamp(1704067200 + 86400 * day)::TIMESTAMP AS ts, 'add' AS action, category FROM l
      UNION ALL SELECT pattern, to_timestamp(1704067200 + 86400 * (day + length))::TIMESTAMP, 'remove', NULL FROM l),
one AS (SELECT pattern, ts, min(action) AS action, min(category) AS category FROM e GROUP BY pattern, ts),
span AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY pattern ORDER BY ts), TIMESTAMP '9999-01-01') AS until FROM one),
labelled AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS parts FROM p),
keyed AS (SELECT DISTINCT page_id, url, fetched_at, unnest(list_concat(list_concat(
        list_transform(range(1, greatest(2, len(labels))), lambda i: 'd:' || array_to_string(labels[i:], '.')),
        list_transform(range(1, len(parts)), lambda i: 'p:' || host || array_to_string(parts[1:i], '/') || '/')), ['u:' || host || path])) AS pattern FROM labelled),
hit AS (SELECT page_id, url, fetched_at, pattern, category, row_number() OVER (PARTITION BY page_id, url, fetched_at
            ORDER BY CASE left(pattern, 2) WHEN 'u:' THEN 0 WHEN 'p:' THEN 1 ELSE 2 END, length(pattern) DESC, pattern) AS place, count(*) OVER (PARTITION BY page_id, url, fetched_at) AS n
        FROM keyed JOIN span USING (pattern) WHERE action = 'add' AND fetched_at >= ts AND fetched_at < until)
SELECT p.page_id, p.url, p.fetched_at, hit.n IS NOT NULL AS blocked, coalesce(hit.n, 0) AS n_active, hit.pattern, hit.category
FROM p LEFT JOIN hit ON hit.place = 1 AND hit.page_id = p.page_id AND hit.url = p.url
"""
