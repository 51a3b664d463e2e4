"""URL filters: a temporal join of captures with dated list entries.

Entries of a list add or remove a pattern at a time. Between two entries of a pattern it is listed or
not, so entries become validity intervals; a capture is judged by the interval that holds its fetch
time. That is an as-of join: captures and intervals of a pattern are ordered together, and each capture
takes the last interval that began. They are ordered within time slots, and each slot starts from the
last interval of the slots before, so a frequent host is dealt to many tasks and nothing is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import common

#: Time slots that the captures' span is cut into: an interval is copied at most so often.
SLOTS = 64

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def patterns_of(url: Column) -> Column:
    """All patterns that list a URL: its host, each domain above of two labels or more, each folder of its path, and the path itself.

    They read ``host:h``, ``domain:d`` and ``prefix:h/folder/``; a path without a closing slash also
    counts as a folder. A URL without a host has none.
    """
    host, labels, parts = host_of(url), F.split(host_of(url), r"\."), F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    domains = F.transform(F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: i < F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    folders = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i <= F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.transform(F.slice(parts, F.lit(1), i), lambda x: F.concat(x, F.lit("/"))), "")))
    return F.when(host != "", F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, folders))).otherwise(F.array().cast("array<string>"))


def _seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds that grow with the column: local times are counted by their own calendar, without any zone's jumps."""
    at = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.unix_seconds(at.cast("timestamp"))


def validity(entries: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Listed intervals (pattern, since, until) of entries (pattern, at, added, seq); until is null while listed.

    Of entries at one time the one with the highest seq decides. Entries without a pattern, a time or
    a verdict are left out.

    A pattern's entries are dealt to equal slots of the list's time and ordered within them; a slot's
    last entry is followed by the first of the pattern's next slot with any. So a frequent pattern is
    ordered by many tasks, and by one only its slots, at most ``slots`` rows.
    """
    known = entries.where("pattern is not null and at is not null and added is not null")
    second = _seconds(known, "at")
    span = known.agg(F.min(second).alias("lo"), F.max(second).alias("hi")).first()
    lo, width = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // slots + 1
    dealt = known.withColumn("slot", F.floor((second - lo) / width).cast("int"))
    inside = Window.partitionBy("pattern", "slot").orderBy("at", "seq")
    firsts = dealt.groupBy("pattern", "slot").agg(F.min("at").alias("first"))
    following = firsts.select("pattern", "slot", F.lead("first").over(Window.partitionBy("pattern").orderBy("slot")).alias("following"))
    spans = dealt.select("pattern", "slot", F.col("at").alias("since"), F.lead("at").over(inside).alias("next"), "added").join(following, ["pattern", "slot"])
    spans = spans.select("pattern", "since", F.coalesce("next", "following").alias("until"), "added")
    return spans.where("added and (until is null or until > since)").drop("added")


def judge_captures(captures: DataFrame, entries: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``captures`` (url, fetched_at and any columns) with listed, rule and rule_since.

    listed: an entry active at the fetch time lists the URL (from its date on, up to the next entry of
    its pattern). rule is the longest such pattern (then the last by name), rule_since its entry's date.

    Null URLs, URLs without a host and captures without a fetch time are not listed. Repeated captures
    are kept. Columns of ``captures`` named listed, rule or rule_since are replaced. Empty tables work:
    without entries nothing is listed.
    """
    captures = captures.drop("listed", "rule", "rule_since")
    fetched = _seconds(captures, "fetched_at")
    span = captures.agg(F.min(fetched).alias("lo"), F.max(fetched).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = max(1, -(-(hi - lo + 1) // slots))
    slot = lambda seconds: F.floor((seconds - lo) / width).cast("int")
    own = captures.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    asked = own.select("url", "fetched_at", slot(fetched).alias("slot"), F.explode(patterns_of(F.col("url"))).alias("pattern"))
    lists = validity(entries)
    since, until = _seconds(lists, "since"), _seconds(lists, "until")
    # what began before the first capture is in a slot of its own
    held = lists.where((since <= hi) & (F.col("until").isNull() | (until >= lo))).select("pattern", F.greatest(slot(since), F.lit(-1)).alias("slot"), F.col("since").alias("t"), F.struct("since", "until").alias("held"))
    points = asked.select("pattern", "slot", F.col("fetched_at").alias("t"), F.lit(1).alias("o"), F.struct("url", "fetched_at").alias("capture")).unionByName(held.withColumn("o", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most slots + 1 rows
    started = points.groupBy("pattern", "slot").agg(F.max("held").alias("last")).select("pattern", "slot", F.last("last", ignorenulls=True).over(before).alias("carried"))
    running = Window.partitionBy("pattern", "slot").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumn("held", F.last("held", ignorenulls=True).over(running)).where("o = 1").join(started, ["pattern", "slot"])
    active = F.coalesce("held", "carried")
    held = found.select("capture.*", "pattern", active["since"].alias("since"), active["until"].alias("until")).where("since is not null and (until is null or fetched_at < until)")
    best = held.groupBy("url", "fetched_at").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("best"))
    best = best.select("url", "fetched_at", F.col("best.pattern").alias("rule"), F.col("best.since").alias("rule_since"))
    joined = captures.join(best, ["url", "fetched_at"], "left")
    return joined.select(*captures.columns, F.col("rule").isNotNull().alias("listed"), "rule", "rule_since")


def page_captures(spark, sf_dir: str) -> DataFrame:
    """Pages with a fetch time, which the table lacks: minutes from January 2024 on by page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    minutes = (F.col("page_id") * 7919 % 43200).cast("int")
    return pages.withColumn("fetched_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def event_entries(spark, sf_dir: str, captures: DataFrame) -> DataFrame:
    """List entries from all events. Events are dealt to pages in turn: each lists its page's host, parent domain or first folder; every fifth removes it."""
    pages = (captures.agg(F.max("page_id")).first()[0] or 0) + 1
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("at"))
    url = F.col("url")
    labels = F.split(host_of(url), r"\.")
    parent = F.array_join(F.when(F.size(labels) > 2, F.slice(labels, F.lit(2), F.size(labels))).otherwise(labels), ".")
    folder = F.concat(host_of(url), F.lit("/"), F.regexp_extract(path_of(url), "^/([^/]*)", 1), F.lit("/"))
    pattern = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("host:"), host_of(url))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("domain:"), parent)).otherwise(F.concat(F.lit("prefix:"), folder))
    joined = events.join(captures.select("page_id", "url"), F.col("event_id") % pages == F.col("page_id"))
    return joined.select(pattern.alias("pattern"), "at", (F.col("event_id") % 5 != 0).alias("added"), F.col("event_id").alias("seq"))


def op6(spark, sf_dir: str) -> DataFrame:
    """All pages, judged by a list that events change."""
    common.prepare(spark)
    captures = page_captures(spark, sf_dir)
    return judge_captures(captures, event_entries(spark, sf_dir, captures))


OP6_SQL = r"""
WITH cap AS (
  SELECT page_id, url,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id * 7919 % 43200 AS BIGINT)) AS fetched_at
  FROM pages),
ent AS (
  SELECT event_id, ts AS dated, event_id % 5 <> 0 AS added,
    CASE event_id % 3
      WHEN 0 THEN 'host:' || host
      WHEN 1 THEN 'domain:' || CASE WHEN len(string_split(host, '.')) > 2 THEN substr(host, strpos(host, '.') + 1) ELSE host END
      ELSE 'prefix:' || host || '/' || regexp_extract(path, '^/([^/]*)', 1) || '/' END AS pattern
  FROM events JOIN cap ON event_id % (SELECT max(page_id) + 1 FROM pages) = page_id),
spans AS (
  SELECT pattern, dated AS since, lead(dated) OVER (PARTITION BY pattern ORDER BY dated, event_id) AS until, added FROM ent),
lists AS (SELECT * FROM spans WHERE added AND (until IS NULL OR until > since)),
parts AS (
  SELECT page_id, host, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS folders FROM cap),
asked AS (
  SELECT page_id, 'host:' || host AS pattern FROM parts WHERE host <> ''
  UNION SELECT page_id, 'domain:' || array_to_string(labels[i:], '.') FROM (SELECT page_id, host, labels, unnest(range(1, len(labels))) AS i FROM parts) WHERE host <> ''
  UNION SELECT page_id, 'prefix:' || host || '/' || array_to_string(list_transform(folders[1:i], lambda x: x || '/'), '')
    FROM (SELECT page_id, host, folders, unnest(range(0, len(folders) + 1)) AS i FROM parts) WHERE host <> ''),
held AS (
  SELECT a.page_id, l.pattern, l.since FROM asked a JOIN lists l USING (pattern) JOIN cap c ON c.page_id = a.page_id
  WHERE l.since <= c.fetched_at AND (l.until IS NULL OR c.fetched_at < l.until)),
best AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC, since DESC) = 1)
SELECT c.page_id, c.url, c.fetched_at, b.pattern IS NOT NULL AS listed, b.pattern AS rule, b.since AS rule_since
FROM cap c LEFT JOIN best b USING (page_id)
"""
