"""URL filters by a temporal join with dated list entries.

Entries of block and allow lists are dated: a pattern is added, removed, added
again. They become validity intervals, and every capture is judged by the entries
that were active when it was fetched. A pattern is a host (``example.com`` covers
its subdomains too) or a host with leading path segments (``example.com/news``).
The longest pattern that is active decides; of an allow and a block entry for the
same pattern, the allow entry does.

The join is on (pattern, month), an interval standing in every month that it touches
and captures have, so that a hot host is spread over the months it was fetched in, a pattern with a
long history is not met by captures of other times, and a skewed partition can be
split; each capture's own patterns are a handful of its own url, with as many path
segments as the deepest entry has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boxwise.llm.common import written


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case, without a leading ``www.`` and trailing dot, and the
    path without query and fragment; both empty for a url without a host."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return host, path


def patterns_of(url: Column, segments: int) -> Column:
    """All patterns that cover a url: its host, the parent domains down to the
    last label, and the host with up to ``segments`` of its first path segments."""
    host, path = host_and_path(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n),
                          lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    depth = F.least(F.size(parts), F.lit(segments))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(
        host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def normal_pattern(pattern: Column) -> Column:
    """An entry's pattern as urls are looked up by: blanks around it are cut, the
    host is in lower case without a leading ``www.`` and trailing dots, path segments
    keep their case, slashes are single and none is last. Null without a host."""
    parts = F.split(F.trim(pattern), "/")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.get(parts, 0)), r"\.+$", ""), r"^www\.", "")
    path = F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x != "")
    return F.when(host != "", F.array_join(F.concat(F.array(host), path), "/"))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) from dated entries (list, pattern, action,
    day): active from an ``add`` to the day before the next ``remove``; ``until``
    is null while it lasts. Repeated adds or removes change nothing; where a day
    has both, the ``add`` is taken to come last. Patterns are normalised as urls
    are (``normal_pattern``). Entries without a day, list or host are left out.

    The state after each day is compared with the state before it. The history of
    a pattern is cut into months, each a bounded window; the last state of a month
    reaches the next one through one row per month.
    """
    named = entries.select("list", normal_pattern(F.col("pattern")).alias("pattern"), F.col("day").cast("date").alias("day"), "action")
    daily = named.where("list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").groupBy(
        "list", "pattern", "day").agg(F.max(F.col("action") == "add").alias("on"))
    daily = daily.withColumn("m", month(F.col("day")))
    key = ["list", "pattern"]

    def changes(rows: DataFrame) -> DataFrame:
        """(list, pattern, m, day, on) of the days that change the state."""
        ends = rows.groupBy(*key, "m").agg(F.max_by("on", "day").alias("end"))
        ends = ends.withColumn("start", F.lag("end", 1, False).over(W.partitionBy(*key).orderBy("m"))).select(*key, "m", "start")
        inside = W.partitionBy(*key, "m").orderBy("day")
        return rows.join(ends, [*key, "m"]).withColumn(
            "before", F.coalesce(F.lag("on").over(inside), F.col("start"))).where("on <> before").select(*key, "m", "day", "on")

    def ended(rows: DataFrame) -> DataFrame:
        """Each change with the day of the next one."""
        starts = rows.groupBy(*key, "m").agg(F.min("day").alias("first"))
        starts = starts.withColumn("after", F.lead("first").over(W.partitionBy(*key).orderBy("m"))).select(*key, "m", "after")
        inside = W.partitionBy(*key, "m").orderBy("day")
        return rows.join(starts, [*key, "m"]).withColumn("until", F.coalesce(F.lead("day").over(inside), F.col("after")))

    return ended(changes(daily)).where("on").select(*key, F.col("day").alias("since"), "until")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   day_col: str = "fetched") -> DataFrame:
    """One row per capture: ``id, url, fetched, verdict, list, pattern, since``.

    ``verdict`` is 'block', 'allow' (by an active allow entry) or 'none'. A null
    url or day matches nothing; repeated captures and ids are judged row by row;
    an empty table gives no rows, an empty list 'none' throughout; other columns
    are not read.
    """
    rows = written(captures.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        F.col(day_col).cast("date").alias("fetched")), "url-captures")
    span = rows.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi")).first()  # one row
    out = ["id", "url", "fetched"]
    if span.hi is None:
        return rows.select(*out, F.lit("none").alias("verdict"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("list", "string"), ("pattern", "string"), ("since", "date"))])
    lo, hi = F.lit(span.lo), F.lit(span.hi)
    intervals = validity_intervals(entries).where((F.col("since") <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
    # at most one number for each month of the calendar
    months = sorted(r.m for r in rows.where("fetched IS NOT NULL").select(month(F.col("fetched")).alias("m")).distinct().collect())
    intervals = intervals.withColumn("m", F.explode(F.filter(F.lit(months), lambda m: m.between(
        month(F.greatest("since", lo)), month(F.least(F.coalesce(F.date_sub("until", 1), hi), hi))))))
    intervals = written(intervals, "url-intervals")
    # the deepest entry says how many path segments a url is looked up by
    deepest = intervals.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0  # one row
    keyed = rows.where("fetched IS NOT NULL").select(
        "uid", "fetched", month(F.col("fetched")).alias("m"), F.explode(patterns_of(F.col("url"), deepest)).alias("pattern"))
    hits = keyed.join(intervals, ["pattern", "m"]).where("fetched >= since AND (until IS NULL OR fetched < until)")
    best = hits.groupBy("uid").agg(F.max(F.struct(
        F.length("pattern").alias("length"), (F.col("list") == "allow").alias("allows"), "list", "pattern", "since")).alias("hit"))
    return rows.join(best, "uid", "left").select(
        *out, F.when(F.col("hit").isNull(), "none").when(F.col("hit.allows"), "allow").otherwise("block").alias("verdict"),
        "hit.list", "hit.pattern", "hit.since")


def block_listed(captures: DataFrame, entries: DataFrame, **options) -> DataFrame:
    """The captures that an active entry blocks."""
    return judge_captures(captures, entries, **options).where("verdict = 'block'")
