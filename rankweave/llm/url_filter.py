"""URL filtering by dated lists: each capture is judged by the entries in force when it was fetched.

An entry adds a pattern to the list or removes it, from its date on. The entries of a pattern
become intervals of validity (each ends when the next begins). Patterns are a domain, which covers
its subdomains, or the beginning of a URL up to the end of a path segment; so a capture has a few
keys, and the as-of join is an equi-join on key and period with a test of the interval. Periods of
PERIOD_DAYS keep the entries that a key has at one time few, however often it was listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIOD_DAYS = 64
FOREVER = 2_932_896  # days from 1970 to the end of 9999


def validity(entries: DataFrame) -> DataFrame:
    """entries(pattern, action 'add' or 'remove', dated date) -> (pattern, day_from, day_to) of the times listed, to excluded.

    Of several entries of a pattern on one date, 'add' wins. Entries with a null are left out.
    """
    e = entries.select(F.lower("pattern").alias("pattern"), "action", F.datediff("dated", F.lit("1970-01-01")).alias("day")).where("pattern IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL")
    e = e.groupBy("pattern", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("listed"))
    by_day = Window.partitionBy("pattern").orderBy("day")
    e = e.withColumn("was", F.lag("listed").over(by_day)).where("was IS NULL OR was != listed")
    e = e.withColumn("day_to", F.coalesce(F.lead("day").over(by_day), F.lit(FOREVER)))
    return e.where("listed = 1").select("pattern", F.col("day").alias("day_from"), "day_to")


def url_keys(url):
    """The patterns that cover a URL: its host and its parents, and its beginnings up to each path segment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?|[?#].*$", "")
    bare = F.regexp_replace(bare, r"^([^/:]*):[0-9]+", "$1")
    host, parts = F.substring_index(bare, "/", 1), F.filter(F.split(bare, "/"), lambda x: x != "")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parents, paths))


def filtered_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched") -> DataFrame:
    """(page_id, url, fetched, n_entries, pattern, blocked): one row for each distinct capture.

    n_entries counts the patterns in force at the capture's date that cover its URL, pattern is the
    first of them by the alphabet (null if none), blocked is whether there is any. A null or empty
    URL is covered by none, and so is a capture with a null date. Repeated captures are one row;
    an empty list blocks nothing. Other columns are ignored.
    """
    c = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(date_col).cast("date").alias("fetched")).distinct()
    c = c.withColumn("day", F.datediff("fetched", F.lit("1970-01-01")))
    low, high = c.agg(F.min("day"), F.max("day")).first()  # intervals are cut to the days that have captures
    keyed = c.select("page_id", "url", "fetched", "day", F.floor(F.col("day") / PERIOD_DAYS).alias("period"), F.explode_outer(url_keys(F.col("url"))).alias("pattern"))
    v = validity(entries).select("pattern", F.greatest("day_from", F.lit(low or 0)).alias("day_from"), F.least("day_to", F.lit((high or 0) + 1)).alias("until")).where("day_from < until")
    periods = F.sequence(F.floor(F.col("day_from") / PERIOD_DAYS), F.floor((F.col("until") - 1) / PERIOD_DAYS))
    v = v.select("pattern", "day_from", "until", F.explode(periods).alias("period"))
    hit = keyed.where("day IS NOT NULL AND pattern != ''").join(v, ["pattern", "period"]).where("day >= day_from AND day < until")
    hit = hit.groupBy("page_id", "url", "fetched").agg(F.count_distinct("pattern").alias("n_entries"), F.min("pattern").alias("pattern"))
    hit = hit.select(*(F.col(k).alias(f"hit_{k}") for k in ("page_id", "url", "fetched")), "n_entries", "pattern")
    same = [F.col(k).eqNullSafe(F.col(f"hit_{k}")) for k in ("page_id", "url", "fetched")]
    out = c.join(hit, same[0] & same[1] & same[2], "left")
    return out.select("page_id", "url", "fetched", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "pattern", F.col("pattern").isNotNull().alias("blocked"))
