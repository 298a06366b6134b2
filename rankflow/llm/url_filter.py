"""URL lists over time: dated entries become intervals, captures join as of their date.

``entries``: ``key, list ('block' or 'allow'), action ('add' or 'remove'), day``.  A key is a
host or a domain (``example.org`` covers its subdomains) or a host with leading path
segments (``example.org/a/b``), in lower case.  An entry holds from the day it is added up to
the day it is removed; of several actions on one day the removal counts.  Repeated entries
change nothing; entries with a NULL, or of any other list, are left out.

``captures``: an id, a URL and the day it was fetched.  Of the entries active on that day,
the one with the longest key decides, and ``allow`` wins over ``block`` on the same key.  A
capture with a NULL or unreadable URL or a NULL day meets no entry.  Every capture row is
returned once; repeated rows give repeated results.

The as-of join is one sort: captures and the starts of intervals of a key stand in one order of
days, each capture takes the last interval that began on each list, and its end decides.  So it
costs the sum of both sides, however often a key was listed and taken off.

Built-in functions only.  A key that many captures share is spread over ``SALTS`` parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it has over one in ``HOT_SHARE`` of the lookups, so at most this
#: many keys can be hot and the list of them may be broadcast.
HOT_SHARE = 1000
SALTS = 64
LISTS = ("block", "allow")

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def url_keys(url: Column) -> Column:
    """All keys that may list a URL: its domains, and its host with leading paths."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    path = F.filter(F.split(F.lower(F.regexp_extract(url, URL, 2)), "/"), lambda p: p != "")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(path) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1))),
        lambda i: F.concat_ws("/", host, F.array_join(F.slice(path, F.lit(1), i), "/"))))
    keys = F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def list_intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``key, list, since, until`` (until is exclusive, NULL if open)."""
    daily = entries.where(F.col("key").isNotNull() & F.col("list").isin(*LISTS) & F.col("day").isNotNull()).groupBy(
        "key", "list", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("key", "list").orderBy("day")
    turns = daily.withColumn("_last", F.lag("action").over(order)).where(
        "action <> coalesce(_last, 'remove')")
    return turns.withColumn("until", F.lead("day").over(order)).where("action = 'add'").select(
        "key", "list", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url: str = "url",
                day: str = "day") -> DataFrame:
    """``id_col, url, day, n_active, decision, rule`` for every capture."""
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"),
                           F.col(day).cast("date").alias("_day"))
    asked = rows.where("_day IS NOT NULL").select(
        "*", F.explode(url_keys(F.col("_url"))).alias("key"))
    total = captures.count()
    hot = asked.groupBy("key").count().where(F.col("count") > total / HOT_SHARE).select(
        "key", F.lit(True).alias("_hot"))

    salt = F.pmod(F.xxhash64("_id", "_url", "_day"), F.lit(SALTS)).cast("int")
    asked = asked.join(F.broadcast(hot), "key", "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0)))
    listed = list_intervals(entries).join(F.broadcast(hot), "key", "left").withColumn(
        "_salt", F.explode(salts)).drop("_hot")

    interval = F.struct(F.col("list"), F.col("key"), F.col("until"))
    starts = listed.select("key", "_salt", F.col("since").alias("_day"), F.lit(False).alias("_asks"), *[
        F.when(F.col("list") == name, interval).alias(f"_{name}") for name in LISTS])
    order = Window.partitionBy("key", "_salt").orderBy("_day", "_asks").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    as_of = asked.withColumn("_asks", F.lit(True)).unionByName(
        starts, allowMissingColumns=True).select("_id", "_url", "_day", "_asks", F.array(*[
            F.last(f"_{name}", ignorenulls=True).over(order) for name in LISTS]).alias("_last"))
    met = as_of.where("_asks").select("_id", "_url", "_day", F.explode("_last").alias("_e")).where(
        "_e IS NOT NULL AND (_e.until IS NULL OR _day < _e.until)").select(
        "_id", "_url", "_day", "_e.list", "_e.key")
    strength = F.struct(F.length("key"), (F.col("list") == "allow").cast("int"), F.col("key"))
    # Repeated captures meet the same entries, so sets and maxima are unharmed by them.
    decided = met.groupBy("_id", "_url", "_day").agg(
        F.size(F.collect_set(F.struct("key", "list"))).cast("bigint").alias("n_active"),
        F.max_by(F.struct("list", "key"), strength).alias("_best"))
    back = decided.withColumnsRenamed({"_id": "_i", "_url": "_u", "_day": "_d"})
    return rows.join(
        back, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_url") == F.col("_u"))
        & (F.col("_day") == F.col("_d")), "left").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url), F.col("_day").alias(day),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.coalesce("_best.list", F.lit("none")).alias("decision"),
        F.col("_best.key").alias("rule"))
