"""Statistics, late data and the accuracy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.catalog.base import (
    EVENT_WINDOWS,
    events,
    query,
    rounded,
    sql_bucket_rows,
    sql_dds,
    sql_ddsc,
    sql_exact,
    sql_hash,
    sql_udds,
    sql_window,
    table,
)
from rankflow.functions.scalars import (
    QUANTILES,
    quantile_column,
    quantile_columns,
    run_id,
    window_id,
)
from rankflow.operators import kll, late, req, stats
from rankflow.operators.exact import exact_quantiles
from rankflow.plans import evaluate
from rankflow.plans.methods import SKETCHES, method, run_methods
from rankflow.scratch import new_path, stage
from rankflow.sources import files

# --- statistics ---------------------------------------------------------------------


@query("kurtosis", """
SELECT event_type, round(kurtosis(value), 4) AS kurtosis FROM events GROUP BY event_type""")
def _(spark, sf):
    df = table(spark, sf, "events")
    return df.groupBy("event_type").agg(F.round(stats.kurtosis("value"), 4).alias("kurtosis"))


@query("min_max", """
SELECT l_returnflag, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value
FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    return stats.min_max(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("sum_count_by_file", """
SELECT l_returnflag, l_linenumber,
       round(sum(l_extendedprice) FILTER (l_linestatus = 'O') / 1000, 4) AS "O",
       round(sum(l_extendedprice) FILTER (l_linestatus = 'F') / 1000, 4) AS "F"
FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def _(spark, sf):
    keys = ["l_returnflag", "l_linenumber"]
    totals = stats.sum_count_by(table(spark, sf, "lineitem"), [*keys, "l_linestatus"],
                                "l_extendedprice")
    return rounded(stats.pivot_total(totals, keys, "l_linestatus", ["O", "F"]), 4, "O", "F")


@query("window_size_count", f"""
SELECT {sql_window()} AS window_id, count(*) AS win_size FROM events GROUP BY 1""")
def _(spark, sf):
    return events(spark, sf).groupBy(window_id("ts", 86_400).alias("window_id")).agg(
        F.count(F.lit(1)).alias("win_size"))


@query("group_mean", """
SELECT l_returnflag, round_even(avg(l_extendedprice), 4) AS l_extendedprice,
       round_even(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    return stats.group_mean(table(spark, sf, "lineitem"), ["l_returnflag"],
                            ["l_extendedprice", "l_tax"], 4)


@query("group_ci95", """
SELECT l_returnflag, round(stddev_pop(l_extendedprice) * 1.96 / sqrt(count(*)), 4)
       AS l_extendedprice, round(stddev_pop(l_tax) * 1.96 / sqrt(count(*)), 8) AS l_tax
FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    ci = stats.group_ci95(table(spark, sf, "lineitem"), ["l_returnflag"],
                          ["l_extendedprice", "l_tax"])
    return rounded(rounded(ci, 4, "l_extendedprice"), 8, "l_tax")


@query("group_ci95_guarded", """
SELECT o_custkey, CASE WHEN count(DISTINCT o_totalprice) = 1 THEN 0.0
       ELSE round(stddev_pop(o_totalprice) * 1.96 / sqrt(count(*)), 4) END::DOUBLE AS o_totalprice
FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    ci = stats.group_ci95(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"], True)
    return rounded(ci, 4, "o_totalprice")


@query("value_histogram", """
SELECT event_type, round_even(value, 0)::DOUBLE AS value,
       round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 8) AS share
FROM events GROUP BY event_type, round_even(value, 0)""")
def _(spark, sf):
    hist = stats.value_histogram(table(spark, sf, "events"), "value", ["event_type"])
    return rounded(hist, 8, "share")


@query("value_histogram_all", """
SELECT round_even(value, 0)::DOUBLE AS value, round(count(*) / sum(count(*)) OVER (), 8) AS share
FROM events GROUP BY round_even(value, 0)""")
def _(spark, sf):
    return rounded(stats.value_histogram(table(spark, sf, "events"), "value"), 8, "share")


def sql_hist(bins: str, src: str, value: str) -> str:
    return f"""
SELECT bin, round(lo + bin * (hi - lo) / bins, 6) AS bin_start,
       round(count(*)::DOUBLE / any_value(n), 8) AS share FROM (
  SELECT least(floor(({value} - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin, lo, hi, bins, n
  FROM {src}, ({bins})) GROUP BY bin, lo, hi, bins"""


def _hist(df, value, bins):
    return rounded(rounded(stats.binned_histogram(df, value, bins), 6, "bin_start"), 8, "share")


@query("binned_histogram_fixed", sql_hist(
    "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, 10000 AS bins "
    "FROM orders", "orders", "o_totalprice"))
def _(spark, sf):
    df = table(spark, sf, "orders")
    return _hist(df, "o_totalprice", stats.fixed_bins(df, "o_totalprice", 10_000))


@query("binned_histogram_width", sql_hist("""
SELECT n, lo, lo + bins AS hi, bins FROM (
  SELECT count(*) AS n, min(value) AS lo, greatest(1, floor(max(value) - min(value)) + 1) AS bins
  FROM events)""", "events", "value"))
def _(spark, sf):
    df = table(spark, sf, "events")
    return _hist(df, "value", stats.width_bins(df, "value", 1.0))


@query("binned_histogram", sql_hist("""
SELECT n, lo, hi, ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, st) ELSE st END) AS bins FROM (
  SELECT count(*) AS n, min(value) AS lo, max(value) AS hi,
         2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))
           / pow(count(*)::DOUBLE, 1.0::DOUBLE / 3) AS fd,
         (max(value) - min(value)) / (log2(count(*)) + 1) AS st
  FROM events)""", "events", "value"))
def _(spark, sf):
    df = table(spark, sf, "events")
    return _hist(df, "value", stats.auto_bins(df, "value"))


@query("top_values", """
SELECT l_quantity::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY 1
ORDER BY n DESC, value LIMIT 10""")
def _(spark, sf):
    return stats.top_values(table(spark, sf, "lineitem"), F.col("l_quantity").cast("double"))


@query("top_values_distinct", """
SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1
ORDER BY n DESC, value LIMIT 10""")
def _(spark, sf):
    return stats.top_values(table(spark, sf, "lineitem"), "l_extendedprice", counters=2_000)


@query("top_total", """
SELECT sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity
ORDER BY n DESC, l_quantity LIMIT 10)""")
def _(spark, sf):
    return stats.top_total(table(spark, sf, "lineitem"), "l_quantity")


# --- late data --------------------------------------------------------------------------

# Events arrive minutes apart, so the delay is hours for some to be late.
DELAY_MS = 6 * 3_600_000
DELAYED = f"""
SELECT *, floor(event_ms / 86400000.0)::BIGINT AS window_id FROM (
  SELECT event_id, value, (epoch_us(ts) // 1000) AS ms,
         (epoch_us(ts) // 1000) - floor({-float(DELAY_MS)!r}::DOUBLE
           * ln(1.0 - {sql_hash('event_id')}))::BIGINT AS event_ms
  FROM events)"""
# The rule as it is stated: a running maximum over everything that came before.
MARKED = f"""
SELECT *, coalesce((window_id + 1) * 86400000 <= max(event_ms) OVER (
  ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS is_late
FROM ({DELAYED})"""


def _delayed(spark, sf):
    df = late.with_delay(events(spark, sf), "ms", "event_id", DELAY_MS)
    return df.withColumn("window_id", F.floor(F.col("event_ms") / 86_400_000).cast("bigint"))


@query("event_delay", f"SELECT event_id, event_ms FROM ({DELAYED})")
def _(spark, sf):
    return _delayed(spark, sf).select("event_id", "event_ms")


@query("late_drop", f"SELECT event_id, window_id, value FROM ({MARKED}) WHERE NOT is_late")
def _(spark, sf):
    return late.late_drop(_delayed(spark, sf).select("event_id", "window_id", "value"), "event_id")


LATE_COUNTS = f"""
SELECT window_id, count(*) AS win_size, count(*) FILTER (is_late) AS slack_events
FROM ({MARKED}) GROUP BY window_id"""


@query("late_count", LATE_COUNTS)
def _(spark, sf):
    return late.late_count(_delayed(spark, sf), "event_id")


@query("missing_data_report", f"""
SELECT count(*) AS windows, round(avg(slack_events * 100.0::DOUBLE / win_size), 6)
       AS mean_missing_pct FROM ({LATE_COUNTS}) WHERE slack_events > 0""")
def _(spark, sf):
    report = late.missing_data_report(late.late_count(_delayed(spark, sf), "event_id"))
    return rounded(report, 6, "mean_missing_pct")


# --- accuracy -----------------------------------------------------------------------------

ACC = [evaluate.acc_column(p) for p in QUANTILES]


def _windows(spark, sf):
    return events(spark, sf).withColumn("window_id", window_id("ts", 86_400))


def _run():
    return run_id("window_id")


def _by_window(spark, sf, name="dds", num_windows=None):
    df = _windows(spark, sf)
    real = exact_quantiles(df, "value", ["window_id"])
    approx = method(name).run(df, "value", ["window_id"])
    kept = evaluate.prepare_results(approx, _run(), num_windows=num_windows)
    return evaluate.accuracy_by_window(kept, real, run=_run())


SQL_APPROX = {
    name: sql(EVENT_WINDOWS, "value", "window_id", places=12)
    for name, sql in (("dds", sql_dds), ("ddsc", sql_ddsc), ("udds", sql_udds))
}
SQL_REAL = sql_exact(EVENT_WINDOWS, "value", "window_id")


def sql_by_window(name: str = "dds", num_windows: int | None = None) -> str:
    errors = ", ".join(
        f"abs(a.{c} - r.{c}) / r.{c} AS {c}_acc" for c in quantile_columns()
    )
    marked = f"SELECT *, substr(window_id::VARCHAR, 1, 4) AS run_id FROM ({SQL_APPROX[name]})"
    trimmed = marked if num_windows is None else f"""
      SELECT * EXCLUDE (rn, cnt) FROM (SELECT *,
        row_number() OVER (PARTITION BY run_id ORDER BY window_id DESC) AS rn,
        count(*) OVER (PARTITION BY run_id) AS cnt
        FROM ({marked}))
      WHERE NOT (rn = 1 AND cnt > {num_windows})"""
    return f"""
SELECT a.run_id, a.window_id, {errors}, r.n AS win_size
FROM ({trimmed}) a JOIN ({SQL_REAL}) r ON a.window_id = r.window_id"""


def sql_by_run(name: str = "dds") -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in [*ACC, "win_size"])
    return f"SELECT run_id, {means} FROM ({sql_by_window(name)}) GROUP BY run_id"


def _sql_mean(ps, wrap="{}") -> str:
    total = " + ".join(wrap.format(evaluate.acc_column(p)) for p in ps)
    return f"(({total}) / {len(ps)})"


def sql_bands(name: str = "dds") -> str:
    return (f"SELECT run_id, {_sql_mean(evaluate.MID)} AS mid, "
            f"{_sql_mean(evaluate.UPPER)} AS upper, {_sql_mean(evaluate.TOP)} AS p99 "
            f"FROM ({sql_by_run(name)})")


def sql_rounded(sql: str, columns, places: int = 6) -> str:
    cols = ", ".join(f"round({c}, {places}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({cols}) FROM ({sql})"


@query("accuracy_by_window", sql_rounded(sql_by_window(), ACC, 6))
def _(spark, sf):
    return rounded(_by_window(spark, sf), 6, *ACC)


@query("accuracy_by_window_trimmed", sql_rounded(sql_by_window("dds", 5), ACC, 6))
def _(spark, sf):
    return rounded(_by_window(spark, sf, num_windows=5), 6, *ACC)


@query("accuracy_by_run", sql_rounded(sql_by_run(), [*ACC, "win_size"], 6))
def _(spark, sf):
    return rounded(evaluate.accuracy_by_run(_by_window(spark, sf)), 6, *ACC, "win_size")


@query("accuracy_from_files", sql_rounded(
    f"SELECT *, 0.25::DOUBLE AS query_time FROM ({sql_by_run()})", [*ACC, "win_size"], 6))
def _(spark, sf):
    """The main analysis as it is run on stored results: two files, joined on the window."""
    df = _windows(spark, sf)
    names = quantile_columns()
    real = exact_quantiles(df, "value", ["window_id"]).select(
        "window_id", *names, F.col("n").alias("win_size"), F.lit(0).alias("slack_events"))
    found = method("dds").run(df, "value", ["window_id"]).select(
        "window_id", *names, F.lit(0.25).alias("query_time"))
    paths = {kind: new_path(spark, f"results-{kind}") for kind in ("exact", "dds")}
    files.write_result_table(real, paths["exact"])
    files.write_result_table(found, paths["dds"])
    approx = evaluate.prepare_results(files.scan_results(spark, paths["dds"], "dds"), _run(),
                                      num_windows=10)
    by_window = evaluate.accuracy_by_window(
        approx, files.scan_results(spark, paths["exact"], "exact"), run=_run())
    return rounded(evaluate.accuracy_by_run(by_window), 6, *ACC, "win_size")


@query("accuracy_bands", sql_rounded(sql_bands(), ["mid", "upper", "p99"], 6))
def _(spark, sf):
    bands = evaluate.accuracy_bands(evaluate.accuracy_by_run(_by_window(spark, sf)))
    return rounded(bands, 6, "mid", "upper", "p99")


ALL_BUT_LOWEST = (*evaluate.MID, *evaluate.UPPER, *evaluate.TOP)


@query("accuracy_overall",
       f"SELECT round(avg({_sql_mean(ALL_BUT_LOWEST)}), 4) AS error FROM ({sql_by_run()})")
def _(spark, sf):
    overall = evaluate.accuracy_overall(evaluate.accuracy_by_run(_by_window(spark, sf)))
    return rounded(overall, 4, "error")


REPORT_METHODS = ("dds", "ddsc", "udds")


#: KLL and REQ draw at random, and the moments fit differs in its last digits, so of
#: their mean relative errors it is said whether they are under the limit of the plots.
SAMPLED = tuple(name for name in SKETCHES if name not in REPORT_METHODS)
ERROR_LIMIT = 0.05


def sql_report() -> str:
    union = " UNION ALL ".join(
        f"SELECT '{name}' AS algo, * FROM ({sql_bands(name)})" for name in REPORT_METHODS
    )
    parts = " UNION ALL ".join(
        f"SELECT '{band}' AS band, algo, {c} AS e FROM ({union})"
        for band, c in (("Mid", "mid"), ("Upper", "upper"), ("0.99", "p99"))
    )
    sampled = ", ".join(f"('{name}')" for name in SAMPLED)
    return (f"SELECT band, algo, round_even(avg(e), 4) AS error, "
            f"round(stddev_pop(e) * 1.96 / sqrt(count(*)), 4) AS ci95, TRUE AS bounded "
            f"FROM ({parts}) GROUP BY band, algo UNION ALL "
            f"SELECT band, algo, NULL, NULL, TRUE FROM (VALUES ('Mid'), ('Upper'), ('0.99')) b(band), "
            f"(VALUES {sampled}) a(algo)")


@query("accuracy_report", sql_report())
def _(spark, sf):
    bands = evaluate.evaluate_methods(_windows(spark, sf), "value", run=_run())
    report = rounded(evaluate.accuracy_report(bands), 4, "ci95")
    fixed = F.col("algo").isin(*REPORT_METHODS)
    return report.select(
        "band", "algo", F.when(fixed, F.col("error")).alias("error"),
        F.when(fixed, F.col("ci95")).alias("ci95"), (F.col("error") <= ERROR_LIMIT).alias("bounded"))


def sql_totals(name: str) -> str:
    cols = {"Mid": evaluate.MID, "Upper": evaluate.UPPER, "0.99": evaluate.TOP}
    return " UNION ALL ".join(
        f"SELECT '{band}' AS band, round_even({_sql_mean(ps, 'avg({})')}, 4) AS {name} "
        f"FROM ({sql_by_run(name)})" for band, ps in cols.items()
    )


@query("collapse_cost", f"""
SELECT band, dds, ddsc, round_even(abs(dds - ddsc), 4) AS diff,
       round_even(abs(dds - ddsc) * 100.0::DOUBLE / dds, 4) AS diff_pct
FROM ({sql_totals("dds")}) JOIN ({sql_totals("ddsc")}) USING (band)""")
def _(spark, sf):
    df = _windows(spark, sf)
    real = stage(exact_quantiles(df, "value", ["window_id"]), "exact")

    both = stage(run_methods(df, "value", ["dds", "ddsc"], ["window_id"]), "results")

    def totals(name):
        approx = both.where(F.col("algo") == name)
        by_run = evaluate.accuracy_by_run(evaluate.accuracy_by_window(approx, real, run=_run()))
        return evaluate.accuracy_band_totals(by_run)

    return evaluate.collapse_cost(totals("dds"), totals("ddsc"))


# --- adaptability, kurtosis, size, merging and time reports ------------------------------------

# Values of events followed by values of orders, in runs by customer.
MIXED = """
SELECT user_id % 4 AS run_id, value FROM events
UNION ALL SELECT o_custkey % 4, o_totalprice FROM orders"""


def _mixed(spark, sf):
    first = events(spark, sf).select((F.col("user_id") % 4).alias("run_id"), "value")
    second = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 4).alias("run_id"), F.col("o_totalprice").alias("value"))
    return first.unionByName(second)


def sql_long(wide: str, keys: str, out: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {p!r}::DOUBLE AS quantile, {quantile_column(p)} AS {out} FROM ({wide})"
        for p in QUANTILES
    )


def sql_adaptability() -> str:
    table_sql = f"({sql_long(sql_exact(MIXED, 'value', 'run_id'), 'run_id', 'actual')})"
    for name, wide in (("dds", sql_dds), ("ddsc", sql_ddsc), ("udds", sql_udds)):
        long = sql_long(wide(MIXED, "value", "run_id", places=12), "run_id", name)
        table_sql += f" JOIN ({long}) USING (run_id, quantile)"

    def each(template: str) -> str:
        return ", ".join(template.format(c=c) for c in REPORT_METHODS)

    errors = f"""SELECT run_id, quantile,
        {each('round_even(abs(({c} - actual) / actual), 4) AS {c}')}
        FROM {table_sql} WHERE quantile NOT IN (0.01, 0.99)"""
    banded = f"""SELECT run_id, CASE WHEN quantile = 0.5 THEN 1 ELSE 0 END AS band,
        {each('round_even(avg({c}), 4) AS {c}')} FROM ({errors}) GROUP BY run_id, quantile"""
    per_run = f"""SELECT run_id, band, {each('round_even(avg({c}), 4) AS {c}')}
        FROM ({banded}) GROUP BY run_id, band"""
    return f"""SELECT band, {each('round(avg({c}), 6) AS {c}')},
        {each('round(stddev_pop({c}) * 1.96 / sqrt(count(*)), 6) AS {c}_ci')}
        FROM ({per_run}) GROUP BY band"""


@query("adaptability_report", sql_adaptability())
def _(spark, sf):
    pairs = evaluate.adaptability_table(_mixed(spark, sf), "value", REPORT_METHODS)
    report = evaluate.adaptability_report(pairs, REPORT_METHODS)
    return rounded(report, 6, *REPORT_METHODS, *[f"{c}_ci" for c in REPORT_METHODS])


DATASETS = """
SELECT 'events' AS dataset, user_id % 4 AS run, value FROM events
UNION ALL SELECT 'orders', o_custkey % 4, o_totalprice FROM orders
UNION ALL SELECT 'lineitem', l_suppkey % 4, l_extendedprice FROM lineitem"""


def _datasets(spark, sf):
    def one(name, tab, c, run):
        return table(spark, sf, tab).select(F.lit(name).alias("dataset"), (F.col(run) % 4).alias("run"),
                                            F.col(c).alias("value"))

    return (
        one("events", "events", "value", "user_id")
        .unionByName(one("orders", "orders", "o_totalprice", "o_custkey"))
        .unionByName(one("lineitem", "lineitem", "l_extendedprice", "l_suppkey"))
    )


def sql_kurtosis() -> str:
    p98 = quantile_column(0.98)
    keys = "dataset, run"
    parts = f"""(SELECT {keys}, round(kurtosis(value), 4) AS kurtosis FROM ({DATASETS})
        GROUP BY {keys}) JOIN (SELECT {keys}, {p98} AS actual
        FROM ({sql_exact(DATASETS, 'value', keys, [0.98])})) USING ({keys})"""
    for name, wide in (("dds", sql_dds), ("ddsc", sql_ddsc), ("udds", sql_udds)):
        parts += (f" JOIN (SELECT {keys}, {p98} AS {name} "
                  f"FROM ({wide(DATASETS, 'value', keys, ps=[0.98], places=12)})) USING ({keys})")
    errors = ", ".join(f"abs(({c} - actual) / actual) AS {c}" for c in REPORT_METHODS)
    cols = ", ".join(
        f"round(avg({c}), 6) AS {c}, round(CASE WHEN min({c}) = max({c}) THEN 0.0 "
        f"ELSE stddev_pop({c}) * 1.96 / sqrt(count(*)) END::DOUBLE, 6) AS {c}_ci" for c in REPORT_METHODS)
    bounds = ", ".join(f"TRUE AS {c}_bounded" for c in SAMPLED)
    return (f"SELECT dataset, round(avg(kurtosis), 2) AS kurtosis, round(avg(actual), 4) AS actual, "
            f"{cols}, {bounds} FROM (SELECT dataset, kurtosis, actual, {errors} FROM {parts}) "
            "GROUP BY dataset")


@query("kurtosis_report", sql_kurtosis())
def _(spark, sf):
    pairs = evaluate.kurtosis_table(_datasets(spark, sf), "dataset", "value", SKETCHES, runs=["run"])
    report = evaluate.kurtosis_report(pairs, "dataset", SKETCHES)
    fixed = [c for name in REPORT_METHODS for c in (name, f"{name}_ci")]
    shown = rounded(rounded(report, 4, "actual"), 6, *fixed)
    return shown.select("dataset", "kurtosis", "actual", *fixed, *[
        (F.col(c) <= ERROR_LIMIT).alias(f"{c}_bounded") for c in SAMPLED])


@query("tick_labels", f"""
SELECT dataset, round(avg(kurtosis), 2)::VARCHAR || chr(10) || '(' || dataset || ')' AS label
FROM (SELECT dataset, run, round(kurtosis(value), 4) AS kurtosis FROM ({DATASETS})
      GROUP BY dataset, run) GROUP BY dataset""")
def _(spark, sf):
    pairs = evaluate.kurtosis_table(_datasets(spark, sf), "dataset", "value", ["dds"], runs=["run"])
    return evaluate.kurtosis_report(pairs, "dataset", ["dds"]).select("dataset", "label")


def sql_sizes() -> str:
    key = "o_orderpriority"
    src = "SELECT * FROM orders"
    parts = [
        f"SELECT {key}, '{algo}' AS algo, (count(*) * 16)::BIGINT AS bytes FROM ({b}) GROUP BY {key}"
        for algo, b in sql_bucket_rows(src, "o_totalprice", key).items()
    ]
    parts.append(f"SELECT {key}, 'moments', 112::BIGINT FROM orders GROUP BY {key}")
    return " UNION ALL ".join(parts)


@query("sketch_size_bytes", sql_sizes())
def _(spark, sf):
    return evaluate.sketch_sizes(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"],
                                 ("moments", "dds", "ddsc", "udds"))


def sql_memory() -> str:
    parts = [
        f"SELECT dataset, '{algo}' AS algo, (count(*) * 16)::BIGINT AS bytes, TRUE AS bounded "
        f"FROM ({b}) GROUP BY dataset"
        for algo, b in sql_bucket_rows(DATASETS, "value", "dataset").items()
    ]
    parts.append(f"SELECT DISTINCT dataset, 'moments', 112::BIGINT, TRUE FROM ({DATASETS})")
    parts += [f"SELECT DISTINCT dataset, '{algo}', NULL::BIGINT, TRUE FROM ({DATASETS})"
              for algo in ("kll", "req")]
    return " UNION ALL ".join(parts)


@query("memory_report", sql_memory())
def _(spark, sf):
    sizes = evaluate.sketch_sizes(_datasets(spark, sf), "value", ["dataset"])
    # KLL keeps a few times k items of 4 bytes; REQ some k sections per level.
    most = F.when(F.col("algo") == "kll", 4 * kll.K * 4 + 200).when(
        F.col("algo") == "req", 40 * req.K * 6 * 4 + 1000)
    sampled = F.col("algo").isin("kll", "req")
    return sizes.select("dataset", "algo", F.when(~sampled, F.col("bytes")).alias("bytes"),
                        F.coalesce(F.col("bytes") <= most, F.lit(True)).alias("bounded"))


def sql_merge() -> str:
    src = "SELECT * FROM lineitem"
    args = (src, "l_extendedprice", "l_returnflag")
    cols = ", ".join(["l_returnflag", "n", *quantile_columns()])
    fixed = " UNION ALL ".join(
        f"SELECT '{name}' AS algo, {cols} FROM ({sql(*args)})"
        for name, sql in (("dds", sql_dds), ("ddsc", sql_ddsc), ("udds", sql_udds))
    )
    nulls = ", ".join("NULL" for _ in quantile_columns())
    return fixed + "".join(
        f" UNION ALL SELECT '{name}', l_returnflag, count(*), {nulls} FROM lineitem "
        "GROUP BY l_returnflag" for name in SAMPLED)


@query("merge_report", sql_merge())
def _(spark, sf):
    report = rounded(evaluate.merge_report(table(spark, sf, "lineitem"), "l_extendedprice",
                                           "l_linenumber", SKETCHES, ["l_returnflag"]))
    # Of the sampled ones, the count of what was merged; their ranks are checked by *_merge.
    fixed = F.col("algo").isin(*REPORT_METHODS)
    return report.select("algo", "l_returnflag", "n", *[
        F.when(fixed, F.col(c)).alias(c) for c in quantile_columns()])


MERGED = (10, 100, 1_000)
_PER_MERGE = "\n UNION ALL ".join(
    f"SELECT {m} AS num_sketches, l_extendedprice FROM lineitem WHERE l_partkey % 1000 < {m}"
    for m in MERGED)


def sql_merge_counts() -> str:
    args = (_PER_MERGE, "l_extendedprice", "num_sketches")
    cols = ", ".join(["num_sketches", "n", *quantile_columns()])
    fixed = " UNION ALL ".join(
        f"SELECT '{name}' AS algo, {cols}, NULL::BOOLEAN AS within FROM ({sql(*args)})"
        for name, sql in (("dds", sql_dds), ("ddsc", sql_ddsc), ("udds", sql_udds)))
    nulls = ", ".join("NULL" for _ in quantile_columns())
    return fixed + "".join(
        f" UNION ALL SELECT '{name}', num_sketches, count(*), {nulls}, TRUE FROM ({_PER_MERGE}) "
        "GROUP BY num_sketches" for name in SAMPLED)


@query("merge_report_counts", sql_merge_counts())
def _(spark, sf):
    """Sampled methods: whether every quantile of the merge is within the method's rank bound."""
    from rankflow.catalog.sketches import kll_bound, moments_bound, req_bound

    rows = table(spark, sf, "lineitem").select("l_extendedprice", F.pmod("l_partkey", F.lit(1000)).alias("id"))
    report = stage(rounded(evaluate.merge_counts_report(rows, "l_extendedprice", "id", MERGED, SKETCHES)),
                   "merges")
    sizes = F.explode(F.filter(F.array(*[F.lit(m) for m in MERGED]), lambda m: m > F.col("id")))
    each = rows.select("l_extendedprice", sizes.alias("num_sketches"))
    checked = []
    for name, bound in (("kll", kll_bound), ("req", req_bound), ("moments", moments_bound)):
        ranks = evaluate.rank_check(each, "l_extendedprice", report.where(F.col("algo") == name),
                                    ["num_sketches"], bound,
                                    dtype="double" if name == "moments" else "float")
        checked.append(ranks.groupBy("num_sketches").agg(F.every("within").alias("within")).withColumn(
            "algo", F.lit(name)))
    within = checked[0].unionByName(checked[1]).unionByName(checked[2])
    sampled = F.col("algo").isin("kll", "req", "moments")
    return report.join(within, ["algo", "num_sketches"], "left").select(
        "algo", "num_sketches", "n",
        *[F.when(~sampled, F.col(c)).alias(c) for c in quantile_columns()], "within")


@query("op_time_report_query", """
SELECT (l_orderkey // 1000000)::BIGINT AS "Data Size", round(avg(kll), 4) AS kll,
       round(stddev_pop(kll) * 1.96 / sqrt(count(*)), 4) AS kll_ci,
       round(avg(req), 4) AS req, round(stddev_pop(req) * 1.96 / sqrt(count(*)), 4) AS req_ci
FROM (SELECT l_linenumber::BIGINT * 1000000 AS l_orderkey, round(l_tax * 100) AS kll,
             l_partkey::DOUBLE AS req FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    """Measurements whose size is the line number in millions."""
    times = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber").cast("bigint") * 1_000_000).alias("Data Size"),
        F.round(F.col("l_tax") * 100).alias("kll"), F.col("l_partkey").cast("double").alias("req"))
    report = evaluate.op_time_report(times, "Data Size", ["kll", "req"], "query")
    return rounded(report, 4, "kll", "kll_ci", "req", "req_ci")


@query("op_time_report", """
SELECT "Num Sketches", round(avg(kll), 4) AS kll,
       round(stddev_pop(kll) * 1.96 / sqrt(count(*)), 4) AS kll_ci,
       round(avg(req), 4) AS req, round(stddev_pop(req) * 1.96 / sqrt(count(*)), 4) AS req_ci
FROM (SELECT l_quantity::BIGINT AS "Num Sketches",
             round_even(l_extendedprice / nullif(l_quantity - 1, 0), 4) AS kll,
             round_even(l_partkey::DOUBLE / nullif(l_quantity - 1, 0), 4) AS req FROM lineitem)
GROUP BY 1""")
def _(spark, sf):
    times = table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("bigint").alias("Num Sketches"),
        F.col("l_extendedprice").alias("kll"), F.col("l_partkey").cast("double").alias("req"),
    )
    report = evaluate.op_time_report(times, "Num Sketches", ["kll", "req"], "merge")
    return rounded(report, 4, "kll", "kll_ci", "req", "req_ci")


@query("op_time_report_insert", """
SELECT floor(o_totalprice * 100 / 1000000)::BIGINT AS size,
       round(avg(o_custkey / (o_totalprice * 100)), 8) AS dds,
       round(stddev_pop(o_custkey / (o_totalprice * 100)) * 1.96 / sqrt(count(*)), 8) AS dds_ci
FROM orders GROUP BY 1""")
def _(spark, sf):
    times = table(spark, sf, "orders").select(
        (F.col("o_totalprice") * 100).alias("size"), F.col("o_custkey").cast("double").alias("dds"))
    report = evaluate.op_time_report(times, "size", ["dds"], "insert")
    return rounded(report, 8, "dds", "dds_ci")
