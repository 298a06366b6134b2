"""Late data, statistics, synthetic columns, sources and reports."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankflow import scratch
from rankflow.functions import scalars as sc
from rankflow.functions import uniform
from rankflow.operators import late, stats
from rankflow.plans import evaluate
from rankflow.sources import events as ev
from rankflow.sources import files, schemas


# --- late data ---------------------------------------------------------------


@pytest.fixture(scope="module")
def arrivals(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        event = i * 10 - int(rnd.expovariate(1 / 600))
        rows.append((i, event, event // 500))
    return rows, spark.createDataFrame(rows, "id long, event_ms long, window_id long").repartition(5)


def brute_late(rows):
    seen, out = -math.inf, {}
    for i, event, w in rows:
        out[i] = (w + 1) * 500 <= seen
        seen = max(seen, event)
    return out


def test_late_rule_matches_running_maximum(arrivals):
    rows, df = arrivals
    expect = brute_late(rows)
    assert 100 < sum(expect.values()) < 3900
    got = {r.id: r.is_late for r in late.mark_late(df, "id").collect()}
    assert got == expect
    kept = {r.id for r in late.late_drop(df, "id").collect()}
    assert kept == {i for i, is_late in expect.items() if not is_late}


def test_late_rule_across_blocks_and_without_broadcast(arrivals, monkeypatch):
    rows, df = arrivals
    monkeypatch.setattr(late, "_BLOCK", 3)
    monkeypatch.setattr(late, "is_small", lambda d: False)
    assert {r.id: r.is_late for r in late.mark_late(df, "id").collect()} == brute_late(rows)


def test_late_counts_and_report(arrivals):
    rows, df = arrivals
    expect = brute_late(rows)
    sizes, lost = Counter(w for _, _, w in rows), Counter()
    for i, _, w in rows:
        lost[w] += expect[i]
    counts = late.late_count(df, "id")
    assert {r.window_id: (r.win_size, r.slack_events) for r in counts.collect()} == {
        w: (sizes[w], lost[w]) for w in sizes}
    shares = [100 * lost[w] / sizes[w] for w in sizes if lost[w]]
    report = late.missing_data_report(counts).first()
    assert report.windows == len(shares)
    assert report.mean_missing_pct == pytest.approx(np.mean(shares))


def test_event_delay(spark):
    d = late.with_delay(spark.range(5000).withColumn("ms", F.col("id") * 10), "ms", "id")
    mean = d.agg(F.avg(F.col("ms") - F.col("event_ms"))).first()[0]
    assert 140 < mean < 160
    same = late.with_delay(spark.range(5).withColumn("ms", F.col("id")), "ms", "id",
                           missing_data=False)
    assert same.where("ms <> event_ms").count() == 0


def test_drop_last_partial_window(spark):
    rows = [("a", w) for w in range(12)] + [("b", w) for w in range(10)]
    df = spark.createDataFrame(rows, "run_id string, window_id long")
    left = late.drop_last_partial_window(df).groupBy("run_id").agg(
        F.count("*").alias("n"), F.max("window_id").alias("m")).collect()
    assert {(r.run_id, r.n, r.m) for r in left} == {("a", 11, 10), ("b", 10, 9)}


# --- statistics ----------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": ["a"] * 400 + ["b"] * 300, "v": rng.lognormal(1, 1, 700).round(3)})
    return pdf, spark.createDataFrame(pdf)


def test_kurtosis(table, spark):
    pdf, df = table
    got = {r.g: r.k for r in df.groupBy("g").agg(stats.kurtosis("v").alias("k")).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part.v.kurt())
    few = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert few.agg(stats.kurtosis("v").alias("k")).first().k is None


def test_means_and_intervals(table, spark):
    pdf, df = table
    ci = {r.g: r.v for r in stats.group_ci95(df, ["g"], ["v"]).collect()}
    for g, part in pdf.groupby("g"):
        v = part.v.to_numpy()
        expect = math.sqrt((v**2).mean() - v.mean() ** 2) * 1.96 / math.sqrt(len(v))
        assert ci[g] == pytest.approx(expect)
    one = spark.createDataFrame([("x", 0.1), ("x", 0.1), ("x", 0.1)], "g string, v double")
    assert stats.group_ci95(one, ["g"], ["v"], guarded=True).first().v == 0.0


def test_histograms(table):
    pdf, df = table
    hist = {r.value: r.share for r in stats.value_histogram(df, "v").collect()}
    expect = pdf.v.round().value_counts(normalize=True)
    assert hist == pytest.approx(expect.to_dict())

    edges = np.histogram_bin_edges(pdf.v, bins="auto")
    bins = stats.auto_bins(df, "v").first()
    assert bins.bins == len(edges) - 1
    for made, ref in ((stats.auto_bins(df, "v"), edges),
                      (stats.fixed_bins(df, "v", 50), np.histogram_bin_edges(pdf.v, 50))):
        rows = stats.binned_histogram(df, "v", made).collect()
        counts = np.histogram(pdf.v, ref)[0]
        assert {r.bin: round(r.share * 700) for r in rows} == {
            i: c for i, c in enumerate(counts) if c}
        assert all(r.bin_start == pytest.approx(ref[r.bin]) for r in rows)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "v double")
    for bins in (stats.auto_bins(df, "v"), stats.width_bins(df, "v"), stats.fixed_bins(df, "v", 9)):
        assert [(r.bin, r.share) for r in stats.binned_histogram(df, "v", bins).collect()] == [(0, 1)]


def test_top_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 2, 3, 3, 3, 4]], "v double")
    assert [(r.value, r.n) for r in stats.top_values(df, "v", 2).collect()] == [(3.0, 3), (1.0, 2)]
    assert stats.top_total(df, "v", 2).first().n == 5


# --- scalars and synthetic columns -------------------------------------------------


def test_quantile_names():
    assert sc.quantile_columns((0.01, 0.5, 0.99, 0.999)) == ["pct_01", "pct_50", "pct_99", "pct_99_9"]


def test_scalars(spark):
    row = spark.range(1).select(
        sc.window_id(F.timestamp_millis(F.lit(59_999)), 20).alias("w"),
        sc.window_id(F.timestamp_millis(F.lit(-1)), 20).alias("neg"),
        sc.run_id(F.lit(19723)).alias("run"),
        sc.round4(F.lit(1.00005)).alias("r"),
        sc.relative_error(F.lit(1.0), F.lit(-2.0)).alias("e"),
        sc.relative_error(F.lit(1.0), F.lit(0.0)).alias("none"),
        sc.to_millions(F.lit(2_999_999)).alias("m"),
        sc.tick_label(F.lit(1.25), F.lit("taxi")).alias("t"),
        sc.quantile_band(F.lit(0.5)).alias("b"),
    ).first()
    assert row.asDict() == {"w": 2, "neg": -1, "run": "1972", "r": 1.0001, "e": -1.5, "none": None,
                            "m": 2, "t": "1.25\n(taxi)", "b": 1}


def test_bad_numbers_raise_unless_lenient(spark):
    df = spark.createDataFrame([("x1",)], "v string")
    with pytest.raises(Exception):
        df.select(sc.value_as_double("v")).collect()
    assert df.select(sc.value_as_double("v", strict=False)).first()[0] is None
    assert df.select(sc.value_as_float("v", strict=False)).first()[0] is None


def test_synthetic_distributions(spark):
    ids = spark.range(30_000)
    row = ids.select(
        uniform.gen_uniform("id", 30, 100).alias("u"), uniform.gen_pareto("id").alias("p"),
        uniform.gen_normal("id", 5, 2).alias("n"), uniform.gen_exponential("id").alias("e"),
        uniform.gen_binomial("id").alias("b"), uniform.gen_zipf("id").alias("z"),
        uniform.gen_pareto_drifting("id").alias("pd"),
        uniform.gen_uniform_drifting("id").alias("ud"),
    ).agg(
        F.avg("u").alias("u"), F.percentile("p", 0.5).alias("p"), F.avg("n").alias("n"),
        F.stddev("n").alias("ns"), F.avg("e").alias("e"), F.avg("b").alias("b"),
        F.min("z").alias("z1"), F.max("z").alias("z2"), F.percentile("pd", 0.5).alias("pd"),
        F.avg("ud").alias("ud"), F.min("p").alias("pmin"),
    ).first()
    assert row.u == pytest.approx(65, abs=0.5) and row.p == pytest.approx(2, abs=0.06)
    assert row.n == pytest.approx(5, abs=0.05) and row.ns == pytest.approx(2, abs=0.05)
    assert row.e == pytest.approx(149.5, abs=3) and row.b == pytest.approx(12, abs=0.1)
    assert (row.z1, row.z2) == (1, 20) and row.pmin >= 1
    assert row.pd == pytest.approx(2, abs=0.1) and row.ud == pytest.approx(550, abs=8)


def test_synthetic_columns_do_not_depend_on_partitioning(spark):
    a = spark.range(0, 500, 1, 1).select("id", uniform.gen_normal("id").alias("v")).collect()
    b = spark.range(0, 500, 1, 7).select("id", uniform.gen_normal("id").alias("v")).collect()
    assert sorted(a) == sorted(b)


def test_event_stream_rates(spark):
    fast = uniform.gen_event_stream(spark.range(1000), "id", 0, 50_000)
    assert fast.groupBy("arrival_ms").count().select(F.max("count")).first()[0] == 50
    slow = uniform.gen_event_stream(spark.range(20_000), "id", 0, 250)
    assert 4700 < slow.count() < 5300


# --- files -------------------------------------------------------------------------


def test_taxi_and_power_files(spark, tmp_path):
    (tmp_path / "taxi.csv").write_text("m1,h1,v1,2013-01-01,CSH,10.0,0.5,0.5,1.0,0.0,12.0\n")
    (tmp_path / "power.txt").write_text("16/12/2006;17:24:00;4.216;0.418;234.840;18.4;0;1;17\n")
    taxi = files.scan_taxi_csv(spark, str(tmp_path / "taxi.csv")).first()
    power = files.scan_power_csv(spark, str(tmp_path / "power.txt")).first()
    assert (taxi.medallion, taxi.total_amount) == ("m1", 12.0)
    assert (power.Date, power.Global_active_power, power.Sub_metering_3) == ("16/12/2006", 4.216, 17.0)
    (tmp_path / "bad.txt").write_text("16/12/2006;17:24:00;?;0.418;234.840;18.4;0;1;17\n")
    with pytest.raises(Exception):
        files.scan_power_csv(spark, str(tmp_path / "bad.txt")).collect()
    lenient = files.scan_power_csv(spark, str(tmp_path / "bad.txt"), strict=False).first()
    assert lenient.Global_active_power is None and lenient.Voltage == 234.84


def test_result_files(spark, tmp_path):
    for name in ("kll", "dds", "exact"):
        schema = schemas.EXACT_RESULTS if name == "exact" else schemas.sketch_results(name)
        row = tuple(7 if f.dataType.simpleString() == "bigint" else 0.5 for f in schema)
        path = str(tmp_path / files.result_name("taxi", name))
        files.write_window_results(spark.createDataFrame([row], schema), path)
        back = files.scan_results(spark, path, name)
        assert back.columns == [f.name for f in schema] and tuple(back.first()) == row
    assert ("num_retained" in schemas.sketch_results("req").names) and (
        "num_retained" not in schemas.sketch_results("moments").names)


def test_sample_and_time_files(spark, tmp_path):
    path = str(tmp_path / "sample")
    sample = spark.range(100).withColumn("v", F.col("id") / 4)
    files.export_sample(sample, "id", "v", path, "adapt_val")
    assert files.scan_sample_csv(spark, path, "adapt_val").agg(F.sum("adapt_val")).first()[0] == 1237.5
    (tmp_path / "m.csv").write_text("Num Sketches,DDS,KLL,Moments,REQ,UDDS\n10,9,18,27,36,45\n")
    times = files.scan_op_times(spark, str(tmp_path / "m.csv"), "merge")
    row = evaluate.op_time_report(times, "Num Sketches", ["DDS", "KLL"], "merge").first()
    assert (row["Num Sketches"], row.DDS, row.KLL, row.DDS_ci) == (10, 1.0, 2.0, 0.0)


def test_json_round_trip_keeps_key_and_value(spark):
    df = spark.createDataFrame([(1.5, 10)], "v double, ms long")
    row = ev.to_json_events(df, ["v"], "ms").first()
    assert row.key == row.value == '{"v":"1.5","event_time":"10"}'


# --- reports -------------------------------------------------------------------------


def test_accuracy_chain(spark):
    """The whole chain against pandas on two runs of windows."""
    rng = np.random.default_rng(9)
    windows = [100_000 + i for i in range(12)] + [200_000 + i for i in range(4)]
    cols = sc.quantile_columns()
    real = pd.DataFrame(rng.uniform(1, 9, (16, 9)), columns=cols)
    real.insert(0, "window_id", windows)
    real["win_size"], real["slack_events"] = 50, 1
    approx = real[["window_id", *cols]].copy()
    approx[cols] *= rng.uniform(0.97, 1.03, (16, 9))
    run = sc.run_id("window_id")
    assert evaluate.prepare_results(spark.createDataFrame(approx), run).count() == 16
    kept = evaluate.prepare_results(spark.createDataFrame(approx), run, num_windows=10)
    by_window = evaluate.accuracy_by_window(kept, spark.createDataFrame(real), run=run)
    by_run = evaluate.accuracy_by_run(by_window)
    got = {r.run_id: r for r in by_run.collect()}

    merged = approx[approx.window_id != 100_011].merge(real, on="window_id",
                                                      suffixes=("_a", "_r"))
    errors = pd.DataFrame({c: (merged[c + "_a"] - merged[c + "_r"]).abs() / merged[c + "_r"]
                           for c in cols})
    errors["run"] = merged.window_id.astype(str).str[:4]
    means = errors.groupby("run").mean()
    for run in means.index:
        for c in cols:
            assert got[run][c + "_acc"] == pytest.approx(means.loc[run, c])
    mid = means[["pct_05", "pct_25", "pct_50", "pct_75", "pct_90"]].mean(axis=1)
    bands = {r.run_id: r for r in evaluate.accuracy_bands(by_run).collect()}
    totals = evaluate.accuracy_band_totals(by_run).first()
    for run in means.index:
        assert bands[run].mid == pytest.approx(mid[run])
        assert bands[run].p99 == pytest.approx(means.loc[run, "pct_99"])
    assert totals.mid == pytest.approx(round(mid.mean(), 4))
    overall = means.drop(columns="pct_01").mean(axis=1).mean()
    assert evaluate.accuracy_overall(by_run).first().error == pytest.approx(round(overall, 6))
    report = evaluate.accuracy_report(
        evaluate.accuracy_bands(by_run).select(F.lit("dds").alias("algo"), "*")).collect()
    assert [r.band for r in report] == ["Mid", "Upper", "0.99"]
    assert report[0].error == pytest.approx(round(mid.mean(), 4))
    assert report[0].ci95 == pytest.approx(mid.std(ddof=0) * 1.96 / math.sqrt(2))
    cost = evaluate.collapse_cost(evaluate.accuracy_band_totals(by_run),
                                  evaluate.accuracy_band_totals(by_run)).collect()
    assert all(r["diff"] == 0 and r.diff_pct == 0 for r in cost)


def test_adaptability_and_kurtosis_reports(spark):
    rows = [(run, p, 10.0, 10.0 + run * p) for run in (1, 2) for p in sc.QUANTILES]
    t = spark.createDataFrame(rows, "run_id int, quantile double, actual double, dds double")
    got = {r.band: r for r in evaluate.adaptability_report(t, ["dds"]).collect()}
    assert got[1].dds == pytest.approx(np.mean([0.05, 0.1]))
    rest = [p for p in sc.QUANTILES if p not in (0.01, 0.5, 0.99)]
    per_run = [round(np.mean([round(run * p / 10, 4) for p in rest]), 4) for run in (1, 2)]
    assert got[0].dds == pytest.approx(np.mean(per_run), abs=1e-4)

    k = spark.createDataFrame([("b", 5.123, 2.0, 2.2), ("a", -1.2, 4.0, 4.0)],
                              "dataset string, kurtosis double, actual double, kll double")
    rows = evaluate.kurtosis_report(k, "dataset", ["kll"]).collect()
    assert [(r.dataset, r.kurtosis, r.kll, r.kll_ci) for r in rows] == [
        ("a", -1.2, 0.0, 0.0), ("b", 5.12, 0.1, 0.0)]
    assert rows[1].label == "5.12\n(b)"


def test_merge_report_equals_single_build(spark):
    df = spark.range(6000).select(
        (F.col("id") % 100).alias("sketch_id"),
        uniform.gen_alternating(F.col("id") % 100, "id").alias("v"))
    names = ("dds", "ddsc", "udds", "moments", "kll", "req")
    rows = {r.algo: r for r in evaluate.merge_report(df, "v", "sketch_id", names).collect()}
    from rankflow.plans.methods import method

    for name in ("dds", "ddsc", "udds"):
        whole = method(name).run(df, "v").first()
        for c in sc.quantile_columns():
            assert rows[name][c] == pytest.approx(whole[c])
    assert {r.n for r in rows.values()} == {6000}


def test_sizes(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"),
                                  uniform.gen_pareto("id").alias("v"))
    sizes = defaultdict(dict)
    for r in evaluate.sketch_sizes(df, "v", ["g"]).collect():
        sizes[r.algo][r.g] = r.bytes
    assert sizes["moments"] == {0: 112, 1: 112}
    assert all(v % 16 == 0 and 0 < v <= 1024 * 16 for v in sizes["udds"].values())
    assert all(500 < v < 20_000 for a in ("kll", "req") for v in sizes[a].values())


def test_rank_check_notices_wrong_values(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    wide = spark.createDataFrame([("a", 1000, 500.0, 700.0)], "g string, n long, pct_50 double, pct_90 double")
    got = {r.quantile: r.within for r in evaluate.rank_check(
        df, "v", wide, ["g"], lambda p, n: F.lit(0.01), (0.5, 0.9)).collect()}
    assert got == {0.5: True, 0.9: False}


# --- stage tables ------------------------------------------------------------------------


def test_stage_tables(spark):
    df = spark.range(10).withColumn("k", F.lit(None).cast("string"))
    staged = scratch.stage(df)
    assert staged.schema.names == df.schema.names and staged.count() == 10
    assert scratch.is_small(staged, 10) and not scratch.is_small(staged, 9)
    joined = scratch.join_groups(staged, staged.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert joined.count() == 10
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch.shared_dir(spark) == configured.rstrip("/")
