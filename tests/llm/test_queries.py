"""The registered queries: SQL where there is some, and the pipeline's stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankflow.llm import licenses, queries, url_filter
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want, key=str)
    assert want


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [
        f"op{i}" for i in range(1, 14)]


# --- licences --------------------------------------------------------------------------


def test_license_units(spark):
    mit = next(t for _, k, t in licenses.TEMPLATES if k == "text")
    wrapped = mit.replace(", ", ",\n")
    rows = [(1, "Intro.\nReleased under the MIT License."), (2, f"Copyright (c) 2020 Some One\n{mit}"),
            (3, f"Intro\n\n{wrapped}\n\nOutro"), (4, None), (5, ""), (6, "license " * 50_000),
            (7, wrapped), (8, "Released under the MTI licence"), (1, "Intro.\nReleased under the MIT License.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, size string")
    got = [(r.doc_id, r.unit, r.position, r.license) for r in licenses.scan_licenses(df).collect()
           if r.template in ("text", "released")]
    assert sorted(got) == [(1, "line", 1, "MIT")] * 2 + [(1, "text", 0, "MIT")] * 2 + [
        (2, "line", 1, "MIT"), (2, "text", 0, "MIT"), (3, "block", 1, "MIT"), (3, "text", 0, "MIT"),
        (7, "text", 0, "MIT")]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licenses_inside_larger_texts(spark):
    body = {n: t for n, k, t in licenses.TEMPLATES if k == "text"}
    mit = body["MIT"].replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    bsd = body["BSD-3-Clause"]
    for head in ("1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE IS"):
        bsd = bsd.replace(f" {head}", f"\n\n{head}")
    prose = " ".join(f"word{i} and" for i in range(150))
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [f"{prose}\n\n{mit}\n\n{prose}", f"{prose}\n\n{bsd}", f"{prose}\n\n{mit}".replace("\n", "\r\n"),
             f"{prose}. {notice} {prose}", f"Copyright 2024 Acme. {notice}", f"(c) 2024 Acme {notice}",
             prose, notice, f"{notice}\n{prose} {notice}"]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[4])], "doc_id bigint, text string")
    got = licenses.scan_licenses(df).where("unit = 'run'").collect()
    best = {r.doc_id: (r.license, r.position) for r in got if r.license not in ("BSD-2-Clause",)}
    assert best == {0: ("MIT", 300), 1: ("BSD-3-Clause", 300), 2: ("MIT", 300), 3: ("Apache-2.0", 300),
                    4: ("Apache-2.0", 3), 5: ("Apache-2.0", 3), 8: ("Apache-2.0", 308), None: ("Apache-2.0", 3)}


# --- URL lists -------------------------------------------------------------------------


def brute_urls(captures, entries):
    out = []
    for i, url, day in captures:
        keys = url_keys(url)
        active = set()
        for key, kind in {(e[0], e[1]) for e in entries if None not in e}:
            state = None
            days = sorted({e[3] for e in entries if e[:2] == (key, kind) and e[3] is not None})
            for d in days:
                if day is not None and d <= day:
                    state = max(e[2] for e in entries if e[:2] == (key, kind) and e[3] == d)
            if state == "add" and key in keys and day is not None:
                active.add((len(key), kind == "allow", key, kind))
        best = max(active, default=None)
        out.append((i, len(active), best[3] if best else "none", best[2] if best else None))
    return sorted(out, key=str)


def url_keys(url):
    import re
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)", url or "")
    if not m:
        return set()
    host, parts = m[1].lower(), [p for p in m[2].lower().split("/") if p]
    labels = host.split(".")
    return {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {
        "/".join([host, *parts[:i + 1]]) for i in range(len(parts))}


def test_url_lists_over_time(spark):
    entries = [("example.org", "block", "add", 10), ("example.org", "block", "remove", 20),
               ("example.org", "block", "add", 30), ("example.org", "block", "add", 32),
               ("a.example.org", "allow", "add", 12), ("example.org/x/y", "block", "add", 5),
               ("a.example.org/x", "block", "add", 1), ("a.example.org/x", "block", "remove", 1),
               ("b.org", "allow", "add", 3), ("b.org", "block", "add", 3), (None, "block", "add", 1),
               ("c.org", None, "add", 1), ("c.org", "block", "add", None), ("d.org", "block", "remove", 4)]
    urls = ["http://example.org/", "https://A.Example.org:80/x/y?q#f", "http://u@example.org/x/y/z", None, "",
            "not a url", "http://b.org", "http://sub.b.org/p", "ftp://c.org", "http://d.org/", "http://org/"]
    captures = [(i, u, d) for i, u in enumerate(urls) for d in (0, 1, 4, 10, 15, 20, 31, 40)]
    captures += [(0, urls[0], None), (0, urls[0], 15), (None, urls[6], 15)]
    day = F.expr("date_add(DATE '2024-01-01', d)")
    e = spark.createDataFrame(entries, "key string, list string, action string, d int").withColumn("day", day)
    c = spark.createDataFrame([(*x, "clash") for x in captures],
                              "id bigint, url string, d int, rule string").withColumn("day", day)
    got = url_filter.filter_urls(c, e, "id")
    assert sorted(((r.id, r.n_active, r.decision, r.rule) for r in got.collect()), key=str) == brute_urls(
        captures, entries)
    assert url_filter.filter_urls(c.limit(0), e, "id").count() == 0
    none = url_filter.filter_urls(c, e.limit(0), "id").collect()
    assert len(none) == len(captures) and {r.decision for r in none} == {"none"}


# --- the pipeline ----------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(out := str(tmp_path / str(n)))
        docs = spark.read.parquet(out)
        kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert kept <= ids and kept
        if n < 4:
            assert docs.columns == columns
        if n in (3, 4):
            assert kept == ids
        ids = kept
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == docs.columns and run.count() == docs.count()


def test_stages_take_empty_and_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
            (2, "mail a@b.cd " * 3, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect()
