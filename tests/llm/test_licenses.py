"""Runs of licence words: built-in functions against SQL, hashes against Spark's."""

import random

import duckdb
from pyspark.sql import functions as F

from rankflow.llm import licenses

BODY = {(n, k): t for n, k, t in licenses.TEMPLATES}
COLUMNS = ["dice", "doc_id", "license", "position", "template", "unit"]


def as_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({licenses.scan_sql()})").fetchall()


def as_spark(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, _body string, _g int")
    return [tuple(r) for r in licenses.scan_licenses(df).select(*COLUMNS).collect()]


def planted(rng):
    """Licences in prose: whole, damaged, cut by line ends, side by side, after notices."""
    bodies = list(BODY.values())
    prose = [f"word{i}" for i in range(40)] + "the and of this is license software any to in".split()
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [rng.choice(prose) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.3:
                parts.append("\nCopyright (c) 2024 Some One")
            words = rng.choice(bodies).split(" ")
            words = [w for w in words if rng.random() > 0.03]
            for gap in ("\n", "\r\n", "\n\n"):
                at = rng.randint(0, len(words))
                if rng.random() < 0.5:
                    words[at:at] = [gap]
            if rng.random() < 0.3:
                at = rng.randint(0, len(words))
                words[at:at] = rng.choices(prose, k=rng.randint(1, 12))
            parts += words * rng.choice((1, 1, 1, 2, 3))
        texts.append(" ".join(parts))
    return texts


def test_runs_equal_sql(spark):
    rng = random.Random(5)
    mit, apache = BODY["MIT", "text"], BODY["Apache-2.0", "header"]
    texts = [*planted(rng), None, "", "one", f"{mit} {mit} {mit}", f"{mit}\n\n{mit}\nx {apache}", "the software is " * 500,
             f"x {apache} y", mit[:200], "in the software " * 3 + mit]
    rows = [*enumerate(texts), (3, texts[3]), (None, f"see {apache}")]
    got = as_spark(spark, rows)
    assert sorted(got, key=str) == sorted(as_sql(rows), key=str)
    runs = [r for r in got if r[-1] == "run"]
    assert len(runs) > 60 and len({r[2] for r in runs}) > 8


def test_copies_side_by_side(spark):
    mit = BODY["MIT", "text"]
    n = len(mit.replace("/", " ").split())
    prose = " ".join(f"word{i}" for i in range(400))  # without it the whole line is a unit that matches
    got = as_spark(spark, [(1, f"intro {mit} {mit} {mit} {prose}\n{mit} and more")])
    assert sorted(r[3] for r in got if r[-1] == "run" and r[2] == "MIT") == [1, 1 + n, 1 + 2 * n]
    assert [r[3] for r in got if r[-1] == "line" and r[2] == "MIT"] == [1]


def test_megabytes_of_licences(spark):
    body = " ".join(BODY["MIT", "text"].split()[:40]) + " " + BODY["ISC", "text"]
    got = as_spark(spark, [(1, " ".join(f"{body} between{i}" for i in range(2_500)))])
    assert sum(r[-1] == "run" and r[2] == "ISC" for r in got) == 2_500


def test_hashes_are_sparks(spark):
    sets = spark.createDataFrame(
        [(i, t[2]) for i, t in enumerate(licenses.TEMPLATES)], "i int, body string").select(
        "i", licenses.bigram_set(licenses.line_words(F.lower("body"))).alias("g")).orderBy("i").collect()
    assert [r.g for r in sets] == licenses.template_grams()


def test_no_python_in_the_plan(spark):
    df = licenses.scan_licenses(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
