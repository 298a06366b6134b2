"""The classifier: gradients, held-out accuracy, and rows at the edges."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankflow.llm import quality
from tests.conftest import SF


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 5)]
    y = np.array([0.0, 1.0, 1.0])
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), {
        "W": rng.normal(size=(quality.FEATURES, 4)) / 7, "b": rng.normal(size=4),
        "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3),
        "c": rng.normal(size=4), "d": np.array(0.1)})
    x, cuts = np.concatenate(bags), np.array([0, 1, 4, 9])

    def loss():
        p = model.forward(x, cuts)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = quality._gradients(model, x, cuts, y)
    for name, grad in grads.items():
        value = model.weights[name]
        for at in np.ndindex(value.shape) if value.size < 20 else [(0, 0), (5, 2)]:
            old, eps = value[at], 1e-6
            value[at] = old + eps
            up = loss()
            value[at] = old - eps
            down = loss()
            value[at] = old
            assert np.asarray(grad)[at] == pytest.approx((up - down) / 2 / eps, abs=1e-6), name


def test_passages_do_not_depend_on_neighbours():
    texts = ["", None, "one", "A b!! $$$ " * 40, "é\n|x| 12", " ", "word " * 120]
    together = []
    for first, x, cuts in quality.passages(pa.array(texts, pa.string())):
        assert first == len(together)
        together += [x[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    assert [len(x) for x in together] == [1, 1, 1, 3, 1, 1, 3]
    for text, x in zip(texts, together):
        alone = next(quality.passages(pa.array([text], pa.string())))[1]
        assert np.allclose(alone, x)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 800
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98


def test_edges(spark):
    rows = [(1, "clean words here", "a"), (2, None, "b"), (3, "", "c"), (None, "x", None),
            (1, "clean words here", "a"), (5, "long " * 50_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 0, 0), (9, 1, 0), (1, 7, 1)],
                                   "doc_id bigint, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
               for r in got)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    # Without labels of both kinds every score is their smoothed mean.
    some = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in some} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    a, b = (dict(quality.score_documents(docs, x).select("doc_id", "score").collect())
            for x in (labels, turned))
    assert a == b


def repeated(spark):
    """40 documents, of which id 0 has 300 rows and 50 labels."""
    texts = [(i, ("clean words of some length here " if i % 2 else "$$$ !! 77 BUY ") * 30 + str(i))
             for i in range(40)]
    docs = spark.createDataFrame(texts + [texts[0]] * 299, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 0)] * 49,
                                   "doc_id bigint, quality int")
    return docs, labels


def test_repeated_rows_and_labels_come_to_the_driver_once(spark, monkeypatch):
    docs, labels = repeated(spark)
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: seen.append(a) or fit(*a))
    model = quality.train(docs, labels, sample=20)
    (bags, y, weights), = seen
    assert len(bags) == len(y) == len(weights) == 20 and model.weights is not None
    every = sum(1 for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2)
    quality.train(docs, labels)
    _, y, weights = seen[1]
    assert len(y) == every and weights.max() == 300 * 50 and weights.sum() == 300 * 50 + every - 1


def test_training_bags_have_every_passage(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "long " * 25_000), (3, "short")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda *a: seen.append(a))
    quality.train(docs, labels)
    assert sorted(len(b) for b in seen[0][0]) == [1, 500]


def test_weights_count_as_repeats():
    rng = np.random.default_rng(5)
    x, cuts = rng.normal(size=(5, quality.FEATURES)), np.array([0, 2, 5])
    model = quality.fit([x[:2], x[2:]], np.array([0.0, 1.0]))
    once = quality._gradients(model, x, cuts, np.array([0.25, 1.0]), np.array([4.0, 1.0]))
    many = quality._gradients(model, np.concatenate([*[x[:2]] * 4, x[2:]]),
                              np.array([0, 2, 4, 6, 8, 11]), np.array([0.0, 0, 0, 1, 1]))
    assert all(np.allclose(once[k] * 2, many[k] * 5) for k in once)


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0), (3, 0)]])
def test_without_a_classifier_all_rows_stay(spark, marks):
    docs = spark.createDataFrame([(1, "clean words"), (3, "more"), (3, "more"), (None, None)],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    assert quality.keep_good(docs, labels).count() == 4
