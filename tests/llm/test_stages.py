"""Every stage of the pipeline on tables whose columns clash with any name it could use."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASHES = ("_key", "_keep", "_i", "_h", "_pii", "_score", "_score_", "_id", "_hash", "_text", "KEY",
           "component_id", "score", "digest", "n", "part", "fp", "coverage", "item")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_any_extra_column_is_kept(spark, name, stage):
    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    clashing = plain.withColumns({c: F.lit(f"{c} stays") for c in CLASHES})
    want = sorted(map(str, stage(spark, plain, sf).collect()))
    got = stage(spark, clashing, sf)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == clashing.columns
        assert got.where(" OR ".join(f"`{c}` <> '{c} stays'" for c in CLASHES)).count() == 0
        got = got.select(*plain.columns)
    assert sorted(map(str, got.collect())) == want
