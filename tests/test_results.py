"""Window results as one table: every batch once, whatever fails in between."""

from pyspark.sql import functions as F

from rankflow.functions.scalars import quantile_columns
from rankflow.sources import files, schemas
from rankflow.sources.results import ResultTable, result_lines


def lines(spark, *windows):
    wide = spark.createDataFrame([(w, 5 + w) for w in windows], "window_id bigint, n bigint").select(
        "*", *[F.lit(1.5).alias(c) for c in quantile_columns()])
    return result_lines(wide, "exact")


def stored(spark, table):
    return sorted(r.window_id for r in table.read(spark, schemas.EXACT_RESULTS).collect())


def test_a_batch_that_fails_before_its_record_leaves_one_line_per_window(spark, fresh_dir):
    table = ResultTable(fresh_dir)
    assert stored(spark, table) == [] and table.folders(spark) == []
    table.append(lines(spark, 1, 2), 0)
    table._write(lines(spark, 3), 1)  # written, and then the driver is lost
    assert stored(spark, table) == [1, 2]
    table.append(lines(spark, 3), 1)
    table.append(lines(spark, 3), 1)  # lost before the stream noted the batch as done
    assert stored(spark, table) == [1, 2, 3]
    scanned = files.scan_results(spark, table.folders(spark), "exact").orderBy("window_id").collect()
    assert [(r.window_id, r.pct_50, r.win_size) for r in scanned] == [(1, 1.5, 6), (2, 1.5, 7), (3, 1.5, 8)]


def test_compaction_stands_for_its_batches(spark, fresh_dir):
    table = ResultTable(fresh_dir)
    for batch in range(4):
        table.append(lines(spark, batch), batch)
    table.compact(spark, schemas.EXACT_RESULTS)
    assert len(table.folders(spark)) == 1 and stored(spark, table) == [0, 1, 2, 3]
    table.append(lines(spark, 4), 4)
    assert stored(spark, table) == [0, 1, 2, 3, 4]
    table.compact(spark, schemas.EXACT_RESULTS)
    table.compact(spark, schemas.EXACT_RESULTS)
    assert len(table.folders(spark)) == 1 and stored(spark, table) == [0, 1, 2, 3, 4]
    table.append(lines(spark, 4), 4)  # the last batch runs again
    assert stored(spark, table) == [0, 1, 2, 3, 4]
    ResultTable(f"{fresh_dir}/x").compact(spark, schemas.EXACT_RESULTS)


def test_lines_of_a_sketch_have_the_columns_of_its_file(spark):
    wide = spark.range(1).select(F.lit(3).alias("window_id"), F.lit(9).alias("n"),
                                 *[F.lit(2.0).alias(c) for c in quantile_columns()])
    for name in ("dds", "kll"):
        assert result_lines(wide, name).columns == [f.name for f in schemas.sketch_results(name)]
