from pyspark.sql import functions as F

from flipside.operators.assemble import path_exists
from flipside.sources.stages import collect_runs, write_results, write_splits

SCHEMA = "method string, test_acc double"


def test_collect_runs_reads_one_table_of_every_run(spark, tmpdir_path):
    row = lambda m, a: spark.createDataFrame([(m, a)], SCHEMA)
    empty = collect_runs(spark, f"{tmpdir_path}/none", SCHEMA)
    assert empty.count() == 0
    write_results(row("none", 0.5), f"{tmpdir_path}/main/100pct/seed_1/main")
    write_results(row("single", 0.6), f"{tmpdir_path}/low_resource/10pct/seed_2/main")
    write_results(row("other", 0.7), f"{tmpdir_path}/main/100pct/seed_1/quality")
    got = collect_runs(spark, tmpdir_path, SCHEMA)
    assert got.columns == empty.columns and got.dtypes == empty.dtypes
    assert sorted(tuple(r) for r in got.collect()) == [("none", 0.5, "main", "100pct", 1), ("single", 0.6, "low_resource", "10pct", 2)]


def test_write_splits_one_folder_each(spark, tmpdir_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("test"))
    write_splits(df, f"{tmpdir_path}/splits")
    assert path_exists(spark, f"{tmpdir_path}/splits/split=train") and not path_exists(spark, f"{tmpdir_path}/splits/split=dev")
    assert spark.read.parquet(f"{tmpdir_path}/splits/split=test").count() == 3
