"""A stage or result is visible by its manifest, and nothing is left behind."""
import os

import pytest
from pyspark.sql import functions as F

from epicohort.sources import io as IO


def _folders(spark, version, name):
    return {n for n in os.listdir(os.path.join(IO.open_store(IO.stage_root(spark))[1], version, name)) if not n.startswith("_")}


def test_a_write_that_dies_leaves_the_old_stage(spark):
    version = IO.new_version()
    IO.write_stage(spark.range(10), "t", version)

    @F.udf("long")
    def dies(x):
        if x > 700:
            raise RuntimeError("the executor is gone")
        return x
    half = spark.range(1000).repartition(4).select(dies("id").alias("id"))
    with pytest.raises(Exception, match="the executor is gone"):
        IO.write_stage(half, "t", version)
    assert IO.read_stage(spark, "t", version).count() == 10
    # a writer killed before its publication: files without a manifest are no content either
    spark.range(99).write.parquet(os.path.join(IO.stage_root(spark), version, "t", "unfinished"))
    assert IO.read_stage(spark, "t", version).count() == 10 and len(_folders(spark, version, "t")) >= 2
    IO.write_stage(spark.range(20), "t", version)
    assert IO.read_stage(spark, "t", version).count() == 20
    assert len(_folders(spark, version, "t")) == IO.KEEP
    IO.drop_version(spark, version)
    with pytest.raises(FileNotFoundError):
        IO.read_stage(spark, "t", version)


def test_only_the_last_versions_stay(spark):
    version = IO.new_version()
    old = None
    for n in range(5):
        old = IO.read_stage(spark, "t", version) if n else None
        IO.write_stage(spark.range(n + 1), "t", version)
        assert IO.read_stage(spark, "t", version).count() == n + 1
        assert old is None or old.count() == n  # a reader of the version before can go on
    assert len(_folders(spark, version, "t")) == IO.KEEP
    IO.drop_version(spark, version)


def test_a_changed_file_is_noticed(spark):
    version = IO.new_version()
    path = IO.open_store(IO.write_stage(spark.range(10).repartition(2), "t", version))[1]
    part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    with open(os.path.join(path, part), "ab") as f:
        f.write(b"x")
    with pytest.raises(OSError, match="not those that were published"):
        IO.read_stage(spark, "t", version)
    IO.drop_version(spark, version)


def test_results_in_parallel_files(spark, tmp_path):
    df = spark.range(1000).repartition(5).withColumn("name", F.concat(F.lit("n,"), F.col("id").cast("string")))
    for fmt in ("csv", "parquet"):
        places = IO.write_results({"flow": df, "none": df.limit(0)}, str(tmp_path / fmt), fmt)
        files = [f for f in os.listdir(IO.published(places["flow"])) if f.startswith("part-")]
        assert len(files) == 5
        back = IO.read_results(spark, str(tmp_path / fmt), "flow", fmt)
        assert sorted((r["id"], r["name"]) for r in back.collect()) == [(i, f"n,{i}") for i in range(1000)]
        IO.write_results({"flow": df.limit(3)}, str(tmp_path / fmt), fmt)
        assert IO.read_results(spark, str(tmp_path / fmt), "flow", fmt).count() == 3


def test_no_folder_is_left_after_a_study(spark):
    from epicohort.plans.study import Study
    from epicohort.sources.fixtures import FixtureTables
    s = Study(FixtureTables(spark, "/root/testdata/sf0.001"), allow_short=True)
    assert s.exposed.count() > 0
    root = IO.open_store(IO.stage_root(spark))[1]
    assert s.version in os.listdir(root)
    s.close()
    assert s.version not in os.listdir(root)


def test_changed_inputs_begin_a_new_study(spark, tmp_path):
    import shutil

    from epicohort.plans.queries import study
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    first = study(spark, str(tmp_path))
    assert study(spark, str(tmp_path)) is first
    fewer = spark.read.parquet(f"{tmp_path}/customer.parquet").limit(5).toPandas()
    os.chmod(tmp_path / "customer.parquet", 0o644)
    fewer.to_parquet(tmp_path / "customer.parquet")
    assert study(spark, str(tmp_path)) is not first
