"""Reading, spreading and sending tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from upcurrent.sources import tables


def test_few_row_groups_are_spread_and_many_files_left_alone(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    one, many = str(tmp_path / "one.parquet"), str(tmp_path / "many.parquet")
    spark.range(1000).coalesce(1).write.parquet(one)
    spark.range(1000).repartition(cores).write.parquet(many)
    few = spark.read.parquet(one).where("id > 3").select("id")
    assert tables.row_groups(few, cores) == 1 and tables.spread(few).rdd.getNumPartitions() == cores
    assert tables.spread(few).count() == 996
    rest = spark.read.parquet(many)
    assert tables.row_groups(rest, cores) is None and "Exchange" not in tables.spread(rest)._jdf.queryExecution().toString()
    assert tables.row_groups(spark.range(3), cores) is None and tables.spread(spark.range(3)).count() == 3
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    assert tables.spread(spark.read.parquet(str(tmp_path / "none.parquet"))).count() == 0


def test_broadcast_has_a_bound(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(tables.broadcast_within(spark.range(5), 5)) and not hinted(tables.broadcast_within(spark.range(6), 5))
    assert hinted(tables.broadcast_within(spark.range(6), 5, spark.range(2)))


def session(folder, master):
    """What scratch asks a session for; the setting cannot be changed in a running one."""
    conf = SimpleNamespace(get=lambda k, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))


def test_scratch_is_the_shared_folder():
    shared = session("hdfs://shared/x/", "spark://cluster:7077")
    a, b = tables.scratch(shared, "n"), tables.scratch(shared, "n")
    assert a != b and a.startswith("hdfs://shared/x/upcurrent-n-")
    assert tables.scratch(session(None, "local[4]"), "n").startswith("file://")
    for master in ("spark://cluster:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            tables.scratch(session(None, master), "n")


def test_spread_keeps_rows_of_any_plan(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    t = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert sorted(r.id for r in tables.spread(t.unionByName(t).where(F.col("id") > 7)).collect()) == [8, 8, 9, 9]
