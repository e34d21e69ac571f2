import os

import pytest
from pyspark.sql import functions as F

from stackwise.llm import common


class FakeSession:
    """A session of a cluster without spark.checkpoint.dir."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return FakeSession.conf


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(FakeSession)


def test_scratch_tables_leave_nothing(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with common.scope() as own:
        first = common.materialise(spark.range(10))
        table = common.bucketed(spark.range(100).withColumn("v", F.col("id") * 2), "id")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert table.join(first, "id").agg(F.sum("v")).first()[0] == 90
    assert "Exchange hashpartitioning" not in table.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    folders = [f.removeprefix("file:").replace("///", "/") for f in own]
    assert len(folders) == 2 and all(os.listdir(f) for f in folders)
    common.remove(spark, own[:1])
    assert not os.path.exists(folders[0]) and os.path.exists(folders[1])
    common.cleanup(spark)
    assert not os.path.exists(folders[1])


def test_small_files_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = common.documents(spark, str(tmp_path))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and found.count() == 100
