from types import SimpleNamespace

import pytest

from tickloom.session import SETTINGS, work_dir


def test_work_dir_lies_in_the_shared_checkpoint_folder():
    conf = {"spark.checkpoint.dir": "hdfs://shared/checkpoints/"}
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)))
    first, second = work_dir(spark, "table"), work_dir(spark, "table")
    assert first.startswith("hdfs://shared/checkpoints/table-") and first != second


def test_work_dir_without_a_shared_folder(spark):
    first, second = work_dir(spark, "x"), work_dir(spark, "y")
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("yarn", "local-cluster[2,1,512]", "spark://host:7077"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            work_dir(spark, "table")


def test_shuffles_start_with_many_partitions():
    assert int(SETTINGS["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) >= 1000
