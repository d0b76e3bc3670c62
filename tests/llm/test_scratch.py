from types import SimpleNamespace

import pytest

from tapewright.llm import scratch


def test_a_cluster_needs_a_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(spark)


def test_tables_can_be_discarded(spark):
    table = scratch.materialize(spark.range(5).toDF("id"), "test")
    assert table.count() == 5
    path = scratch._paths[table].removeprefix("file:")
    import os

    assert os.path.isdir(path)
    scratch.discard(table, spark.range(1))
    assert not os.path.isdir(path)
