from types import SimpleNamespace

import pytest

from fieldloom.session import shared_folder, stage


def fake(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_named_folder_wins():
    assert shared_folder(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError):
        shared_folder(fake("yarn"))


def test_local_mode_keeps_one_temporary_folder():
    assert shared_folder(fake("local[2]")) == shared_folder(fake("local[2]"))


def test_staged_tables_prune_columns(spark):
    df = stage(spark.range(10).selectExpr("id", "id * 2 as twice"), "test")
    text = df.filter("id > 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in text and "GreaterThan(id,3)" in text
