"""Shared storage: paths that mean the same to Spark and pyarrow, no local fallback on a cluster, deletion."""

import os

import pytest

from kegler.llm import storage


def test_paths_are_qualified(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda session: storage.qualified(session, str(tmp_path)))
    path = storage.work_path(spark, "x")
    assert path.startswith("file:") and str(tmp_path) in path
    assert storage.open_fs(path)[1].startswith(str(tmp_path))
    table = storage.materialize(spark.range(3), "y")
    assert table.count() == 3 and any(n.startswith("y-") for n in os.listdir(tmp_path / "kegler"))
    storage.discard(table)
    assert not any(n.startswith("y-") for n in os.listdir(tmp_path / "kegler"))
    scratch = storage.Scratch()
    kept = storage.materialize(scratch(spark.range(2), "a").selectExpr("id + 1 AS id"), "b")
    scratch.drop()
    assert not scratch and sorted(r[0] for r in kept.collect()) == [1, 2] and [n[:2] for n in os.listdir(tmp_path / "kegler")] == ["b-"]
    with pytest.raises(ValueError, match="no scheme"):
        storage.open_fs("/x/y")


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    Context.master = "local[4]"
    assert storage.shared_dir(Session()).startswith("file://")
