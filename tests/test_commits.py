"""Batches of tables that count all at once or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from tablekeep.sources import commits
from tests.helpers import rows


def _frames(spark, n, tag):
    versions = spark.createDataFrame([(i, tag) for i in range(n)], "id int, tag string")
    return {"versions": versions, "edges": versions.select(F.col("id").alias("source"))}


def test_readers_see_whole_batches_only(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(KeyError):
        commits.read(spark, root, "versions")
    assert commits.commit(spark, root, "a", _frames(spark, 3, "a"))
    commits.stage(root, "killed", _frames(spark, 9, "killed"))
    assert rows(commits.read(spark, root, "versions")) == [(0, "a"), (1, "a"), (2, "a")]
    # a batch that was killed after staging is run again under its name
    assert commits.commit(spark, root, "killed", _frames(spark, 2, "b"))
    assert not commits.commit(spark, root, "killed", _frames(spark, 7, "c"))
    assert rows(commits.read(spark, root, "versions", ["id"])) == [(0, "b"), (1, "b"), (2, "a")]
    assert commits.read(spark, root, "edges").count() == 5
    assert [c.batch for c in commits.commits(spark, root)] == ["a", "killed"]


def test_manifest_is_taken_by_one_writer(spark, tmp_path):
    root = str(tmp_path / "store")
    assert commits.commit(spark, root, "a", _frames(spark, 1, "a"))
    name = f"{root}/commits/{1:0{commits.DIGITS}d}.json"
    before = json.loads(open(name).read())
    assert not commits._create(spark, name, "{}") and json.loads(open(name).read()) == before
    # another writer took the next place meanwhile
    other = {"sequence": 2, "batch": "other", "tables": {}, "base": False}
    assert commits._create(spark, f"{root}/commits/{2:0{commits.DIGITS}d}.json", json.dumps(other))
    assert commits.commit(spark, root, "b/../odd name", _frames(spark, 1, "b"))
    assert [(c.sequence, c.batch) for c in commits.commits(spark, root)] == [(1, "a"), (2, "other"), (3, "b/../odd name")]


def test_base_holds_what_counted(spark, tmp_path):
    root = str(tmp_path / "store")
    for tag in "abc":
        commits.commit(spark, root, tag, _frames(spark, 2, tag))
    before = rows(commits.read(spark, root, "versions", ["id"]))
    assert commits.compact(spark, root, {"versions": ["id"]}) and not commits.compact(spark, root, {"versions": ["id"]})
    assert len(commits.commits(spark, root)) == 1
    assert rows(commits.read(spark, root, "versions", ["id"])) == before == rows(commits.read(spark, root, "versions"))
    assert commits.read(spark, root, "edges").count() == 6
    assert not commits.commit(spark, root, "b", _frames(spark, 5, "again"))
    assert commits.commit(spark, root, "d", _frames(spark, 1, "d"))
    assert rows(commits.read(spark, root, "versions", ["id"])) == [(0, "d"), (1, "c")]


def test_empty_tables_keep_their_schema(spark, tmp_path):
    root = str(tmp_path / "store")
    commits.commit(spark, root, "a", {"versions": _frames(spark, 0, "a")["versions"]})
    found = commits.read(spark, root, "versions", ["id"])
    assert found.columns == ["id", "tag"] and found.count() == 0
