"""Pushes that follow each other on stored results."""

from pyspark.sql import functions as F

from tablekeep.operators import versions as ver
from tablekeep.plans.publish import KEYS, Catalogue, publish, store_push, stored_table, stored_tables
from tablekeep.sources import commits
from tests.helpers import rows

VERSIONS = "id string, dataset_id int, version_number int, external_id string, parent_version_id string, change_comment string"


def _push(spark, versions, lineage, columns, hashed):
    pending = spark.createDataFrame(
        [(1, 7, hashed, 10, "ann"), (2, 7, "h2" + hashed, 10, "ann")],
        "dataset_id int, project_id int, hash string, rows_count bigint, pushed_by string",
    ).withColumn("pushed_at", F.to_timestamp(F.lit("2024-01-01")))
    listed = spark.createDataFrame(
        [(d, c, i, "string") for d in (1, 2) for i, c in enumerate(("name", "city"))],
        "dataset_id int, column_name string, position int, type string",
    )
    checks = spark.createDataFrame(
        [],
        "dataset_id int, dag_run_id string, rule_type string, column_name string, status string, "
        "error_count bigint, ratio string, examples array<string>, check_type string, alert boolean",
    )
    signatures = spark.createDataFrame(
        [(7, d, "t", c, "string", "s") for d in (1, 2) for c in ("name", "city")],
        "project_id int, dataset_id int, name_base string, column_name string, data_type string, sample_hash string",
    )
    texts = spark.createDataFrame([], "version_id string, column_name string, description string")
    nodes = spark.createDataFrame([], "qualified_name string")
    return publish(pending, listed, checks, Catalogue(versions, signatures, columns, lineage, texts, nodes))


def test_two_pushes_on_the_stored_output(spark):
    versions = spark.createDataFrame(
        [("a1", 1, 1, "ga1", None, "x"), ("a2", 1, 2, None, "a1", ver.DRAFT_COMMENT)], VERSIONS
    )
    lineage = spark.createDataFrame(
        [], "id string, dataset_version_id string, logical_column_id string, column_name string, parent_column_id string, data_type string"
    )
    columns = spark.createDataFrame(
        [], "version_id string, column_name string, position int, logical_id string, external_id string"
    )
    first = _push(spark, versions, lineage, columns, "h")
    assert rows(first.drafts, "id", "change_comment") == [("a2", "Push depuis h")]
    # The second dataset goes on from the similar first one, so its number follows that of the parent.
    assert rows(first.versions, "dataset_id", "version_number") == [(2, 2)]
    assert rows(first.lineage.select("id").distinct().groupBy().count()) == [(4,)]
    assert rows(first.lineage, "data_type")[0] == ("string",)

    stored = ver.publish_versions(versions, first.drafts).unionByName(
        first.versions.withColumn("change_comment", F.lit("x"))
    )
    assert stored.count() == stored.select("id").distinct().count() == 3
    ids = first.lineage.select("dataset_version_id", "column_name", "logical_column_id")
    columns = ids.select(
        F.col("dataset_version_id").alias("version_id"),
        "column_name",
        F.when(F.col("column_name") == "name", 0).otherwise(1).alias("position"),
        F.col("logical_column_id").alias("logical_id"),
        F.md5(F.concat("dataset_version_id", "column_name")).alias("external_id"),
    )
    second = _push(spark, stored, first.lineage, columns, "k")
    assert rows(second.report, "dataset_id", "version_number", "parent_version_id")[0] == (1, 3, "a2")
    assert second.drafts.count() == 0
    assert rows(second.lineage.filter("parent_column_id is null")) == []


def test_a_killed_push_is_stored_whole(spark, tmp_path):
    """Every table of a push counts at once; running it again, killed or not, changes nothing."""
    root = str(tmp_path / "store")
    versions = spark.createDataFrame(
        [("a1", 1, 1, "ga1", None, "x"), ("a2", 1, 2, None, "a1", ver.DRAFT_COMMENT), ("b1", 2, 7, None, None, "x")], VERSIONS
    )
    commits.commit(spark, root, "before", {"versions": versions})
    lineage = spark.createDataFrame(
        [], "id string, dataset_version_id string, logical_column_id string, column_name string, parent_column_id string, data_type string"
    )
    columns = spark.createDataFrame([], "version_id string, column_name string, position int, logical_id string, external_id string")
    pushed = _push(spark, versions, lineage, columns, "h")
    tables = stored_tables(pushed)
    assert set(tables) == set(KEYS)
    # killed after some tables were staged
    commits.stage(root, "push", {n: tables[n] for n in ("versions", "edges", "results")})
    assert rows(stored_table(spark, root, "versions"), "id") == [("a1",), ("a2",), ("b1",)]
    assert store_push(spark, root, "push", pushed)
    first = {name: rows(stored_table(spark, root, name)) for name in KEYS if name not in ("signatures", "classes")}
    assert not store_push(spark, root, "push", pushed)
    assert {name: rows(stored_table(spark, root, name)) for name in first} == first
    assert {i: x for i, _, _, x, *_ in first["versions"]}["a2"] is not None and len(first["versions"]) == 4
    assert len(first["dataset_nodes"]) == 2 and stored_table(spark, root, "classes").count() == 2
    assert [r.classification for r in stored_table(spark, root, "classes").collect()] == ["RESTRICTED"] * 2
    assert stored_table(spark, root, "signatures").count() == 2
    chains = stored_table(spark, root, "chains")
    full = ver.chain_state(stored_table(spark, root, "versions"))
    assert rows(chains, "id", "depth", "latest_id") == rows(full.join(chains.select("id"), "id"), "id", "depth", "latest_id")


def test_tables_that_nobody_asks_for_are_not_made(spark, monkeypatch):
    versions = spark.createDataFrame([("a1", 1, 1, "ga1", None, "x")], VERSIONS)
    lineage = spark.createDataFrame([], "id string, dataset_version_id string, logical_column_id string, column_name string")
    columns = spark.createDataFrame([], "version_id string, column_name string, position int, logical_id string, external_id string")

    def made(*_, **__):
        raise AssertionError("column nodes were made")

    monkeypatch.setattr("tablekeep.plans.publish.graph.column_nodes", made)
    pushed = _push(spark, versions, lineage, columns, "h")
    assert pushed.versions.count() == 2 and pushed.report.count() == 2
