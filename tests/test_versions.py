from datetime import datetime

from pyspark.sql import functions as F

from tablekeep.operators import versions as ver
from tests.helpers import rows

SCHEMA = "id string, dataset_id string, version_number int, external_id string, parent_version_id string"


def _versions(spark):
    return spark.createDataFrame(
        [
            ("a1", "A", 1, "ga1", None),
            ("a2", "A", 2, "ga2", "a1"),
            ("a3", "A", 3, None, "a2"),
            ("b1", "B", 1, None, None),
            ("c1", "C", 5, "gc", None),
        ],
        SCHEMA,
    )


def test_latest(spark):
    versions = _versions(spark)
    assert rows(ver.latest_versions(versions), "dataset_id", "id") == [("A", "a3"), ("B", "b1"), ("C", "c1")]
    assert rows(ver.latest_versions(versions, published_only=True), "id") == [("a2",), ("c1",)]


def test_numbers_and_drafts(spark):
    versions = _versions(spark)
    pushes = spark.createDataFrame(
        [("A", "a2"), ("B", None), ("D", None), ("C", "a1"), ("E", "c1")],
        "dataset_id string, parent_version_id string",
    )
    numbered = ver.next_version_numbers(pushes, versions)
    # A goes on from its parent; C may not fall back to 2, it has a version 5.
    assert rows(numbered, "dataset_id", "next_version") == [("A", 3), ("B", 2), ("C", 6), ("D", 1), ("E", 6)]
    planned = ver.plan_drafts(numbered, versions)
    assert rows(planned, "dataset_id", "reuse_draft", "draft_id", "transfer_from") == [
        ("A", True, "a3", None),
        ("B", False, None, "b1"),
        ("C", False, None, None),
        ("D", False, None, None),
        ("E", False, None, None),
    ]


def test_process_versions(spark):
    versions = _versions(spark)
    pushes = spark.createDataFrame([("A", "a2"), ("B", None)], "id string, parent_version_id string")
    numbered = ver.next_process_version(pushes, ver.chain_positions(versions))
    assert rows(numbered, "id", "process_name") == [("A", "Reupload v3"), ("B", "Reupload v1")]
    assert rows(ver.process_records(numbered), "process_id") == [("a2_to_A",)]


def test_publish_and_edges(spark):
    versions = _versions(spark).withColumn("change_comment", F.lit(ver.DRAFT_COMMENT))
    change = spark.createDataFrame([("a3", "ga3", "done")], "id string, external_id string, change_comment string")
    after = ver.publish_versions(versions, change)
    assert rows(ver.version_edges(after)) == [("ga2", "ga1"), ("ga3", "ga2")]
    assert rows(after.filter("id != 'a3'")) == rows(versions.filter("id != 'a3'"))
    assert rows(ver.version_by_external_id(after, change), "id", "change_comment") == [("a3", "done")]


def test_qualified_names(spark):
    frame = spark.createDataFrame(
        [("p", "h", 2, datetime(2024, 1, 1)), (None, "h", None, None)],
        "project string, hash string, n int, at timestamp",
    )
    names = frame.select(ver.qualified_name("hash", "project", "n", "at").alias("q"))
    assert rows(names) == [("h",), ("p_h_v2_1704067200",)]
    assert rows(frame.select(ver.qualified_name("hash", "project", "n").alias("q"))) == [("h",), ("p_h_v2",)]


def test_missing_parents_are_dealt_out(spark):
    """Rows without a parent do not meet in the task of the null key."""
    from pyspark.sql import functions as F

    from tablekeep.functions.joins import lookup

    left = spark.range(4000).select(F.col("id").alias("dataset_id"), F.when(F.col("id") < 3, F.col("id")).alias("parent"))
    right = spark.range(2).select(F.col("id").alias("parent"), (F.col("id") * 10).alias("number"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(left, right, ["parent"], ["dataset_id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1000
        assert rows(joined.filter("number IS NOT NULL"), "dataset_id", "number") == [(0, 0), (1, 10)]
        assert joined.columns == ["parent", "dataset_id", "number"] and joined.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
