"""The governance graph: dataset, column and check nodes and the edges between them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.operators.descriptions import final_description
from tablekeep.operators.results import parse_ratio, quality_tag
from tablekeep.operators.versions import qualified_name

# Node and edge types.
DATASET_NODE = "DataSet"
COLUMN_NODE = "Column"
CHECK_NODE = "DataQualityCheck"
DATASET_COLUMNS = "dataset_columns"
DATASET_VERSIONING = "dataset_versioning"
COLUMN_VERSIONING = "column_versioning"
VERSION_CHECKS = "datasetversion_dqchecks"
COLUMN_CHECKS = "column_dqchecks"


def dataset_nodes(versions: DataFrame, datasets: DataFrame) -> DataFrame:
    """One node per published version.

    ``datasets`` holds ``dataset_id, name, hash, file_path, project_id,
    owner_employee_id, description, columns_list``; ``versions`` may carry the
    ``parent_name`` it was derived from.
    """
    joined = versions.filter(F.col("external_id").isNotNull()).join(datasets, "dataset_id")
    comment = F.coalesce(
        F.concat(F.lit("Version dérivée de "), F.col("parent_name")), F.lit("Version initiale")
    )
    default = F.concat(F.lit("Dataset importé depuis "), F.col("file_path"))
    return joined.select(
        F.col("external_id").alias("node_id"),
        F.lit(DATASET_NODE).alias("node_type"),
        qualified_name("hash", "project_id", "version_number").alias("qualified_name"),
        "name",
        F.coalesce(F.nullif("description", F.lit("")), default).alias("description"),
        comment.alias("version_comment"),
        F.size("columns_list").alias("columns_count"),
        "columns_list",
        F.col("owner_employee_id").alias("owner"),
        F.col("project_id").alias("project"),
    )


def column_nodes(matched: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One node per matched column, with its final description.

    ``matched`` holds ``version_id, dataset_node, qualified_name, column_name,
    position, type, logical_id`` and ``existing_description``.
    """
    given = descriptions.select(
        "version_id", "column_name", F.col("description").alias("given_description")
    )
    joined = matched.join(given, ["version_id", "column_name"], "left")
    name = F.concat_ws(".", "qualified_name", "column_name")
    return joined.select(
        F.sha2(name, 256).alias("node_id"),
        F.lit(COLUMN_NODE).alias("node_type"),
        name.alias("qualified_name"),
        F.col("column_name").alias("name"),
        "type",
        "position",
        "logical_id",
        final_description("given_description", "existing_description", "column_name").alias(
            "description"
        ),
        "dataset_node",
        "version_id",
    )


def check_nodes(checks: DataFrame, columns: DataFrame) -> DataFrame:
    """One node per check, linked to its column when that is known, else to the dataset.

    ``checks`` holds ``version_node, dag_run_id`` and a standard check; ``columns``
    maps ``version_node, column_name`` to ``column_node``.
    """
    known = columns.select("version_node", "column_name", "column_node")
    joined = checks.join(known, ["version_node", "column_name"], "left")
    named = F.coalesce(F.nullif("column_name", F.lit("")), F.lit("dataset"))
    unique = F.concat_ws(".", "version_node", named, "rule_type", "dag_run_id")
    examples = F.when(F.size("examples") > 0, F.to_json("examples"))
    return joined.select(
        F.sha2(unique, 256).alias("node_id"),
        F.lit(CHECK_NODE).alias("node_type"),
        unique.alias("qualified_name"),
        F.concat(F.col("rule_type"), F.lit(" - "), named).alias("name"),
        F.upper("rule_type").alias("check_type"),
        "column_name",
        "error_count",
        parse_ratio("ratio").alias("ratio"),
        "dag_run_id",
        examples.alias("examples"),
        quality_tag("status").alias("quality_tag"),
        "version_node",
        "column_node",
    )


def check_link_counts(nodes: DataFrame) -> DataFrame:
    """Per version: checks on a known column and checks on the dataset as a whole."""
    return nodes.groupBy("version_node").agg(
        F.count("column_node").alias("on_columns"),
        F.count_if(F.col("column_node").isNull()).alias("on_dataset"),
    )


def graph_edges(
    column_nodes: DataFrame,
    check_nodes: DataFrame,
    version_edges: DataFrame,
    column_edges: DataFrame,
) -> DataFrame:
    """All edges ``edge_type, source, target`` of the graph.

    Containers point to what they hold; versions and columns to what they came from.
    """

    def edges(kind: str, frame: DataFrame, source: str, target: str) -> DataFrame:
        return frame.select(
            F.lit(kind).alias("edge_type"), F.col(source).alias("source"), F.col(target).alias("target")
        )

    # A check has two edges at most, both from one reading of it.
    of_checks = check_nodes.select(
        F.inline(
            F.array(
                F.struct(F.lit(VERSION_CHECKS).alias("edge_type"), F.col("version_node").alias("source"), F.col("node_id").alias("target")),
                F.struct(F.lit(COLUMN_CHECKS).alias("edge_type"), F.col("column_node").alias("source"), F.col("node_id").alias("target")),
            )
        )
    ).filter((F.col("edge_type") == VERSION_CHECKS) | F.col("source").isNotNull())
    return (
        edges(DATASET_COLUMNS, column_nodes, "dataset_node", "node_id")
        .unionByName(edges(DATASET_VERSIONING, version_edges, "child", "parent"))
        .unionByName(edges(COLUMN_VERSIONING, column_edges, "child", "parent"))
        .unionByName(of_checks)
    )
