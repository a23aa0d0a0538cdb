"""Dataset versions: numbers, drafts, publishing, process and version edges.

Versions are rows ``id, dataset_id, version_number, external_id, parent_version_id``;
a version without external id is a draft.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.functions.joins import lookup
from tablekeep.functions.lineage import cut_lineage
from tablekeep.operators.chains import extend_chains, follow_chains, follow_grouped

DRAFT_COMMENT = "Version temporaire (en attente de push)"
PUSH_COMMENT = "Push depuis "


def latest_versions(versions: DataFrame, published_only: bool = False) -> DataFrame:
    """The version with the highest number of each dataset (ties by id)."""
    if published_only:
        versions = versions.filter(F.col("external_id").isNotNull())
    fields = [c for c in versions.columns if c != "dataset_id"]
    newest = F.max_by(F.struct(*fields), F.struct("version_number", "id"))
    return versions.groupBy("dataset_id").agg(newest.alias("v")).select("dataset_id", "v.*")


def version_by_external_id(versions: DataFrame, external_ids: DataFrame) -> DataFrame:
    """Versions found by the ``external_id`` they were published under."""
    return versions.join(external_ids.select("external_id").distinct(), "external_id", "left_semi")


def chain_positions(versions: DataFrame) -> DataFrame:
    """Root, depth and latest version of every version along the parent links."""
    places = ["id", "root_id", "depth", "latest_id", "is_cyclic"]
    if "dataset_id" not in versions.columns:
        return follow_chains(_links(versions), order=["version_number"])
    closed, others = follow_grouped(_links(versions, "dataset_id"), "dataset_id", ["version_number"])
    closed = closed.select(*places)
    return closed if others.isEmpty() else closed.unionByName(follow_chains(others, ["version_number"]))


def _links(versions: DataFrame, *also: str) -> DataFrame:
    return versions.select("id", F.col("parent_version_id").alias("parent_id"), "version_number", *also)


def chain_state(versions: DataFrame) -> DataFrame:
    """:func:`chain_positions` with the links they come from, to be stored and moved on by :func:`extend_chain_state`.

    The rows are written once, by :func:`cut_lineage`.
    """
    if "dataset_id" not in versions.columns:
        links = _links(versions)
        return cut_lineage(links.join(follow_chains(links, order=["version_number"]), "id"))
    # Versions of a dataset mostly go on from each other.
    closed, others = follow_grouped(_links(versions, "dataset_id"), "dataset_id", ["version_number"])
    if others.isEmpty():
        return closed
    followed = others.join(follow_chains(others, ["version_number"]), "id")
    return closed.unionByName(cut_lineage(followed.select(*closed.columns)))


def extend_chain_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of :func:`chain_state` that a batch of versions adds or changes."""
    return extend_chains(state, _links(batch), order=["version_number"])


def _spread(rows: DataFrame) -> list[str]:
    """Columns by which rows without a parent are dealt out."""
    return [c for c in ("dataset_id", "id") if c in rows.columns] or [c for c in rows.columns if c != "parent_version_id"]


def next_process_version(pushes: DataFrame, chain: DataFrame) -> DataFrame:
    """Add ``process_version`` and ``process_name`` to ``parent_version_id`` of new pushes.

    The version is the length of the parent's chain plus one, 1 without a parent.
    """
    depth = chain.select(F.col("id").alias("parent_version_id"), F.col("depth").alias("_depth"))
    version = F.coalesce("_depth", F.lit(0)) + 1
    return (
        lookup(pushes, depth, ["parent_version_id"], _spread(pushes))
        .withColumn("process_version", version)
        .withColumn("process_name", F.concat(F.lit("Reupload v"), version.cast("string")))
        .drop("_depth")
    )


def next_version_numbers(pushes: DataFrame, versions: DataFrame) -> DataFrame:
    """Add ``next_version`` to the rows ``dataset_id, parent_version_id``.

    One more than the parent's number, but never a number the dataset already has;
    without a parent one more than the dataset's own highest, else 1. A draft of
    exactly the parent's number plus one is reused, so it does not count.
    """
    parents = versions.select(
        F.col("id").alias("parent_version_id"), F.col("version_number").alias("_parent_number")
    )
    published = F.col("external_id").isNotNull()
    own = versions.groupBy("dataset_id").agg(
        F.max("version_number").alias("_own"),
        F.max(F.when(published, F.col("version_number"))).alias("_own_published"),
    )
    by_parent = F.when(
        F.col("_parent_number").isNotNull(),
        F.greatest(F.col("_parent_number") + 1, F.coalesce("_own_published", F.lit(0)) + 1),
    )
    by_own = F.coalesce("_own", F.lit(0)) + 1
    return (
        lookup(pushes, parents, ["parent_version_id"], ["dataset_id"])
        .join(own, "dataset_id", "left")
        .withColumn("next_version", F.coalesce(by_parent, by_own))
        .drop("_parent_number", "_own", "_own_published")
    )


def plan_drafts(numbered: DataFrame, versions: DataFrame) -> DataFrame:
    """Whether each push reuses a draft of its dataset or needs a new version.

    Adds ``draft_id`` (the draft with the right number), ``reuse_draft`` and, when
    none fits, ``transfer_from``: the dataset's first draft, whose descriptions move
    on to the new version.
    """
    drafts = versions.filter(F.col("external_id").isNull())
    fitting = drafts.select(
        "dataset_id", F.col("version_number").alias("next_version"), F.col("id").alias("draft_id")
    )
    first = drafts.groupBy("dataset_id").agg(
        F.min_by("id", F.struct("version_number", "id")).alias("_first")
    )
    return (
        numbered.join(fitting, ["dataset_id", "next_version"], "left")
        .join(first, "dataset_id", "left")
        .withColumn("reuse_draft", F.col("draft_id").isNotNull())
        .withColumn("transfer_from", F.when(F.col("draft_id").isNull(), F.col("_first")))
        .drop("_first")
    )


def publish_versions(versions: DataFrame, published: DataFrame) -> DataFrame:
    """New snapshot of ``versions`` with the external ids and comments of ``published``."""
    change = published.select(
        "id", F.col("external_id").alias("_external"), F.col("change_comment").alias("_comment")
    )
    return (
        versions.join(change, "id", "left")
        .withColumn("external_id", F.coalesce("_external", "external_id"))
        .withColumn("change_comment", F.coalesce("_comment", "change_comment"))
        .select(*versions.columns)
    )


def version_edges(versions: DataFrame) -> DataFrame:
    """Published child → published parent; missing ends and self links are dropped."""
    parents = versions.select(
        F.col("id").alias("parent_version_id"), F.col("external_id").alias("parent_external")
    )
    return (
        versions.join(parents, "parent_version_id")
        .filter("external_id IS NOT NULL AND parent_external IS NOT NULL")
        .filter("external_id != parent_external")
        .select(F.col("external_id").alias("child"), F.col("parent_external").alias("parent"))
    )


def process_records(numbered: DataFrame, operation: str = "TRANSFORMATION") -> DataFrame:
    """Process edges of versions that came from a parent (rows with ``process_name``).

    ``created_by``, ``execution_time_ms`` and ``parent_name`` are taken over where they are given; the name of the
    parent stands in ``metadata``.
    """

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in numbered.columns else F.lit(None).cast(kind)

    return numbered.filter(F.col("parent_version_id").isNotNull()).select(
        F.concat_ws("_to_", "parent_version_id", F.col("id").cast("string")).alias("process_id"),
        "process_name",
        F.lit(operation).alias("operation_type"),
        F.col("parent_version_id").alias("input_version_id"),
        F.col("id").alias("output_version_id"),
        given("created_by", "string").alias("created_by"),
        given("execution_time_ms", "int").alias("execution_time_ms"),
        F.lit("SUCCESS").alias("status"),
        F.to_json(F.struct(given("parent_name", "string").alias("parent_qn"))).alias("metadata"),
    )


def qualified_name(
    content_hash: Column | str,
    project: Column | str | None = None,
    version_number: Column | str | None = None,
    pushed_at: Column | str | None = None,
) -> Column:
    """``[project_]hash[_vN][_epoch seconds]``; a null part is left out."""

    def part(value: Column | str | None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        return (F.col(value) if isinstance(value, str) else value).cast("string")

    stamp = F.lit(None) if pushed_at is None else F.unix_timestamp(pushed_at)
    return F.concat_ws(
        "_",
        part(project),
        part(content_hash),
        F.concat(F.lit("v"), part(version_number)),
        stamp.cast("string"),
    )


def already_registered(pushes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pushes whose ``qualified_name`` exists already."""
    return pushes.join(nodes.select("qualified_name").distinct(), "qualified_name", "left_semi")
