"""Publishing a batch of datasets: parents, versions, columns, graph, history.

One call handles all pending datasets together. Every step is a join over the
catalogue, so a batch costs the same number of jobs whether it holds one dataset
or a million.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.functions.joins import lookup, lookup_lists
from tablekeep.functions.lineage import cut_lineage
from tablekeep.functions.vocab import DATASET
from tablekeep.operators import classifications, graph, profile, results, similarity, versions
from tablekeep.operators import columns as col
from tablekeep.sources import commits
from tablekeep.sources.files import push_history_rows, signature_rows


@dataclass
class Catalogue:
    """What is known before a push.

    ``versions``: ``id, dataset_id, version_number, external_id, parent_version_id``;
    ``signatures``: long column signatures of all datasets, pending ones included;
    ``columns``: ``version_id, column_name, position, logical_id, external_id``;
    ``lineage``: ``id, dataset_version_id, logical_column_id, column_name``;
    ``descriptions``: ``version_id, column_name, description``, and who created them when
    (``created_by, created_at``), where that is known;
    ``nodes``: the ``qualified_name`` of the dataset nodes that exist, and their ``node_id``;
    ``runs``: ``id, dag_run_id`` of the known runs; results of other runs are not stored;
    ``users``: ``employee_id, department``, for the scope of security classes;
    ``chains``: the stored :func:`versions.chain_state` of ``versions``. Without it all chains
    are followed once; with it only those that the push touches.
    """

    versions: DataFrame
    signatures: DataFrame
    columns: DataFrame
    lineage: DataFrame
    descriptions: DataFrame
    nodes: DataFrame
    runs: DataFrame | None = None
    users: DataFrame | None = None
    chains: DataFrame | None = None


class Published:
    """Rows to append, and the report of the push, each made when it is first asked for.

    ``drafts`` are no new rows: the drafts in ``versions`` that the push published, with
    their external id and comment, for :func:`versions.publish_versions`. ``chains`` supersedes
    rows of the stored chain state by id, ``registry`` what is known of a dataset.
    """

    TABLES = (
        "versions", "drafts", "chains", "registry", "signatures", "dataset_nodes", "classes", "descriptions", "results",
        "column_nodes", "check_nodes", "lineage", "processes", "edges", "summary", "report", "history",
    )

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = makers

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise AttributeError(name)
        setattr(self, name, self._makers[name]())
        return self.__dict__[name]


def find_push_parents(pending: DataFrame, catalogue: Catalogue, chains: DataFrame) -> DataFrame:
    """Add ``parent_version_id`` and ``similarity_score`` to pending datasets.

    A dataset with a published version goes on from the newest version of its
    chain; any other from the best similar dataset of its project, whose score is
    kept (0 otherwise). ``chains`` are the chain positions of the known versions.
    """
    rows = catalogue.versions.filter(F.col("external_id").isNotNull()).select("id", "dataset_id", "version_number")
    published = versions.latest_versions(rows)
    newest = published.select("dataset_id", F.col("id").alias("own_version"))
    chain = chains.select(F.col("id").alias("own_version"), "latest_id")
    external = catalogue.versions.select(F.col("id").alias("latest_id"), "external_id")
    # A draft at the end of the chain is no parent: the published version is.
    end = F.when(F.col("external_id").isNotNull(), F.col("latest_id"))
    linked = (
        newest.join(chain, "own_version", "left")
        .join(external, "latest_id", "left")
        .select("dataset_id", F.coalesce(end, "own_version").alias("linked_version"))
    )
    joined = cut_lineage(pending.join(linked, "dataset_id", "left"))
    unlinked = joined.filter(F.col("linked_version").isNull())
    best = similarity.find_parents(catalogue.signatures, newest, wanted=unlinked).join(
        newest.select(F.col("dataset_id").alias("parent_id"), "own_version"), "parent_id"
    )
    found = best.select("dataset_id", F.col("own_version").alias("similar_version"), "score")
    return (
        joined.join(found, "dataset_id", "left")
        .withColumn("parent_version_id", F.coalesce("linked_version", "similar_version"))
        .withColumn("similarity_score", F.coalesce("score", F.lit(0.0)))
        .drop("linked_version", "similar_version", "score")
    )


def new_versions(pending: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Pending datasets with their new version: number, id, names and process.

    The id of a reused draft is kept; a fresh id and the external id are derived from
    the qualified name, so a push that is run again gives the same rows.
    """
    chains = catalogue.chains
    if chains is None:
        chains = versions.chain_state(catalogue.versions)
    placed = cut_lineage(find_push_parents(pending, catalogue, chains))
    numbered = versions.next_version_numbers(placed, catalogue.versions)
    numbered = versions.plan_drafts(numbered, catalogue.versions)
    numbered = versions.next_process_version(numbered, chains)
    name = versions.qualified_name("hash", "project_id", "next_version")
    parent = catalogue.versions.select(
        F.col("id").alias("parent_version_id"),
        F.col("external_id").alias("parent_external_id"),
        F.col("version_number").alias("parent_version_number"),
    )
    known = catalogue.nodes.select("qualified_name", F.lit(True).alias("_known")).distinct()
    found = lookup(
        numbered.withColumn("qualified_name", name)
        .withColumn("external_id", F.substring(F.sha2("qualified_name", 256), 1, 32))
        .withColumn("version_id", F.coalesce(F.col("draft_id").cast("string"), "external_id")),
        parent,
        ["parent_version_id"],
        ["dataset_id"],
    )
    parent_name = F.col("parent_external_id")
    if "node_id" in catalogue.nodes.columns:
        # Only the parents are named, not all versions: far fewer rows are shuffled.
        names = catalogue.nodes.select(F.col("node_id").alias("parent_external_id"), "qualified_name")
        found = lookup_lists(found, {"_names": names}, "parent_external_id", ["dataset_id"])
        parent_name = F.coalesce(F.array_min("_names.qualified_name"), parent_name)
    return (
        found.withColumn("parent_name", parent_name)
        .join(known, "qualified_name", "left")
        .withColumn("dataset_existed", F.coalesce("_known", F.lit(False)))
        .drop("_known", "_names")
    )


def _completed(pending: DataFrame) -> DataFrame:
    """``pending`` with the columns it may leave out: the file is named by its hash, the pusher owns it."""
    defaults = [
        ("file_path", lambda: F.col("hash").cast("string")),
        ("name", lambda: F.element_at(F.split("file_path", "/"), -1)),
        ("owner_employee_id", lambda: F.col("pushed_by")),
        ("description", lambda: F.lit(None).cast("string")),
        ("is_public", lambda: F.lit(False)),
        ("execution_time_ms", lambda: F.lit(None).cast("int")),
    ]
    for name, value in defaults:
        if name not in pending.columns:
            pending = pending.withColumn(name, value())
    return pending


def _moved_descriptions(pushed: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Texts of replaced drafts as rows of the new versions: creators stay, the pusher is the last to touch them."""
    kinds = {"created_by": "string", "created_at": "timestamp"}
    known = [c if c in descriptions.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    texts = descriptions.select(F.col("version_id").alias("transfer_from"), "column_name", "description", *known)
    return (
        pushed.filter(F.col("transfer_from").isNotNull())
        .select("version_id", "transfer_from", "pushed_by", "pushed_at")
        .join(texts, "transfer_from")
        .select(
            "version_id",
            "column_name",
            "description",
            *kinds,
            F.col("pushed_by").alias("updated_by"),
            F.col("pushed_at").alias("updated_at"),
        )
    )


def _security_classes(pushed: DataFrame, users: DataFrame | None) -> DataFrame:
    """The class of every dataset node with its attributes: PUBLIC if asked for, else RESTRICTED."""
    requests = pushed.select(
        F.lit(DATASET).alias("entity_type"),
        F.col("external_id").alias("entity_id"),
        F.when(F.col("is_public"), F.lit("PUBLIC")).otherwise(F.lit("RESTRICTED")).alias("classification"),
        F.col("pushed_by").alias("applied_by"),
        F.col("pushed_at").alias("applied_at"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    if users is None:
        users = requests.select(F.col("applied_by").alias("employee_id"), F.lit(None).cast("string").alias("department")).limit(0)
    return classifications.with_default_attributes(requests, users)


def publish(
    pending: DataFrame, columns: DataFrame, checks: DataFrame, catalogue: Catalogue
) -> Published:
    """Publish all pending datasets.

    ``pending``: ``dataset_id, project_id, hash, rows_count, pushed_by, pushed_at``, and if
    known ``file_path, name, owner_employee_id, description, is_public, execution_time_ms``;
    ``columns``: ``dataset_id, column_name, position, type``; ``checks``:
    ``dataset_id, dag_run_id`` and a standard check of the dataset's own runs.
    """
    pushed = cut_lineage(new_versions(_completed(pending), catalogue))

    # What several tables of the push read is written once, if one of them is asked for.
    @cache
    def matched() -> DataFrame:
        children = columns.join(
            pushed.select(
                "dataset_id",
                "version_id",
                "parent_version_id",
                "qualified_name",
                F.col("external_id").alias("dataset_node"),
            ),
            "dataset_id",
        ).withColumn("existing_id", F.lit(None).cast("string"))
        return cut_lineage(col.match_columns(children, catalogue.columns, parent_lineage=catalogue.lineage))

    @cache
    def nodes() -> DataFrame:
        # Descriptions come from the reused draft, or from the draft the version replaces.
        source = pushed.select(
            "version_id", F.coalesce("draft_id", "transfer_from").alias("source_version")
        )
        texts = source.join(
            catalogue.descriptions.withColumnRenamed("version_id", "source_version"), "source_version"
        ).drop("source_version")
        # Read by the edges, the checks and the caller: written once.
        return cut_lineage(
            graph.column_nodes(matched().withColumn("existing_description", F.lit(None).cast("string")), texts)
        )

    def lineage() -> DataFrame:
        return col.lineage_rows(matched())

    own_checks = checks.join(
        pushed.select("dataset_id", F.col("external_id").alias("version_node")), "dataset_id"
    )

    def check_nodes() -> DataFrame:
        known_columns = nodes().select(
            F.col("dataset_node").alias("version_node"),
            F.col("name").alias("column_name"),
            F.col("node_id").alias("column_node"),
        )
        return graph.check_nodes(own_checks, known_columns)

    def edges() -> DataFrame:
        links = pushed.filter(F.col("parent_external_id").isNotNull()).select(
            F.col("external_id").alias("child"), F.col("parent_external_id").alias("parent")
        )
        child_ids = nodes().select(
            "version_id", F.col("name").alias("column_name"), F.col("node_id").alias("external_id")
        ).join(pushed.select("version_id", "parent_version_id"), "version_id")
        return graph.graph_edges(
            nodes(),
            check_nodes(),
            links.filter("child != parent"),
            col.column_edges(child_ids, catalogue.columns),
        )

    summary = results.quality_summary(own_checks, key="version_node")

    @cache
    def report() -> DataFrame:
        counts = lineage().groupBy(F.col("dataset_version_id").alias("version_id")).agg(
            F.count(F.lit(1)).alias("columns_count"), F.count("parent_column_id").alias("propagated")
        )
        return (
            pushed.join(counts, "version_id", "left")
            .join(
                summary.select(
                    F.col("version_node").alias("external_id"),
                    F.col("total").alias("data_quality_checks"),
                    "summary_text",
                ),
                "external_id",
                "left",
            )
            .select(
                "dataset_id",
                "version_id",
                F.col("external_id").alias("dataset_node"),
                "dataset_existed",
                F.col("next_version").alias("version_number"),
                "parent_version_id",
                "parent_version_number",
                "process_name",
                F.coalesce("columns_count", F.lit(0)).alias("columns_count"),
                "rows_count",
                F.coalesce("propagated", F.lit(0)).alias("propagated"),
                "similarity_score",
                F.coalesce("data_quality_checks", F.lit(0)).alias("data_quality_checks"),
                F.col("summary_text").isNotNull().alias("quality_summary_added"),
                "pushed_by",
                "pushed_at",
                "execution_time_ms",
            )
        )

    version_rows = pushed.filter(F.col("draft_id").isNull()).select(
        F.col("version_id").alias("id"),
        "dataset_id",
        F.col("next_version").alias("version_number"),
        "external_id",
        F.col("parent_version_id").cast("string").alias("parent_version_id"),
        F.concat(F.lit(versions.PUSH_COMMENT), F.col("file_path")).alias("change_comment"),
    )
    # A reused draft keeps its place in the chain.
    place = catalogue.versions.select(F.col("id").alias("draft_id"), F.col("parent_version_id").alias("_own_parent"))
    drafts = pushed.filter(F.col("draft_id").isNotNull()).join(place, "draft_id").select(
        F.col("version_id").alias("id"),
        "dataset_id",
        F.col("next_version").alias("version_number"),
        "external_id",
        F.col("_own_parent").cast("string").alias("parent_version_id"),
        F.concat(F.lit(versions.PUSH_COMMENT), F.col("file_path")).alias("change_comment"),
    )
    # A version that goes on from itself under another id is no process.
    derived = pushed.filter(F.col("parent_external_id").isNull() | (F.col("parent_external_id") != F.col("external_id")))
    processes = versions.process_records(
        derived.withColumn("id", F.col("version_id"))
        .withColumn("created_by", F.col("pushed_by"))
        .withColumn("parent_version_id", F.col("parent_version_id").cast("string"))
    )

    def history() -> DataFrame:
        return push_history_rows(report().withColumn("error_message", F.lit(None).cast("string")))

    listed = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    names = columns.groupBy("dataset_id").agg(F.transform(listed, lambda c: c["column_name"]).alias("columns_list"))
    owned = pushed.select("dataset_id", "name", "hash", "file_path", "project_id", "owner_employee_id", "description")
    numbered = pushed.select("dataset_id", "external_id", F.col("next_version").alias("version_number"), "parent_name")
    dataset_nodes = graph.dataset_nodes(
        numbered,
        owned.join(names, "dataset_id", "left").withColumn("columns_list", F.coalesce("columns_list", F.array().cast("array<string>"))),
    )
    registry = pushed.select(
        "dataset_id",
        "external_id",
        F.col("pushed_by").alias("last_modified_by"),
        F.col("pushed_at").alias("last_modified_at"),
    )
    stamped = pushed.select("dataset_id", "rows_count", "pushed_at")
    signatures = profile.stored_signatures(catalogue.signatures.join(stamped.select("dataset_id"), "dataset_id", "left_semi"))
    signatures = signature_rows(signatures.join(stamped, "dataset_id"), "dataset_id", F.col("pushed_at"))
    if catalogue.runs is None:
        stored = own_checks.limit(0).withColumn("dataset_version_id", F.lit(None).cast("string"))
        runs = own_checks.select(F.col("dag_run_id").alias("id"), "dag_run_id").limit(0)
    else:
        stored = checks.join(pushed.select("dataset_id", F.col("version_id").alias("dataset_version_id")), "dataset_id")
        runs = catalogue.runs
    return Published(
        versions=lambda: version_rows,
        drafts=lambda: drafts,
        chains=lambda: _moved_chains(version_rows, catalogue),
        registry=lambda: registry,
        signatures=lambda: signatures,
        dataset_nodes=lambda: dataset_nodes,
        classes=lambda: _security_classes(pushed, catalogue.users),
        descriptions=lambda: _moved_descriptions(pushed, catalogue.descriptions),
        results=lambda: results.stored_results(stored, runs),
        column_nodes=nodes,
        check_nodes=check_nodes,
        lineage=lineage,
        processes=lambda: processes,
        edges=edges,
        summary=lambda: summary,
        report=report,
        history=history,
    )


def _moved_chains(version_rows: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Rows of the chain state that new versions add or change; a published draft was in its chain before."""
    state = versions.chain_state(catalogue.versions) if catalogue.chains is None else catalogue.chains
    return versions.extend_chain_state(state, version_rows)


# --- storing a push ----------------------------------------------------------------------------

#: Tables of a push in which a later row of the same key supersedes an earlier one.
KEYS = {
    "versions": ["id"],
    "chains": ["id"],
    "registry": ["dataset_id"],
    "signatures": ["id"],
    "dataset_nodes": ["node_id"],
    "classes": ["entity_id"],
    "descriptions": ["version_id", "column_name"],
    "results": [],
    "column_nodes": ["node_id"],
    "check_nodes": ["node_id"],
    "lineage": ["id"],
    "processes": ["process_id"],
    "edges": ["edge_type", "source", "target"],
    "history": [],
}


def stored_tables(published: Published, only: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables a push stores, or those named, by name; published drafts supersede their rows among the versions."""
    names = [n for n in KEYS if only is None or n in only]
    return {
        n: published.versions.unionByName(published.drafts) if n == "versions" else getattr(published, n) for n in names
    }


def store_push(
    spark: SparkSession, root: str, batch: str, published: Published, only: list[str] | None = None
) -> bool:
    """Commit all tables of a push, or those named, as one batch; False if the batch is stored already.

    Rows depend on the push alone, so an attempt that was killed is run again under the same name.
    """
    return commits.commit(spark, root, batch, stored_tables(published, only))


def stored_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What all committed pushes made of a table."""
    return commits.read(spark, root, name, KEYS[name])
