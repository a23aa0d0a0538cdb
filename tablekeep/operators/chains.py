"""Version chains: roots, depths and latest versions of a forest of parent links."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablekeep.functions.lineage import cut_lineage, forget, ship_package

#: Nodes of a group that are followed in one task at most; larger groups are followed in rounds.
GROUP_NODES = 100_000
#: Nodes that are followed together: whole groups.
CHUNK_NODES = 65_536


def follow_chains(nodes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``id, root_id, depth, latest_id, is_cyclic`` for ``id, parent_id`` links.

    ``depth`` counts the nodes from the root (1 for a root). ``latest_id`` is the
    deepest descendant; ties go to the largest ``order`` columns, then id. Nodes
    on or below a cycle are flagged and get no root, depth or latest. A parent that
    is not among the nodes counts as none.

    Works by pointer doubling: after round r every node knows its 2^r-th ancestor
    and the best descendant less than 2^r steps below, so a chain of n versions
    takes log2(n) rounds whatever its length. Every round is cut in the shared
    folder, in place of the one before. Nodes without any link are settled before and take part in none. A parent of very many children is one key of the offers, which are
    merged inside the tasks, and one row on the lookup side of the join.
    """
    order = order or []
    nodes = nodes.select("id", "parent_id", *order)
    ids = nodes.select(F.col("id").alias("parent_id"))
    linked = cut_lineage(nodes.filter("parent_id IS NOT NULL").select("id", "parent_id").join(ids, "parent_id", "left_semi"))
    # Only ends of links take part in the rounds, and ids that are no key.
    ends = linked.select(F.explode(F.array("id", "parent_id")).alias("id")).distinct().withColumn("_end", F.lit(True))
    rows = F.count(F.lit(1)).over(Window.partitionBy("id"))
    lone = F.col("id").isNotNull() & F.col("_end").isNull() & (F.col("_rows") == 1)
    placed = cut_lineage(
        nodes.withColumn("_rows", rows).join(ends, "id", "left").withColumn("_lone", lone).drop("_rows", "_end")
    )
    state = (
        placed.filter("NOT _lone")
        .select("id", *order)
        .join(linked, "id", "left")
        .select(
            "id",
            # The ancestor 2^r steps up; null once the root is fewer steps away.
            F.col("parent_id").alias("jump"),
            F.coalesce("parent_id", "id").alias("root"),
            F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
            F.struct(
                F.lit(0).cast("bigint").alias("below"), *order, F.col("id").alias("latest")
            ).alias("best"),
        )
    )
    state = cut_lineage(state)
    forget(linked)
    waiting = _waiting(state)
    while waiting:
        last, state = state, cut_lineage(_double(state, order))
        forget(last)
        left = _waiting(state)
        if left == waiting:
            # The nearest waiting node of a rooted chain always ends: what is left is cyclic.
            break
        waiting = left
    cyclic = F.col("jump").isNotNull()
    alone = placed.filter("_lone").select(
        "id",
        F.col("id").alias("root_id"),
        F.lit(1).cast("bigint").alias("depth"),
        F.col("id").alias("latest_id"),
        F.lit(False).alias("is_cyclic"),
    )
    followed = state.select(
        "id",
        F.when(~cyclic, F.col("root")).alias("root_id"),
        F.when(~cyclic, F.col("steps") + 1).alias("depth"),
        F.when(~cyclic, F.col("best.latest")).alias("latest_id"),
        cyclic.alias("is_cyclic"),
    )
    return followed.unionByName(alone)


def follow_grouped(nodes: DataFrame, group: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`follow_chains` where most links stay inside a ``group``, as those of versions do inside a dataset.

    Gives the rows ``id, parent_id``, the ``order`` columns and what :func:`follow_chains` adds to them, of all groups
    that can be followed alone; and the links of the others, for :func:`follow_chains`. A group goes to the others if
    one of its links leaves or enters it, if one of its ids is no key, or if it is too large for a task. So no link
    between the two parts is ever cut, whatever the groups are; where all of them are closed, no round is needed.
    """
    order = order or []
    ship_package(nodes.sparkSession)
    nodes = nodes.select("id", "parent_id", *order, F.col(group).alias("_group"))
    large = nodes.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_NODES).select("_group")
    large = cut_lineage(large.filter("_group IS NOT NULL"))
    dealt = nodes.filter("_group IS NOT NULL").join(large, "_group", "left_anti").repartition("_group")
    kind = nodes.schema["id"].dataType
    added = T.StructType(
        [
            T.StructField("root_id", kind),
            T.StructField("depth", T.LongType()),
            T.StructField("latest_id", kind),
            T.StructField("is_cyclic", T.BooleanType()),
            T.StructField("_leaves", T.BooleanType()),
        ]
    )
    schema = T.StructType([*dealt.schema.fields, *added.fields])
    # The ends of foreign links and the ids of no key are looked up among these rows: written once.
    followed = cut_lineage(dealt.sortWithinPartitions("_group").mapInArrow(_follow_groups(order), schema))
    rest = nodes.filter("_group IS NULL").unionByName(nodes.join(large, "_group", "left_semi"))

    none = F.lit(0)
    held = followed.select("id", F.lit(1).alias("own"), none.alias("asked"))
    asked = followed.filter("_leaves").select(F.col("parent_id").alias("id"), none.alias("own"), F.lit(1).alias("asked"))
    others = rest.select("id", F.lit(1).alias("own"), F.lit(1).alias("asked"))
    askers = rest.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), none.alias("own"), F.lit(1).alias("asked"))
    ends = held.unionByName(asked).unionByName(others).unionByName(askers).groupBy("id").agg(F.sum("own").alias("own"), F.max("asked").alias("asked"))
    met = ends.filter("own > 1 OR own > 0 AND asked > 0").select("id")
    met = cut_lineage(met.filter("id IS NOT NULL"))
    opened = (
        followed.join(met, "id", "left_semi")
        .select("_group")
        .union(followed.filter("_leaves").join(met.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("_group"))
        .union(followed.filter("id IS NULL").select("_group"))
        .distinct()
    )
    opened = cut_lineage(opened)
    links = ["id", "parent_id", *order]
    places = [*links, "root_id", "depth", "latest_id", "is_cyclic"]
    if opened.isEmpty():
        return followed.select(*places), rest.select(*links)
    closed = cut_lineage(followed.join(opened, "_group", "left_anti").select(*places))
    return closed, rest.select(*links).unionByName(followed.join(opened, "_group", "left_semi").select(*links))


def _follow_groups(order: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Follows the links inside every group of rows sorted by ``_group``, some whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < CHUNK_NODES:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks()
            codes = rows["_group"].combine_chunks().dictionary_encode().indices.to_numpy()
            # the last group may go on in the next batch
            whole = int(np.searchsorted(codes, codes[-1]))
            if whole:
                yield from _followed(rows.slice(0, whole), order).to_batches()
            waiting = rows.slice(whole).to_batches()
        if waiting:
            rows = pa.Table.from_batches(waiting)
            if rows.num_rows:
                yield from _followed(rows, order).to_batches()

    return run


def _followed(rows: pa.Table, order: list[str]) -> pa.Table:
    """The rows with their places, by the rounds of :func:`follow_chains` over arrays."""
    rows = rows.combine_chunks()
    ids, parents = (rows[c].combine_chunks() for c in ("id", "parent_id"))
    group = rows["_group"].combine_chunks().dictionary_encode().indices.to_numpy()
    n = len(ids)
    at = pc.fill_null(pc.index_in(parents, value_set=ids, skip_nulls=True), -1).to_numpy().astype(np.int64)
    parent = np.where((at >= 0) & (group[at] == group), at, -1)
    leaves = (parent < 0) & parents.is_valid().to_numpy(zero_copy_only=False)
    keys = [(c, "ascending") for c in [*order, "id"]]
    ranked = pc.sort_indices(rows, sort_keys=keys, null_placement="at_start").to_numpy().astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[ranked] = np.arange(n)
    jump, root = parent, np.where(parent < 0, np.arange(n), parent)
    steps, best = (parent >= 0).astype(np.int64), rank
    waiting = n + 1
    while True:
        active = np.flatnonzero(jump >= 0)
        # The nearest waiting node of a rooted chain always ends: what is left is cyclic.
        if not len(active) or len(active) == waiting:
            break
        waiting, to = len(active), jump[active]
        offered = best.copy()
        np.maximum.at(offered, to, best[active] + steps[active] * n)
        best, further, top = offered, steps.copy(), root.copy()
        further[active] += steps[to]
        top[active] = root[to]
        moved = jump.copy()
        moved[active] = jump[to]
        jump, root, steps = moved, top, further
    cyclic = jump >= 0
    mask = pa.array(cyclic)
    places = {
        "root_id": pc.if_else(mask, None, ids.take(pa.array(root))),
        "depth": pa.array(steps + 1, mask=cyclic),
        "latest_id": pc.if_else(mask, None, ids.take(pa.array(ranked[best % n]))),
        "is_cyclic": mask,
        "_leaves": pa.array(leaves),
    }
    for name, values in places.items():
        rows = rows.append_column(name, values)
    return rows


def extend_chains(state: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows of a stored chain state that a batch of nodes adds or changes.

    ``state`` is what :func:`follow_chains` gave for the nodes so far, with their ``parent_id`` and the ``order``
    columns; ``batch`` holds ``id, parent_id`` and the same columns, and replaces nodes of the state that it repeats.
    The result has the columns of ``state`` and supersedes its rows by id; all other rows stay as they are.

    Only the trees that the batch touches are followed again: those of its parents, of nodes that waited for a parent
    it brings, and of nodes it replaces. They are found by their roots, so no other chain is read into a round. Nodes
    on cycles have no root and are few; they are always followed.
    """
    order = order or []
    links = ["id", "parent_id", *order]
    batch = cut_lineage(batch.select(*links))
    ids = batch.select("id")
    frontier = ids.union(batch.filter("parent_id IS NOT NULL").select("parent_id")).distinct()
    touched = (
        state.join(frontier, "id", "left_semi")
        .select("root_id")
        # a root whose parent was missing so far
        .union(state.join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("root_id"))
        .filter("root_id IS NOT NULL")
        .distinct()
    )
    rows = state.filter(~F.col("is_cyclic")).join(touched, "root_id", "left_semi").select(*links)
    rows = rows.union(state.filter("is_cyclic").select(*links)).join(ids, "id", "left_anti")
    nodes = cut_lineage(rows.union(batch))
    followed = follow_chains(nodes, order)
    return nodes.join(followed, "id").select(*state.columns)


def _waiting(state: DataFrame) -> int:
    return state.filter(F.col("jump").isNotNull()).count()


def _double(state: DataFrame, order: list[str]) -> DataFrame:
    """One round: take over the best offers from below, then jump twice as far up."""
    offer = F.struct(
        (F.col("best.below") + F.col("steps")).alias("below"),
        *[F.col(f"best.{c}").alias(c) for c in order],
        F.col("best.latest").alias("latest"),
    )
    offers = (
        state.filter(F.col("jump").isNotNull())
        .groupBy(F.col("jump").alias("id"))
        .agg(F.max(offer).alias("offer"))
    )
    above = state.select(
        F.col("id").alias("target"),
        F.col("jump").alias("next_jump"),
        F.col("root").alias("next_root"),
        F.col("steps").alias("next_steps"),
    )
    active = F.col("jump").isNotNull()
    # Finished nodes look up themselves: as null keys they would all meet in one task.
    return (
        state.join(offers, "id", "left")
        .withColumn("target", F.coalesce("jump", "id"))
        .join(above, "target")
        .select(
            "id",
            F.when(active, F.col("next_jump")).alias("jump"),
            F.when(active, F.col("next_root")).otherwise(F.col("root")).alias("root"),
            F.when(active, F.col("steps") + F.col("next_steps"))
            .otherwise(F.col("steps"))
            .alias("steps"),
            F.greatest("best", F.coalesce("offer", "best")).alias("best"),
        )
    )
