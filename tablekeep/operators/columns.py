"""Column matching between versions and column lineage.

Children are rows ``version_id, parent_version_id, qualified_name, column_name,
position, existing_id``; parents are rows ``version_id, column_name, position,
logical_id``. Positions count from 0.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekeep.functions.joins import lookup, lookup_lists
from tablekeep.functions.lineage import cut_lineage, forget
from tablekeep.functions.textsim import lcs_length
from tablekeep.functions.vocab import COLUMN_NAME_PERCENT
from tablekeep.operators.chains import follow_chains

# Ids still to be replaced by real ones carry this prefix.
TEMPORARY_PREFIX = "-col-"
STRATEGIES = ["existing", "exact_name", "position", "fuzzy", "new"]


def new_logical_id(qualified_name: Column | str, column_name: Column | str) -> Column:
    """First 32 hex digits of the SHA-256 of ``qualified_name.column_name``."""
    return F.substring(F.sha2(F.concat_ws(".", qualified_name, column_name), 256), 1, 32)


def _fitting(length: Column) -> tuple[Column, Column]:
    """Least and greatest length of a name that may be close to one of this length."""
    percent = COLUMN_NAME_PERCENT
    # 2 * min / (min + max) >= p  <=>  max <= min * (2 - p) / p.
    return F.ceil(length * percent / (200.0 - percent)), F.floor(length * (200.0 - percent) / percent)


def _may_be_close(name: Column, other: Column) -> Column:
    """Whether the characters of one name that occur in the other at all, which bound the common ones, are enough."""

    def occurring(text: Column, among: Column) -> Column:
        return F.length(text) - F.length(F.call_function("translate", text, among, F.lit("")))

    shared = F.least(occurring(name, other), occurring(other, name))
    return shared * 200 >= (F.length(name) + F.length(other)) * COLUMN_NAME_PERCENT


def close_names(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``parent_version_id, name, logical_id, position, lcs, total`` of the parent columns that may be close by name.

    Close are those with ``lcs * 200 >= total * COLUMN_NAME_PERCENT``. Compares lower-cased names once per distinct (parent version, name). A ratio of
    82 % bounds the length of the other name, so each name is joined only to parent
    columns of a fitting length.
    """
    shortest, longest = _fitting(F.length("name"))
    names = (
        children.select("parent_version_id", F.lower("column_name").alias("name"))
        .distinct()
        .filter((F.col("name") != "") & F.col("parent_version_id").isNotNull())
        .withColumn("parent_length", F.explode(F.sequence(shortest, longest)))
    )
    targets = parents.filter(F.coalesce("logical_id", F.lit("")) != "").select(
        F.col("version_id").alias("parent_version_id"),
        F.lower("column_name").alias("parent_name"),
        F.length("column_name").cast("bigint").alias("parent_length"),
        "logical_id",
        "position",
    )
    pairs = names.join(targets, ["parent_version_id", "parent_length"])
    total = F.length("name") + F.length("parent_name")
    possible = pairs.filter(_may_be_close(F.col("name"), F.col("parent_name")))
    return possible.select(
        "parent_version_id", "name", "logical_id", "position", lcs_length(F.col("name"), F.col("parent_name")).alias("lcs"), total.alias("total")
    )


def _close() -> Column:
    return F.col("lcs") * 200 >= F.col("total") * COLUMN_NAME_PERCENT


def fuzzy_matches(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``parent_version_id, name, fuzzy_id, fuzzy_ratio``: the closest parent column name; ties go to the first column."""
    # Accepted inside the aggregate: a filter on lcs would be pushed below and compute it twice.
    ratio = 2.0 * F.col("lcs") / F.col("total")
    best = F.max_by(
        F.struct(F.col("logical_id").alias("fuzzy_id"), ratio.alias("fuzzy_ratio")),
        F.when(_close(), F.struct(ratio, -F.col("position"), "logical_id")),
    )
    return (
        close_names(children, parents)
        .groupBy("parent_version_id", "name")
        .agg(best.alias("m"))
        .select("parent_version_id", "name", "m.*")
        .filter(F.col("fuzzy_id").isNotNull())
    )


def _closest(above: str, name: Column) -> Column:
    """Logical id of the closest by name of the listed parent columns, as :func:`fuzzy_matches` finds it."""
    shortest, longest = _fitting(F.length(name))
    fitting = F.filter(
        above,
        lambda p: (name != "")
        & F.length(p["column_name"]).between(shortest, longest)
        & _may_be_close(name, F.lower(p["column_name"])),
    )
    pairs = F.transform(
        fitting,
        lambda p: F.struct(
            lcs_length(name, F.lower(p["column_name"])).alias("lcs"),
            (F.length(name) + F.length(F.lower(p["column_name"]))).alias("total"),
            p["position"].alias("position"),
            p["logical_id"].alias("logical_id"),
        ),
    )
    close = F.filter(pairs, lambda p: p["lcs"] * 200 >= p["total"] * COLUMN_NAME_PERCENT)
    order = F.transform(
        close,
        lambda p: F.struct((2.0 * p["lcs"] / p["total"]).alias("ratio"), (-p["position"]).alias("place"), p["logical_id"].alias("logical_id")),
    )
    return F.array_max(order)["logical_id"]


def assign_columns(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Like :func:`match_columns`, but every id of a version goes to one column, and losers try their next best.

    Pairs of a child and a parent column are ranked by strategy, ratio, child and parent position. The best pair of a
    version is taken, both ends leave, and so on. Every round takes all pairs that are the best of both their ends,
    which is what taking them one by one gives, and needs far fewer rounds. Ids that columns have already are theirs.
    """
    key, spread = ["version_id", "column_name"], ["version_id", "column_name"]
    existing = F.nullif("existing_id", F.lit(""))
    usable = parents.filter(F.coalesce("logical_id", F.lit("")) != "")
    taken_before = children.filter(existing.isNotNull())
    first = taken_before.groupBy("version_id", existing.alias("logical_id")).agg(
        F.min_by("column_name", F.struct("position", "column_name")).alias("column_name")
    )
    free = children.filter(existing.isNull() & F.col("parent_version_id").isNotNull())

    def pairs(joined: DataFrame, rank: int, ratio: Column) -> DataFrame:
        order = F.struct(
            F.lit(rank).alias("rank"),
            (-ratio).alias("ratio"),
            F.col("position").cast("bigint").alias("position"),
            F.col("parent_position").cast("bigint").alias("parent_position"),
            "logical_id",
        )
        return joined.select(*key, order.alias("order"))

    own = usable.select(F.col("version_id").alias("parent_version_id"), "column_name", "logical_id", F.col("position").alias("parent_position"))
    by_name = pairs(free.join(own, ["parent_version_id", "column_name"]), 1, F.lit(1.0))
    same = own.drop("column_name").withColumn("position", F.col("parent_position"))
    by_position = pairs(free.join(same, ["parent_version_id", "position"]), 2, F.lit(1.0))
    # Written before the close names are looked for: the shuffles of one are gone when those of the other are made.
    exact: DataFrame | None = cut_lineage(by_name.unionByName(by_position))
    near = close_names(free, usable).withColumnRenamed("position", "parent_position")
    named = free.withColumn("name", F.lower("column_name"))
    by_fuzzy = pairs(
        named.join(near, ["parent_version_id", "name"]).filter(_close()), 3, 2.0 * F.col("lcs") / F.col("total")
    )
    # Pairs are dealt by version alone, which is all that the groups and windows after it ask for.
    gone = first.groupBy("version_id").agg(F.collect_set("logical_id").alias("_gone"))
    every = exact.unionByName(by_fuzzy).join(gone, "version_id", "left").withColumn("logical_id", F.col("order.logical_id"))
    every = every.filter(~F.coalesce(F.array_contains("_gone", F.col("logical_id")), F.lit(False))).drop("_gone")
    left = every.groupBy(*key, "logical_id").agg(F.min("order").alias("order"))
    taken: DataFrame | None = None
    while True:
        best = [F.min("order").over(Window.partitionBy("version_id", end)) for end in ("column_name", "logical_id")]
        ranked = cut_lineage(left.withColumn("mutual", (F.col("order") == best[0]) & (F.col("order") == best[1])))
        if exact is not None:
            forget(exact)
            exact = None
        winners = ranked.filter("mutual").drop("mutual")
        if winners.isEmpty():
            break
        taken = winners if taken is None else taken.unionByName(winners)
        left = ranked.filter("NOT mutual").drop("mutual")
        for end in ("column_name", "logical_id"):
            left = left.join(winners.select("version_id", end), ["version_id", end], "left_anti")
    names = F.array(*[F.lit(s) for s in STRATEGIES])
    kept = first.select(*key, "logical_id", F.lit(STRATEGIES[0]).alias("strategy"))
    if taken is not None:
        kept = kept.unionByName(taken.select(*key, "logical_id", F.get(names, F.col("order.rank")).alias("strategy")))
    return lookup(children, kept, key, spread).select(
        *children.columns,
        F.coalesce("logical_id", new_logical_id("qualified_name", "column_name")).alias("logical_id"),
        F.coalesce("strategy", F.lit("new")).alias("strategy"),
    )


def match_columns(
    children: DataFrame, parents: DataFrame, exclusive: bool = False, parent_lineage: DataFrame | None = None
) -> DataFrame:
    """Give every child column a ``logical_id`` and the ``strategy`` that found it.

    Order: the id the column has already, the parent column of the same name, the
    one at the same position, the closest name, a new id. With ``exclusive`` an id
    goes to one column of a version only; the others get new ones. With ``parent_lineage``
    the result has the ``parent_column_id`` of :func:`lineage_rows` too.

    All strategies look into one list of a version's parent columns, so both sides are shuffled once.
    """
    usable = parents.filter(F.coalesce("logical_id", F.lit("")) != "")
    lists = {"_above": usable.select(F.col("version_id").alias("parent_version_id"), "column_name", "position", "logical_id")}
    if parent_lineage is not None:
        lists["_rows"] = _listed_rows(parent_lineage)
    existing = F.nullif("existing_id", F.lit(""))
    found = lookup_lists(children, lists, "parent_version_id", ["version_id", "column_name"])

    def ids(of: str) -> Column:
        own = F.col(of)
        return F.transform(F.filter("_above", lambda p: p[of] == own), lambda p: p["logical_id"])

    # Several parent columns of one name or position give as many rows, as a join does.
    found = found.select("*", F.explode_outer(ids("column_name")).alias("name_id"))
    found = found.select("*", F.explode_outer(ids("position")).alias("position_id"))
    found = found.withColumn("known_id", F.coalesce(existing, "name_id", "position_id"))
    matched = found.withColumn("fuzzy_id", F.when(F.col("known_id").isNull(), _closest("_above", F.lower("column_name"))))
    fresh = new_logical_id("qualified_name", "column_name")
    strategy = (
        F.when(existing.isNotNull(), F.lit("existing"))
        .when(F.col("name_id").isNotNull(), F.lit("exact_name"))
        .when(F.col("position_id").isNotNull(), F.lit("position"))
        .when(F.col("fuzzy_id").isNotNull(), F.lit("fuzzy"))
        .otherwise(F.lit("new"))
    )
    matched = matched.withColumn("strategy", strategy).withColumn(
        "logical_id", F.coalesce("known_id", "fuzzy_id", fresh)
    )
    if exclusive:
        order = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
        first = Window.partitionBy("version_id", "logical_id").orderBy(order, "position")
        matched = matched.withColumn("_taken", F.row_number().over(first) > 1)
        matched = matched.withColumn(
            "strategy", F.when(F.col("_taken"), F.lit("new")).otherwise(F.col("strategy"))
        ).withColumn("logical_id", F.when(F.col("_taken"), fresh).otherwise(F.col("logical_id")))
    if parent_lineage is not None:
        matched = matched.withColumn("parent_column_id", _parent_row())
    linked = ["parent_column_id"] if parent_lineage is not None else []
    return matched.select(*children.columns, "logical_id", "strategy", *linked)


def match_counts(matched: DataFrame, parents: DataFrame) -> DataFrame:
    """Per version: columns, ids taken over from the parent, new ids."""
    known = (
        parents.filter(F.col("logical_id").isNotNull())
        .select(F.col("version_id").alias("parent_version_id"), "logical_id", F.lit(1).alias("_hit"))
        .distinct()
    )
    joined = matched.join(known, ["parent_version_id", "logical_id"], "left")
    return joined.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count("_hit").alias("propagated"),
        (F.count_distinct("logical_id") - F.count("_hit")).alias("new_ids"),
    )


def parent_columns(owners: DataFrame, columns: DataFrame, by_prefix: bool = True) -> DataFrame:
    """Columns of each owner, by ``dataset_id``; by qualified-name prefix if it owns none.

    ``owners`` holds ``dataset_id, qualified_name``; ``columns`` holds ``dataset_id,
    qualified_name, column_name, ...``. A column's qualified name is its dataset's
    followed by a dot and its own name, so the prefix lookup is an equi-join too.
    """
    kept = [c for c in columns.columns if c not in ("dataset_id", "qualified_name")]
    own = owners.select("dataset_id").join(columns.select("dataset_id", *kept), "dataset_id")
    if not by_prefix:
        return own
    bare = owners.join(columns.select("dataset_id").distinct(), "dataset_id", "left_anti")
    # A dataset name may hold dots itself, so every prefix that ends before a dot is tried.
    dots = F.filter(
        F.sequence(F.lit(2), F.length("qualified_name")),
        lambda i: F.substring(F.col("qualified_name"), i, F.lit(1)) == ".",
    )
    prefixes = columns.filter(F.contains("qualified_name", F.lit("."))).select(
        F.explode(
            F.transform(dots, lambda i: F.substring(F.col("qualified_name"), F.lit(1), i - 1))
        ).alias("prefix"),
        *kept,
    )
    fallback = bare.join(prefixes, bare["qualified_name"] == prefixes["prefix"]).select(
        "dataset_id", *kept
    )
    return own.unionByName(fallback)


def column_edges(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child column → parent column of the same name, between external column ids.

    Both sides hold ``version_id, column_name, external_id`` (children also
    ``parent_version_id``). Missing, temporary and self links are dropped.
    """
    above = parents.select(
        F.col("version_id").alias("parent_version_id"),
        "column_name",
        F.col("external_id").alias("parent"),
    )
    real = [~F.startswith(c, F.lit(TEMPORARY_PREFIX)) for c in (F.col("child"), F.col("parent"))]
    return (
        children.select("parent_version_id", "column_name", F.col("external_id").alias("child"))
        .join(above, ["parent_version_id", "column_name"])
        .filter((F.col("child") != F.col("parent")) & real[0] & real[1])
        .select("child", "parent", "column_name")
    )


def _listed_rows(parent_lineage: DataFrame) -> DataFrame:
    return parent_lineage.select(
        F.col("dataset_version_id").alias("parent_version_id"), "id", F.col("logical_column_id").alias("logical_id"), "column_name"
    )


def _parent_row() -> Column:
    """The parent version's row of the same logical id, if the column's name is known there."""
    own, name = F.col("logical_id"), F.col("column_name")
    # A logical id may stand twice in a version (position matches): take one row.
    same = F.filter("_rows", lambda p: p["logical_id"] == own)
    known = F.exists("_rows", lambda p: p["column_name"] == name)
    return F.when(known, F.array_min(F.transform(same, lambda p: p["id"])))


def lineage_rows(matched: DataFrame, parent_lineage: DataFrame | None = None) -> DataFrame:
    """Lineage rows of matched columns, linked to the parent version's row.

    The parent row has the same logical id in the parent version, and the column's
    name is known there. ``parent_lineage`` holds ``id, dataset_version_id,
    logical_column_id, column_name``; it is left out where ``match_columns`` had it. The
    id of a row digests its version and name, and ``data_type`` is the ``type`` of the
    matched column, where there is one.
    """
    kind = F.col("type") if "type" in matched.columns else F.lit(None)
    parent = F.col("parent_column_id")
    if parent_lineage is not None:
        lists = {"_rows": _listed_rows(parent_lineage)}
        matched = lookup_lists(matched, lists, "parent_version_id", ["version_id", "column_name"])
        parent = _parent_row()
    identity = F.to_json(F.struct(F.col("version_id").cast("string").alias("version_id"), "column_name"))
    return matched.select(
        F.substring(F.sha2(identity, 256), 1, 32).alias("id"),
        F.col("version_id").alias("dataset_version_id"),
        "column_name",
        F.col("logical_id").alias("logical_column_id"),
        parent.alias("parent_column_id"),
        kind.cast("string").alias("data_type"),
    )


def column_history(lineage: DataFrame) -> DataFrame:
    """Full lineage of every column: its root row, depth and latest row.

    Rows of one ``root_id`` in order of ``depth`` are the path of a column. Takes
    ``id, parent_column_id`` and any other columns of lineage rows, such as ``logical_column_id,
    column_name, dataset_version_id``.
    """
    lineage = cut_lineage(lineage)
    chains = follow_chains(lineage.select("id", F.col("parent_column_id").alias("parent_id")))
    return lineage.join(chains, "id")
