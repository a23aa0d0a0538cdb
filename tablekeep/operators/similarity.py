"""Dataset similarity, parent search and suggestions for all datasets at once.

Input is the long signature table ``project_id, dataset_id, name_base,
column_name, data_type, sample_hash``. The work is kept below "every pair of a
project" in three exact ways:

* datasets with the same signature are one *profile*: copies are scored once and
  only the first few members of a profile can ever be a best match;
* profiles meet only where the score can still reach a threshold (see
  :func:`candidate_pairs`), so a column nearly every table has joins nothing;
* name similarity, the expensive part, is computed once per distinct pair of
  names and only for pairs it can still lift over the threshold.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekeep.functions.lineage import cut_lineage, forget
from tablekeep.functions.rounding import round_exact
from tablekeep.functions.textsim import partial_ratio
from tablekeep.functions.vocab import (
    CLOSE_OVERLAP,
    CLOSE_THRESHOLD,
    EXTENSION_THRESHOLD,
    PARENT_THRESHOLD,
    WEIGHT_NAME,
    WEIGHT_NAME_OVERLAP,
    WEIGHT_SAMPLE,
    WEIGHT_STRUCTURE,
    WEIGHT_TYPE_AGREEMENT,
)

TOP_SUGGESTIONS = 5
# Smallest column overlap with which a pair without equal samples reaches 0.60
# even when types and names agree fully.
MIN_OVERLAP = (
    PARENT_THRESHOLD - WEIGHT_STRUCTURE * WEIGHT_TYPE_AGREEMENT - WEIGHT_NAME
) / (WEIGHT_STRUCTURE * WEIGHT_NAME_OVERLAP) - 1e-9
# Slack for rounding when a pair is dropped on an upper bound.
EPSILON = 1e-9


def dataset_profiles(signatures: DataFrame) -> DataFrame:
    """``project_id, dataset_id, profile_id, name_base, columns`` per dataset.

    ``profile_id`` digests the base name and the whole column signature as JSON, in which no two signatures look alike.
    """
    column = F.struct("column_name", "data_type", "sample_hash")
    columns = F.array_sort(F.collect_set(column))
    per_dataset = signatures.groupBy("project_id", "dataset_id", "name_base").agg(
        columns.alias("columns")
    )
    return per_dataset.select(
        "project_id",
        "dataset_id",
        F.sha2(F.to_json(F.struct("name_base", "columns")), 256).alias("profile_id"),
        "name_base",
        "columns",
    )


def distinct_profiles(
    datasets: DataFrame, wanted: DataFrame | None = None, published: DataFrame | None = None
) -> DataFrame:
    """One row per (project, profile), with a short ``key`` that stands for it in joins.

    ``wanted`` and ``published`` say whether a member is listed there (all are, without a
    list); profiles of neither are left out. The key is fixed by writing the table: it
    only has to be unique within one run.
    """
    flags = []
    for name, listed in (("wanted", wanted), ("published", published)):
        if listed is None:
            datasets = datasets.withColumn(name, F.lit(True))
        else:
            marked = listed.select("dataset_id", F.lit(True).alias(name)).distinct()
            datasets = datasets.join(marked, "dataset_id", "left")
        flags.append(F.coalesce(F.bool_or(name), F.lit(False)).alias(name))
    profiles = (
        datasets.groupBy("project_id", "profile_id")
        .agg(F.any_value("name_base").alias("name_base"), F.any_value("columns").alias("columns"), *flags)
        .filter("wanted OR published")
    )
    return cut_lineage(profiles.withColumn("key", F.monotonically_increasing_id()))


def _ordered_tokens(profiles: DataFrame) -> DataFrame:
    """The columns of every profile with their ``rank`` by rarity in the project, written once for :func:`_candidates`."""
    flags = ("wanted", "published")
    long = profiles.select("project_id", "key", *flags, F.size("columns").alias("n"), F.inline("columns"))
    tokens = long.select(
        "project_id",
        "key",
        "n",
        *flags,
        F.xxhash64("column_name").alias("token"),
        F.xxhash64("column_name", "sample_hash").alias("sample"),
    )
    frequency = tokens.groupBy("project_id", "token").agg(F.count(F.lit(1)).alias("frequency"))
    rarity = Window.partitionBy("project_id", "key").orderBy("frequency", "token")
    return cut_lineage(
        tokens.join(frequency, ["project_id", "token"])
        .withColumn("rank", F.row_number().over(rarity))
        .drop("frequency")
    )


def candidate_pairs(profiles: DataFrame) -> DataFrame:
    """Unordered profile pairs ``a < b`` (keys) of a project that can reach a threshold.

    A pair is accepted only if it (a) overlaps in at least ``MIN_OVERLAP`` of all
    its columns, or (b) agrees on the sample of some column, or (c) holds all
    columns of the other side. For (a) it is enough to join the columns that are
    rare in the project: with n columns, the n - ceil(t * n) + 1 rarest of both
    sides must share one. For (c) the rarest column of the contained side must be
    among the other's. Columns common to the whole project are so left out of
    both joins. Names and samples are joined by their hashes: a collision only adds
    a pair, which the exact overlap then weighs like any other. One side must be
    wanted and the other published.
    """
    return _candidates(_ordered_tokens(profiles))


def _candidates(ordered: DataFrame) -> DataFrame:
    """:func:`candidate_pairs` from the ranked columns, which three joins read."""
    flags = ("wanted", "published")
    prefix = ordered.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * MIN_OVERLAP) + 1)

    def pair(left: DataFrame, right: DataFrame, token: str, condition: str) -> DataFrame:
        def side(rows: DataFrame, name: str) -> DataFrame:
            named = [F.col(c).alias(f"{c}_{name}") for c in ("n", *flags)]
            return rows.select("project_id", token, F.col("key").alias(name), *named)

        joined = (
            side(left, "a")
            .join(side(right, "b"), ["project_id", token])
            .filter(condition)
            .filter("(wanted_a AND published_b) OR (wanted_b AND published_a)")
        )
        return joined.select(
            "project_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        )

    overlap = pair(prefix, prefix, "token", "a < b")
    samples = pair(ordered, ordered, "sample", "a < b")
    contained = pair(ordered.filter("rank = 1"), ordered, "token", "a != b AND n_a <= n_b")
    return overlap.unionByName(samples).unionByName(contained).distinct()


def _with_overlap(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach both column lists and count what they share.

    A list travels once; what is compared of it is made where both sides have met.
    """
    for side in ("a", "b"):
        columns = profiles.select(
            "project_id",
            F.col("key").alias(side),
            F.col("name_base").alias(f"name_{side}"),
            F.col("columns").alias(f"columns_{side}"),
        )
        pairs = pairs.join(columns, ["project_id", side])

    def shared(*fields: str) -> Column:
        sides = [F.transform(f"columns_{side}", lambda c: F.concat_ws(":", *[c[f] for f in fields])) for side in ("a", "b")]
        return F.size(F.array_intersect(*sides))

    return pairs.select(
        "project_id",
        "a",
        "b",
        "name_a",
        "name_b",
        F.size("columns_a").alias("n_a"),
        F.size("columns_b").alias("n_b"),
        shared("column_name").alias("common"),
        shared("data_type", "column_name").alias("same_type"),
        shared("sample_hash", "column_name").alias("same_sample"),
    )


def _threshold(contained: Column, jaccard: Column, adaptive: bool) -> Column:
    if not adaptive:
        return F.lit(PARENT_THRESHOLD)
    return (
        F.when(contained, F.lit(EXTENSION_THRESHOLD))
        .when(jaccard > CLOSE_OVERLAP, F.lit(CLOSE_THRESHOLD))
        .otherwise(F.lit(PARENT_THRESHOLD))
    )


def pair_scores(profiles: DataFrame, adaptive: bool = True) -> DataFrame:
    """Scores of all profile pairs accepted in at least one direction.

    Each pair stands once, either way round. ``accept_a_for_b`` says that profile a is an acceptable parent of profile b.
    With ``adaptive`` the threshold is lower for contained and close structures.
    """
    ordered = _ordered_tokens(profiles)
    pairs = _with_overlap(_candidates(ordered), profiles)
    common, least = F.col("common"), F.greatest("common", F.lit(1))
    union = F.col("n_a") + F.col("n_b") - common
    parts = pairs.select(
        "project_id",
        "a",
        "b",
        "name_a",
        "name_b",
        (common / union).alias("jaccard"),
        (F.col("same_type") / least).alias("type_agreement"),
        (F.col("same_sample") / least).alias("sample_agreement"),
        (common == F.col("n_a")).alias("a_in_b"),
        (common == F.col("n_b")).alias("b_in_a"),
    )
    structure = F.lit(WEIGHT_STRUCTURE) * (
        F.lit(WEIGHT_NAME_OVERLAP) * F.col("jaccard")
        + F.lit(WEIGHT_TYPE_AGREEMENT) * F.col("type_agreement")
    )
    data = F.col("sample_agreement") * F.lit(WEIGHT_SAMPLE)
    lowest = _threshold(F.col("a_in_b") | F.col("b_in_a"), F.col("jaccard"), adaptive)
    # Read again for its names: written once, with the keys of the profiles.
    reachable = cut_lineage(
        parts.filter(structure + data + F.lit(WEIGHT_NAME + EPSILON) >= lowest)
        .withColumn("name_1", F.least("name_a", "name_b"))
        .withColumn("name_2", F.greatest("name_a", "name_b"))
    )
    forget(ordered)
    names = (
        reachable.filter(F.col("name_1") != F.col("name_2"))
        .select("name_1", "name_2")
        .distinct()
        .withColumn("ratio", partial_ratio(F.col("name_1"), F.col("name_2")))
    )
    similarity = F.when(F.col("name_1") == F.col("name_2"), F.lit(1.0)).otherwise(F.col("ratio"))
    scored = (
        reachable.join(names, ["name_1", "name_2"], "left")
        .withColumn("name_similarity", similarity)
        .withColumn("score", structure + F.lit(WEIGHT_NAME) * F.col("name_similarity") + data)
    )
    accept = {
        side: F.col("score") >= _threshold(F.col(inside), F.col("jaccard"), adaptive)
        for side, inside in (("accept_a_for_b", "a_in_b"), ("accept_b_for_a", "b_in_a"))
    }
    accepted = scored.withColumns(accept).filter("accept_a_for_b OR accept_b_for_a")
    for side in ("a", "b"):
        ids = profiles.select("project_id", F.col("key").alias(side), F.col("profile_id").alias(f"profile_{side}"))
        accepted = accepted.join(ids, ["project_id", side])
    return accepted.drop("a", "b", "name_1", "name_2", "ratio", "a_in_b", "b_in_a")


def similar_datasets(
    signatures: DataFrame,
    published: DataFrame,
    k: int = TOP_SUGGESTIONS,
    adaptive: bool = True,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best acceptable parents of each dataset: ``..., score, rank``.

    ``published`` lists the ``dataset_id`` that may be a parent; ``wanted`` limits
    the datasets a parent is looked for; then only their projects are read, and only
    pairs of a wanted and a published profile are scored. Equal scores go to the smaller id.
    """
    if wanted is not None:
        projects = signatures.join(wanted.select("dataset_id").distinct(), "dataset_id", "left_semi")
        signatures = signatures.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    datasets = cut_lineage(dataset_profiles(signatures))
    profiles = distinct_profiles(datasets, wanted, published)
    scores = cut_lineage(pair_scores(profiles, adaptive))
    directed = scores.filter("accept_a_for_b").select(
        "project_id",
        F.col("profile_b").alias("profile_id"),
        F.col("profile_a").alias("parent_profile"),
        "score",
    )
    directed = directed.unionByName(
        scores.filter("accept_b_for_a").select(
            "project_id",
            F.col("profile_a").alias("profile_id"),
            F.col("profile_b").alias("parent_profile"),
            "score",
        )
    )
    # A profile always matches itself: its members are copies of each other.
    itself = profiles.select(
        "project_id",
        "profile_id",
        F.col("profile_id").alias("parent_profile"),
        F.lit(1.0).alias("score"),
    )
    directed = directed.unionByName(itself)

    # Only the k + 1 first members of a profile can be among anyone's best k.
    by_id = Window.partitionBy("project_id", "parent_profile").orderBy("parent_id")
    members = (
        datasets.join(published.select("dataset_id").distinct(), "dataset_id", "left_semi")
        .select(
            "project_id",
            F.col("profile_id").alias("parent_profile"),
            F.col("dataset_id").alias("parent_id"),
        )
        .withColumn("member", F.row_number().over(by_id))
        .filter(F.col("member") <= k + 1)
    )
    best = Window.partitionBy("project_id", "profile_id").orderBy(F.desc("score"), "parent_id")
    shortlist = (
        directed.join(members, ["project_id", "parent_profile"])
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k + 1)
        .select("project_id", "profile_id", "parent_id", "score")
    )
    current = datasets.select("project_id", "profile_id", "dataset_id")
    if wanted is not None:
        current = current.join(wanted.select("dataset_id").distinct(), "dataset_id", "left_semi")
    order = Window.partitionBy("dataset_id").orderBy(F.desc("score"), "parent_id")
    return (
        current.join(shortlist, ["project_id", "profile_id"])
        .filter(F.col("dataset_id") != F.col("parent_id"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("project_id", "dataset_id", "parent_id", "score", "rank")
    )


def find_parents(
    signatures: DataFrame, published: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """The best parent of each dataset that has one with a score of at least 0.60."""
    best = similar_datasets(signatures, published, k=1, adaptive=False, wanted=wanted)
    return best.drop("rank")


def suggested_descriptions(similar: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Per dataset and column the description of the best similar dataset that has one.

    ``descriptions`` holds ``dataset_id, version_number, column_name, description`` of
    the latest published version of each dataset.
    """
    found = similar.join(descriptions.withColumnRenamed("dataset_id", "parent_id"), "parent_id")
    fields = F.struct(
        "description",
        F.col("parent_id").alias("source_dataset"),
        F.col("version_number").alias("source_version"),
        round_exact(F.col("score"), 3).alias("similarity_score"),
    )
    best = found.groupBy("dataset_id", "column_name").agg(F.min_by(fields, "rank").alias("s"))
    return best.select("dataset_id", "column_name", "s.*")
