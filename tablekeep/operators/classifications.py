"""Security and privacy classes of datasets and columns.

The log holds ``id, entity_type, entity_id, column_name, classification,
applied_by, applied_at``; the latest valid row of a key is the active one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.functions.vocab import (
    COLUMN,
    COLUMN_CLASSES,
    DATASET,
    DATASET_CLASSES,
    DEFAULT_DATASET_CLASS,
    PUBLIC_SCOPE,
    RESTRICTED_SCOPE,
    UNKNOWN_DEPARTMENT,
)

KEY = ["entity_type", "entity_id", "column_key"]


def class_problem(entity_type: str = "entity_type", classification: str = "classification") -> Column:
    """Why a class does not fit the entity type; null when it does."""
    kind, name = F.col(entity_type), F.col(classification)

    def wrong(allowed: list[str]) -> Column:
        return F.coalesce(~name.isin(allowed), F.lit(True))

    return (
        F.when((kind == DATASET) & wrong(DATASET_CLASSES), F.lit("not a dataset class"))
        .when((kind == COLUMN) & wrong(COLUMN_CLASSES), F.lit("not a column class"))
        .when(
            F.coalesce(~kind.isin(DATASET, COLUMN), F.lit(True)), F.lit("unknown entity type")
        )
    )


def _latest(log: DataFrame) -> DataFrame:
    """Key and id of the newest row per key, merged inside the tasks first."""
    keyed = log.withColumn("column_key", F.coalesce("column_name", F.lit("")))
    newest = F.max(F.struct("applied_at", "id"))
    return keyed.groupBy(*KEY).agg(newest.alias("m")).select(*KEY, F.col("m.id").alias("id"))


def classification_history(log: DataFrame) -> DataFrame:
    """The valid log with ``is_active``: exactly one active row per key.

    The newest row is found by an aggregate and joined by id, so the log of one
    very busy key is never sorted in a single task.
    """
    valid = log.filter(class_problem().isNull())
    active = _latest(valid).select("id", F.lit(True).alias("_active"))
    return (
        valid.join(active, "id", "left")
        .withColumn("is_active", F.coalesce("_active", F.lit(False)))
        .drop("_active")
    )


def rejected_classifications(log: DataFrame) -> DataFrame:
    """Log rows that are never applied, with the reason."""
    return log.withColumn("problem", class_problem()).filter(F.col("problem").isNotNull())


def active_classifications(log: DataFrame) -> DataFrame:
    """The active row of every key."""
    valid = log.filter(class_problem().isNull())
    fields = F.struct("id", "column_name", "classification", "applied_by", "applied_at")
    keyed = valid.withColumn("column_key", F.coalesce("column_name", F.lit("")))
    newest = F.max_by(fields, F.struct("applied_at", "id"))
    return keyed.groupBy(*KEY).agg(newest.alias("r")).select("entity_type", "entity_id", "r.*")


def security_class(active: DataFrame) -> DataFrame:
    """Active security class of each dataset that has one."""
    return active.filter(
        (F.col("entity_type") == DATASET) & F.col("classification").isin(DATASET_CLASSES)
    ).select(F.col("entity_id").alias("dataset_id"), F.col("classification").alias("security_class"))


def column_classes(active: DataFrame) -> DataFrame:
    """Per dataset a map from column name to its active class."""
    entry = F.struct(F.col("column_name").alias("key"), F.col("classification").alias("value"))
    return (
        active.filter((F.col("entity_type") == COLUMN) & F.col("column_name").isNotNull())
        .groupBy(F.col("entity_id").alias("dataset_id"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("column_classes"))
    )


def allowed_column_classes(
    datasets: DataFrame, active: DataFrame, default: str | None = DEFAULT_DATASET_CLASS
) -> DataFrame:
    """Security class of each dataset and the column classes it admits.

    A dataset without a class counts as ``default``; with None as default it admits none.
    """
    joined = datasets.select("dataset_id").join(security_class(active), "dataset_id", "left")
    known = F.coalesce("security_class", F.lit(default).cast("string"))
    every = F.array(*[F.lit(c) for c in sorted(COLUMN_CLASSES)])
    allowed = F.when(known.isNotNull(), every).otherwise(F.array().cast("array<string>"))
    return joined.select("dataset_id", known.alias("security_class"), allowed.alias("allowed"))


def consistency_problems(wanted: DataFrame, active: DataFrame) -> DataFrame:
    """Column classes asked for (``dataset_id, column_name, classification``) that do not fit."""
    allowed = allowed_column_classes(wanted.select("dataset_id").distinct(), active)
    return (
        wanted.join(allowed, "dataset_id")
        .filter(F.col("classification").isNotNull() & (F.col("classification") != ""))
        .filter(~F.array_contains(F.col("allowed"), F.col("classification")))
        .select("dataset_id", "column_name", "classification", "security_class")
    )


def with_default_attributes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Complete ``attributes`` (a string map) of classification requests.

    RESTRICTED gets a department scope and the department of ``applied_by``, PUBLIC
    an enterprise scope; attributes given explicitly win.
    """
    people = users.select(F.col("employee_id").alias("applied_by"), "department")
    joined = requests.join(people, "applied_by", "left")
    department = F.coalesce("department", F.lit(UNKNOWN_DEPARTMENT))

    def strings(*items: Column) -> Column:
        return F.create_map(*items).cast("map<string,string>")

    defaults = (
        F.when(
            F.col("classification") == "RESTRICTED",
            strings(
                F.lit("visibility_scope"), F.lit(RESTRICTED_SCOPE), F.lit("department"), department
            ),
        )
        .when(
            F.col("classification") == "PUBLIC",
            strings(F.lit("visibility_scope"), F.lit(PUBLIC_SCOPE)),
        )
        .otherwise(strings())
    )
    given = F.coalesce("attributes", strings())
    missing = F.map_filter(defaults, lambda key, _: ~F.map_contains_key(given, key))
    return joined.withColumn("attributes", F.map_concat(missing, given)).drop("department")


# --- tags on entities: rows ``entity_id, tag`` --------------------------------------------------


def replace_security_class(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot of the tags in which changed entities carry only their new security class.

    ``changes`` holds ``entity_id, tag``, one row per entity; other tags stay.
    """
    changed = changes.select("entity_id").distinct()
    security = F.col("tag").isin(DATASET_CLASSES)
    outdated = tags.filter(security).join(changed, "entity_id", "left_anti")
    return tags.filter(~security).unionByName(outdated).unionByName(changes.select("entity_id", "tag"))


def add_tags(tags: DataFrame, additions: DataFrame) -> DataFrame:
    """Snapshot with ``additions``; entities that have the tag already are left alone."""
    fresh = additions.select("entity_id", "tag").distinct().join(tags, ["entity_id", "tag"], "left_anti")
    return tags.unionByName(fresh)


def remove_tags(tags: DataFrame, removals: DataFrame) -> DataFrame:
    """Snapshot without these (entity, tag) rows."""
    return tags.join(removals.select("entity_id", "tag").distinct(), ["entity_id", "tag"], "left_anti")


def list_tags(tags: DataFrame) -> DataFrame:
    """The set of tags of every entity."""
    return tags.groupBy("entity_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
