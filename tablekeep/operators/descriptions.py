"""Column descriptions carried from version to version.

Descriptions are rows ``version_id, column_name, description, created_by,
created_at, updated_by, updated_at``, one per (version, column). A change writes
a new snapshot.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablekeep.operators.versions import latest_versions

KEY = ["version_id", "column_name"]
INHERITED_VERSIONS = 5


def upsert_descriptions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New snapshot after applying ``incoming`` in order of ``submitted_at, seq``.

    Texts are trimmed and blank ones ignored. The first text of a new key creates
    the row, any later one updates it; an update leaves ``created_*`` alone.
    """
    text = F.trim("description")
    order = F.struct("submitted_at", "seq")
    entry = F.struct(text.alias("description"), "user_id", "submitted_at")
    changes = (
        incoming.filter(F.coalesce(text, F.lit("")) != "")
        .groupBy(*KEY)
        .agg(
            F.min_by(entry, order).alias("first"),
            F.max_by(entry, order).alias("last"),
            F.count(F.lit(1)).alias("changes"),
        )
    )
    old = existing.withColumn("_old", F.lit(True))
    changed = F.col("last").isNotNull()
    updated = changed & (F.col("_old").isNotNull() | (F.col("changes") > 1))
    is_old = F.col("_old").isNotNull()
    return old.join(changes, KEY, "full_outer").select(
        *KEY,
        F.when(changed, F.col("last.description")).otherwise(F.col("description")).alias("description"),
        F.when(is_old, F.col("created_by")).otherwise(F.col("first.user_id")).alias("created_by"),
        F.when(is_old, F.col("created_at")).otherwise(F.col("first.submitted_at")).alias("created_at"),
        F.when(updated, F.col("last.user_id")).otherwise(F.col("updated_by")).alias("updated_by"),
        F.when(updated, F.col("last.submitted_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def version_descriptions(
    versions: DataFrame, descriptions: DataFrame, published_only: bool = False
) -> DataFrame:
    """Descriptions of the latest (published) version of each dataset."""
    latest = latest_versions(versions, published_only).select(
        "dataset_id", F.col("id").alias("version_id"), "version_number"
    )
    return latest.join(descriptions.select(*KEY, "description"), "version_id")


def description_coverage(versions: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Per dataset: has it descriptions, in how many versions, how many in all."""
    per_version = descriptions.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    joined = versions.select("dataset_id", F.col("id").alias("version_id")).join(
        per_version, "version_id", "left"
    )
    return joined.groupBy("dataset_id").agg(
        (F.count("n") > 0).alias("has_descriptions"),
        F.count("n").alias("versions_count"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_descriptions"),
    )


def delete_descriptions(descriptions: DataFrame, version_ids: DataFrame) -> DataFrame:
    """Snapshot without the descriptions of these versions."""
    return descriptions.join(version_ids.select("version_id").distinct(), "version_id", "left_anti")


def deleted_counts(descriptions: DataFrame, version_ids: DataFrame) -> DataFrame:
    """How many descriptions :func:`delete_descriptions` removes, per version."""
    gone = descriptions.join(version_ids.select("version_id").distinct(), "version_id", "left_semi")
    return gone.groupBy("version_id").agg(F.count(F.lit(1)).alias("deleted_count"))


def copied_descriptions(descriptions: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows to append so that each ``new_version`` has the texts of its ``old_version``.

    ``copies`` also holds ``user_id`` and ``copied_at``.
    """
    texts = descriptions.select(F.col("version_id").alias("old_version"), "column_name", "description")
    nothing = F.lit(None)
    return texts.join(copies, "old_version").select(
        F.col("new_version").alias("version_id"),
        "column_name",
        "description",
        F.col("user_id").alias("created_by"),
        F.col("copied_at").alias("created_at"),
        nothing.cast("string").alias("updated_by"),
        nothing.cast("timestamp").alias("updated_at"),
    )


def inherited_descriptions(versions: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Texts of the last five published versions of a dataset, where there are any.

    The versions are cut first, so a later one without descriptions still counts.
    """
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("version_number"), F.desc("id"))
    recent = (
        versions.filter(F.col("external_id").isNotNull())
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= INHERITED_VERSIONS)
        .select("dataset_id", F.col("id").alias("version_id"), "version_number")
    )
    texts = F.array_sort(F.collect_list(F.struct("column_name", "description")))
    per_version = descriptions.groupBy("version_id").agg(texts.alias("descriptions"))
    return recent.join(per_version, "version_id")


def final_description(given: Column | str, existing: Column | str, column_name: Column | str) -> Column:
    """The given text unless blank, else the existing one, else a generic one."""
    given = F.col(given) if isinstance(given, str) else given
    return F.coalesce(
        F.when(F.trim(given) != "", given),
        F.nullif(existing, F.lit("")),
        F.concat(F.lit("Colonne "), column_name),
    )


def autofill(fields: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Fill blank descriptions from suggestions; ``filled`` marks the ones taken over.

    Both hold ``dataset_id, column_name, description``.
    """
    offered = suggestions.select("dataset_id", "column_name", F.trim("description").alias("_offer"))
    blank = F.coalesce(F.trim("description"), F.lit("")) == ""
    filled = blank & F.col("_offer").isNotNull()
    return (
        fields.join(offered, ["dataset_id", "column_name"], "left")
        .withColumn("filled", filled)
        .withColumn("description", F.when(filled, F.col("_offer")).otherwise(F.col("description")))
        .drop("_offer")
    )
