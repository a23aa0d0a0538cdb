"""Profiling a table into a signature other tables can be compared with."""

import hashlib
from bisect import bisect, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablekeep.operators.checks import value_counts

NUMERIC = "numeric"
DATETIME = "datetime"
STRING = "string"
SAMPLE_SIZE = 20
ALGO_VERSION = "v1"
# Columns per aggregate; a columnar scan of each group reads only its own columns.
COLUMNS_PER_PASS = 40
# Size of the sketches that estimate distinct values, as a power of two: 1.6 % off on average, and stored ones 0.8 %.
ESTIMATE_BITS = 12
SKETCH_BITS = 14


def column_class(kind: T.DataType) -> str:
    """numeric, datetime or string; decimals are numeric, nested types string."""
    if isinstance(kind, T.NumericType):
        return NUMERIC
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return STRING


def column_listing(df: DataFrame) -> DataFrame:
    """``position, column_name, spark_type, data_type`` of a table, in column order."""
    rows = [
        (i, field.name, field.dataType.simpleString(), column_class(field.dataType))
        for i, field in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, spark_type string, data_type string"
    )


def base_name(name: Column | str) -> Column:
    """Lower-cased text before the first dot."""
    return F.lower(F.substring_index(name, ".", 1))


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _countable(field: T.StructField) -> Column:
    """A column as a type that sketches take; others are counted by their text."""
    known = isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
    return _col(field.name) if known else _col(field.name).cast("string")


def _group_stats(df: DataFrame, columns: list[tuple[int, T.StructField]]) -> DataFrame:
    aggs, rows = [F.count(F.lit(1)).alias("rows_count")], []
    for i, field in columns:
        column, kind = _col(field.name), column_class(field.dataType)
        aggs.append(F.hll_sketch_estimate(F.hll_sketch_agg(_countable(field), ESTIMATE_BITS)).alias(f"d{i}"))
        if kind == NUMERIC:
            aggs += [
                F.min(column).cast("double").alias(f"min{i}"),
                F.max(column).cast("double").alias(f"max{i}"),
                F.avg(column).cast("double").alias(f"avg{i}"),
                F.stddev_samp(column).alias(f"std{i}"),
            ]
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(kind).alias("data_type"),
                *[
                    (F.col(f"{stat}{i}") if kind == NUMERIC else F.lit(None).cast("double")).alias(
                        name
                    )
                    for stat, name in (("min", "min"), ("max", "max"), ("avg", "mean"), ("std", "std"))
                ],
                F.col(f"d{i}").alias("distinct_count"),
            )
        )
    return df.agg(*aggs).select("rows_count", F.inline(F.array(*rows)))


def column_stats(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per column: class, min, max, mean, sample deviation, distinct count, rows.

    Distinct counts are HyperLogLog estimates unless ``exact_distinct``: then one more scan counts the values of all
    columns together, merged inside the tasks before anything is shuffled.
    """
    fields = list(enumerate(df.schema.fields))
    out = None
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        part = _group_stats(df, fields[start : start + COLUMNS_PER_PASS])
        out = part if out is None else out.unionByName(part)
    if not exact_distinct:
        return out
    exact = value_counts(df, df.columns).groupBy("column_name").agg(F.count("value").alias("exact"))
    return (
        out.join(exact, "column_name", "left")
        .withColumn("distinct_count", F.coalesce("exact", F.lit(0).cast("bigint")))
        .select(*out.columns)
    )


# --- profiles that merge -----------------------------------------------------------------------


def column_sketches(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What is kept of every column so that profiles of parts can be merged, per group of ``by`` (a file, a day).

    Moments are kept as count, mean and sum of squared deviations, distinct values as a sketch; nothing of the rows is
    needed again. See :func:`merge_sketches`.
    """
    by = by or []
    groups = []
    fields = list(enumerate(df.schema.fields))
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        aggs, rows = [F.count(F.lit(1)).alias("rows_count")], []
        for i, field in fields[start : start + COLUMNS_PER_PASS]:
            column, kind = _col(field.name), column_class(field.dataType)
            aggs += [F.count(column).alias(f"n{i}"), F.hll_sketch_agg(_countable(field), SKETCH_BITS).alias(f"s{i}")]
            stats = {name: F.lit(None).cast("double") for name in ("min", "max", "mean", "deviations")}
            if kind == NUMERIC:
                number = column.cast("double")
                aggs += [F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}")]
                aggs += [F.avg(number).alias(f"mean{i}"), (F.var_pop(number) * F.count(number)).alias(f"deviations{i}")]
                stats = {name: F.col(f"{name}{i}") for name in stats}
            rows.append(
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(field.name).alias("column_name"),
                    F.lit(kind).alias("data_type"),
                    F.col(f"n{i}").alias("n"),
                    *[value.alias(name) for name, value in stats.items()],
                    F.col(f"s{i}").alias("sketch"),
                )
            )
        groups.append(df.groupBy(*by).agg(*aggs).select(*by, "rows_count", F.inline(F.array(*rows))))
    out = groups[0]
    for part in groups[1:]:
        out = out.unionByName(part)
    return out


def merge_sketches(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The profile of all parts of a key (a version), as :func:`column_stats` has it.

    Squared deviations are moved to the common mean part by part, which stays exact where sums of squares would cancel.
    """
    keys = keys or []
    column = [*keys, "position", "column_name", "data_type"]
    whole = sketches.groupBy(*column).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("whole"))
    shifted = F.col("deviations") + F.col("n") * F.pow(F.col("mean") - F.col("whole"), 2)
    return (
        sketches.join(whole, column)
        .groupBy(*column)
        .agg(
            F.sum("rows_count").alias("rows_count"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.max("whole").alias("mean"),
            F.sqrt(F.sum(shifted) / F.nullif(F.greatest(F.sum("n") - 1, F.lit(0)), F.lit(0))).alias("std"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"),
        )
        .select(*keys, "rows_count", "position", "column_name", "data_type", "min", "max", "mean", "std", "distinct_count")
    )


# --- samples -----------------------------------------------------------------------------------


def _smallest(names: list[str], k: int):
    """Task side of the sample: the ``k`` distinct values of each column with the smallest hashes, held at any time.

    It stands for itself, so that workers need nothing of this package.
    """

    def run(batches):
        kept: list[list[tuple[str, str]]] = [[] for _ in names]
        for batch in batches:
            for i, smallest in enumerate(kept):
                for value in pc.unique(batch.column(i).drop_null()).to_pylist():
                    entry = hashlib.md5(value.encode("utf-8", "surrogatepass")).hexdigest(), value
                    if len(smallest) < k or entry < smallest[-1]:
                        at = bisect(smallest, entry)
                        if not at or smallest[at - 1] != entry:
                            insort(smallest, entry)
                            del smallest[k:]
        rows = [(name, value, digest) for name, smallest in zip(names, kept, strict=True) for digest, value in smallest]
        columns = [pa.array([row[i] for row in rows], type=pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["column_name", "value", "hash"])

    return run


def column_samples(df: DataFrame, k: int = SAMPLE_SIZE) -> DataFrame:
    """The ``k`` distinct values with the smallest MD5 per column: a repeatable sample, from one scan.

    Each task holds k values per column and hands on no more, so what is shuffled follows the number of tasks and not
    the rows or the distinct values.
    """
    texts = df.select(*[_col(c).cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
    found = texts.mapInArrow(_smallest(df.columns, k), "column_name string, value string, hash string").distinct()
    order = Window.partitionBy("column_name").orderBy("hash", "value")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sample_hashes(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``column_name, sample_hash``: SHA-256 of the sampled values in hash order."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "value")))
    values = F.transform(pairs, lambda p: p["value"])
    return samples.groupBy(*(keys or ["column_name"])).agg(
        F.sha2(F.array_join(values, "\x1f"), 256).alias("sample_hash")
    )


def structure_hash(columns: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of the sorted ``name:class`` list, per key (dataset)."""
    names = F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "data_type")))
    return columns.groupBy(*keys).agg(F.sha2(F.array_join(names, ","), 256).alias("structure_hash"))


# --- signatures --------------------------------------------------------------------------------

EMPTY_SAMPLE = ""


def column_signatures(df: DataFrame) -> DataFrame:
    """Long signature: the statistics of every column with its sample hash.

    Two scans, one for the statistics and one for the samples; nothing comes to the driver.
    """
    stats = column_stats(df)
    hashes = sample_hashes(column_samples(df))
    empty = F.sha2(F.lit(EMPTY_SAMPLE), 256)
    return stats.join(hashes, "column_name", "left").withColumn(
        "sample_hash", F.coalesce("sample_hash", empty)
    )


def dataset_signature(columns: DataFrame, name: str) -> DataFrame:
    """One-row signature of a table from its :func:`column_signatures`."""
    entry = F.struct(
        F.col("column_name").alias("key"),
        F.struct(
            F.col("data_type").alias("dtype"),
            "min",
            "max",
            "mean",
            "std",
            F.col("distinct_count").alias("ndist"),
            "sample_hash",
        ).alias("value"),
    )
    names = F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "data_type")))
    return columns.agg(
        base_name(F.lit(name)).alias("name_base"),
        F.count(F.lit(1)).cast("int").alias("columns_count"),
        F.max("rows_count").alias("rows_count"),
        F.sha2(F.array_join(names, ","), 256).alias("structure_hash"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("columns"),
    )


def stored_signatures(columns: DataFrame) -> DataFrame:
    """One signature per dataset from long column signatures ``dataset_id, name_base, column_name, data_type, sample_hash``.

    Statistics are kept where ``columns`` has them.
    """
    stats = {"min": "double", "max": "double", "mean": "double", "std": "double", "distinct_count": "bigint"}
    values = [
        (F.col(c) if c in columns.columns else F.lit(None)).cast(kind).alias("ndist" if c == "distinct_count" else c)
        for c, kind in stats.items()
    ]
    entry = F.struct(
        F.col("column_name").alias("key"),
        F.struct(F.col("data_type").alias("dtype"), *values, "sample_hash").alias("value"),
    )
    names = F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "data_type")))
    return columns.groupBy("dataset_id").agg(
        F.min("name_base").alias("name_base"),
        F.count(F.lit(1)).cast("int").alias("columns_count"),
        F.sha2(F.array_join(names, ","), 256).alias("structure_hash"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("columns"),
    )


def latest_signatures(signatures: DataFrame) -> DataFrame:
    """The newest stored signature of every dataset (ties by id)."""
    fields = [c for c in signatures.columns if c != "dataset_id"]
    newest = F.max_by(F.struct(*fields), F.struct("created_at", "id"))
    return signatures.groupBy("dataset_id").agg(newest.alias("s")).select("dataset_id", "s.*")


def signature_status(datasets: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per dataset: has it a signature, which, the start of its hash, its date."""
    latest = latest_signatures(signatures.select("dataset_id", "id", "structure_hash", "created_at"))
    return datasets.select("dataset_id").join(latest, "dataset_id", "left").select(
        "dataset_id",
        F.col("id").isNotNull().alias("has_signature"),
        F.col("id").alias("signature_id"),
        F.substring("structure_hash", 1, 16).alias("signature_hash"),
        F.col("created_at").alias("signature_date"),
    )
