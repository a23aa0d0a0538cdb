"""Check results: one vocabulary, run documents, summaries and tags."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.functions.rounding import round_exact
from tablekeep.functions.vocab import (
    DQ_FAILED,
    DQ_SUCCESS,
    DQ_WARNING,
    FAILED,
    FAILURE_WORDS,
    PASSED,
    STATUS_WORDS,
    SUCCESS_WORDS,
    TAG_FAILURE_WORDS,
    TAG_SUCCESS_WORDS,
    UNKNOWN,
)

CHECK_TYPE = T.StructType(
    [
        T.StructField("rule_type", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("ratio", T.StringType()),
        T.StructField("examples", T.ArrayType(T.StringType())),
    ]
)
RUN_SCHEMA = T.StructType(
    [
        T.StructField("dag_run_id", T.StringType()),
        T.StructField("dataset_version_id", T.StringType()),
        T.StructField("execution_date", T.StringType()),
        T.StructField("checks", T.ArrayType(CHECK_TYPE)),
    ]
)


def _word(status: Column | str) -> Column:
    column = F.col(status) if isinstance(status, str) else status
    return F.lower(F.coalesce(column, F.lit("")))


def map_status(status: Column | str) -> Column:
    """Any accepted status word as passed / failed / skipped, else unknown."""
    word, mapped = F.trim(_word(status)), F.lit(UNKNOWN)
    for target in dict.fromkeys(STATUS_WORDS.values()):
        words = [w for w, t in STATUS_WORDS.items() if t == target]
        mapped = F.when(word.isin(words), F.lit(target)).otherwise(mapped)
    return mapped


def parse_ratio(ratio: Column | str) -> Column:
    """``"x/y"`` or a plain number as a double; a zero divisor or junk gives 0."""
    text = F.col(ratio) if isinstance(ratio, str) else ratio
    parts = F.split(text, "/")
    first = F.trim(parts[0]).try_cast("double")
    second = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    value = F.when(F.size(parts) == 1, first).when(
        (F.size(parts) == 2) & (second > 0), first / second
    )
    return F.coalesce(value, F.lit(0.0))


def is_alert(status: Column | str) -> Column:
    """True for a failed check."""
    return map_status(status) == FAILED


def quality_tag(status: Column | str) -> Column:
    """Quality tag of one check; anything unclear is a warning."""
    word = _word(status)
    return (
        F.when(word.isin(TAG_SUCCESS_WORDS), F.lit(DQ_SUCCESS))
        .when(word.isin(TAG_FAILURE_WORDS), F.lit(DQ_FAILED))
        .otherwise(F.lit(DQ_WARNING))
    )


def standardise(frames: dict[str, DataFrame]) -> DataFrame:
    """Raw results of several families as one list of checks.

    A frame may leave columns out; a missing ``rule_type`` becomes the family's
    name (the key), a missing count 0 and a missing ratio ``0/0``.
    """
    defaults = {
        "column_name": F.lit(None).cast("string"),
        "status": F.lit(None).cast("string"),
        "error_count": F.lit(0),
        "ratio": F.lit("0/0"),
        "examples": F.array().cast("array<string>"),
    }
    out = None
    for family, frame in frames.items():
        kept = [c for c in ("run_id", "version_id") if c in frame.columns]

        def field(name: str, default: Column, frame: DataFrame = frame) -> Column:
            return F.coalesce(F.col(name), default) if name in frame.columns else default

        part = frame.select(
            *kept,
            field("rule_type", F.lit(family)).alias("rule_type"),
            field("column_name", defaults["column_name"]).alias("column_name"),
            map_status(field("status", defaults["status"])).alias("status"),
            field("error_count", defaults["error_count"]).cast("bigint").alias("error_count"),
            field("ratio", defaults["ratio"]).alias("ratio"),
            field("examples", defaults["examples"]).alias("examples"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def checks_of(results: DataFrame) -> DataFrame:
    """Rule-engine results as standard checks."""
    return results.select(
        F.col("check_name").alias("rule_type"),
        "column_name",
        "status",
        "error_count",
        "ratio",
        "examples",
    )


def run_documents(checks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One document per run: the standard checks of ``checks`` nested below its keys.

    A run holds one check per rule, so a document stays as small as its rule set.
    """
    keys = keys or ["dag_run_id", "dataset_version_id", "execution_date"]
    check = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHECK_TYPE.fields])
    return checks.groupBy(*keys).agg(F.array_sort(F.collect_list(check)).alias("checks"))


def flatten_documents(documents: DataFrame) -> DataFrame:
    """One row per check of every run document; a run without checks gives none."""
    return documents.select(
        "dag_run_id", "dataset_version_id", "execution_date", F.inline("checks")
    )


def stored_results(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """Typed result rows of the checks whose run is known.

    ``runs`` maps ``dag_run_id`` to ``id`` (and its ``dataset_version_id`` is the
    check's own): a document is only attached to the version it was run for.
    """
    known = runs.select("dag_run_id", F.col("id").alias("dag_run_uuid"))
    return checks.join(known, "dag_run_id").select(
        "dag_run_uuid",
        "dataset_version_id",
        F.coalesce("rule_type", F.lit("unknown")).alias("validator_name"),
        F.coalesce("rule_type", F.lit("unknown")).alias("check_type"),
        "column_name",
        map_status("status").alias("status"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        parse_ratio("ratio").alias("ratio"),
        is_alert("status").alias("alert"),
        F.to_json(F.coalesce("examples", F.array().cast("array<string>"))).alias("examples"),
    )


def quality_summary(checks: DataFrame, key: str = "version_id") -> DataFrame:
    """Counts, success rate, readable text and fallback tag per version."""
    word, rows = _word("status"), F.count(F.lit(1))
    summary = checks.groupBy(key).agg(
        rows.alias("total"),
        F.count_if(word.isin(SUCCESS_WORDS)).alias("success"),
        F.count_if(word.isin(FAILURE_WORDS)).alias("failed"),
    )
    summary = summary.withColumn("warnings", F.expr("total - success - failed")).withColumn(
        "success_rate", round_exact(F.col("success") / F.col("total") * 100, 1)
    )
    text = F.concat(
        F.lit("✅ "),
        F.col("success").cast("string"),
        F.lit("/"),
        F.col("total").cast("string"),
        F.lit(" ("),
        F.format_string("%.1f", "success_rate"),
        F.lit("%) | ❌ "),
        F.col("failed").cast("string"),
        F.lit(" | ⚠️ "),
        F.col("warnings").cast("string"),
    )
    tag = F.when(F.col("failed") == 0, F.lit(DQ_SUCCESS)).otherwise(F.lit(DQ_WARNING))
    return summary.withColumn("summary_text", text).withColumn("fallback_tag", tag)


def report_summary(checks: DataFrame, key: str = "version_id") -> DataFrame:
    """Summary as a report shows it: only checks with a status, N/A when there are none."""
    stated = F.col("status").isNotNull() & (F.col("status") != "")
    mapped = map_status("status")
    summary = checks.groupBy(key).agg(
        F.count_if(stated).alias("total"),
        F.count_if(mapped == PASSED).alias("success"),
        F.count_if(mapped == FAILED).alias("failed"),
    )
    percent = F.col("success") / F.nullif("total", F.lit(0)) * 100
    # Only quarters lie exactly between two tenths; a report rounds those up.
    tie = (percent * 4) % 1 == 0
    rounded = F.when(tie, F.round(percent, 1)).otherwise(round_exact(percent, 1))
    rate = F.format_string("%.1f%%", rounded)
    return summary.withColumn(
        "rate", F.when(F.col("total") > 0, rate).otherwise(F.lit("N/A"))
    ).withColumn("colour", F.when(F.col("failed") > 0, F.lit("red")).otherwise(F.lit("green")))
