"""Running a rule set over a table.

All constraints and patterns share one aggregate, so a table is scanned once
however many rules it has; the examples of the failing rules take a second
scan that keeps at most a few values per rule and task.
"""

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablekeep.functions.faults import data_fault
from tablekeep.functions.lineage import cut_lineage
from tablekeep.functions.vocab import (
    BLANK_EXAMPLE,
    FAILED,
    NULL_EXAMPLE,
    PASSED,
    PATTERNS,
    SKIPPED,
)
from tablekeep.operators.rules import (
    COLUMN_DUPLICATES,
    DUPLICATES,
    REGEX,
    ROW_DUPLICATES,
    Rule,
    bind_rules,
    parse_rules,
)

MAX_EXAMPLES = 5
# Rules per aggregate: more would leave generated methods too long to compile.
RULES_PER_PASS = 80

RESULT_COLUMNS = [
    "rule_id",
    "family",
    "check_name",
    "column_name",
    "status",
    "error_count",
    "total_count",
    "ratio",
    "null_count",
    "blank_count",
    "examples",
    "message",
]


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _text(rule: Rule) -> Column:
    return _col(rule.column).cast("string")


def _number(rule: Rule, schema: T.StructType) -> Column:
    column = _col(rule.column)
    if isinstance(schema[rule.column].dataType, T.StringType):
        return column.try_cast("double")
    return column


def _usable(rule: Rule) -> Column:
    text = F.trim(_text(rule))
    return text.isNotNull() & (text != "") & (text != "NULL")


def failure_condition(rule: Rule, schema: T.StructType) -> Column:
    """True for the rows counted as errors once the rule has failed."""
    if rule.family == REGEX:
        return _usable(rule) & ~F.trim(_text(rule)).rlike(PATTERNS[rule.check])
    if rule.check == "completeness":
        return _text(rule).isNull() | (F.trim(_text(rule)) == "")
    if rule.check == "min":
        return _number(rule, schema) < F.lit(rule.threshold)
    if rule.check == "max":
        return _number(rule, schema) > F.lit(rule.threshold)
    return _text(rule).isNull() | ~_text(rule).isin(list(rule.values))


def _example_value(rule: Rule) -> Column:
    text = F.trim(_text(rule)) if rule.family == REGEX else _text(rule)
    value = F.coalesce(text, F.lit(NULL_EXAMPLE))
    if rule.check == "completeness":
        value = F.when(F.trim(value) == "", F.lit(BLANK_EXAMPLE)).otherwise(value)
    return value


def _constraint_pass(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Results of one group of rules from a single aggregate."""
    schema, aggs = df.schema, {"n": F.count(F.lit(1))}
    for i, rule in enumerate(rules):
        text = _text(rule)
        aggs[f"bad{i}"] = F.count_if(failure_condition(rule, schema))
        aggs[f"nulls{i}"] = F.count_if(text.isNull())
        aggs[f"blanks{i}"] = F.count_if(F.trim(text) == "")
        if rule.family == REGEX:
            aggs[f"used{i}"] = F.count_if(_usable(rule))
        elif rule.check in ("min", "max"):
            aggs[f"edge{i}"] = getattr(F, rule.check)(_number(rule, schema))
    stats = df.agg(*[expr.alias(name) for name, expr in aggs.items()])

    rows = []
    for i, rule in enumerate(rules):
        n, bad = F.col("n"), F.col(f"bad{i}")
        total = n
        if rule.family == REGEX:
            total, passed = F.col(f"used{i}"), bad == 0
        elif rule.check == "completeness":
            passed = (n - F.col(f"nulls{i}")) / F.nullif(n, F.lit(0)) >= F.lit(rule.threshold)
        elif rule.check == "min":
            passed = F.col(f"edge{i}") >= F.lit(rule.threshold)
        elif rule.check == "max":
            passed = F.col(f"edge{i}") <= F.lit(rule.threshold)
        else:
            passed = (n > 0) & (bad == F.col(f"nulls{i}"))
        passed = F.coalesce(passed, F.lit(False))
        rows.append(
            _result(
                rule,
                F.when(passed, F.lit(PASSED)).otherwise(F.lit(FAILED)),
                F.when(passed, F.lit(0).cast("bigint")).otherwise(bad),
                total,
                F.col(f"nulls{i}"),
                F.col(f"blanks{i}"),
            )
        )
    return stats.select(F.inline(F.array(*rows)))


def _result(
    rule: Rule,
    status: Column,
    errors: Column,
    total: Column,
    nulls: Column | None = None,
    blanks: Column | None = None,
    message: str | None = None,
) -> Column:
    errors, total = errors.cast("bigint"), total.cast("bigint")
    none = F.lit(None)
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.family).alias("family"),
        F.lit(rule.check_name).alias("check_name"),
        F.lit(rule.column).cast("string").alias("column_name"),
        status.alias("status"),
        errors.alias("error_count"),
        total.alias("total_count"),
        F.concat_ws("/", errors.cast("string"), total.cast("string")).alias("ratio"),
        (none if nulls is None else nulls).cast("bigint").alias("null_count"),
        (none if blanks is None else blanks).cast("bigint").alias("blank_count"),
        F.lit(message).cast("string").alias("message"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _groups(rules: list[Rule]) -> list[list[Rule]]:
    return [rules[i : i + RULES_PER_PASS] for i in range(0, len(rules), RULES_PER_PASS)]


def constraint_results(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Completeness, minimum, maximum, allowed values and patterns, without examples."""
    return _union([_constraint_pass(df, group) for group in _groups(rules)])


def failing_examples(df: DataFrame, rules: list[Rule], k: int = MAX_EXAMPLES) -> DataFrame:
    """Up to ``k`` failing values per rule, smallest first: ``rule_id, examples``.

    Missing and disallowed values repeat a lot, so they are counted inside the
    tasks first; allowed-value examples are distinct, the others may repeat. For
    the remaining rules the window keeps k rows per rule in every task before
    anything is shuffled.
    """

    def failing(some: list[Rule]) -> DataFrame:
        hits = [
            F.when(
                failure_condition(rule, df.schema),
                F.struct(F.lit(rule.rule_id).alias("rule_id"), _example_value(rule).alias("value")),
            )
            for rule in some
        ]
        return df.select(F.inline(F.array(*hits))).filter(F.col("rule_id").isNotNull())

    counted = [r for r in rules if r.check in ("completeness", "allowed_values")]
    once = [r.rule_id for r in counted if r.check == "allowed_values"]
    frames = []
    for group in _groups([r for r in rules if r not in counted]):
        frames.append(failing(group))
    for group in _groups(counted):
        copies = F.when(F.col("rule_id").isin(once), F.lit(1)).otherwise(F.least("n", F.lit(k)))
        counts = failing(group).groupBy("rule_id", "value").agg(F.count(F.lit(1)).alias("n"))
        values = F.array_repeat("value", copies.cast("int"))
        frames.append(counts.select("rule_id", F.explode(values).alias("value")))
    order = Window.partitionBy("rule_id").orderBy("value")
    return _ranked_examples(_union(frames).withColumn("rank", F.row_number().over(order)), k)


def _ranked_examples(ranked: DataFrame, k: int) -> DataFrame:
    kept = ranked.filter(F.col("rank") <= k)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return kept.groupBy("rule_id").agg(
        F.transform(pairs, lambda pair: pair["value"]).alias("examples")
    )


def _with_examples(results: DataFrame, examples: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    found = F.when(F.col("status") == FAILED, F.col("examples"))
    return results.join(examples, "rule_id", "left").withColumn("examples", F.coalesce(found, none))


def check_constraints(df: DataFrame, rules: list[Rule], k: int = MAX_EXAMPLES) -> DataFrame:
    """Constraint and pattern results with examples."""
    results = _with_examples(constraint_results(df, rules), failing_examples(df, rules, k))
    return results.select(*RESULT_COLUMNS)


# --- duplicates --------------------------------------------------------------------------------


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name`` with one typed slot per data type, and ``occurrences``.

    One scan serves every column: each value goes to the slot of its own type,
    so nothing is compared as text and the grouping stays exact. Counts are
    merged inside the tasks first, so a value held by a third of the rows is
    shuffled once per task.
    """
    schema = df.schema
    kinds = list(dict.fromkeys(schema[c].dataType.simpleString() for c in columns))
    slots = [f"slot{i}" for i in range(len(kinds))]

    def entry(column: str) -> Column:
        own = kinds.index(schema[column].dataType.simpleString())
        values = [
            (_col(column) if i == own else F.lit(None).cast(schema_kind)).alias(slots[i])
            for i, schema_kind in enumerate(kinds)
        ]
        return F.struct(F.lit(column).alias("column_name"), *values)

    long = df.select(F.inline(F.array(*[entry(c) for c in columns])))
    counts = long.groupBy("column_name", *slots).agg(F.count(F.lit(1)).alias("occurrences"))
    text = F.coalesce(*[F.col(s).cast("string") for s in slots])
    return counts.select("column_name", text.alias("value"), "occurrences")


def duplicate_values(df: DataFrame, columns: list[str], k: int = MAX_EXAMPLES) -> DataFrame:
    """``column_name, duplicates, rows, examples``: distinct values that occur again.

    A repeated null counts as one value unless the column holds nothing else.
    Examples are the most frequent values.
    """
    counts = value_counts(df, columns)
    repeated = F.col("occurrences") > 1
    summary = counts.groupBy("column_name").agg(
        F.count_if(repeated).alias("repeated"),
        F.sum("occurrences").alias("rows"),
        F.count("value").alias("values"),
    )
    order = Window.partitionBy("column_name").orderBy(F.desc("occurrences"), F.asc("value"))
    ranked = (
        counts.filter(repeated)
        .withColumn("rank", F.row_number().over(order))
        .withColumn("value", F.coalesce("value", F.lit(NULL_EXAMPLE)))
        .withColumnRenamed("column_name", "rule_id")
    )
    examples = _ranked_examples(ranked, k).withColumnRenamed("rule_id", "column_name")
    return summary.join(examples, "column_name", "left").select(
        "column_name",
        F.when(F.col("values") == 0, F.lit(0).cast("bigint"))
        .otherwise(F.col("repeated"))
        .alias("duplicates"),
        "rows",
        F.when(F.col("values") > 0, F.col("examples")).alias("examples"),
    )


def check_column_duplicates(df: DataFrame, rules: list[Rule], k: int = MAX_EXAMPLES) -> DataFrame:
    """One result per column-duplicates rule."""
    rows = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.column).alias("c")) for r in rules]
    spark = df.sparkSession
    wanted = spark.range(1).select(F.inline(F.array(*rows)))
    found = duplicate_values(df, sorted({r.column for r in rules}), k)
    joined = wanted.join(found, wanted["c"] == found["column_name"], "left")
    errors = F.coalesce("duplicates", F.lit(0)).cast("bigint")
    total = F.coalesce("rows", F.lit(0)).cast("bigint")
    return joined.select(
        "rule_id",
        F.lit(DUPLICATES).alias("family"),
        F.lit(COLUMN_DUPLICATES).alias("check_name"),
        F.col("c").alias("column_name"),
        F.when(errors > 0, F.lit(FAILED)).otherwise(F.lit(PASSED)).alias("status"),
        errors.alias("error_count"),
        total.alias("total_count"),
        F.concat_ws("/", errors.cast("string"), total.cast("string")).alias("ratio"),
        F.lit(None).cast("bigint").alias("null_count"),
        F.lit(None).cast("bigint").alias("blank_count"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        F.lit(None).cast("string").alias("message"),
    )


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(field.dataType) for field in kind.fields)
    return False


def repeated_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, each with its ``occurrences``.

    Equal rows have equal hashes, so a first pass shuffles only 8-byte hashes, counted
    inside the tasks first, and the exact grouping then sees nothing but rows whose hash
    repeats. Tables with a map column, which cannot be hashed, are grouped at once.
    """
    candidates = df
    if not any(_has_map(field.dataType) for field in df.schema.fields):
        row_hash = F.xxhash64(*[_col(c) for c in df.columns])
        hashes = (
            df.select(row_hash.alias("_hash"))
            .groupBy("_hash")
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1)
            .select("_hash")
        )
        candidates = (
            df.withColumn("_hash", row_hash).join(hashes, "_hash", "left_semi").drop("_hash")
        )
    return (
        candidates.groupBy(*[_col(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def duplicate_rows(df: DataFrame, k: int = MAX_EXAMPLES) -> DataFrame:
    """One row ``duplicates, rows, examples``: surplus copies, the table's rows, JSON examples."""
    groups = repeated_rows(df)
    surplus = groups.agg(
        F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).cast("bigint").alias("duplicates")
    )
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    as_json = F.to_json(F.struct(*[_col(c) for c in df.columns]))
    top = groups.select("occurrences", as_json.alias("value")).orderBy(F.desc("occurrences"), "value")
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("n"), "value")))
    examples = top.limit(k).agg(F.transform(pairs, lambda p: p["value"]).alias("examples"))
    # three one-row frames in one aggregate, each column set in exactly one of them
    return (
        surplus.unionByName(total, allowMissingColumns=True)
        .unionByName(examples, allowMissingColumns=True)
        .agg(
            F.max("duplicates").alias("duplicates"),
            F.max("rows").alias("rows"),
            F.first("examples", ignorenulls=True).alias("examples"),
        )
    )


def check_row_duplicates(df: DataFrame, rule: Rule, k: int = MAX_EXAMPLES) -> DataFrame:
    """Result of the whole-row duplicates rule; an empty table passes with 0/0."""
    errors = F.col("duplicates")
    status = F.when(errors > 0, F.lit(FAILED)).otherwise(F.lit(PASSED))
    return (
        duplicate_rows(df, k)
        .select(_result(rule, status, errors, F.col("rows")).alias("r"), "examples")
        .select("r.*", "examples")
        .select(*RESULT_COLUMNS)
    )


# --- whole rule sets ---------------------------------------------------------------------------


def skipped_results(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Results of rules that cannot run: nothing counted, the reason in ``message``."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    rows = [
        _result(
            rule,
            F.lit(SKIPPED),
            zero,
            zero if rule.family == REGEX else F.col("n"),
            message=rule.problem,
        )
        for rule in rules
    ]
    return (
        n.select(F.inline(F.array(*rows)))
        .withColumn("examples", F.array().cast("array<string>"))
        .select(*RESULT_COLUMNS)
    )


def technical_failures(df: DataFrame, failed: list[tuple[Rule, str]]) -> DataFrame:
    """Results of rules that cannot be evaluated on this table: every row counts as an error."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    rows = [
        _result(rule, F.lit(FAILED), F.col("n"), F.col("n"), message=message[:200])
        for rule, message in failed
    ]
    return (
        n.select(F.inline(F.array(*rows)))
        .withColumn("examples", F.array("message"))
        .select(*RESULT_COLUMNS)
    )


def isolate(
    make: Callable[[list[Rule]], DataFrame], rules: list[Rule]
) -> tuple[list[DataFrame], list[tuple[Rule, str]]]:
    """Results of ``make(rules)``, run at once, and the rules whose evaluation raises with the reason.

    All rules share one run. Only if it raises over the data is the group halved, until a bad rule stands alone, so one
    bad rule among n costs log2(n) more runs and the others stay together. Errors that are no fault of the data, such
    as a lost executor, are raised.
    """
    if not rules:
        return [], []
    try:
        return [cut_lineage(make(rules))], []
    except (PySparkException, Py4JJavaError) as error:
        message = data_fault(error)
        if message is None:
            raise
    if len(rules) == 1:
        return [], [(rules[0], message)]
    half = len(rules) // 2
    first, second = isolate(make, rules[:half]), isolate(make, rules[half:])
    return first[0] + second[0], first[1] + second[1]


def _failed_examples(df: DataFrame, frames: list[DataFrame], rules: list[Rule], k: int) -> list[DataFrame]:
    """Results with examples, which are gathered for the rules that failed only."""
    out = []
    by_id = {r.rule_id: r for r in rules}
    for frame in frames:
        failed = [by_id[r.rule_id] for r in frame.filter(F.col("status") == FAILED).select("rule_id").collect()]
        if failed:
            out.append(_with_examples(frame, failing_examples(df, failed, k)))
        else:
            out.append(frame.withColumn("examples", F.array().cast("array<string>")))
    return [frame.select(*RESULT_COLUMNS) for frame in out]


def validate(df: DataFrame, rules: list[Rule] | dict | str, k: int = MAX_EXAMPLES) -> DataFrame:
    """Run every family of a rule set over one table; one result row per rule.

    The rules are evaluated when this is called. A rule that raises over the data, or that cannot be analysed, fails
    with every row as an error and the reason in ``message``; the others are not touched by it (:func:`isolate`).
    """
    parsed = rules if isinstance(rules, list) else parse_rules(rules)
    bound = bind_rules(parsed, df.schema)
    skipped = [r for r in bound if r.problem]
    runnable = [r for r in bound if not r.problem]
    frames: list[DataFrame] = []
    broken: list[tuple[Rule, str]] = []

    def run(make: Callable[[list[Rule]], DataFrame], some: list[Rule]) -> list[DataFrame]:
        found, bad = isolate(make, some)
        broken.extend(bad)
        return found

    fused = [r for r in runnable if r.family != DUPLICATES]
    frames += _failed_examples(df, run(lambda some: constraint_results(df, some), fused), fused, k)
    by_column = [r for r in runnable if r.check == COLUMN_DUPLICATES]
    frames += run(lambda some: check_column_duplicates(df, some, k), by_column)
    for rule in (r for r in runnable if r.check == ROW_DUPLICATES):
        frames += run(lambda some: check_row_duplicates(df, some[0], k), [rule])
    if skipped:
        frames.append(skipped_results(df, skipped))
    if broken:
        frames.append(technical_failures(df, broken))
    if not frames:
        raise ValueError("the rule set is empty")
    return _union(frames)
