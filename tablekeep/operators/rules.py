"""Rule sets: one normal form, validation, and binding to a schema.

A rule set arrives as ``{"duplicates", "regex", "deequ"}`` in any of the
accepted shapes, either as one literal on the driver (:func:`parse_rules`) or
as a JSON column of many stored runs (:func:`normalise_rule_sets`).
"""

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.functions.vocab import PATTERNS

CONSTRAINT = "constraint"
REGEX = "regex"
DUPLICATES = "duplicates"
CONSTRAINT_CHECKS = ["completeness", "min", "max", "allowed_values"]
ROW_DUPLICATES = "row_duplicates"
COLUMN_DUPLICATES = "column_duplicates"

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("values", T.ArrayType(T.StringType())),
    ]
)


# A rule set that is no JSON object.
UNREADABLE = "unreadable"
UNREADABLE_PROBLEM = "the rule set is no JSON object"
# Texts of a flag that is not set.
NOT_SET = ("", "false", "0", "0.0", "none", "null")


@dataclass(frozen=True)
class Rule:
    """One check on one column (no column for whole-row duplicates)."""

    rule_id: str
    family: str
    check: str
    column: str | None = None
    threshold: float | None = None
    values: tuple[str, ...] | None = None
    problem: str | None = None

    @property
    def check_name(self) -> str:
        return f"regex_{self.check}" if self.family == REGEX else self.check


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _values(value) -> tuple[str, ...] | None:
    if value is None:
        return None
    if isinstance(value, str):
        return tuple(item.strip() for item in value.split(",") if item.strip())
    return tuple(str(item) for item in value)


def _listed(value) -> list:
    """A single text counts as a list of one."""
    return [value] if isinstance(value, str) else list(value or [])


def _flag(value) -> bool:
    return str(value).strip().lower() not in NOT_SET


def _regex_pairs(spec) -> list[tuple[str | None, str | None]]:
    """(column, pattern) pairs; a dict with a pattern name as key lists columns."""
    if isinstance(spec, dict):
        by_pattern = any(key in PATTERNS for key in spec)
        pairs = [(key, item) for key, items in spec.items() for item in _listed(items)]
        return [(item, key) for key, item in pairs] if by_pattern else pairs
    return [(item.get("column"), item.get("rule_type")) for item in spec or []]


def parse_rules(spec: dict | str) -> list[Rule]:
    """Normal form of one rule set, in the order constraints, regex, duplicates.

    A text that is no JSON object gives one rule that cannot run.
    """
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError:
            spec = None
    if not isinstance(spec, dict):
        return [Rule("r001", UNREADABLE, UNREADABLE)]
    found = []
    for item in spec.get("deequ") or spec.get("constraints") or []:
        check, threshold = item.get("type"), _number(item.get("threshold"))
        if check == "completeness" and "threshold" not in item:
            threshold = 1.0
        found.append((CONSTRAINT, check, item.get("column"), threshold, _values(item.get("values"))))
    for column, pattern in _regex_pairs(spec.get("regex")):
        found.append((REGEX, pattern, column, None, None))
    duplicates = spec.get("duplicates") or {}
    if isinstance(duplicates, list):
        duplicates = {"sensitive": duplicates, "full_row": False}
    for column in _listed(duplicates.get("sensitive")):
        found.append((DUPLICATES, COLUMN_DUPLICATES, column, None, None))
    if _flag(duplicates.get("full_row", "")):
        found.append((DUPLICATES, ROW_DUPLICATES, None, None, None))
    return [Rule(f"r{i:03d}", *rule) for i, rule in enumerate(found, 1)]


def _is_blank(text: str | None) -> bool:
    return text is None or not text.strip()


def rule_problem(rule: Rule) -> str | None:
    """Why a rule cannot run, whatever the table; None when it can."""
    if rule.family == UNREADABLE:
        return UNREADABLE_PROBLEM
    if rule.check == ROW_DUPLICATES:
        return None
    if _is_blank(rule.column):
        return "no column named"
    if rule.family == REGEX and rule.check not in PATTERNS:
        return f"unknown pattern '{rule.check}'"
    if rule.family == CONSTRAINT:
        if rule.check not in CONSTRAINT_CHECKS:
            return f"unknown check '{rule.check}'"
        if rule.check == "allowed_values" and all(map(_is_blank, rule.values or ())):
            return "at least one allowed value is needed"
        finite = rule.threshold is not None and math.isfinite(rule.threshold)
        if rule.check == "completeness" and not (finite and 0 <= rule.threshold <= 1):
            return "threshold must be between 0 and 1"
        if rule.check in ("min", "max") and not finite:
            return "threshold must be a finite number"
    return None


def bind_rules(rules: list[Rule], schema: T.StructType) -> list[Rule]:
    """Mark the rules that cannot run on a table with this schema."""
    bound = []
    for rule in rules:
        problem = rule_problem(rule)
        if problem is None and rule.check != ROW_DUPLICATES:
            if rule.column not in schema.names:
                problem = f"column '{rule.column}' not found"
            elif rule.check in ("min", "max"):
                kind = schema[rule.column].dataType
                if not isinstance(kind, (T.NumericType, T.StringType)):
                    problem = f"column '{rule.column}' is not numeric"
        bound.append(replace(rule, problem=problem))
    return bound


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A literal rule set as rows."""
    rows = [
        (r.rule_id, r.family, r.check, r.column, r.threshold, list(r.values) if r.values else None)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


# --- many stored rule sets at once -------------------------------------------------------------

_CONSTRAINT_ITEM = "struct<type:string,column:string,threshold:string,values:string>"


def _json(column: str, path: str) -> Column:
    return F.get_json_object(column, path)


def _rule(family: Column, check: Column, column: Column, threshold=None, values=None) -> Column:
    return F.struct(
        family.alias("family"),
        check.alias("check"),
        column.alias("column"),
        (F.lit(None) if threshold is None else threshold).cast("double").alias("threshold"),
        (F.lit(None) if values is None else values).cast("array<string>").alias("values"),
    )


def normalise_rule_sets(runs: DataFrame, json_column: str = "rules") -> DataFrame:
    """One row per rule for a table of stored rule sets (one JSON text per row).

    Keeps the other columns of ``runs`` and adds ``position`` plus the columns of
    a rule. Accepts the same shapes as :func:`parse_rules`; a text that is no JSON
    object gives one row that cannot run, a null none.
    """
    constraints = F.from_json(
        F.coalesce(_json(json_column, "$.deequ"), _json(json_column, "$.constraints")),
        "array<string>",
    )

    def constraint(text: Column) -> Column:
        item = F.from_json(text, _CONSTRAINT_ITEM)
        number = item["threshold"].try_cast("double")
        # A threshold that is left out counts as 1, one that is null as missing.
        named = F.array_contains(F.json_object_keys(text), "threshold")
        number = F.when((item["type"] == "completeness") & ~named, F.lit(1.0)).otherwise(number)
        commas = F.filter(
            F.transform(F.split(item["values"], ","), lambda v: F.trim(v)), lambda v: v != ""
        )
        values = F.when(
            F.startswith(item["values"], F.lit("[")),
            F.coalesce(F.from_json(item["values"], "array<string>"), commas),
        ).otherwise(commas)
        return _rule(F.lit(CONSTRAINT), item["type"], item["column"], number, values)

    def listed(text: Column) -> Column:
        many = F.from_json(text, "array<string>")
        return F.when(F.startswith(text, F.lit("[")), many).when(text.isNotNull(), F.array(text))

    regex_text = _json(json_column, "$.regex")
    regex_list = F.from_json(regex_text, "array<struct<column:string,rule_type:string>>")
    regex_map = F.from_json(
        F.when(~F.startswith(regex_text, F.lit("[")), regex_text), "map<string,string>"
    )
    names = F.array(*[F.lit(name) for name in PATTERNS])
    by_pattern = F.arrays_overlap(F.map_keys(regex_map), names)
    from_map = F.flatten(
        F.transform(
            F.map_entries(regex_map),
            lambda entry: F.transform(
                F.coalesce(listed(entry["value"]), F.array().cast("array<string>")),
                lambda item: _rule(
                    F.lit(REGEX),
                    F.when(by_pattern, entry["key"]).otherwise(item),
                    F.when(by_pattern, item).otherwise(entry["key"]),
                ),
            ),
        )
    )
    from_list = F.transform(
        regex_list, lambda item: _rule(F.lit(REGEX), item["rule_type"], item["column"])
    )
    regex = F.when(F.startswith(regex_text, F.lit("[")), from_list).otherwise(from_map)

    duplicates_text = _json(json_column, "$.duplicates")
    sensitive = F.when(
        F.startswith(duplicates_text, F.lit("[")), F.from_json(duplicates_text, "array<string>")
    ).otherwise(listed(_json(json_column, "$.duplicates.sensitive")))
    column_duplicates = F.transform(
        sensitive, lambda column: _rule(F.lit(DUPLICATES), F.lit(COLUMN_DUPLICATES), column)
    )
    row_duplicates = F.when(
        ~F.lower(F.trim(_json(json_column, "$.duplicates.full_row"))).isin(list(NOT_SET)),
        F.array(_rule(F.lit(DUPLICATES), F.lit(ROW_DUPLICATES), F.lit(None).cast("string"))),
    )
    kind = (
        "array<struct<family:string,check:string,column:string,threshold:double,"
        "values:array<string>>>"
    )
    is_object = F.schema_of_variant(F.try_parse_json(json_column)).startswith("OBJECT")
    unreadable = F.when(
        F.col(json_column).isNotNull() & ~F.coalesce(is_object, F.lit(False)),
        F.array(_rule(F.lit(UNREADABLE), F.lit(UNREADABLE), F.lit(None).cast("string"))),
    )
    parts = [
        F.coalesce(part.cast(kind), F.array().cast(kind))
        for part in (
            F.transform(constraints, constraint),
            regex,
            column_duplicates,
            row_duplicates,
            unreadable,
        )
    ]
    kept = [c for c in runs.columns if c != json_column]
    return runs.select(*kept, F.posexplode(F.concat(*parts)).alias("position", "rule")).select(
        *kept, (F.col("position") + 1).alias("position"), "rule.*"
    )


def validate_rule_rows(rules: DataFrame) -> DataFrame:
    """Add ``problem`` (null when the rule can run), as :func:`rule_problem` does."""
    check, threshold = F.col("check"), F.col("threshold")
    # A threshold of NaN or infinity is not between two finite bounds either.
    finite = threshold.isNotNull() & ~F.isnan(threshold) & (F.abs(threshold) < float("inf"))
    constraint, regex = F.col("family") == CONSTRAINT, F.col("family") == REGEX
    problem = (
        F.when(F.col("family") == UNREADABLE, F.lit(UNREADABLE_PROBLEM))
        .when(check == ROW_DUPLICATES, F.lit(None))
        .when(F.coalesce(F.trim("column"), F.lit("")) == "", F.lit("no column named"))
        .when(
            regex & ~F.coalesce(check, F.lit("")).isin(list(PATTERNS)),
            F.concat(F.lit("unknown pattern '"), check, F.lit("'")),
        )
        .when(
            constraint & ~F.coalesce(check, F.lit("")).isin(CONSTRAINT_CHECKS),
            F.concat(F.lit("unknown check '"), check, F.lit("'")),
        )
        .when(
            (check == "allowed_values")
            & ~F.coalesce(F.exists("values", lambda v: F.trim(v) != ""), F.lit(False)),
            F.lit("at least one allowed value is needed"),
        )
        .when(
            (check == "completeness") & ~(finite & threshold.between(0, 1)),
            F.lit("threshold must be between 0 and 1"),
        )
        .when(check.isin("min", "max") & ~finite, F.lit("threshold must be a finite number"))
    )
    return rules.withColumn("problem", problem)


def bind_rule_rows(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """Add the schema problems, for rules over many datasets at once.

    ``columns`` lists ``dataset_id, column_name`` (one row per column); a rule whose
    column is not among them gets a ``problem``.
    """
    known = columns.select("dataset_id", F.col("column_name").alias("column"), F.lit(True).alias("_known"))
    missing = F.concat(F.lit("column '"), F.col("column"), F.lit("' not found"))
    return (
        rules.join(known, ["dataset_id", "column"], "left")
        .withColumn(
            "problem",
            F.coalesce(
                "problem",
                F.when(F.col("_known").isNull() & (F.col("check") != ROW_DUPLICATES), missing),
            ),
        )
        .drop("_known")
    )
