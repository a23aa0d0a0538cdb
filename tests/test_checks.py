import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablekeep.operators import checks as chk
from tablekeep.operators.rules import CONSTRAINT, Rule, bind_rules, parse_rules

SCHEMA = "id int, s string, n double, d decimal(10,2), m map<string,int>, empty string"
ROWS = [
    (1, "a", 1.0, Decimal("1.50"), {"k": 1}, None),
    (2, None, 2.0, Decimal("2.50"), {"k": 1}, None),
    (3, "  ", None, Decimal("3.50"), {"k": 2}, None),
    (4, "b", -5.0, None, None, None),
    (4, "b", -5.0, None, None, None),
    (5, "12", float("nan"), Decimal("9.99"), {}, None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _run(table, *items):
    found = chk.validate(table, {"deequ": list(items)}).orderBy("rule_id").collect()
    return [(r.status, r.error_count, r.ratio, r.examples) for r in found]


def test_completeness_status_ignores_blanks_but_errors_count_them(table):
    assert _run(
        table,
        {"type": "completeness", "column": "s", "threshold": 0.8},
        {"type": "completeness", "column": "s"},
        {"type": "completeness", "column": "empty", "threshold": 0.0},
    ) == [
        ("passed", 0, "0/6", []),
        ("failed", 2, "2/6", ["NULL", "VIDE"]),
        ("passed", 0, "0/6", []),
    ]


def test_minimum_and_maximum(table):
    assert _run(
        table,
        {"type": "min", "column": "n", "threshold": 0},
        {"type": "max", "column": "d", "threshold": 9},
        {"type": "min", "column": "s", "threshold": 13},
        {"type": "min", "column": "empty", "threshold": 0},
    ) == [
        ("failed", 2, "2/6", ["-5.0", "-5.0"]),
        ("failed", 1, "1/6", ["9.99"]),
        ("failed", 1, "1/6", ["12"]),
        ("failed", 0, "0/6", []),
    ]


def test_allowed_values_pass_nulls_but_count_them_on_failure(table):
    assert _run(
        table,
        {"type": "allowed_values", "column": "s", "values": ["a", "b", "  ", "12"]},
        {"type": "allowed_values", "column": "s", "values": ["a", "12"]},
        {"type": "allowed_values", "column": "id", "values": ["1", "2", "3"]},
    ) == [
        ("passed", 0, "0/6", []),
        ("failed", 4, "4/6", ["  ", "NULL", "b"]),
        ("failed", 3, "3/6", ["4", "5"]),
    ]


def test_pattern_total_is_cleaned_rows(spark):
    rows = [("a@b.co",), (" a@b.co ",), ("NULL",), ("",), (None,), ("null",), ("é@b.co",)]
    table = spark.createDataFrame(rows, "mail string")
    row = chk.validate(table, {"regex": {"mail": ["email"]}}).first()
    assert (row.status, row.ratio, row.examples) == ("failed", "2/4", ["null", "é@b.co"])
    none = spark.createDataFrame([("NULL",)], "mail string")
    row = chk.validate(none, {"regex": {"mail": ["email"]}}).first()
    assert (row.status, row.ratio) == ("passed", "0/0")


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    spec = {
        "deequ": [
            {"type": "completeness", "column": "s", "threshold": 0.0},
            {"type": "min", "column": "n", "threshold": 0},
            {"type": "allowed_values", "column": "s", "values": ["a"]},
        ],
        "duplicates": {"sensitive": ["s"], "full_row": True},
    }
    found = chk.validate(table, spec).orderBy("rule_id").collect()
    assert [(r.status, r.ratio) for r in found] == [
        ("failed", "0/0"),
        ("failed", "0/0"),
        ("failed", "0/0"),
        ("passed", "0/0"),
        ("passed", "0/0"),
    ]


def test_many_rules_and_column_names_with_dots(spark):
    table = spark.createDataFrame([(1, None), (2, "x")], "`a.b` int, s string")
    items = [{"type": "min", "column": "a.b", "threshold": i} for i in range(100)]
    items += [{"type": "completeness", "column": "s"}]
    found = chk.validate(table, {"deequ": items}).orderBy("rule_id").collect()
    assert len(found) == 101
    assert [r.status for r in found[:3]] == ["passed", "passed", "failed"]
    assert found[-1].error_count == 1


def test_rules_that_do_not_compile_fail_alone(spark):
    table = spark.createDataFrame([(1, b"x")], "n int, v binary")
    rules = [
        Rule("r1", CONSTRAINT, "min", "n", 0.0),
        Rule("r2", CONSTRAINT, "completeness", "v", 1.0),
    ]
    found = chk.validate(table, rules).orderBy("rule_id").collect()
    assert [r.status for r in found] == ["passed", "passed"]
    broken = chk.technical_failures(table, [(rules[0], "cannot compare")]).first()
    assert (broken.status, broken.ratio, broken.examples) == ("failed", "1/1", ["cannot compare"])


def test_one_scan_for_all_constraints(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as string) s", "id * 2 other").write.parquet(path)
    table = spark.read.parquet(path)
    spec = {
        "deequ": [
            {"type": "min", "column": "id", "threshold": 0},
            {"type": "completeness", "column": "s"},
        ],
        "regex": {"s": ["numeric"]},
    }
    rules = bind_rules(parse_rules(spec), table.schema)
    plan = chk.constraint_results(table, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "other" not in re.findall(r"ReadSchema: \S+", plan)[0]
    examples = chk.failing_examples(table, rules)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in examples


def test_column_duplicates(spark, table):
    found = {r.column_name: r for r in chk.duplicate_values(table, ["id", "s", "n", "empty"]).collect()}
    assert (found["id"].duplicates, found["id"].examples) == (1, ["4"])
    assert (found["n"].duplicates, found["n"].examples) == (1, ["-5.0"])
    assert (found["s"].duplicates, found["empty"].duplicates) == (1, 0)
    nulls = spark.createDataFrame([(None,), (None,), ("x",)], "c string")
    row = chk.duplicate_values(nulls, ["c"]).first()
    assert (row.duplicates, row.rows, row.examples) == (1, 3, ["NULL"])


def test_duplicate_counts_against_brute_force_with_a_hot_value(spark):
    rng = random.Random(5)
    rows = [(7 if rng.random() < 0.4 else rng.randint(0, 300), rng.choice("abcde")) for _ in range(900)]
    table = spark.createDataFrame(rows, "k int, c string").repartition(8)
    found = {r.column_name: r for r in chk.duplicate_values(table, ["k", "c"]).collect()}
    for i, name in enumerate(("k", "c")):
        counts = Counter(r[i] for r in rows)
        assert found[name].duplicates == sum(n > 1 for n in counts.values())
        top = sorted(((-n, str(v)) for v, n in counts.items() if n > 1))[:5]
        assert found[name].examples == [v for _, v in top]
    surplus = len(rows) - len(set(rows))
    row = chk.duplicate_rows(table).first()
    assert (row.duplicates, row["rows"]) == (surplus, len(rows))


def test_row_duplicates_with_map_column(table):
    row = chk.duplicate_rows(table).first()
    assert (row.duplicates, row["rows"], len(row.examples)) == (1, 6, 1)


def test_row_duplicates_need_no_nested_loop(spark):
    table = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    plan = chk.duplicate_rows(table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_that_raise_fail_alone(spark, monkeypatch):
    """Bisection: the good rules share few runs, each bad one is reported with every row as an error."""
    fault = F.raise_error(F.lit("broken value\nand more")).cast("int")
    frame = spark.range(20).select("id", F.when(F.col("id") == 7, fault).otherwise(F.col("id").cast("int")).alias("bad"))
    rules = {
        "deequ": [{"type": "max", "column": "id", "threshold": i} for i in range(12)]
        + [{"type": "min", "column": "bad", "threshold": 0}]
        + [{"type": "completeness", "column": "id"}],
        "duplicates": {"sensitive": ["id", "bad"], "full_row": False},
    }
    runs = []
    plain = chk.constraint_results
    monkeypatch.setattr(chk, "constraint_results", lambda df, some: runs.append(len(some)) or plain(df, some))
    found = chk.validate(frame, rules).collect()
    assert len(found) == 16 and len({r.rule_id for r in found}) == 16
    bad = [r for r in found if r.column_name == "bad"]
    assert {(r.status, r.ratio) for r in bad} == {("failed", "20/20")}
    assert all("broken value" in r.message and r.examples == [r.message] for r in bad)
    good = [r for r in found if r.column_name == "id"]
    assert [r.error_count for r in sorted(good, key=lambda r: r.rule_id)] == [*range(19, 7, -1), 0, 0]
    assert runs[0] == 14 and len(runs) <= 9
    assert next(r for r in good if r.rule_id == "r001").examples == ["1", "10", "11", "12", "13"]


def test_faults_of_the_cluster_are_raised(spark, monkeypatch):
    def lost(df, rules):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(chk, "constraint_results", lost)
    with pytest.raises(RuntimeError):
        chk.validate(spark.range(3), {"deequ": [{"type": "max", "column": "id", "threshold": 1}]})
    with pytest.raises(ValueError):
        chk.validate(spark.range(3), [])
