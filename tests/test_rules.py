import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.operators import rules as rul

SETS = [
    {"deequ": [{"type": "completeness", "column": "a"}, {"type": "min", "column": "b", "threshold": "3"}]},
    {"deequ": [{"type": "allowed_values", "column": "a", "values": [" x ", ""]}], "duplicates": ["a", "b"]},
    {"regex": {"email": ["a", "b"]}, "duplicates": {"sensitive": ["a"], "full_row": True}},
    {"regex": {"a": ["email", "zip"], "b": ["ip"]}},
    {"regex": [{"column": "a", "rule_type": "date"}]},
    {"deequ": [{"type": "max", "column": "a", "threshold": None}, {"type": "odd", "column": ""}]},
    # A column named like a pattern turns the whole dict into pattern -> columns.
    {"regex": {"date": ["email"], "b": ["ip"]}},
]


def _flat(rules):
    return [(r.family, r.check, r.column, r.threshold, r.values) for r in rules]


def test_stored_sets_normalise_like_literal_ones(spark):
    runs = spark.createDataFrame(
        [(i, json.dumps(s)) for i, s in enumerate(SETS)], "run_id int, rules string"
    )
    found = rul.normalise_rule_sets(runs).orderBy("run_id", "position").collect()
    for i, spec in enumerate(SETS):
        mine = [
            (r.family, r.check, r.column, r.threshold, tuple(r["values"]) if r["values"] is not None else None)
            for r in found
            if r.run_id == i
        ]
        assert mine == _flat(rul.parse_rules(spec)), spec


def test_row_validation_agrees_with_literal_validation(spark):
    rules = [r for s in SETS for r in rul.parse_rules(s)]
    rules += [
        rul.Rule("x1", rul.CONSTRAINT, "completeness", "a", 1.2),
        rul.Rule("x2", rul.CONSTRAINT, "min", "a", float("nan")),
        rul.Rule("x3", rul.CONSTRAINT, "max", "a", float("inf")),
        rul.Rule("x4", rul.CONSTRAINT, "allowed_values", "a", None, (" ",)),
        rul.Rule("x5", rul.CONSTRAINT, "min", "  ", 1.0),
    ]
    rules = [rul.Rule(f"n{i}", r.family, r.check, r.column, r.threshold, r.values) for i, r in enumerate(rules)]
    found = {r.rule_id: r.problem for r in rul.validate_rule_rows(rul.rules_frame(spark, rules)).collect()}
    assert found == {r.rule_id: rul.rule_problem(r) for r in rules}


@pytest.mark.parametrize("text", [
    '{"regex":{"email":"ab"}}', '{"duplicates":{"full_row":1,"sensitive":"a"}}', '{"duplicates":{"full_row":0}}',
    "no JSON", "[1]", "", "{}", '{"deequ":[{"type":"allowed_values","column":"c","values":"a, b,"}]}',
    '{"deequ":[{"type":"completeness","column":"c","threshold":null},{"type":"completeness","column":"c"}]}',
    '{"deequ":[{"type":"allowed_values","column":"c","values":["x",2]}],"regex":{"c":["email","ip"]}}',
])
def test_stored_and_literal_rule_sets_agree(spark, text):
    stored = rul.normalise_rule_sets(spark.createDataFrame([(text,)], "rules string"))
    found = [
        (r.family, r["check"], r.column, r.threshold, None if r["values"] is None else tuple(r["values"]), r.problem)
        for r in rul.validate_rule_rows(stored).orderBy("position").collect()
    ]
    literal = rul.parse_rules(text)
    assert found == [(r.family, r.check, r.column, r.threshold, r.values, rul.rule_problem(r)) for r in literal]


def test_comma_list_is_trimmed():
    spec = {"deequ": [{"type": "allowed_values", "column": "a", "values": "x, y ,,z "}]}
    assert rul.parse_rules(spec)[0].values == ("x", "y", "z")


def test_bind_to_schema():
    schema = T.StructType([T.StructField("t", T.TimestampType()), T.StructField("s", T.StringType())])
    spec = {
        "deequ": [
            {"type": "min", "column": "t", "threshold": 1},
            {"type": "min", "column": "s", "threshold": 1},
            {"type": "completeness", "column": "gone"},
        ]
    }
    problems = [r.problem for r in rul.bind_rules(rul.parse_rules(spec), schema)]
    assert problems == ["column 't' is not numeric", None, "column 'gone' not found"]


@pytest.mark.parametrize("name", list(rul.PATTERNS))
def test_patterns_match_as_expected(spark, name):
    good = {
        "email": "a.b-c@x.org", "phone": "+33123456789", "postal_code": "75001", "numeric": "42",
        "alphanumeric": "aB9", "date": "2024-13-99", "ip": "999.1.1.1",
    }
    bad = {
        "email": "a b@x", "phone": "123", "postal_code": "7500", "numeric": "4.2",
        "alphanumeric": "a_b", "date": "2024/01/01", "ip": "1.1.1",
    }
    frame = spark.createDataFrame([(good[name], bad[name])], "g string, b string")
    row = frame.select(F.col("g").rlike(rul.PATTERNS[name]), F.col("b").rlike(rul.PATTERNS[name])).first()
    assert tuple(row) == (True, False)
