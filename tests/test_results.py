from pyspark.sql import functions as F

from tablekeep.operators import results as res


def test_ratio_parse(spark):
    cases = {"3/4": 0.75, "1/0": 0.0, "junk": 0.0, "0.5": 0.5, "": 0.0, "1/2/3": 0.0, "1/-2": 0.0, "x/2": 0.0}
    frame = spark.createDataFrame([(k,) for k in cases] + [(None,)], "r string")
    found = {r.r: r.v for r in frame.select("r", res.parse_ratio("r").alias("v")).collect()}
    assert found == {**cases, None: 0.0}


def test_status_words(spark):
    words = [("Réussi",), (" fail ",), ("ignoré",), ("skipped",), ("other",), (None,)]
    frame = spark.createDataFrame(words, "s string")
    found = [r.m for r in frame.select(res.map_status("s").alias("m")).collect()]
    assert found == ["passed", "failed", "skipped", "skipped", "unknown", "unknown"]


def test_summary_parts_sum_up_and_round_like_the_exact_double(spark):
    rows = [("a", "réussi")] + [("a", "failed")] * 15 + [("b", None), ("b", "pass"), ("b", "échec")]
    frame = spark.createDataFrame(rows, "version_id string, status string")
    found = {r.version_id: r for r in res.quality_summary(frame).collect()}
    assert all(r.total == r.success + r.failed + r.warnings for r in found.values())
    # 1/16 is 6.25 %, an exact tie: to even in the summary, up in the report.
    assert found["a"].summary_text == "✅ 1/16 (6.2%) | ❌ 15 | ⚠️ 0"
    assert found["b"].summary_text == "✅ 1/3 (33.3%) | ❌ 1 | ⚠️ 1"
    report = {r.version_id: r for r in res.report_summary(frame).collect()}
    assert report["a"].rate == "6.3%"
    assert (report["b"].total, report["b"].colour) == (2, "green")


def test_report_without_statuses(spark):
    frame = spark.createDataFrame([("a", None)], "version_id string, status string")
    row = res.report_summary(frame).first()
    assert (row.total, row.rate, row.colour) == (0, "N/A", "green")


def test_documents_round_trip_in_memory(spark):
    rows = [("r1", "v1", "2024", "min", "c", "failed", 2, "2/9", ["1", "2"]), ("r1", "v1", "2024", "max", None, "passed", 0, "0/9", [])]
    schema = (
        "dag_run_id string, dataset_version_id string, execution_date string, rule_type string, "
        "column_name string, status string, error_count bigint, ratio string, examples array<string>"
    )
    checks = spark.createDataFrame(rows, schema)
    back = res.flatten_documents(res.run_documents(checks))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, checks.collect()), key=repr)
    runs = spark.createDataFrame([("r1", "uuid-1")], "dag_run_id string, id string")
    stored = res.stored_results(back, runs).orderBy("check_type").collect()
    assert [(r.dag_run_uuid, r.alert, r.examples) for r in stored] == [
        ("uuid-1", False, "[]"),
        ("uuid-1", True, '["1","2"]'),
    ]
    assert res.stored_results(back, runs.filter(F.lit(False))).count() == 0
