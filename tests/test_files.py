import hashlib

from pyspark.sql import functions as F

from tablekeep.operators import profile as pro
from tablekeep.operators import results as res
from tablekeep.sources import files
from tablekeep.streaming.pickup import pick_up_results, picked_up_checks, unread_documents
from tests.helpers import rows


def test_csv_import_and_listing(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("id,name,paid,day\n1,ann,2.5,2024-01-01\n2,,3.5,2024-01-02\n")
    table = files.import_csv(spark, str(source), str(tmp_path / "out"))
    assert rows(pro.column_listing(table), "position", "column_name", "data_type") == [
        (0, "id", "numeric"), (1, "name", "string"), (2, "paid", "numeric"), (3, "day", "datetime"),
    ]
    assert [r.id for r in files.preview(table, 1, ["id"]).collect()] == [1]
    typed = files.read_csv(spark, str(source), "id string, name string, paid string, day string")
    assert {f.dataType.simpleString() for f in typed.schema} == {"string"}


def test_content_hashes_small_and_streamed(spark, tmp_path):
    folder = tmp_path / "uploads dir"
    folder.mkdir()
    contents = {"a.csv": b"x" * 10, "b.csv": b"x" * 10, "c.csv": bytes(range(256)) * 40_000, "d.csv": b""}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    expected = {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    (folder / "below").mkdir()
    for i in range(40):
        (folder / "below" / f"{i}.csv.gz").write_bytes(bytes([i]))
        expected[f"{i}.csv.gz"] = hashlib.sha256(bytes([i])).hexdigest()
    hashes = files.content_hashes(spark, str(folder))
    assert {r.path.rsplit("/", 1)[-1]: r.hash for r in hashes.collect()} == expected
    # Many tasks share the files, large or small.
    assert hashes.select(F.spark_partition_id()).distinct().count() > 4
    twice = files.identical_uploads(files.content_hashes(spark, str(folder))).collect()
    assert [(r.copies, r.first_path[-5:]) for r in twice] == [(2, "a.csv")]


def test_registry_is_repeatable(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    hashes = files.content_hashes(spark, str(tmp_path / "a.csv"))
    columns = hashes.select("path", F.explode(F.array(F.lit("n"), F.lit("m"))).alias("column_name"))
    columns = columns.withColumn("position", F.when(F.col("column_name") == "n", 0).otherwise(1))
    first = files.dataset_rows(hashes, columns, "p", "ann").first()
    assert (first.name, first.columns_list, first.project_id) == ("a.csv", ["n", "m"], "p")
    assert files.dataset_rows(hashes, columns, "p", "ann").first() == first
    files.append_table(files.dataset_rows(hashes, columns, "p", "ann"), str(tmp_path / "registry"))
    assert files.read_table(spark, str(tmp_path / "registry")).count() == 1


def _documents(spark, runs):
    checks = spark.createDataFrame(
        [(r, "v", "2024", "min", "c", "failed", i, f"{i}/9", ["1"]) for r in runs for i in (1, 2)],
        "dag_run_id string, dataset_version_id string, execution_date string, rule_type string, "
        "column_name string, status string, error_count bigint, ratio string, examples array<string>",
    )
    return res.run_documents(checks)


def test_run_documents(spark, tmp_path):
    for per_run in (True, False):
        folder = str(tmp_path / f"docs-{per_run}")
        files.write_run_documents(_documents(spark, ["r1", "r2"]), folder, per_run)
        assert res.flatten_documents(files.read_run_documents(spark, folder)).count() == 4
        one = files.read_run_documents(spark, folder, "r2", "r2" if per_run else "2024")
        assert rows(res.flatten_documents(one), "dag_run_id", "error_count") == [("r2", 1), ("r2", 2)]
        assert files.read_run_documents(spark, folder, "missing").count() == 0
        assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()


def test_pickup_takes_every_file_once(spark, tmp_path):
    folder, target, checkpoint, archive = (str(tmp_path / n) for n in ("in", "out", "cp", "old"))
    files.write_run_documents(_documents(spark, ["r1", "r2"]), folder)
    pick_up_results(spark, folder, target, checkpoint, archive, files_per_batch=1)
    assert picked_up_checks(spark, target).count() == 4
    pick_up_results(spark, folder, target, checkpoint, archive)
    assert picked_up_checks(spark, target).count() == 4
    files.write_run_documents(_documents(spark, ["r3"]), folder)
    pick_up_results(spark, folder, target, checkpoint, archive)
    found = picked_up_checks(spark, target).groupBy("dag_run_id").count()
    assert rows(found) == [("r1", 2), ("r2", 2), ("r3", 2)]


def test_signature_rows_and_history(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    columns = pro.column_signatures(frame)
    now = F.to_timestamp(F.lit("2024-01-01"))
    stored = files.signature_rows(pro.dataset_signature(columns, "T.csv"), F.lit("d1"), now)
    row = stored.first()
    assert (row.dataset_id, row.columns_count, row.rows_count, row.algo_version) == ("d1", 2, 2, "v1")
    long = files.column_signature_rows(columns, F.lit(row.id))
    assert rows(long, "column_name", "distinct_count") == [("n", 2), ("s", 2)]
    pushes = spark.createDataFrame(
        [("d1", 1, "u", None, 5, 2, 10, "p", 0.7, 2), ("d2", 1, "u", "e" * 900, 5, 2, 10, None, 0.0, 0)],
        "dataset_id string, pushed_at int, pushed_by string, error_message string, "
        "execution_time_ms int, columns_count int, rows_count int, parent_version_id string, "
        "similarity_score double, propagated int",
    )
    history = {r.dataset_id: r for r in files.push_history_rows(pushes).collect()}
    assert (history["d1"].status, history["d1"].parent_found) == ("SUCCESS", True)
    assert (history["d2"].status, len(history["d2"].error_message)) == ("FAILED", 500)
    assert history["d2"].columns_count is None


def test_column_types(spark):
    texts = {
        "i": ["1", "-2", None, " 3 "],
        "l": ["1", "3000000000", None, None],
        "x": ["1", "2.5", "1e3", "-.5"],
        "d": ["2024-01-31", "2024-02-29", None, None],
        "t": ["2024-01-31", "2024-01-31T10:00:00.000Z", "2024-01-31 10:00", None],
        "b": ["true", "FALSE", None, None],
        "s": ["2024-02-30", "2024-01-01", None, None],
        "n": [None, None, None, None],
        "mixed `x`": ["1", "a", None, None],
    }
    frame = spark.createDataFrame(list(zip(*texts.values(), strict=True)), ", ".join(f"`{c.replace('`', '``')}` string" for c in texts))
    found = {r.column_name: r for r in files.column_types(frame).collect()}
    want = ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string", "string"]
    assert [found[c].type for c in texts] == want
    assert found["i"].filled == 3 and found["x"].misfits["int"] == 3 and found["mixed `x`"].misfits["int"] == 1
    assert files.column_types(frame.limit(0)).filter("type = 'string'").count() == len(texts)


def test_broken_documents_are_kept_apart(spark, tmp_path):
    folder, target = tmp_path / "pending", str(tmp_path / "results")
    folder.mkdir()
    good = '{"dag_run_id": "r1", "dataset_version_id": "v", "execution_date": "d", "checks": [{"rule_type": "min"}]}'
    (folder / "a.json").write_text(good + "\n\n{\"dag_run_id\": \"r2\", \"che\n[1]\n")
    (folder / "b.json").write_text("")
    (folder / "c.json").write_text('{"checks": []}\n{"dag_run_id": "r3", "checks": []}\n')
    for _ in range(2):
        pick_up_results(spark, str(folder), target, str(tmp_path / "state"))
    assert rows(picked_up_checks(spark, target), "dag_run_id", "rule_type") == [("r1", "min")]
    letters = unread_documents(spark, target)
    assert rows(letters, "reason", "document") == [
        ("no run", '{"checks":[]}'), ("unreadable", "[1]"), ("unreadable", '{"dag_run_id": "r2", "che'),
    ]
    assert {r.file.rsplit("/", 1)[-1] for r in letters.collect()} == {"a.json", "c.json"}
    listed = files.unreadable_documents(spark, str(folder))
    assert rows(listed, "document") == [("[1]",), ('{"dag_run_id": "r2", "che',)]
    assert rows(files.read_run_documents(spark, str(folder)).filter("dag_run_id IS NOT NULL"), "dag_run_id") == [("r1",), ("r3",)]
    assert unread_documents(spark, str(tmp_path / "none")).count() == 0
