import hashlib
import statistics
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.operators import profile as pro


def test_column_classes():
    kinds = {
        T.DecimalType(10, 2): "numeric", T.LongType(): "numeric", T.DateType(): "datetime",
        T.TimestampNTZType(): "datetime", T.BooleanType(): "string",
        T.ArrayType(T.IntegerType()): "string", T.MapType(T.StringType(), T.IntegerType()): "string",
    }
    assert {k: pro.column_class(k) for k in kinds} == kinds


def test_statistics(spark):
    frame = spark.createDataFrame(
        [(1, Decimal("2.50"), "x", None), (3, Decimal("4.50"), "y", None), (8, None, "x", None)],
        "a int, d decimal(5,2), s string, e double",
    )
    found = {r.column_name: r for r in pro.column_stats(frame, exact_distinct=True).collect()}
    assert (found["a"].min, found["a"].max, found["a"].mean) == (1.0, 8.0, 4.0)
    assert abs(found["a"]["std"] - statistics.stdev([1, 3, 8])) < 1e-12
    assert (found["d"].mean, found["s"].mean, found["e"].min) == (3.5, None, None)
    assert [found[c].distinct_count for c in "adse"] == [3, 2, 2, 0]
    assert {r.rows_count for r in found.values()} == {3}


def test_wide_table_keeps_every_column(spark):
    frame = spark.range(5).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(95)])
    found = pro.column_stats(frame).collect()
    assert sorted(r.position for r in found) == list(range(95))


def _expected(values, k):
    texts = {str(v) for v in values if v is not None}
    return sorted(texts, key=lambda t: (hashlib.md5(t.encode()).hexdigest(), t))[:k]


def test_sample_is_bottom_k_from_one_scan(spark, tmp_path):
    rows = [(i, i % 7, "hot" if i % 3 else f"v{i}") for i in range(5000)]
    frame = spark.createDataFrame(rows, "a int, b int, c string").repartition(6)
    expected = {name: _expected([r[i] for r in rows], 20) for i, name in enumerate("abc")}
    frame.write.parquet(str(tmp_path / "t"))
    found = pro.column_samples(spark.read.parquet(str(tmp_path / "t")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    samples = found.orderBy("rank").collect()
    for name in "abc":
        assert [r.value for r in samples if r.column_name == name] == expected[name]
    assert pro.column_samples(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "é\x00", 1.5)] * 3, "`a.b` int, `c d` string, e double")
    assert sorted((r.column_name, r.value) for r in pro.column_samples(odd).collect()) == [("c d", "é\x00"), ("e", "1.5")]


def test_merged_profiles_equal_the_profile_of_the_union(spark):
    rows = [(i % 5, 1e9 + i / 3, i, None if i % 4 else f"v{i % 50}") for i in range(3000)] + [(9, None, None, None)]
    frame = spark.createDataFrame(rows, "part int, x double, n bigint, s string").withColumn("d", F.lit("2024-01-01").cast("date"))
    parts = pro.column_sketches(frame, ["part"])
    merged = {r.column_name: r for r in pro.merge_sketches(parts).collect()}
    whole = {r.column_name: r for r in pro.column_stats(frame, exact_distinct=True).collect()}
    assert set(merged) == set(whole)
    for name, row in whole.items():
        mine = merged[name]
        assert (mine.rows_count, mine.data_type, mine.min, mine.max, mine.position) == (row.rows_count, row.data_type, row.min, row.max, row.position)
        assert abs(mine.distinct_count - row.distinct_count) <= 0.05 * row.distinct_count
        for stat in ("mean", "std"):
            assert mine[stat] == row[stat] or abs(mine[stat] - row[stat]) <= 1e-7 * abs(row[stat])
    again = pro.merge_sketches(parts.unionByName(pro.column_sketches(frame.limit(0), ["part"])))
    assert again.count() == len(whole)
    alone = pro.merge_sketches(pro.column_sketches(frame.limit(1))).filter("column_name = 'x'").first()
    assert (alone.mean, alone.std, alone.distinct_count) == (1e9, None, 1)


def test_signature_of_a_table(spark):
    frame = spark.createDataFrame([(2, None), (1, None)], "n int, s string")
    signature = pro.dataset_signature(pro.column_signatures(frame), "Sales.2024.csv").first()
    assert (signature.name_base, signature.columns_count, signature.rows_count) == ("sales", 2, 2)
    structure = hashlib.sha256(b"n:numeric,s:string").hexdigest()
    assert signature.structure_hash == structure
    assert signature["columns"]["s"].sample_hash == hashlib.sha256(b"").hexdigest()
    text = "\x1f".join(_expected([1, 2], 20))
    assert signature["columns"]["n"].sample_hash == hashlib.sha256(text.encode()).hexdigest()
    renamed = pro.dataset_signature(pro.column_signatures(frame.select("s", "n")), "x").first()
    assert renamed.structure_hash == structure


def test_latest_signature(spark):
    stored = spark.createDataFrame(
        [("a", "1", "h1", "2024-01-01"), ("a", "2", "h2", "2024-01-02"), ("a", "3", "h3", "2024-01-02")],
        "dataset_id string, id string, structure_hash string, created_at string",
    )
    datasets = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    found = {r.dataset_id: r for r in pro.signature_status(datasets, stored).collect()}
    assert (found["a"].signature_id, found["b"].has_signature) == ("3", False)
