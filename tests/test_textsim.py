import random

from pyspark.sql import functions as F

from tablekeep.functions.textsim import indel_ratio, lcs_length, partial_ratio
from tablekeep.plans.queries import QUERIES
from tests.helpers import indel, lcs, partial


def _compare(spark, pairs):
    frame = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    a, b = F.col("a"), F.col("b")
    found = frame.select(
        a, b, lcs_length(a, b).alias("n"), indel_ratio(a, b).alias("r"), partial_ratio(a, b).alias("p")
    ).collect()
    assert len(found) == len(pairs)
    for row in found:
        assert row.n == lcs(row.a, row.b), row
        assert abs(row.r - indel(row.a, row.b)) < 1e-12, row
        assert abs(row.p - partial(row.a, row.b)) < 1e-12, row


def _text(rng, size, letters):
    return "".join(rng.choice(letters) for _ in range(size))


def test_short_random_strings(spark):
    rng = random.Random(3)
    sizes = [(rng.randint(0, 15), rng.randint(0, 15)) for _ in range(400)]
    _compare(spark, [(_text(rng, n, "abcé😀_"), _text(rng, m, "abcé😀_")) for n, m in sizes])


def test_word_boundaries_and_long_strings(spark):
    rng = random.Random(4)
    sizes = [(61, 62), (62, 62), (62, 63), (63, 63), (63, 140), (124, 125), (130, 20)]
    _compare(spark, [(_text(rng, n, "abcdef"), _text(rng, m, "abcdef")) for n, m in sizes])


def test_known_values(spark):
    _compare(spark, [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("ab", "xxabxx"), ("a.b", "a|b")])


def test_null_stays_null(spark):
    frame = spark.createDataFrame([(None, "a")], "a string, b string")
    assert frame.select(partial_ratio(F.col("a"), F.col("b")).alias("p")).first().p is None


def test_rows_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    rows = [(i, f"name {i}", "TYPE", f"brand {i}") for i in range(64)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_brand string").coalesce(1).write.parquet(
        str(tmp_path / "part.parquet")
    )
    found = QUERIES["text_partial_ratio"](spark, str(tmp_path))
    assert found.count() == 64 and found.select(F.spark_partition_id()).distinct().count() > 1


def test_partial_ratio_of_missing_texts(spark):
    frame = spark.createDataFrame([(None, "x"), ("x", None), (None, None), ("", "")], "a string, b string")
    assert [r[0] for r in frame.select(partial_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, None, 1.0]
