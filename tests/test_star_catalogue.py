import pytest

from tablekeep.plans import star_catalogue as star
from tests.helpers import rows


@pytest.mark.parametrize("name", ["version_columns", "signatures"])
def test_large_files_are_dealt_to_more_tasks_with_the_rows_of_the_recipe(spark, tmp_path, monkeypatch, name):
    lines = [(i // 4, i % 7, i % 4, f"{i % 50}.0", "ANR"[i % 3], "FO"[i % 2]) for i in range(400)]
    lines += [(None, 1, 1, "3.0", None, "F"), (3, None, 1, "3.0", "A", None), (3, 1, 1, None, "A", None), lines[0]]
    tables = {
        "lineitem": spark.createDataFrame(
            lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity string, l_returnflag string, l_linestatus string"
        ).withColumn("l_quantity", star.F.col("l_quantity").cast("double")),
        "part": spark.createDataFrame([(i, f"p {i % 3}" if i else None, f"t{i}") for i in range(6)], "p_partkey bigint, p_name string, p_type string"),
        "orders": spark.createDataFrame(
            [(i, i % 9, "5-LOW", "P" if i % 2 else None) for i in [*range(90), 7]],
            "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string",
        ),
    }
    for table, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    frames = {t: star.catalogue(spark, str(tmp_path), t) for t in star.inputs_of(name)}
    plain = rows(spark.sql(star.RECIPES[name], **frames))
    assert rows(star.catalogue(spark, str(tmp_path), name), *spark.sql(star.RECIPES[name], **frames).columns) == plain
    monkeypatch.setattr(star, "TASK_BYTES", 500)
    many = star.catalogue(spark, str(tmp_path), name)
    assert many.rdd.getNumPartitions() > 8
    assert rows(many, *spark.sql(star.RECIPES[name], **frames).columns) == plain
