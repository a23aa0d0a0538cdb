import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablekeep.functions import lineage
from tablekeep.operators.chains import follow_chains
from tablekeep.plans import star_catalogue
from tablekeep.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _shuffles(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def _cuts(spark) -> set[str]:
    folder = Path(re.sub("^file:/*", "/", lineage.shared_folder(spark)))
    return {p.name for p in folder.glob("cut-*")}


def test_a_cut_leaves_no_shuffle_files_and_no_setting_behind(spark):
    before, setting = _shuffles(spark), spark.conf.get(lineage.CLEANUP, None)
    rows = spark.range(1000).select((F.col("id") % 7).alias("k")).repartition(5, "k").groupBy("k").count()
    written = lineage.cut_lineage(rows)
    for _ in range(50):  # files go a little later
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert spark.conf.get(lineage.CLEANUP, None) == setting
    assert sorted(map(tuple, written.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_forgotten_rows_take_no_space(spark):
    before = _cuts(spark)
    written = lineage.cut_lineage(spark.range(10))
    assert len(_cuts(spark) - before) == 1
    lineage.forget(written)
    assert not _cuts(spark) - before


def test_rounds_of_a_chain_do_not_pile_up(spark):
    before = _cuts(spark)
    nodes = spark.range(64).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    followed = follow_chains(nodes)
    assert len(_cuts(spark) - before) == 2  # unlinked nodes, and the last of seven rounds
    assert {(r.root_id, r.latest_id) for r in followed.collect()} == {(0, 63)}


def test_col_assign_makes_the_columns_of_versions_once(spark, monkeypatch):
    made, build = [], star_catalogue.BUILDERS["version_columns"]
    monkeypatch.setitem(star_catalogue.BUILDERS, "version_columns", lambda **f: made.append(1) or build(**f))
    assert QUERIES["col_assign"](spark, SF).count()
    assert len(made) == 1


@pytest.mark.parametrize(("name", "joins"), [("graph_columns", 1), ("graph_edges", 2), ("sim_descriptions", 2)])
def test_the_last_step_of_a_query_repeats_none_of_those_written(spark, name, joins):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"^\W*Join ", plan, re.M)) == joins
