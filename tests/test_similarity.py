import random

import pytest

from tablekeep.operators import similarity as sim
from tests.helpers import partial

SCHEMA = (
    "project_id int, dataset_id int, name_base string, column_name string, data_type string, "
    "sample_hash string"
)


def _datasets(seed, n):
    """Random datasets of one project; a third of them are copies, all share a hot column."""
    rng = random.Random(seed)
    made = {}
    for i in range(n):
        if i and rng.random() < 0.34:
            made[i] = made[0]
            continue
        columns = rng.sample([f"c{j}" for j in range(12)], rng.randint(1, 6)) + ["id"]
        made[i] = (
            rng.choice(["sales", "sales_eu", "stock", "st"]),
            {c: (rng.choice(["numeric", "string"]), rng.choice("xyz")) for c in columns},
        )
    return made


def _score(a, b):
    (name_a, cols_a), (name_b, cols_b) = a, b
    common = cols_a.keys() & cols_b.keys()
    jaccard = len(common) / len(cols_a.keys() | cols_b.keys())
    types = sum(cols_a[c][0] == cols_b[c][0] for c in common) / max(len(common), 1)
    samples = sum(cols_a[c][1] == cols_b[c][1] for c in common) / max(len(common), 1)
    total = 0.6 * (0.7 * jaccard + 0.3 * types) + 0.3 * partial(name_a, name_b) + samples * 0.1
    return total, jaccard, cols_b.keys() <= cols_a.keys()


def _best(datasets, published, k, adaptive):
    out = []
    for i, current in datasets.items():
        accepted = []
        for j, other in datasets.items():
            if i == j or j not in published:
                continue
            score, jaccard, contained = _score(current, other)
            limit = 0.6
            if adaptive:
                limit = 0.45 if contained else 0.55 if jaccard > 0.8 else 0.6
            if score >= limit:
                accepted.append((-score, j))
        out += [(i, j, round(-s, 9)) for s, j in sorted(accepted)[:k]]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pair(spark, seed):
    datasets = _datasets(seed, 60)
    rows = [
        (1, i, name, c, kind, sample)
        for i, (name, cols) in datasets.items()
        for c, (kind, sample) in cols.items()
    ]
    signatures = spark.createDataFrame(rows, SCHEMA)
    published = {i for i in datasets if i % 4}
    frame = spark.createDataFrame([(i,) for i in published], "dataset_id int")
    for k, adaptive in ((1, False), (5, True)):
        found = sim.similar_datasets(signatures, frame, k=k, adaptive=adaptive).collect()
        mine = sorted((r.dataset_id, r.parent_id, round(r.score, 9)) for r in found)
        assert mine == _best(datasets, published, k, adaptive)
        assert all(0 <= r.score <= 1 for r in found)


def test_projects_do_not_mix_and_wanted_limits_the_search(spark):
    rows = [(p, d, "n", "c", "string", "x") for p, d in ((1, 1), (1, 2), (2, 3))]
    signatures = spark.createDataFrame(rows, SCHEMA)
    everything = signatures.select("dataset_id")
    found = sim.find_parents(signatures, everything)
    assert {(r.dataset_id, r.parent_id) for r in found.collect()} == {(1, 2), (2, 1)}
    listed = sim.dataset_profiles(signatures)
    pairs = sim.candidate_pairs(sim.distinct_profiles(listed, everything.filter("dataset_id < 0"), everything))
    assert pairs.count() == 0
    one = sim.find_parents(signatures, everything, wanted=everything.filter("dataset_id = 2"))
    assert {(r.dataset_id, r.parent_id) for r in one.collect()} == {(2, 1)}


def test_a_column_of_every_table_joins_nothing(spark):
    """Columns common to a whole project are left out of the overlap join."""
    rows = [
        (1, d, f"n{d}", c, "string", f"{d}{c}")
        for d in range(40)
        for c in ("id", *[f"own{d}_{i}" for i in range(9)])
    ]
    profiles = sim.distinct_profiles(sim.dataset_profiles(spark.createDataFrame(rows, SCHEMA)))
    assert sim.candidate_pairs(profiles).count() == 0


def test_no_cartesian_product(spark):
    signatures = spark.createDataFrame([(1, 1, "n", "c", "string", "x")], SCHEMA)
    profiles = sim.distinct_profiles(sim.dataset_profiles(signatures))
    for frame in (sim.candidate_pairs(profiles), sim.pair_scores(profiles)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_first_description_of_the_best_candidate(spark):
    similar = spark.createDataFrame(
        [(1, 2, 0.9, 1), (1, 3, 0.5025, 2)], "dataset_id int, parent_id int, score double, rank int"
    )
    texts = spark.createDataFrame(
        [(2, 1, "a", "best"), (3, 4, "a", "second"), (3, 4, "b", "only")],
        "dataset_id int, version_number int, column_name string, description string",
    )
    found = sim.suggested_descriptions(similar, texts).orderBy("column_name").collect()
    assert [(r.description, r.similarity_score) for r in found] == [("best", 0.9), ("only", 0.502)]
    assert found[1].source_version == 4
