import random

from tablekeep.operators import chains
from tablekeep.operators.chains import extend_chains, follow_chains
from tests.helpers import rows


def _follow(spark, links):
    frame = spark.createDataFrame(links, "id string, parent_id string")
    return {r.id: r for r in follow_chains(frame).collect()}


def test_long_chain(spark):
    n = 700
    found = _follow(spark, [(f"v{i}", f"v{i - 1}" if i else None) for i in range(n)])
    assert all(found[f"v{i}"].depth == i + 1 for i in range(n))
    assert {r.latest_id for r in found.values()} == {f"v{n - 1}"}
    assert {r.root_id for r in found.values()} == {"v0"}


def test_branches_cycles_self_links_and_missing_parents(spark):
    links = [
        ("a", None), ("b", "a"), ("c", "a"), ("d", "c"),
        ("x", "y"), ("y", "x"), ("below", "x"), ("self", "self"), ("orphan", "gone"),
    ]
    found = _follow(spark, links)
    assert (found["a"].latest_id, found["b"].latest_id, found["d"].depth) == ("d", "b", 3)
    assert {i for i, r in found.items() if r.is_cyclic} == {"x", "y", "below", "self"}
    assert found["x"].depth is None and found["x"].latest_id is None
    assert (found["orphan"].depth, found["orphan"].root_id) == (1, "orphan")


def test_random_forest_against_brute_force_with_a_hot_parent(spark):
    rng = random.Random(9)
    parent = {0: None}
    for i in range(1, 300):
        parent[i] = 3 if i > 3 and rng.random() < 0.35 else rng.choice([None, *range(max(0, i - 6), i)])
    links = [(f"{i:03d}", None if p is None else f"{p:03d}") for i, p in parent.items()]
    found = _follow(spark, links)

    def path(i):
        out = [i]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    paths = {i: path(i) for i in parent}
    for i in parent:
        row = found[f"{i:03d}"]
        assert (row.depth, row.root_id) == (len(paths[i]), f"{paths[i][-1]:03d}")
        below = [(len(p), j) for j, p in paths.items() if i in p]
        assert row.latest_id == f"{max(below)[1]:03d}"
    latest = {i: found[i].latest_id for i in found}
    assert all(latest[latest[i]] == latest[i] for i in latest)


def _state(spark, links):
    nodes = spark.createDataFrame([(i, p, i % 5) for i, p in links], "id int, parent_id int, rank int")
    return nodes.join(follow_chains(nodes, ["rank"]), "id")


def test_extended_state_equals_the_full_walk(spark):
    rng = random.Random(4)
    links = [(i, rng.choice([None, rng.randrange(60), rng.randrange(max(i, 1))])) for i in range(60)]
    for cut in (0, 15, 40, 59):
        order = rng.sample(links, len(links))
        state, batch = _state(spark, order[:cut]), order[cut:]
        new = spark.createDataFrame([(i, p, i % 5) for i, p in batch], "id int, parent_id int, rank int")
        delta = extend_chains(state, new, ["rank"])
        merged = state.join(delta, "id", "left_anti").unionByName(delta)
        assert rows(merged) == rows(_state(spark, links).select(merged.columns))
    # a batch that repeats nodes moves them
    state = _state(spark, [(1, None), (2, 1), (3, 2), (8, None)])
    moved = spark.createDataFrame([(2, 8, 0), (1, 3, 0)], "id int, parent_id int, rank int")
    delta = extend_chains(state, moved, ["rank"])
    merged = state.join(delta, "id", "left_anti").unionByName(delta)
    assert rows(merged, "id", "root_id", "depth", "latest_id") == [(1, 8, 4, 1), (2, 8, 2, 1), (3, 8, 3, 1), (8, 8, 1, 1)]


def test_untouched_chains_are_not_followed(spark, monkeypatch):
    links = [(i, None if i % 10 == 0 else i - 1) for i in range(200)]
    state = _state(spark, links)
    seen = []
    follow = chains.follow_chains
    monkeypatch.setattr(chains, "follow_chains", lambda nodes, order=None: seen.append(nodes.count()) or follow(nodes, order))
    batch = spark.createDataFrame([(1000, 59, 0), (1001, None, 0)], "id int, parent_id int, rank int")
    delta = extend_chains(state, batch, ["rank"])
    assert seen == [12] and delta.count() == 12
    assert {r.latest_id for r in delta.filter("root_id = 50").collect()} == {1000}


def test_nodes_without_links_take_part_in_no_round(spark, monkeypatch):
    seen = []
    double = chains._double
    monkeypatch.setattr(chains, "_double", lambda state, order: seen.append(state.count()) or double(state, order))
    links = [(f"lone{i}", "gone" if i % 2 else None) for i in range(50)] + [("a", None), ("b", "a"), ("c", "b")]
    found = _follow(spark, links)
    assert seen and max(seen) == 3
    assert (found["c"].root_id, found["c"].depth, found["a"].latest_id) == ("a", 3, "c")
    assert (found["lone1"].root_id, found["lone1"].depth, found["lone1"].latest_id, found["lone1"].is_cyclic) == ("lone1", 1, "lone1", False)


def test_groups_are_followed_alone_unless_a_link_or_an_id_is_shared(spark, monkeypatch):
    rng = random.Random(4)
    links = []
    for g in range(60):
        members = list(range(g * 10, g * 10 + rng.randint(1, 10)))
        for place, i in enumerate(members):
            choice = rng.random()
            parent = members[rng.randrange(place)] if place and choice < 0.8 else None
            if g % 6 == 0 and choice > 0.85:
                parent = rng.randrange(600)  # another group, or none that is known
            if g % 7 == 0 and not place:
                parent = members[-1]
            links.append((f"{i}", None if parent is None else f"{parent}", rng.choice([None, 1, 2]), g))
    links += [("0", None, 1, 59), (None, "10", 1, 58), ("n1", None, 1, None), ("n2", "n1", 1, None), ("in", "55", 1, None)]
    nodes = spark.createDataFrame(links, "id string, parent_id string, rank int, grp int")
    plain = nodes.drop("grp").join(follow_chains(nodes, ["rank"]), "id").distinct()
    for limit in (chains.GROUP_NODES, 9):
        monkeypatch.setattr(chains, "GROUP_NODES", limit)
        closed, others = chains.follow_grouped(nodes, "grp", ["rank"])
        assert closed.count() > 150 and others.count() > 20
        assert closed.count() + others.count() == len(links)
        both = closed.unionByName(others.join(follow_chains(others, ["rank"]), "id").distinct().select(*closed.columns))
        assert rows(both.distinct()) == rows(plain.select(*both.columns))


def test_versions_that_stay_in_their_datasets_take_no_round(spark, monkeypatch):
    from tablekeep.operators import versions as ver

    monkeypatch.setattr(ver, "follow_chains", None)
    listed = [(f"{d}-{i}", d, i, f"{d}-{i - 1}" if i else None) for d in range(40) for i in range(5)]
    versions = spark.createDataFrame(listed, "id string, dataset_id int, version_number int, parent_version_id string")
    found = {r.id: r for r in ver.chain_state(versions).collect()}
    assert len(found) == 200
    assert (found["7-2"].root_id, found["7-2"].depth, found["7-2"].latest_id, found["7-2"].parent_id) == ("7-0", 3, "7-4", "7-1")
    assert len(ver.chain_positions(versions).collect()) == 200
