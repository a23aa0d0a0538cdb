import random

from tablekeep.operators import columns as col
from tests.helpers import lcs, rows

CHILD = (
    "version_id string, parent_version_id string, qualified_name string, column_name string, "
    "position int, existing_id string"
)
PARENT = "version_id string, column_name string, position int, logical_id string"
LINEAGE = "id string, dataset_version_id string, logical_column_id string, column_name string"


def test_cascade(spark):
    parents = spark.createDataFrame(
        [("p", "Customer_Id", 0, "L0"), ("p", "amount", 1, "L1"), ("p", "town", 2, None)], PARENT
    )
    children = spark.createDataFrame(
        [
            ("c", "p", "q", "amount", 0, None),
            ("c", "p", "q", "other", 1, None),
            ("c", "p", "q", "town", 2, None),
            ("c", "p", "q", "customer_id", 3, None),
            ("c", "p", "q", "kept", 4, "OLD"),
            ("n", None, "q2", "amount", 0, None),
        ],
        CHILD,
    )
    found = {(r.version_id, r.column_name): (r.strategy, r.logical_id) for r in col.match_columns(children, parents).collect()}
    assert found[("c", "amount")] == ("exact_name", "L1")
    assert found[("c", "other")] == ("position", "L1")
    assert found[("c", "town")][0] == "new"
    assert found[("c", "customer_id")] == ("fuzzy", "L0")
    assert found[("c", "kept")] == ("existing", "OLD")
    assert found[("n", "amount")][0] == "new" and len(found[("n", "amount")][1]) == 32
    alone = {(r.version_id, r.column_name): r.strategy for r in col.match_columns(children, parents, exclusive=True).collect()}
    assert (alone[("c", "amount")], alone[("c", "other")]) == ("exact_name", "new")


def test_fuzzy_matches_against_every_pair(spark):
    rng = random.Random(2)
    base = ["customer_name", "order_total", "shipping_date", "postal_code", "vat"]

    def spoil(name):
        letters = list(name)
        for _ in range(rng.randint(0, 4)):
            letters[rng.randrange(len(letters))] = rng.choice("abc_XY")
        return "".join(letters)

    parents = [(f"p{v}", spoil(rng.choice(base)), i, f"L{v}.{i}") for v in range(5) for i in range(6)]
    children = [(f"c{i}", f"p{rng.randrange(5)}", "q", spoil(rng.choice(base)), i, None) for i in range(60)]
    found = {
        (r.parent_version_id, r.name): r.fuzzy_id
        for r in col.fuzzy_matches(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)).collect()
    }
    expected = {}
    for _, parent, _, name, *_ in children:
        low, best = name.lower(), None
        for version, other, _, logical in parents:
            if version != parent:
                continue
            score = 2 * lcs(low, other.lower()) / (len(low) + len(other))
            if 200 * lcs(low, other.lower()) >= 82 * (len(low) + len(other)) and (best is None or score > best[0]):
                best = (score, logical)
        if best:
            expected[(parent, low)] = best[1]
    assert found == expected and expected


def test_edges_and_history(spark):
    columns = spark.createDataFrame(
        [("v1", None, "a", "g1"), ("v2", "v1", "a", "g2"), ("v2", "v1", "b", "-col-1"), ("v3", "v2", "a", "g2"), ("v3", "v2", "b", None)],
        "version_id string, parent_version_id string, column_name string, external_id string",
    )
    edges = col.column_edges(columns, columns).collect()
    assert [(e.child, e.parent) for e in edges] == [("g2", "g1")]


def test_parent_lookup_by_prefix_with_dots_in_names(spark):
    owners = spark.createDataFrame([("d1", "p_h.v1"), ("d2", "p_h.v2")], "dataset_id string, qualified_name string")
    columns = spark.createDataFrame(
        [("d1", "p_h.v1.a", "a"), (None, "p_h.v1.lost", "lost"), (None, "p_h.v2.x.y", "x.y"), (None, "p_h.v22.z", "z")],
        "dataset_id string, qualified_name string, column_name string",
    )
    found = {tuple(r) for r in col.parent_columns(owners, columns).collect()}
    assert found == {("d1", "a"), ("d2", "x.y")}


def _greedy(children, parents):
    """Pairs one by one: strategy, ratio, positions."""
    usable = {}
    for version, name, position, logical in parents:
        if logical:
            usable.setdefault(version, []).append((name, position, logical))
    out = {}
    for version in {c[0] for c in children}:
        own = sorted((c for c in children if c[0] == version), key=lambda c: c[4])
        gone, taken = set(), {}
        for c in own:
            if c[5] and c[5] not in gone:
                gone.add(c[5])
                taken[c[3]] = (c[5], "existing")
        pairs = []
        for c in own:
            if c[5]:
                continue
            for name, position, logical in usable.get(c[1], []):
                if name == c[3]:
                    pairs.append((1, -1.0, c[4], position, logical, c[3], "exact_name"))
                if position == c[4]:
                    pairs.append((2, -1.0, c[4], position, logical, c[3], "position"))
                a, b = c[3].lower(), name.lower()
                if lcs(a, b) * 200 >= (len(a) + len(b)) * 82:
                    pairs.append((3, -2.0 * lcs(a, b) / (len(a) + len(b)), c[4], position, logical, c[3], "fuzzy"))
        for _, _, _, _, logical, name, strategy in sorted(pairs):
            if logical not in gone and name not in taken:
                gone.add(logical)
                taken[name] = (logical, strategy)
        for c in own:
            out[version, c[3]] = taken.get(c[3], (None, "new"))
    return out


def test_assignment_equals_greedy(spark):
    rng = random.Random(6)
    names = ["amount", "amounts", "amount_eur", "amount_usd", "id", "ids", "customer", "customers", "date", "dates", "Date"]
    parents, children = [], []
    for version in range(12):
        for position, name in enumerate(rng.sample(names, rng.randint(1, 9))):
            parents.append((f"v{version}", name, position, None if rng.random() < 0.15 else f"L{version}.{position}"))
        parent = None if version % 5 == 4 else f"v{version}"
        for position, name in enumerate(rng.sample(names, rng.randint(1, 9))):
            existing = rng.choice([None, None, None, "", "E1", f"L{version}.0"])
            children.append((f"c{version}", parent, f"q{version}", name, position, existing))
    frames = (
        spark.createDataFrame(children, "version_id string, parent_version_id string, qualified_name string, column_name string, position int, existing_id string"),
        spark.createDataFrame(parents, "version_id string, column_name string, position int, logical_id string"),
    )
    found = {(r.version_id, r.column_name): (r.logical_id, r.strategy) for r in col.assign_columns(*frames).collect()}
    want = _greedy(children, parents)
    assert set(found) == set(want)
    for key, (logical, strategy) in want.items():
        assert found[key][1] == strategy and (strategy == "new" or found[key][0] == logical)
    assert len({(k[0], x[0]) for k, x in found.items()}) == len(found)
    assert col.assign_columns(frames[0].limit(0), frames[1]).count() == 0


def test_every_side_is_shuffled_once(spark):
    children = spark.createDataFrame([("c", "p", "q", "a", 0, None), ("c", "p", "q", "b", 1, None)], CHILD)
    parents = spark.createDataFrame([("p", "a", 0, "L0"), ("p", "a", 1, "L1")], PARENT)
    lineage = spark.createDataFrame([("r", "p", "L0", "a"), ("q", "p", "L1", "b")], LINEAGE)
    matched = col.match_columns(children, parents, parent_lineage=lineage)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    # a name that stands twice in the parent gives two rows, as a join does
    found = rows(matched, "column_name", "logical_id", "strategy", "parent_column_id")
    assert found == [
        ("a", "L0", "exact_name", "r"),
        ("a", "L1", "exact_name", "q"),
        ("b", "L1", "position", "q"),
    ]
    one, two = col.lineage_rows(matched), col.lineage_rows(matched.drop("parent_column_id"), lineage)
    assert rows(one) == rows(two)


def test_rows_without_a_parent_or_a_name(spark):
    children = spark.createDataFrame(
        [("c", None, "q", "a", 0, None), ("d", "p", "q", None, None, None), ("d", "p", "q", "", 7, None)], CHILD
    )
    parents = spark.createDataFrame([("p", "a", 0, "L0"), ("p", None, None, "L1"), (None, "a", 0, "L2")], PARENT)
    assert {r.strategy for r in col.match_columns(children, parents).collect()} == {"new"}
