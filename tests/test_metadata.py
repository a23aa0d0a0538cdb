from pyspark.sql import functions as F

from tablekeep.operators import access as acc
from tablekeep.operators import classifications as cls
from tablekeep.operators import descriptions as dsc
from tests.helpers import rows

TEXTS = (
    "version_id string, column_name string, description string, created_by string, created_at string, "
    "updated_by string, updated_at string"
)
EDITS = "version_id string, column_name string, description string, user_id string, submitted_at string, seq int"


def test_upsert_order_blanks_and_idempotence(spark):
    old = spark.createDataFrame([("v", "a", "old", "u0", "t0", None, None), ("v", "z", "same", "u0", "t0", None, None)], TEXTS)
    edits = spark.createDataFrame(
        [("v", "a", " new ", "u1", "t1", 1), ("v", "b", "first", "u1", "t1", 1), ("v", "b", "second", "u2", "t2", 1), ("v", "b", "  ", "u3", "t3", 1), ("v", "a", None, "u3", "t3", 1)],
        EDITS,
    )
    once = dsc.upsert_descriptions(old, edits)
    assert rows(once) == [
        ("v", "a", "new", "u0", "t0", "u1", "t1"),
        ("v", "b", "second", "u1", "t1", "u2", "t2"),
        ("v", "z", "same", "u0", "t0", None, None),
    ]
    again = dsc.upsert_descriptions(once, edits.filter("column_name = 'a'"))
    assert rows(again) == rows(once)


def test_inherited_takes_five_versions_before_dropping_empty_ones(spark):
    versions = spark.createDataFrame(
        [(f"v{i}", "d", i, f"g{i}" if i != 7 else None) for i in range(1, 9)],
        "id string, dataset_id string, version_number int, external_id string",
    )
    texts = spark.createDataFrame([("v2", "a", "x"), ("v3", "a", "y"), ("v8", "a", "z"), ("v7", "a", "draft")], "version_id string, column_name string, description string")
    found = dsc.inherited_descriptions(versions, texts)
    assert rows(found, "version_id") == [("v3",), ("v8",)]


def test_final_description(spark):
    frame = spark.createDataFrame([(" new", "old", "c"), ("  ", "old", "c"), (None, "", "c"), (None, None, "c")], "g string, e string, c string")
    found = [r.d for r in frame.select(dsc.final_description("g", "e", "c").alias("d")).collect()]
    assert found == [" new", "old", "Colonne c", "Colonne c"]


LOG = "id int, entity_type string, entity_id string, column_name string, classification string, applied_by string, applied_at int"


def test_exactly_one_active_class_per_key(spark):
    log = [(i, "DATASET", "hot", None, ["PUBLIC", "RESTRICTED"][i % 2], "u", i // 2) for i in range(200)]
    log += [(900 + i, "COLUMN", "hot", f"c{i % 3}", "PII", "u", i) for i in range(30)]
    log += [(990, "COLUMN", "hot", "c0", "PUBLIC", "u", 99), (991, "TABLE", "hot", None, "PII", "u", 99)]
    frame = spark.createDataFrame(log, LOG)
    history = cls.classification_history(frame)
    active = history.filter("is_active").groupBy("entity_type", "column_name").count()
    assert {r["count"] for r in active.collect()} == {1} and active.count() == 4
    assert rows(cls.security_class(cls.active_classifications(frame))) == [("hot", "RESTRICTED")]
    assert rows(cls.rejected_classifications(frame), "id", "problem") == [
        (990, "not a column class"),
        (991, "unknown entity type"),
    ]


def test_default_class_and_consistency(spark):
    active = cls.active_classifications(spark.createDataFrame([(1, "DATASET", "p", None, "PUBLIC", "u", 1)], LOG))
    datasets = spark.createDataFrame([("p",), ("q",)], "dataset_id string")
    assert rows(cls.allowed_column_classes(datasets, active)) == [
        ("p", "PUBLIC", ["PII", "SENSITIVE"]),
        ("q", "RESTRICTED", ["PII", "SENSITIVE"]),
    ]
    wanted = spark.createDataFrame([("q", "a", "PII"), ("q", "b", "PUBLIC"), ("p", "c", None)], "dataset_id string, column_name string, classification string")
    assert rows(cls.consistency_problems(wanted, active), "column_name") == [("b",)]


def test_default_attributes_give_way_to_explicit_ones(spark):
    requests = spark.createDataFrame(
        [(1, "RESTRICTED", "u", {"department": "X"}), (2, "RESTRICTED", "gone", None), (3, "PUBLIC", "u", {}), (4, "PII", "u", None)],
        "id int, classification string, applied_by string, attributes map<string,string>",
    )
    users = spark.createDataFrame([("u", "SALES")], "employee_id string, department string")
    found = {r.id: r.attributes for r in cls.with_default_attributes(requests, users).collect()}
    assert found == {
        1: {"visibility_scope": "DEPARTMENT", "department": "X"},
        2: {"visibility_scope": "DEPARTMENT", "department": "UNKNOWN"},
        3: {"visibility_scope": "ENTERPRISE"},
        4: {},
    }


def test_replacing_a_security_class_leaves_other_tags(spark):
    tags = spark.createDataFrame([("a", "PUBLIC"), ("a", "PII"), ("b", "RESTRICTED")], "entity_id string, tag string")
    change = spark.createDataFrame([("a", "RESTRICTED"), ("c", "PUBLIC")], "entity_id string, tag string")
    assert rows(cls.replace_security_class(tags, change)) == [
        ("a", "PII"), ("a", "RESTRICTED"), ("b", "RESTRICTED"), ("c", "PUBLIC"),
    ]
    assert cls.add_tags(tags, tags).count() == 3


def test_access(spark):
    users = spark.createDataFrame(
        [("admin", "IT", "ADMIN"), ("audit", "IT", "AUDIT"), ("ann", "S", "DATA_OWNER"), ("bob", "R", "DATA_OWNER"), ("new", None, "DATA_OWNER")],
        "employee_id string, department string, role string",
    )
    projects = spark.createDataFrame(
        [("pub", "bob", "PUBLIC"), ("dep", "ann", "DEPARTMENT"), ("lost", "gone", "DEPARTMENT")],
        "project_id string, owner_employee_id string, visibility string",
    )
    seen = rows(acc.visible_projects(users, acc.access_grants(projects, users)))
    assert seen == sorted(
        [(u, p) for u in ("admin", "audit") for p in ("dep", "lost", "pub")]
        + [("ann", "dep"), ("ann", "pub"), ("bob", "pub"), ("new", "pub")]
    )
    uploads = acc.visible_project_counts(users, acc.access_grants(projects, users, "upload"))
    assert dict(rows(uploads)) == {"admin": 3, "audit": 0, "ann": 2, "bob": 1, "new": 1}
    datasets = spark.createDataFrame([("d", "pub", "bob")], "dataset_id string, project_id string, owner_employee_id string")
    assert rows(acc.project_overview(projects, datasets), "project_id", "datasets_count") == [("dep", 0), ("lost", 0), ("pub", 1)]
    assert rows(acc.deletable_projects(projects, datasets), "project_id") == [("dep",), ("lost",)]
    assert acc.owned_by(datasets, "ann").count() == 0
    may = users.select("employee_id", acc.may_delete("role", "employee_id", F.lit("ann")).alias("m"))
    assert {u for u, m in rows(may) if m} == {"admin", "ann"}
