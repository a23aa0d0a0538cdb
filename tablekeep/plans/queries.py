"""The registered queries: every operator on whole tables of a star schema.

Each takes a session and a folder of Parquet tables and returns a DataFrame of
plain columns (lists joined to text, missing numbers as -1), so that results can
be compared as they are.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.functions.lineage import cut_lineage, scratch_path
from tablekeep.functions.textsim import indel_ratio, partial_ratio
from tablekeep.operators import access as acc
from tablekeep.operators import checks as chk
from tablekeep.operators import classifications as cls
from tablekeep.operators import columns as col
from tablekeep.operators import descriptions as dsc
from tablekeep.operators import graph as gra
from tablekeep.operators import profile as pro
from tablekeep.operators import results as res
from tablekeep.operators import rules as rul
from tablekeep.operators import similarity as sim
from tablekeep.operators import versions as ver
from tablekeep.plans.publish import Catalogue, Published, publish, store_push, stored_table
from tablekeep.plans.star_catalogue import catalogue, detailed_columns, placed_columns
from tablekeep.sources import commits, files
from tablekeep.streaming import pickup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _long(value: str | Column, name: str | None = None) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.cast("bigint"), F.lit(-1)).alias(name or value)


def _text(value: str | Column, name: str | None = None) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.cast("string"), F.lit("")).alias(name or value)


def _double(value: str | Column, name: str | None = None, digits: int = 6) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.round(column, digits), F.lit(-1.0)).alias(name or value)


def _list(value: str, name: str | None = None) -> Column:
    return F.coalesce(F.array_join(value, "|"), F.lit("")).alias(name or value)


# --- rules -------------------------------------------------------------------------------------

CONSTRAINTS = {
    "deequ": [
        {"type": "completeness", "column": "o_orderstatus", "threshold": 0.95},
        {"type": "completeness", "column": "o_orderstatus", "threshold": 0.5},
        {"type": "completeness", "column": "o_custkey"},
        {"type": "min", "column": "o_totalprice", "threshold": 2000},
        {"type": "max", "column": "o_totalprice", "threshold": 499000},
        {"type": "max", "column": "o_custkey", "threshold": 1e12},
        {"type": "allowed_values", "column": "o_orderstatus", "values": ["F", "O"]},
        {"type": "allowed_values", "column": "o_orderpriority", "values": ["1-URGENT", "2-HIGH"]},
        {
            "type": "allowed_values",
            "column": "o_orderstatus",
            "values": ["F", "O", "P", "", "  ", "NULL"],
        },
    ]
}
PATTERN_COLUMNS = {
    "regex": [
        {"column": "email", "rule_type": "email"},
        {"column": "phone", "rule_type": "phone"},
        {"column": "postal_code", "rule_type": "postal_code"},
        {"column": "digits", "rule_type": "numeric"},
        {"column": "word", "rule_type": "alphanumeric"},
        {"column": "day", "rule_type": "date"},
        {"column": "ip", "rule_type": "ip"},
        {"column": "c_custkey", "rule_type": "numeric"},
    ]
}
BROKEN_RULES = {
    "deequ": [
        {"type": "min", "column": "", "threshold": 1},
        {"type": "max", "column": "no_such_column", "threshold": 1},
        {"type": "unique", "column": "o_custkey"},
        {"type": "completeness", "column": "o_custkey", "threshold": 2},
        {"type": "min", "column": "o_custkey"},
        {"type": "allowed_values", "column": "o_custkey", "values": [" "]},
        {"type": "min", "column": "o_orderdate", "threshold": 1},
    ],
    "regex": {"o_orderstatus": ["zip"], "missing": ["email"]},
    "duplicates": ["missing"],
}


def _results(frame: DataFrame, *more: str) -> DataFrame:
    return frame.select(
        "rule_id",
        "check_name",
        _text("column_name"),
        "status",
        "error_count",
        "total_count",
        "ratio",
        *more,
    )


@query
def dq_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-1 to R-4: completeness, minimum, maximum and allowed values in one aggregate."""
    orders = catalogue(spark, sf_dir, "dirty_orders")
    rules = rul.bind_rules(rul.parse_rules(CONSTRAINTS), orders.schema)
    results = chk.constraint_results(orders, rules)
    return results.select(
        "rule_id",
        "check_name",
        "column_name",
        "status",
        "error_count",
        "total_count",
        "ratio",
        "null_count",
        "blank_count",
    )


@query
def dq_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-5: every pattern, over trimmed values that are neither blank nor the word NULL."""
    contacts = catalogue(spark, sf_dir, "contacts")
    rules = rul.bind_rules(rul.parse_rules(PATTERN_COLUMNS), contacts.schema)
    return _results(chk.constraint_results(contacts, rules))


@query
def dq_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-9: up to five failing values per failed rule."""
    orders = catalogue(spark, sf_dir, "dirty_orders")
    rules = rul.bind_rules(rul.parse_rules(CONSTRAINTS), orders.schema)
    found = chk.check_constraints(orders, rules)
    return found.select("rule_id", "status", _list("examples"))


@query
def dq_column_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-6, R-8: values that occur again, all columns in one pass."""
    orders = catalogue(spark, sf_dir, "dirty_orders")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"]
    found = chk.duplicate_values(orders, columns)
    return found.select("column_name", "duplicates", "rows", _list("examples"))


@query
def dq_row_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-7, R-8: surplus copies of whole rows, with the rows of the most copies as examples."""
    found = chk.duplicate_rows(catalogue(spark, sf_dir, "double_lineitem"))
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    shown = F.transform("examples", lambda e: F.concat_ws("/", *[F.get_json_object(e, f"$.{c}") for c in columns]))
    return found.select("duplicates", "rows", F.array_join(shown, "|").alias("examples"))


@query
def dq_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-11, R-12: rules that cannot run on a table."""
    orders = catalogue(spark, sf_dir, "dirty_orders")
    return _results(chk.validate(orders, BROKEN_RULES), "message")


@query
def dq_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-20: all families over one table, standardised."""
    contacts = catalogue(spark, sf_dir, "contacts")
    rules = {
        "deequ": [{"type": "completeness", "column": "word"}],
        "regex": {"email": ["email"], "ip": ["ip"]},
        "duplicates": {"sensitive": ["postal_code", "day"], "full_row": True},
    }
    return _results(chk.validate(contacts, rules))


@query
def dq_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-13: rules that raise over the data fail alone; all others keep their results."""
    contacts = catalogue(spark, sf_dir, "contacts")
    fault = F.raise_error(F.lit("no age")).cast("bigint")
    contacts = contacts.withColumn("age", F.when(F.col("c_custkey") % 9 == 0, fault).otherwise(F.col("c_custkey")))
    rules = {
        "deequ": [
            {"type": "completeness", "column": "word"},
            {"type": "min", "column": "age", "threshold": 10},
            {"type": "max", "column": "c_custkey", "threshold": 1e12},
            {"type": "allowed_values", "column": "age", "values": ["1"]},
        ],
        "regex": {"email": ["email"], "numeric": ["age"]},
        "duplicates": {"sensitive": ["age", "day"], "full_row": True},
    }
    return _results(chk.validate(contacts, rules))


@query
def dq_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10 to R-12 for many stored rule sets, each bound to its own columns."""
    rules = rul.normalise_rule_sets(catalogue(spark, sf_dir, "rule_sets"))
    columns = catalogue(spark, sf_dir, "version_columns").select(
        F.col("version_id").alias("dataset_id"), "column_name"
    )
    bound = rul.bind_rule_rows(rul.validate_rule_rows(rules), columns)
    return bound.select(
        "run_id",
        _long("position"),
        "family",
        "check",
        _text("column"),
        _double("threshold"),
        _list("values"),
        _text("problem"),
    )


# --- results -----------------------------------------------------------------------------------


def _checks(spark: SparkSession, sf_dir: str, **known: DataFrame) -> DataFrame:
    return catalogue(spark, sf_dir, "checks", **known).withColumn("examples", F.array("example"))


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(spark, sf_dir).withColumnRenamed("dag_run_id", "run_id")
    regex = F.startswith("rule_type", F.lit("regex"))
    return res.standardise(
        {
            "constraint": checks.filter(~regex),
            "regex": checks.filter(regex).drop("rule_type", "examples"),
        }
    )


@query
def dq_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-14: results of several families in one vocabulary."""
    return _standard(spark, sf_dir).select(
        "run_id",
        "version_id",
        "rule_type",
        _text("column_name"),
        "status",
        "error_count",
        "ratio",
        _list("examples"),
    )


@query
def dq_ratio_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-15, R-16: typed result rows of the runs that are known."""
    checks = _checks(spark, sf_dir).withColumn("dataset_version_id", F.col("version_id"))
    runs = catalogue(spark, sf_dir, "orders").select(
        F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("dag_run_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("id"),
    )
    stored = res.stored_results(checks, runs)
    return stored.select(
        "dag_run_uuid",
        "check_type",
        _text("column_name"),
        "status",
        "error_count",
        _double("ratio"),
        _long("alert"),
        "examples",
    )


@query
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-17, R-19: quality summary of every version."""
    return res.quality_summary(_checks(spark, sf_dir))


@query
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-18: the summary as a report shows it."""
    return res.report_summary(_checks(spark, sf_dir))


@query
def dq_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-19: quality tags of the checks, per kind of check."""
    tagged = _checks(spark, sf_dir).withColumn("tag", res.quality_tag("status"))
    return tagged.groupBy("rule_type", "tag").agg(F.count(F.lit(1)).alias("checks"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = catalogue(spark, sf_dir, "orders")
    checks = _checks(spark, sf_dir).join(orders, F.col("version_id") == F.col("o_orderkey"))
    return res.run_documents(
        checks.select(
            "dag_run_id",
            F.col("version_id").cast("string").alias("dataset_version_id"),
            F.year("o_orderdate").cast("string").alias("execution_date"),
            "rule_type",
            "column_name",
            "status",
            "error_count",
            "ratio",
            "examples",
        )
    )


def _flat(checks: DataFrame) -> DataFrame:
    return checks.select(
        "dag_run_id",
        "dataset_version_id",
        "execution_date",
        "rule_type",
        _text("column_name"),
        _text("status"),
        "error_count",
        _text("ratio"),
        _list("examples"),
    )


@query
def dq_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-8, S-9: run documents written as JSON and read back, one row per check."""
    folder = scratch_path(spark, "documents")
    files.write_run_documents(_documents(spark, sf_dir), folder, per_run=False)
    return _flat(res.flatten_documents(files.read_run_documents(spark, folder)))


@query
def dq_stream_pickup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-11: pending run documents picked up once; a second run finds nothing new."""
    folder, target = scratch_path(spark, "pending"), scratch_path(spark, "results")
    checkpoint = scratch_path(spark, "pickup")
    files.write_run_documents(_documents(spark, sf_dir), folder, per_run=False)
    for _ in range(2):
        pickup.pick_up_results(spark, folder, target, checkpoint)
    return _flat(pickup.picked_up_checks(spark, target))


@query
def dq_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-9, S-11: of broken, empty and good documents in one folder the good are picked up, the broken kept apart."""
    folder, target = scratch_path(spark, "pending"), scratch_path(spark, "results")
    key = F.col("version_id")
    documents = _documents(spark, sf_dir).withColumn("version_id", F.col("dataset_version_id").cast("bigint"))
    text = F.to_json(F.struct("dag_run_id", "dataset_version_id", "execution_date", "checks"))
    broken = F.concat(F.lit('{"dag_run_id": "run'), key.cast("string"), F.lit('", "checks": ['))
    nameless = F.concat(F.lit('{"dataset_version_id":"'), key.cast("string"), F.lit('"}'))
    line = F.when(key % 5 == 0, broken).when(key % 5 == 1, F.lit("")).when(key % 5 == 2, nameless).otherwise(text)
    documents.select(line.alias("value")).write.text(folder)
    for _ in range(2):
        pickup.pick_up_results(spark, folder, target, f"{target}-state")
    letters = pickup.unread_documents(spark, target).select(
        F.col("reason").alias("kind"), "document", F.lit(1).cast("bigint").alias("rows")
    )
    checks = pickup.picked_up_checks(spark, target).groupBy(F.col("dag_run_id").alias("document"))
    read = files.unreadable_documents(spark, folder).select(F.lit("listed").alias("kind"), "document", F.lit(1).cast("bigint").alias("rows"))
    return (
        checks.agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit("checks").alias("kind"), "document", "rows")
        .unionByName(letters)
        .unionByName(read)
    )


# --- datasets and profiles ---------------------------------------------------------------------


@query
def ds_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-6: the first hundred rows."""
    return files.preview(catalogue(spark, sf_dir, "orders"), order_by=["o_orderdate", "o_orderkey"])


@query
def ds_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4: SHA-256 of every stored file."""
    hashes = files.content_hashes(spark, sf_dir)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return hashes.select(name, "length", "hash")


@query
def ds_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4: contents uploaded more than once: texts and pages as files, by their fingerprints."""
    uploads = [
        catalogue(spark, sf_dir, table).select(
            F.concat(F.lit(f"{table}/"), F.col(key).cast("string")).alias("path"), F.sha2(content, 256).alias("hash")
        )
        for table, key, content in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))
    ]
    return files.identical_uploads(uploads[0].unionByName(uploads[1]))


@query
def ds_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4: fingerprints of files whose content is known: the customers of every nation, one file each."""
    folder = scratch_path(spark, "contents")
    lines = catalogue(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey")
    ordered = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    ordered.select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(folder)
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("bigint").alias("nation")
    return files.content_hashes(spark, folder).select(nation, "length", "hash")


@query
def ds_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-5: registry rows of uploaded files with the columns of their stored tables; an upload sent twice is one row."""
    key = F.col("o_orderkey").cast("string")
    path = F.concat(F.lit("/data/"), key, F.lit(".csv"))
    uploads = catalogue(spark, sf_dir, "orders").select(path.alias("path"), F.sha2(key, 256).alias("hash"))
    columns = catalogue(spark, sf_dir, "version_columns").withColumnRenamed("version_id", "o_orderkey")
    listed = columns.select(path.alias("path"), "column_name", "position")
    root = scratch_path(spark, "registry")
    for batch in ("first", "again", "first"):
        rows = files.dataset_rows(uploads, listed, "p7", "ann", "orders of a customer")
        commits.commit(spark, root, batch, {"registry": rows})
    stored = commits.read(spark, root, "registry", ["dataset_id"])
    return stored.withColumn("columns_list", F.array_join("columns_list", "|"))


@query
def ds_signature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-12: signatures in their stored form, and read again from it."""
    signatures = pro.stored_signatures(catalogue(spark, sf_dir, "signatures"))
    stamped = catalogue(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), "o_orderdate", F.col("o_custkey").cast("bigint").alias("rows_count")
    )
    rows = files.signature_rows(signatures.join(stamped, "dataset_id"), "dataset_id", F.col("o_orderdate"))
    path = scratch_path(spark, "signatures")
    files.append_table(rows, path)
    stored = files.read_table(spark, path)
    entries = F.map_entries(F.from_json(F.get_json_object("signature", "$.columns"), "map<string,struct<dtype:string,sample_hash:string>>"))
    shown = F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"]["dtype"], e["value"]["sample_hash"]))
    return stored.select(
        "id",
        "dataset_id",
        "structure_hash",
        F.get_json_object("signature", "$.name_base").alias("name_base"),
        F.array_join(F.array_sort(shown), "|").alias("columns"),
        _long("columns_count"),
        "rows_count",
        "algo_version",
        "created_at",
    )


@query
def ds_csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1, S-2, S-3: a whole table written as CSV with a header, its types found, imported and read back."""
    source, target = scratch_path(spark, "upload"), scratch_path(spark, "imported")
    catalogue(spark, sf_dir, "orders").write.option("header", True).csv(source)
    orders = files.import_csv(spark, source, target)
    kinds = "|".join(f.dataType.simpleString() for f in orders.schema.fields)
    return orders.select(
        _long("o_orderkey"), _long("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.lit(kinds).alias("kinds"),
    )


@query
def ds_csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1: narrowest type of every column of a table of texts, and how many values do not fit the others."""
    contacts = catalogue(spark, sf_dir, "contacts")
    texts = contacts.select(*[F.col(c).cast("string").alias(c) for c in contacts.columns])
    return files.column_types(texts).select(
        "column_name", "type", "filled", *[F.col("misfits")[kind].alias(f"not_{kind}") for kind in files.LATTICE]
    )


@query
def dq_one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-9: the documents of one run, the first by name, out of many; only the folder of its date is read."""
    folder = scratch_path(spark, "documents")
    # Written to the folder and asked for its first run: made once.
    documents = cut_lineage(_documents(spark, sf_dir))
    files.write_run_documents(documents, folder, per_run=False)
    run, date = documents.agg(F.min(F.struct("dag_run_id", "execution_date"))).first()[0]
    return _flat(res.flatten_documents(files.read_run_documents(spark, folder, run, date)))


@query
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1, P-2, P-4, S-7: class and statistics of every column, rows of the table."""
    stats = pro.column_stats(catalogue(spark, sf_dir, "lineitem"))
    return stats.select(
        _long("position"),
        "column_name",
        "data_type",
        "rows_count",
        *[_double(c, digits=4) for c in ("min", "max", "mean", "std")],
    )


def _close(estimate: str) -> Column:
    """Whether an estimate of distinct values is within a tenth of the exact number."""
    return _long(F.abs(F.col(estimate) - F.col("distinct_count")) <= F.col("distinct_count") * 0.1, "close")


@query
def profile_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-7: columns of a table with their classes, and how many of their values are there."""
    documents = catalogue(spark, sf_dir, "documents")
    listing = pro.column_listing(documents).select(_long("position"), "column_name", "data_type")
    filled = documents.agg(*[F.count(c).alias(c) for c in documents.columns])
    return listing.join(filled.unpivot([], documents.columns, "column_name", "filled"), "column_name")


@query
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-3: exact distinct counts, and whether the operator's own estimate is within 10 %."""
    orders = catalogue(spark, sf_dir, "orders")
    exact = pro.column_stats(orders, exact_distinct=True).select("column_name", "distinct_count")
    own = pro.column_stats(orders).select("column_name", F.col("distinct_count").alias("estimate"))
    return exact.join(own, "column_name").select("column_name", "distinct_count", _close("estimate"))


@query
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-2 to P-4: the profile of a table from stored profiles of its parts, without its rows."""
    orders = catalogue(spark, sf_dir, "orders")
    path = scratch_path(spark, "sketches")
    files.append_table(pro.column_sketches(orders, ["o_orderstatus"]), path)
    merged = pro.merge_sketches(files.read_table(spark, path))
    exact = pro.column_stats(orders, exact_distinct=True).select("column_name", "distinct_count")
    joined = merged.withColumnRenamed("distinct_count", "estimate").join(exact, "column_name")
    return joined.select(
        _long("position"),
        "column_name",
        "data_type",
        "rows_count",
        *[_double(c, digits=4) for c in ("min", "max", "mean", "std")],
        "distinct_count",
        _close("estimate"),
    )


@query
def profile_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5, P-6: repeatable sample of every column and its hash."""
    return pro.sample_hashes(pro.column_samples(catalogue(spark, sf_dir, "orders")))


@query
def profile_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-7 to P-9: whole signatures of two tables."""
    out = None
    for name in ("lineitem", "documents"):
        table = catalogue(spark, sf_dir, name)
        one = pro.dataset_signature(pro.column_signatures(table), f"{name.title()}.v1.csv")
        exact = pro.column_stats(table, exact_distinct=True).select("column_name", "distinct_count")
        fields = one.select("name_base", "columns_count", "rows_count", "structure_hash", F.explode("columns").alias("column_name", "x"))
        fields = fields.join(exact, "column_name")
        out = fields if out is None else out.unionByName(fields)
    return out.select(
        "name_base",
        _long("columns_count"),
        "rows_count",
        "structure_hash",
        "column_name",
        F.col("x.dtype").alias("dtype"),
        *[_double(F.col(f"x.{c}"), c, digits=4) for c in ("min", "max", "mean", "std")],
        _close("x.ndist"),
        F.col("x.sample_hash").alias("sample_hash"),
    )


@query
def profile_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-10, P-11: newest signature of each dataset and whether there is one."""
    stored = catalogue(spark, sf_dir, "versions").filter(F.col("version_number") % 3 != 1)
    stored = stored.select(
        "dataset_id", "id", F.md5(F.col("id").cast("string")).alias("structure_hash"), "created_at"
    )
    datasets = catalogue(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"))
    return pro.signature_status(datasets, stored).select(
        "dataset_id",
        _long("has_signature"),
        _long("signature_id"),
        _text("signature_hash"),
        _text("signature_date"),
    )


# --- similarity --------------------------------------------------------------------------------


@query
def text_indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-1: indel ratio of two texts per part."""
    return _text_pairs(spark, sf_dir, indel_ratio)


@query
def text_partial_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-2: partial ratio of two texts per part."""
    return _text_pairs(spark, sf_dir, partial_ratio)


def _text_pairs(spark: SparkSession, sf_dir: str, ratio: Callable) -> DataFrame:
    # Few bytes and much work a row: a file that one task would read is dealt to all.
    part = catalogue(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    part = part.repartition(4 * spark.sparkContext.defaultParallelism)
    other = F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand"))
    return part.select("p_partkey", _double(ratio(F.col("p_name"), other), "ratio"))


@query
def sim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-1 to M-5: scores of the signature pairs that reach a threshold."""
    datasets = cut_lineage(sim.dataset_profiles(catalogue(spark, sf_dir, "signatures")))
    scores = sim.pair_scores(sim.distinct_profiles(datasets))
    ordered = F.col("profile_a") < F.col("profile_b")
    accept = F.struct("accept_a_for_b", "accept_b_for_a")
    swapped = F.struct(
        F.col("accept_b_for_a").alias("accept_a_for_b"),
        F.col("accept_a_for_b").alias("accept_b_for_a"),
    )
    return scores.withColumn("accept", F.when(ordered, accept).otherwise(swapped)).select(
        "project_id",
        F.least("profile_a", "profile_b").alias("profile_a"),
        F.greatest("profile_a", "profile_b").alias("profile_b"),
        *[
            _double(c)
            for c in ("jaccard", "type_agreement", "sample_agreement", "name_similarity", "score")
        ],
        _long(F.col("accept.accept_a_for_b"), "accept_a_for_b"),
        _long(F.col("accept.accept_b_for_a"), "accept_b_for_a"),
    )


@query
def sim_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-6: the parent of every dataset that has one."""
    found = sim.find_parents(
        catalogue(spark, sf_dir, "signatures"), catalogue(spark, sf_dir, "published")
    )
    return found.select("dataset_id", "parent_id", _double("score"))


@query
def sim_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-7, M-8: the five best candidates with adaptive thresholds."""
    found = sim.similar_datasets(
        catalogue(spark, sf_dir, "signatures"), catalogue(spark, sf_dir, "published")
    )
    return found.select("dataset_id", "parent_id", _double("score"), _long("rank"))


@query
def sim_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-9: per column the description of the best candidate that has one."""
    found = sim.similar_datasets(
        catalogue(spark, sf_dir, "signatures"), catalogue(spark, sf_dir, "published")
    )
    texts = catalogue(spark, sf_dir, "descriptions").select(
        F.col("version_id").alias("dataset_id"),
        F.lit(1).alias("version_number"),
        "column_name",
        "description",
    )
    # Few and narrow rows: written, so the shuffles that found them are gone before the texts are shuffled.
    return sim.suggested_descriptions(cut_lineage(found), texts).select(
        "dataset_id", "column_name", "description", "source_dataset", "similarity_score"
    )


# --- columns -----------------------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The columns of all versions, which most queries read several times, written once."""
    columns = catalogue(spark, sf_dir, "version_columns")
    return {"version_columns": cut_lineage(placed_columns(columns, catalogue(spark, sf_dir, "versions")))}


def _detailed(spark: SparkSession, sf_dir: str, lineage: DataFrame | None = None, exclusive: bool = False, **known: DataFrame) -> DataFrame:
    """Matched columns with their ``type`` and ``quantity``."""
    known = known or _written(spark, sf_dir)
    children, parents = detailed_columns(known["version_columns"]), catalogue(spark, sf_dir, "known_columns", **known)
    return col.match_columns(children, parents, exclusive, lineage)


def _matched(spark: SparkSession, sf_dir: str, exclusive: bool = False, **known: DataFrame) -> DataFrame:
    return _detailed(spark, sf_dir, exclusive=exclusive, **known).drop("type", "quantity")


@query
def col_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-10 to M-12: logical id and strategy of every column."""
    return _matched(spark, sf_dir).select("version_id", "column_name", "logical_id", "strategy")


@query
def col_match_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-10 with every id given to one column of a version only."""
    matched = _matched(spark, sf_dir, exclusive=True)
    return matched.select("version_id", "column_name", "logical_id", "strategy")


@query
def col_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-10 as an assignment: the best pair of a version first, then the next best of what is left."""
    known = _written(spark, sf_dir)
    children = detailed_columns(known["version_columns"]).drop("type", "quantity")
    assigned = col.assign_columns(children, catalogue(spark, sf_dir, "known_columns", **known))
    return assigned.select("version_id", "column_name", "logical_id", "strategy")


@query
def col_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-14: ids taken over and new ones per version."""
    known = _written(spark, sf_dir)
    return col.match_counts(_matched(spark, sf_dir, **known), catalogue(spark, sf_dir, "known_columns", **known))


@query
def col_parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-13: columns of each owner, by owner or by qualified-name prefix."""
    name = F.concat(F.lit("ds.v"), F.col("version_id").cast("string"))
    columns = catalogue(spark, sf_dir, "version_columns").select(
        F.when(F.col("flag") != "A", F.col("version_id")).alias("dataset_id"),
        F.concat_ws(".", name, "column_name").alias("qualified_name"),
        "column_name",
    )
    owners = catalogue(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dataset_id"),
        F.concat(F.lit("ds.v"), F.col("o_orderkey").cast("string")).alias("qualified_name"),
    )
    return col.parent_columns(owners, columns)


@query
def col_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-10: edges between columns of the same name in a version and its parent."""
    external = F.when(F.col("quantity") == 7, F.concat(F.lit("-col-"), F.col("position"))).when(
        F.col("quantity") != 9, F.md5(F.concat_ws("|", "version_id", "column_name"))
    )
    columns = catalogue(spark, sf_dir, "version_columns").withColumn("external_id", external)
    versions = catalogue(spark, sf_dir, "versions").select(
        F.col("id").alias("version_id"), "parent_version_id"
    )
    return col.column_edges(columns.join(versions, "version_id"), columns)


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _written(spark, sf_dir)
    matched = _detailed(spark, sf_dir, catalogue(spark, sf_dir, "lineage", **known), **known)
    return col.lineage_rows(matched.filter("column_name IS NOT NULL"))


@query
def col_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-11: lineage rows linked to the parent version's rows."""
    return _lineage(spark, sf_dir).select(
        "id", "dataset_version_id", "column_name", "logical_column_id", _text("parent_column_id"), "data_type"
    )


@query
def col_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-12: root, depth and latest row of every column."""
    identity = F.md5(F.concat_ws("|", "dataset_version_id", "column_name"))
    history = col.column_history(_lineage(spark, sf_dir).select(identity.alias("id"), "parent_column_id"))
    return history.select(
        "id", _text("root_id"), _long("depth"), _text("latest_id"), _long("is_cyclic")
    )


# --- versions ----------------------------------------------------------------------------------


@query
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-1, V-2: root, depth and latest version along the parent links."""
    chain = ver.chain_positions(catalogue(spark, sf_dir, "versions"))
    return chain.select(
        "id", _long("root_id"), _long("depth"), _long("latest_id"), _long("is_cyclic")
    )


@query
def version_chain_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-1, V-2 kept as a table: the first versions of all datasets are known, all later ones come as a batch."""
    versions = catalogue(spark, sf_dir, "versions")
    root = scratch_path(spark, "chains")
    known = ver.chain_state(versions.filter("version_number <= 3"))
    commits.commit(spark, root, "known", {"chains": known})
    state = commits.read(spark, root, "chains", ["id"])
    moved = ver.extend_chain_state(state, versions.filter("version_number > 3"))
    commits.commit(spark, root, "batch", {"chains": moved})
    chain = commits.read(spark, root, "chains", ["id"])
    return chain.select(
        "id", _long("root_id"), _long("depth"), _long("latest_id"), _long("is_cyclic")
    )


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ver.next_version_numbers(
        catalogue(spark, sf_dir, "pushes"), catalogue(spark, sf_dir, "versions")
    )


@query
def version_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-3, V-4: next process version and next dataset version of pushes to come."""
    chain = ver.chain_positions(catalogue(spark, sf_dir, "versions"))
    numbered = ver.next_process_version(_numbered(spark, sf_dir), chain)
    return numbered.select(
        "dataset_id", _long("next_version"), _long("process_version"), "process_name"
    )


@query
def version_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-13: process edges of the versions that come from a parent."""
    versions = catalogue(spark, sf_dir, "versions")
    numbered = ver.next_process_version(versions, ver.chain_positions(versions))
    numbered = (
        numbered.withColumn("created_by", F.col("dataset_id"))
        .withColumn("execution_time_ms", F.col("version_number") * 10)
        .withColumn("parent_name", F.concat(F.lit("v"), F.col("parent_version_id").cast("string")))
    )
    return ver.process_records(numbered).withColumn("execution_time_ms", _long("execution_time_ms"))


@query
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-5, V-6: latest and latest published version of each dataset."""
    versions = catalogue(spark, sf_dir, "versions")
    latest = ver.latest_versions(versions).select("dataset_id", "id", "version_number")
    published = ver.latest_versions(versions, published_only=True).select(
        "dataset_id", F.col("id").alias("published_id"), "external_id"
    )
    return latest.join(published, "dataset_id", "left").select(
        "dataset_id", "id", _long("version_number"), _long("published_id"), _text("external_id")
    )


@query
def version_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-7: drafts reused by the pushes, and drafts whose descriptions move on."""
    planned = ver.plan_drafts(_numbered(spark, sf_dir), catalogue(spark, sf_dir, "versions"))
    return planned.select(
        "dataset_id",
        _long("next_version"),
        _long("reuse_draft"),
        _long("draft_id"),
        _long("transfer_from"),
    )


@query
def version_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-7, V-8: drafts published under an external id, then found by it."""
    versions = catalogue(spark, sf_dir, "versions").withColumn(
        "change_comment", F.lit(ver.DRAFT_COMMENT)
    )
    published = versions.filter(F.col("external_id").isNull()).select(
        "id",
        F.concat(F.lit("new"), F.col("id").cast("string")).alias("external_id"),
        F.concat(F.lit("Push depuis "), F.col("dataset_id").cast("string")).alias("change_comment"),
    )
    after = ver.publish_versions(versions, published)
    found = ver.version_by_external_id(after, published)
    return found.select("id", "external_id", "change_comment", _long("version_number"))


@query
def version_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-9: edges between published versions."""
    return ver.version_edges(catalogue(spark, sf_dir, "versions"))


@query
def version_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-14: qualified names, and which of them exist already."""
    versions = catalogue(spark, sf_dir, "versions")
    name = ver.qualified_name(
        F.md5(F.col("id").cast("string")),
        F.when(F.col("dataset_id") % 2 == 0, F.col("dataset_id")),
        F.when(F.col("version_number") > 1, F.col("version_number")),
        F.when(F.col("external_id").isNull(), F.col("created_at")),
    )
    named = versions.withColumn("qualified_name", name)
    stored = named.filter(F.col("external_id").isNotNull())
    known = ver.already_registered(named, stored).select("id", F.lit(1).alias("known"))
    return named.join(known, "id", "left").select("id", "qualified_name", _long("known"))


# --- descriptions ------------------------------------------------------------------------------


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None)
    return catalogue(spark, sf_dir, "descriptions").select(
        "version_id",
        "column_name",
        "description",
        "created_by",
        F.to_timestamp(F.lit("2024-01-01")).alias("created_at"),
        nothing.cast("string").alias("updated_by"),
        nothing.cast("timestamp").alias("updated_at"),
    )


@query
def desc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1: descriptions after all edits."""
    edits = catalogue(spark, sf_dir, "edits")
    merged = dsc.upsert_descriptions(_descriptions(spark, sf_dir), edits)
    return merged.select(
        "version_id",
        "column_name",
        "description",
        "created_by",
        "created_at",
        _text("updated_by"),
        _text("updated_at"),
    )


@query
def desc_upsert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1 on long texts: the last turn of every role of a conversation wins, over stored texts too."""
    turns = catalogue(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("version_id"),
        F.col("role").alias("column_name"),
        F.col("text").alias("description"),
        F.col("turn").cast("string").alias("user_id"),
        F.col("turn").cast("timestamp").alias("submitted_at"),
        F.col("turn").alias("seq"),
    )
    # every other conversation has the first text of each role already
    stored = turns.filter("version_id % 2 = 0").groupBy("version_id", "column_name").agg(
        F.min_by("description", "seq").alias("description"),
        F.lit("0").alias("created_by"),
        F.to_timestamp(F.lit("2024-01-01")).alias("created_at"),
        F.lit(None).cast("string").alias("updated_by"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    merged = dsc.upsert_descriptions(stored, turns)
    return merged.select("version_id", "column_name", "description", "created_by", _text("updated_by"))


@query
def desc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-2, D-3: descriptions of the latest and of the latest published version."""
    versions = catalogue(spark, sf_dir, "versions")
    texts = catalogue(spark, sf_dir, "descriptions")
    parts = [
        dsc.version_descriptions(versions, texts, published).withColumn("published", F.lit(int(published)))
        for published in (False, True)
    ]
    both = parts[0].unionByName(parts[1])
    return both.select(
        "dataset_id",
        "version_id",
        _long("version_number"),
        "column_name",
        "description",
        _long("published"),
    )


@query
def desc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-4: versions with descriptions and descriptions in all, per dataset."""
    found = dsc.description_coverage(
        catalogue(spark, sf_dir, "versions"), catalogue(spark, sf_dir, "descriptions")
    )
    return found.select(
        "dataset_id", _long("has_descriptions"), "versions_count", "total_descriptions"
    )


@query
def desc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-5: what is left and what is gone after deleting the drafts' descriptions."""
    texts = catalogue(spark, sf_dir, "descriptions")
    drafts = catalogue(spark, sf_dir, "versions").filter(F.col("external_id").isNull())
    drafts = drafts.select(F.col("id").alias("version_id"))
    kept = dsc.delete_descriptions(texts, drafts).groupBy("version_id")
    kept = kept.agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("kept"))
    gone = dsc.deleted_counts(texts, drafts).withColumnRenamed("deleted_count", "n")
    return kept.unionByName(gone.withColumn("state", F.lit("deleted")))


@query
def desc_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-6: descriptions copied from every version to the one derived from it."""
    copies = catalogue(spark, sf_dir, "versions").select(
        F.col("parent_version_id").alias("old_version"),
        F.col("id").alias("new_version"),
        F.col("dataset_id").cast("string").alias("user_id"),
        F.col("created_at").alias("copied_at"),
    )
    copied = dsc.copied_descriptions(catalogue(spark, sf_dir, "descriptions"), copies)
    return copied.select("version_id", "column_name", "description", "created_by", "created_at")


@query
def desc_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-7: descriptions of the last five published versions."""
    found = dsc.inherited_descriptions(
        catalogue(spark, sf_dir, "versions"), catalogue(spark, sf_dir, "descriptions")
    )
    pairs = F.transform("descriptions", lambda d: F.concat_ws("=", d["column_name"], d["description"]))
    return found.select(
        "dataset_id",
        "version_id",
        _long("version_number"),
        F.array_join(pairs, "|").alias("descriptions"),
    )


@query
def desc_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-8: given, existing or generic description of every column."""
    columns = catalogue(spark, sf_dir, "version_columns")
    given = F.when(F.col("flag") == "A", F.col("type")).when(F.col("flag") == "N", F.lit("  "))
    existing = F.when(F.col("quantity") > 30, F.concat(F.lit("old "), F.col("type"))).when(
        F.col("quantity") > 20, F.lit("")
    )
    final = dsc.final_description(given, existing, "column_name")
    return columns.select("version_id", "column_name", final.alias("description"))


@query
def desc_autofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-9: blank descriptions filled from suggestions, counted per dataset."""
    fields = catalogue(spark, sf_dir, "version_columns").select(
        F.col("version_id").alias("dataset_id"),
        "column_name",
        F.when(F.col("flag") == "R", F.lit(" ")).when(F.col("flag") == "N", F.col("type")).alias("description"),
    )
    offers = catalogue(spark, sf_dir, "edits").groupBy(
        F.col("version_id").alias("dataset_id"), "column_name"
    ).agg(F.max("description").alias("description"))
    offers = offers.filter(F.trim("description") != "")
    filled = dsc.autofill(fields, offers)
    return filled.groupBy("dataset_id").agg(
        F.count_if("filled").alias("filled"),
        F.array_join(
            F.array_sort(F.collect_list(F.concat_ws("=", "column_name", "description"))), "|"
        ).alias("descriptions"),
    )


# --- classifications ---------------------------------------------------------------------------


@query
def class_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-1: requests that are never applied, with the reason."""
    rejected = cls.rejected_classifications(catalogue(spark, sf_dir, "class_log"))
    return rejected.select("id", "entity_type", "classification", "problem")


@query
def class_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-3: the log with one active row per key."""
    history = cls.classification_history(catalogue(spark, sf_dir, "class_log"))
    return history.select("id", "entity_type", "entity_id", _text("column_name"), _long("is_active"))


@query
def class_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-4, C-5: active security class and column classes of every dataset."""
    active = cls.active_classifications(catalogue(spark, sf_dir, "class_log"))
    security, columns = cls.security_class(active), cls.column_classes(active)
    entries = F.transform(F.map_entries("column_classes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return security.join(columns, "dataset_id", "full_outer").select(
        "dataset_id",
        _text("security_class"),
        F.coalesce(F.array_join(F.array_sort(entries), "|"), F.lit("")).alias("columns"),
    )


@query
def class_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-6: column classes each dataset admits."""
    active = cls.active_classifications(catalogue(spark, sf_dir, "class_log"))
    datasets = catalogue(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"))
    allowed = cls.allowed_column_classes(datasets, active)
    return allowed.select("dataset_id", "security_class", _list("allowed"))


@query
def class_allowed_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-6 in the form that offers nothing to a dataset without a class."""
    datasets = catalogue(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"))
    active = cls.active_classifications(catalogue(spark, sf_dir, "class_log"))
    allowed = cls.allowed_column_classes(datasets, active, default=None)
    return allowed.select("dataset_id", _text("security_class"), _list("allowed"))


@query
def class_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-2: column classes asked for that the dataset's class does not admit."""
    log = catalogue(spark, sf_dir, "class_log")
    wanted = log.select(
        F.col("entity_id").alias("dataset_id"),
        F.col("id").cast("string").alias("column_name"),
        "classification",
    )
    return cls.consistency_problems(wanted, cls.active_classifications(log))


@query
def class_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-7: requests completed with default attributes."""
    given = F.when(
        F.col("id") % 10 == 0, F.create_map(F.lit("visibility_scope"), F.lit("TEAM"))
    ).when(F.col("id") % 10 == 1, F.create_map(F.lit("note"), F.lit("x")))
    requests = catalogue(spark, sf_dir, "class_log").withColumn("attributes", given)
    completed = cls.with_default_attributes(requests, catalogue(spark, sf_dir, "users"))
    entries = F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return completed.select(
        "id", "classification", F.array_join(F.array_sort(entries), "|").alias("attributes")
    )


@query
def class_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-8: tags after replacing the security class of some entities."""
    tags, changes = _tags(spark, sf_dir)
    return cls.list_tags(cls.replace_security_class(tags, changes)).select("entity_id", _list("tags"))


@query
def class_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-9: tags added where missing, then removed again from the costly entities."""
    tags, changes = _tags(spark, sf_dir)
    log = catalogue(spark, sf_dir, "class_log")
    additions = log.select("entity_id", F.lit("DQ_SUMMARY").alias("tag")).unionByName(changes)
    removals = log.filter("classification = 'UNKNOWN'").select("entity_id", F.lit("PII").alias("tag"))
    after = cls.remove_tags(cls.add_tags(tags, additions), removals)
    counts = after.groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows"))
    return cls.list_tags(after).join(counts, "entity_id").select("entity_id", _list("tags"), "rows")


def _tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = catalogue(spark, sf_dir, "class_log")
    tags = log.select("entity_id", F.col("classification").alias("tag")).distinct()
    loud = log.filter("entity_type = 'TABLE'").groupBy("entity_id").agg(F.max("id").alias("last"))
    new = F.when(F.col("last") % 2 == 0, F.lit("PUBLIC")).otherwise(F.lit("RESTRICTED"))
    return tags, loud.select("entity_id", new.alias("tag"))


# --- graph and access --------------------------------------------------------------------------


def _dataset_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = (
        catalogue(spark, sf_dir, "lineitem")
        .join(catalogue(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(catalogue(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("dataset_id"))
        .agg(F.array_sort(F.collect_set("p_type")).alias("columns_list"))
    )
    datasets = (
        catalogue(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("dataset_id"),
            F.concat(F.col("c_name"), F.lit(".csv")).alias("name"),
            F.md5("c_name").alias("hash"),
            F.concat(F.lit("/data/"), F.col("c_name")).alias("file_path"),
            F.col("c_nationkey").alias("project_id"),
            F.col("c_custkey").cast("string").alias("owner_employee_id"),
            F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("description"),
        )
        .join(types, "dataset_id")
    )
    parent = F.concat(F.lit("v"), F.col("parent_version_id").cast("string"))
    versions = catalogue(spark, sf_dir, "versions").withColumn("parent_name", parent)
    return gra.dataset_nodes(versions, datasets)


@query
def graph_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-1: dataset nodes of the published versions."""
    return _dataset_nodes(spark, sf_dir).select(
        "node_id",
        "qualified_name",
        "name",
        "description",
        "version_comment",
        _long("columns_count"),
        _list("columns_list"),
        "owner",
        _text("project"),
    )


def _column_nodes(spark: SparkSession, sf_dir: str, written: bool = False, **known: DataFrame) -> DataFrame:
    """Column nodes; ``written`` keeps the matched columns, so that their shuffles are gone before the texts are met."""
    node = F.concat(F.lit("g"), F.col("version_id").cast("string"))
    old = F.when(F.col("quantity") > 40, F.concat(F.lit("old "), F.col("type")))
    matched = _detailed(spark, sf_dir, **known).filter("column_name IS NOT NULL")
    if written:
        matched = cut_lineage(matched.select("version_id", "qualified_name", "column_name", "type", "quantity", "position", "logical_id"))
    matched = matched.withColumns({"existing_description": old, "dataset_node": node})
    return gra.column_nodes(matched, catalogue(spark, sf_dir, "descriptions", **known))


@query
def graph_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-2: column nodes with logical id and final description."""
    return _column_nodes(spark, sf_dir, written=True, **_written(spark, sf_dir)).select(
        "node_id", "qualified_name", "name", "type", _long("position"), "logical_id", "description"
    )


def _check_nodes(spark: SparkSession, sf_dir: str, **known: DataFrame) -> DataFrame:
    node = F.concat(F.lit("g"), F.col("version_id").cast("string"))
    known = known or _written(spark, sf_dir)
    columns = known["version_columns"].filter(F.col("flag") != "N")
    columns = columns.select(
        node.alias("version_node"),
        "column_name",
        F.sha2(
            F.concat_ws(".", F.concat(F.lit("p_"), F.col("version_id").cast("string")), "column_name"), 256
        ).alias("column_node"),
    )
    checks = _checks(spark, sf_dir, **known).withColumn("version_node", node)
    return gra.check_nodes(checks, columns)


@query
def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-3: check nodes."""
    return _check_nodes(spark, sf_dir).select(
        "node_id",
        "qualified_name",
        "name",
        "check_type",
        _text("column_name"),
        "error_count",
        _double("ratio"),
        "dag_run_id",
        _text("examples"),
        "quality_tag",
        _text("column_node"),
    )


@query
def graph_check_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-4: checks on known columns and on the dataset, per version."""
    return gra.check_link_counts(_check_nodes(spark, sf_dir))


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-5: all edges of the graph."""
    known = _written(spark, sf_dir)
    # Names are written and joined, as they are shorter than the ids they give.
    named = cut_lineage(_column_nodes(spark, sf_dir, **known).select("version_id", "name", "qualified_name", "dataset_node"))
    versions = catalogue(spark, sf_dir, "versions")
    external = named.select("version_id", F.col("name").alias("column_name"), F.col("qualified_name").alias("external_id"))
    links = versions.select(F.col("id").alias("version_id"), "parent_version_id")
    # Written as names, too: its shuffles are gone before those of the checks are made.
    above = cut_lineage(col.column_edges(external.join(links, "version_id"), external))
    return gra.graph_edges(
        named.withColumn("node_id", F.sha2("qualified_name", 256)),
        _check_nodes(spark, sf_dir, **known),
        ver.version_edges(versions),
        above.withColumns({end: F.sha2(end, 256) for end in ("child", "parent")}),
    )


def _grants(spark: SparkSession, sf_dir: str, action: str) -> DataFrame:
    projects, users = catalogue(spark, sf_dir, "projects"), catalogue(spark, sf_dir, "users")
    return acc.access_grants(projects, users, action)


@query
def access_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1, A-2: the audiences that may view or upload."""
    parts = [
        _grants(spark, sf_dir, action).withColumn("action", F.lit(action))
        for action in ("view", "upload")
    ]
    return parts[0].unionByName(parts[1])


@query
def access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1, A-2: how many projects every user may view and upload to."""
    users = catalogue(spark, sf_dir, "users")
    counts = [
        acc.visible_project_counts(users, _grants(spark, sf_dir, action)).withColumnRenamed("projects", action)
        for action in ("view", "upload")
    ]
    return counts[0].join(counts[1], "employee_id")


@query
def access_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1: how many projects every user sees, and how many of them are their own."""
    projects, users = catalogue(spark, sf_dir, "projects"), catalogue(spark, sf_dir, "users")
    grants = _grants(spark, sf_dir, "view")
    own = acc.own_project_counts(users, projects, grants)
    joined = acc.visible_project_counts(users, grants).join(own, "employee_id", "left")
    return joined.select("employee_id", "projects", F.coalesce("own_projects", F.lit(0)).cast("bigint").alias("own_projects"))


@query
def access_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-4: the datasets that owners may preview, describe or profile."""
    owner = catalogue(spark, sf_dir, "projects").select("project_id", "owner_employee_id")
    datasets = catalogue(spark, sf_dir, "project_datasets").join(owner, "project_id")
    return acc.owned_by(datasets, catalogue(spark, sf_dir, "users")).select("dataset_id", "owner_employee_id")


@query
def access_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3: projects with dataset counts, and whether their owner may delete them."""
    projects = catalogue(spark, sf_dir, "projects")
    datasets = catalogue(spark, sf_dir, "project_datasets")
    roles = catalogue(spark, sf_dir, "users").select(
        F.col("employee_id").alias("owner_employee_id"), "role"
    )
    empty = acc.deletable_projects(projects, datasets).join(roles, "owner_employee_id")
    may = acc.may_delete("role", "owner_employee_id", "owner_employee_id")
    deletable = empty.filter(may).select("project_id", F.lit(1).alias("deletable"))
    overview = acc.project_overview(projects, datasets).join(deletable, "project_id", "left")
    return overview.select("project_id", "name", "datasets_count", _long("deletable"))


# --- publishing --------------------------------------------------------------------------------


def _publish(spark: SparkSession, sf_dir: str):
    """All orders that are drafts yet, pushed in one batch against the published ones."""
    orders = catalogue(spark, sf_dir, "orders")
    made = {"version_columns": cut_lineage(catalogue(spark, sf_dir, "version_columns"))}
    draft = F.col("o_orderpriority") == "5-LOW"
    # Every published order is the only version of its own dataset here.
    versions = orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderkey").alias("dataset_id"),
        F.lit(1).alias("version_number"),
        F.when(~draft, F.concat(F.lit("g"), F.col("o_orderkey").cast("string"))).alias("external_id"),
        F.lit(None).cast("string").alias("parent_version_id"),
    )
    pending = orders.filter(draft).select(
        F.col("o_orderkey").alias("dataset_id"),
        F.col("o_custkey").alias("project_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("hash"),
        F.col("o_totalprice").cast("bigint").alias("rows_count"),
        F.col("o_custkey").cast("string").alias("pushed_by"),
        F.col("o_orderdate").alias("pushed_at"),
    )
    text_id = F.col("version_id").cast("string").alias("version_id")
    known = catalogue(spark, sf_dir, "known_columns", **made).select(
        text_id,
        "column_name",
        "position",
        "logical_id",
        F.md5(F.concat_ws("#", "version_id", "column_name")).alias("external_id"),
    )
    lineage = catalogue(spark, sf_dir, "lineage", **made).withColumn(
        "dataset_version_id", F.col("dataset_version_id").cast("string")
    )
    columns = made["version_columns"].select(
        F.col("version_id").alias("dataset_id"), "column_name", "position", "type"
    )
    checks = _checks(spark, sf_dir, **made).withColumnRenamed("version_id", "dataset_id")
    texts = catalogue(spark, sf_dir, "descriptions", **made).select(text_id, "column_name", "description")
    # some of the nodes exist already: a push that was not recorded
    nodes = pending.filter("dataset_id % 2 = 0").select(
        ver.qualified_name("hash", "project_id", F.lit(2)).alias("qualified_name")
    )
    known_now = Catalogue(
        versions, catalogue(spark, sf_dir, "signatures"), known, lineage, texts, nodes
    )
    return publish(pending, columns, checks, known_now)


@query
def push_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-6: report of publishing all drafts in one batch."""
    report = _publish(spark, sf_dir).report
    return report.select(
        "dataset_id",
        "version_id",
        _long("version_number"),
        _text("parent_version_id"),
        "process_name",
        "columns_count",
        "rows_count",
        "propagated",
        _double("similarity_score"),
        "data_quality_checks",
        _long("quality_summary_added"),
        _long("dataset_existed"),
    )


@query
def push_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-13: history rows of the same batch, with a failed push for every existing version."""
    done = _publish(spark, sf_dir).history
    failed = catalogue(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("dataset_id"),
        F.to_timestamp(F.lit("2024-01-01")).alias("pushed_at"),
        F.col("source").alias("pushed_by"),
        F.col("text").alias("error_message"),
        F.lit(None).cast("int").alias("execution_time_ms"),
        F.lit(1).alias("columns_count"),
        "n_chars",
        F.lit(None).cast("string").alias("parent_version_id"),
        F.lit(0.0).alias("similarity_score"),
        F.lit(0).alias("propagated"),
    )
    rows = files.push_history_rows(failed.withColumnRenamed("n_chars", "rows_count"))
    both = done.unionByName(rows)
    return both.select(
        "dataset_id",
        "pushed_at",
        "pushed_by",
        "status",
        _text("error_message"),
        _long("columns_count"),
        _long("rows_count"),
        _long("parent_found"),
        _double("similarity_score"),
        _long("propagated_columns_count"),
    )


def _linked_push(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Published]:
    """All customers pushed at once: most go on from their own chains, some reuse or replace a draft.

    Gives the versions before the push, and the push.
    """
    # Read by every step of the push: written once.
    versions = cut_lineage(
        catalogue(spark, sf_dir, "versions").select(
            F.col("id").cast("string").alias("id"),
            "dataset_id",
            "version_number",
            "external_id",
            F.col("parent_version_id").cast("string").alias("parent_version_id"),
            F.lit(ver.DRAFT_COMMENT).alias("change_comment"),
        )
    )
    customers = catalogue(spark, sf_dir, "customer")
    pending = customers.select(
        F.col("c_custkey").alias("dataset_id"),
        F.col("c_nationkey").alias("project_id"),
        F.md5("c_name").alias("hash"),
        F.concat(F.lit("/data/"), F.col("c_name"), F.lit(".csv")).alias("file_path"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("description"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_public"),
        F.col("c_custkey").alias("rows_count"),
        F.col("c_custkey").cast("string").alias("pushed_by"),
        F.to_timestamp(F.lit("2024-02-01")).alias("pushed_at"),
    )
    newest = catalogue(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(F.max("o_orderkey").alias("version_id"))
    # Only the newest version of a dataset is pushed: the lines of all others are left out before they meet their parts.
    pushed_lines = catalogue(spark, sf_dir, "lineitem").join(newest.select(F.col("version_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    columns = catalogue(spark, sf_dir, "version_columns", lineitem=pushed_lines).join(newest, "version_id")
    checks = _checks(spark, sf_dir, lineitem=pushed_lines).join(newest, "version_id").drop("version_id")
    runs = catalogue(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(
        F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("dag_run_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("id"),
    )
    texts = _descriptions(spark, sf_dir).withColumn("version_id", F.col("version_id").cast("string"))
    named = versions.filter("external_id IS NOT NULL").join(pending.select("dataset_id", "hash", "project_id"), "dataset_id")
    nodes = named.select(
        ver.qualified_name("hash", "project_id", "version_number").alias("qualified_name"), F.col("external_id").alias("node_id")
    )
    users = catalogue(spark, sf_dir, "users").withColumn("employee_id", F.col("employee_id").cast("string"))
    nothing = {
        "signatures": "project_id int, dataset_id bigint, name_base string, column_name string, data_type string, sample_hash string",
        "columns": "version_id string, column_name string, position int, logical_id string, external_id string",
        "lineage": "id string, dataset_version_id string, logical_column_id string, column_name string",
    }
    empty = {name: spark.createDataFrame([], ddl) for name, ddl in nothing.items()}
    known = Catalogue(versions, descriptions=texts, nodes=nodes, runs=runs, users=users, **empty)
    return versions, publish(pending, columns.select("dataset_id", "column_name", "position", "type"), checks, known)


def _stored_push(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables of a push that was killed once, stored, and sent again."""
    versions, pushed = _linked_push(spark, sf_dir)
    root = scratch_path(spark, "store")
    commits.commit(spark, root, "before", {"versions": versions})
    lost = {"versions": versions.withColumn("change_comment", F.lit("staged and never committed"))}
    commits.stage(root, "killed", lost)
    commits.stage(root, "push", lost)
    for _ in range(2):
        store_push(spark, root, "push", pushed, only=[*names])
    return [stored_table(spark, root, name) for name in names]


@query
def push_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-6, V-7: the versions after a stored push; reused drafts are published, replaced ones stay."""
    (versions,) = _stored_push(spark, sf_dir, "versions")
    return versions.select(
        "id", "dataset_id", _long("version_number"), _text("external_id"), _text("parent_version_id"), "change_comment"
    )


@query
def push_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-6, G-1, C-7: dataset nodes of a stored push with their security classes."""
    nodes, classes, registry = _stored_push(spark, sf_dir, "dataset_nodes", "classes", "registry")
    joined = nodes.join(classes, F.col("node_id") == F.col("entity_id")).join(
        registry.select(F.col("external_id").alias("node_id"), "last_modified_by"), "node_id"
    )
    return joined.select(
        "node_id",
        "qualified_name",
        "name",
        "description",
        "version_comment",
        _long("columns_count"),
        _list("columns_list"),
        "owner",
        F.col("project").cast("string").alias("project"),
        "classification",
        F.col("attributes")["visibility_scope"].alias("scope"),
        _text(F.col("attributes")["department"], "department"),
        "last_modified_by",
    )


@query
def push_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-6, S-10: typed results of a stored push, of the runs that are known."""
    (results,) = _stored_push(spark, sf_dir, "results")
    return results.select(
        "dag_run_uuid",
        "dataset_version_id",
        "check_type",
        _text("column_name"),
        "status",
        "error_count",
        _double("ratio"),
        _long("alert"),
        "examples",
    )


@query
def push_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-6, D-6: descriptions that a stored push moved from replaced drafts to the new versions."""
    (moved,) = _stored_push(spark, sf_dir, "descriptions")
    return moved.select("version_id", "column_name", "description", "created_by", "created_at", "updated_by", "updated_at")


@query
def push_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-6, V-13: process records of a stored push, with who made them and the parent's name."""
    (processes,) = _stored_push(spark, sf_dir, "processes")
    return processes.select(
        "process_id", "process_name", "input_version_id", "output_version_id", "created_by", "status",
        F.get_json_object("metadata", "$.parent_qn").alias("parent_name"),
    )
