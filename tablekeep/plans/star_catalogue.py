"""A catalogue derived from a star schema, whole table by whole table.

The operators work on catalogue tables (versions, signatures, classifications...).
Each recipe below makes one of them from the sales tables, in SQL that reads the
same everywhere, so its size grows with the data. Orders play dataset versions,
customers datasets, part names columns, suppliers projects; dirt is injected by
value, as the tables themselves are clean.
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of input files whose rows one task brings together: some 25 times as much in memory, sorted.
TASK_BYTES = 16 << 20

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

RECIPES = {
    # Orders with nulls, blanks and the literal NULL in one column.
    "dirty_orders": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 11 = 1 THEN ''
                    WHEN o_orderkey % 11 = 2 THEN '  '
                    WHEN o_orderkey % 11 = 3 THEN 'NULL'
                    ELSE o_orderstatus END AS o_orderstatus
        FROM {orders}""",
    # One text per pattern, some of them malformed.
    "contacts": """
        SELECT c_custkey,
               'user' || CAST(c_custkey AS STRING)
                   || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '@' END || 'ex.com' AS email,
               CASE WHEN c_custkey % 6 = 0 THEN 'tel ' ELSE '+' END
                   || CAST(3300000000 + c_custkey AS STRING) AS phone,
               CASE WHEN c_custkey % 4 = 0 THEN '9' ELSE '' END
                   || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS postal_code,
               CAST(c_custkey AS STRING)
                   || CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE '' END AS digits,
               CASE WHEN c_custkey % 7 = 0 THEN c_name
                    WHEN c_custkey % 7 = 1 THEN NULL
                    ELSE ' ' || replace(c_name, '#', '') || ' ' END AS word,
               '2024' || CASE WHEN c_custkey % 8 = 0 THEN '/' ELSE '-' END
                   || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-'
                   || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS day,
               '10.' || CAST(c_custkey % 300 AS STRING) || '.0.'
                   || CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE '1' END AS ip
        FROM {customer}""",
    # Returned line items were entered twice.
    "double_lineitem": """
        SELECT * FROM {lineitem}
        UNION ALL
        SELECT * FROM {lineitem} WHERE l_returnflag = 'R'""",
    # Stored rule sets, one per order, in all accepted shapes.
    "rule_sets": """
        SELECT o_orderkey AS run_id, o_orderkey AS dataset_id,
               CASE o_orderkey % 6
               WHEN 0 THEN '{{"deequ":[{{"type":"completeness","column":"red bolt"}},'
                   || '{{"type":"min","column":"old_gear","threshold":'
                   || CAST(o_custkey AS STRING) || '}},'
                   || '{{"type":"allowed_values","column":"","values":["a"]}}],'
                   || '"duplicates":["red bolt"]}}'
               WHEN 1 THEN '{{"regex":{{"email":["hot ring","new gear"],"ip":["no such"]}},'
                   || '"duplicates":{{"sensitive":[],"full_row":true}}}}'
               WHEN 2 THEN '{{"regex":{{"blue_bolt":["phone","word"]}},'
                   || '"deequ":[{{"type":"completeness","column":"blue_bolt","threshold":1.5}},'
                   || '{{"type":"max","column":"blue_bolt"}}]}}'
               WHEN 3 THEN '{{"regex":[{{"column":"small ring","rule_type":"date"}}],'
                   || '"deequ":[{{"type":"allowed_values","column":"small ring",'
                   || '"values":[" A ","","B"]}},'
                   || '{{"type":"allowed_values","column":"small ring","values":[" "]}},'
                   || '{{"type":"unique","column":"small ring"}}],'
                   || '"duplicates":{{"sensitive":["small ring"],"full_row":false}}}}'
               WHEN 4 THEN '{{"regex":{{"email":"hot ring"}},'
                   || '"deequ":[{{"type":"allowed_values","column":"small ring","values":"a, b"}},'
                   || '{{"type":"completeness","column":"hot ring","threshold":null}}],'
                   || '"duplicates":{{"sensitive":"old_gear","full_row":1}}}}'
               ELSE 'rules of ' || CAST(o_custkey AS STRING)
               END AS rules
        FROM {orders}""",
    # Columns of a version: the distinct parts of an order, half of them spelt with "_".
    "version_columns": """
        SELECT version_id, column_name, type, quantity, flag, line, status, part_key,
               CAST(row_number() OVER (PARTITION BY version_id ORDER BY line, column_name) - 1
                    AS INT) AS position
        FROM (
            SELECT l_orderkey AS version_id,
                   CASE WHEN l_linestatus = 'F' THEN replace(p_name, ' ', '_')
                        ELSE p_name END AS column_name,
                   min(p_type) AS type, min(l_quantity) AS quantity, min(l_returnflag) AS flag,
                   min(l_linenumber) AS line, min(l_linestatus) AS status,
                   min(l_partkey) AS part_key
            FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
            GROUP BY l_orderkey,
                     CASE WHEN l_linestatus = 'F' THEN replace(p_name, ' ', '_') ELSE p_name END
        ) AS named""",
    # Versions of a customer's dataset. Partial orders derive from the version before
    # the last, which branches; the first one of some customers closes a cycle.
    "versions": """
        SELECT id, dataset_id, version_number, external_id,
               CASE WHEN version_number = 1 AND dataset_id % 40 = 0 THEN newest
                    WHEN branches THEN before_last ELSE previous END AS parent_version_id,
               created_at
        FROM (
            SELECT o_orderkey AS id, o_custkey AS dataset_id, o_orderdate AS created_at,
                   o_orderstatus = 'P' AS branches,
                   CASE WHEN o_orderpriority = '5-LOW' THEN NULL
                        ELSE 'g' || CAST(o_orderkey AS STRING) END AS external_id,
                   CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
                        AS INT) AS version_number,
                   lag(o_orderkey, 1) OVER (PARTITION BY o_custkey
                                            ORDER BY o_orderdate, o_orderkey) AS previous,
                   lag(o_orderkey, 2) OVER (PARTITION BY o_custkey
                                            ORDER BY o_orderdate, o_orderkey) AS before_last,
                   last_value(o_orderkey) OVER (PARTITION BY o_custkey
                       ORDER BY o_orderdate, o_orderkey
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest
            FROM {orders}
        ) AS numbered""",
    # Pushes to come: one per customer, from the version its nation neighbour shares.
    "pushes": """
        SELECT c_custkey AS dataset_id,
               CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
                    ELSE last_order END AS parent_version_id,
               c_acctbal AS balance
        FROM {customer}
        LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM {orders}
                   GROUP BY o_custkey) AS latest
          ON latest.o_custkey = CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey - 1
                                     ELSE c_custkey END""",
    # Column signatures: every order is a dataset, its customer the project, the kinds
    # of goods in it the columns.
    "signatures": """
        SELECT o_custkey AS project_id, o_orderkey AS dataset_id,
               lower(o_orderpriority) || '_' || lower(o_orderstatus) AS name_base,
               column_name, data_type, sample_hash
        FROM (
            SELECT l_orderkey, split_part(p_name, ' ', 2) || '_' || l_linestatus AS column_name,
                   CASE min(l_returnflag) WHEN 'A' THEN 'numeric' WHEN 'N' THEN 'datetime'
                                          ELSE 'string' END AS data_type,
                   md5(CAST(CAST(min(l_quantity) AS BIGINT) % 5 AS STRING)) AS sample_hash
            FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
            GROUP BY l_orderkey, split_part(p_name, ' ', 2) || '_' || l_linestatus
        ) AS goods JOIN {orders} ON o_orderkey = l_orderkey""",
    "published": """
        SELECT o_orderkey AS dataset_id FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    # Columns with the logical ids an earlier push left behind, some without one.
    "known_columns": """
        SELECT version_id, column_name, position, flag,
               CASE WHEN quantity < 5 THEN NULL
                    ELSE md5(column_name || '@' || CAST(version_id AS STRING))
               END AS logical_id
        FROM {version_columns}""",
    "child_columns": """
        SELECT version_id, parent_version_id, 'p_' || CAST(version_id AS STRING) AS qualified_name,
               column_name, position,
               CASE WHEN quantity > 48 THEN md5(column_name) ELSE NULL END AS existing_id
        FROM {version_columns} JOIN {versions} ON id = version_id""",
    "lineage": """
        SELECT md5(CAST(version_id AS STRING) || '|' || column_name) AS id,
               version_id AS dataset_version_id, logical_id AS logical_column_id, column_name
        FROM {known_columns} WHERE logical_id IS NOT NULL""",
    # Descriptions of version columns; returned parts have none, accepted ones a blank.
    "descriptions": """
        SELECT version_id, column_name,
               type || ' part of line ' || CAST(line AS STRING) AS description,
               CAST(part_key AS STRING) AS created_by
        FROM {version_columns} WHERE flag <> 'R'""",
    # Description edits, one per line item, in the order of shipping.
    "edits": """
        SELECT l_orderkey AS version_id,
               CASE WHEN l_linestatus = 'F' THEN replace(p_name, ' ', '_')
                    ELSE p_name END AS column_name,
               CASE WHEN l_quantity < 10 THEN '  '
                    ELSE '  ' || p_type || ' ' || CAST(l_partkey AS STRING) || ' ' END AS description,
               CAST(l_suppkey AS STRING) AS user_id, l_shipdate AS submitted_at,
               CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
                   || CAST(l_suppkey AS STRING) || '-' || CAST(l_quantity AS STRING) AS seq
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # Checks of a version's run.
    "checks": """
        SELECT version_id, 'run' || CAST(version_id AS STRING) AS dag_run_id,
               CASE flag WHEN 'A' THEN 'completeness' WHEN 'N' THEN 'regex_email'
                         ELSE 'min' END AS rule_type,
               CASE WHEN line = 1 THEN NULL ELSE column_name END AS column_name,
               CASE WHEN flag = 'A' AND status = 'F' THEN 'réussi'
                    WHEN flag = 'A' THEN ' Pass '
                    WHEN flag = 'N' AND status = 'F' THEN 'Échoué'
                    WHEN flag = 'N' THEN 'success'
                    WHEN status = 'F' THEN 'ignoré'
                    WHEN quantity < 10 THEN ''
                    WHEN quantity < 20 THEN NULL
                    ELSE 'failed' END AS status,
               CAST(quantity AS BIGINT) AS error_count,
               CASE WHEN quantity < 3 THEN 'junk'
                    WHEN quantity < 5 THEN '0.5'
                    WHEN quantity < 7 THEN ''
                    WHEN quantity < 9 THEN '1/2/3'
                    WHEN quantity < 11 THEN NULL
                    ELSE CAST(line AS STRING) || '/' || CAST(part_key % 3 AS STRING) END AS ratio,
               type AS example
        FROM {version_columns}""",
    # Classification requests in the order of the events.
    "class_log": """
        SELECT event_id AS id,
               CASE event_type WHEN 'signup' THEN 'DATASET' WHEN 'purchase' THEN 'DATASET'
                               WHEN 'error' THEN 'TABLE' ELSE 'COLUMN' END AS entity_type,
               user_id AS entity_id,
               CASE WHEN event_type IN ('view', 'click')
                    THEN 'c' || CAST(event_id % 4 AS STRING) ELSE NULL END AS column_name,
               CASE WHEN value < 2 THEN 'UNKNOWN'
                    WHEN event_type = 'signup' THEN 'PUBLIC'
                    WHEN event_type = 'purchase' THEN 'RESTRICTED'
                    WHEN event_type = 'view' THEN 'PII'
                    ELSE 'SENSITIVE' END AS classification,
               user_id * 7 AS applied_by, ts AS applied_at
        FROM {events}""",
    "users": """
        SELECT c_custkey AS employee_id, n_name AS department,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'ADMIN' WHEN 'MACHINERY' THEN 'AUDIT'
                                 ELSE 'DATA_OWNER' END AS role
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "projects": """
        SELECT s_suppkey AS project_id, s_name AS name,
               CASE WHEN s_acctbal < 1000 THEN -1 - s_suppkey ELSE s_suppkey * 15 END
                   AS owner_employee_id,
               CASE WHEN s_acctbal < 5000 THEN 'DEPARTMENT' ELSE 'PUBLIC' END AS visibility
        FROM {supplier}""",
    "project_datasets": """
        SELECT l_partkey AS dataset_id, min(l_suppkey) AS project_id
        FROM {lineitem} GROUP BY l_partkey""",
}


def inputs_of(name: str) -> list[str]:
    """Tables and recipes a recipe reads."""
    return [n for n in (*TABLES, *RECIPES) if "{" + n + "}" in RECIPES[name]]


def _dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` brought together by ``key``, in more partitions than usual if the ``size`` of their files asks for it.

    Joins and groups on the key keep the partitions, so what a task sorts does not grow with the tables.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = math.ceil(size / TASK_BYTES)
    return rows.repartition(needed, key) if needed > usual else rows.repartition(key)


def _file_bytes(rows: DataFrame) -> int:
    """Bytes of the files that ``rows`` are read from."""
    spark = rows.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in rows.inputFiles()]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def _with_parts(lineitem: DataFrame, part: DataFrame, size: int) -> DataFrame:
    """Lines with their parts; dealt by part beforehand only if they are many."""
    usual = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _dealt(lineitem, "l_partkey", size) if size > usual * TASK_BYTES else lineitem
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _signatures(lineitem: DataFrame, part: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows of that recipe: an order's lines are brought together once, for its columns and the order itself."""
    size = _file_bytes(lineitem)
    column_name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("_"), F.col("l_linestatus"))
    flag = F.min("l_returnflag")
    goods = (
        _dealt(_with_parts(lineitem, part, size).select("l_orderkey", column_name.alias("column_name"), "l_returnflag", "l_quantity"), "l_orderkey", size)
        .groupBy("l_orderkey", "column_name")
        .agg(
            F.when(flag == "A", "numeric").when(flag == "N", "datetime").otherwise("string").alias("data_type"),
            F.md5((F.min("l_quantity").cast("bigint") % 5).cast("string")).alias("sample_hash"),
        )
    )
    base = F.concat(F.lower("o_orderpriority"), F.lit("_"), F.lower("o_orderstatus"))
    return goods.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderkey").alias("dataset_id"),
        base.alias("name_base"),
        "column_name",
        "data_type",
        "sample_hash",
    )


def _version_columns(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The rows of that recipe: a version's lines are brought together once, for its columns and their positions."""
    spelt = F.when(F.col("l_linestatus") == "F", F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    size = _file_bytes(lineitem)
    lines = _with_parts(lineitem, part, size).select(
        F.col("l_orderkey").alias("version_id"),
        spelt.alias("column_name"),
        F.col("p_type").alias("type"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("status"),
        F.col("l_partkey").alias("part_key"),
    )
    values = [c for c in lines.columns if c not in ("version_id", "column_name")]
    order = Window.partitionBy("version_id").orderBy("line", "column_name")
    return (
        _dealt(lines, "version_id", size)
        .groupBy("version_id", "column_name")
        .agg(*[F.min(c).alias(c) for c in values])
        .withColumn("position", (F.row_number().over(order) - 1).cast("int"))
    )


def placed_columns(version_columns: DataFrame, versions: DataFrame) -> DataFrame:
    """Version columns with their ``places``: one for every row of their version, with its parent.

    Both sides are dealt by version, so no column is shuffled again to be joined with its version.
    """
    places = versions.groupBy("id").agg(F.collect_list(F.struct("parent_version_id")).alias("places"))
    return version_columns.join(places, F.col("id") == F.col("version_id"), "left").drop("id")


def detailed_columns(placed: DataFrame) -> DataFrame:
    """The rows of the recipe ``child_columns``, with the ``type`` and ``quantity`` of the column."""
    return placed.select(
        "version_id",
        F.inline("places"),
        F.concat(F.lit("p_"), F.col("version_id").cast("string")).alias("qualified_name"),
        "column_name",
        "position",
        F.when(F.col("quantity") > 48, F.md5("column_name")).alias("existing_id"),
        "type",
        "quantity",
    )


#: Recipes whose rows Spark makes with fewer shuffles than by their SQL.
BUILDERS = {"version_columns": _version_columns, "signatures": _signatures}


def catalogue(spark: SparkSession, sf_dir: str, name: str, **known: DataFrame) -> DataFrame:
    """A table of the star schema or one derived from it; ``known`` are tables that were made already."""
    if name in known:
        return known[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    frames = {n: catalogue(spark, sf_dir, n, **known) for n in inputs_of(name)}
    return BUILDERS[name](**frames) if name in BUILDERS else spark.sql(RECIPES[name], **frames)
