"""Files in and out: tables, content fingerprints, registries and run documents."""

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.functions.lineage import cut_lineage, ship_package
from tablekeep.operators.results import RUN_SCHEMA

PREVIEW_ROWS = 100
ERROR_TEXT_LENGTH = 500
# Bytes that one task hashes, about.
TASK_BYTES = 1 << 30
CHUNK_BYTES = 4 << 20


#: Types a column of texts may have, narrowest first; the first that fits every value is taken, else string.
LATTICE = ("int", "bigint", "double", "date", "timestamp", "boolean")


def column_types(texts: DataFrame) -> DataFrame:
    """``position, column_name, type, filled`` and ``misfits`` of a table of texts, from one aggregate.

    ``misfits`` counts for every type of LATTICE the values that do not fit it; the type is the first without any. A
    column without values is a string. The counts merge, so a file of any size is one pass with a small result.
    """
    names, aggs, rows = texts.columns, [], []
    for i, name in enumerate(names):
        value = F.trim(F.col("`" + name.replace("`", "``") + "`"))
        aggs.append(F.count(value).alias(f"n{i}"))
        aggs += [F.count_if(value.isNotNull() & ~_fits(value, kind)).alias(f"{kind}{i}") for kind in LATTICE]
        kind = F.lit("string")
        for name_of_type in reversed(LATTICE):
            kind = F.when((F.col(f"{name_of_type}{i}") == 0) & (F.col(f"n{i}") > 0), F.lit(name_of_type)).otherwise(kind)
        counts = F.create_map(*[x for k in LATTICE for x in (F.lit(k), F.col(f"{k}{i}"))])
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                kind.alias("type"),
                F.col(f"n{i}").alias("filled"),
                counts.alias("misfits"),
            )
        )
    return texts.agg(*aggs).select(F.inline(F.array(*rows)))


def _fits(value: Column, kind: str) -> Column:
    """Whether a text is a value of the type: numbers and dates in their usual form, not any text that casts."""
    forms = {
        "int": r"^[+-]?[0-9]{1,10}$",
        "bigint": r"^[+-]?[0-9]{1,19}$",
        "double": r"(?i)^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$|^nan$|^[+-]?inf(inity)?$",
        "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
        "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$",
        "boolean": r"(?i)^(true|false)$",
    }
    return value.rlike(forms[kind]) & value.try_cast(kind).isNotNull()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema the types come from all values of each column (one more scan)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    texts = reader.csv(path)
    kinds = {r.column_name: r.type for r in column_types(texts).collect()}
    columns = [("`" + c.replace("`", "``") + "`", c) for c in texts.columns]
    return texts.select(*[F.trim(F.col(q)).try_cast(kinds[c]).alias(c) if kinds[c] != "string" else F.col(q) for q, c in columns])


def write_table(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at ``path``."""
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_csv(
    spark: SparkSession, source: str, target: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Convert an uploaded CSV to Parquet and return the stored table."""
    write_table(read_csv(spark, source, schema), target)
    return read_table(spark, target)


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, in a fixed order when keys are given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


# --- fingerprints and the registry -------------------------------------------------------------


def _opened(path: str):
    """File system of a path, the path inside it, and what stands before that in the full name."""
    from pyarrow import fs

    # The root names the file system; the path itself is not URL-encoded.
    root, name = re.fullmatch(r"(?:([^:/]+:)/*)?(.*)", path).groups()
    if root is None or root == "file:":
        return fs.LocalFileSystem(), "/" + name.lstrip("/"), "file:"
    system, inside = fs.FileSystem.from_uri(f"{root}//{quote(name)}")
    return system, inside, f"{root}//{name}".removesuffix(inside)


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each folder holds; hidden names are left out, and a file stands for itself."""
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch["path"]:
            system, name, prefix = _opened(path)
            entry = system.get_file_info(name)
            if entry.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            inside = [entry]
            if entry.type == fs.FileType.Directory:
                inside = [e for e in system.get_file_info(fs.FileSelector(name)) if e.base_name[0] not in "._"]
            found += [(prefix + e.path, e.size or 0, e.type == fs.FileType.Directory) for e in inside]
        yield pd.DataFrame(found, columns=["path", "length", "folder"])


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length`` of all files below the paths, listed in tasks, one level of folders after the other.

    Spark's own listing leaves out empty files, which are uploads too. The store must be one that both Spark and
    pyarrow know: local files, HDFS, S3, GCS or Azure.
    """
    ship_package(spark)
    paths = [path] if isinstance(path, str) else path
    level = spark.createDataFrame([(p,) for p in paths], "path string")
    found = None
    while True:
        spread = level.repartition(spark.sparkContext.defaultParallelism, "path")
        entries = cut_lineage(spread.mapInPandas(_list_folders, "path string, length bigint, folder boolean"))
        files = entries.filter("NOT folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = entries.filter("folder").select("path")
        if level.isEmpty():
            return found


def _hash_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of whole files, read in chunks where the task runs."""
    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, name, _ = _opened(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name, compression=None) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "hash": digests})


def content_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length, hash`` (SHA-256 of the content) of every file, empty ones included.

    Files of any size are read as streams, spread over as many tasks as their bytes ask for.
    """
    files = list_files(spark, path)
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    # A given number of partitions is not merged by adaptive execution, which sees only the short rows.
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-total.bytes // TASK_BYTES))
    spread = files.repartition(max(1, min(total.n, wanted)), "path")
    return spread.mapInPandas(_hash_streams, "path string, length bigint, hash string")


def identical_uploads(hashes: DataFrame) -> DataFrame:
    """Content hashes held by several files: how often, and the first path."""
    return (
        hashes.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
        .filter(F.col("copies") > 1)
    )


def dataset_rows(
    hashes: DataFrame, columns: DataFrame, project_id: str, owner: str, description: str | None = None
) -> DataFrame:
    """Registry rows of uploaded files.

    ``columns`` lists ``path, column_name, position`` of the stored tables; the
    dataset id is derived from project, path and content, so registering an upload
    twice gives the same id.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    names = columns.groupBy("path").agg(
        F.transform(listed, lambda c: c["column_name"]).alias("columns_list")
    )
    identity = F.concat_ws("|", F.lit(project_id), "path", "hash")
    return hashes.join(names, "path").select(
        F.substring(F.sha2(identity, 256), 1, 32).alias("dataset_id"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("path").alias("file_path"),
        "hash",
        "columns_list",
        F.lit(owner).alias("owner_employee_id"),
        F.lit(project_id).alias("project_id"),
        F.lit(description).cast("string").alias("description"),
    )


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table (registry, results, signatures, history)."""
    df.write.mode("append").parquet(path)


# --- run documents -----------------------------------------------------------------------------


def write_run_documents(documents: DataFrame, folder: str, per_run: bool = True) -> None:
    """Append run documents as JSON lines.

    ``per_run`` gives every run a folder of its own; a bulk of many thousand runs is
    better kept in one folder per ``execution_date``, many runs to a file.
    """
    partition = F.col("dag_run_id") if per_run else F.col("execution_date")
    keyed = documents.withColumn("part", partition)
    if per_run:
        keyed = keyed.repartition("part")
    keyed.write.mode("append").partitionBy("part").json(folder)


#: Column in which Spark keeps the text of a document it cannot read.
BROKEN = "_corrupt_record"


def unreadable_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``file, document`` of the lines that stand among the run documents and are no JSON object of a run."""
    schema = T.StructType([*RUN_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])
    lines = spark.read.option("recursiveFileLookup", True).text(folder).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": BROKEN})
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"), parsed[BROKEN].alias("broken"))
    return rows.filter(F.col("broken").isNotNull()).drop("broken")


def read_run_documents(
    spark: SparkSession, folder: str, run_id: str | None = None, part: str | None = None
) -> DataFrame:
    """Run documents, or only one run's; an unknown run gives no rows, as does a document that is no JSON object.

    ``part`` limits the scan to one folder: that of a run, or of an execution date that many runs share.
    """
    schema = T.StructType([*RUN_SCHEMA.fields, T.StructField("part", T.StringType())])
    documents = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    if run_id is not None:
        documents = documents.filter(F.col("dag_run_id") == run_id)
    if part is not None:
        documents = documents.filter(F.col("part") == part)
    return documents.drop("part")


# --- signatures and push history ---------------------------------------------------------------


def signature_rows(signature: DataFrame, dataset_id: Column | str, created_at: Column) -> DataFrame:
    """The stored form of one-row signatures: the column map as JSON."""
    dataset_id = F.col(dataset_id) if isinstance(dataset_id, str) else dataset_id
    identity = F.concat_ws("|", dataset_id, "structure_hash", created_at.cast("string"))
    return signature.select(
        F.substring(F.sha2(identity, 256), 1, 32).alias("id"),
        dataset_id.alias("dataset_id"),
        "structure_hash",
        F.to_json(F.struct("name_base", "columns_count", "rows_count", "columns")).alias("signature"),
        "columns_count",
        "rows_count",
        F.lit("v1").alias("algo_version"),
        created_at.alias("created_at"),
    )


def column_signature_rows(columns: DataFrame, signature_id: Column | str) -> DataFrame:
    """The stored form of the column signatures (minimum and maximum are not kept)."""
    signature_id = F.col(signature_id) if isinstance(signature_id, str) else signature_id
    return columns.select(
        signature_id.alias("dataset_signature_id"),
        "column_name",
        "data_type",
        "mean",
        "std",
        "distinct_count",
        "sample_hash",
    )


def push_history_rows(pushes: DataFrame) -> DataFrame:
    """History rows of finished pushes; an error text is cut to 500 characters.

    A failed push keeps no counts; a similarity of 0 is stored as missing.
    """
    failed = F.col("error_message").isNotNull()

    def counted(value: Column) -> Column:
        return F.when(~failed, value)

    return pushes.select(
        "dataset_id",
        "pushed_at",
        "pushed_by",
        F.when(failed, F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.substring("error_message", 1, ERROR_TEXT_LENGTH).alias("error_message"),
        "execution_time_ms",
        counted(F.col("columns_count")).alias("columns_count"),
        counted(F.col("rows_count")).alias("rows_count"),
        counted(F.col("parent_version_id").isNotNull()).alias("parent_found"),
        counted(F.when(F.col("similarity_score") > 0, F.col("similarity_score"))).alias(
            "similarity_score"
        ),
        counted(F.col("propagated")).alias("propagated_columns_count"),
    )
