"""Several tables written as one: rows staged per batch, one manifest that makes them count.

A store is a folder. The rows of a batch are staged below ``tables/<name>/_batch=<batch>``, replacing what an earlier
attempt of the same batch left there. The manifest of the batch is created last and under a name that only one writer
can take, so readers see all tables of a batch or none, and a batch that is committed already changes nothing. A table
with a key holds changes: of several rows of a key, the one of the latest commit counts.
"""

import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of a commit's number in the name of its manifest.
DIGITS = 12
BATCH, SEQUENCE = "_batch", "_sequence"


@dataclass(frozen=True)
class Commit:
    """One manifest: the batch, its place in the order, and the schema of each of its tables as JSON.

    A commit with ``base`` holds all that counted before it.
    """

    sequence: int
    batch: str
    tables: dict[str, str]
    base: bool = False


def _folder(batch: str) -> str:
    """Name of a batch that is safe in a path."""
    return hashlib.sha256(batch.encode()).hexdigest()[:32]


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole, unless there is one: a rename that never replaces decides between writers."""
    jvm = spark._jvm
    files, target = _files(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(target), plain)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """The commits that count, in order: one short row per batch since the last base, and no data."""
    files, folder = _files(spark, f"{root}/commits")
    if not files.exists(folder):
        return []
    text = spark.read.option("wholetext", True).text(f"{root}/commits")
    found: dict[str, Commit] = {}
    for row in sorted((json.loads(r.value) for r in text.collect()), key=lambda m: m["sequence"]):
        if row["base"]:
            found.clear()
        found.setdefault(row["batch"], Commit(**row))
    return list(found.values())


def _is_committed(spark: SparkSession, root: str, batch: str) -> bool:
    """Whether a batch was ever committed, a base that holds it by now included."""
    files, where = _files(spark, f"{root}/commits")
    if not files.exists(where):
        return False
    text = spark.read.option("wholetext", True).text(f"{root}/commits")
    return not text.filter(F.get_json_object("value", "$.batch") == batch).isEmpty()


def stage(root: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """Write the rows of a batch; what an earlier attempt of it staged is replaced, and nothing counts yet."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/tables/{name}/{BATCH}={_folder(batch)}")


def commit(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame], base: bool = False) -> bool:
    """Stage the tables of a batch and make them count, all at once; False if the batch counts already.

    A batch is told by its name, and its rows should only depend on it: an attempt that was killed is run again under
    the same name. Two batches may be committed at the same time; each takes the next free place in the order.
    """
    if _is_committed(spark, root, batch):
        return False
    stage(root, batch, tables)
    schemas = {name: frame.schema.json() for name, frame in tables.items()}
    while True:
        if _is_committed(spark, root, batch):
            return False
        known = commits(spark, root)
        sequence = known[-1].sequence + 1 if known else 1
        manifest = json.dumps({"sequence": sequence, "batch": batch, "tables": schemas, "base": base})
        if _create(spark, f"{root}/commits/{sequence:0{DIGITS}d}.json", manifest):
            return True


def read(spark: SparkSession, root: str, name: str, key: Iterable[str] = ()) -> DataFrame:
    """The rows of a table that count; of the rows of a ``key`` the latest. Raises KeyError for an unknown table."""
    known = [c for c in commits(spark, root) if name in c.tables]
    if not known:
        raise KeyError(name)
    schema = T.StructType.fromJson(json.loads(known[-1].tables[name]))
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
    rows = spark.read.schema(stored).option("basePath", f"{root}/tables/{name}").parquet(
        *[f"{root}/tables/{name}/{BATCH}={_folder(c.batch)}" for c in known]
    )
    key = list(key)
    if not key:
        return rows.drop(BATCH)
    places = {_folder(c.batch): c.sequence for c in known}
    order = spark.createDataFrame(list(places.items()), f"{BATCH} string, {SEQUENCE} bigint")
    fields = F.struct(*schema.names)
    newest = rows.join(F.broadcast(order), BATCH).groupBy(*key).agg(F.max_by(fields, SEQUENCE).alias("_row"))
    return newest.select("_row.*")


def compact(spark: SparkSession, root: str, keys: dict[str, list[str]]) -> bool:
    """Write all that counts as one base commit; ``keys`` names the key of every table that has one.

    Staged rows of older batches stay until someone removes them; readers no longer list them.
    """
    known = commits(spark, root)
    if len(known) < 2:
        return False
    names = dict.fromkeys(n for c in known for n in c.tables)
    tables = {n: read(spark, root, n, keys.get(n, ())) for n in names}
    return commit(spark, root, f"base-{known[-1].sequence}", tables, base=True)
