"""Cutting the plan of an iterative job in storage every executor can read, and code that tasks can import."""

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications whose workers have the package.
_SHIPPED: set[str] = set()
#: Shuffle files of a query go when it ends, and not whenever the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where driver and tasks are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="tablekeep-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def _hadoop_file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _deleted_at_exit(spark: SparkSession, path: str):
    files, where = _hadoop_file(spark, path)
    files.deleteOnExit(where)
    return files, where


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are written meanwhile leave no shuffle files behind: nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def write_scratch(df: DataFrame, path: str) -> DataFrame:
    """The rows written below a scratch path, tightly compressed, and read back; the files go when the driver ends."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    _deleted_at_exit(spark, path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder as Parquet and go on from there.

    What is read back is pruned and has a size, unlike a checkpoint; the files outlive lost executors and go when the
    driver ends, or when :func:`forget` is called.
    """
    return write_scratch(df, scratch_path(df.sparkSession, "cut"))


def forget(*written: DataFrame) -> None:
    """Delete the files of frames that :func:`write_scratch` gave and that nothing will read again."""
    for df in written:
        files, where = _hadoop_file(df.sparkSession, df._scratch)
        files.delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables written and read back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, through a file in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    name = f"{scratch_path(spark, 'package')}.zip"
    files, where = _deleted_at_exit(spark, name)
    stream = files.create(where)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)
