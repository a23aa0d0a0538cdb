"""Small helpers shared by the operators of this subpackage."""

import io
import string
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type
from pyspark.sql.types import StructType

from tablekeep.functions.lineage import scratch_path, write_scratch

#: Separators of plain words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"

#: Text that is handled at once in a task, in bytes, beside a single longer text.
PIECE_BYTES = 1 << 20
#: Applications whose workers have the package.
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    The files outlive lost executors and go when the session's JVM ends, or when they are forgotten.
    """
    return write_scratch(df, scratch_path(df.sparkSession, name))


#: Arrow batches on the way to Python workers, unless the session has limits of its own: rows of long texts are large.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, through a file in the shared folder, and small batches."""
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    name = f"{scratch_path(spark, 'package')}.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(where)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    files.deleteOnExit(where)
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of a regular-expression character class; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(count: Column) -> Column:
    """0 to count-1, empty if count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def union_length(spans: Column) -> Column:
    """Positions covered by (start, end) structs that are sorted by start."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    return F.aggregate(
        spans,
        zero,
        lambda seen, span: F.struct(
            (
                seen.total + F.greatest(F.lit(0), span.end - F.greatest(span.start, seen.reach))
            ).alias("total"),
            F.greatest(seen.reach, span.end).alias("reach"),
        ),
        lambda seen: seen.total,
    ).cast("long")


def crc_rest(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % modulus).cast("int")


def text_columns(
    df: DataFrame,
    fields: str,
    make: Callable[[], Callable[[list], list]],
    text: str = "text",
    drop: tuple[str, ...] = (),
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """``df`` with columns computed from its texts in Arrow batches.

    ``fields`` is the DDL of the new columns and ``make``, called once per task, gives the function from a list
    of texts to one list per new column. Batches are cut into pieces of about ``piece_bytes``, so memory
    follows the longest text and not the number of rows. Columns of the same name are replaced.
    """
    added = StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in added.names and f.name not in drop]
    schema = StructType([*kept, *added.fields])
    names = [f.name for f in kept]
    types = [pa_type(f.dataType) for f in added.fields]
    at = df.columns.index(text)
    places = [df.columns.index(n) for n in names]

    def run(batches):
        compute = make()
        for batch in batches:
            step = max(1, int(batch.num_rows * piece_bytes / max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                found = compute(piece.column(at).to_pylist())
                arrays = [piece.column(i) for i in places]
                arrays += [pa.array(x, type=t) for x, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added.names])
        # workers live on between tasks: what this one held goes back
        pa.default_memory_pool().release_unused()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
