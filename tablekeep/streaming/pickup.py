"""Picking up finished run documents as they arrive in a folder, unreadable ones apart."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.operators.results import RUN_SCHEMA, flatten_documents
from tablekeep.sources.files import BROKEN

DEAD_LETTERS = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("document", T.StringType()), T.StructField("reason", T.StringType())]
)


def dead_letter_folder(target: str) -> str:
    """Where documents that were not picked up are kept, unless another folder is named."""
    return f"{target.rstrip('/')}_dead_letters"


def pick_up_results(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    archive: str | None = None,
    files_per_batch: int | None = None,
    dead_letters: str | None = None,
) -> None:
    """Load every pending run document below ``folder`` once and append its checks.

    The checkpoint remembers the files taken, whether or not they have been moved to
    ``archive`` yet. A document that is no JSON, or names no run, is not lost: its file, text
    and reason go to ``dead_letters``. A batch has its own partition of both tables and replaces
    it, so a batch repeated after a failure leaves no rows twice.
    """
    letters = dead_letters or dead_letter_folder(target)
    schema = T.StructType([*RUN_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])

    def store(batch: DataFrame, batch_id: int) -> None:
        # read by both writes; blocks of lost executors are read from the files again
        batch.persist()
        readable = F.col(BROKEN).isNull() & F.col("dag_run_id").isNotNull()
        reason = F.when(F.col(BROKEN).isNotNull(), F.lit("unreadable")).otherwise(F.lit("no run"))
        document = F.coalesce(BROKEN, F.to_json(F.struct(*RUN_SCHEMA.names)))
        bad = batch.filter(~readable).select("file", document.alias("document"), reason.alias("reason"))
        bad.write.mode("overwrite").parquet(f"{letters}/batch_id={batch_id}")
        flatten_documents(batch.filter(readable)).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        batch.unpersist()

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    stream = stream.option("columnNameOfCorruptRecord", BROKEN)
    if archive is not None:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    query = (
        stream.json(folder)
        .withColumn("file", F.col("_metadata.file_path"))
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches below a path, none when there is no batch yet."""
    try:
        stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("bigint"))
    return stored


def picked_up_checks(spark: SparkSession, target: str) -> DataFrame:
    """The checks stored so far; none when nothing has been picked up yet."""
    return _batches(spark, target, flatten_documents(spark.createDataFrame([], RUN_SCHEMA)).schema)


def unread_documents(spark: SparkSession, target: str, dead_letters: str | None = None) -> DataFrame:
    """Documents that were not picked up: ``file, document, reason, batch_id``."""
    return _batches(spark, dead_letters or dead_letter_folder(target), DEAD_LETTERS)
