"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of the documents, the last one the
encoded corpus. ``run`` writes each result as Parquet and reads it again. ORACLE_SQL is None: neither the classifier
nor the encoder can be said in SQL; the tests compare every stage with a brute-force version.

A document is told by its id and a 64-bit hash of its text, so rows without an id and rows that share one are each
judged by their own text; rows equal in both are one document. An empty table gives an empty result, other columns are
passed on whatever their names, null and empty texts count as empty: they get the score of an empty text, are no near
duplicates, hold nothing of the benchmark, no secrets and no tokens.
"""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm import bpe, decontaminate, jaccard_join, quality, secrets
from tablekeep.llm.common import staged, table

ORACLE_SQL = None
VOCABULARY = "word_bpe_49k.json"
#: Near duplicates share four fifths of their five-word shingles.
NEAR = jaccard_join.Rule(5, 80, 100, rare=True)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = _free_name(docs)
    scored = quality.score(docs, model, name=name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def _document(docs: DataFrame) -> Column:
    """What tells a document: a row without an id comes after all that have one."""
    kind = docs.schema["doc_id"].dataType
    return F.struct(
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce("doc_id", F.lit("0").cast(kind)).alias("id"),
        F.xxhash64("text").alias("at"),
    )


def _free_name(docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    name = "document"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (of equal ones the least hash)."""
    name = _free_name(docs)
    groups = jaccard_join.jaccard_components(docs.select(_document(docs).alias("doc_id"), "text"), NEAR)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.withColumn(name, _document(docs)).join(first, name, "left_semi")
    return kept.dropDuplicates([name]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    name = _free_name(docs)
    found = decontaminate.contamination(
        docs.select(_document(docs).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")
    )
    bad = found.filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, _document(docs)).join(bad, name, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed ids of every document that is left."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), drop=("text",))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
