"""The registered queries of the operators: whole tables in, the columns that are compared out."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm import (
    bpe,
    collocations,
    context_tree,
    decontaminate,
    jaccard_join,
    langid,
    minhash,
    quality,
    repetitions,
    rule_ledger,
    secrets,
    sharding,
    wrappers,
)
from tablekeep.llm.common import SPACES, crc_rest, split_words, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SHARDS = 16
SEED = 17
VOCABULARY = "word_bpe_49k.json"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside shared windows, and the items they come from."""
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards, each with the mixture of sources of the whole."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
    )
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")))
    placed = sharding.interleave(rows, SHARDS, key)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule once, the base policy and the verdict of the current one."""
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rule_ledger.passes(rule_ledger.BASE)).alias("base_failed"),
        rule_ledger.passes(rule_ledger.STRICT).alias("kept"),
        "failed_bits",
    )


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, those inside nested encodings included."""
    rows = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x.layer == "")

    def count(kind: str):
        return F.size(F.filter("found", lambda x: (x.layer == "") & (x.kind == kind))).cast("long")

    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.listing(base), 256).alias("base_sha256"),
        secrets.listing(F.col("found")).alias("spans"),
    )


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    return bpe.encode(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path(VOCABULARY),
        ("n_tokens", "ids_sha256", "decoded_sha256"),
        drop=("text",),
    )


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a classifier that learned from the labels of four folds out of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, drop=("text",)).select(
        "doc_id",
        (crc_rest(F.col("doc_id"), quality.FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by its nearest centroid."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model, drop=("text",)).select(
        "doc_id",
        (crc_rest(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT).alias("held_out"),
        F.col("nearest").alias("lang_pred"),
        "score",
        "rejected",
    )


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text by words alone and by the context tree."""
    return context_tree.score(table(spark, sf_dir, "documents"))


@query
def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    return wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their three-word shingles."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), jaccard_join.Rule(3, 90, 100))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two thousand best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, by crc32 of the id, goes on periodically from some word."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    some = (
        docs.withColumn("_h", crc)
        .withColumn("_w", F.when(F.col("_h") % 10 == 0, split_words(F.col("text"), SPACES)))
        .selectExpr("*", "_h div 10 as _g")
        .selectExpr("*", "case when size(_w) > 0 then cast(_g % size(_w) as int) end as _a")
        .selectExpr("*", "cast(1 + (size(_w) - _a) div (3 + _g % 8) as int) as _p")
    )
    planted = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[_a + (i - _a) % _p])), ' ')")
    return some.withColumn("text", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text"))).select(*docs.columns)


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, with runs planted in a tenth of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetitions.periodic_runs(_with_planted_runs(docs))


@query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and the class of near duplicates it belongs to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = minhash.compared_with_next(docs)
    classes = minhash.near_classes(docs, rows.select("text_id", "bands"))
    return minhash.with_classes(rows, classes).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        F.coalesce("near_class", "text_id").alias("near_class"),
    )
