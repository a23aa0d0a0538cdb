"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every run of ``WINDOW - GRAM + 1`` k-grams. Any span of ``WINDOW``
words that a document shares with an item therefore holds an anchor that both sides kept, at the same offset.
Anchors are joined by hash and extended word by word, at most ``WINDOW - GRAM`` words either way: enough to
reach every shared window around the anchor. A span counts only if ``WINDOW`` words in a row are equal, so hash
collisions never show. Items shorter than a window are one window as a whole and are looked up by their length.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import indexes, let, lower_ascii, split_words, staged, union_length

WINDOW = 13
GRAM = 5
#: Hashes and positions are 31-bit numbers.
LOW = 0x7FFFFFFF
SIDE = WINDOW - GRAM
#: Bits of the filter that spares documents' anchors the join: 128 KB whatever the benchmark's size.
FILTER_BITS = 1 << 20

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
ANCHOR = "array<struct<hash:bigint,span:int,at:int,before:array<string>,after:array<string>>>"


def bench_words(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _ordered_grams(words: Column) -> Column:
    """Per k-gram its 31-bit hash above its position: unique, ordered by hash, leftmost first."""
    return F.transform(
        indexes(F.size(words) - (GRAM - 1)),
        lambda i: F.shiftleft(
            F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]).bitwiseAND(F.lit(LOW)), 32
        ).bitwiseOR(i.cast("long")),
    )


def _kept(grams: Column, may: Callable[[Column], Column]) -> Column:
    """The k-grams that are the smallest of some window of k-grams, and for which ``may`` of the hash holds.

    ``may`` is tried first: it is cheap, and few k-grams of a document pass it.
    """

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.lit(LOW)).cast("int")

    def smallest(x: Column) -> Column:
        first = F.greatest(position(x) - SIDE, F.lit(0))
        last = F.least(position(x), F.size(grams) - (SIDE + 1))
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda a: F.array_min(F.slice(grams, a + 1, SIDE + 1)) == x)

    likely = F.filter(grams, lambda x: may(F.shiftright(x, 32)))
    return F.filter(likely, smallest)


def _anchors(words: Column, kept: Column) -> Column:
    """Anchors with the words before them, nearest first, and the words from them on."""

    def anchor(x: Column) -> Column:
        at = x.bitwiseAND(F.lit(LOW)).cast("int")
        before = F.slice(words, F.greatest(at - SIDE, F.lit(0)) + 1, F.least(at, F.lit(SIDE)))
        return F.struct(
            F.shiftright(x, 32).alias("hash"),
            F.lit(WINDOW).alias("span"),
            at.alias("at"),
            F.reverse(before).alias("before"),
            F.slice(words, at + 1, WINDOW).alias("after"),
        )

    return F.transform(kept, anchor).cast(ANCHOR)


def _hash(words: Column, at: Column, count: int) -> Column:
    return F.xxhash64(F.slice(words, at + 1, count)).bitwiseAND(F.lit(LOW))


def _whole(words: Column, length: int, positions: Column) -> Column:
    return F.transform(
        positions,
        lambda at: F.struct(
            _hash(words, at, length).alias("hash"),
            F.lit(length).alias("span"),
            at.alias("at"),
            F.array().cast("array<string>").alias("before"),
            F.slice(words, at + 1, length).alias("after"),
        ),
    ).cast(ANCHOR)


def item_fingerprints(items: DataFrame) -> DataFrame:
    """item_id, hash, span, before, after: each different anchor of an item once."""
    words = items.select("item_id", bench_words(F.col("text")).alias("words")).filter(
        F.size("words") > 0
    )
    short = [F.when(F.size("words") == n, _whole(F.col("words"), n, indexes(F.lit(1)))) for n in range(1, WINDOW)]
    found = F.coalesce(*short, let(_ordered_grams(F.col("words")), lambda g: _anchors(F.col("words"), _kept(g, lambda h: F.lit(True)))))
    return (
        words.select("item_id", F.inline(found)).drop("at").distinct()
    )


def _present(prints: DataFrame) -> Column:
    """The hashes as one bit set, a scalar: bounded, without false negatives."""
    spark = prints.sparkSession
    bit = F.pmod("hash", F.lit(FILTER_BITS))
    bits = (
        prints.select(
            F.shiftright(bit, 6).alias("id"),
            F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER_BITS}) & 63 as int))").alias("bits"),
        )
        .groupBy("id")
        .agg(F.bit_or("bits").alias("bits"))
    )
    every = spark.range(FILTER_BITS // 64).join(bits, "id", "left")
    entry = F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.bits).alias("bits")
    ).scalar()


def document_anchors(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """The documents' rows with n_words and their anchors that may match, written out.

    Only the distinct lengths of short items, twelve at most, come to the driver.
    """
    docs = docs.withColumn("present", _present(prints))
    lengths = sorted(
        r.span for r in prints.filter(F.col("span") < WINDOW).select("span").distinct().collect()
    )

    def may_match(hash_: Column) -> Column:
        word = F.get("present", F.shiftright(hash_, 6).bitwiseAND(F.lit(FILTER_BITS // 64 - 1)).cast("int"))
        shifted = F.call_function("shiftright", word, hash_.bitwiseAND(F.lit(63)).cast("int"))
        return shifted.bitwiseAND(F.lit(1)) != 0

    def whole(words: Column, n: int) -> Column:
        places = indexes(F.size(words) - (n - 1))
        return _whole(words, n, F.filter(places, lambda at: may_match(_hash(words, at, n))))

    def anchors(words: Column) -> Column:
        parts = [let(_ordered_grams(words), lambda g: _anchors(words, _kept(g, may_match)))]
        parts += [whole(words, n) for n in lengths]
        return F.concat(*parts)

    found = docs.select(
        "doc_id",
        let(
            bench_words(F.col("text")),
            lambda w: F.struct(F.size(w).alias("n_words"), anchors(w).alias("anchors")),
        ).alias("found"),
    )
    return staged(
        found.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", "found.n_words", "found.anchors"
        ),
        "anchors",
    )


def _equal_run(mine: Column, theirs: Column) -> Column:
    """How many leading words are equal."""
    same = F.zip_with(mine, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (list), n_items, contaminated.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. A null text has no
    words. An item without an id still makes words count as hit but is not listed. Repeated document rows each
    get a row; repeated items count once.
    """
    prints = staged(item_fingerprints(items), "prints")
    rows = document_anchors(docs.select("doc_id", "text"), prints)
    spans = (
        rows.select("row_id", F.inline("anchors"))
        .join(
            prints.withColumnsRenamed({"before": "their_before", "after": "their_after"}),
            ["hash", "span"],
        )
        .select(
            "row_id",
            "item_id",
            "at",
            "span",
            _equal_run(F.col("before"), F.col("their_before")).alias("left"),
            _equal_run(F.col("after"), F.col("their_after")).alias("right"),
        )
        .filter((F.col("right") > 0) & (F.col("left") + F.col("right") >= F.col("span")))
        .groupBy("row_id")
        .agg(
            F.collect_set("item_id").alias("items"),
            F.array_sort(
                F.collect_set(
                    F.struct(
                        (F.col("at") - F.col("left")).alias("start"),
                        (F.col("at") + F.col("right")).alias("end"),
                    )
                )
            ).alias("spans"),
        )
        .select("row_id", "items", union_length(F.col("spans")).alias("n_hit"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.sort_array(
        F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string"))
    )
    return (
        rows.select("row_id", "doc_id", F.col("n_words").cast("long"))
        .join(spans, "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            listed.alias("items"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )
