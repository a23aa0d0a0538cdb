"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a document keeps its measurements and one bit per failed rule. Policies are masks
over those bits, so a new version of a policy or an ablation reads the ledger and never the texts.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import SPACES, indexes, let, split_words, union_length

RUN = 5
SYMBOLS = "#*$%|<>&"

#: Rule name and the condition under which a document fails, over its measurements. The order gives the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "shouting": "10 * n_marks > 3 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A document is dropped when it fails any rule of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(name) for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("v1", tuple(RULES))


def _repeated(words: Column) -> Column:
    """Words inside runs of five words that occur at least twice in the text.

    Runs are compared by a 64-bit hash; positions are only sorted where some hash occurs twice.
    """
    hashes = F.transform(
        indexes(F.size(words) - (RUN - 1)),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(RUN)]),
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda o: F.filter(
                o,
                lambda x, i: F.coalesce(F.get(o, i - 1).h == x.h, F.lit(False))
                | F.coalesce(F.get(o, i + 1).h == x.h, F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x.i))
        return union_length(
            F.transform(starts, lambda i: F.struct(i.alias("start"), (i + RUN).alias("end")))
        )

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(
            F.lit(0).cast("long")
        ),
    )


def _count_other(text: Column, characters: str) -> Column:
    """Characters outside a class; removing runs leaves little to copy."""
    return F.length(F.regexp_replace(text, f"[{characters}]+", "")).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measurements of every text; a null or empty text measures zero throughout."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        *keep,
        _count_other(text, SPACES).alias("word_chars"),
        _count_other(text, f"^{SYMBOLS}").alias("n_symbols"),
        _count_other(text, "^A-Z").alias("n_capitals"),
        _count_other(text, "^!").alias("n_marks"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice"),
            ),
        ).alias("lines"),
        let(
            split_words(F.col("text"), SPACES),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("twice")),
        ).alias("words"),
    ).select(
        *keep,
        F.col("words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.twice").alias("n_dup_lines"),
        F.col("words.twice").alias("n_repeat_words"),
        "n_capitals",
        "n_marks",
        F.col("lines.n").alias("n_lines"),
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements and ``failed_bits``: one bit per rule of ``RULES``, set where the rule fails.

    One row per input row, repeated rows included; other columns than ``keep`` and text are ignored.
    """
    bits = [
        F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        for bit, condition in enumerate(RULES.values())
    ]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, keep).withColumn("failed_bits", failed)


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """A boolean column ``kept_<version>`` for each policy."""
    return rows.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone, and that would be kept without it.

    One aggregate over the bits; an empty ledger gives zero counts.
    """
    names = list(RULES)
    mask = policy.mask
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(bits == 0).alias("kept")]
    for name in policy.rules:
        one = 1 << names.index(name)
        sums.append(F.count_if(bits.bitwiseAND(F.lit(one)) != 0).alias(f"fail_{name}"))
        sums.append(F.count_if(bits == one).alias(f"only_{name}"))
    return rows.agg(*sums).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.col("n").alias("n_docs"),
                        F.col(f"fail_{name}").alias("n_failed"),
                        F.col(f"only_{name}").alias("n_only"),
                        (F.col("kept") + F.col(f"only_{name}")).alias("kept_without"),
                    )
                    for name in policy.rules
                ]
            )
        )
    )
