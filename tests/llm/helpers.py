"""Small tables with nulls, empty and long texts, repeats and clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sentence(rng: random.Random, size: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(size))


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    long = sentence(rng, 4000, 100_000)
    return [None, "", " \t\n", "one", "Is this Ünïcode? 日本語 ½ \U0001f600", long, long, "a b c", "\x00\x1c x\x85y"]


def documents(spark, texts, **more):
    """doc_id, text and columns whose names clash with those that operators add."""
    extra = {"lang": "string", "source": "string", "score": "double", "n_tokens": "string", "block": "string"}
    rows = [(i, t, *[more.get(c, [None] * len(texts))[i] for c in extra]) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, " + ", ".join(f"{c} {k}" for c, k in extra.items())
    return spark.createDataFrame(rows, schema)
