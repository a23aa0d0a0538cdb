"""Every stage of the pipeline against a brute-force version of it."""

import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablekeep.llm import quality, secrets
from tablekeep.llm.common import staged
from tests.llm.helpers import BENCH_WORD, LOWER, documents, odd_texts, sentence
from tests.llm.test_graphs import brute_components

SF_DIR = "/root/testdata/sf0.001"


def brute_score(model, text):
    """Log odds by counting every feature in plain Python."""
    data = (text or "").encode()
    words, at = [], 0
    for raw in data.split():
        value = 0
        for i, byte in enumerate(raw):
            value = (value + (byte + 1) * pow(0x100000001B3, i, 1 << 64)) % (1 << 64)
        words.append(value)

    def mixed(value, bits):
        value = ((value ^ (value >> 29)) * 0x9E3779B97F4A7C15) % (1 << 64)
        return value >> (64 - bits)

    kinds = [[mixed(w, quality.WORD_BITS) for w in words]]
    kinds.append([mixed((b - a) % (1 << 64), quality.WORD_BITS) + (1 << quality.WORD_BITS) for a, b in zip(words, words[1:], strict=False)])
    for i, n in enumerate(quality.GRAMS):
        grams = []
        for at in range(len(data) - n + 1):
            value = n
            for byte in data[at : at + n]:
                value = (value << 8 | byte) % (1 << 64)
            grams.append(mixed(value, quality.GRAM_BITS) + (2 << quality.WORD_BITS) + (i << quality.GRAM_BITS))
        kinds.append(grams)
    return model.bias + sum(sum(float(model.weights[b]) for b in kind) / len(kind) for kind in kinds if kind)


def brute_contaminated(text, items):
    words = BENCH_WORD.findall((text or "").translate(LOWER))
    hit = set()
    for item in items:
        own = BENCH_WORD.findall((item or "").translate(LOWER))
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if own else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def _by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    model = quality.fit(docs, labels)
    kept = _by_id(docs)
    for (_, stage), step in zip(corpus_pipeline.STAGES, range(5), strict=True):
        frame = stage(spark, docs, SF_DIR)
        after = _by_id(frame)
        if step == 0:
            odds = {i: brute_score(model, r.text) for i, r in kept.items()}
            assert set(after) == {i for i, x in odds.items() if 1 / (1 + 2.718281828459045**-x) >= quality.THRESHOLD}
        elif step == 1:
            ids = sorted(kept)
            found = brute_components([kept[i].text for i in ids], 5, 80, 100)
            assert set(after) == {ids[x] for _, x in found}
        elif step == 2:
            assert set(after) == {i for i, r in kept.items() if not brute_contaminated(r.text, items)}
        elif step == 3:
            assert set(after) == set(kept)
            for i, r in kept.items():
                inside = [False] * len(r.text)
                for start, end, _, _ in secrets.scan(r.text):
                    inside[start:end] = [True] * (end - start)
                runs = ["".join(c for c, _ in run) for hit, run in itertools.groupby(zip(r.text, inside, strict=True), lambda x: x[1]) if not hit]
                assert [part for part in after[i].text.split(secrets.MASK) if part] == [part for part in runs if part]
                assert after[i].n_chars == len(after[i].text) and any(inside) == (secrets.MASK in after[i].text)
        else:
            assert set(after) == set(kept)
            for i, r in kept.items():
                ids = library.encode(r.text or "", add_special_tokens=False).ids
                assert after[i].n_tokens == len(ids) and after[i].ids == b"".join(x.to_bytes(4, "little") for x in ids)
        if step < 4:
            assert frame.columns == docs.columns
            docs, kept = staged(frame, "stage"), after
    final = _by_id(corpus_pipeline.run(spark, SF_DIR))
    assert {i: r.n_tokens for i, r in final.items()} == {i: r.n_tokens for i, r in after.items()}


def test_quality_score_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [*odd_texts(), *[sentence(rng, n) for n in (1, 2, 5, 40)], "a  a\tb\x0b\x1c é a a a"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert abs(model.weights).max() > 0
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, text in enumerate(texts):
        assert rows[i] == pytest.approx(1 / (1 + 2.718281828459045 ** -brute_score(model, text)), abs=1e-6)
    assert quality.score(docs, model).columns == docs.columns


def test_stages_on_odd_rows(spark):
    """Repeated rows, rows without an id, rows that share one, empty tables and columns of any name."""
    docs = documents(spark, odd_texts() * 2)
    docs = docs.union(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("bigint")))
    docs = docs.withColumn("document", F.lit(7)).withColumn("component_id", F.lit(1)).withColumn("contaminated", F.lit(True))
    docs = staged(docs, "odd")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF_DIR)
            assert out.count() <= rows.count() and "doc_id" in out.columns
            if stage is not corpus_pipeline.encode:
                assert out.columns == docs.columns


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(3)
    clean, near = sentence(rng, 60, 5000), sentence(rng, 60, 5000)
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("length(text) > 100").first().text
    rows = [(1, clean), (1, item), (1, near), (2, near + " end"), (None, near), (None, item + " x"), (None, "alone in here"), (1, clean)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect())
    assert left == sorted([(1, clean), (1, item), (1, near), (0, "alone in here")])
    left = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, SF_DIR).collect())
    assert left == sorted([(1, clean), (1, near), (2, near + " end"), (0, near), (0, "alone in here"), (1, clean)])
