"""Collocations, periodic runs and fingerprints, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablekeep.llm import collocations, minhash, repetitions
from tests.llm.helpers import LOWER, WORD, documents, odd_texts, sentence


def brute_runs(words, shortest=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repeating(rng, size, words):
    out = [rng.choice(words) for _ in range(size)]
    for _ in range(rng.randrange(3)):
        at, p = rng.randrange(size + 1), rng.randrange(1, 6)
        out[at:at] = (out[at : at + p] or [rng.choice(words)]) * rng.randrange(1, 9)
    return out


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(3)
    for _ in range(400):
        texts = [repeating(rng, rng.randrange(1, 40), list(range(rng.randrange(1, 5)))) for _ in range(rng.randrange(1, 4))] + [[]]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        found = repetitions.find_runs(np.array(sum(texts, []), dtype=np.int64), starts, ends, *limits)
        mine = [(s, e - s, p) for s, e, p in zip(*(x.tolist() for x in found), strict=True)]
        assert mine == [(int(a) + s, n, p) for a, t in zip(starts, texts, strict=True) for s, n, p in sorted(brute_runs(t, *limits), key=lambda r: (r[0], r[2]))]


def test_periodic_runs(spark):
    rng = random.Random(4)
    texts = odd_texts() + [" ".join(repeating(rng, 30, ["a", "b", "Ä"])) for _ in range(60)]
    texts += ["x " * 50000, "\t".join(["p q r"] * 9) + "\x1cs", "a b\nc " * 4, "a b\nc " * 3]
    docs = documents(spark, texts).withColumn("length", F.lit("old")).withColumn("page", F.lit(1))
    frame = repetitions.periodic_runs(docs)
    assert "text" not in frame.columns and frame.columns.count("length") == 1 and "page" in frame.columns
    for row in frame.collect():
        words = WORD.findall(texts[row.doc_id] or "")
        runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2])) if len(words) < 10_000 else ([(0, 50000, 1)] if words[0] == "x" else [])
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert repetitions.periodic_runs(docs.limit(0)).count() == 0


def brute_collocations(rows, least, top, share):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    counts = {p: n for p, n in counts.items() if n >= least}
    out = []
    for (lang, words), a in counts.items():
        if len(words) < 2:
            continue
        inside = any(
            la == lang and len(w) > len(words) and 100 * n >= share * a and any(w[i : i + len(words)] == words for i in range(len(w)))
            for (la, w), n in counts.items()
        )
        if not inside:
            cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
            score, k = min((1000 * a * totals[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
            out.append((lang, " ".join(words), a, *cuts[k], totals[lang], score))
    ranked = []
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(9)
    texts, langs = odd_texts(), [None] * len(odd_texts())
    for i in range(150):
        text = sentence(rng, 40, 30).replace("w3 ", "W3, ").replace("w7 ", "w7\n")
        texts.append(text.replace("w5", "New York City\tHall") if i % 3 else text)
        langs.append([None, "und", "a\nb", "é"][i % 4])
    return texts + [texts[-1]] * 20, langs + ["é"] * 20


@pytest.mark.parametrize("limits", [(12, 2000, 100), (5, 7, 80)])
def test_collocations_equal_brute_force(spark, phrase_rows, limits):
    texts, langs = phrase_rows
    docs = documents(spark, texts, lang=langs).withColumn("rank", F.lit("old")).withColumn("n", F.lit(0))
    found = sorted(tuple(r) for r in collocations.collocations(docs, *limits).collect())
    want = brute_collocations(list(zip(langs, texts, strict=True)), *limits)
    assert found == want and len(want) > 20
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_in_small_tries_and_large_partitions(spark, phrase_rows, monkeypatch):
    """Containers burst, tries are spilled in many runs, and one partition is summed up apart."""
    texts, langs = phrase_rows
    for name, value in (("BURST", 4), ("TRIE_WINDOWS", 300), ("PIECE_BYTES", 2000), ("PARTITION_WINDOWS", 100), ("LARGEST_PARTITION", 150), ("COUNTED_WORDS", 50), ("FAN", 4), ("MERGED_WINDOWS", 200)):
        monkeypatch.setattr(collocations, name, value)
    rows = list(zip(langs, texts, strict=True))
    held = []
    piece = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "text"])
    held += collocations._word_counts([piece])
    total = Counter()
    for batch in held:
        for row in batch.to_pylist():
            total[row["lang"], row["word"]] += row["n"]
    assert total["é", None] == sum(n for (lang, w), n in total.items() if lang == "é" and w is not None)
    trie = collocations.Trie()
    windows = np.random.default_rng(1).integers(1, 4, (2000, 6)).astype(np.int32)
    for i in range(0, 2000, 100):
        trie.add(windows[i : i + 100])
    keys, counts = zip(*[(k, n) for some, ns in trie.subtrees() for k, n in zip(some, ns, strict=True)], strict=True)
    assert list(keys) == sorted(keys) and len(keys) == trie.size
    assert Counter(dict(zip(keys, counts, strict=True))) == Counter(collocations._packed(windows))
    docs = documents(spark, texts, lang=langs)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 5).collect()) == brute_collocations(rows, 5, 2000, 100)


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def near_family(rng):
    texts = odd_texts()
    for size in (3, 30, 80, 200, 400, 600):
        base = sentence(rng, size, 5000).split()
        for edits in [0, 0, 1, 1, 1, 2, 2, 3, 4, 6, 8]:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts + [sentence(rng, 100, 5000) for _ in range(60)]


def test_fingerprints(spark):
    rng = random.Random(12)
    texts = near_family(rng)
    docs = documents(spark, texts).withColumn("part", F.lit(3)).withColumn("at", F.lit("x")).repartition(7)
    rows = {r.doc_id: r for r in minhash.compared_with_next(docs).collect()}
    assert len(rows) == len(texts)
    prints = {}
    for i, text in enumerate(texts):
        own, after = text or "", texts[(i + 1) % len(texts)] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        row = rows[i]
        assert row.n_chars == len(own) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(own, row.fingerprint) == row.fingerprint and len(row.fingerprint) == 4 * minhash.PERMUTATIONS
        if edited in prints:
            assert prints[edited] == row.edited_fingerprint
        for near, other in ((row.near_edited, edited), (row.near_next, after)):
            if shingle_set(own) or shingle_set(other):
                assert abs(near - jaccard(shingle_set(own), shingle_set(other))) < 0.2
            else:
                assert near == 1.0
    # rows that share an id, rows without one, one row, none
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "x y z w"), (5, "k l m n"), (5, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in minhash.compared_with_next(odd).collect()) == [(0, 3), (0, 3), (5, 0), (5, 7), (5, 7)]
    alone = minhash.compared_with_next(odd.limit(1)).first()
    assert alone.near_next == 1.0
    assert minhash.compared_with_next(odd.limit(0)).count() == 0


def test_near_classes_recall(spark):
    texts = near_family(random.Random(13))
    docs = documents(spark, texts)
    found = {r.text_id: r.near_class for r in minhash.near_classes(docs).collect()}
    ids = [minhash._text_id((t or "").encode()) for t in texts]
    sets = [shingle_set(t) for t in texts]
    linked = kept = 0
    for i in range(len(texts)):
        for j in range(i):
            if ids[i] != ids[j] and jaccard(sets[i], sets[j]) >= minhash.THRESHOLD:
                linked += 1
                kept += ids[i] in found and found[ids[i]] == found.get(ids[j])
    assert linked > 50 and kept >= 0.9 * linked
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and jaccard(sets[i], sets[j]) >= minhash.THRESHOLD:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    true = {ids[i]: label[i] for i in range(len(texts))}
    assert all(true[a] == true[b] for a, b in found.items())
    assert minhash.near_classes(docs.limit(0)).count() == 0
    assert minhash.near_classes(docs.filter("doc_id < 4")).count() == 0


def test_signatures_are_minima_of_the_permutations():
    texts = ["a b c d e f g", "a b", "", "A B C D E f g"]
    column = pa.array(texts)
    values, offsets = minhash.shingles(column)
    signed = minhash.signatures(column)
    assert (np.diff(offsets) == [3, 1, 0, 3]).all()
    for k, text in enumerate(texts):
        own = [int(v) >> 32 for v in values[offsets[k] : offsets[k + 1]]]
        for j in range(minhash.PERMUTATIONS):
            least = min((((int(minhash._A[j]) * x + int(minhash._B[j])) % (1 << 64)) >> 32 for x in own), default=0xFFFFFFFF)
            assert signed[k, j] == least
    assert zlib.crc32(signed[0].tobytes()) == zlib.crc32(signed[3].tobytes())


def test_links_inside_a_bucket_are_kept_whoever_is_chosen(spark):
    """A text like a linked member, but not like the chosen one; and two alike in the bucket of a third that is not."""

    def words(*marks):
        return " ".join(f"w{i}{marks[0] if i < 9 else marks[2] if i > 90 else marks[1]}" for i in range(100))

    hub, near, far = words("a", "m", "a"), words("a", "m", "z"), words("y", "m", "z")
    other, one, two = words("k", "l", "k"), words("u", "v", "a"), words("u", "v", "z")
    lone = [words(f"x{i}", f"x{i}", "x") for i in range(2)]
    texts = [hub, near, far, other, one, two, *lone]
    docs = documents(spark, texts)
    ids = [minhash._text_id(t.encode()) for t in texts]
    # the hub and the stranger have most company and are chosen
    bands = [[1, 3, 4], [1], [1], [2, 5, 6], [2], [2], [3, 5], [4, 6]]
    signed = spark.createDataFrame(list(zip(ids, bands, strict=True)), "text_id bigint, bands array<bigint>")
    found = {r.text_id: r.near_class for r in minhash.near_classes(docs, signed).collect()}
    assert found == {**dict.fromkeys(ids[:3], min(ids[:3])), **dict.fromkeys(ids[4:6], min(ids[4:6]))}


def test_buckets_become_no_pairs_and_blocks_lose_no_link(spark, monkeypatch):
    """Links of a bucket that no chosen member has, over several blocks; what is asked of rows grows with the bucket."""
    rng = random.Random(14)

    def varied(base, edits):
        words = list(base)
        for i in rng.sample(range(len(words)), edits):
            words[i] = f"v{rng.randrange(10**6)}"
        return words

    base = [f"w{i}" for i in range(120)]
    kin = [varied(base, 6) for _ in range(30)]
    texts = [" ".join(words) for words in [*kin, *(varied(words, 1) for words in kin[:12])]]
    docs = documents(spark, texts)
    ids = [minhash._text_id(t.encode()) for t in texts]
    signed = spark.createDataFrame([(i, [1, 2 + k % 2]) for k, i in enumerate(ids)], "text_id bigint, bands array<bigint>")
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= minhash.THRESHOLD:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {c: min(ids[i] for i in range(len(ids)) if label[i] == c) for c in label}
    true = {ids[i]: least[label[i]] for i in range(len(ids)) if label.count(label[i]) > 1}
    assert len(set(true.values())) > 5
    asked = []
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda docs, pairs: asked.append(pairs.count()) or verified(docs, pairs))
    for block in (512, 10):
        monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
        asked.clear()
        assert {r.text_id: r.near_class for r in minhash.near_classes(docs, signed).collect()} == true
        assert sum(asked) <= 8 * len(texts)
    rows = docs.select("doc_id").withColumn("text_id", F.element_at(F.array(*map(F.lit, ids)), F.col("doc_id").cast("int") + 1))
    classes = minhash.near_classes(docs, signed)
    assert {r.text_id: r.near_class for r in minhash.with_classes(rows, classes).collect()} == {i: true.get(i) for i in ids}


def test_runs_of_pairs_are_merged_in_portions_and_written_once(spark, monkeypatch):
    rng = random.Random(15)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(60))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    seen = []
    written = collocations.staged
    monkeypatch.setattr(collocations, "staged", lambda df, name: seen.append(name) or written(df, name))
    for largest in (1 << 20, 20):
        monkeypatch.setattr(collocations, "LARGEST_PARTITION", largest)
        seen.clear()
        assert sorted(tuple(r) for r in collocations.collocations(docs, 5).collect()) == brute_collocations(rows, 5, 2000, 100)
        assert seen.count("runs") == 1
