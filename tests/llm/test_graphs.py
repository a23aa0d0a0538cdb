"""Jaccard join and context tree, against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekeep.llm import context_tree, jaccard_join
from tests.llm.helpers import LOWER, WORD, documents, odd_texts, sentence


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


def near_texts():
    rng = random.Random(8)
    texts = odd_texts()
    for size in (3, 9, 12, 40, 150):
        base = sentence(rng, size).split()
        for edits in (0, 1, 1, 2, 3, 5):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[: -max(1, size // 12)]))
        texts.append(" ".join(base).upper())
    chain = sentence(rng, 60).split()
    for step in range(12):
        texts.append(" ".join(chain[step : step + 45]))
    return texts


@pytest.mark.parametrize("rule", [(3, 90, 100), (5, 80, 100), (3, 90, 100, True), (5, 80, 100, True)])
def test_components(spark, rule):
    texts = near_texts()
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts), jaccard_join.Rule(*rule)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_components(texts, *rule[:3])


def test_tied_sets_are_sent_once(spark):
    rule = jaccard_join.Rule(3, 90, 100)
    texts = near_texts()[:20] * 30
    rows = [(t, jaccard_join.set_id(x)) for t in texts if t and len(x := jaccard_join.shingle_sets([t], 3)[0])]
    docs = spark.createDataFrame(rows, "text string, set_id bigint").repartition(6)
    nodes = docs.select(F.col("set_id").alias("node")).distinct()
    found = [r.set_id for r in jaccard_join._tied_sets(docs, nodes, rule).collect()]
    assert sorted(found) == sorted({name for _, name in rows})


def test_components_of_large_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 1500)
    texts = near_texts()
    found = jaccard_join.jaccard_components(documents(spark, texts), jaccard_join.Rule(3, 90, 100))
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert [rows[i] for i in range(len(texts))] == brute_components(texts, 3, 90, 100)
    assert jaccard_join.jaccard_components(documents(spark, []), jaccard_join.Rule(3, 90, 100)).count() == 0


def test_cells_are_exact(monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 10)
    rng = np.random.default_rng(1)
    rule = jaccard_join.Rule(3, 90, 100)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**60, 60, dtype=np.uint64)
        for _ in range(10):
            own = base.copy()
            own[rng.integers(0, 60, 2)] = rng.integers(0, 2**60, 2, dtype=np.uint64)
            sets.append(np.unique(own))
    forest = jaccard_join.Forest(len(sets))
    jaccard_join.join_cell(sets, np.arange(len(sets)), rule, forest)
    brute = jaccard_join.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if rule.linked(np.array(common), len(sets[i]), len(sets[j])):
                brute.link(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [brute.root(i) for i in range(len(sets))]


def test_size_classes_meet():
    for num in (80, 90):
        rule = jaccard_join.Rule(3, num, 100)
        for large in range(1, 400):
            own = rule.size_classes(large)[0]
            for small in range(-(-num * large // 100), large + 1):
                assert own in rule.size_classes(small)
                assert (100 - num) * (small + large) // (100 + num) < own[1]


def test_linked_sets_share_a_rare_key():
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 9, 1 << jaccard_join.SKETCH_BITS, dtype=np.uint8)
    for num, size in [(80, 5), (80, 40), (80, 333), (90, 11), (90, 250)]:
        rule = jaccard_join.Rule(5, num, 100, rare=True)
        for _ in range(40):
            both = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64))
            changed = size * (100 - num) // (100 + num)
            left, right = both[:size], np.sort(np.concatenate([both[changed:size], both[size : size + changed]]))
            assert rule.linked(np.array(size - changed), size, len(right))
            assert set(jaccard_join.rare_keys(left, rule, sketch)) & set(jaccard_join.rare_keys(right, rule, sketch))


def test_linked_sets_share_as_many_rare_keys_as_both_need(spark):
    rng = np.random.default_rng(6)
    sketch = rng.integers(0, 3, 1 << jaccard_join.SKETCH_BITS, dtype=np.uint8)
    for num, size in [(20, 60), (50, 90), (80, 5), (80, 37), (80, 640), (90, 250)]:
        rule = jaccard_join.Rule(5, num, 100, rare=True)
        needs = {r.n: r.needed for r in spark.range(1, 800).select(F.col("id").alias("n"), rule.needed(F.col("id")).alias("needed")).collect()}
        for _ in range(30):
            both = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64))
            # a part of the larger set, or sets of one size
            small = -(-size * num // 100)
            changed = size * (100 - num) // (100 + num)
            for other in (both[:small], np.sort(np.concatenate([both[changed:size], both[size : size + changed]]))):
                left, right = both[:size], other
                common = len(np.intersect1d(left, right))
                assert rule.linked(np.array(common), len(left), len(right))
                keys = set(jaccard_join.rare_keys(left, rule, sketch)) & set(jaccard_join.rare_keys(right, rule, sketch))
                assert len(keys) >= max(needs[len(left)], needs[len(right)])


def test_a_full_sketch_ties_no_texts_that_share_phrases_only(spark, monkeypatch):
    rng, word = random.Random(7), (f"w{i}" for i in range(100_000))
    phrases = [[next(word) for _ in range(5)] for _ in range(60)]
    texts = []
    for i in range(60):
        own = [next(word) for _ in range(45)]
        for k, phrase in enumerate((phrases[i], phrases[i - 1], phrases[i - 2])):
            own[15 * k : 15 * k] = phrase
        texts.append(" ".join(own))
    texts.append(texts[0] + " end")
    noise = np.array([rng.randrange(4) for _ in range(1 << 16)], dtype=np.uint8)
    full = np.tile(noise, (1 << jaccard_join.SKETCH_BITS) >> 16)
    tied, written = {}, jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "_sketch", lambda docs, rule: full)
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name: tied.setdefault(name, written(df, name)) if name == "regions" else written(df, name))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs, jaccard_join.Rule(5, 80, 100, rare=True)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 60 for i in range(61)}
    assert tied["regions"].count() == 2


def test_sketch_counts_all_texts(spark):
    texts = near_texts()[:60] + [None, "", "short text"]
    rule = jaccard_join.Rule(5, 80, 100, rare=True)
    flat = np.concatenate(jaccard_join.shingle_sets(texts, 5)) >> np.uint64(64 - jaccard_join.SKETCH_BITS)
    expected = np.zeros(1 << jaccard_join.SKETCH_BITS, dtype=np.int64)
    np.add.at(expected, flat, 1)
    found = jaccard_join._sketch(documents(spark, texts), rule)
    assert (found == (6 * np.log2(1 + expected)).astype(np.uint8)).all()


def test_connected(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)]
    label = {n: n for p in pairs for n in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    rows = jaccard_join.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in rows} == {n: x for n, x in label.items() if any(a != b and n in (a, b) for a, b in pairs)}


# --- context tree --------------------------------------------------------------------------------


def brute_probability(train, text, depth):
    """Context-tree weighting with the counts of ``train`` by recursion over contexts."""
    counts: dict = {}
    for raw in train:
        data = b"\n" * depth + raw
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for k in range(8):
                    node = (1 << k) | data[i] >> (8 - k)
                    cell = counts.setdefault((d, data[i - d : i], node), [0, 0])
                    cell[data[i] >> (7 - k) & 1] += 1
    log_weighted: dict = {}
    for d in range(depth, -1, -1):
        for (e, context, node), cell in list(counts.items()):
            a, b = cell[:2]
            if e != d:
                continue
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            below = [log_weighted[key] for key in log_weighted if key[0] == d + 1 and key[1][1:] == context and key[2] == node]
            log_weighted[d, context, node] = kt if d == depth else np.logaddexp(kt, sum(below)) - math.log(2)
            counts[d, context, node] = [a, b, kt, sum(below)]
    total, data = 0.0, b"\n" * depth + text
    for i in range(depth, len(data)):
        for k in range(8):
            node, bit = (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1
            known = [d for d in range(depth + 1) if (d, data[i - d : i], node) in counts and (d < 3 or sum(counts[d, data[i - d : i], node][:2]) > 1)]
            p = 0.5
            for d in sorted(known, reverse=True):
                a, b, kt, below = counts[d, data[i - d : i], node]
                one = (b + 0.5) / (a + b + 1)
                own = 1 / (1 + math.exp(min(700, max(-700, below - kt))))
                p = one if d == max(known) else own * one + (1 - own) * p
            total += math.log10(p if bit else 1 - p)
    return total


def test_context_tree(spark):
    texts = ["the cat sat on the mat", "the cat ate the rat", "a rat sat", None, "The CAT sat", "zebra", "the mat sat on"]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in context_tree.score(docs).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [s for i, s in enumerate(context_tree.streams(texts)) if i not in held]
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
    count = Counter(w for i, ws in enumerate(tokens) if i not in held for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, raw in enumerate(context_tree.streams(texts)):
        row = rows[i]
        assert row.held_out == (i in held) and row.train_tokens == total
        assert (row.n_tokens, row.n_known) == (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]))
        assert row.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens[i]))
        assert row.score == pytest.approx(brute_probability(train, raw, context_tree.DEPTH), rel=1e-4)


def test_context_tree_odd(spark):
    docs = documents(spark, odd_texts())
    rows = context_tree.score(docs.union(docs)).collect()
    assert len(rows) == 18 and all(r.score < 0 and r.n_bytes > 0 for r in rows)
    assert context_tree.score(docs.limit(0)).count() == 0
    held = docs.filter(context_tree.held_out(F.col("doc_id")))
    alone = context_tree.score(held).collect()
    assert all(r.score == pytest.approx(r.n_bytes * 8 * math.log10(0.5)) for r in alone)


def test_context_tree_keeps_every_decision(spark):
    """More than two million decisions, seen by each training text once: the score is that of the whole tree."""
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~", k=120_000))
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(40)]
    ids = [held.index(False), held.index(False, held.index(False) + 1), held.index(True)]
    docs = documents(spark, [text if i in ids else None for i in range(40)]).filter(F.col("doc_id").isin(ids))
    row = next(r for r in context_tree.score(docs).collect() if r.held_out)
    keys, _, _ = context_tree.grams(context_tree.streams([text]))
    distinct, n = np.unique(keys, return_counts=True)
    tree = context_tree.subtree(distinct, 2 * n, 0)
    kept = (tree["depth"] < 3) | (tree["a"] + tree["b"] > 1)
    assert kept.sum() > 1 << 21
    order = np.argsort(tree["key"][kept])
    known, p = tree["key"][kept][order], tree["p"][kept][order]
    total = 0.0
    for k in range(8):
        want = context_tree.node_key(5, keys >> 8, (1 << k) | (keys & 255) >> (8 - k))
        at = np.searchsorted(known, want)
        assert (known[at] == want).all()
        total += np.log10(np.where((keys >> (7 - k)) & 1, p[at], 1 - p[at])).sum()
    assert row.score == pytest.approx(total, rel=1e-4)
