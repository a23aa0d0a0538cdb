"""Decontamination, sharding and rules on odd rows, against plain Python."""

import random
from collections import Counter

from tablekeep.llm import decontaminate, rule_ledger, sharding
from tests.llm.helpers import BENCH_WORD, LOWER, WORD, documents, odd_texts, sentence
from pyspark.sql import functions as F


def brute_contamination(texts, items):
    out = []
    split = [BENCH_WORD.findall((t or "").translate(LOWER)) for t in texts]
    for words in split:
        hit, found = set(), set()
        for item, text in items:
            other = BENCH_WORD.findall((text or "").translate(LOWER))
            size = min(13, len(other))
            windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
            for i in range(len(words) - size + 1) if size else ():
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(item)
        out.append((len(words), len(hit), sorted(map(str, found - {None}))))
    return out


def test_contamination(spark):
    rng = random.Random(1)
    passages = [sentence(rng, n) for n in (13, 14, 40, 300)]
    items = [(i, p) for i, p in enumerate(passages)]
    items += [(20, "tiny"), (21, "two words"), (22, ""), (23, None), (24, passages[2]), (None, passages[1]), (25, "la " * 30), (20, "tiny")]
    texts = odd_texts()
    texts += [sentence(rng, 50) + " " + p + " " + sentence(rng, 20) for p in passages]
    texts += [" ".join(p.split()[:12]) for p in passages] + [p.upper().replace(" ", " -- ") for p in passages]
    texts += ["so Tiny, a thing", "two. words two words", "la " * 200, " ".join(passages[3].split()[5:60]) + " " + passages[3]]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    for i, want in enumerate(brute_contamination(texts, items)):
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == want
        assert rows[i].contaminated == (want[1] > 0 and 20 * want[1] >= want[0])
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    clean = decontaminate.contamination(docs, benchmark.limit(0))
    assert clean.agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(docs.union(docs), benchmark).count() == 2 * len(texts)


def test_shards(spark):
    rng = random.Random(2)
    source = [rng.choice(["hot", "hot", "hot", "b", "c", None]) for _ in range(5000)]
    docs = documents(spark, ["t"] * 5000, source=source).select("doc_id", "source", "score")
    key = F.md5(F.col("doc_id").cast("string"))
    rows = sharding.interleave(docs, 7, key).collect()
    assert sorted(r.doc_id for r in rows) == list(range(5000))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for name, total in Counter(source).items():
        per = [sum(r.source == name for r in rows if r.shard == s) for s in range(7)]
        assert max(per) - min(per) <= 2 and sum(per) == total
    assert sharding.interleave(docs.limit(0), 7, key).count() == 0
    same = documents(spark, ["t"] * 3).select(F.lit(1).alias("doc_id"), "source")
    assert sorted((r.shard, r.slot) for r in sharding.interleave(same, 3, key).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_shards_keep_columns_of_any_name(spark):
    names = ("start", "stratum", "stratum_rows", "n", "bucket", "inside", "rank", "position", "fraction", "shuffle_key", "c0", "a.b", "Shard", "slot")
    docs = documents(spark, ["t"] * 30, source=["a", "b", None] * 10).drop("score")
    for name in names:
        docs = docs.withColumn(name, F.col("doc_id") * 2)
    docs = docs.union(docs.limit(5)).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    placed = sharding.interleave(docs, 4, F.md5(F.col("doc_id").cast("string")))
    assert placed.columns == [*[c for c in docs.columns if c not in ("Shard", "slot")], "shard", "slot"]
    rows = placed.collect()
    assert len(rows) == 38 and sorted(Counter(r.shard for r in rows).values()) == [9, 9, 10, 10]
    assert all(r.rank == r["a.b"] == r.c0 and (r.doc_id is None or r.rank == 2 * r.doc_id) for r in rows)
    again = sharding.interleave(docs.repartition(5), 4, F.md5(F.col("doc_id").cast("string"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_rules(spark):
    rng = random.Random(3)
    run = sentence(rng, 6)
    texts = odd_texts() + [f"{run} x {run} y {run}", "a a a a a a a a a a a a", "l one\n\n \nl one\nl one\nl two", "#*$%&|<> a", "A! B! C!", run * 30]
    rows = {r.doc_id: r for r in rule_ledger.ledger(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        runs = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        count = Counter(runs)
        twice = {p for j, r in enumerate(runs) if count[r] > 1 for p in range(j, j + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice))
        got = rows[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert bool(got.failed_bits & rule_ledger.BASE.mask) == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    ledger = rule_ledger.ledger(documents(spark, texts))
    table = {r.rule: r for r in rule_ledger.ablation(ledger, rule_ledger.STRICT).collect()}
    bits = [r.failed_bits for r in rows.values()]
    for i, name in enumerate(rule_ledger.RULES):
        assert table[name].n_failed == sum(b >> i & 1 for b in bits)
        assert table[name].n_only == sum(b == 1 << i for b in bits)
        assert table[name].kept_without == sum(b & ~(1 << i) == 0 for b in bits)
    assert rule_ledger.apply_policies(ledger, [rule_ledger.BASE, rule_ledger.STRICT]).filter("kept_v1 and not kept_base").count() == 0
    assert rule_ledger.ledger(documents(spark, [])).count() == 0
