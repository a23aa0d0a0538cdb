"""N-gram Jaccard join in the metric space of Jaccard distance.

Texts are sets of hashed word shingles; equal sets are one point. The join works in regions:

1. Coarse regions. Two sets of similarity t differ in at most (1-t)/(1+t) of their joint size. If the shingles of
   a size class are dealt to more classes than that by their hash, two linked sets agree on a whole class. Sets
   that agree on a class are tied, and tied sets form a region. Pivots drawn from a whole corpus would not do:
   unrelated texts are all at distance one from them, and the windows would copy every text into every cell.
   At low thresholds a class holds few shingles, and passages of many texts would tie unrelated ones. A rule with
   ``rare`` ties sets by their rarest shingles instead: n - ceil(t n) + 1 of them, in one order for all sets, must
   share one if two sets are linked. The order is by counts of all texts, in a sketch of fixed size. When it fills up,
   unrelated texts meet by the phrases that any two large texts share. So a few shingles more are taken than one must
   be shared of, and a set that has not as many shingles in common with others as each of its links would need is in
   no region.
2. Inside a region: pivots create Voronoi cells. A set whose distance to another pivot exceeds that to its own by
   no more than twice the radius is copied into that cell too (triangle inequality), so every linked pair meets in
   a cell. Cells are split again until they are small and then joined exactly. Regions that are too large for a
   task are first cut into shells around a pivot; only shells closer than the radius meet.

Links are returned as a forest that spans every component; no pair of a group is emitted beyond that.
"""

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.functions.lineage import forget, shuffles_dropped
from tablekeep.llm.common import PIECE_BYTES, ship_package, staged, text_columns
from tablekeep.llm.features import pack, word_hashes

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Shingles of a region that one task holds; larger regions are cut into shells.
TASK_SHINGLES = 2_000_000
#: Shingles of a region below which regions share a task.
SMALL_SHINGLES = 20_000
#: Sets of a cell that are compared at once.
LEAF = 1024
PIVOTS = 8
#: Keys that a task holds before it hands them on.
BATCH_KEYS = 1_000_000
#: Bits of the filter that says which sets are tied to another: one megabyte.
FILTER_BITS = 1 << 23
#: Counters of the sketch of shingle counts, as a power of two, and counters that are added up together.
SKETCH_BITS = 25
SKETCH_BLOCK = 1 << 17


@dataclass(frozen=True)
class Rule:
    """Shingle length and threshold: num/den of the union must be shared.

    ``rare`` ties sets by their rarest shingles, not by classes of shingles; links are the same.
    """

    words: int
    num: int
    den: int
    rare: bool = False

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)

    def size_classes(self, size: int) -> list[tuple[int, int]]:
        """(number of the class, most differing shingles plus one) for its own size and as the smaller partner."""
        low, number = 1, 0
        while low * self.den // self.num < size:
            low, number = low * self.den // self.num + 1, number + 1
        out = []
        for step in (0, 1):
            high = low * self.den // self.num
            if step == 0 or self.den * size >= self.num * low:
                out.append((number + step, (self.den - self.num) * 2 * high // (self.den + self.num) + 1))
            low = high + 1
        return out

    def extra(self, size: int) -> int:
        """Rare shingles taken of a set beyond those of which it may share none with a linked set."""
        return 1 + self.num * size // (8 * self.den)

    def needed(self, size: Column) -> Column:
        """Rare shingles that a set of this size shares with every linked set: as many as the smaller of both has extra."""
        least = F.floor((size * self.num + (self.den - 1)) / self.den)
        return 1 + F.floor(least * self.num / (8 * self.den))

    @property
    def smallest(self) -> int:
        """Sets of fewer shingles link only with equal sets."""
        return -(-self.num // (self.den - self.num))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD[0]
    return values ^ (values >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, none is empty."""
    data, starts, ends = pack([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts])
    hashes, first, last = word_hashes(data, starts, ends)
    hashes = _mixed(hashes)
    sums = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for i in range(words if len(sums) else 0):
        sums = sums * _ODD[1] + hashes[i : len(hashes) - words + 1 + i] * _ODD[2 + i % 3]
    sums = _mixed(sums)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(sums[a : b - words + 1]))
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    value = value * _ODD[3] + h
            out.append(_mixed(np.array([value], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    total = np.array([np.add.reduce(_mixed(shingles + _ODD[4])) + np.uint64(len(shingles))])
    return int(_mixed(total).view(np.int64)[0])


def region_keys(shingles: np.ndarray, rule: Rule) -> np.ndarray:
    """One key per size class and class of shingles; equal for sets that agree on the whole class."""
    out = []
    mixed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(shingles ^ _ODD[3]), dtype=np.uint64)])
    high = shingles >> np.uint64(32)
    for number, classes in rule.size_classes(len(shingles)):
        own = (high * np.uint64(classes)) >> np.uint64(32)
        cuts = np.searchsorted(own, np.arange(classes + 1, dtype=np.uint64))
        name = np.arange(classes, dtype=np.uint64) | np.uint64(number << 40)
        out.append(_mixed(mixed[cuts[1:]] - mixed[cuts[:-1]] + _mixed(name + _ODD[1])))
    return np.concatenate(out).view(np.int64)


def rare_keys(shingles: np.ndarray, rule: Rule, sketch: np.ndarray) -> np.ndarray:
    """The rarest shingles, of which two linked sets share some (:meth:`Rule.needed`). Equal counts go by hash."""
    kept = len(shingles) + rule.num * len(shingles) // -rule.den + rule.extra(len(shingles))
    order = np.argsort(sketch[shingles >> np.uint64(64 - SKETCH_BITS)], kind="stable")
    return shingles[order[:kept]].view(np.int64)


# --- exact join of a region ----------------------------------------------------------------------


class Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def _common(sets: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """Shared shingles of each set with one."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    hits = np.concatenate([[0], np.cumsum(one[at] == flat)])
    ends = np.cumsum([len(s) for s in sets])
    return hits[ends] - hits[ends - [len(s) for s in sets]]


def _block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, rule: Rule, forest: Forest) -> None:
    """Compare all of ``left`` with all of ``right``: one product of incidence matrices, columns in parts."""
    if len(left) == 1 and len(right) == 1:
        a, b = sets[left[0]], sets[right[0]]
        common = len(np.intersect1d(a, b, assume_unique=True))
        if rule.linked(np.array(common), len(a), len(b)):
            forest.link(int(left[0]), int(right[0]))
        return
    both = np.unique(np.concatenate([left, right]))
    flat = np.concatenate([sets[i] for i in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    numbers = np.cumsum(times > 1) - 1
    column, owner = numbers[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    rows, columns = np.searchsorted(both, left), np.searchsorted(both, right)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 2048
    edges = np.searchsorted(column, np.arange(0, int(numbers[-1]) + 1 + width, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        matrix = np.zeros((len(both), width), dtype=np.float32)
        matrix[owner[part], column[part] - k * width] = 1
        common += matrix[rows] @ matrix[columns].T
    size_l = np.array([len(sets[i]) for i in left], dtype=np.int64)
    size_r = np.array([len(sets[i]) for i in right], dtype=np.int64)
    found = rule.linked(common.astype(np.int64), size_l[:, None], size_r[None, :])
    for i, j in zip(*np.nonzero(found), strict=True):
        if left[i] != right[j]:
            forest.link(int(left[i]), int(right[j]))


def join_cell(sets: list[np.ndarray], cell: np.ndarray, rule: Rule, forest: Forest, depth: int = 0) -> None:
    """Link all sets of a cell: Voronoi cells of pivots with their windows, until a cell is small."""
    if len(cell) < 2:
        return
    if len(cell) > LEAF:
        rng = np.random.default_rng(len(cell) + depth)
        pivots = rng.choice(cell, PIVOTS, replace=False)
        sizes = np.array([len(sets[i]) for i in cell])
        distance = np.empty((PIVOTS, len(cell)))
        members = [sets[i] for i in cell]
        for k, p in enumerate(pivots):
            common = _common(members, sets[p])
            union = sizes + len(sets[p]) - common
            distance[k] = 1 - common / union
            for j in cell[rule.linked(common, sizes, len(sets[p]))].tolist():
                if j != p:
                    forest.link(int(p), j)
        near = distance.min(axis=0)
        cells = [cell[distance[k] <= near + 2 * rule.radius + 1e-9] for k in range(PIVOTS)]
        if max(map(len, cells)) <= 0.7 * len(cell) and depth < 12:
            for part in cells:
                join_cell(sets, part, rule, forest, depth + 1)
            return
    # too small or too close together to be split: exact, in blocks; sizes far apart do not meet
    ordered = cell[np.argsort([len(sets[i]) for i in cell], kind="stable")]
    blocks = [ordered[i : i + LEAF] for i in range(0, len(ordered), LEAF)]
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            if rule.den * len(sets[left[-1]]) >= rule.num * len(sets[right[0]]):
                _block(sets, left, right, rule, forest)


# --- Spark -----------------------------------------------------------------------------------------


def _sketch(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How often the shingles of each counter occur in all texts, as one byte that grows with the logarithm.

    Tasks count into an array of fixed size and hand on what they met in compressed blocks, added up one by one.
    """
    blocks = (1 << SKETCH_BITS) // SKETCH_BLOCK

    def count(batches):
        # counters met so far with their counts; few of all counters in a task of usual size
        at, times, held = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint32), []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([at, *[x for x, _ in held]])
            order = np.argsort(every, kind="stable")
            every = every[order]
            heads = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else order
            sums = np.add.reduceat(np.concatenate([times, *[x for _, x in held]])[order], heads) if len(every) else times
            return every[heads], sums

        for batch in batches:
            step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                sets = shingle_sets(batch.column(0).slice(start, step).to_pylist(), rule.words)
                found = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                held.append(tuple(x.astype(np.uint32) for x in found))
                if sum(len(x) for x, _ in held) > len(at) + SKETCH_BLOCK:
                    (at, times), held = summed(), []
        used, counts = summed()
        if len(used):
            cuts = np.searchsorted(used, np.arange(blocks + 1) * SKETCH_BLOCK)
            packed = []
            for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                gaps = np.diff(used[a:b], prepend=np.uint32(number * SKETCH_BLOCK))
                packed.append(zlib.compress(np.concatenate([gaps, counts[a:b]]).astype(np.uint32).tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(blocks), type=pa.int32()), pa.array(packed, type=pa.binary())], names=["block", "counts"]
            )

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gaps, times = np.frombuffer(zlib.decompress(counts.as_buffer()), dtype=np.uint32).reshape(2, -1)
                total.setdefault(block, np.zeros(SKETCH_BLOCK, dtype=np.int64))[np.cumsum(gaps)] += times
        grades = [np.minimum(255, 6 * np.log2(1 + c)).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), type=pa.int32()), pa.array(grades, type=pa.binary())], names=["block", "counts"]
        )

    schema = "block int, counts binary"
    with shuffles_dropped(docs.sparkSession):
        rows = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    sketch = np.zeros((blocks, SKETCH_BLOCK), dtype=np.uint8)
    for block, grades in zip(rows["block"].to_pylist(), rows["counts"], strict=True):
        sketch[block] = np.frombuffer(grades.as_buffer(), dtype=np.uint8)
    return sketch.reshape(-1)


def _key_batches(rule: Rule, parts: int, key_of: Callable[[np.ndarray], np.ndarray]):
    """Keys and set ids of a task, dealt to parts; unless the keys are rare, sets that agree inside the task are tied at once."""

    def hand_on(keys: list, ids: list) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(keys)
        own = np.repeat(np.array(ids, dtype=np.int64), [len(k) for k in keys])
        first, ties = (np.arange(len(key)), np.empty((0, 2), dtype=np.int64)) if rule.rare else _tie(key, own)
        part = (key[first].view(np.uint64) >> np.uint64(11)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        rows = [order[cuts[p] : cuts[p + 1]] for p in range(parts)]
        full = [p for p in range(parts) if len(rows[p])]
        blob = [ties.tobytes()] + [b""] * max(0, len(full) - 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full, type=pa.int32()),
                pa.array([key[first][rows[p]].tobytes() for p in full], type=pa.binary()),
                pa.array([own[first][rows[p]].tobytes() for p in full], type=pa.binary()),
                pa.array(blob[: len(full)], type=pa.binary()),
            ],
            names=["part", "keys", "ids", "ties"],
        )

    def run(batches):
        keys, ids, seen, held = [], [], set(), 0
        for batch in batches:
            step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                for shingles in shingle_sets(batch.column(0).slice(start, step).to_pylist(), rule.words):
                    if len(shingles) < rule.smallest:
                        continue
                    name = set_id(shingles)
                    if name in seen:
                        continue
                    seen.add(name)
                    keys.append(key_of(shingles))
                    ids.append(name)
                    held += len(keys[-1])
                    if held > BATCH_KEYS:
                        yield from hand_on(keys, ids)
                        keys, ids, held = [], [], 0
        if keys:
            yield from hand_on(keys, ids)

    return run


def _tie(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the smallest id of every key, and the different (id, smallest id) pairs."""
    order = np.lexsort((own, key))
    sorted_key, sorted_own = key[order], own[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    first = order[new]
    lead = own[first][np.cumsum(new) - 1]
    other = sorted_own != lead
    pairs = np.unique(np.stack([sorted_own[other], lead[other]], axis=1), axis=0) if other.any() else np.empty((0, 2), dtype=np.int64)
    return first, pairs


def _shared(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (key, id) of keys that more than one id has."""
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])) if len(key) else np.empty(0, dtype=bool)
    key, own = key[new], own[new]
    same = key[1:] == key[:-1]
    several = np.append(False, same) | np.append(same, False) if len(key) else np.empty(0, dtype=bool)
    return key[several], own[several]


def _pruned(shared: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """The (key, id) left when ids that share too few keys to be linked are left out, again as long as many go.

    Two linked sets share the keys they need with each other, so neither of them ever goes.
    """
    before = shared.count()
    while before:
        enough = F.col("n") >= rule.needed(F.col("n_shingles"))
        able = shared.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(sizes, "id").filter(enough).select("id")
        rows = shared.join(able, "id", "left_semi")
        several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        left = staged(rows.join(several, "key", "left_semi"), "shared")
        forget(shared)
        shared, n = left, left.count()
        if n > 0.9 * before:
            break
        before = n
    return shared


def _ties(docs: DataFrame, rule: Rule, members: DataFrame) -> DataFrame:
    """Different pairs (a, b) of tied sets: b is the smallest id that shares some key with a.

    ``members`` holds ``set_id, n_shingles`` of all texts.
    """
    spark = docs.sparkSession
    if rule.rare:
        sketch = spark.sparkContext.broadcast(_sketch(docs, rule))

        def key_of(shingles: np.ndarray) -> np.ndarray:
            return rare_keys(shingles, rule, sketch.value)
    else:

        def key_of(shingles: np.ndarray) -> np.ndarray:
            return region_keys(shingles, rule)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    packed = docs.select("text").mapInArrow(_key_batches(rule, parts, key_of), "part int, keys binary, ids binary, ties binary")
    if rule.rare:

        def share(group: pd.DataFrame) -> pd.DataFrame:
            key = np.frombuffer(b"".join(group["keys"]), dtype=np.int64)
            key, own = _shared(key, np.frombuffer(b"".join(group["ids"]), dtype=np.int64))
            return pd.DataFrame({"key": key, "id": own})

        sizes = members.select(F.col("set_id").alias("id"), "n_shingles").distinct()
        shared = staged(packed.groupBy("part").applyInPandas(share, "key bigint, id bigint"), "shared")
        shared = _pruned(shared, sizes, rule)
        least = shared.groupBy("key").agg(F.min("id").alias("b"))
        return shared.join(least, "key").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()

    def tie(group: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(b"".join(group["keys"]), dtype=np.int64)
        own = np.frombuffer(b"".join(group["ids"]), dtype=np.int64)
        early = np.frombuffer(b"".join(group["ties"]), dtype=np.int64).reshape(-1, 2)
        pairs = np.concatenate([_tie(key, own)[1], early])
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return packed.groupBy("part").applyInPandas(tie, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable: large-star and small-star steps until nothing changes.

    ``links`` has columns a and b. Every step is written to the shared folder.
    """
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before or not mark.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        last, edges = edges, staged(
            small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges"
        )
        forget(last)


def _tied_sets(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """set_id and shingles of the sets among ``nodes``, each once.

    A bit set of fixed size tells tasks which texts to send on; the join afterwards drops what slipped through.
    Copies are dropped inside the tasks as far as a set was sent before, and the rest by one aggregate over set_id
    that merges before its shuffle, so no group meets a set twice.
    """
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    rows = (
        nodes.select(F.shiftright(bit, 5).cast("int").alias("at"), bit.bitwiseAND(F.lit(31)).cast("int").alias("bit"))
        .select("at", F.expr("shiftleft(1L, bit)").alias("bits"))
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    present = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                at = piece.column(1).to_numpy()
                hit = (present.value[at >> 5] >> (at & 31)) & 1 == 1
                hit &= np.array([name not in sent for name in piece.column(2).to_pylist()])
                if not hit.any():
                    continue
                sets = shingle_sets(piece.column(0).filter(pa.array(hit)).to_pylist(), rule.words)
                found = {set_id(s): s for s in sets if len(s)}
                sent.update(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), type=pa.int64()), pa.array([s.tobytes() for s in found.values()], type=pa.binary())],
                    names=["set_id", "shingles"],
                )

    named = docs.select("text", F.pmod(F.xxhash64("set_id"), F.lit(FILTER_BITS)).alias("bit"), "set_id").filter("bit is not null")
    sets = named.mapInArrow(run, "set_id bigint, shingles binary")
    return sets.groupBy("set_id").agg(F.any_value("shingles").alias("shingles"))


def _region_links(rule: Rule):
    def join(group: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for _, region in group.groupby("region", sort=False):
            region = region.drop_duplicates("set_id")
            ids = region["set_id"].to_numpy()
            sets = [np.frombuffer(s, dtype=np.uint64) for s in region["shingles"]]
            forest = Forest(len(sets))
            join_cell(sets, np.arange(len(sets)), rule, forest)
            links += [(int(ids[i]), int(ids[j])) for i, j in forest.links]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return join


def _shells(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Large regions cut for tasks: rows of region pieces to join, and the links with the pivots.

    A piece is a pair of shells around the region's pivot whose distances differ by the radius at most. Sets
    linked to the pivot are one component already and are not compared with each other.
    """
    pivot = rows.groupBy("label").agg(F.min_by("shingles", "set_id").alias("pivot"), F.min("set_id").alias("pivot_id"))
    width = rule.radius / 2
    near = rows.join(pivot, "label")

    def measure(batches):
        for batch in batches:
            frame = batch.to_pandas()
            shell = []
            for own, other in zip(frame["shingles"], frame["pivot"], strict=True):
                a, b = np.frombuffer(own, dtype=np.uint64), np.frombuffer(other, dtype=np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                tied = rule.linked(np.array(common), len(a), len(b))
                shell.append(-1 if tied else int((1 - common / (len(a) + len(b) - common)) / width))
            frame["shell"] = np.array(shell, dtype=np.int32)
            yield pa.RecordBatch.from_pandas(
                frame[["label", "set_id", "pivot_id", "shingles", "shell"]], preserve_index=False
            )

    schema = "label bigint, set_id bigint, pivot_id bigint, shingles binary, shell int"
    measured = staged(near.mapInArrow(measure, schema), "shells")
    links = measured.filter("shell = -1 and set_id <> pivot_id").select(F.col("set_id").alias("a"), F.col("pivot_id").alias("b"))
    weight = F.sum(F.length("shingles") / 8)
    shells = measured.groupBy("label", "shell").agg(F.ceil(weight * 2 / TASK_SHINGLES).cast("int").alias("cuts"))
    place = measured.join(shells, ["label", "shell"]).withColumn("cut", F.pmod(F.xxhash64("set_id"), F.col("cuts")).cast("int"))
    # the linked sets lie within the radius, so they meet shells up to twice the radius
    other = shells.select("label", F.col("shell").alias("shell2"), "cuts").withColumn("cut2", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    pairs = shells.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts").join(other, "label").filter(
        (F.struct("shell", "cut") <= F.struct(F.col("shell2").alias("shell"), F.col("cut2").alias("cut")))
        & (
            ((F.col("shell") >= 0) & (F.col("shell2") - F.col("shell") <= 3))
            | ((F.col("shell") == -1) & (F.col("shell2") >= 0) & (F.col("shell2") <= 5))
        )
    ).withColumn("region", F.xxhash64("label", "shell", "cut", "shell2", "cut2"))
    ends = pairs.select("label", "region", F.explode(F.array_distinct(F.array(F.struct("shell", "cut"), F.struct(F.col("shell2").alias("shell"), F.col("cut2").alias("cut"))))).alias("e"))
    pieces = place.join(ends.select("label", "region", "e.shell", "e.cut"), ["label", "shell", "cut"])
    return pieces.select("region", "set_id", "shingles"), links


def jaccard_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, its own for a document that has none. Null and
    empty texts have no shingles and no links; equal sets are linked. A null doc_id never names a component that
    has other ids. Sets are compared by 64-bit hashes of their shingles.
    """
    ship_package(docs.sparkSession)

    def make():
        def compute(texts: list) -> list[list]:
            sets = shingle_sets(texts, rule.words)
            return [[len(s) for s in sets], [set_id(s) if len(s) else None for s in sets]]

        return compute

    texts = docs.select("doc_id", "text")
    named = text_columns(texts, "n_shingles bigint, set_id bigint", make)
    members = staged(named.drop("text"), "members")
    regions = staged(components(_ties(texts, rule, members)), "regions")
    # The weight of a region is known from the sizes of its sets, before any shingles are sent.
    sizes = members.select(F.col("set_id").alias("node"), "n_shingles").distinct()
    sized = regions.join(sizes, "node")
    weight = sized.groupBy("label").agg(F.sum("n_shingles").alias("weight"))
    sized = staged(sized.join(weight, "label").select("node", "label", "weight"), "weights")
    packs = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(nodes: DataFrame) -> DataFrame:
        return _tied_sets(named, nodes.select("node"), rule).join(nodes.withColumnRenamed("node", "set_id"), "set_id")

    fits, large = sized.filter(F.col("weight") <= TASK_SHINGLES), sized.filter(F.col("weight") > TASK_SHINGLES)
    task = F.when(F.col("weight") <= SMALL_SHINGLES, F.pmod(F.xxhash64("label"), F.lit(packs))).otherwise(F.col("label"))
    joined, links = rows(fits).select(task.alias("task"), F.col("label").alias("region"), "set_id", "shingles"), None
    if not large.isEmpty():
        tied = staged(rows(large).select("label", "set_id", "shingles"), "tied")
        pieces, links = _shells(tied, rule)
        forget(tied)
        joined = joined.union(pieces.select(F.col("region").alias("task"), "region", "set_id", "shingles"))
    found = joined.groupBy("task").applyInPandas(_region_links(rule), "a bigint, b bigint")
    labels = components(found if links is None else found.union(links))
    grouped = members.join(labels, members.set_id == labels.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "set_id").alias("label")
    )
    names = grouped.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return grouped.join(names, "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )
