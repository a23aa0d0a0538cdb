"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words joined by one space and closed by a line feed. Every byte is coded as eight binary
decisions; each decision has a Krichevsky-Trofimov estimate in the context of the last 0 to DEPTH bytes, and
context-tree weighting mixes the estimates of all depths by how well each coded the training texts.

The distinct grams (context, byte) of every block of rows and their training counts are dealt to parts by the last
TOP context bytes. A part is weighed by itself from depth TOP on; what its decisions sum up to above that is gathered
once, at most 65,536 contexts of 255 decisions whatever the corpus. Then every part scores its own grams, by the whole
tree, and the scores go back to the blocks that have them. No decision is left out for want of room.

Training counts of words, for the unigram base, reach the documents by block of rows: a block's distinct words
are looked up once, and block and counts meet in one group, so no vocabulary is broadcast.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekeep.llm.common import PIECE_BYTES, crc_rest, ship_package, staged
from tablekeep.llm.features import pack, word_hashes

DEPTH = 5
#: Context bytes that decisions of one part share; the levels above are gathered.
TOP = 3
#: Consecutive rows of a file that share the lookup of their words.
BLOCK_ROWS = 8192
FOLDS, HELD_OUT = 5, 1

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_END = b"\n"
_CONTEXT = (1 << (8 * DEPTH)) - 1


# --- bytes and grams ---------------------------------------------------------------------------


def streams(texts: list[str | None]) -> list[bytes]:
    """The bytes that are coded for each text."""
    return [b" ".join((t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()) + _END for t in texts]


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """DEPTH bytes and the byte after them for every byte of every stream, and each stream's part.

    Before a stream stand DEPTH line feeds.
    """
    data, starts, ends = pack([_END * DEPTH + r for r in raw])
    keys = np.zeros(max(0, len(data) - DEPTH), dtype=np.int64)
    for i in range(DEPTH + 1):
        keys = (keys << 8) | data[i : len(data) - DEPTH + i]
    sizes = ends - starts - DEPTH
    coded = np.cumsum(sizes)
    skip = np.ones(len(keys), dtype=bool)
    # between two streams there are DEPTH grams whose last byte is padding
    for edge in starts[1:].tolist():
        skip[edge - DEPTH : edge] = False
    return keys[skip], coded - sizes, coded


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; x > 0."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return _log_gamma(x + 0.5) + _log_gamma(y + 0.5) - _log_gamma(x + y + 1) - math.log(math.pi)


def node_key(depth: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A decision: how many context bytes, which, and the bits of the byte so far with a one in front."""
    return (np.int64(depth) << np.int64(8 * DEPTH + 8)) | (context << np.int64(8)) | node


def decisions(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, node) of all bits, with their zeros and ones."""
    keys, zeros, ones = [], [], []
    for k in range(8):
        bit = (byte >> (7 - k)) & 1
        keys.append((context << 8) | (1 << k) | (byte >> (8 - k)))
        zeros.append(np.where(bit == 0, n, 0))
        ones.append(np.where(bit == 1, n, 0))
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    a = np.bincount(at, np.concatenate(zeros), len(found))
    b = np.bincount(at, np.concatenate(ones), len(found))
    return found, a, b


def upward(keys: np.ndarray, n: np.ndarray, top: int) -> list[tuple]:
    """Per depth from DEPTH to ``top``: depth, decisions, zeros, ones, own and children's log probability, their mix."""
    levels = []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for depth in range(DEPTH, top - 1, -1):
        context = (keys >> 8) & ((1 << (8 * depth)) - 1)
        found, a, b = decisions(context, keys & 255, n)
        kt = log_kt(a, b)
        if below is None:
            children = np.full(len(found), -np.inf)
            weighted = kt
        else:
            mask = np.int64((1 << (8 * depth + 8)) - 1)
            parent = (((below[0] >> 8) << 8) & (mask ^ 255)) | (below[0] & 255)
            children = np.bincount(np.searchsorted(found, parent), below[1], len(found))
            weighted = np.logaddexp(kt, children) - math.log(2)
        below = (found, weighted)
        levels.append((depth, found, a, b, kt, children, weighted))
    return levels


def subtree(keys: np.ndarray, n: np.ndarray, top: int) -> dict[str, np.ndarray]:
    """Weigh the part of the tree from depth ``top`` on that the grams span.

    Per decision: key, zeros and ones, the log weighted probability of its part of the tree, and the probability
    of a one if this is the longest context known, mixed with the levels from ``top`` on.
    """
    levels = upward(keys, n, top)
    out: dict[str, list] = {c: [] for c in ("key", "depth", "a", "b", "weighted", "p")}
    above: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for depth, found, a, b, kt, children, weighted in reversed(levels):
        one = (b + 0.5) / (a + b + 1)
        if above is None:
            base, scale = np.zeros(len(found)), np.ones(len(found))
        else:
            mask = np.int64((1 << (8 * (depth - 1))) - 1)
            at = np.searchsorted(above[0], (((found >> 8) & mask) << 8) | (found & 255))
            base, scale = above[1][at], above[2][at]
        out["key"].append(node_key(depth, found >> 8, found & 255))
        out["depth"].append(np.full(len(found), depth))
        out["a"].append(a)
        out["b"].append(b)
        out["weighted"].append(weighted)
        out["p"].append(base + scale * one)
        own = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
        above = (found, base + scale * own * one, scale * (1 - own))
    return {c: np.concatenate(v) for c, v in out.items()}


def mix_top(a: np.ndarray, b: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, ...]:
    """One, share of the own estimate, and weighted log probability of decisions above the parts."""
    kt = log_kt(a, b)
    own = 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))
    return (b + 0.5) / (a + b + 1), own, np.logaddexp(kt, children) - math.log(2)


# --- the model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Top:
    """The levels above the parts: probability of a one per decision, in the order of their keys.

    ``base`` and ``scale`` belong to the last level and say what it and those above add to the levels below.
    """

    keys: np.ndarray
    ones: np.ndarray
    last: np.ndarray
    base: np.ndarray
    scale: np.ndarray


def top_levels(last: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray) -> Top:
    """``last``: sorted (context, node) of depth TOP - 1, with zeros, ones and the log weights of its children."""
    levels, found = [], last
    for depth in range(TOP - 1, -1, -1):
        one, own, weighted = mix_top(a, b, children)
        above, up = np.unique(found & ((1 << (8 * depth)) - 1), return_inverse=True)
        levels.append((depth, found, one, own, up))
        found, a, b, children = above, *[np.bincount(up, x, len(above)) for x in (a, b, weighted)]
    keys, ones = [], []
    base, scale = np.zeros(len(found)), np.ones(len(found))
    for depth, found, one, own, up in reversed(levels):
        base, scale = base[up], scale[up]
        keys.append(node_key(depth, found >> 8, found & 255))
        ones.append(base + scale * one)
        base, scale = base + scale * own * one, scale * (1 - own)
    return Top(np.concatenate(keys), np.concatenate(ones), last, base, scale)


@dataclass(frozen=True)
class Model:
    """Decisions of one part in the order of their keys, with the probability of a one, and the levels above."""

    keys: np.ndarray
    ones: np.ndarray
    top: Top

    def log10(self, distinct: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each gram after the bytes before it."""
        context, byte = distinct >> 8, distinct & 255
        total = np.zeros(len(distinct))
        for k in range(8):
            node = (1 << k) | (byte >> (8 - k))
            p = np.full(len(distinct), 0.5)
            rest = np.arange(len(distinct))
            for depth in range(DEPTH, -1, -1):
                keys, ones = (self.keys, self.ones) if depth >= TOP else (self.top.keys, self.top.ones)
                if not len(rest) or not len(keys):
                    continue
                want = node_key(depth, context[rest] & ((1 << (8 * depth)) - 1), node[rest])
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                p[rest[hit]] = ones[at[hit]]
                rest = rest[~hit]
            p = np.clip(p, 1e-9, 1 - 1e-9)
            total += np.log10(np.where((byte >> (7 - k)) & 1, p, 1 - p))
        return total


def model(keys: np.ndarray, n: np.ndarray, top: Top) -> Model:
    """The part of the tree that the training grams of one part span."""
    if not len(keys):
        return Model(keys, np.empty(0), top)
    found = subtree(keys, n, TOP)
    # a decision seen once says no more than the level above it
    kept = found["a"] + found["b"] > 1
    key, p = found["key"][kept], found["p"][kept]
    order = np.argsort(key)
    key, p = key[order], p[order]
    at = np.searchsorted(top.last, key & ((1 << (8 * TOP)) - 1))
    return Model(key, top.base[at] + top.scale[at] * p, top)


def _pieces(batch: pa.RecordBatch):
    step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _blocks_of(batches) -> Iterator[tuple[int | None, pa.RecordBatch | None]]:
    """Pieces of text, held_out and block that lie in one block, with (block, None) where a block ends."""
    block = None
    for batch in batches:
        for piece in _pieces(batch):
            blocks = piece.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if block is not None and blocks[a] != block:
                    yield block, None
                block = blocks[a]
                yield block, piece.slice(a, b - a)
    if block is not None:
        yield block, None


def _block_grams(parts: int) -> Callable:
    """Distinct grams of each block of a task, dealt to parts, and how often training texts have them."""

    def run(batches):
        keys, counts, held = [], [], 0
        for block, piece in _blocks_of(batches):
            if piece is not None:
                found, start, stop = grams(streams(piece.column(0).to_pylist()))
                learned = np.repeat(~piece.column(1).to_numpy(zero_copy_only=False), stop - start)
                codes, distinct = pd.factorize(found)
                keys.append(distinct)
                counts.append(np.bincount(codes, learned, len(distinct)).astype(np.int64))
                held += len(distinct)
                if held > 1 << 22:
                    keys, counts = [[x] for x in _summed(keys, counts)]
                    held = 0
                continue
            found, n = _summed(keys, counts)
            keys, counts, held = [], [], 0
            last = (found >> 8) & ((1 << (8 * TOP)) - 1)
            part = ((last * 0x9E3779B1) & 0xFFFFFFFF) * parts >> 32
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            rows = [order[cuts[p] : cuts[p + 1]] for p in full]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(full), block)),
                    pa.array(full.astype(np.int32)),
                    pa.array([found[r].tobytes() for r in rows], type=pa.binary()),
                    pa.array([n[r].astype(np.uint32).tobytes() for r in rows], type=pa.binary()),
                ],
                names=["block", "part", "grams", "counts"],
            )

    return run


def _arrays(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]


def gram_scores(rows: DataFrame) -> DataFrame:
    """block, grams and logs: log10 probability of the distinct grams of every block, in any number of rows.

    ``rows`` has text, held_out and block; what is not held out trains the tree. Nulls count as empty texts.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // BLOCK_ROWS)
    uses = rows.select("text", "held_out", "block").mapInArrow(
        _block_grams(parts), "block bigint, part int, grams binary, counts binary"
    )
    uses = staged(uses, "grams")

    def weigh(group: pa.Table) -> pa.Table:
        keys, n = _summed(_arrays(group.column("grams"), np.int64), _arrays(group.column("counts"), np.uint32))
        keys, n = keys[n > 0], n[n > 0]
        _, found, a, b, _, _, weighted = upward(keys, n, TOP)[-1]
        above, up = np.unique(found & ((1 << (8 * TOP)) - 1), return_inverse=True)
        named = ("a", a), ("b", b), ("weighted", weighted)
        return pa.table({"last": above, **{c: np.bincount(up, x, len(above)).astype(float) for c, x in named}})

    sums = (
        uses.groupBy("part")
        .applyInArrow(weigh, "last bigint, a double, b double, weighted double")
        .groupBy("last")
        .agg(*[F.sum(c).alias(c) for c in ("a", "b", "weighted")])
        .toArrow()
        .sort_by("last")
    )
    top = spark.sparkContext.broadcast(top_levels(*[sums[c].to_numpy() for c in ("last", "a", "b", "weighted")]))

    def look_up(group: pa.Table) -> pa.Table:
        own = _arrays(group.column("grams"), np.int64)
        distinct, n = _summed(own, _arrays(group.column("counts"), np.uint32))
        logs = model(distinct[n > 0], n[n > 0], top.value).log10(distinct).astype(np.float32)
        found = [logs[np.searchsorted(distinct, x)].tobytes() for x in own]
        return pa.table({"block": group.column("block"), "grams": group.column("grams"), "logs": pa.array(found, type=pa.binary())})

    return uses.groupBy("part").applyInArrow(look_up, "block bigint, grams binary, logs binary")


# --- blocks and words --------------------------------------------------------------------------


def blocked(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out and the block of each row: neighbours in their file.

    Rows that come from no file are written to one first.
    """
    docs = docs.select("doc_id", "text")
    if "_metadata" not in _hidden(docs):
        docs = staged(docs, "documents")
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS))
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), place.alias("block"))


def _hidden(docs: DataFrame) -> list[str]:
    try:
        docs.select("_metadata.row_index")
    except Exception as error:  # the class differs between classic and connect sessions
        if "UNRESOLVED_COLUMN" not in str(error) and "FIELD_NOT_FOUND" not in str(error):
            raise
        return []
    return ["_metadata"]


def held_out(doc_id: Column) -> Column:
    """A null id counts as a training document."""
    return F.coalesce(crc_rest(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def _word_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_hashes(*pack([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]))


def _block_words(batches):
    """Distinct words of each block of a task and how often training texts have them."""
    keys, counts = [], []
    for block, piece in _blocks_of(batches):
        if piece is not None:
            hashes, first, last = _word_keys(piece.column(0).to_pylist())
            learned = ~np.repeat(piece.column(1).to_numpy(zero_copy_only=False), last - first)
            found, at = np.unique(hashes, return_inverse=True)
            keys.append(found)
            counts.append(np.bincount(at, learned, len(found)))
            continue
        found, n = _summed(keys, counts)
        keys, counts = [], []
        for start in range(0, len(found), 1 << 16):
            part = slice(start, start + (1 << 16))
            size = len(found[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block)), pa.array(found[part].view(np.int64)), pa.array(n[part])],
                names=["block", "word", "n"],
            )


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    Texts whose crc32 of the id, modulo FOLDS, is HELD_OUT teach nothing. ``base_score`` is the smoothed unigram
    log10 probability of the words and the end, ``score`` that of the context tree. A null or empty text is one
    end. Without training texts every bit has probability one half.
    """
    ship_package(docs.sparkSession)
    rows = blocked(docs)
    scores = gram_scores(rows)
    uses = rows.select("text", "held_out", "block").mapInArrow(_block_words, "block bigint, word bigint, n bigint")
    by_word = Window.partitionBy("word")
    counts = staged(
        uses.select(
            "block", "word", "n", F.sum("n").over(by_word).alias("c"), F.count(F.lit(1)).over(by_word).alias("m")
        ),
        "words",
    )
    ends = rows.select("held_out").filter(~F.col("held_out")).count()
    total = ends + (counts.agg(F.sum("n").alias("n")).first().n or 0)
    distinct = sum(
        r["count"] // r.m for r in counts.filter("c > 0").groupBy("m").count().collect()
    ) + (ends > 0)
    floor = math.log10(total + 0.5 * (distinct + 1)) if total else 0.0

    def compute(texts: pa.Table, known: pa.Table) -> pa.Table:
        scored = known.filter(pc.is_valid(known.column("grams")))
        known = known.filter(pc.is_valid(known.column("word")))
        words = known.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, c = words[order], known.column("c").to_numpy()[order]
        # a block that two tasks read has grams twice, with the same scores
        gram = np.concatenate([np.empty(0, dtype=np.int64), *_arrays(scored.column("grams"), np.int64)])
        log = np.concatenate([np.empty(0, dtype=np.float32), *_arrays(scored.column("logs"), np.float32)])
        order = np.argsort(gram)
        gram, log = gram[order], log[order].astype(np.float64)
        logs = np.log10(c + 0.5) - floor
        end = np.log10(ends + 0.5) - floor
        out = []
        for batch in texts.combine_chunks().to_batches():
            for piece in _pieces(batch):
                column = piece.column("text").to_pylist()
                hashes, first, last = _word_keys(column)
                at = np.searchsorted(words, hashes)
                base = np.concatenate([[0.0], np.cumsum(logs[at])]) if len(at) else np.zeros(1)
                seen = np.concatenate([[0], np.cumsum(c[at] > 0)]) if len(at) else np.zeros(1, dtype=np.int64)
                raw = streams(column)
                keys, start, stop = grams(raw)
                codes, distinct_grams = pd.factorize(keys)
                bits = np.concatenate([[0.0], np.cumsum(log[np.searchsorted(gram, distinct_grams)][codes])])
                out.append(
                    pa.table(
                        {
                            "doc_id": piece.column("doc_id"),
                            "held_out": piece.column("held_out"),
                            "n_tokens": pa.array(last - first + 1),
                            "n_known": pa.array(seen[last] - seen[first] + (ends > 0)),
                            "base_score": pa.array(base[last] - base[first] + end),
                            "score": pa.array(bits[stop] - bits[start]),
                            "n_bytes": pa.array(stop - start),
                        }
                    )
                )
        return pa.concat_tables(out) if out else pa.schema(_RESULT).empty_table()

    known = counts.select("block", "word", "c").unionByName(scores, allowMissingColumns=True)
    joined = rows.groupBy("block").cogroup(known.groupBy("block"))
    found = joined.applyInArrow(
        compute,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint",
    )
    return found.withColumn("train_tokens", F.lit(total).cast("long"))


_RESULT = [
    ("doc_id", pa.int64()),
    ("held_out", pa.bool_()),
    ("n_tokens", pa.int64()),
    ("n_known", pa.int64()),
    ("base_score", pa.float64()),
    ("score", pa.float64()),
    ("n_bytes", pa.int64()),
]
