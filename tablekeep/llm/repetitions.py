"""Maximal periodic runs of words by the branching-tandem test on an enhanced suffix array.

A text is a sequence of words. Its suffixes are ranked by prefix doubling; the ranks of every level are kept, so the
length of a common prefix is found by descending them. An LCP interval of depth d holds all suffixes that share d
words. Where a suffix i and the suffix i+d stand in one such interval but go on differently, the 2d words from i on
are a branching square. Only the suffixes of all children of an interval but its largest are asked, by looking up the
rank of i+d and of i-d (each inside the interval or not), so a text of n words needs O(n log n) questions, and no
tree is built: intervals are the nearest smaller values of the LCP array, their children its entries of value d.
Rotating a branching square to the left as long as the words before it agree gives the run it ends; squares of
several periods that fill the same stretch are one run of the smallest period.

Only runs of at least ``exponent`` periods are wanted. A word that occurs more rarely than that in its text is in
none of them, so it only separates what stands on its sides; the suffix array is made of the rest.
"""

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type as pa_type
from pyspark.sql.types import StructType

from tablekeep.llm.common import ship_package
from tablekeep.llm.words import flat, pieces, split

#: A run is at least so many words long, and at least so many periods.
SHORTEST = 6
EXPONENT = 4
#: Bytes of texts whose suffixes are ranked together.
PIECE_BYTES = 1 << 20

FIELDS = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


class Runs(NamedTuple):
    """Start, end and period of every run, by start and then period."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _reduced(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int, exponent: int):
    """Stretches of words frequent in their text, each with a separator behind; place of each symbol in ``symbols``.

    Equal words of different texts become different symbols, so texts never share a suffix.
    """
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    keys = owner * (int(symbols.max(initial=0)) + 1) + symbols
    _, codes, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = counts[codes] >= exponent
    edge = np.ones(len(codes), dtype=bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (often[1:] != often[:-1])
    begins = np.flatnonzero(edge)
    lengths = np.diff(np.append(begins, len(codes)))
    good = often[begins] & (lengths >= shortest)
    begins, lengths = begins[good], lengths[good]
    total = int(lengths.sum()) + len(lengths)
    place = np.full(total, -1, dtype=np.int64)
    heads = np.cumsum(lengths + 1) - (lengths + 1)
    inside = np.ones(total, dtype=bool)
    inside[heads + lengths] = False
    place[inside] = np.repeat(begins - heads, lengths) + np.flatnonzero(inside)
    text = np.empty(total, dtype=np.int64)
    text[inside] = codes[place[inside]]
    text[~inside] = len(counts) + np.arange(len(lengths))
    return text, place


def _ranked(text: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ.

    The rank of a suffix is the first place of its group in the order, so the last level is the inverse suffix array.
    Separators occur once, which keeps every comparison inside its stretch.
    """
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    head = np.ones(len(text), dtype=bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(text), dtype=np.int32)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    levels, step = [rank], 1
    single = head & np.append(head[1:], True)
    active = order[~single]
    while len(active):
        before = levels[-1]
        key = before[active].astype(np.int64) * len(text) + before[active + step]
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        group = before[active]
        new_group = np.ones(len(active), dtype=bool)
        new_group[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
        at = group + np.arange(len(active)) - begin
        head = np.ones(len(active), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        rank = before.copy()
        rank[active] = at[np.flatnonzero(head)[np.cumsum(head) - 1]]
        levels.append(rank)
        single = head & np.append(head[1:], True)
        active, step = active[~single], step * 2
    return levels


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes i and j."""
    i, j, length = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][i] == levels[level][j]
        step = np.where(same, 1 << level, 0)
        i, j, length = i + step, j + step, length + step
    return length


def _rotated(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Squares moved to the left while the word before them equals the one before their second half."""
    at = at.copy()
    for level in range(len(levels) - 1, -1, -1):
        to = at - (1 << level)
        back = np.maximum(to, 0)
        same = (to >= 0) & (levels[level][back] == levels[level][np.minimum(back + period, len(levels[0]) - 1)])
        at = np.where(same, to, at)
    return at


def _nearest_smaller(lcp: np.ndarray, side: int) -> np.ndarray:
    """For each entry the nearest one on a side (-1 or 1) that is smaller; both ends of ``lcp`` are smaller than all.

    All entries jump at once; what lies between an entry and where it points is never smaller, so a jump may follow
    the pointer it meets.
    """
    to = np.clip(np.arange(len(lcp)) + side, 0, len(lcp) - 1)
    todo = np.flatnonzero((lcp > 0) & (lcp[to] >= lcp))
    while len(todo):
        to[todo] = to[to[todo]]
        todo = todo[lcp[to[todo]] >= lcp[todo]]
    return to


def _squares(text: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of all branching squares."""
    inverse = levels[-1]
    suffixes = np.empty(len(text), dtype=np.int64)
    suffixes[inverse] = np.arange(len(text))
    lcp = np.full(len(text) + 1, -1, dtype=np.int64)
    lcp[1:-1] = _common(levels, suffixes[:-1], suffixes[1:])
    low, high = _nearest_smaller(lcp, -1), _nearest_smaller(lcp, 1)
    cuts = np.flatnonzero(lcp > 0)
    cuts = cuts[np.lexsort((cuts, high[cuts], low[cuts]))]
    new = np.ones(len(cuts), dtype=bool)
    new[1:] = (low[cuts[1:]] != low[cuts[:-1]]) | (high[cuts[1:]] != high[cuts[:-1]])
    interval = np.cumsum(new) - 1
    # children: one ends at every cut, the last at the end of the interval
    ends_at = np.append(new[1:], True) if len(cuts) else new
    starts = np.concatenate([np.where(new, low[cuts], np.append(0, cuts[:-1])), cuts[ends_at]]) if len(cuts) else cuts
    stops = np.concatenate([cuts, high[cuts][ends_at]])
    owner = np.concatenate([interval, interval[ends_at]])
    sizes = stops - starts
    order = np.lexsort((-sizes, owner))
    largest = np.ones(len(order), dtype=bool)
    largest[1:] = owner[order][1:] != owner[order][:-1]
    small = order[~largest]
    found = []
    lows, highs, depths = low[cuts][new], high[cuts][new], lcp[cuts][new]
    # children are asked in blocks, so memory follows the words and not their logarithm
    block = np.cumsum(sizes[small]) // max(1, len(text))
    for number in range(int(block[-1]) + 1 if len(block) else 0):
        part = small[block == number]
        lengths = sizes[part]
        into = np.repeat(starts[part] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(int(lengths.sum()))
        mine = np.repeat(owner[part], lengths)
        here, depth = suffixes[into], depths[mine]
        for other, square in ((here + depth, here), (here - depth, here - depth)):
            fits = (other >= 0) & (other < len(text))
            rank = inverse[np.where(fits, other, 0)]
            fits &= (rank >= lows[mine]) & (rank < highs[mine])
            at, d = square[fits], depth[fits]
            branching = text[at + d] != text[at + 2 * d]
            found.append(np.stack([at[branching], d[branching]]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at, period = np.unique(np.concatenate(found, axis=1), axis=1)
    return at, period


def find_runs(
    symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT
) -> Runs:
    """Runs of all texts; text k is symbols[starts[k]:ends[k]], and texts follow each other without gaps."""
    none = np.empty(0, dtype=np.int64)
    text, place = _reduced(symbols, starts, ends, shortest, exponent)
    if not len(text):
        return Runs(none, none, none)
    levels = _ranked(text)
    at, period = _squares(text, levels)
    left = _rotated(levels, at, period)
    length = at + 2 * period - left
    long_enough = length >= np.maximum(shortest, exponent * period)
    left, length, period = left[long_enough], length[long_enough], period[long_enough]
    order = np.lexsort((period, length, left))
    left, length, period = left[order], length[order], period[order]
    merged = np.ones(len(left), dtype=bool)
    merged[1:] = (left[1:] != left[:-1]) | (length[1:] != length[:-1])
    start, length, period = place[left[merged]], length[merged], period[merged]
    order = np.lexsort((period, start))
    return Runs(start[order], (start + length)[order], period[order])


def _described(column: pa.Array) -> list[list]:
    """One list per field of FIELDS."""
    data, offsets = flat(column)
    words = split(data, offsets)
    runs = find_runs(words.ids, words.first, words.last)
    marks = np.zeros(len(words.ids) + 1, dtype=np.int64)
    np.add.at(marks, runs.start + runs.period, 1)
    np.add.at(marks, runs.end, -1)
    kept = np.cumsum(marks[:-1]) == 0
    raw = data.tobytes()
    low = np.searchsorted(runs.start, words.first).tolist()
    high = np.searchsorted(runs.start, words.last).tolist()
    out: list[list] = [[] for _ in FIELDS.split(",")]
    for k, (first, last) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
        start = (runs.start[low[k] : high[k]] - first).tolist()
        period = runs.period[low[k] : high[k]].tolist()
        length = (runs.end[low[k] : high[k]] - first).tolist()
        length = [e - s for s, e in zip(start, length, strict=True)]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start, length, period, strict=True))
        text = raw[offsets[k] : offsets[k + 1]].split()
        if start:
            text = [w for w, keep in zip(text, kept[first:last].tolist(), strict=True) if keep]
            best = min(range(len(start)), key=lambda i: (-length[i], start[i], period[i]))
            top = [start[best], length[best], period[best], 1000 * length[best] // period[best]]
        else:
            top = [None] * 4
        row = [len(start), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(text)).hexdigest()]
        for values, value in zip(out, row, strict=True):
            values.append(value)
    return out


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with FIELDS: the runs of every text and a digest of the text without them.

    A run is a stretch of words with smallest period q, at least max(SHORTEST, EXPONENT * q) words long, that no
    neighbouring word extends. start, length, period and exponent_milli are those of the longest run (ties: first
    start, then smallest period) and null without one. ``runs_sha256`` digests ``start,length,period`` and a line feed of
    every run; ``collapsed_sha256`` digests the words that no run has after its first period, joined by one space.

    Null and empty texts have no words, no runs and the digests of an empty text. Repeated rows are described each.
    Columns of the names in FIELDS are replaced; all others, whatever their names, are passed on. An empty table gives
    no rows. A text is handled whole in one task, whatever its length.
    """
    added = StructType.fromDDL(FIELDS)
    kept = [f for f in docs.schema.fields if f.name not in added.names and f.name != text]
    types = [pa_type(f.dataType) for f in added.fields]
    names = [f.name for f in kept]
    at, places = docs.columns.index(text), [docs.columns.index(n) for n in names]

    def run(batches):
        for piece in pieces(batches, PIECE_BYTES):
            found = _described(piece.column(at))
            arrays = [piece.column(i) for i in places] + [pa.array(v, type=t) for v, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added.names])

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*kept, *added.fields]))
