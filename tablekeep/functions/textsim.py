"""String similarity as column expressions; the windows of a partial ratio are walked by a short Python function.

The longest common subsequence is counted with the bit-parallel recurrence
of Hyyrö: one machine word holds a whole row of the usual table, so a string
of n characters costs n steps. Words of 62 bits keep every sum inside a
signed BIGINT; longer strings use several words with a carry.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 62


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", _long(1), position.cast("int"))


def _ones(count: Column) -> Column:
    return _bit(count) - _long(1)


def _chars(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.split(text, "")
    )


def _mask(chars: Column, char: Column) -> Column:
    """Bits set at the positions of ``char`` in ``chars`` (at most one word)."""
    bits = F.transform(chars, lambda c, i: F.when(c == char, _bit(i)).otherwise(_long(0)))
    return F.aggregate(bits, _long(0), lambda acc, bit: acc.bitwiseOR(bit))


def _lcs_word(masks: Column, size: Column) -> Column:
    """Common subsequence length; the pattern has ``size`` <= 62 characters."""
    full = _ones(size)

    def step(state: Column, mask: Column) -> Column:
        hit = state.bitwiseAND(mask)
        return (state + hit).bitwiseOR(state - hit).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(masks, full, step))


def _word_count(size: Column) -> Column:
    return F.ceil(size / WORD_BITS).cast("int")


def _masks_words(pattern: Column, text: Column) -> Column:
    words = F.transform(
        F.sequence(F.lit(0), _word_count(F.size(pattern)) - 1),
        lambda w: F.slice(pattern, w * WORD_BITS + 1, F.lit(WORD_BITS)),
    )
    return _let(
        words, lambda ws: F.transform(text, lambda c: F.transform(ws, lambda w: _mask(w, c)))
    )


def _lcs_words(masks: Column, size: Column) -> Column:
    """Same count for patterns of any length; a mask is an array of words."""
    fulls = F.transform(
        F.sequence(F.lit(0), _word_count(size) - 1),
        lambda w: _ones(F.least(F.lit(WORD_BITS), size - w * WORD_BITS)),
    )

    def step(state: Column, mask: Column) -> Column:
        parts = F.zip_with(state, mask, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
        start = F.struct(_long(0).alias("carry"), F.array().cast("array<bigint>").alias("words"))

        def add(acc: Column, part: Column) -> Column:
            hit = part["s"].bitwiseAND(part["m"])
            total = part["s"] + hit + acc["carry"]
            low = total.bitwiseOR(part["s"] - hit).bitwiseAND(_long((1 << WORD_BITS) - 1))
            return F.struct(
                F.call_function("shiftright", total, F.lit(WORD_BITS)).alias("carry"),
                F.concat(acc["words"], F.array(low)).alias("words"),
            )

        words = F.aggregate(parts, start, add, lambda acc: acc["words"])
        return F.zip_with(words, fulls, lambda w, full: w.bitwiseAND(full))

    left = F.aggregate(masks, fulls, step)
    ones = F.aggregate(left, _long(0), lambda acc, w: acc + F.bit_count(w))
    return (size - ones).cast("int")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two non-null strings."""
    pair = F.struct(_chars(a).alias("a"), _chars(b).alias("b"))

    def count(p: Column) -> Column:
        size = F.size(p["a"])
        one_word = _lcs_word(F.transform(p["b"], lambda c: _mask(p["a"], c)), size)
        return (
            F.when((size == 0) | (F.size(p["b"]) == 0), F.lit(0))
            .when(size <= WORD_BITS, one_word)
            .otherwise(_lcs_words(_masks_words(p["a"], p["b"]), size))
            .cast("int")
        )

    return _let(pair, count)


def indel_ratio(a: Column, b: Column) -> Column:
    """``2 * LCS / (len a + len b)``, 1 when both strings are empty."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)


def _window_ratio() -> Callable:
    """The function behind :func:`partial_ratio`; made here, so that it travels to the tasks by value."""

    def best_window(short: str, long: str) -> float:
        n, m, full = len(short), len(long), (1 << len(short)) - 1
        masks: dict[str, int] = {}
        for i, c in enumerate(short):
            masks[c] = masks.get(c, 0) | 1 << i
        steps = [masks.get(c, 0) for c in long]
        best = 0.0
        # A window ends at 1 .. n + m - 1 and is clipped to the string: full ones, and shorter ones at both ends. One
        # that ends (at the end of the string: begins) with a character foreign to ``short`` is no better than its neighbour.
        for end in range(1, n + m):
            start = max(0, end - n)
            if not steps[end - 1 if end <= m else start]:
                continue
            window, left = steps[start:end], full
            if 2.0 * min(n, len(window)) / (n + len(window)) <= best:
                continue
            for mask in window:
                hit = left & mask
                left = ((left + hit) | (left - hit)) & full
            best = max(best, 2.0 * (n - left.bit_count()) / (n + len(window)))
        return best

    def ratio(a, b):
        if a is None:
            return 1.0 if b == "" else None
        if b is None:
            return 0.0 if a == "" else None
        short, long = (b, a) if len(a) > len(b) else (a, b)
        if not short:
            return 0.0 if long else 1.0
        forward = best_window(short, long)
        return forward if len(short) < len(long) else max(forward, best_window(long, short))

    return ratio


def partial_ratio(a: Column, b: Column) -> Column:
    """Best indel ratio of the shorter string in a window of the longer one.

    Strings of equal length are tried both ways. Two empty strings score 1, an
    empty and a non-empty one 0.
    """
    return F.udf(_window_ratio(), "double")(a, b)
