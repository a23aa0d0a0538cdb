"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. The leaves of its tree hold rank and position of each adjacent pair, so the root is
the leftmost pair of lowest rank; merging it changes three leaves, and their paths to the root are mended, until
no pair can be merged. Short words are merged many at once, each numpy step being one merge in every word; long
ones one by one.
"""

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablekeep.llm.common import text_columns

NONE = np.iinfo(np.int32).max
#: Bits of a leaf that hold the position, in trees of short words.
AT = 6
#: Words of more symbols than this are merged one by one.
SHORT = 32
#: Text that is encoded at once: words that it repeats are merged once.
PIECE_BYTES = 2 << 20
#: White space of Unicode.
_SPACE = "\t-\r \x85\xa0  -     　"
_GAPS = regex.compile(f"[{_SPACE}]+")
#: Separators of str.split that are not white space of Unicode.
_ODD = regex.compile("[\x1c-\x1f]")

COLUMNS = {
    "n_tokens": "bigint",
    "ids": "binary",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


#: First and last letters and numbers that the library's tables have beyond those of Unicode 15.1.
_KNOWN = [
    (0x1C8A, 0x1C8A), (0xA7CD, 0xA7CD), (0xA7DB, 0xA7DB), (0x105C0, 0x105F3), (0x10D40, 0x10D4F), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79),
    (0x16FF4, 0x16FF6), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
#: Capital letters beyond Unicode 15.1 with their small ones, and rows of such letters.
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITAL = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")


@lru_cache(maxsize=1)
def _newer() -> regex.Pattern:
    """Characters that ``regex`` takes for letters or numbers and the library does not know yet."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    known = {c for a, b in _KNOWN for c in range(a, b + 1)}
    codes = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    first = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    last = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True))
    return regex.compile(f"[{ranges}]" if ranges else r"(?!)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordBpe:
    """A vocabulary of the kind NFC, one space, lower case, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.splitter = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        )
        chars = byte_characters()
        self.inner = np.array([self.vocab.get(c, -1) for c in chars])
        self.final = np.array([self.vocab.get(c + suffix, -1) for c in chars])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self.complete = bool((self.inner >= 0).all() and (self.final >= 0).all())
        size = 1 + max(self.tokens)
        spelled = [self.tokens.get(i, "").encode("utf-8") + b" " for i in range(size)]
        self.widths = np.array([len(x) for x in spelled])
        self.places = np.cumsum(self.widths) - self.widths
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    # one word ---------------------------------------------------------------------------------

    def merge_long(self, symbols: list[int]) -> list[int]:
        """Merge one word of any length; each merge costs a path to the root."""
        n = len(symbols)
        leaves = 1 << max(1, (n - 1).bit_length())
        rank_of, merged = self.rank_of, self.merged
        none = 1 << 62

        def leaf(a: int, b: int, at: int) -> int:
            rank = rank_of.get(symbols[a] << 32 | symbols[b])
            return none if rank is None else rank << 32 | at

        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1, i)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            i = leaves + at
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        alive = [True] * n
        while tree[1] < none:
            at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[at]
            symbols[at] = int(merged[rank])
            alive[gone] = False
            after[at] = far = after[gone]
            put(gone, none)
            if far < n:
                before[far] = at
                put(at, leaf(at, far, at))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], leaf(before[at], at, before[at]))
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    # many words of up to SHORT symbols ----------------------------------------------------------

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.ranks[found] << AT | at, NONE)

    def merge_many(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words given as rows of symbols, padded with -1: all ids in a row, and how many per word."""
        rows, width = symbols.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        tree = np.full((rows, 2 * leaves), NONE, dtype=np.int32)
        if width > 1:
            pair = np.where(
                symbols[:, 1:] >= 0,
                self._leaf(symbols[:, :-1], np.maximum(symbols[:, 1:], 0), np.arange(width - 1)[None, :]),
                NONE,
            )
            tree[:, leaves : leaves + width - 1] = pair
        for i in range(leaves - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        padded = np.concatenate([symbols, np.full((rows, 1), -1)], axis=1)
        live = np.flatnonzero(tree[:, 1] < NONE)

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            i = leaves + at
            tree[row, i] = value
            while leaves > 1 and i.size and i[0] > 1:
                i = i >> 1
                tree[row, i] = np.minimum(tree[row, 2 * i], tree[row, 2 * i + 1])

        while live.size:
            root = tree[live, 1]
            at = root & ((1 << AT) - 1)
            gone = after[live, at]
            far = after[live, gone]
            padded[live, at] = self.merged[root >> AT]
            padded[live, gone] = -1
            after[live, at] = far
            put(live, gone, np.full(live.size, NONE))
            there = far < sizes[live]
            before[live[there], far[there]] = at[there]
            right = np.where(there, padded[live, np.minimum(far, width)], 0)
            put(live, at, np.where(there, self._leaf(padded[live, at], right, at), NONE))
            left = before[live, at]
            inner = left >= 0
            row, left = live[inner], left[inner]
            put(row, left, self._leaf(padded[row, left], padded[row, at[inner]], left))
            live = live[tree[live, 1] < NONE]
        kept = padded[:, :width] >= 0
        return padded[:, :width][kept], kept.sum(axis=1)

    def encode_pieces(self, pieces: list[str]) -> "Ragged":
        """Ids of each piece."""
        if not pieces:
            return Ragged(*[np.empty(0, dtype=np.int64)] * 3)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        order = np.argsort(sizes, kind="stable")
        long = order[sizes[order] > SHORT] if self.complete else order
        order = order[: len(order) - len(long)]
        groups, ids, counts = [], [], []
        for start in range(0, len(order), 16384):
            rows = order[start : start + 16384]
            width = int(sizes[rows[-1]])
            table = np.full((len(rows), width), -1, dtype=np.int64)
            within = np.arange(width)[None, :] < sizes[rows][:, None]
            table[within] = symbols[((ends - sizes)[rows][:, None] + np.arange(width)[None, :])[within]]
            merged, count = self.merge_many(table, sizes[rows])
            ids.append(merged)
            counts.append(count)
            groups.append(rows)
        for row in long.tolist():
            known = symbols[ends[row] - sizes[row] : ends[row]]
            merged = self.merge_long(known[known >= 0].tolist())
            ids.append(np.array(merged, dtype=np.int64))
            counts.append(np.array([len(merged)]))
            groups.append(np.array([row]))
        ids, counts, groups = np.concatenate(ids), np.concatenate(counts), np.concatenate(groups)
        at = np.empty(len(pieces), dtype=np.int64)
        size = np.empty(len(pieces), dtype=np.int64)
        size[groups] = counts
        at[groups] = np.cumsum(counts) - counts
        return Ragged(ids, at, size)

    def _decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the tokens, each followed by a space, and how many each token has."""
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        source = np.arange(int(ends[-1]) if len(ends) else 0)
        source += np.repeat(self.places[ids] - (ends - widths), widths)
        return self.spelled[source].tobytes(), widths

    # texts --------------------------------------------------------------------------------------

    def _chunks(self, text: str) -> list[str]:
        """Words between white space of a normalised text."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _CAPITAL.search(text):
                text = text.translate(_SMALL)
        text = text.lower()
        return [c for c in _GAPS.split(text) if c] if _ODD.search(text) else text.split()

    def split(self, text: str) -> list[str]:
        """Special tokens, marked by a leading space, and words in the order of the text."""
        if "<|" not in text:
            return self._chunks(text)
        out = []
        for part in self.splitter.split(text):
            out += [f" {part}"] if part in self.special else self._chunks(part)
        return out

    def _pieces(self, word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if word[-1] in ",." and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        if word.isascii() or not _newer().search(word):
            return self.pieces.findall(word)
        # a character that is nothing to the pattern stands for each of them
        return [word[slice(*m.span())] for m in self.pieces.finditer(_newer().sub("\ufdd0", word))]

    def encode_words(self, words: list[str]) -> "Ragged":
        """Ids of each word or marked special token; pieces shared by words are merged once."""
        numbers = {f" {t}": n for n, t in enumerate(self.special)}
        known, of_words, counts = dict(numbers), [], []
        for word in words:
            pieces = (word,) if word[0] == " " else self._pieces(word)
            counts.append(len(pieces))
            of_words += [known.setdefault(p, len(known)) for p in pieces]
        found = self.encode_pieces(list(known)[len(numbers) :])
        special = Ragged(
            np.array([*self.special.values()], dtype=np.int64),
            np.arange(len(numbers)),
            np.ones(len(numbers), dtype=np.int64),
        )
        return special.followed_by(found).take(np.array(of_words, dtype=np.int64), np.array(counts, dtype=np.int64))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as a vocabulary without a decoder gives them."""
        spelled, _ = self._decoded(np.frombuffer(ids, dtype="<u4").astype(np.int64))
        return spelled[:-1].decode("utf-8")

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of each text and the UTF-8 bytes of what they decode to."""
        split = [self.split(t) for t in texts]
        every = pa.array(chain.from_iterable(split), type=pa.large_string()).dictionary_encode()
        words = self.encode_words(every.dictionary.to_pylist())
        use = every.indices.to_numpy().astype(np.int64)
        found = words.take(use, np.array([len(s) for s in split], dtype=np.int64))
        out = []
        for at, size in zip(found.at.tolist(), found.size.tolist(), strict=True):
            ids = found.flat[at : at + size]
            out.append((ids.astype("<u4").tobytes(), self._decoded(ids)[0][:-1]))
        return out


class Ragged:
    """Lists of numbers in one array, with the place and size of each."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.flat, self.at, self.size = flat, at, size

    def followed_by(self, other: "Ragged") -> "Ragged":
        return Ragged(
            np.concatenate([self.flat, other.flat]),
            np.concatenate([self.at, other.at + len(self.flat)]),
            np.concatenate([self.size, other.size]),
        )

    def take(self, order: np.ndarray, counts: np.ndarray) -> "Ragged":
        """Lists joined from the lists ``order``, ``counts`` of them for each."""
        sizes = self.size[order]
        ends = np.cumsum(sizes)
        source = np.arange(int(ends[-1]) if len(ends) else 0)
        source += np.repeat(self.at[order] - (ends - sizes), sizes)
        before = np.concatenate([[0], ends])
        last = np.cumsum(counts).astype(np.int64)
        at = before[last - counts]
        return Ragged(self.flat[source], at, before[last] - at)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encoder(path: str, outputs: tuple[str, ...]):
    def make():
        bpe = load(path)

        def compute(texts: list) -> list[list]:
            found = bpe.encode_batch([t or "" for t in texts])
            give = {
                "n_tokens": lambda x: len(x[0]) // 4,
                "ids": lambda x: x[0],
                "decoded": lambda x: x[1].decode("utf-8"),
                "ids_sha256": lambda x: hashlib.sha256(x[0]).hexdigest(),
                "decoded_sha256": lambda x: hashlib.sha256(x[1]).hexdigest(),
            }
            return [[give[o](x) for x in found] for o in outputs]

        return compute

    return make


def encode(
    docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with the chosen ``outputs`` of COLUMNS for its texts.

    ``path`` names a vocabulary file that every executor has. ``ids`` are little-endian unsigned 32-bit numbers.
    Special tokens standing in a text become their ids, and none are added. A null text counts as empty: no
    tokens. Existing columns of the same names are replaced.
    """
    fields = ", ".join(f"{o} {COLUMNS[o]}" for o in outputs)
    return text_columns(docs, fields, _encoder(path, outputs), drop=drop, piece_bytes=PIECE_BYTES)
