"""Phrase collocations, counted in burst tries whose subtrees are spilled as sorted runs.

1. Words are counted per language, then pairs of frequent words by the steps below, then longer phrases. A phrase can
   only be frequent if all its words and pairs are, so bit sets of fixed size of the frequent words and pairs tell
   tasks where phrases end; a false positive costs work, never a result.
2. A task puts the windows of two, or up to LONGEST, words that start at each word into a trie of word numbers. Its
   upper nodes are language and first word; below stand hash containers of the rest of the windows with their counts.
   A container of more than BURST windows bursts into a node with one container per next word. A trie of more than
   TRIE_WINDOWS windows is spilled: every subtree of a language and two words is written in sorted order to the run
   of its prefix partition, which carries its own small dictionary.
3. A spill goes to FAN partitions at most. Where more are needed, the runs of one are merged and split again, so a run
   stays long and its dictionary small, however many partitions there are.
4. The runs of a prefix partition are merged level by level: windows that share their first d words are one phrase of
   d words, and windows whose prefix is too rare leave the merge. A partition that one frequent pair of words makes
   too large for a task is not merged there; its phrases are summed up by an aggregate over phrases instead.
5. Scores, containment and ranks are joins over the frequent phrases.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekeep.llm.common import ship_package, staged
from tablekeep.llm.words import arrow_schema, flat, pieces, split

LONGEST = 5
#: Language of texts without one.
UNKNOWN = "und"
#: Bytes that end a piece, and bytes that only separate words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Bytes of texts that are cut into words together.
PIECE_BYTES = 1 << 20
#: Bits of the filters of frequent words and pairs: two megabytes each.
FILTER_BITS = 1 << 24
#: Factors and modulus of the hash of a pair.
_LANG, _FIRST, _SECOND, _PRIME = 268_435_399, 402_653_189, 536_870_909, 2_147_483_629
#: Distinct words a task counts before it hands them on.
COUNTED_WORDS = 1 << 19
#: Windows of a container and of a trie, windows of the corpus for each prefix partition, and distinct ones of it at most.
BURST = 1 << 13
TRIE_WINDOWS = 1 << 18
PARTITION_WINDOWS = 1 << 19
LARGEST_PARTITION = 1 << 20
#: Partitions that a spill, or a partition that is split again, is dealt to, and windows that are merged before that.
FAN = 128
MERGED_WINDOWS = 1 << 20

_BIG = np.dtype(">i4")
_ENDS = np.zeros(256, dtype=bool)
_ENDS[np.frombuffer(PIECE_ENDS, dtype=np.uint8)] = True


def _tokens(batch: pa.RecordBatch):
    """Words of a batch of (lang, text): the words, language number of each, whether it begins a piece, languages."""
    langs = pc.fill_null(batch.column(0), UNKNOWN).dictionary_encode()
    data, offsets = flat(batch.column(1), lower=True)
    words = split(data, offsets, PIECE_ENDS + BLANKS)
    owner = np.repeat(np.arange(len(words.first)), words.last - words.first)
    begins = np.ones(len(words.ids), dtype=bool)
    if len(owner):
        cuts = np.append(0, np.cumsum(_ENDS[data]))[words.begin]
        begins[1:] = (owner[1:] != owner[:-1]) | (cuts[1:] != cuts[:-1])
    lang = langs.indices.to_numpy(zero_copy_only=False)[owner] if len(owner) else owner
    return words, lang, begins, langs.dictionary.to_pylist()


def _word_counts(batches):
    """lang, word and n of the words of a task; the row of the null word counts all of a language."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        table = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")])
        return table.select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"])

    for piece in pieces(batches, PIECE_BYTES):
        words, lang, _, langs = _tokens(piece)
        size = max(1, len(words.names))
        keys, counts = np.unique(lang.astype(np.int64) * size + words.ids, return_counts=True)
        totals = np.bincount(lang, minlength=len(langs))
        names = pa.array(langs, type=pa.string())
        held.append(
            pa.table({
                "lang": pa.concat_arrays([names.take(pa.array(keys // size)), names]),
                "word": pa.concat_arrays([words.names.take(pa.array(keys % size)).cast(pa.string()), pa.nulls(len(langs), pa.string())]),
                "n": pa.array(np.append(counts, totals).astype(np.int64)),
            })
        )
        if sum(len(t) for t in held) > COUNTED_WORDS:
            held = [merged()]
            if len(held[0]) > COUNTED_WORDS // 2:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from merged().combine_chunks().to_batches()


def _slots(langs: list[bytes], words: list[bytes], langs_of: list[int], words_of: list[int]) -> np.ndarray:
    """Bits of the filter of frequent words, for pairs of places in both lists."""
    seeds = [zlib.crc32(lang + b"\0") for lang in langs]
    crc = zlib.crc32
    return np.array([crc(words[w], seeds[k]) for k, w in zip(langs_of, words_of, strict=True)], dtype=np.int64) % FILTER_BITS


class Trie:
    """Burst trie of windows: arrays of word numbers, 0 behind the end of a piece.

    An inner node is a dict from a word number to what stands below; a container is a dict from the packed rest of a
    window to its count, marked by the class Leaf.
    """

    class Leaf(dict):
        __slots__ = ()

    def __init__(self):
        self.root: dict = {}
        self.size = 0

    def add(self, windows: np.ndarray) -> None:
        """Windows as rows: language, then words; the last columns may be 0."""
        if not len(windows):
            return
        key = windows[:, 0].astype(np.int64) << 32 | windows[:, 1]
        windows = windows[np.argsort(key, kind="stable")]
        edges = np.flatnonzero((windows[1:, :2] != windows[:-1, :2]).any(axis=1)) + 1
        bounds = [0, *edges.tolist(), len(windows)]
        heads = windows[bounds[:-1], :2].tolist()
        tails = _packed(windows[:, 2:])
        for (lang, word), low, high in zip(heads, bounds[:-1], bounds[1:], strict=True):
            below = self.root.setdefault(lang, {})
            below[word] = self._insert(below.get(word), tails[low:high])

    def _insert(self, node, tails: list[bytes]):
        """The node with the tails counted; a container that grows too large comes back burst."""
        if node is None:
            node = self.Leaf()
        if isinstance(node, self.Leaf):
            before, get = len(node), node.get
            for tail in tails:
                node[tail] = get(tail, 0) + 1
            self.size += len(node) - before
            return self._burst(node) if len(node) > BURST and len(tails[0]) > 4 else node
        groups: dict[bytes, list[bytes]] = {}
        for tail in tails:
            groups.setdefault(tail[:4], []).append(tail[4:])
        for word, rest in groups.items():
            number = int.from_bytes(word, "big")
            node[number] = self._insert(node.get(number), rest)
        return node

    def _burst(self, leaf: "Trie.Leaf") -> dict:
        node: dict = {}
        for tail, count in leaf.items():
            node.setdefault(int.from_bytes(tail[:4], "big"), self.Leaf())[tail[4:]] = count
        return node

    def subtrees(self):
        """All windows and counts, subtree after subtree in sorted order."""
        yield from self._walk(self.root, b"")

    def _walk(self, node, prefix: bytes):
        if isinstance(node, self.Leaf):
            tails = sorted(node)
            yield [prefix + tail for tail in tails], [node[tail] for tail in tails]
            return
        for word in sorted(node):
            yield from self._walk(node[word], prefix + word.to_bytes(4, "big"))


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row of numbers as bytes that sort like the row."""
    rows = np.ascontiguousarray(rows, dtype=_BIG)
    return rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel().tolist()


def _spilled(trie: Trie, names: list[bytes], partitions: int, schema: pa.Schema) -> pa.RecordBatch:
    """The runs of a trie, whose word number n is names[n]."""
    keys, counts = [], []
    for some, n in trie.subtrees():
        keys += some
        counts += n
    windows = np.frombuffer(b"".join(keys), dtype=_BIG).reshape(len(keys), -1).astype(np.int32)
    del keys
    # numbers in the order of the words, so that runs of all tasks are sorted alike
    order = sorted(range(1, len(names)), key=names.__getitem__)
    place = np.zeros(len(names), dtype=np.int32)
    place[order] = np.arange(1, len(names))
    return _runs(place[windows].T, np.array(counts, dtype=np.int64), [names[i] for i in order], partitions, schema)


def _runs(windows: np.ndarray, counts: np.ndarray, names: list[bytes], partitions: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row per prefix partition: its number, windows, and the packed run: words, then sorted windows with counts.

    ``windows`` has a row per level, ``names[n - 1]`` is word n and names are sorted. Equal windows are added up.
    """
    code = np.array([0, *[zlib.crc32(w) for w in names]], dtype=np.uint64)
    mixed = (code[windows[0]] * np.uint64(31) + code[windows[1]]) * np.uint64(0x9E3779B97F4A7C15) + code[windows[2]]
    # ranges of a hash: a partition of few is a row of neighbouring partitions of many
    part = ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) * partitions >> 31
    order = np.lexsort((*windows[::-1], part))
    windows, part, counts = windows[:, order], part[order], counts[order]
    heads = np.flatnonzero(np.append(True, (windows[:, 1:] != windows[:, :-1]).any(axis=0)))
    windows, part, counts = windows[:, heads], part[heads], np.add.reduceat(counts, heads)
    bounds = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    rows: dict[str, list] = {f.name: [] for f in schema}
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        used, local = np.unique(windows[:, low:high], return_inverse=True)
        local = local.reshape(len(windows), -1) + int(used[0] != 0)
        own = b"\n".join([names[i - 1] for i in used.tolist() if i])
        # columns one after the other: sorted and small numbers pack well
        kind = np.dtype(np.uint16 if len(used) < 1 << 16 else np.uint32)
        head = np.array([len(own), len(windows), kind.itemsize], dtype=np.int64).tobytes()
        raw = head + own + local.astype(kind).tobytes() + counts[low:high].tobytes()
        rows["part"].append(int(part[low]))
        rows["windows"].append(high - low)
        rows["size"].append(len(raw))
        rows["run"].append(pa.compress(raw, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def _read_run(windows: int, size: int, run: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Windows with a row per level, counts, and the words from number 1 on."""
    raw = pa.decompress(run, size, codec="zstd", asbytes=True)
    length, levels, width = np.frombuffer(raw, dtype=np.int64, count=3).tolist()
    end = 24 + length
    rows = np.frombuffer(raw, dtype=f"u{width}", count=windows * levels, offset=end).reshape(levels, windows)
    return rows, np.frombuffer(raw, dtype=np.int64, offset=size - 8 * windows), raw[24:end].split(b"\n")


def _together(runs: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Packed runs (windows, size, run) as one: windows, counts and sorted words."""
    total = sum(n for n, _, _ in runs)
    names = sorted({w for n, size, run in runs for w in _read_run(n, size, run)[2]})
    numbers = {w: i + 1 for i, w in enumerate(names)}
    levels = len(_read_run(*runs[0])[0])
    windows, counts, at = np.empty((levels, total), dtype=np.int32), np.empty(total, dtype=np.int64), 0
    for n, size, run in runs:
        rows, own, some = _read_run(n, size, run)
        windows[:, at : at + n] = np.array([0, *[numbers[w] for w in some]], dtype=np.int32)[rows]
        counts[at : at + n] = own
        at += n
    return windows, counts, names


def _packed_runs(batch) -> list[tuple[int, int, bytes]]:
    return list(zip(*[batch.column(c).to_pylist() for c in ("windows", "size", "run")], strict=True))


def _phrases(columns: np.ndarray, counts: np.ndarray, size: int, least: int):
    """(words, one window of each phrase, its count) for 2 words on, of phrases that occur ``least`` times or more.

    Level by level: windows of equal prefix get equal numbers, and those of a rare prefix leave.
    """
    prefix = columns[0].astype(np.int64)
    for depth in range(1, len(columns)):
        inside = columns[depth] > 0
        columns, counts, prefix = columns[:, inside], counts[inside], prefix[inside]
        if not len(prefix):
            return
        key = prefix * size + columns[depth]
        order = np.argsort(key, kind="stable")
        key, columns, counts = key[order], columns[:, order], counts[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sums = np.add.reduceat(counts, heads)
        good = sums >= (least if depth > 1 else 1)
        if depth > 1:
            yield depth, columns[:, heads[good]], sums[good]
        sizes = np.diff(np.append(heads, len(key)))
        prefix = np.repeat(np.arange(len(heads)), sizes)
        keep = np.repeat(good, sizes)
        columns, counts, prefix = columns[:, keep], counts[keep], prefix[keep]


_COUNTS = "lang string, phrase string, words int, n bigint"
_RUNS = "part int, windows bigint, size bigint, run binary"


def _count_batch(columns: np.ndarray, counts: np.ndarray, names: list[bytes], least: int) -> pa.RecordBatch:
    """lang, phrase, words and n of every phrase of the windows; names[0] has number 1."""
    langs, phrases, depths, sums = [], [], [], []
    for depth, rows, n in _phrases(columns, counts, len(names) + 1, least):
        for row in rows[: depth + 1].T.tolist():
            langs.append(bytes.fromhex(names[row[0] - 1][1:].decode()).decode())
            phrases.append(b" ".join([names[i - 1] for i in row[1:]]).decode())
        depths += [depth] * len(n)
        sums += n.tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(depths, pa.int32()), pa.array(sums, pa.int64())],
        names=["lang", "phrase", "words", "n"],
    )


def _merged_in_portions(least: int):
    """Task side of merging runs sorted by partition: counts, and whether they are of a portion of a partition only."""

    def counted(held: list, portion: bool) -> pa.RecordBatch:
        batch = _count_batch(*_together(held), 1 if portion else least)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([portion] * batch.num_rows, pa.bool_())], names=[*batch.schema.names, "portion"])

    def run(batches):
        part, held, size, first = None, [], 0, True
        for batch in batches:
            for number, packed in zip(batch.column("part").to_pylist(), _packed_runs(batch), strict=True):
                if held and (number != part or size + packed[0] > 2 * LARGEST_PARTITION):
                    yield counted(held, number == part or not first)
                    first, held, size = number != part, [], 0
                part, size = number, size + packed[0]
                held.append(packed)
        if held:
            yield counted(held, not first)

    return run


def _bit_set(slots: DataFrame) -> np.ndarray:
    """Bits of the column ``slot``, as words of 32 bits; not more than FILTER_BITS come to the driver."""
    rows = (
        slots.select(F.shiftright("slot", 5).cast("int").alias("at"), F.expr("shiftleft(1L, cast(slot & 31 as int))").alias("bits"))
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table


def _bytes(column: str):
    return F.encode(column, "utf-8")


def _filler(words, pairs, longest: int, partitions: int, schema: pa.Schema):
    """Task side of counting: the runs of all windows of ``longest`` words, or of three and more if ``pairs`` is given."""

    def run(batches):
        trie, numbers, names = Trie(), {}, [b""]

        def number(name: bytes) -> int:
            if name not in numbers:
                numbers[name] = len(names)
                names.append(name)
            return numbers[name]

        for piece in pieces(batches, PIECE_BYTES):
            tokens, lang, begins, langs = _tokens(piece)
            if len(tokens.ids) < 2:
                continue
            own = tokens.names.to_pylist()
            known = [name.encode() for name in langs]
            ids = np.zeros((len(langs), len(own)), dtype=np.int32)
            distinct = np.unique(lang.astype(np.int64) * len(own) + tokens.ids)
            langs_of, words_of = distinct // len(own), distinct % len(own)
            slots = _slots(known, own, langs_of.tolist(), words_of.tolist())
            frequent = words.value[slots >> 5] >> (slots & 31) & 1 == 1
            langs_of, words_of = langs_of[frequent], words_of[frequent]
            ids[langs_of, words_of] = [number(own[w]) for w in words_of.tolist()]
            # a blank in front tells languages from words, and hexadecimal digits hold no line feed
            heads = np.array([number(b" " + name.hex().encode()) for name in known], dtype=np.int32)
            coded = ids[lang, tokens.ids]
            # whether a word and the next one can stand in one phrase
            tied = (coded[:-1] > 0) & (coded[1:] > 0) & ~begins[1:]
            if pairs is not None:
                code = np.array([zlib.crc32(w) for w in own], dtype=np.int64)[tokens.ids]
                langs_code = np.array([zlib.crc32(name) for name in known], dtype=np.int64)[lang]
                slot = (langs_code[:-1] * _LANG + code[:-1] * _FIRST + code[1:] * _SECOND) % _PRIME % FILTER_BITS
                tied &= pairs.value[slot >> 5] >> (slot & 31) & 1 == 1
            starts = np.flatnonzero(tied if pairs is None else tied[:-1] & tied[1:])
            windows = np.zeros((len(starts), longest + 1), dtype=np.int32)
            windows[:, 0], windows[:, 1] = heads[lang[starts]], coded[starts]
            tied = np.append(tied, np.zeros(longest, dtype=bool))
            padded = np.append(coded, np.zeros(longest, dtype=np.int32))
            going = np.ones(len(starts), dtype=bool)
            for d in range(1, longest):
                going &= tied[starts + d - 1]
                windows[:, d + 1] = np.where(going, padded[starts + d], 0)
            trie.add(windows)
            if trie.size > TRIE_WINDOWS:
                yield _spilled(trie, names, partitions, schema)
                trie, numbers, names = Trie(), {}, [b""]
        if trie.size:
            yield _spilled(trie, names, partitions, schema)

    return run


def _counted(texts: DataFrame, longest: int, words, pairs, windows: int, least: int) -> DataFrame:
    """Phrases of two words, or of three to ``longest`` with ``pairs``, that occur ``least`` times or more.

    ``windows`` is how many there are to count; it only says how many partitions they are dealt to.
    """
    spark = texts.sparkSession
    # a spill holds a pair once, however often it was met, so partitions of pairs stay smaller than what was counted into them
    entry = PARTITION_WINDOWS * (LONGEST + 1) // (longest + 1) * (2 if pairs is None else 1)
    wide = max(1, windows // entry)
    partitions = min(wide, FAN)
    schema = arrow_schema(_RUNS)

    def split_again(partitions: int):
        def run(batches):
            held: dict[int, list[tuple[int, int, bytes]]] = {}
            size = 0
            for batch in batches:
                for part, packed in zip(batch.column("part").to_pylist(), _packed_runs(batch), strict=True):
                    held.setdefault(part, []).append(packed)
                    size += packed[0]
                    if size > MERGED_WINDOWS:
                        for some in held.values():
                            yield _runs(*_together(some), partitions, schema)
                        held, size = {}, 0
            for some in held.values():
                yield _runs(*_together(some), partitions, schema)

        return run

    runs = texts.mapInArrow(_filler(words, pairs, longest, partitions, schema), _RUNS)
    while partitions < wide:
        # runs of one partition meet in a few tasks, so one that holds much is no single task's work
        tasks = max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
        partitions *= min(FAN, -(-wide // partitions))
        runs = runs.repartition(tasks, "part", F.pmod(F.xxhash64("run"), F.lit(4))).mapInArrow(split_again(partitions), _RUNS)
    if pairs is None:
        # a pair of words is in a run once, so none makes its partition large: runs are merged as they arrive and not written before
        found = staged(runs.repartition("part").sortWithinPartitions("part").mapInArrow(_merged_in_portions(least), f"{_COUNTS}, portion boolean"), "phrases")
        whole, portions = found.filter("NOT portion").drop("portion"), found.filter("portion")
        return whole.union(portions.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    runs = staged(runs, "runs")

    def merge(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_count_batch(*_together(_packed_runs(group)), least)])

    def unfold(batches):
        for batch in batches:
            for packed in _packed_runs(batch):
                yield _count_batch(*_read_run(*packed), 1)

    weights = runs.groupBy("part").agg(F.sum("windows").alias("weight"))
    large = weights.filter(F.col("weight") > LARGEST_PARTITION * (LONGEST + 1) // (longest + 1)).select("part")
    if large.isEmpty():
        found = runs.groupBy("part").applyInArrow(merge, _COUNTS)
    else:
        spread = runs.join(large, "part", "left_semi").mapInArrow(unfold, _COUNTS)
        spread = spread.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        found = runs.join(large, "part", "left_anti").groupBy("part").applyInArrow(merge, _COUNTS).union(spread)
    return staged(found.filter("words > 2"), "phrases")


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of one to LONGEST words that occur ``least`` times or more, and of all words, per language.

    The first has lang, phrase, words and n, the second lang and total. Both are written to the shared folder.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    counted = texts.mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = staged(counted.filter(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = counted.filter("word is null").select("lang", F.col("n").alias("total"))
    words = counted.filter("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    slot = F.crc32(F.concat(_bytes("lang"), F.lit(b"\0"), _bytes("phrase"))) % FILTER_BITS
    known = spark.sparkContext.broadcast(_bit_set(words.select(slot.alias("slot"))))
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first().n
    two = _counted(texts, 2, known, None, total, least)

    word = [F.crc32(F.encode(F.split("phrase", " ")[i], "utf-8")) for i in (0, 1)]
    slot = (F.crc32(_bytes("lang")) * _LANG + word[0] * _FIRST + word[1] * _SECOND) % _PRIME % FILTER_BITS
    tied = spark.sparkContext.broadcast(_bit_set(two.select(slot.alias("slot"))))
    total = two.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    more = _counted(texts, LONGEST, known, tied, total, least)
    return words.union(two).union(more), totals


def _part(phrase: str, start, length):
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100) -> DataFrame:
    """The ``top`` best phrases of two to LONGEST words of every language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts are cut into pieces at ``.,;:!?`` and line breaks and pieces into words at blanks and
    tabs. A phrase is a candidate if it occurs ``least`` times (a) in its language. Cut after its k-th word it has the
    score floor(1000 a n / (l r)), with n words in the language and l and r the counts of the parts; the lowest counts,
    of equal ones the smallest k. A candidate that stands inside a longer one that occurs at least ``share`` percent as
    often is dropped. Ranks go by score and a, greatest first, then by the bytes of the phrase.

    A null language is UNKNOWN and shares its rows; null and empty texts have no words; repeated rows count each.
    Columns other than lang and text are not read. Without candidates the result is empty.
    """
    counts, totals = phrase_counts(docs, least)
    candidates = counts.filter("words > 1")
    cuts = candidates.select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select("*", _part("phrase", F.lit(1), F.col("k")).alias("left"), _part("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    # of the parts only those that are looked up meet the cuts
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    wide = "decimal(19,0)"
    score = F.expr(f"cast(1000 * a as {wide}) * cast(total as {wide}) div (cast(l as {wide}) * cast(r as {wide}))").cast("long")
    lowest = (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("x"))
        .select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    )
    inner = candidates.filter("words > 2").select(
        "lang",
        "n",
        F.explode(F.expr(
            "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> "
            "array_join(slice(split(phrase, ' '), i, m), ' '))))"
        )).alias("phrase"),
    )
    around = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
