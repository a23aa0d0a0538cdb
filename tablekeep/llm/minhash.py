"""Document fingerprints by MinHash, and near duplicates by bands of them.

A text is the set of its shingles: WORDS neighbouring words, A-Z in lower case; a text of fewer words is one shingle.
Each of PERMUTATIONS universal hash functions, h(x) = ((a x + b) mod 2^64) >> 32 with odd a, keeps its least value over
the shingles. Two texts agree on one with the probability of their Jaccard similarity, so the share of equal values
estimates it. A fingerprint holds the lower 16 bits of every value.

Near duplicates: a signature is cut into BANDS bands, and texts that agree on a band share a bucket. A bucket never
becomes rows of pairs: its members are compared with one of them, by the exact Jaccard similarity of their shingles: the
one that meets most others over all its buckets, as an original does.
Members that are not like it go on in a smaller bucket with a member of their own, as long as a round settles a tenth
of what it asks and leaves a bucket that is more than one task's work. Buckets that still hold two classes are then
compared in blocks inside tasks, which give links only, so no link of two texts that share a bucket is lost. Texts of
exactly THRESHOLD share a bucket with probability 0.95, more alike ones nearly always.
"""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekeep.llm.common import ship_package, staged
from tablekeep.llm.jaccard_join import components
from tablekeep.llm.words import arrow_schema, flat, pieces, split

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 8, 16
PERMUTATIONS = ROWS * BANDS
#: Bytes of texts that are signed together.
PIECE_BYTES = 1 << 20
#: Bits of the filter that says which texts share a bucket or a class with others.
FILTER_BITS = 1 << 23
#: Texts, and bytes of texts, of a block of a bucket: a task compares two blocks at a time.
BLOCK = 512
BLOCK_BYTES = 8 << 20

_RANDOM = random.Random(13)
_A = [np.uint64(_RANDOM.getrandbits(64) | 1) for _ in range(PERMUTATIONS)]
_B = [np.uint64(_RANDOM.getrandbits(64)) for _ in range(PERMUTATIONS)]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(32)

FIELDS = (
    "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, "
    "near_next double, text_id bigint, bands array<bigint>"
)
_NAMES = [field.split()[0] for field in FIELDS.split(", ")]
_PRINTS = ("fingerprint", "edited_fingerprint")


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    return values ^ (values >> np.uint64(29))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, and the offsets of the texts among them."""
    words = split(*flat(column, lower=True))
    counts = words.last - words.first
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    offsets = np.append(0, np.cumsum(sizes))
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in words.names.to_pylist()], dtype=np.uint64)
    codes = names[words.ids] if len(names) else names
    rolled = np.zeros(len(codes), dtype=np.uint64)
    whole = max(0, len(codes) - WORDS + 1)
    for i in range(WORDS):
        rolled[:whole] = _mixed(rolled[:whole] ^ codes[i : whole + i])
    valid = np.repeat(words.first - offsets[:-1], sizes) + np.arange(offsets[-1])
    values = rolled[valid]
    for k in np.flatnonzero((counts > 0) & (counts < WORDS)).tolist():
        value = np.array([counts[k]], dtype=np.uint64)
        for code in codes[words.first[k] : words.last[k]]:
            value = _mixed(value ^ code)
        values[offsets[k]] = value[0]
    return values, offsets


def signatures(column: pa.Array) -> np.ndarray:
    """One row per text: the least value of every permutation, the greatest number for a text without words."""
    values, offsets = shingles(column)
    out = np.full((len(column), PERMUTATIONS), 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        values, starts = values >> _HIGH, offsets[:-1][filled]
        for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
            out[filled, k] = np.minimum.reduceat((values * a + b) >> _HIGH, starts)
    return out


def prints(signed: np.ndarray) -> list[bytes]:
    """Two bytes a permutation, the higher one first."""
    return [row.tobytes() for row in signed.astype(np.uint16).astype(">u2")]


def likeness(one: np.ndarray, other: np.ndarray) -> list[float]:
    """Share of equal values of the fingerprints in each row."""
    return (one.astype(np.uint16) == other.astype(np.uint16)).mean(axis=1).tolist()


def _bands(signed: np.ndarray) -> list[list[int]]:
    """A 64-bit key of every band; none for a text without words."""
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signed), 1))
    for row in range(ROWS):
        key = _mixed(key ^ signed[:, row::ROWS].astype(np.uint64))
    empty = (signed == 0xFFFFFFFF).all(axis=1).tolist()
    return [[] if none else row for row, none in zip(key.view(np.int64).tolist(), empty, strict=True)]


def _text_id(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _compared(texts: list[bytes], following: list[bytes]) -> list[list]:
    """FIELDS of texts whose next texts are ``following``."""
    edited, lengths = [], []
    for text, after in zip(texts, following, strict=True):
        own = text.decode("utf-8", "surrogatepass")
        cut = len(own) // 4
        lengths.append(len(own))
        edited.append((own[: len(own) - cut] + after.decode("utf-8", "surrogatepass")[:cut]).encode("utf-8", "surrogatepass"))
    # a text is mostly the one after its predecessor
    both = signatures(pa.array([*texts, following[-1]], type=pa.large_binary())) if texts else signatures(pa.array([], pa.large_binary()))
    shifted = all(a is b for a, b in zip(texts[1:], following, strict=False))
    own = both[:-1] if texts else both
    after = both[1:] if shifted else signatures(pa.array(following, type=pa.large_binary()))
    changed = signatures(pa.array(edited, type=pa.large_binary()))
    return [
        lengths,
        [hashlib.sha256(t).hexdigest() for t in edited],
        prints(own),
        prints(changed),
        likeness(own, changed),
        likeness(own, after[: len(own)]),
        [_text_id(t) for t in texts],
        _bands(own),
    ]


def _row_batch(values: dict, schema: pa.Schema) -> pa.RecordBatch:
    size = len(next(iter(values.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(values[f.name], type=f.type) if f.name in values else pa.nulls(size, f.type) for f in schema], schema=schema
    )


def compared_with_next(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and FIELDS, over whole texts; fingerprints as hexadecimal digits.

    The edited text has its last quarter (floor(n_chars / 4) code points) replaced by as much of the start of the next
    text, in the order of doc_id, null first; after the last comes the first. Rows that share an id stand in the order
    of a hash of their texts. ``near_edited`` and ``near_next`` are the likeness of the text's fingerprint to those of
    the edited and of the next text. ``bands`` are the keys by which near duplicates meet.

    Null and empty texts, and texts without words, have the fingerprint of the empty set, which is like itself only.
    Repeated rows are rows of their own. An empty table gives none. Columns other than doc_id and text are not read.

    Texts are sorted once, packed, by ranges of their ids; neighbours are compared in the task that holds them, and
    the first and the last text of every range meet in a second step.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "at"]
    packed_ddl = f"doc_id {id_type}, at bigint, packed binary"
    row_ddl, out_ddl = f"doc_id {id_type}, {FIELDS}, part int, edge int, packed binary", f"doc_id {id_type}, {FIELDS}"
    row_schema, out_schema = arrow_schema(row_ddl), arrow_schema(out_ddl)

    def pack(batches):
        for piece in pieces(batches, PIECE_BYTES):
            texts = [t or b"" for t in piece.column(2).cast(pa.binary()).to_pylist()]
            packed = pa.array([_pack(t) for t in texts], type=pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), packed], names=["doc_id", "at", "packed"])

    def walk(batches):
        part, held = TaskContext.get().partitionId(), None
        for piece in pieces(batches, PIECE_BYTES // 3):
            ids, blobs = piece.column(0).to_pylist(), piece.column(2).to_pylist()
            texts = [_unpack(b) for b in blobs]
            if held is None:
                yield _row_batch({"doc_id": ids[:1], "part": [part], "edge": [1], "packed": blobs[:1]}, row_schema)
            else:
                ids, blobs, texts = [held[0], *ids], [held[1], *blobs], [held[2], *texts]
            held = ids[-1], blobs[-1], texts[-1]
            if len(ids) > 1:
                found = dict(zip(_NAMES, _compared(texts[:-1], texts[1:]), strict=True))
                yield _row_batch({"doc_id": ids[:-1], "edge": [0] * (len(ids) - 1), **found}, row_schema)
        if held is not None:
            yield _row_batch({"doc_id": [held[0]], "part": [part], "edge": [2], "packed": [held[1]]}, row_schema)

    def meet(batches):
        for piece in pieces(batches, PIECE_BYTES // 3):
            texts, following = ([_unpack(b) for b in piece.column(i).to_pylist()] for i in (1, 2))
            found = dict(zip(_NAMES, _compared(texts, following), strict=True))
            yield _row_batch({"doc_id": piece.column(0).to_pylist(), **found}, out_schema)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("at"), "text")
    ranged = keyed.mapInArrow(pack, packed_ddl).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(ranged.mapInArrow(walk, row_ddl), "walked")
    firsts, lasts = rows.filter("edge = 1"), rows.filter("edge = 2")
    # one row per range of ids
    ranges = firsts.select("part", F.min("part").over(Window.partitionBy()).alias("start"), F.lead("part").over(Window.orderBy("part")).alias("after"))
    ends = (
        lasts.select("doc_id", "part", "packed")
        .join(ranges.select("part", F.coalesce("after", "start").alias("after")), "part")
        .join(firsts.select(F.col("part").alias("after"), F.col("packed").alias("following")), "after")
        .select("doc_id", "packed", "following")
    )
    found = rows.filter("edge = 0").select("doc_id", *_NAMES).union(ends.mapInArrow(meet, out_ddl))
    return found.withColumns({c: F.lower(F.hex(c)) for c in _PRINTS})


def signed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text_id and bands, without any order of rows."""
    ship_package(docs.sparkSession)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_id bigint, bands array<bigint>"

    schema = arrow_schema(ddl)

    def sign(batches):
        for piece in pieces(batches, PIECE_BYTES):
            texts = [t or b"" for t in piece.column(1).cast(pa.binary()).to_pylist()]
            bands = _bands(signatures(pa.array(texts, type=pa.large_binary())))
            yield _row_batch({"doc_id": piece.column(0).to_pylist(), "text_id": [_text_id(t) for t in texts], "bands": bands}, schema)

    return docs.select("doc_id", "text").mapInArrow(sign, ddl)


def _filter_of(keys: DataFrame):
    """Bit set of fixed size of the keys, for tasks to leave out rows that cannot join."""
    bit = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    rows = (
        keys.select(F.shiftright(bit, 5).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) & 31 as int))").alias("bits"))
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table)


def _pack(text: bytes) -> bytes:
    return pa.compress(text, codec="zstd", asbytes=True) + len(text).to_bytes(8, "little")


def _unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[:-8], int.from_bytes(blob[-8:], "little"), codec="zstd", asbytes=True)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct shingles of every text, sorted."""
    values, offsets = shingles(pa.array(texts, type=pa.large_binary()))
    return [np.unique(values[a:b]) for a, b in itertools.pairwise(offsets.tolist())]


def _packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text_id, packed and n_bytes of the texts whose ids the column ``key`` of ``ids`` lists, and of a few others."""
    present = _filter_of(ids)

    def fetch(batches):
        for piece in pieces(batches, PIECE_BYTES):
            texts = {_text_id(t): t for t in (t or b"" for t in piece.column(0).cast(pa.binary()).to_pylist())}
            at = {k: k % FILTER_BITS for k in texts}
            texts = {k: t for k, t in texts.items() if present.value[at[k] >> 5] >> (at[k] & 31) & 1}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(texts.keys(), type=pa.int64()),
                    pa.array([_pack(t) for t in texts.values()], type=pa.binary()),
                    pa.array([len(t) for t in texts.values()], type=pa.int64()),
                ],
                names=["text_id", "packed", "n_bytes"],
            )

    found = docs.select("text").mapInArrow(fetch, "text_id bigint, packed binary, n_bytes bigint")
    return staged(found.groupBy("text_id").agg(F.any_value("packed").alias("packed"), F.any_value("n_bytes").alias("n_bytes")), "texts")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of text ids whose shingles are alike by THRESHOLD at least."""

    def verify(batches):
        for piece in pieces(batches, PIECE_BYTES // 4):
            blobs = list(dict.fromkeys([*piece.column(2).to_pylist(), *piece.column(3).to_pylist()]))
            sets = dict(zip(blobs, _sets([_unpack(b) for b in blobs]), strict=True))
            good = []
            for a, b in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                one, other = sets[a], sets[b]
                common = len(np.intersect1d(one, other, assume_unique=True))
                good.append(common >= THRESHOLD * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], names=["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    one = texts.select(F.col("text_id").alias("a"), F.col("packed").alias("packed_a"))
    other = texts.select(F.col("text_id").alias("b"), F.col("packed").alias("packed_b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "packed_a", "packed_b").mapInArrow(verify, "a bigint, b bigint")


def _block_links(labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of linked texts of two labels, one in each block if ``sides`` has both; labels that are linked become one.

    Shingles that all stand in texts of one label are in no link, which bounds what a text can share with those of
    other labels; only texts whose bounds reach THRESHOLD are compared.
    """
    labels, links = labels.copy(), []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    _, flat_ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    alive = np.ones(len(sets), dtype=bool)
    across = len(set(sides.tolist())) > 1
    while True:
        rows = np.flatnonzero(alive[owner])
        least = np.full(flat_ids.max() + 1, np.iinfo(np.int64).max)
        most = np.full(len(least), np.iinfo(np.int64).min)
        np.minimum.at(least, flat_ids[rows], labels[owner[rows]])
        np.maximum.at(most, flat_ids[rows], labels[owner[rows]])
        shared = np.bincount(owner[rows], weights=(least < most)[flat_ids[rows]], minlength=len(sets)).astype(np.int64)
        kept = alive & (shared >= THRESHOLD * sizes)
        if (kept == alive).all():
            break
        alive = kept
    has = np.zeros(len(least), dtype=np.int64)
    for i in np.flatnonzero(alive).tolist():
        if across and sides[i]:
            continue
        bound = np.minimum(shared[i], shared)
        others = alive & (labels != labels[i]) & (bound >= THRESHOLD * (sizes[i] + sizes - bound))
        others &= sides == 1 if across else np.arange(len(sets)) > i
        if not others.any():
            continue
        has[flat_ids[offsets[i] : offsets[i + 1]]] = 1
        for j in np.flatnonzero(others).tolist():
            if labels[i] == labels[j]:
                continue
            common = has[flat_ids[offsets[j] : offsets[j + 1]]].sum()
            if common >= THRESHOLD * (sizes[i] + sizes[j] - common):
                links.append((i, j))
                labels[labels == labels[j]] = labels[i]
        has[flat_ids[offsets[i] : offsets[i + 1]]] = 0
    return links


def _mixed_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the labels of a bucket; ``rows`` has the columns key, text_id and label of mixed buckets.

    Buckets are cut into blocks by a hash of the text, and every pair of blocks of a bucket meets in a group of its own.
    """
    # what a text takes here is its bytes, however well it packs
    sized = rows.join(texts.select("text_id", "n_bytes"), "text_id")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int")
    cells = (
        rows.join(sized.groupBy("key").agg(blocks.alias("blocks")), "key")
        .withColumn("own", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "text_id", "label",
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )

    def compare(group: pa.Table) -> pa.Table:
        ids, labels, sides = (group.column(c).to_numpy() for c in ("text_id", "label", "side"))
        own = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        found = []
        if len(np.unique(labels)) > 1 and (own or len(np.unique(sides)) > 1):
            found = _block_links(labels, sides, _sets([_unpack(b) for b in group.column("packed").to_pylist()]))
        return pa.table({c: pa.array([int(ids[pair[k]]) for pair in found], type=pa.int64()) for k, c in enumerate("ab")})

    full = cells.join(texts.select("text_id", "packed"), "text_id").select("key", "low", "high", "text_id", "label", "side", "packed")
    return full.groupBy("key", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def near_classes(docs: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """text_id and near_class, the least text id reachable by links, of every text that is linked with another text.

    ``signed`` has the columns text_id and bands of the rows of ``docs``; it is made if it is not given. Equal texts
    are one text; texts without words have no links. A link is an exact similarity of THRESHOLD at least between two
    members of a bucket; those that others already connect need not be compared.
    """
    ship_package(docs.sparkSession)
    signed = signed_texts(docs) if signed is None else signed
    texts = signed.groupBy("text_id").agg(F.any_value("bands").alias("bands"))
    members = texts.select("text_id", F.explode("bands").alias("key"))
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = staged(members.join(groups, "key"), "shared")
    if shared.isEmpty():
        return signed.select("text_id", F.col("text_id").alias("near_class")).filter("false")
    packed = _packed_texts(docs, shared.select(F.col("text_id").alias("key")).distinct())
    # how much company a text has: the one that many others come from has most
    company = shared.groupBy("text_id").agg(F.sum("size").alias("company"))
    open_rows = shared.select("text_id", "key").join(company, "text_id")
    links = None
    while True:
        lead = open_rows.groupBy("key").agg(F.max_by("text_id", F.struct("company", "text_id")).alias("b"))
        asked = staged(open_rows.withColumnRenamed("text_id", "a").join(lead, "key").filter("a <> b"), "asked")
        found = staged(_verified(packed, asked.select("a", "b").distinct()), "links")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        # who is not like the chosen member of its bucket goes on among its own kind
        open_rows = asked.join(found, ["a", "b"], "left_anti").select("key", F.col("a").alias("text_id"), "company")
        still = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        if (still.most or 0) <= BLOCK or 10 * still.n > 9 * asked.count():
            break
    # Members of two classes may still be linked with each other, if not with the chosen ones.
    classes = shared.select("text_id", "key")
    if links is None:
        classes = classes.withColumn("label", F.col("text_id"))
    else:
        known = components(links).withColumnRenamed("node", "text_id")
        classes = classes.join(known, "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    classes = staged(classes, "classes")
    mixed = classes.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    rest = staged(classes.join(mixed.select("key"), "key", "left_semi"), "mixed")
    found = staged(_mixed_links(rest, packed), "links")
    links = found if links is None else links.union(found)
    return components(links).select(F.col("node").alias("text_id"), F.col("label").alias("near_class"))


def with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the near_class of their text_id, null without one.

    Most texts are in no class: a bit set of fixed size, broadcast as rows, tells which rows need not meet the classes.
    """
    bit = F.pmod(F.col("text_id"), F.lit(FILTER_BITS))
    here = F.expr(f"shiftleft(1L, cast(pmod(text_id, {FILTER_BITS}) & 31 as int))")
    bits = classes.select(F.shiftright(bit, 5).cast("int").alias("_at"), here.alias("bit")).groupBy("_at").agg(F.bit_or("bit").alias("_bits"))
    marked = rows.withColumn("_at", F.shiftright(bit, 5).cast("int")).join(F.broadcast(bits), "_at", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(here), F.lit(0)) != 0
    found = marked.filter(maybe).drop("_at", "_bits").join(classes, "text_id", "left")
    return found.unionByName(marked.filter(~maybe).drop("_at", "_bits").withColumn("near_class", F.lit(None).cast("bigint")))
