"""Quality classifier with supervised subword embeddings.

Every document is a bag of hashed words, pairs of neighbouring words and byte n-grams. Each bucket has a learned
vector; the vectors of a document are averaged, and a softmax over two outputs gives the score. The vectors are
trained by stochastic gradient descent in numpy on a sample of SAMPLE labelled documents at most, the only bound:
every document is scored, over its whole text. Since the average is linear, a trained model is one number per
bucket, which is what tasks receive.

A pair of words is hashed by the difference of its words, so that a word following itself is always the same
feature, whatever the word.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import crc_rest, ship_package
from tablekeep.llm.features import bucket, byte_grams, means, pack, word_hashes

SAMPLE = 3000
WORD_BITS = 12
GRAM_BITS = 12
GRAMS = (1, 2, 3)
SIZE = 2 * (1 << WORD_BITS) + len(GRAMS) * (1 << GRAM_BITS)
DIMENSIONS = 16
EPOCHS = 12
BATCH = 32
RATE = 0.3
THRESHOLD = 0.3
FOLDS = 5
#: Bytes of texts that are turned into buckets together; a task's memory is some forty times that, or the longest text.
PIECE_BYTES = 1 << 18


@dataclass(frozen=True)
class Model:
    """Weight of each bucket and the bias: the log odds of label 1 are their mean per kind, added up."""

    weights: np.ndarray
    bias: float


def _parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One kind of feature after the other: all its buckets, and where each text starts and ends among them."""
    data, starts, ends = pack([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    words, first, last = word_hashes(data, starts, ends)
    yield bucket(words, WORD_BITS).astype(np.uint16), first, last
    words[1:] -= words[:-1].copy()
    words[:1] = 0
    yield bucket(words, WORD_BITS).astype(np.uint16) + np.uint16(1 << WORD_BITS), np.minimum(first + 1, last), last
    del words
    base = 2 << WORD_BITS
    for i, n in enumerate(GRAMS):
        grams = byte_grams(data, n, GRAM_BITS).astype(np.uint16) + np.uint16(base + i * (1 << GRAM_BITS))
        yield grams, starts, np.maximum(ends - n + 1, starts)


def averages(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the buckets it has, and the share of each among the text's features of that kind."""
    found: list[list] = [[] for _ in texts]
    for values, starts, ends in _parts(texts):
        for row, a, b in zip(found, starts.tolist(), ends.tolist(), strict=True):
            if b > a:
                kinds, counts = np.unique(values[a:b], return_counts=True)
                row.append((kinds, (counts / np.float32(b - a)).astype(np.float32)))
    none = np.empty(0, dtype=np.uint16), np.empty(0, dtype=np.float32)
    return [(np.concatenate([k for k, _ in row]), np.concatenate([v for _, v in row])) if row else none for row in found]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Fit on the averages of labelled texts; without any, a model that scores 0.5 throughout.

    Only the buckets that a text has are held; a step of the descent sees BATCH whole rows.
    """
    if not rows:
        return Model(np.zeros(SIZE, dtype=np.float32), 0.0)
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    vectors = rng.normal(0, 0.1, (SIZE, DIMENSIONS)).astype(np.float32)
    outputs = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log(np.array([(y == 0).sum() + 1.0, (y == 1).sum() + 1.0]) / (len(y) + 2)).astype(np.float32)
    squares = [np.full(p.shape, 1e-8, dtype=np.float32) for p in (vectors, outputs, bias)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            chosen = order[start : start + BATCH]
            x = np.zeros((len(chosen), SIZE), dtype=np.float32)
            for k, row in enumerate(chosen.tolist()):
                x[k, rows[row][0]] = rows[row][1]
            hidden = x @ vectors
            logits = hidden @ outputs + bias
            shares = np.exp(logits - logits.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
            shares[np.arange(len(chosen)), y[chosen]] -= 1
            shares /= len(chosen)
            steps = (x.T @ (shares @ outputs.T), hidden.T @ shares, shares.sum(axis=0))
            for value, step, square in zip((vectors, outputs, bias), steps, squares, strict=True):
                square += step * step
                value -= RATE * step / np.sqrt(square)
    direction = outputs[:, 1] - outputs[:, 0]
    return Model((vectors @ direction).astype(np.float32), float(bias[1] - bias[0]))


def log_odds(model: Model, texts: list[str | None]) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    for values, starts, ends in _parts(texts):
        total += means(model.weights[values], starts, ends)
    return total


def _pieces(column: pa.Array) -> Iterator[list[str | None]]:
    """Texts of an Arrow column, some PIECE_BYTES at a time."""
    step = max(1, int(len(column) * PIECE_BYTES / max(1, column.nbytes)))
    for start in range(0, len(column), step):
        yield column.slice(start, step).to_pylist()


def _sampled_averages(docs: DataFrame, ids: list) -> list[tuple]:
    """doc_id and averages of the documents with these ids; of rows that share an id the one of the least text hash."""

    def run(batches):
        for batch in batches:
            rows = [row for texts in _pieces(batch.column(2)) for row in averages(texts)]
            packed = [pa.array([row[i].tobytes() for row in rows], type=pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["doc_id", "at", "kinds", "shares"])

    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.filter(F.col("doc_id").isin(ids)).select("doc_id", F.xxhash64("text").alias("at"), "text")
    found = {}
    for r in texts.mapInArrow(run, f"doc_id {kind}, at bigint, kinds binary, shares binary").collect():
        if r.doc_id not in found or r.at < found[r.doc_id][0]:
            found[r.doc_id] = r.at, np.frombuffer(r.kinds, dtype=np.uint16), np.frombuffer(r.shares, dtype=np.float32)
    return [(i, (kinds, shares)) for i, (_, kinds, shares) in sorted(found.items())]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled documents whose crc32 of the id, modulo FOLDS, is not 0.

    At most ``sample`` of them, chosen by a hash of the id: their ids and then the averages of their texts come to
    the driver, at most six bytes a bucket. Rows without an id or label are left out; of several labels of an id the
    greatest counts, of several texts that of the least hash. Without labelled rows every score is 0.5.
    """
    known = (
        labels.filter((crc_rest(F.col("doc_id"), FOLDS) != 0) & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    total = known.count()
    share = min(1.0, 1.2 * sample / max(total, 1))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = known.select("doc_id", "quality", at.alias("at")).filter(F.col("at") < share * (1 << 20))
    rows = sorted(chosen.collect(), key=lambda r: (r.at, r.doc_id))[:sample]
    label_of = {r.doc_id: r.quality for r in rows}
    if not label_of:
        return train([], [])
    rows = _sampled_averages(docs, list(label_of))
    return train([row for _, row in rows], [label_of[i] for i, _ in rows])


def score(
    docs: DataFrame, model: Model, drop: tuple[str, ...] = (), name: str = "score"
) -> DataFrame:
    """``docs`` with column ``name``, the share of label 1; a column of that name is replaced.

    Null and empty texts get the score of the bias. Equal texts get equal scores, an empty table no rows. Other
    columns, whatever their names, are passed on. Only the texts travel to Python; the rows stay where they are.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def share(text: pa.Array) -> pa.Array:
        found = [1 / (1 + np.exp(-log_odds(shared.value, texts))) for texts in _pieces(text)]
        return pa.array(np.concatenate(found) if found else [], type=pa.float64())

    return docs.withColumn(name, F.arrow_udf(share, "double")("text")).drop(*drop)
