"""Language identification by nearest centroid.

Texts are TF-IDF vectors of hashed byte n-grams, of unit length. Each language has several centroids, clustered
from a bounded sample of its labelled texts; a text takes the language of the centroid with the largest cosine.
A text farther from that centroid than its own training texts is rejected.
"""

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import crc_rest, text_columns
from tablekeep.llm.features import byte_grams

FOLDS, HELD_OUT = 4, 2
#: Training texts per language from which its centroids are clustered.
SAMPLE = 400
CENTROIDS = 3
ROUNDS = 10
GRAMS = (1, 2, 3)
BITS = 13
SIZE = len(GRAMS) << BITS
#: A text is rejected if its cosine is below this share of the lowest cosine among the centroid's own texts.
REJECT_SHARE = 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes other than letters count as a space; A-Z as a-z. Bytes of other characters stay.
_PLAIN = np.array([b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    #: One column per centroid, and the language and radius of each.
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    data = _PLAIN[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if len(data):
        data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])]
    total = np.zeros(SIZE, dtype=np.int64)
    for i, n in enumerate(GRAMS):
        total[i << BITS : (i + 1) << BITS] = np.bincount(byte_grams(data, n, BITS), minlength=1 << BITS)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector; zero for a text without features."""
    weights = np.sqrt(counts(text).astype(np.float32)) * idf
    length = np.sqrt(weights @ weights)
    return weights / length if length else weights


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the farthest-first start; at most k unit centroids, as rows."""
    centroids = [rows.mean(axis=0)]
    while len(centroids) < min(k, len(rows)):
        near = np.max(rows @ np.array(centroids).T, axis=1)
        centroids.append(rows[int(np.argmin(near))])
    found = np.array(centroids)
    for _ in range(ROUNDS):
        found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        own = np.argmax(rows @ found.T, axis=1)
        found = np.array([rows[own == j].mean(axis=0) for j in range(len(found)) if (own == j).any()])
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all training rows; summed per task before the shuffle."""

    def make():
        def compute(texts: list) -> list[list]:
            total = np.zeros(SIZE, dtype=np.int64)
            for text in texts:
                total += counts(text) > 0
            out: list = [[] for _ in texts]
            if texts:
                out[0] = [{"bucket": int(b), "df": int(total[b])} for b in np.flatnonzero(total)]
            return [out]

        return compute

    parts = text_columns(train.select("text"), "part array<struct<bucket:int,df:bigint>>", make, drop=("text",))
    rows = parts.select(F.inline("part")).groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(SIZE, dtype=np.int64)
    for r in rows:
        df[r.bucket] = r.df
    return df, train.count()


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from rows with a language whose crc32 of the id, modulo FOLDS, is not HELD_OUT.

    Document frequencies come from all of them, the centroids from ``sample`` texts per language, chosen by a
    hash of the id (of rows that share one, by the order of their texts), which come to the driver. Repeated rows count
    each. A table without such rows gives a model that knows no language.
    """
    train = docs.select("doc_id", "text", "lang").filter(
        (crc_rest(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.least(F.lit(1.0), F.lit(1.2 * sample) / F.count(F.lit(1))) * (1 << 20)
    shares = train.groupBy("lang").agg(F.floor(share).alias("share"))
    # ids meet the shares, so no text is shuffled; at most some 1.2 * sample ids per language are chosen
    ids = train.select("doc_id", "lang", at.alias("at")).join(shares, "lang").filter("at < share")
    wanted = {(r.doc_id, r.lang): r.at for r in ids.collect()}
    found = train.filter(F.col("doc_id").isin(list({i for i, _ in wanted}))).collect()
    chosen: dict[str, list] = {}
    for r in sorted((r for r in found if (r.doc_id, r.lang) in wanted), key=lambda r: (wanted[r.doc_id, r.lang], r.doc_id, r.text)):
        if _LETTER.search(r.text):
            chosen.setdefault(r.lang, []).append(r.text)
    frequencies, n = _document_frequencies(train)
    idf = (np.log((1 + n) / (1 + frequencies)) + 0.1).astype(np.float32)
    languages = sorted(chosen)
    columns, owner, least = [], [], []
    for number, lang in enumerate(languages):
        rows = np.array([vector(t, idf) for t in chosen[lang][:sample]], dtype=np.float32)
        centroids = cluster(rows, k)
        near = rows @ centroids.T
        own = np.argmax(near, axis=1)
        for j in range(len(centroids)):
            columns.append(centroids[j])
            owner.append(number)
            least.append(near[own == j, j].min() if (own == j).any() else 0.0)
    matrix = np.array(columns, dtype=np.float32).T if columns else np.zeros((SIZE, 0), dtype=np.float32)
    return Model(languages, idf, np.ascontiguousarray(matrix), np.array(owner, dtype=np.int64), np.array(least))


def identify(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``nearest``, ``score`` (cosine, 0 to 1) and ``rejected``.

    ``nearest`` is UNKNOWN with score 0 for a null text, a text without a letter, or a model without languages.
    Ties go to the language that comes first by name. Repeated rows are scored each; columns named like these three are
    replaced, others are passed on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def one(text: str | None) -> tuple[str, float, bool]:
            if not m.languages or text is None or not _LETTER.search(text):
                return UNKNOWN, 0.0, True
            near = vector(text, m.idf) @ m.centroids
            best = int(np.argmax(near))
            score = float(min(1.0, max(0.0, near[best])))
            return m.languages[m.owner[best]], score, bool(score < REJECT_SHARE * m.least[best])

        def compute(texts: list) -> list[list]:
            found = [one(t) for t in texts]
            return [[f[i] for f in found] for i in range(3)]

        return compute

    return text_columns(docs, "nearest string, score double, rejected boolean", make, drop=drop)
