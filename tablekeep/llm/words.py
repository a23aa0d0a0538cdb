"""Words of Arrow batches of texts as numpy arrays, without a Python object per word."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a batch: number of each word in ``names``, and where the words of each text start and end."""

    ids: np.ndarray
    names: pa.BinaryArray
    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    data: np.ndarray


def flat(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts in a row, null as empty, and the offsets of the texts among them."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACE_BYTES) -> Words:
    """Longest stretches of bytes that are no separators, cut where texts meet."""
    if not len(data):
        none = np.zeros(len(offsets) - 1, dtype=np.int64)
        return Words(np.empty(0, dtype=np.int32), pa.array([], type=pa.binary()), none, none, none[:0], data)
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = inside[cuts]
    edges = cuts[cuts > 0] - 1
    last[edges] = inside[edges]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(stop - begin, out=ends[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    )
    coded = words.dictionary_encode()
    return Words(
        coded.indices.to_numpy(zero_copy_only=False),
        coded.dictionary.cast(pa.binary()),
        np.searchsorted(begin, offsets[:-1]),
        np.searchsorted(begin, offsets[1:]),
        begin,
        data,
    )


def pieces(batches, piece_bytes: int):
    """Batches cut so that each holds about ``piece_bytes``, or a single longer row."""
    for batch in batches:
        step = max(1, int(batch.num_rows * piece_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def arrow_schema(ddl: str) -> pa.Schema:
    """Schema of Arrow batches for a DDL string; to be called on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))
