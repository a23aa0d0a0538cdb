"""Secret scans through nested encodings.

A worklist holds layers of text, first the document itself. Each layer is scanned and opened further:

* around its URL escapes and around its Unicode escapes, these are decoded;
* its base64 runs, as they stand or joined over line breaks, are decoded from each of four alignments, so whatever
  stands in front of an encoded secret in the same run does not hide it;
* characters with a zero after each are read as UTF-16 too;
* compressed bytes that begin anywhere in a layer are unpacked, whatever encoding they came from, in overlapping
  chunks, so a stream may unpack to any size;

until nothing new turns up. Every character of a layer knows the stretch of the document it comes from, and spans are
reported there. A layer that was seen before at the same stretch is not opened again, so cycles end; the same layer at
another place is. Layers are opened depth first and made when their turn comes, so memory follows the longest layer
and not their number.
"""

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import text_columns

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Without one of these no assignment can match.
_HINTS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}")
#: Stretches of characters that can stand in a secret or in an encoding of one: no match crosses their ends.
_STRETCH = re.compile(r"[A-Za-z0-9+/_.=\-\"' :\t\r\n%\\{}\x00-\x08\x0e-\x1f\x7f-\xff\udc80-\udcff]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs wrapped over several lines, which may be indented.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
#: First bytes of gzip and of the usual zlib streams.
_PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
#: Decoded bytes without any of these hold no secret and open no further.
_OPENS = re.compile(
    rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uxU]|[A-Za-z0-9+/_-]{16}"
    rb"|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]|\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|(?:[^\0]\0){6}"
)
#: UTF-16 of characters below 256, read as one character a byte.
_ZEROS = re.compile("(?:[^\0]\0){6,}[^\0]?")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: Bytes of an unpacked stream that are held at once, and bytes that two such chunks share.
CHUNK = 4 << 20
OVERLAP = 1 << 18

FOUND = "found array<struct<kind:string,start:int,end:int,layer:string>>"


def scan_layer(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of every secret in a text as it stands."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in _ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return found


class _Places:
    """Where the characters of a layer come from: arrays of starts and ends, one stretch for all, or themselves."""

    def __init__(self, starts=None, ends=None):
        self.starts, self.ends = starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Stretch of the document that the characters from start to end come from."""
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def within(self, starts: np.ndarray, ends: np.ndarray) -> "_Places":
        """Places of characters that come from these stretches of the layer."""
        if self.starts is None:
            return _Places(starts, ends)
        if isinstance(self.starts, int):
            return self
        return _Places(self.starts[starts], self.ends[ends - 1])

    def mark(self) -> tuple:
        if self.starts is None or isinstance(self.starts, int):
            return self.starts, self.ends
        return hash(self.starts.tobytes()), hash(self.ends.tobytes())


def _joined(pieces: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[str, np.ndarray, np.ndarray]:
    return "".join(p[0] for p in pieces), np.concatenate([p[1] for p in pieces]), np.concatenate([p[2] for p in pieces])


def _plain(text: str, at: int) -> tuple[str, np.ndarray, np.ndarray]:
    starts = np.arange(at, at + len(text))
    return text, starts, starts + 1


def _percent(text: str, low: int, high: int) -> tuple[str, np.ndarray, np.ndarray]:
    """A stretch with its URL escapes decoded as UTF-8, bytes that are none kept apart, and the place of each character."""
    pieces, at = [], low
    for m in _PERCENT.finditer(text, low, high):
        pieces.append(_plain(text[at : m.start()], at))
        chars = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        sizes = np.array([3 * (1 if c < "\x80" or "\ud800" <= c <= "\udfff" else len(c.encode("utf-8"))) for c in chars])
        ends = m.start() + np.cumsum(sizes)
        pieces.append((chars, ends - sizes, ends))
        at = m.end()
    pieces.append(_plain(text[at:high], at))
    return _joined(pieces)


def _escapes(text: str, low: int, high: int) -> tuple[str, np.ndarray, np.ndarray]:
    """A stretch with its Unicode escapes decoded, surrogate pairs as one character."""
    pieces, at, half = [], low, False
    for m in _ESCAPE.finditer(text, low, high):
        if m.start() > at:
            pieces.append(_plain(text[at : m.start()], at))
            half = False
        code, start = int(m[0][2:].strip("{}"), 16), m.start()
        at = m.end()
        if half and 0xDC00 <= code < 0xE000:
            before, starts, _ = pieces.pop()
            code, start = 0x10000 + ((ord(before) - 0xD800) << 10) + code - 0xDC00, int(starts[0])
        if code < 0x110000:
            pieces.append((chr(code), np.array([start]), np.array([at])))
            half = 0xD800 <= code < 0xDC00
    pieces.append(_plain(text[at:high], at))
    return _joined(pieces)


def _members(raw: memoryview, size: list[int]) -> Iterator[bytes]:
    """Bytes of all gzip or zlib streams that follow each other; ``size`` gets the bytes that whole streams took.

    What stands behind them is part of the layer they stand in.
    """
    whole = len(raw)
    while _starts_stream(raw):
        stream, at = zlib.decompressobj(wbits=47), 0
        try:
            while not stream.eof and at < len(raw):
                part = bytes(raw[at : at + (1 << 16)])
                at += len(part)
                while part and not stream.eof:
                    yield stream.decompress(part, 1 << 18)
                    part = stream.unconsumed_tail
        except zlib.error:
            return
        if not stream.eof:
            return
        raw = raw[at - len(stream.unused_data) :]
        size[0] = whole - len(raw)


def _starts_stream(raw: memoryview) -> bool:
    """Whether bytes begin with a gzip or zlib header and something that unpacks."""
    first = bytes(raw[:64])
    if first[:3] != b"\x1f\x8b\x08" and not (len(first) > 5 and first[0] & 15 == 8 and first[0] >> 4 < 8 and not (first[0] << 8 | first[1]) % 31):
        return False
    try:
        zlib.decompressobj(wbits=47).decompress(first, 1)
    except zlib.error:
        return False
    return True


def _unpacked(raw: memoryview, size: list[int]) -> Iterator[str]:
    """Texts of what compressed bytes unpack to, in chunks that overlap; ``size`` gets the bytes of whole streams."""
    if not _starts_stream(raw):
        return
    held, fresh = bytearray(), 0
    for part in _members(raw, size):
        held += part
        fresh += len(part)
        if len(held) >= CHUNK:
            yield held.decode("utf-8", "surrogateescape")
            del held[: len(held) - OVERLAP]
            fresh = 0
    if fresh:
        yield held.decode("utf-8", "surrogateescape")


def _streams(text: str, places: _Places, path: str) -> Iterator[tuple]:
    """Layers of all compressed bytes in a layer: as UTF-8 gave them, or as one character a byte."""
    name = path[: -len("base64")] if path.endswith("base64") else f"{path}/" if path else ""
    views = []
    if any("\udc80" <= c <= "\udcff" for c in text):
        views.append((text.encode("utf-8", "surrogateescape"), True))
    elif text and max(text) >= "\x80":
        views.append((text.encode("latin-1", "replace"), False))
    else:
        views.append((text.encode(), False))
    for raw, wide in views:
        starts = {m.start() for m in _PACKED.finditer(raw)} | {0}
        done = 0
        for start in sorted(starts):
            if start < done:
                continue
            first, size = None, [0]
            for chunk in _unpacked(memoryview(raw)[start:], size):
                if first is None:
                    first = len(raw[:start].decode("utf-8", "surrogateescape")) if wide else start
                yield chunk, _Places(*places.span(first, len(text))), f"{name}compressed"
            done = start + size[0]


def _decoded(raw: bytes, starts: np.ndarray, ends: np.ndarray, places: _Places, path: str) -> tuple:
    """Layer of bytes that came from these stretches of the layer above, as UTF-8 as far as they are."""
    text = raw.decode("utf-8", "surrogateescape")
    if len(text) != len(raw):
        sizes = np.array([1 if c < "\x80" or "\ud800" <= c <= "\udfff" else len(c.encode("utf-8")) for c in text])
        last = np.cumsum(sizes)
        starts, ends = starts[last - sizes], ends[last - 1]
    return text, places.within(starts, ends), path


def _aligned(token: bytes, at: np.ndarray, places: _Places, path: str) -> Iterator[tuple]:
    """Layers of a base64 run read from each of its first four characters on; ``at`` is the place of each character."""
    body = token.rstrip(b"=").translate(_STANDARD)
    for skip in range(min(4, len(body))):
        size = len(body) - skip
        size -= size % 4 == 1
        raw = base64.b64decode(body[skip : skip + size] + b"=" * (-size % 4))
        if not _OPENS.search(raw) and not (raw and _starts_stream(memoryview(raw))):
            continue
        k = np.arange(len(raw))
        ends = np.minimum(skip + size, skip + -(-(k + 1) * 4 // 3))
        yield _decoded(raw, at[skip + k * 4 // 3], at[ends - 1] + 1, places, path)


def _opened(text: str, places: _Places, path: str) -> Iterator[tuple]:
    """All layers that a layer opens to, one after the other: text, places and path."""
    inner = f"{path}/" if path else ""
    yield from _streams(text, places, path)
    if "\0" in text:
        for m in _ZEROS.finditer(text):
            kept = m.start() + np.array([i for i, c in enumerate(m[0]) if c != "\0"])
            yield m[0].replace("\0", ""), places.within(kept, kept + 1), f"{inner}utf16"
    for sign, pattern, decode, kind in (("%", _PERCENT, _percent, "url"), ("\\", _ESCAPE, _escapes, "unicode")):
        if sign in text and pattern.search(text):
            for m in _STRETCH.finditer(text):
                if pattern.search(text, *m.span()):
                    layer, starts, ends = decode(text, *m.span())
                    if layer:
                        yield layer, places.within(starts, ends), f"{inner}{kind}"
    for m in _BASE64.finditer(text):
        yield from _aligned(m[0].encode(), np.arange(*m.span()), places, f"{inner}base64")
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            data = np.frombuffer(m[0].encode(), dtype=np.uint8)
            kept = np.flatnonzero((data != 32) & (data != 9) & (data != 10) & (data != 13))
            if len(kept) >= 16:
                yield from _aligned(data[kept].tobytes(), kept + m.start(), places, f"{inner}base64")


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """All secrets of a text as (start, end, kind, layer)."""
    found = {(s, e, k): "" for s, e, k in scan_layer(text)}
    seen: set[tuple] = set()
    work = [_opened(text, _Places(), "")]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        inner, places, path = layer
        mark = hash(inner), len(inner), *places.mark()
        if mark in seen:
            continue
        seen.add(mark)
        for s, e, k in scan_layer(inner):
            found.setdefault((*places.span(s, e), k), path)
        work.append(_opened(inner, places, path))
    return sorted((s, e, k, path) for (s, e, k), path in found.items())


def _scanner():
    def compute(texts: list) -> list[list]:
        return [
            [
                [{"kind": KINDS[k], "start": s, "end": e, "layer": p} for s, e, k, p in scan(text or "")]
                for text in texts
            ]
        ]

    return compute


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` without its text and with ``found``: kind, start, end and layer of every secret.

    Offsets count code points of the whole text, the end is exclusive. The layer is empty for what stands in
    the text itself, else the path of decodings such as ``url/base64``. Null and empty texts have no secrets. A secret
    seen in the same place through several layers is listed once per kind, with the first layer. Repeated rows are
    scanned each, an empty table gives no rows. A column named ``found`` is replaced; others are passed on.
    """
    return text_columns(docs, FOUND, _scanner, drop=("text",))


def _redactor():
    def compute(texts: list) -> list[list]:
        out = []
        for text in texts:
            if text is not None:
                parts, at = [], 0
                for start, end, _, _ in scan(text):
                    if start >= at:
                        parts += [text[at:start], MASK]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return [out]

    return compute


MASK = "[secret]"


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in its text replaced by MASK; overlapping spans by a single one."""
    return text_columns(docs, "text string", _redactor).select(*docs.columns)


def listing(spans: Column) -> Column:
    """kind:start:end of every span by start, then kind as in KINDS, then end, joined by commas."""
    order = F.transform(
        spans,
        lambda x: F.struct(
            x.start.alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), x.kind).alias("k"),
            x.end.alias("end"),
            x.kind.alias("kind"),
        ),
    )
    text = F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x.kind, x.start, x.end))
    return F.array_join(text, ",")
