"""Vectorised tokenising and hashing of whole texts on UTF-8 bytes.

All kernels here run inside Arrow batches.  Texts are taken as bytes and
handled in groups of a few megabytes, so a task's memory is bounded by the
group size and by its single longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GROUP_BYTES = 2 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.PCG64(20240607).random_raw(256)  # a random 64-bit number for each byte value
_powers: dict[int, np.ndarray] = {}


def byte_table(chars: bytes, inside: bool = True) -> np.ndarray:
    table = np.full(256, not inside)
    table[list(chars)] = inside
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
WORD = byte_table(SPACES, inside=False)
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, GROUP_BYTES + 4096)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=U)
    return have


def word_spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that table allows."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = table[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over random byte values, from prefix sums, finalised with the length."""
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf))[: len(buf)], out=total[1:])
    own = (total[ends] - total[starts]) * _power(_INVERSE, len(buf) + 1)[starts]
    return mix(own + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about limit bytes together."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def _cuts(text: bytes, table: np.ndarray, limit: int) -> Iterator[bytes]:
    """A very long text in pieces that end where no word is cut."""
    at = 0
    while len(text) - at > limit:
        window = np.frombuffer(text, dtype=np.uint8, count=limit, offset=at)
        stops = np.flatnonzero(~table[window])
        if len(stops):
            cut = at + int(stops[-1]) + 1
        else:
            rest = np.frombuffer(text, dtype=np.uint8, offset=at + limit)
            more = np.flatnonzero(~table[rest])
            cut = at + limit + int(more[0]) + 1 if len(more) else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def hashed_words(texts: list[bytes], table: np.ndarray = WORD, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows: first row, last row (exclusive), hashes of all their words, and offsets of each row's words."""
    for a, b in groups(texts):
        if b - a == 1 and len(texts[a]) > 2 * GROUP_BYTES:
            whole = texts[a].lower() if lower else texts[a]  # before it is cut: the table may hold no capitals
            found = [hashed_words_once([x], table, False)[0] for x in _cuts(whole, table, GROUP_BYTES)]
            h = np.concatenate(found)
            yield a, b, h, np.array([0, len(h)])
        else:
            yield a, b, *hashed_words_once(texts[a:b], table, lower)


def hashed_words_once(parts: list[bytes], table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(parts)
    buf = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    starts, ends = word_spans(buf, table)
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=at[1:])
    return span_hashes(buf, starts, ends), np.searchsorted(starts, at)
