"""Vector work on whole texts inside Arrow batches: words, rolling hashes, sliding minima.

A batch's texts are one byte buffer with offsets. It is worked through in chunks of
whole texts of a few MB, so that memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4 << 20
#: Odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, modulo 2**64."""
    have = len(_powers["base"])
    if have < n:
        grow = max(n, 2 * have)
        for name, b in (("base", BASE), ("inverse", INVERSE)):
            steps = np.full(grow, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["base"][:n], _powers["inverse"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    out = x >> np.uint64(31)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    step = out >> np.uint64(29)
    out ^= step
    out *= np.uint64(0x94D049BB133111EB)
    step = np.right_shift(out, np.uint64(32), out=step)
    out ^= step
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(buf: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, bytes, offsets) of runs of texts of at most limit bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, past, buf[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
        first = past


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of the words [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's first word (n + 1). No word spans two texts."""
    inside = member[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums of byte * BASE**i before each position (n + 1)."""
    base, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * base[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, the same wherever the bytes stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (n - k + 1, or none): a polynomial in BASE, built by doubling."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, piece, size = None, 0, words, 1
    while True:
        if k & size:
            # piece stands before the part that is already there.
            out, have = (piece, size) if out is None else (joined(piece, size, out, have), have + size)
        if 2 * size > k:
            return mix(out[:n])
        piece, size = joined(piece, size, piece, size), 2 * size


def joined(left: np.ndarray, size: int, right: np.ndarray, length: int) -> np.ndarray:
    """Hashes of size + length elements from those of size (left) and of length (right)."""
    n = len(right) - size
    out = left[:n] * np.uint64(pow(BASE, length, 1 << 64))
    out += right[size:]
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of UTF-8 bytes, cut between characters, as a string array."""
    data = memoryview(np.ascontiguousarray(buf))
    whole = b"".join([data[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(whole))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values (n - width + 1), in three passes for any width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    top = np.iinfo(x.dtype).max
    rows = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
