"""Array helpers for whole texts inside Arrow tasks: words, rolling hashes, packed arrays.

Texts are handled as one byte array with document offsets, so that the work per word or
byte is a numpy operation. Rolling hashes are polynomial, modulo 2**64, over random byte
values, with a final mixing step; two lanes together give 128 bits.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: blank, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A null document id orders after every other.
NO_ID = np.iinfo(np.int64).max

#: Powers are kept in steps of so many; bytes are hashed fewer than 16 steps at a time.
STEP = 1 << 16
CHUNK = 15 * STEP

_LANES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_TABLES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1) for seed in (11, 29)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offset of each row; a null is empty."""
    array = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64)[array.offset: array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def keep_heap() -> None:
    """Let this process keep freed arrays' memory for the next ones.

    glibc maps blocks anew, page by page, that are larger than any it has unmapped so far; one large block, never touched, raises that size.
    """
    np.empty(31 << 20, np.uint8)


def ids(column) -> np.ndarray:
    """A document id column as integers; null is ``NO_ID``."""
    return np.asarray(column.fill_null(NO_ID).to_numpy() if len(column) else [], dtype=np.int64)


def id_column(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(stop, rows)
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (one more at the end)."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    kind = np.int32 if len(data) < 2**31 - 1 else np.int64
    begin = np.flatnonzero(starts).astype(kind)
    return begin, (np.flatnonzero(ends) + 1).astype(kind), np.searchsorted(begin, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else unchanged."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n:
        size = max(-(-n // STEP), 1) * STEP
        base = _LANES[lane]
        up, down = np.full(size, U64(base)), np.full(size, U64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _POWERS[lane] = (np.cumprod(up), np.cumprod(down))
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, lane: int = 0) -> np.ndarray:
    """Running sums from which ``span`` takes the hash of any run of values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(len(values), lane)[0], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums), lane)[1][start])


def neighbours(sums: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` neighbouring values; lightly mixed, to be compared or mixed again."""
    h = sums[width:] - sums[:-width]
    h *= _powers(len(h), lane)[1]
    h ^= h >> U64(32)
    h *= U64(0xFF51AFD7ED558CCD)
    return h


def byte_values(data: np.ndarray, lane: int = 0) -> np.ndarray:
    return _TABLES[lane][data]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each word's bytes, worked out ``CHUNK`` bytes at a time."""
    out, at = np.empty(len(start), U64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, "right")))
        low = int(start[at])
        sums = prefix(byte_values(data[low: int(end[stop - 1])], lane), lane)
        out[at:stop] = span(sums, start[at:stop] - low, end[at:stop] - low, lane)
        at = stop
    return out


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the index of each document's first item."""
    return np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes. Bytes of one significance lie together, which Spark's compression likes."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str[1:].encode()
        out.append(struct.pack("<2sq", code, len(a)))
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 and len(a) else a.tobytes())
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    (count,), at, out = struct.unpack_from("<B", blob), 1, []
    for _ in range(count):
        code, n = struct.unpack_from("<2sq", blob, at)
        at += 10
        kind = np.dtype(code.decode())
        raw = np.frombuffer(blob, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if kind.itemsize > 1 and n else raw.view(kind))
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the distance to the one before."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def ungaps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def runs(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys; the keys are sorted."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first.astype(np.int32) if len(new) < 2**31 else first


def cover(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` items lie in a window of ``length`` that begins at one of the distinct ``starts``."""
    step = np.zeros(size + length + 1, np.int32)
    step[starts] += 1
    step[starts + length] -= 1
    return np.cumsum(step, out=step)[:size] > 0
