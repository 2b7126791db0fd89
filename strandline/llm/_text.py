"""Words, shingles and windows of whole Arrow string columns, as numpy arrays over their bytes.

Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 those separators are single bytes, so byte positions are enough
and no Python string is made. Hashes are 64-bit polynomial sums over prefix sums, mixed at the end. Texts are
handled in runs of a quarter megabyte, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses modulo 2^64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a uint64 over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_Q)) | U(1)
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, modulo 2^64."""
    got = _pow.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = U(1)
            out.append(np.multiply.accumulate(p))
        got = _pow[base] = (out[0], out[1])
    return got[0][:n], got[1][:n]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    if off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def text_of(b: pa.RecordBatch) -> pa.Array:
    """The texts of a batch, which has them as a column or, so that they travel once, inside the struct ``row`` only."""
    return b.column("text") if "text" in b.schema.names else pc.struct_field(b.column("row"), "text")


def runs(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """Words of rows [i, j): byte ``start`` and ``end`` in ``data``, ``row`` (from 0), ``first`` word of each row."""

    __slots__ = ("data", "start", "end", "row", "first", "n")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int):
        lo, hi = int(offsets[i]), int(offsets[j])
        self.data = data[lo:hi]
        cuts = offsets[i : j + 1] - lo
        self.n = j - i
        m = ~_SEP[self.data]
        before, after = np.empty_like(m), np.empty_like(m)
        if len(m):
            before[0] = after[-1] = False
            before[1:], after[:-1] = m[:-1], m[1:]
            inner = cuts[(cuts > 0) & (cuts < len(m))]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.row = np.searchsorted(cuts, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.n + 1))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One mixed hash per word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        p, inv = powers(_P, len(self.data) + 1)
        c = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[self.data] * p[:-1], out=c[1:])
        return mix((c[self.end] - c[self.start]) * inv[self.start])


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q, inv = powers(_Q, len(h))
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * q, out=c[1:])
    return mix((c[k:] - c[:-k]) * inv[:n])


def to_list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
