"""Vectorised text scanning over the UTF-8 bytes of Arrow string columns (NumPy, whole texts, many rows at once)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C55), U(0xD6E8FEB86659FD93)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_power = {int(_P): np.ones(1, U), int(_P_INV): np.ones(1, U)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept and grown."""
    have = _power[int(base)]
    if len(have) <= n:
        have = np.full(max(n + 1, 1 << 21), base, U)
        have[0] = 1
        _power[int(base)] = np.cumprod(have, dtype=U)
    return _power[int(base)][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary Arrow array; nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def table(members: bytes | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Runs:
    """Maximal runs of the bytes for which `inside` holds, never across rows. start, end: byte places; row: row number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.zeros(len(data), bool)
        if len(data):
            before[1:] = inside[:-1]
        opens = inside & (~before | first[:-1])
        after = np.zeros(len(data), bool)
        if len(data):
            after[:-1] = inside[1:]
        closes = inside & (~after | first[1:])
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        #: first run of each row, and one more
        self.of = np.searchsorted(self.start, offsets)


class Hasher:
    """64-bit hashes of any byte ranges of one buffer, equal for equal ranges."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(_P, n)[:n], out=self.sums[1:])
        self.back = powers(_P_INV, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U) * _Q)


def windows(words: np.ndarray, of: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of each window of `size` words within a row; short: rows with fewer words give one window."""
    n = np.diff(of)
    count = np.maximum(n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + of[:-1][row]
    out = np.zeros(len(place), U)
    for k in range(size):
        out = out * _P + words[place + k]
    out = mix(out)
    if short and (few := np.flatnonzero((n > 0) & (n < size))).size:
        more = []
        for r in few:
            h = U(0)
            with np.errstate(over="ignore"):
                for w in words[of[r] : of[r + 1]]:
                    h = h * _P + w
            more.append(h)
        out = np.concatenate([out, mix(np.array(more, U) + n[few].astype(U) * _Q)])
        place = np.concatenate([place, of[few]])
    return out, place


def row_sets(values: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """The distinct values of each row, ascending; values of one row stand together, `of` has the rows' offsets."""
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        v = np.sort(values[a:b])
        if b - a > 1:
            keep = np.empty(b - a, bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        out.append(v)
    return out


def repeated(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mask of the values that occur more than once in their row."""
    key = values ^ mix(row.astype(U) + U(1))
    order = np.argsort(key)
    v = key[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    again = np.empty(len(v), bool)
    again[order] = same[:-1] | same[1:]
    return again


def surplus(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row, its values less its distinct values."""
    key = values ^ mix(row.astype(U) + U(1))
    order = np.argsort(key)
    v, r = key[order], row[order]
    return np.bincount(r[1:][v[1:] == v[:-1]], minlength=rows)
