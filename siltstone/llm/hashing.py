"""Vectorised 64-bit hashing of byte ranges in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (Steele, Lea and Flood)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random number for each byte value; the hash of a range is a polynomial in BASE over these.
BYTES = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
BYTES_2 = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    have = len(_powers["up"])
    if have < n:
        size = max(n, 2 * have)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Prefix:
    """Prefix sums from which the hash of any byte range follows in constant time."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def chunks(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column, as (first row, bytes, row offsets within them), each of about ``most`` bytes or one long row. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
