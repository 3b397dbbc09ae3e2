"""Hashes of many ranges of an array at once, by prefix sums of a polynomial modulo 2**64.

Such a polynomial has equal values on certain pairs of long ranges (from 1,024 elements on,
whatever the base), so ranges of LONG elements and more are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 256


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of its bits; one to one."""
    x = x.astype(np.uint64) ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """A polynomial with a fixed odd base; its powers are kept for a worker's life."""

    def __init__(self, base: int):
        self.bases = tuple(np.uint64(b) for b in (base, pow(base, -1, 2**64)))
        self.powers = [np.ones(1, np.uint64) for _ in self.bases]

    def _upto(self, n: int) -> None:
        if len(self.powers[0]) < n:
            for k, base in enumerate(self.bases):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                self.powers[k] = np.multiply.accumulate(steps)

    def of(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of ``values[start:end]`` for each pair; equal ranges have equal hashes."""
        self._upto(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[0][: len(values)], out=sums[1:])
        out = mixed((sums[end] - sums[start]) * self.powers[1][start], 1) + (end - start).astype(np.uint64)
        for k in np.flatnonzero(end - start >= LONG):
            out[k] = xxhash.xxh64_intdigest(values[start[k] : end[k]].tobytes(), int(self.bases[0]))
        return out
