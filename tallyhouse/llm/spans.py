"""64-bit hashes of many spans of one array at once."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class SpanHasher:
    """Polynomial hashes from prefix sums: one pass over the array, then O(1) a span."""

    def __init__(self) -> None:
        self._up = self._down = np.zeros(0, dtype=np.uint64)

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(symbols)
        if len(self._up) < n + 1:
            self._up, self._down = _powers(_ODD, 2 * n + 1), _powers(_INVERSE, 2 * n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(1)) * self._up[:n], dtype=np.uint64, out=prefix[1:])
        sums = (prefix[ends] - prefix[starts]) * self._down[starts]
        return mixed(sums + (ends - starts).astype(np.uint64))
