"""Vectorised 64-bit hashing of bytes, words and word sequences, alike on every machine and in every process.

What tells words and passages apart (span_hashes, grams) mixes eight bytes or two halves at a time by bijective, non-linear
steps: there is no power of a base that a patterned text, such as one of Thue and Morse, could cancel out. The polynomial sums of
Prefix, which have that weakness, serve the hashed features of classifiers alone, where a collision costs nothing.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_U = np.uint64
#: Odd multipliers: of the polynomial over bytes, and of the left half of a pair.
BYTE_M, PAIR_M = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Longer spans are hashed one by one.
LONG = 96
#: The ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random value for each byte, so that the polynomial sees no small differences.
BYTES = mix(np.arange(1, 257, dtype=_U) * _U(BYTE_M))


def powers(m: int, n: int) -> np.ndarray:
    out = np.full(n, m, _U)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_KEPT: dict[int, np.ndarray] = {}


def kept_powers(m: int, n: int) -> np.ndarray:
    if m not in _KEPT or len(_KEPT[m]) < n:
        _KEPT[m] = powers(m, max(1 << 16, 1 << (n - 1).bit_length()))
    return _KEPT[m][:n]


def inverse(m: int) -> int:
    return pow(m, -1, 1 << 64)


class Prefix:
    """Prefix sums of a polynomial hash; the hash of any stretch costs a few operations."""

    def __init__(self, values: np.ndarray, m: int):
        n = len(values)
        self.inv = kept_powers(inverse(m), n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * kept_powers(m, n), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k values from each place on; one for each place that has k."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.empty(0, _U)


def bytes_prefix(data: np.ndarray) -> Prefix:
    return Prefix(BYTES[data], BYTE_M)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[0::2], edges[1::2]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end; a view on a copy of data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: The low bytes that count, by their number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, and of their number."""
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(_U) + _U(BYTE_M))
    view = eights(data)
    live, d = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        rest = size[live] - d
        out[live] = mix(out[live] ^ (view[starts[live] + d] & _LOW[np.minimum(rest, 8)]))
        live, d = live[rest > 8], d + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix(left * _U(PAIR_M) + right)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k hashes from each place on; one for each place that has k. Halves are joined pairwise."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out, span = values, 1
    while span * 2 <= k:
        out = join(out[: len(out) - span], out[span:])
        span *= 2
    return out[:n] if span == k else join(out[:n], out[k - span : k - span + n])
