"""Exact integer correlation of many short rows by a number-theoretic transform in NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: 15 * 2**27 + 1, a prime below 2**31: products fit 64 bits, rows may have up to 2**27 numbers.
PRIME = 2013265921
_GENERATOR = 31  # of all residues
_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    # A division by a constant is vectorised, a remainder is not.
    return x - (x // _P) * _P


@lru_cache(maxsize=64)
def _roots(n: int, inverse: bool) -> np.ndarray:
    """The powers 0 to n/2 - 1 of a primitive n-th root of one."""
    root = pow(_GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(max(n // 2, 1), np.uint64)
    filled = 1
    while filled < len(out):
        step = np.uint64(pow(root, filled, PRIME))
        out[filled : 2 * filled] = _mod(out[:filled] * step)
        filled *= 2
    out.setflags(write=False)
    return out


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Transform of each row; the row length is a power of two. The inverse is not scaled."""
    m, length = rows.shape
    roots = _roots(length, inverse)
    n, stride = length, 1
    while n > 1:
        halves = rows.reshape(m, 2, n // 2, stride)
        low, high = halves[:, 0], halves[:, 1]
        out = np.empty((m, n // 2, 2, stride), np.uint64)
        total = low + high
        np.subtract(total, _P, out=total, where=total >= _P)
        out[:, :, 0] = total
        twiddle = roots[:: length // n][: n // 2, None]
        out[:, :, 1] = _mod((low + (_P - high)) * twiddle)
        rows = out.reshape(m, length)
        n, stride = n // 2, stride * 2
    return rows


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For every row and shift d < P, the sum over i < P of (block[i] - window[d + i]) squared.

    Blocks have P whole numbers from 0 on a row, windows 2 P. Numbers are cut into digits so short that all sums stay
    below the prime, and what is summed is the squared difference of the digits: exact, and 0 if and
    only if the block equals the window there.
    """
    m, p = blocks.shape
    top = int(max(blocks.max(initial=0), windows.max(initial=0)))
    need = max(top.bit_length(), 1)
    bits = need
    while bits > 1 and -(-need // bits) * p * ((1 << bits) - 1) ** 2 >= PRIME:
        bits -= 1
    if -(-need // bits) * p * ((1 << bits) - 1) ** 2 >= PRIME:
        raise ValueError("blocks too long for exact sums")
    product = np.zeros((m, 2 * p), np.uint64)
    own = np.zeros(m, np.int64)
    squares = np.zeros((m, 2 * p + 1), np.int64)
    for shift in range(0, need, bits):
        mask = (1 << bits) - 1
        x, y = (blocks >> shift) & mask, (windows >> shift) & mask
        own += (x * x).sum(1)
        squares[:, 1:] += np.cumsum(y * y, 1)
        reversed_block = np.zeros((m, 2 * p), np.uint64)
        reversed_block[:, :p] = x[:, ::-1]
        part = transform(reversed_block) * transform(y.astype(np.uint64))
        product = _mod(product + _mod(part))
    # Cyclic wrap-around reaches the shifts before P - 1 only, which are not used.
    scale = np.uint64(pow(2 * p, PRIME - 2, PRIME))
    cross = _mod(transform(product, inverse=True)[:, p - 1 : 2 * p - 1] * scale).astype(np.int64)
    return own[:, None] + (squares[:, p : 2 * p] - squares[:, :p]) - 2 * cross
