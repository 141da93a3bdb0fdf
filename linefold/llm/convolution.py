"""Zero mismatches of blocks in the windows after them, by number-theoretic transforms.

For a block b of L values and a window w, the sums over j of (b_j - w_{t+j})^2 are computed exactly modulo a prime:
the squares by running sums, the products by transforms of 2 L values, for many blocks at once. A sum is 0 where the block occurs.
Codes of more than a few ten thousand values can sum to a multiple of the prime, so callers confirm what they take.
"""

from __future__ import annotations

import numpy as np

#: A prime of the form 15 * 2**27 + 1 and a generator of its units. Products stay under 2**62.
PRIME, GENERATOR, TWOS = 2_013_265_921, 31, 27
P = np.uint64(PRIME)
#: Elements of one array of blocks; more blocks are worked on in parts.
WORK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo the prime, by doubling; ``n`` is a power of two."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % P])
    return out


def root(n: int) -> int:
    """A primitive ``n``-th root of unity."""
    if n > 1 << TWOS:
        raise ValueError(f"no transform of {n} values")
    return pow(GENERATOR, (PRIME - 1) // n, PRIME)


def forward(rows: np.ndarray) -> np.ndarray:
    """Transforms of all rows, in bit-reversed order (decimation in frequency)."""
    n = rows.shape[1]
    while n > 1:
        half = n // 2
        pairs = rows.reshape(-1, 2, half)
        low, high = pairs[:, 0], pairs[:, 1]
        out = np.empty_like(pairs)
        total = low + high
        out[:, 0] = np.minimum(total, total - P)
        out[:, 1] = (low + (P - high)) * powers(root(n), half) % P
        rows, n = out.reshape(rows.shape), half
    return rows


def inverse(rows: np.ndarray) -> np.ndarray:
    """Rows from their bit-reversed transforms (decimation in time)."""
    size, n = rows.shape[1], 2
    while n <= size:
        half = n // 2
        pairs = rows.reshape(-1, 2, half)
        low, high = pairs[:, 0], pairs[:, 1] * powers(pow(root(n), -1, PRIME), half) % P
        out = np.empty_like(pairs)
        total, less = low + high, low + (P - high)
        out[:, 0] = np.minimum(total, total - P)
        out[:, 1] = np.minimum(less, less - P)
        rows, n = out.reshape(rows.shape), n * 2
    return rows * np.uint64(pow(size, -1, PRIME)) % P


def products(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For blocks of L and windows of 2 L values: sums of b_j * w_{t+j} for t = 0 ... L - 1."""
    length = blocks.shape[1]
    padded = np.zeros_like(windows)
    # a block turned round makes the convolution a correlation; value t ends up at place L - 1 + t
    padded[:, :length] = blocks[:, ::-1]
    return inverse(forward(padded) * forward(windows) % P)[:, length - 1 : 2 * length - 1]


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block and its window from t = 0 ... L - 1, modulo the prime."""
    length = blocks.shape[1]
    own = (blocks * blocks % P).sum(axis=1)
    run = np.zeros((len(windows), 2 * length + 1), np.uint64)
    np.cumsum(windows * windows % P, axis=1, out=run[:, 1:])
    theirs = run[:, length : 2 * length] - run[:, :length]
    return (own[:, None] + theirs + (P - products(blocks, windows)) * np.uint64(2)) % P


def zero_mismatches(values: np.ndarray, starts: np.ndarray, length: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) pairs, distance in ahead ... ahead + length - 1, at which the block at ``start`` occurs again.

    ``values`` are codes below the prime; places after their end match nothing.
    """
    found_at, found_distance = [], []
    end = len(values)
    for first in range(0, len(starts), step := max(1, WORK // (2 * length))):
        part = starts[first : first + step]
        places = part[:, None] + ahead + np.arange(2 * length)
        inside = places < end
        windows = np.where(inside, values[np.minimum(places, end - 1)], np.uint64(0))
        blocks = values[part[:, None] + np.arange(length)]
        row, distance = np.nonzero(mismatches(blocks, windows) == 0)
        fits = part[row] + ahead + distance + length <= end
        found_at.append(part[row[fits]])
        found_distance.append(distance[fits] + ahead)
    return np.concatenate([np.zeros(0, np.int64), *found_at]), np.concatenate([np.zeros(0, np.int64), *found_distance])
