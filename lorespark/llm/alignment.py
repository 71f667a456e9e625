"""Edit distance of word sequences inside a band of diagonals.

The band's rows of one column live in the bits of a Python integer and step
down one diagonal a column (Hyyro's bit-vector form of the banded dynamic
programme), so a column costs a few big-integer operations for any band width.
"""

from __future__ import annotations

import numpy as np


def banded_distance(a: list[int], b: list[int], limit: int) -> int:
    """Levenshtein distance if it is at most ``limit``, else ``limit + 1``."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    if not m:
        return n
    if not limit:
        return int(a != b)
    limit = min(limit, n)
    width = 2 * limit + 1
    mask = (1 << width) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << (i + limit)
    up = mask & ~((1 << limit) - 1)  # vertical differences +1 in the rows below row 0
    down = 0
    corner, edge = 1 << (width - 1), 1 << (width - 2)
    dist, hopeless = limit, 2 * limit + m - n
    turn = n - limit
    for j, x in enumerate(b):
        match = (where.get(x, 0) >> j) & mask
        zero = ((((match & up) + up) ^ up) | match | down) & mask
        plus = down | (mask & ~(zero | up))
        minus = zero & up
        if j < turn:
            dist += not zero & corner
        else:
            dist += bool(plus & edge) - bool(minus & edge)
            edge >>= 1
        if dist > hopeless:
            return limit + 1
        shifted = zero >> 1
        up = minus | (mask & ~(shifted | plus))
        down = shifted & plus
    return min(dist, limit + 1)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether ``1 - distance / longer length`` reaches the threshold."""
    longest = max(len(a), len(b))
    limit = int((1 - threshold) * longest + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    short = min(len(a), len(b))
    off = np.flatnonzero(a[:short] != b[:short])
    head = int(off[0]) if len(off) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    if not short:
        return max(len(a), len(b)) <= limit
    off = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(off[0]) if len(off) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= limit
    # words that one side lacks cost an edit each: most unlike pairs end here
    values, counts = np.unique(a, return_counts=True)
    others, their = np.unique(b, return_counts=True)
    _, i, k = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - np.minimum(counts[i], their[k]).sum() > limit:
        return False
    left, right = a.tolist(), b.tolist()
    quick = min(limit, max(8, longest // 24))
    if banded_distance(left, right, quick) <= quick:
        return True
    return quick < limit and banded_distance(left, right, limit) <= limit
