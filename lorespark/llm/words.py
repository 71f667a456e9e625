"""Words of a text as 64-bit hashes, computed with numpy a piece at a time.

A word is a maximal run of ASCII letters and digits or of non-ASCII characters
in the lower-cased text.  Word hashes come from one running polynomial sum over
the bytes, so the cost per byte is a few vector operations however many words
there are; texts of any length pass through in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that belong to words: 0-9, a-z (A-Z is lowered before) and all above ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
#: The same words as a pattern for ``re``, on lower-cased text.
WORD_PATTERN = "[0-9a-z\x80-\U0010ffff]+"

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _powers:
        if size > PIECE * 2:
            _powers.pop(max(_powers, default=size), None)
        run = lambda x: np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size - 1, x, np.uint64))))
        _powers[size] = run(_BASE), run(_INVERSE)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(b: np.ndarray, inside: np.ndarray = IS_WORD, size: int = PIECE) -> Iterator[np.ndarray]:
    """Parts of at most about ``size`` bytes, cut where no word is (a longer word stays whole)."""
    lo = 0
    while lo < len(b):
        hi = min(lo + size, len(b))
        if hi < len(b):
            gaps = np.flatnonzero(~inside[b[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                while hi < len(b) and inside[b[hi]]:
                    hi += 1
        yield b[lo:hi]
        lo = hi


def spans(b: np.ndarray, inside: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one piece."""
    flags = np.zeros(len(b) + 2, np.int8)
    flags[1:-1] = inside[b]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lower_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)


def word_hashes(text: str | None) -> np.ndarray:
    """One hash a word, in text order."""
    found = [hash_spans(p, *spans(p)) for p in pieces(lower_bytes(text))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words; none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return mix(out)
