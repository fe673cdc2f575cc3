"""Words of many texts at once: where they lie, and a 64-bit hash of each."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from brigade.llm.arrow_text import mixed

# Letters and digits of ASCII, lower-cased, and every byte beyond ASCII; all else parts words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[: n + 1]


# Scripts without blanks: Thai and Lao, Myanmar, Khmer, kana, Chinese characters and their extensions.
_ALONE = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Per code point: 0 parts words, 1 is inside one (letters, digits), 2 is a word of its own, 3 combines with what is before."""
    kinds = np.fromiter(({"L": 1, "N": 1, "M": 3}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    for low, high in _ALONE:
        own = kinds[low : high + 1]
        own[own == 1] = 2
    return kinds


def _beyond_ascii(data: np.ndarray, inside: np.ndarray, opens: np.ndarray) -> None:
    """Correct where words are and where they open, by the classes of characters beyond ASCII."""
    lead = np.nonzero(data >= 0xC0)[0]
    if not len(lead):
        return
    first = data[lead].astype(np.int64)
    more = 1 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x3F >> more)
    for j in (1, 2, 3):
        has = more >= j
        point[has] = point[has] << 6 | data[lead[has] + j] & 0x3F
    kind = _kinds()[point]
    for j in range(4):
        has = (more >= j) & (kind == 0)
        inside[lead[has] + j] = False
        opens[lead[has] + j + 1] = True
    alone = kind == 2
    opens[lead[alone]] = True
    # marks stay with such a character, whatever else follows opens a word
    end = lead + more + 1
    marked = np.r_[(kind[1:] == 3) & (end[:-1] == lead[1:]), False]
    tail = kind == 3
    for k in np.nonzero(tail)[0]:
        if k and end[k - 1] == lead[k]:
            alone[k] = alone[k - 1]
    opens[end[alone & ~marked]] = True


def find(data: np.ndarray, at: np.ndarray, unicode: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes), their hashes, and the index of each text's first word (len + 1).

    With ``unicode`` words are runs of Unicode letters, digits and combining marks; in scripts without blanks every
    character is a word. Without it every byte beyond ASCII is inside a word.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    low = np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)
    inside = low != 0
    opens = np.ones(n + 1, bool)  # nothing of the word before reaches here
    opens[1:n] = ~inside[:-1]
    if unicode:
        _beyond_ascii(data, inside, opens)
    opens[at[:-1][at[:-1] < n]] = True
    starts = np.nonzero(inside & opens[:-1])[0]
    shuts = opens[1:].copy()  # a new text begins behind
    shuts[:-1] |= ~inside[1:]
    ends = np.nonzero(inside & shuts)[0] + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(low * powers(_BASE, n)[:n], dtype=np.uint64, out=sums[1:])
    own = (sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts]
    hashes = mixed(own + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return starts, ends, hashes, np.searchsorted(starts, at)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words, and the text it is in; a text with fewer words, but not none, is one run."""
    n_words = np.diff(first)
    n_runs = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(len(n_runs)), n_runs)
    begin = np.repeat(first[:-1] - np.r_[0, np.cumsum(n_runs)[:-1]], n_runs) + np.arange(len(text))
    end = first[1:][text]
    total = np.zeros(len(text), np.uint64)
    for j in range(width):
        at = begin + j
        here = at < end
        total = total * np.uint64(0xA24BAED4963EE407) + np.where(here, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(j + 1))
    return mixed(total), text
