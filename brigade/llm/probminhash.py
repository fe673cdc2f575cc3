"""ProbMinHash signatures of weighted shingles, and the probability Jaccard similarity itself.

A shingle of weight w sends out arrivals as a Poisson process of rate w; each arrival falls into a random register,
which keeps the shingle that arrived first. Two documents agree in a register with the probability Jaccard similarity.
A shingle stops once its next arrival is later than every register's first one.
"""

from __future__ import annotations

import numpy as np

from brigade.llm.arrow_text import mixed

REGISTERS = 240
ROWS = 6  # registers in a band
BANDS = REGISTERS // ROWS
_TOP = np.uint64((1 << 48) - 1)


def multisets(runs: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted shingle ids (48 bits) of each of n texts, repeated ones as often as they occur."""
    key = np.sort(text.astype(np.uint64) << np.uint64(48) | runs & _TOP)
    return np.split(key & _TOP, np.searchsorted(key, np.arange(1, n, dtype=np.uint64) << np.uint64(48)))


def signatures(runs: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) ids of the first arrivals; rows of texts without a shingle stay 0."""
    assert n <= 1 << 16
    key = np.sort(text.astype(np.uint64) << np.uint64(48) | runs & _TOP)
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.nonzero(first)[0]
    weight = np.diff(np.r_[at, len(key)]).astype(np.float64)
    key = key[at]
    base = (key >> np.uint64(48)).astype(np.int64) * REGISTERS
    shingle = key & _TOP
    seed = mixed(shingle + np.uint64(0x632BE59BD9B4E019))
    clock = np.zeros(len(key))
    earliest = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    turn = 0
    while len(base):
        turn += 1
        draw = mixed(seed + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        # the upper 53 bits give the waiting time, the lower 11 the register
        clock = clock - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight
        register = base + ((draw & np.uint64(0x7FF)) * np.uint64(REGISTERS) >> np.uint64(11)).astype(np.int64)
        sooner = clock < earliest[register]
        hit, when = register[sooner], clock[sooner]
        np.minimum.at(earliest, hit, when)
        won = earliest[hit] == when
        winner[hit[won]] = shingle[sooner][won]
        latest = earliest.reshape(n, REGISTERS).max(1)
        going = clock < latest[base // REGISTERS]
        base, shingle, seed, clock, weight = base[going], shingle[going], seed[going], clock[going], weight[going]
    return winner.reshape(n, REGISTERS)


def band_keys(winners: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys, each over the registers of one band."""
    laid = winners.reshape(len(winners), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), laid.shape[:2]).copy()
    for j in range(ROWS):
        total = total * np.uint64(0xA24BAED4963EE407) + laid[:, :, j]
    return mixed(total).view(np.int64)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum over shared d of 1 / sum over d' of max(a[d'] / a[d], b[d'] / b[d]), from two sorted multisets."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(places[: len(a)], minlength=len(ids)).astype(np.float64)
    y = np.bincount(places[len(a) :], minlength=len(ids)).astype(np.float64)
    if x.max(initial=0) == 1 == y.max(initial=0):
        return float(np.sum((x > 0) & (y > 0))) / len(ids) if len(ids) else 0.0
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.r_[0.0, np.cumsum(y)]  # y over the ids of a lower ratio
    above = np.r_[0.0, np.cumsum(x[::-1])][::-1]  # x from here on
    both = (x > 0) & (y > 0)
    at = np.searchsorted(ratio, ratio[both], "left")
    return float(np.sum(1.0 / (above[at] / x[both] + below[at] / y[both])))
