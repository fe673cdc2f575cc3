"""Pair merging of many pre-tokens at once, on ragged arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_NONE = np.int32(2**31 - 1)


class PairMerger:
    """Merges by a table of (left id, right id) -> (rank, id made)."""

    def __init__(self, of_byte: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.of_byte = of_byte.astype(np.int64)
        self.width = np.int64(max(of_byte.max(), made.max(initial=0)) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], rank[order].astype(np.int32), made[order].astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), at

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving ids of all words, one after the other, and how many each word has.

        Every round each word merges all occurrences of its lowest-ranked pair; words without a pair are set aside.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbols), _NONE)  # of the pair that begins here
        slot = np.zeros(len(symbols), np.int64)  # of that pair in the table
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        rank[inner], slot[inner] = self._found(symbols[inner], symbols[inner + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            first = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(owner)])
            done = lowest == _NONE
            if done.any():
                over = np.repeat(done, length)
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                symbols, owner, rank, slot = symbols[~over], owner[~over], rank[~over], slot[~over]
                lowest, length = lowest[~done], length[~done]
                if not len(symbols):
                    break
            hit = np.nonzero(rank == np.repeat(lowest, length))[0]
            # in a run of equal pairs (a a a) every second one overlaps the one before it
            opens = np.r_[True, np.diff(hit) != 1]
            start = np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbols[hit] = self.made[slot[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            symbols, owner, rank, slot = symbols[stay], owner[stay], rank[stay], slot[stay]
            hit = place[hit]
            again = np.r_[hit, hit[hit > 0] - 1]
            rank[again] = _NONE
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            rank[again], slot[again] = self._found(symbols[again], symbols[again + 1])
        if not done_owner:
            return np.zeros(0, np.int64), sizes
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(owner, minlength=len(words))
