"""Best-first top-k over one shard of documents: document intervals bounded by range-maximum queries on posting lists."""

from __future__ import annotations

import heapq

import numpy as np

LAST = np.iinfo(np.int64).max  # stands for a null id: behind all others


class Best:
    """The k best (score, id) so far: by score, then by smaller id. Only scores above zero count."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    @property
    def mark(self) -> tuple[int, int]:
        """Score and id of the k-th; what is not better cannot get in."""
        return (int(self.scores[-1]), int(self.ids[-1])) if len(self.scores) == self.k else (0, -LAST - 1)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        score, key = self.mark
        good = (scores > score) | (scores == score) & (ids < key)
        if good.any():
            scores, ids = np.r_[self.scores, scores[good]], np.r_[self.ids, ids[good]]
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


class Shard:
    """Posting lists of a run of documents, each with a sparse table of the places of its range maxima.

    ``ids``: ids of the documents, ascending. Postings come by term and, within one, by document: ``terms`` and ``docs``
    are their numbers, ``impacts`` what they add to a score.
    """

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        self.ids, self.docs, self.impacts = ids, docs, impacts
        self.keys = terms.astype(np.int64) * (len(ids) + 1) + docs
        self.listed, self.starts = np.unique(terms, return_index=True)
        self.ends = np.r_[self.starts[1:], len(terms)]
        longest = int((self.ends - self.starts).max(initial=1))
        # a range that crosses a list's end is never asked for
        self.tables = [np.arange(len(terms), dtype=np.int32)]
        for level in range(longest.bit_length() - 1):
            half, below = 1 << level, self.tables[-1]
            left, right = below[:-half], below[half:]
            table = below.copy()
            table[:-half] = np.where(impacts[right] > impacts[left], right, left)
            self.tables.append(table)
        self.flat = np.concatenate(self.tables)
        self.log = np.zeros(longest + 1, np.int64)
        for level in range(1, longest.bit_length()):
            self.log[1 << level :] = level

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact of each range of postings, the leftmost of equal ones; no range is empty."""
        level = self.log[high - low]
        row = level * len(self.docs)
        left, right = self.flat[row + low], self.flat[row + high - (1 << level)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best, batch: int = 256) -> int:
        """Put the documents that belong among the best into it; the number of documents that were scored.

        An interval of documents is bounded by the sum, over its terms, of the largest impact in it. The intervals with
        the highest bounds are taken, each is split at the document of the largest single share; that document is scored
        and both sides are bounded in turn. It ends when no bound is above the k-th best. Documents are in the order of
        their ids, so of a bound equal to the k-th score only what has a smaller id in front is looked at.
        """
        at = np.searchsorted(self.listed, terms)
        here = np.nonzero((at < len(self.listed)) & (self.listed[np.minimum(at, len(self.listed) - 1)] == terms))[0]
        if not len(here):
            return 0
        term, share = self.listed[at[here]].astype(np.int64) * (len(self.ids) + 1), times[here].astype(np.int64)
        heap: list[tuple] = []
        self._push(heap, best, np.zeros(1, np.int64), np.zeros(len(here), np.int64), np.arange(len(here)), share, self.starts[at[here]], self.ends[at[here]])
        scored, width = 0, 1
        while heap:
            score, key = best.mark
            taken: list[tuple] = []
            while heap and len(taken) < width:
                x = heapq.heappop(heap)
                if -x[0] < score:
                    heap = []
                elif -x[0] > score or self.ids[x[1]] < key:
                    taken.append(x)
            if not taken:
                break
            width = min(2 * width, batch)
            sizes = np.fromiter((len(x[3]) for x in taken), np.int64, len(taken))
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            of = np.repeat(np.arange(len(taken)), sizes)
            t, low, high = (np.concatenate([x[j] for x in taken]) for j in (3, 4, 5))
            split = np.fromiter((x[2] for x in taken), np.int64, len(taken))
            # one look-up for each term gives the split document's share and the border of both sides
            wanted = term[t] + split[of]
            place = np.searchsorted(self.keys, wanted)
            there = self.keys[np.minimum(place, len(self.keys) - 1)] == wanted
            own = np.where(there, self.impacts[np.minimum(place, len(self.keys) - 1)] * share[t], 0)
            best.add(np.add.reduceat(own, first), self.ids[split])
            scored += len(taken)
            after = place + there
            left, right = place > low, high > after
            begin = np.fromiter((x[1] for x in taken), np.int64, len(taken))
            self._push(
                heap, best, np.r_[begin, split + 1], np.r_[of[left], of[right] + len(taken)], np.r_[t[left], t[right]], share,
                np.r_[low[left], after[right]], np.r_[place[left], high[right]])
        return scored

    def _push(
        self, heap: list, best: Best, begin: np.ndarray, of: np.ndarray, t: np.ndarray, share: np.ndarray, low: np.ndarray, high: np.ndarray,
    ) -> None:
        """Bound intervals, given by their terms' ranges of postings, and keep those that may hold a better document."""
        if not len(of):
            return
        top = self.maxima(low, high)
        value = self.impacts[top] * share[t]
        first = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0]
        ends = np.r_[first[1:], len(of)]
        bound = np.add.reduceat(value, first)
        largest = np.repeat(np.maximum.reduceat(value, first), ends - first) == value
        hits = np.nonzero(largest)[0]
        split = self.docs[top[hits[np.searchsorted(hits, first)]]]
        score, key = best.mark
        front = begin[of[first]]  # with the bound it tells intervals apart: they are disjoint
        for k in np.nonzero((bound > score) | (bound == score) & (bound > 0) & (self.ids[front] < key))[0].tolist():
            s = slice(first[k], ends[k])
            heapq.heappush(heap, (-int(bound[k]), int(front[k]), int(split[k]), t[s].copy(), low[s].copy(), high[s].copy()))
