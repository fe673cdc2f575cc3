"""Suffix sorting in two phases: shallow multikey quicksort, then blind tries for long common prefixes.

Suffixes come as rows of bytes of unequal length, each cut where its text ends. The shallow phase splits all open groups
by one eight-byte character after the other, side by side, up to a fixed depth. Suffixes that still agree are put into
one blind trie per group: it keeps only branching depths and branching bytes, so an insertion compares one full pair.
"""

from __future__ import annotations

import numpy as np

SHALLOW_BYTES = 48


class _Node:
    """An inner node branches at ``depth``; a leaf (no children) holds equal suffixes."""

    __slots__ = ("depth", "children", "held")

    def __init__(self, depth: int, held: int | None = None):
        self.depth = depth
        self.children: dict[int, _Node] = {}
        self.held = [] if held is None else [held]


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share at the front."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order, and the common prefix of each string with the one before it (0 for the first)."""
    root = _Node(len(strings[0]), 0)
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while node.children:  # blind: only branching bytes are looked at
            node = node.children.get(_byte(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node.held[0]]
        shared = _common(s, other)
        if shared == len(s) == len(other):
            node.held.append(i)
            continue
        above, node = None, root
        while node.children and node.depth < shared:
            above, node = node, node.children[_byte(s, node.depth)]
        if node.children and node.depth == shared:
            node.children[_byte(s, shared)] = _Node(len(s), i)
            continue
        fork = _Node(shared)
        fork.held = []
        fork.children = {_byte(other, shared): node, _byte(s, shared): _Node(len(s), i)}
        if above is None:
            root = fork
        else:
            above.children[_byte(s, above.depth)] = fork
    order: list[int] = []
    shared_with_last: list[int] = []
    stack: list[tuple[_Node, int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if node.children:
            low, *rest = sorted(node.children.items())
            stack += [(child, node.depth) for _, child in reversed(rest)]
            stack.append((low[1], shared))
        else:
            order += node.held
            shared_with_last += [shared] + [node.depth] * (len(node.held) - 1)
    return order, shared_with_last


def suffix_array(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows (bytes beyond a row's length are 0), and each one's common prefix with the one before."""
    n, width = rows.shape
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    if n < 2:
        return order, common
    shallow = min(SHALLOW_BYTES, -(-width // 8) * 8)
    padded = np.zeros((n, max(shallow, width)), np.uint8)
    padded[:, :width] = rows
    letters = np.ascontiguousarray(padded[:, :shallow]).view(">u8").astype(np.uint64)
    start = np.zeros(n, np.int64)  # group of each place, named by its first place
    open_ = np.arange(n)  # places whose group has more than one member
    for d in range(shallow // 8):
        who = order[open_]
        by = np.lexsort((np.minimum(lengths[who], 8 * d + 8), letters[who, d], start[open_]))
        order[open_] = who = who[by]
        same = start[open_][1:] == start[open_][:-1]
        a, b = letters[who[:-1], d], letters[who[1:], d]
        a_len, b_len = (np.minimum(lengths[w], 8 * d + 8) for w in (who[:-1], who[1:]))
        split = same & ((a != b) | (a_len != b_len))
        at = np.nonzero(split)[0]
        # leading zero bytes of the difference
        equal = (a[at] ^ b[at]).astype(">u8").view(np.uint8).reshape(-1, 8)
        equal = np.where(equal.any(1), (equal != 0).argmax(1), 8)
        common[open_[at + 1]] = np.minimum(8 * d + equal, np.minimum(a_len[at], b_len[at]))
        opens = np.r_[True, ~same | split]
        start[open_] = np.maximum.accumulate(np.where(opens, open_, 0))
        # a group that has ended, or has one member, is settled
        size = np.bincount(start[open_], minlength=n)
        ended = lengths[who] < 8 * d + 8
        inner = ended & ~opens
        common[open_[inner]] = lengths[who[inner]]
        open_ = open_[(size[start[open_]] > 1) & ~ended]
        if not len(open_):
            return order, common
    firsts = np.nonzero(np.r_[True, np.diff(start[open_]) != 0])[0]
    whole = rows.tobytes()
    for x, y in zip(firsts, [*firsts[1:], len(open_)]):
        who = order[open_[x:y]]
        strings = [whole[i * width + shallow : i * width + int(lengths[i])] for i in who]
        ranked, shared = blind_trie_order(strings)
        order[open_[x:y]] = who[ranked]
        common[open_[x + 1 : y]] = np.array(shared[1:], np.int64) + shallow
    return order, common
