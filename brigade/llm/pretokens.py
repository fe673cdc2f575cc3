"""Pre-token boundaries of byte-level BPE by an associative scan, without a regular expression.

The fixed pattern (contractions, letters, digits, other marks, white space, each of the middle three with an
optional leading space) is a finite automaton once every code point knows the class of its successors.
Each code point becomes a transition function; functions compose associatively, so prefixes of all blocks
are composed side by side and the blocks are then combined by doubling.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# Code-point classes.
LETTER, DIGIT, OTHER, BLANK, SPACE, QUOTE = range(6)
# States after a code point: inside letters, digits, other marks, a white-space run; after a leading blank;
# with one or two letters of a contraction to come; at a fresh start.
_L, _N, _O, _W, _P, _C1, _C2, _F = range(8)
# Symbols of the automaton.
_LETTER, _DIGIT, _OTHER, _SHORT, _LONG, _LEAD, _LONE, _RUN = range(8)
# Code points with the White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 256


@cache
def code_classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    classes[WHITE_SPACE] = SPACE
    classes[ord(" ")] = BLANK
    classes[ord("'")] = QUOTE
    return classes


@cache
def _automaton() -> tuple[np.ndarray, bytes, bytes, bytes]:
    """Functions by symbol, and byte tables: composition, action on states, boundaries by (symbol, state)."""
    step = np.empty((8, 8), np.uint8)  # [symbol, state]
    cut = np.ones((8, 8), bool)
    for symbol, state in ((_LETTER, _L), (_DIGIT, _N), (_OTHER, _O), (_SHORT, _C1), (_LONG, _C2), (_LEAD, _P), (_LONE, _F), (_RUN, _W)):
        step[symbol] = state
    for symbol, state, to in (
        (_LETTER, _L, _L), (_LETTER, _P, _L), (_LETTER, _C1, _F), (_LETTER, _C2, _C1),
        (_DIGIT, _N, _N), (_DIGIT, _P, _N),
        (_OTHER, _O, _O), (_OTHER, _P, _O), (_SHORT, _O, _O), (_SHORT, _P, _O), (_LONG, _O, _O), (_LONG, _P, _O),
        (_RUN, _W, _W),
    ):
        step[symbol, state] = to
        cut[symbol, state] = False
    # symbols 8..15: the same at the start of a text, whatever came before
    first = np.repeat(step[:, _F : _F + 1], 8, 1)
    step, cut = np.vstack([step, first]), np.vstack([cut, np.ones((8, 8), bool)])
    known = {tuple(range(8)): 0}  # the identity pads the last block
    queue = list(known)
    generators = [tuple(int(x) for x in row) for row in step]
    while queue:
        f = queue.pop()
        for g in generators:
            made = tuple(g[x] for x in f)
            if made not in known:
                known[made] = len(known)
                queue.append(made)
    functions = list(known)
    assert len(functions) <= 16  # so a pair of functions fits a byte
    compose, act = bytearray(256), bytearray(256)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i << 4 | j] = known[tuple(g[x] for x in f)]
        act[i << 3 : (i << 3) + 8] = bytes(f)
    cuts = bytearray(256)
    cuts[:128] = cut.astype(np.uint8).tobytes()  # [symbol, state]
    return np.array([known[g] for g in generators], np.uint8), bytes(compose), bytes(act), bytes(cuts)


def _looked_up(table: bytes, index: np.ndarray) -> np.ndarray:
    return np.frombuffer(index.tobytes().translate(table), np.uint8)


def _symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``starts`` marks the first code point of each text."""
    n = len(points)
    kind = code_classes()[points]
    ends = np.empty(n, bool)  # the last code point of a text
    ends[:-1] = starts[1:]
    ends[-1] = True
    white = (kind == BLANK) | (kind == SPACE)
    before_ink = np.empty(n, bool)
    before_ink[:-1] = ~white[1:]
    before_ink[-1] = False
    before_ink &= ~ends
    symbol = np.minimum(kind, np.uint8(OTHER))
    symbol[white] = _RUN
    symbol[before_ink & (kind == BLANK)] = _LEAD
    symbol[before_ink & (kind == SPACE)] = _LONE
    quotes = np.nonzero((kind == QUOTE) & ~ends)[0]
    if len(quotes):
        one = points[quotes + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        symbol[quotes[short]] = _SHORT
        rest = quotes[~short]
        rest = rest[(rest + 2 < n)]
        rest = rest[~ends[rest + 1]]
        a, b = points[rest + 1], points[rest + 2]
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[rest[long]] = _LONG
    return symbol + np.uint8(8) * starts


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The state in front of each code point."""
    generators, compose, act, _ = _automaton()
    n = len(symbols)
    blocks = -(-n // BLOCK)
    laid = np.zeros(blocks * BLOCK, np.uint8)
    laid[:n] = generators[symbols]
    laid = np.ascontiguousarray(laid.reshape(blocks, BLOCK).T)
    for j in range(1, BLOCK):
        laid[j] = _looked_up(compose, laid[j - 1] << 4 | laid[j])
    total = laid[-1].copy()
    reach = 1
    while reach < blocks:  # doubling: each block composed with ever more blocks before it
        total[reach:] = _looked_up(compose, total[:-reach] << 4 | total[reach:])
        reach *= 2
    entry = np.full(blocks, _F, np.uint8)
    entry[1:] = _looked_up(act, total[:-1] << 3 | np.uint8(_F))
    before = np.empty((BLOCK, blocks), np.uint8)
    before[0] = entry
    before[1:] = _looked_up(act, laid[:-1] << 3 | entry).reshape(BLOCK - 1, blocks)
    return before.T.reshape(-1)[:n]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which a pre-token starts, over all texts of a piece (texts never share one)."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.nonzero((data & 0xC0) != 0x80)[0]
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    symbols = _symbols(points, starts[at])
    return at[_looked_up(_automaton()[3], symbols << 3 | _states_before(symbols)) == 1]


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The pre-tokens as bytes, and for each text the index of its first one (len + 1 entries)."""
    cuts = boundaries(data, offsets)
    whole = data.tobytes()
    marks = [*cuts.tolist(), len(whole)]
    return [whole[a:b] for a, b in zip(marks, marks[1:])], np.searchsorted(cuts, offsets, "left")
