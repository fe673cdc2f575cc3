"""The size-checked join of this subpackage: its driver holds little, so little is broadcast."""

from collections.abc import Iterable
from functools import partial

from brigade.operators import spread

# Measured size up to which a side is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 8 << 20
attach = partial(spread.attach, broadcast_bytes=BROADCAST_BYTES)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no column has yet, whatever its case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name
