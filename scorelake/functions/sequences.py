"""Edit distance and longest common subsequence of any two sequences, by bit-parallel dynamic programs.

A column of the program's table is one integer, a bit for each item of one sequence, so that a step costs a few operations
on integers of that length; memory grows with one sequence alone.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def _places(items: Sequence[Hashable]) -> dict[Hashable, int]:
    at: dict[Hashable, int] = {}
    bit = 1
    for x in items:
        at[x] = at.get(x, 0) | bit
        bit <<= 1
    return at


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence."""
    at, full = _places(a), (1 << len(a)) - 1
    rising = full
    for x in b:
        met = rising & at.get(x, 0)
        rising = ((rising + met) | (rising - met)) & full
    return len(a) - rising.bit_count()


def edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Unit-cost edit distance."""
    if not a or not b:
        return len(a) + len(b)
    at, full, last = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        same = at.get(x, 0)
        level = (((same & up) + up) ^ up) | same | down
        right, left = (down | ~(level | up)) & full, level & up
        score += bool(right & last) - bool(left & last)
        right = (right << 1 | 1) & full
        up, down = ((left << 1) | ~(level | right)) & full, right & level
    return score
