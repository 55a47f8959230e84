"""Edit distance of two sequences of words, a whole column of the table in a few operations on long integers."""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterator, Sequence


def _places(a: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each word the bits of its places in a."""
    out: dict[Hashable, int] = {}
    bits: dict[Hashable, bytearray] = {}
    size = len(a) // 8 + 1
    for i, w in enumerate(a):
        if w not in bits:
            bits[w] = bytearray(size) if len(bits) < 64 else None
        if bits[w] is None:  # rare words: few bits, so shifting them costs little
            out[w] = out.get(w, 0) | 1 << i
        else:
            bits[w][i >> 3] |= 1 << (i & 7)
    return out | {w: int.from_bytes(b, "little") for w, b in bits.items() if b is not None}


def columns(places: dict, m: int, b: Sequence[Hashable], up: int, down: int) -> Iterator[tuple[int, int, int]]:
    """For each word of b the bits of the rows in which the column's value is one more (up) and one less (down) than in the row above, and the
    change of the last row. Rows are the m words of a; the column before the first one is given."""
    mask, top = (1 << m) - 1, m - 1
    for w in b:
        eq = places.get(w, 0)
        level = eq | down
        same = (((eq & up) + up) ^ up) | eq
        right = (down | ~(same | up)) & mask
        left = up & same
        step = (right >> top & 1) - (left >> top & 1)
        right, left = (right << 1 | 1) & mask, (left << 1) & mask
        up, down = (left | ~(level | right)) & mask, right & level
        yield up, down, step


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """The least number of insertions, deletions and replacements that turn a into b."""
    if len(a) > len(b):
        a, b = b, a  # shorter integers
    if not a:
        return len(b)
    m = len(a)
    return m + sum(step for _, _, step in columns(_places(a), m, b, (1 << m) - 1, 0))


def counts(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int, int]:
    """(insertions, deletions, replacements) of one shortest way from a to b: walked from the end, over a pair of words wherever that is
    on a shortest way, else over a word of a, else over one of b. Memory is that of twice the root of len(b) columns."""
    m, n = len(a), len(b)
    if not m or not n:
        return n, m, 0
    places, step = _places(a), max(1, math.isqrt(n))
    kept = [((1 << m) - 1, 0)]  # columns 0, step, 2 * step, ...
    up, down = kept[0]
    for j, (up, down, _) in enumerate(columns(places, m, b, up, down), 1):
        if j % step == 0:
            kept.append((up, down))
    block, held = -1, []

    def column(j: int) -> tuple[int, int]:
        nonlocal block, held
        if j // step != block:
            block = j // step
            first = block * step
            held = [kept[block], *((u, d) for u, d, _ in columns(places, m, b[first : min(n, first + step - 1)], *kept[block]))]
        return held[j - block * step]

    def value(i: int, c: tuple[int, int], j: int) -> int:
        low = (1 << i) - 1
        return j + (c[0] & low).bit_count() - (c[1] & low).bit_count()

    i, j, added, dropped, replaced = m, n, 0, 0, 0
    here = column(j)
    now = value(i, here, j)
    while i and j:
        before = column(j - 1)
        slant = value(i - 1, before, j - 1)
        if now == slant + (a[i - 1] != b[j - 1]):
            replaced += a[i - 1] != b[j - 1]
            i, j, here, now = i - 1, j - 1, before, slant
        elif here[0] >> (i - 1) & 1:  # one more than in the row above
            dropped, i, now = dropped + 1, i - 1, now - 1
        else:
            added, j, here = added + 1, j - 1, before
            now -= 1
    return added + j, dropped + i, replaced
