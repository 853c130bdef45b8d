"""Windows on one packed key: few ranges of Z-order numbers that cover a window.

A window of k keys is not one range of the number that interleaves them, but several, with
numbers of other places between them. Cutting the whole space in halves, one bit at a time, a
part wholly inside is one range, a part outside none, and a part that the window cuts is halved
again, the largest first, for as long as the number of ranges allows. So a scan sees a handful of
ranges on one column, each of which a stored table in that order can seek.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_ranges(low: Sequence[int], high: Sequence[int], n_bits: int, most: int = 16) -> list[tuple[int, int]]:
    """At most ``most`` ascending ranges (both ends included) that hold the Z-order number of every place in the window.

    Keys are whole numbers of ``n_bits`` bits, from 0 on; bounds outside are cut off. The first
    key's bits are the highest of each group, as ``bits.interleave`` has them. Ranges are exact if
    ``most`` suffices, else they also hold places outside.
    """
    dims, top = len(low), (1 << n_bits) - 1
    low, high = [max(x, 0) for x in low], [min(x, top) for x in high]
    if most < 1:
        raise ValueError("at least one range is needed")
    if any(a > b for a, b in zip(low, high, strict=True)):
        return []
    done: list[tuple[int, int]] = []
    # parts that the window cuts: (minus their size in bits, first number, lower corner)
    cut = [(-dims * n_bits, 0, (0,) * dims)]
    if all(a == 0 for a in low) and all(b == top for b in high):
        return [(0, (1 << dims * n_bits) - 1)]
    while cut and len(done) + len(cut) < most + 8:
        size, start, corner = heapq.heappop(cut)
        bits = -size - 1
        # the axis whose bit is the highest of the part's numbers, and the width of its halves there
        axis, width = dims - 1 - bits % dims, 1 << bits // dims
        for half in (0, 1):
            at = tuple(c + half * width if d == axis else c for d, c in enumerate(corner))
            spans = [(c, c + (1 << (bits + d) // dims) - 1) for d, c in enumerate(at)]
            first = start + (half << bits)
            if any(b < lo or a > hi for (a, b), lo, hi in zip(spans, low, high, strict=True)):
                continue
            if all(a >= lo and b <= hi for (a, b), lo, hi in zip(spans, low, high, strict=True)):
                done.append((first, first + (1 << bits) - 1))
            else:
                heapq.heappush(cut, (-bits, first, at))
    ranges = sorted(done + [(first, first + (1 << -size) - 1) for size, first, _ in cut])
    joined: list[list[int]] = []
    for a, b in ranges:
        if joined and a == joined[-1][1] + 1:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    while len(joined) > most:
        gaps = [joined[i + 1][0] - joined[i][1] for i in range(len(joined) - 1)]
        i = gaps.index(min(gaps))
        joined[i : i + 2] = [[joined[i][0], joined[i + 1][1]]]
    return [(a, b) for a, b in joined]


def in_ranges(z: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether a number is in any of the ranges: plain comparisons, which a scan can use."""
    return reduce(Column.__or__, [z.between(F.lit(a), F.lit(b)) for a, b in ranges], F.lit(False)) if ranges else F.lit(False)


def inside(z: Column, low: Sequence[int], high: Sequence[int], n_bits: int) -> Column:
    """Whether a Z-order number's keys are inside the window, from the number alone."""
    from cellframe.functions.bits import deinterleave

    keys = deinterleave(z, len(low), n_bits)
    return reduce(Column.__and__, [k.between(F.lit(a), F.lit(b)) for k, a, b in zip(keys, low, high, strict=True)])
