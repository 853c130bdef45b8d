"""Distance metrics as Column builders, each with the bounding box of its balls.

Terms are added in the order of the dimensions, so results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


class Metric:
    """``distance`` between a point and a centre, and ``box``, the bounding box of a ball."""

    #: Whether distances depend on the gaps on the axes alone and grow with each.
    by_gaps = False

    def distance(self, point: Sequence[Column], center: Sequence[Column]) -> Column:
        raise NotImplementedError

    def box(self, center: Sequence, radius) -> list[tuple] | None:
        """(low, high) on each axis, outside which nothing is within the radius; None if unknown.

        Bounds of numbers are widened by an ulp or so: the exact predicate decides.
        """
        out = []
        for c in center:
            if isinstance(c, Column) or isinstance(radius, Column):
                slack = F.abs(c) * 1e-15 + F.lit(0.0) if isinstance(c, Column) else abs(c) * 1e-15
                out.append((c - radius - slack, c + radius + slack))
            else:
                slack = (abs(c) + abs(radius)) * 1e-15
                out.append((c - radius - slack, c + radius + slack))
        return out


@dataclass(frozen=True)
class L2(Metric):
    """Euclidean, on doubles (integers are cast first); the default."""

    by_gaps = True

    def distance(self, point: Sequence[Column], center: Sequence[Column]) -> Column:
        gaps = [p.cast("double") - c.cast("double") for p, c in zip(point, center, strict=True)]
        return F.sqrt(_sum([g * g for g in gaps]))


@dataclass(frozen=True)
class L1(Metric):
    """Manhattan."""

    by_gaps = True

    def distance(self, point: Sequence[Column], center: Sequence[Column]) -> Column:
        return _sum([F.abs(p.cast("double") - c.cast("double")) for p, c in zip(point, center, strict=True)])


@dataclass(frozen=True)
class Decoded(Metric):
    """Another metric on keys decoded first."""

    encoding: object
    inner: Metric = L2()

    def distance(self, point: Sequence[Column], center: Sequence[Column]) -> Column:
        return self.inner.distance([self.encoding.post(p, d) for d, p in enumerate(point)], center)

    def box(self, center: Sequence, radius) -> list[tuple] | None:
        """The inner metric's box as keys, a step wider on each side: encodings keep the order but may truncate."""
        plain = self.inner.box(center, radius)
        if plain is None or any(isinstance(x, Column) for bounds in plain for x in bounds):
            return None
        keys = [(self.encoding.key(float(a), d), self.encoding.key(float(b), d)) for d, (a, b) in enumerate(plain)]
        return [(max(a - 1, -(1 << 63)), min(b + 1, (1 << 63) - 1)) for a, b in keys]


@dataclass(frozen=True)
class Custom(Metric):
    """A caller's function of (point columns, centre columns) -> Column; no bounding box."""

    function: Callable[[Sequence[Column], Sequence[Column]], Column]

    def distance(self, point: Sequence[Column], center: Sequence[Column]) -> Column:
        return self.function(point, center)

    def box(self, center: Sequence, radius) -> None:
        return None


def edge_distance(low: Sequence[Column], high: Sequence[Column], q_low: Sequence[Column], q_high: Sequence[Column]) -> Column:
    """Euclidean gap between boxes, 0 where they overlap; null if a bound is."""
    gaps = [F.when((ql - h).isNotNull() & (lo - qh).isNotNull(), F.greatest(ql - h, lo - qh, F.lit(0.0))) for lo, h, ql, qh in zip(low, high, q_low, q_high, strict=True)]
    return F.sqrt(_sum([g * g for g in gaps]))


def center_distance(low: Sequence[Column], high: Sequence[Column], q_low: Sequence[Column], q_high: Sequence[Column]) -> Column:
    """Euclidean distance between the centres of boxes."""
    gaps = [((lo - ql) + (h - qh)) / 2 for lo, h, ql, qh in zip(low, high, q_low, q_high, strict=True)]
    return F.sqrt(_sum([g * g for g in gaps]))


BOX_METRICS = {"edge": edge_distance, "center": center_distance}


def box_reach(low: Sequence[Column], high: Sequence[Column], q_low: Sequence[float], q_high: Sequence[float], radius: float) -> list[Column]:
    """What a box within ``radius`` of another by either box metric must meet on each axis.

    The gap between the boxes is at most the radius, and so is that between their centres,
    which lie inside them.
    """
    slack = [radius + (abs(a) + abs(b) + abs(radius)) * 1e-15 for a, b in zip(q_low, q_high, strict=True)]
    return [(lo <= F.lit(b + r)) & (h >= F.lit(a - r)) for lo, h, a, b, r in zip(low, high, q_low, q_high, slack, strict=True)]


def array_l2(point: Column, center: Column) -> Column:
    """Euclidean between array columns of any length, added from the left."""
    squares = F.zip_with(point, center, lambda p, c: (p.cast("double") - c.cast("double")) * (p.cast("double") - c.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
