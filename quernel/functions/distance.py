"""Distances between two points given as lists of columns, and bounds of them for boxes.

Every metric is a term for each axis and a way to combine terms. On each axis the term grows with the way from one value to the
other on either side, so the nearest and farthest ends of two intervals bound the term of any two values in them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _most(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def _square(x: Column, y: Column) -> Column:
    return (x - y) * (x - y)


def _gap(x: Column, y: Column) -> Column:
    return F.abs(x - y)


def _ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))


#: For each metric the term of an axis and what makes a distance of the terms.
TERMS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[list[Column]], Column]]] = {
    "euclidean": (_square, lambda t: F.sqrt(_sum(t))), "manhattan": (_gap, _sum), "chebyshev": (_gap, _most), "canberra": (_ratio, _sum),
}


def squared(a: list[Column], b: list[Column]) -> Column:
    return _sum([_square(x, y) for x, y in zip(a, b, strict=True)])


def metric(name: str) -> Callable[[list[Column], list[Column]], Column]:
    if name not in TERMS:
        raise ValueError(f"unknown distance {name!r}; known: {sorted(TERMS)}")
    term, combine = TERMS[name]
    return lambda a, b: combine([term(x, y) for x, y in zip(a, b, strict=True)])


def box_bounds(name: str, a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The least and the largest distance that two points can have, one in each box; a box is a (low, high) for each axis."""
    term, combine = TERMS[name]
    near, far = [], []
    for (al, ah), (bl, bh) in zip(a, b, strict=True):
        near.append(F.when(al > bh, term(al, bh)).when(bl > ah, term(ah, bl)).otherwise(F.lit(0.0)))
        far.append(F.greatest(term(al, bh), term(ah, bl)))
    return combine(near), combine(far)


def grid(name: str, eps: float, parts: int | None = None) -> tuple[Callable[[Column], Column], int]:
    """A cell number for a value on an axis, and a reach: points within eps of each other have numbers that differ by `reach` at
    most on every axis. Without `parts` the reach is 1. With it, points with equal numbers on that many axes, and no others, are
    within eps of each other.

    By Canberra's distance two values are near if their logarithms are; it needs eps < 1, as opposite signs are 1 apart."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    metric(name)
    if name == "canberra" and eps >= 1:
        raise ValueError("canberra needs an eps below 1: opposite signs are 1 apart, whatever the values")
    # a term of e is a difference of 2 atanh(e) between logarithms
    width = lambda e: 2 * math.atanh(e) if name == "canberra" else e
    wide = width(eps) * (1 + 1e-9)
    side = width(eps / {"euclidean": math.sqrt(parts), "chebyshev": 1}.get(name, parts)) * (1 - 1e-9) if parts else wide
    far = 1 << 40

    def cell(x: Column) -> Column:
        if name != "canberra":
            return F.floor(x / side)
        step = F.floor(F.log(F.abs(x)) / side)
        return F.when(x > 0, step + far).when(x < 0, step - far).when(x == 0, F.lit(0).cast("long"))

    return cell, math.ceil(wide / side)


def nearly_equal(a: Column, b: Column, within: float = 1e-10) -> Column:
    return F.abs(a - b) <= within
