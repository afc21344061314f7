"""Projection and polygon predicates as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


@dataclass(frozen=True)
class AlbersParams:
    """Equal-area conic projection.  Defaults are fixed values: Alaska Albers on GRS 1980, metres."""

    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101
    central_meridian: float = -154.0
    parallel_1: float = 55.0
    parallel_2: float = 65.0
    origin: float = 50.0


def _authalic(sin_phi, e: float, log):
    """Authalic ``q`` of a latitude given its sine; works on floats and on columns."""
    return (1 - e * e) * (
        sin_phi / (1 - e * e * sin_phi * sin_phi) - (1 / (2 * e)) * log((1 - e * sin_phi) / (1 + e * sin_phi))
    )


def albers_xy(lon: str | Column, lat: str | Column, p: AlbersParams = AlbersParams()) -> tuple[Column, Column]:
    """Closed-form ellipsoidal Albers: degrees to metres."""
    f = 1 / p.inverse_flattening
    e = math.sqrt(2 * f - f * f)

    def parallel(deg: float) -> tuple[float, float]:
        s, c = math.sin(math.radians(deg)), math.cos(math.radians(deg))
        return c / math.sqrt(1 - e * e * s * s), _authalic(s, e, math.log)

    m1, q1 = parallel(p.parallel_1)
    m2, q2 = parallel(p.parallel_2)
    _, q0 = parallel(p.origin)
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho0 = p.semi_major * math.sqrt(c - n * q0) / n

    q = _authalic(F.sin(F.radians(col(lat))), e, F.ln)
    rho = F.lit(p.semi_major) * F.sqrt(F.lit(c) - n * q) / n
    theta = n * F.radians(col(lon) - p.central_meridian)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed(v: Column) -> Column:
    """Whether a vertex has both coordinates."""
    return v.x.isNotNull() & v.y.isNotNull() & ~F.isnan(v.x) & ~F.isnan(v.y)


def edges_of(ring: str | Column) -> Column:
    """Edges ``struct<ax, ay, bx, by>`` of a ring of ``struct<x, y>`` vertices; its first vertex need not be repeated.

    Vertices that lack a coordinate are left out.
    """

    def closed(v: Column) -> Column:
        rest = F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))
        return F.zip_with(v, rest, lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))

    return let(F.filter(col(ring), placed), closed)


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from a point to larger ``x`` crosses an edge; an edge holds its lower end only."""
    at = (e.bx - e.ax) * F.try_divide(y - e.ay, e.by - e.ay) + e.ax
    return F.coalesce(((e.ay > y) != (e.by > y)) & (x < at), F.lit(False))


def touches(e: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge or vertex."""
    straight = (e.bx - e.ax) * (y - e.ay) == (e.by - e.ay) * (x - e.ax)
    boxed = x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by))
    return F.coalesce(straight & boxed, F.lit(False))


def odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(edges, lambda e: crosses(e, x, y))) % 2 == 1


def in_ring(x: str | Column, y: str | Column, ring: str | Column) -> Column:
    """Even-odd test of a point against a ring; points on an edge or vertex are inside."""
    x, y = col(x), col(y)
    return let(edges_of(ring), lambda edges: odd_crossings(edges, x, y) | F.exists(edges, lambda e: touches(e, x, y)))


def dense_ring(ring: Column, step: float) -> Column:
    """A ring with vertices added so that no edge is longer than ``step`` along either axis."""

    def pieces(e: Column) -> Column:
        dx, dy = e.bx - e.ax, e.by - e.ay
        n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / step)).cast("int")
        return let(n, lambda m: F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct((e.ax + dx * i / m).alias("x"), (e.ay + dy * i / m).alias("y"))))

    return F.flatten(F.transform(edges_of(ring), pieces))


def square_ring(x: str | Column, y: str | Column, half: float) -> Column:
    """Closed ring of the square of side ``2 * half`` around a point."""
    x, y = col(x), col(y)

    def corner(dx: int, dy: int) -> Column:
        return F.struct((x + dx * half).alias("x"), (y + dy * half).alias("y"))

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
