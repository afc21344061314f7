"""Multi-level cell covers of polygons.

A polygon is any number of rings - parts, holes, islands in holes - and a point
is inside if a ray from it crosses their edges an odd number of times.  Its
cover are square cells of sizes ``4 ** j``: cells that no edge touches are
wholly inside (or are dropped), the others hold the edges that decide for the
points in them.  A cell that holds many edges falls apart into 16 smaller ones,
so large parts of a polygon take few cells and few points meet an edge.

Edges to the right of a cell that every ray from it crosses are counted once,
as the cell's parity.  All bounds of cells are exact binary fractions, and a
point is compared with the same edges by the same rule as without a cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import edges_of, odd_crossings, touches

#: Edges up to which a cell is not divided further, and how often a cell may be divided.
FEW_EDGES = 16
DIVISIONS = 4
#: What the edges are to a cell: one touches it, or it lies inside or outside as a whole.
BOUNDARY, INSIDE, OUTSIDE = 0, 1, 2


def size_of(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value`` evaluated once, as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Facts of an edge ``e`` and a cell ``b`` (corners x0, y0, x1, y1, size s).  Slack is more than the rounding of a crossing.
_SLACK = "(abs(e.ax) + abs(e.bx) + abs(b.x1) + b.s) * 1e-12D"
_RIGHT = f"least(e.ax, e.bx) > b.x1 + {_SLACK}"
_SPANS = "least(e.ay, e.by) <= b.y0 AND greatest(e.ay, e.by) > b.y1"
_IN_BAND = f"greatest(e.ay, e.by) >= b.y0 AND least(e.ay, e.by) <= b.y1 AND greatest(e.ax, e.bx) >= b.x0 - {_SLACK}"
_MATTERS = f"{_IN_BAND} AND NOT ({_RIGHT} AND (({_SPANS}) OR e.ay = e.by))"
_SIDES = ", ".join(f"(e.bx - e.ax) * (b.{y} - e.ay) - (e.by - e.ay) * (b.{x} - e.ax)" for x in ("x0", "x1") for y in ("y0", "y1"))
_UNSURE = "(abs(e.bx - e.ax) + abs(e.by - e.ay)) * (abs(b.x0) + abs(b.y0) + abs(e.ax) + abs(e.ay) + b.s) * 1e-12D"
#: An edge does not touch a cell whose corners are all clearly on one side of its line.
_MEETS = f"NOT ({_RIGHT}) AND NOT (least({_SIDES}) > {_UNSURE} OR greatest({_SIDES}) < -({_UNSURE}))"
_CROSSES = "(e.ay > b.y0 + b.s / 2) != (e.by > b.y0 + b.s / 2) AND b.x0 + b.s / 2 < (e.bx - e.ax) * try_divide(b.y0 + b.s / 2 - e.ay, e.by - e.ay) + e.ax"


def _cell(k: str, cx: str, cy: str, edges: str, odd: str) -> str:
    """SQL of a cell with those of its parent's edges that matter in it, its state, and the parity of the others."""
    box = f"named_struct('s', s, 'x0', {cx} * s, 'y0', {cy} * s, 'x1', {cx} * s + s, 'y1', {cy} * s + s)"
    inside = f"({odd_sql('near', _CROSSES)}) != parity"
    state = f"CASE WHEN exists(near, e -> {_MEETS}) THEN {BOUNDARY} WHEN {inside} THEN {INSIDE} ELSE {OUTSIDE} END"
    made = (
        f"named_struct('k', int({k}), 'cx', bigint({cx}), 'cy', bigint({cy}), 'state', state, 'odd', parity, "
        f"'edges', IF(state = {BOUNDARY}, near, slice(near, 1, 0)))"
    )
    flips = f"{odd} != ({odd_sql(edges, f'{_RIGHT} AND {_SPANS}')})"
    body = _let(f"filter({edges}, e -> {_MATTERS})", "near", _let(flips, "parity", _let(state, "state", made)))
    return _let(f"pow(2D, {k})", "s", _let(box, "b", body))


def odd_sql(edges: str, condition: str) -> str:
    return f"size(filter({edges}, e -> coalesce({condition}, false))) % 2 = 1"


def cover(polys: DataFrame, few: int = FEW_EDGES, divisions: int = DIVISIONS) -> DataFrame:
    """Cells ``poly_id, k, cx, cy, inside, odd, edges`` of polygons ``poly_id, rings, xmin, xmax, ymin, ymax``.

    A cell is ``[cx, cx + 1) x [cy, cy + 1)`` times ``2 ** k``.  A polygon starts with at most four cells of the first
    size that is no smaller than its box.  Polygons without a vertex have no cells.
    """
    widest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(2.0**-40))
    start = polys.where(F.col("xmin").isNotNull()).select(
        "poly_id",
        (2 * F.ceil(F.log2(widest) / 2)).cast("int").alias("k"),
        F.flatten(F.transform("rings", edges_of)).alias("edges"),
        "xmin", "xmax", "ymin", "ymax",
    )
    along = lambda axis: f"sequence(floor({axis}min / pow(2D, k)), floor({axis}max / pow(2D, k)))"
    first = f"flatten(transform({along('x')}, i -> transform({along('y')}, j -> {_cell('k', 'i', 'j', 'edges', 'false')})))"
    parts = f"transform(sequence(0, 15), i -> {_cell('(c.k - 2)', '(c.cx * 4 + i % 4)', '(c.cy * 4 + i div 4)', 'c.edges', 'c.odd')})"
    kept = lambda cells: f"filter({cells}, x -> x.state != {OUTSIDE})"
    cells = start.select("poly_id", F.expr(f"explode({kept(first)})").alias("c"))
    for _ in range(divisions):
        settled = f"c.state = {INSIDE} OR size(c.edges) <= {int(few)}"
        cells = cells.select("poly_id", F.expr(f"explode(IF({settled}, array(c), {kept(parts)}))").alias("c"))
    return cells.select("poly_id", "c.k", "c.cx", "c.cy", (F.col("c.state") == INSIDE).alias("inside"), "c.odd", "c.edges")


def holds(x: Column, y: Column) -> Column:
    """Whether a cell (columns ``inside, odd, edges``) says that a point in it is inside the polygon, edges included."""
    edges = F.col("edges")
    return F.col("inside") | (odd_crossings(edges, x, y) != F.col("odd")) | F.exists(edges, lambda e: touches(e, x, y))
