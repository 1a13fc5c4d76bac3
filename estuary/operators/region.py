"""Points in regions of any shape, by an index of cells over the region's edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estuary.session import written

#: So many cells of a row are one block, and crossings are counted by block first.
BLOCK = 4096
#: Of the region's extent: what a point may lie off an edge by rounding alone and still count as on it.
ROUNDING = 1e-12


class Grid:
    """The rectangle over a region's extent, cut to square cells: about as many as edges, three times that at most."""

    def __init__(self, x: float, y: float, wide: float, high: float, edges: int, tolerance: float):
        self.x, self.y, self.tolerance = x - tolerance, y - tolerance, tolerance
        wide, high = wide + 2 * tolerance, high + 2 * tolerance
        self.width = max(math.sqrt(wide * high / edges), wide / edges, high / edges, tolerance) or 1.0
        self.across, self.rows = (max(1, math.ceil(s / self.width)) for s in (wide, high))

    def at(self, value: Column, axis: str) -> Column:
        """The cell number along an axis. The last cell holds the far border."""
        number = F.floor((value - F.lit(getattr(self, axis))) / F.lit(self.width))
        return F.greatest(F.least(number, F.lit((self.across if axis == "x" else self.rows) - 1)), F.lit(0)).cast("int")

    def middle(self, number: Column, axis: str) -> Column:
        return F.lit(getattr(self, axis)) + (number + 0.5) * F.lit(self.width)


def _x_at(y: Column) -> Column:
    """Where an edge that is not level has this height, kept to its ends."""
    held = F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))
    return F.col("x1") + (held - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))


def _spans(y: Column) -> Column:
    """Whether an edge has this height: its lower end does, its upper one does not."""
    return (F.least("y1", "y2") <= y) & (y < F.greatest("y1", "y2"))


def edge_cells(edges: DataFrame, grid: Grid) -> DataFrame:
    """edges with (i, j), one row for each cell that they come within the tolerance of."""
    slack = F.lit(grid.tolerance)
    low, high = grid.at(F.least("y1", "y2") - slack, "y"), grid.at(F.greatest("y1", "y2") + slack, "y")
    rows = edges.withColumn("j", F.explode(F.sequence(low, high)))
    floor = F.lit(grid.y) + F.col("j") * F.lit(grid.width)
    below, above = _x_at(floor - slack), _x_at(floor + F.lit(grid.width) + slack)
    level = F.col("y1") == F.col("y2")
    left = F.when(level, F.least("x1", "x2")).otherwise(F.least(below, above)) - slack
    right = F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(below, above)) + slack
    return rows.withColumn("i", F.explode(F.sequence(grid.at(left, "x"), grid.at(right, "x"))))


def _ahead(x: Column, y: Column) -> Column:
    """Whether an edge crosses the ray from the point to the right. Beside the edge's extent its ends alone decide."""
    held = F.least(F.greatest(_x_at(y), F.least("x1", "x2")), F.greatest("x1", "x2"))
    return F.coalesce(_spans(y) & (x < held), F.lit(False))


def cell_sides(edges: DataFrame, grid: Grid) -> DataFrame:
    """(i, j, in): whether each cell's middle lies inside the region, for all cells of the grid.

    The edges' crossings of a row's middle height are counted from the left, those of whole blocks of cells first.
    """
    each = F.col("id")
    cells = edges.sparkSession.range(grid.across * grid.rows).select((each % grid.across).cast("int").alias("i"), F.floor(each / grid.across).cast("int").alias("j"))
    rows = F.sequence(grid.at(F.least("y1", "y2"), "y"), grid.at(F.greatest("y1", "y2"), "y"))
    height = grid.middle(F.col("j"), "y")
    met = edges.where("y1 <> y2").withColumn("j", F.explode(rows)).where(_spans(height))
    # the first cell whose middle is not left of the crossing; there may be none
    crossing = F.least(F.greatest(_x_at(height), F.least("x1", "x2")), F.greatest("x1", "x2"))
    near = grid.at(crossing, "x")
    first = near + (grid.middle(near, "x") < crossing).cast("int")
    crossed = met.select(first.alias("i"), "j").groupBy("i", "j").agg(F.count("*").alias("n"))
    both = cells.select("i", "j", F.lit(0).cast("long").alias("n"), F.lit(True).alias("cell")).unionByName(crossed.select("i", "j", "n", F.lit(False).alias("cell")))
    both = both.withColumn("block", F.floor(F.col("i") / BLOCK).cast("int"))
    sums = crossed.groupBy("j", F.floor(F.col("i") / BLOCK).cast("int").alias("block")).agg(F.sum("n").alias("n"))
    blocks = cells.where(F.col("i") % BLOCK == 0).select("j", F.floor(F.col("i") / BLOCK).cast("int").alias("block")).join(sums, ["j", "block"], "left")
    left = Window.partitionBy("j").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("j", "block", F.coalesce(F.sum("n").over(left), F.lit(0)).alias("left"))
    within = Window.partitionBy("j", "block").orderBy("i", "cell").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("own", F.sum("n").over(within)).where("cell").join(blocks, ["j", "block"])
    return counted.select("i", "j", ((F.col("left") + F.col("own")) % 2 == 1).alias("in"))


def _turns(grid: Grid) -> Column:
    """Whether an edge parts the point (px, py) from the middle of its cell (i, j).

    The way goes level from the point to the middle's x, then upright to the middle. Of an edge that has this x, the
    upright part tells the side it passes the middle on from that it passes the corner on, so whether it crosses left or
    right of the corner cancels out, and rounding there changes nothing.
    """
    x, y = grid.middle(F.col("i"), "x"), grid.middle(F.col("j"), "y")
    py, low, high = F.col("py"), F.least("y1", "y2"), F.greatest("y1", "y2")
    ahead = F.coalesce(_spans(py) & (F.col("px") < _x_at(py)), F.lit(False))
    upright = (F.least("x1", "x2") <= x) & (x < F.greatest("x1", "x2"))
    rising = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) > 0
    above = F.when(_spans(y), _ahead(x, y) == rising).otherwise(y >= high)
    beside = ahead != (_spans(py) & (F.least("x1", "x2") > x))
    return F.when(~upright, beside).when(_spans(py), (ahead == rising) != above).otherwise((py >= high) != above)


def edge_distance() -> Column:
    """From (px, py) to the nearest point of the edge."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    along = ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / F.nullif(size, F.lit(0.0))
    t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.hypot(F.col("px") - F.col("x1") - t * dx, F.col("py") - F.col("y1") - t * dy)


def points_in_region(points: DataFrame, ring_edges: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Points (x, y and any columns) inside a region of edges (x1, y1, x2, y2); edges of holes count alike.

    The edges form closed rings, in any order and direction. With a tolerance, in the unit of the coordinates, points as
    near to an edge as that are inside, and with 0 those on an edge, whichever side of the region it bounds. Without, a
    point on an edge is inside if the parity of the edges that a ray to the right crosses says so: left and lower edges
    in, right and upper ones out.

    Of each cell it is known whether its middle lies inside. A point meets its cell by equality and then only the edges
    that come near that cell: it is inside if the middle is, but for the edges between the two. The cells follow the
    region's extent and number of edges, whatever the unit and however long and narrow the region. Points without
    coordinates are outside, repeated ones come back as often as they came. No edges, or no points: no rows.
    """
    sides = ring_edges.select(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    edges = written(sides, "region-edges")
    ends = edges.agg(
        F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2")), F.count("*")
    ).first()
    if not ends[4]:
        return points.limit(0)
    wide, high = ends[2] - ends[0], ends[3] - ends[1]
    reach = (tolerance or 0.0) + ROUNDING * (max(wide, high) + max(map(abs, ends[:4])))
    grid = Grid(ends[0], ends[1], wide, high, ends[4], reach)
    near_edges = written(edge_cells(edges, grid), "region-border")
    border = near_edges.select("i", "j").distinct().withColumn("border", F.lit(True))
    index = written(cell_sides(edges, grid).join(border, ["i", "j"], "left").where("in or border"), "region-cells")
    spots = points.select(F.struct(*points.columns).alias("point"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    over = F.lit(reach)
    near = spots.where(F.col("px").between(F.lit(ends[0]) - over, F.lit(ends[2]) + over) & F.col("py").between(F.lit(ends[1]) - over, F.lit(ends[3]) + over))
    placed = near.withColumns({"i": grid.at(F.col("px"), "x"), "j": grid.at(F.col("py"), "y")}).join(index, ["i", "j"])
    inside = placed.where("border is null").select("point.*")
    asked = placed.where("border").withColumn("row", F.monotonically_increasing_id())
    odd = F.sum(_turns(grid).cast("int")) % 2 == 1
    held = F.first("in") != odd
    if tolerance is not None:
        held = held | (F.min(edge_distance()) <= reach)
    met = asked.select("row", "point", "px", "py", "i", "j", "in").join(near_edges, ["i", "j"])
    return inside.unionByName(met.groupBy("row").agg(F.first("point").alias("point"), held.alias("held")).where("held").select("point.*"))
