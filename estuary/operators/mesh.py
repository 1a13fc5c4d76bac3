"""Triangular meshes as tables: nodes (node_id, x, y, h) and elements (ele_id, n1, n2, n3), ids from 1.

Slot i of an element (0, 1, 2) is the edge opposite its vertex i. A neighbour of 0 is the mesh boundary. Mesh tables
are small against fields, so joins with them are left to the optimizer, which broadcasts what is under its limit.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estuary.operators.extraction import per_vertex, vertices
from estuary.operators.region import points_in_region
from estuary.session import written


def element_centers(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(ele_id, x, y, h): the means over the three vertices."""
    return per_vertex(elements, nodes, ["x", "y", "h"]).groupBy("ele_id").agg(*(F.avg(c).alias(c) for c in ("x", "y", "h")))


def edges(elements: DataFrame) -> DataFrame:
    """(ele_id, slot, a, b) with a < b: three edges an element."""
    pairs = F.array(*(F.struct(F.lit(i).alias("slot"), F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for i, (p, q) in enumerate((("n2", "n3"), ("n1", "n3"), ("n1", "n2")))))
    return elements.select("ele_id", F.explode(pairs).alias("e")).select("ele_id", "e.slot", "e.a", "e.b")


def element_neighbors(elements: DataFrame) -> DataFrame:
    """(ele_id, slot, nei_id): the other element at each edge, or 0. An edge has two owners at most, so one grouping finds both."""
    owners = edges(elements).groupBy("a", "b").agg(F.collect_list(F.struct("ele_id", "slot")).alias("o"))
    other = lambda i, j: F.struct(F.col("o")[i]["ele_id"].alias("ele_id"), F.col("o")[i]["slot"].alias("slot"), F.coalesce(F.get("o", F.lit(j))["ele_id"], F.lit(0)).alias("nei_id"))
    both = F.when(F.size("o") > 1, F.array(other(0, 1), other(1, 0))).otherwise(F.array(other(0, 1)))
    return owners.select(F.explode(both).alias("n")).select("n.ele_id", "n.slot", "n.nei_id")


def boundary_edges(elements: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Edges with one owner: the outline of the mesh, or with parts (ele_id, part) of each part."""
    keys, owned = ["a", "b"], edges(elements)
    if parts is not None:
        keys, owned = ["part", "a", "b"], owned.join(parts, "ele_id")
    return owned.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").drop("n")


def node_neighbors(elements: DataFrame) -> DataFrame:
    """(node_id, nei_id): nodes joined by an edge, both ways, each once."""
    pairs = F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("nei_id")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("nei_id")))
    return edges(elements).select("a", "b").distinct().select(F.explode(pairs).alias("p")).select("p.node_id", "p.nei_id")


def distance(pairs: DataFrame, points: DataFrame, a: str, b: str, key: str, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """pairs with dist, the Euclidean distance over the axes of the points that a and b name."""
    side = lambda c, tag: points.select(F.col(key).alias(c), *(F.col(x).alias(f"{x}_{tag}") for x in axes))
    squares = [F.pow(F.col(f"{x}_a") - F.col(f"{x}_b"), 2) for x in axes]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return pairs.join(side(a, "a"), a).join(side(b, "b"), b).withColumn("dist", F.sqrt(total)).drop(*(f"{x}_{t}" for x in axes for t in "ab"))


def element_area(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(ele_id, area) by the shoelace formula."""
    corner = F.collect_list(F.struct("slot", "x", "y"))
    p = per_vertex(elements, nodes, ["x", "y"]).groupBy("ele_id").agg(F.sort_array(corner).alias("p"))
    at = lambda i, c: F.col("p")[i][c]
    cross = (at(1, "x") - at(0, "x")) * (at(2, "y") - at(0, "y")) - (at(2, "x") - at(0, "x")) * (at(1, "y") - at(0, "y"))
    return p.select("ele_id", (F.abs(cross) / 2).alias("area"))


def node_area(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(node_id, area) of the control polygon of each node: a third of its elements."""
    owned = vertices(elements).join(element_area(nodes, elements), "ele_id")
    return owned.groupBy("node_id").agg((F.sum("area") / 3).alias("area"))


def node_polygon(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(node_id, ring): the control polygon's corners, centroids and edge middles by angle around the node; the node itself too on the boundary."""
    centre = element_centers(nodes, elements).select("ele_id", "x", "y")
    own = nodes.select("node_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    centroids = vertices(elements).join(centre, "ele_id").select("node_id", "x", "y")
    ends = nodes.select(F.col("node_id").alias("nei_id"), F.col("x").alias("xn"), F.col("y").alias("yn"))
    middles = node_neighbors(elements).join(own, "node_id").join(ends, "nei_id").select("node_id", ((F.col("x0") + F.col("xn")) / 2).alias("x"), ((F.col("y0") + F.col("yn")) / 2).alias("y"))
    rim = boundary_edges(elements).select(F.explode(F.array("a", "b")).alias("node_id")).distinct().join(own, "node_id").select("node_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    every = centroids.unionByName(middles).unionByName(rim).join(own, "node_id")
    angle = F.atan2(F.col("y") - F.col("y0"), F.col("x") - F.col("x0"))
    return every.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct(angle.alias("angle"), "x", "y"))).alias("ring"))


def node_to_element(field: DataFrame, elements: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Element values: the mean of the three vertices, for each time and layer. The explode comes before the one shuffle, which sums within tasks first."""
    return vertices(elements).join(field, "node_id").groupBy(*keys, "ele_id").agg(*(F.avg(c).alias(c) for c in values))


def gradient_weights(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(ele_id, slot, nei_id, wx, wy): weights whose sums over neighbour differences are the x and y slopes of a least-squares plane.

    A boundary edge stands for a neighbour at its middle. All offsets are taken from the element's own centre.
    """
    centre = element_centers(nodes, elements).select("ele_id", "x", "y")
    around = element_neighbors(elements).join(edges(elements), ["ele_id", "slot"])
    nei = centre.select(F.col("ele_id").alias("nei_id"), F.col("x").alias("xn"), F.col("y").alias("yn"))
    corner = lambda c: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"))
    placed = around.join(centre, "ele_id").join(nei, "nei_id", "left").join(corner("a"), "a").join(corner("b"), "b")
    at = lambda axis: F.coalesce(f"{axis}n", (F.col(f"{axis}a") + F.col(f"{axis}b")) / 2) - F.col(axis)
    offsets = placed.select("ele_id", "slot", "nei_id", at("x").alias("dx"), at("y").alias("dy"))
    sums = offsets.groupBy("ele_id").agg(F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dy") * F.col("dy")).alias("syy"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    wx = (F.col("syy") * F.col("dx") - F.col("sxy") * F.col("dy")) / det
    wy = (F.col("sxx") * F.col("dy") - F.col("sxy") * F.col("dx")) / det
    return offsets.join(sums, "ele_id").select("ele_id", "slot", "nei_id", wx.alias("wx"), wy.alias("wy"))


def velocity_slopes(flow: DataFrame, weights: DataFrame, keys: list[str], walls: bool = True) -> DataFrame:
    """(keys, ele_id, u_x, u_y, v_x, v_y): least-squares slopes of the velocity; with walls, it is zero beyond a boundary edge.

    A slope is the sum of weight times (neighbour less own value). Each element sends its weighted values to its
    neighbours, three at most, and its own value to itself, so the field joins the small mesh only and is grouped once.
    A neighbour that lacks leaves its term out.
    """
    used = weights if walls else weights.where("nei_id <> 0")
    beyond = lambda w, axis: F.when(F.col("nei_id") == 0, F.col(w)).alias(f"wall_{axis}")
    nothing = [F.lit(None).cast("double").alias(f"wall_{axis}") for axis in "xy"]
    out = F.struct(F.col("ele_id").alias("to"), "wx", "wy")
    ends = F.array(
        F.struct(F.col("ele_id").alias("e"), F.lit(True).alias("own"), beyond("wx", "x"), beyond("wy", "y"), F.when(F.lit(False), out).alias("sent")),
        F.struct(F.col("nei_id").alias("e"), F.lit(None).cast("boolean").alias("own"), *nothing, F.when(F.lit(True), out).alias("sent")),
    )
    each = used.select(F.explode(ends).alias("p")).select("p.*").where("e <> 0")
    mesh = each.groupBy(F.col("e").alias("ele_id")).agg(F.max("own").alias("own"), F.sum("wall_x").alias("wall_x"), F.sum("wall_y").alias("wall_y"), F.collect_list("sent").alias("sent"))
    none = F.lit(None).cast("double")
    itself = F.array(F.struct(F.col("ele_id").alias("to"), none.alias("wx"), none.alias("wy")))
    rows = flow.join(mesh, "ele_id").select(*keys, "ele_id", "u", "v", "own", "wall_x", "wall_y", F.explode(F.concat(itself, "sent")).alias("s"))
    here = F.col("s.to") == F.col("ele_id")
    parts = [F.max(F.when(here, F.col("own"))).alias("own"), *(F.max(F.when(here, F.col(c))).alias(c) for c in ("u", "v", "wall_x", "wall_y"))]
    for c in "uv":
        for axis in "xy":
            w = F.col(f"s.w{axis}")
            parts += [F.sum(F.when(~here, w * F.col(c))).alias(f"{c}_{axis}"), F.sum(F.when(~here & F.col(c).isNotNull(), w)).alias(f"w_{c}_{axis}")]
    sums = rows.groupBy(*keys, F.col("s.to").alias("ele_id")).agg(*parts).where("own")
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def slope(c: str, axis: str) -> Column:
        near, wall = f"w_{c}_{axis}", f"wall_{axis}"
        return F.when(F.coalesce(near, wall).isNotNull(), zero(f"{c}_{axis}") - F.col(c) * (zero(near) + zero(wall))).alias(f"{c}_{axis}")

    return sums.select(*keys, "ele_id", *(slope(c, axis) for c in "uv" for axis in "xy"))


def vorticity(flow: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ele_id, vorticity): the slope of v along x less that of u along y."""
    return velocity_slopes(flow, weights, keys).select(*keys, "ele_id", (F.col("v_x") - F.col("u_y")).alias("vorticity"))


def layer_volume(nodes: DataFrame, elements: DataFrame, sigma: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """(node_id, layer, volume): area * dz * h, and with a surface (its keys, node_id, zeta) times 1 + zeta / h."""
    cells = node_area(nodes, elements).join(nodes.select("node_id", "h"), "node_id").join(sigma.select("layer", "dz"), how="cross")
    still = cells.withColumn("volume", F.col("area") * F.col("dz") * F.col("h"))
    if surface is None:
        return still.select("node_id", "layer", "volume")
    return surface.join(still, "node_id").withColumn("volume", F.col("volume") * (1 + F.col("zeta") / F.col("h"))).drop("area", "dz", "h")


#: A tile of the mesh, which one task searches as a whole, has so many times 4,096 elements.
BUCKET = 8


def mesh_tiles(centres: DataFrame) -> DataFrame:
    """(ele_id, tile): elements in tiles of like size that lie together, by ranges of x and within these of y."""
    n, x0, x1, y0, y1 = centres.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    parts = max(1, math.ceil(n / (BUCKET * 4096)))
    wide = max(1, min(parts, round(math.sqrt(parts * (x1 - x0) / (y1 - y0))) if n and y1 > y0 else parts))
    high = math.ceil(parts / wide)
    tiles = centres.repartitionByRange(wide, "x").select("ele_id", "y", F.spark_partition_id().alias("tile"))
    if high > 1:
        strips = written(tiles, "path-strips")
        cuts = strips.groupBy("tile").agg(F.percentile_approx("y", [k / high for k in range(1, high)]).alias("cuts"))
        tiles = strips.join(cuts, "tile").withColumn("tile", F.col("tile") * high + F.size(F.filter("cuts", lambda c: c < F.col("y"))))
    tiles = tiles.select("ele_id", "tile")
    return written(tiles, "path-tiles")


def _search(front: pd.DataFrame, links: pd.DataFrame) -> dict[int, tuple[float, int, int]]:
    """Least (cost, hops, prev) of the elements that a tile's links reach from its front, those just beyond the tile among them."""
    around: dict[int, list[tuple[int, float]]] = {}
    for src, dst, dist in zip(links["src"].tolist(), links["dst"].tolist(), links["dist"].tolist(), strict=True):
        around.setdefault(src, []).append((dst, dist))
    best: dict[int, tuple[float, int, int]] = {}
    heap = list(zip(*(front[c].tolist() for c in ("cost", "hops", "prev", "ele_id")), strict=True))
    heapq.heapify(heap)
    while heap:
        cost, hops, prev, e = heapq.heappop(heap)
        if e not in best:
            best[e] = cost, hops, prev
            for dst, dist in around.get(e, ()):
                if dst not in best:
                    heapq.heappush(heap, (cost + dist, hops + 1, e, dst))
    return best


def cheapest(legs: DataFrame, links: DataFrame, keys: list[str], rounds_at_once: int = 4, tiles: DataFrame | None = None) -> DataFrame:
    """(keys, ele_id, cost, prev): the least costs from each leg's start, up to its goal's cost, by tiles of the mesh.

    legs: keys, start, goal. tiles: ele_id, tile (default: by ranges of ids). A tile is searched as a whole in one task
    and sends the costs of the elements just beyond it to their tiles; one that has been sent a lower cost is searched
    again, until none is. Only these costs are kept, so rounds follow the tiles from end to end, not the elements. Every
    rounds_at_once rounds, what costs as much as a known way to the goal is taken out of the search. Costs are sums from the start on; of equal ones that with
    the fewest elements counts, then the smallest element before.
    """
    if tiles is None:
        ids = links.select(F.explode(F.array("src", "dst")).alias("ele_id")).union(legs.select(F.explode(F.array("start", "goal")))).distinct()
        tiles = ids.select("ele_id", F.floor(F.col("ele_id") / (BUCKET * 4096)).cast("int").alias("tile"))
    tiles = tiles.select("ele_id", F.col("tile").cast("int").alias("tile"))
    far = tiles.select(F.col("ele_id").alias("dst"), F.col("tile").alias("far"))
    placed = links.join(tiles.withColumnRenamed("ele_id", "src"), "src").join(far, "dst")
    placed = written(placed.select("tile", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("dist").cast("double"), "far"), "path-links")
    ends = written(legs.select(*keys, F.col("start").cast("long").alias("ele_id"), F.col("goal").cast("long").alias("goal")).join(tiles, "ele_id"), "path-ends")
    key, group = [*keys, "ele_id"], [*keys, "tile"]
    kept = ["tile", "cost", "hops", "prev", "fresh"]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ends.select(*keys).schema)
    sent_type = f"{typed}, ele_id long, tile int, cost double, hops long, prev long, fresh boolean"
    goals = ends.select(*keys, "goal")

    def send(named: tuple, front: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        best, beyond, here = _search(front, own), dict(zip(own["dst"].tolist(), own["far"].tolist(), strict=True)), named[-1]
        goal = int(front["goal"].iloc[0])
        rows = [(*named[:-1], e, t, *best[e], True) for e, t in beyond.items() if t != here and e in best]
        if goal in best and beyond.get(goal, here) == here:
            rows.append((*named[:-1], goal, here, *best[goal], False))
        return pd.DataFrame(rows, columns=[*key, *kept])

    def settle(named: tuple, front: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        best, beyond, here = _search(front, own), dict(zip(own["dst"].tolist(), own["far"].tolist(), strict=True)), named[-1]
        most = front["bound"].iloc[0]
        rows = [(*named[:-1], e, c, p) for e, (c, _, p) in best.items() if beyond.get(e, here) == here and not c > most]
        return pd.DataFrame(rows, columns=[*key, "cost", "prev"])

    def searched(front: DataFrame, asked: DataFrame, task, returns: str) -> DataFrame:
        """task over the fronts and links of the tiles asked for."""
        asked = asked.select(*group).distinct()
        mine, own = front.join(asked, group, "left_semi").join(goals, keys), asked.join(placed, "tile")
        # new names of columns, as both sides come from one table
        mine, own = (df.toDF(*df.columns).groupBy(*group) for df in (mine, own))
        return mine.cogroup(own).applyInPandas(task, returns)

    def bounded(front: DataFrame) -> DataFrame:
        ways = front.join(goals.withColumnRenamed("goal", "ele_id"), key).select(*keys, F.col("cost").alias("bound"))
        return front.join(ways, keys, "left")

    none = F.lit(0).cast("long")
    front = ends.select(*key, "tile", F.lit(0.0).alias("cost"), none.alias("hops"), none.alias("prev"), F.lit(True).alias("fresh"))
    front = written(front, "path-front")
    rounds = 0
    while not front.where("fresh").isEmpty():
        sent = searched(front, front.where("fresh"), send, sent_type)
        rows = front.withColumn("fresh", F.lit(False)).unionByName(sent)
        least = rows.groupBy(*key, "tile").agg(F.min(F.struct("cost", "hops", "prev", "fresh")).alias("m"))
        front, rounds = written(least.select(*key, "tile", "m.*"), "path-front"), rounds + 1
        if rounds % rounds_at_once == 0:
            followed = F.col("fresh") & ~F.coalesce(F.col("cost") >= F.col("bound"), F.lit(False))
            front = written(bounded(front).withColumn("fresh", followed).drop("bound"), "path-front")
    return written(searched(bounded(front), front, settle, f"{typed}, ele_id long, cost double, prev long"), "path-costs")


def section_paths(nodes: DataFrame, elements: DataFrame, waypoints: DataFrame, reverse: bool = False, rounds_at_once: int = 4) -> DataFrame:
    """(section, seq, ele_id): each section's element path through its waypoints in order, with the least sum of centre distances.

    waypoints: section, seq, ele_id; two at least in a section. Each pair of neighbours is a leg, and all legs are
    searched at once (see cheapest). Paths are read back from the goals by joins on the
    written predecessors, twice as far each round. An element where two legs meet stands once.
    """
    leg = ["section", "leg"]
    order = Window.partitionBy("section").orderBy("seq")
    pairs = waypoints.select("section", F.row_number().over(order).alias("leg"), F.col("ele_id").alias("start"), F.lead("ele_id").over(order).alias("goal"))
    if short := pairs.groupBy("section").agg(F.count("*").alias("n")).where("n < 2").first():
        raise ValueError(f"section {short.section} has a single waypoint")
    legs = written(pairs.where("goal IS NOT NULL"), "path-legs")
    links = element_neighbors(elements).where("nei_id <> 0").select(F.col("ele_id").alias("src"), F.col("nei_id").alias("dst"))
    centres = written(element_centers(nodes, elements).select("ele_id", "x", "y"), "path-centres")
    links = distance(links, centres, "src", "dst", "ele_id")
    inside = legs.join(elements.select(F.col("ele_id").alias("start")), "start", "left_semi")
    if inside.isEmpty():
        missing = legs.first()
        raise ValueError(f"no path from element {missing.start} to {missing.goal}")
    best = cheapest(inside, links, leg, rounds_at_once, mesh_tiles(centres))
    missing = legs.join(best.select(*leg, F.col("ele_id").alias("goal")), [*leg, "goal"], "left_anti").first()
    if missing:
        raise ValueError(f"no path from element {missing.start} to {missing.goal}")
    back = best.where("prev <> 0").select(*leg, F.col("ele_id").alias("src"), F.col("prev").alias("dst"))
    path = legs.select(*leg, F.col("goal").cast("long").alias("ele_id"), F.lit(0).cast("long").alias("back"))
    found, reach = 0, 1
    while True:
        further = path.join(back, (path.section == back.section) & (path.leg == back.leg) & (path.ele_id == back.src)).select(path.section, path.leg, F.col("dst").alias("ele_id"), (F.col("back") + reach).alias("back"))
        path = written(path.unionByName(further), "path-steps")
        if (now := path.count()) == found:
            break
        found, reach = now, 2 * reach
        onward = back.select(*leg, F.col("src").alias("dst"), F.col("dst").alias("beyond"))
        back = written(back.join(onward, [*leg, "dst"]).select(*leg, "src", F.col("beyond").alias("dst")), "path-jumps")
    last = Window.partitionBy("section", "leg")
    steps = path.withColumn("at", F.max("back").over(last) - F.col("back")).where("leg = 1 OR at > 0")
    along = [F.desc("leg"), F.desc("at")] if reverse else [F.asc("leg"), F.asc("at")]
    return steps.select("section", F.row_number().over(Window.partitionBy("section").orderBy(*along)).alias("seq"), F.col("ele_id").cast("int").alias("ele_id"))


def shortest_path(nodes: DataFrame, elements: DataFrame, start: int, goal: int, reverse: bool = False, rounds_at_once: int = 4) -> DataFrame:
    """(seq, ele_id): the element path from start to goal with the least sum of centre distances."""
    ends = nodes.sparkSession.createDataFrame([(1, 1, start), (1, 2, goal)], "section int, seq int, ele_id int")
    return section_paths(nodes, elements, ends, reverse, rounds_at_once).select("seq", "ele_id")


def edge_lines(nodes: DataFrame, node_edges: DataFrame, keep: bool = False) -> DataFrame:
    """x1, y1, x2, y2 of edges (a, b), with keep also a and b."""
    end = lambda c, i: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    return node_edges.join(end("a", 1), "a").join(end("b", 2), "b").select(*(("a", "b") if keep else ()), "x1", "y1", "x2", "y2")


def component_labels(pairs: DataFrame, node: str = "node_id", nei: str = "nei_id") -> DataFrame:
    """(node, label): the smallest node of each connected component, by label hopping.

    Each round takes the least label among neighbours and then the label of that label, so that far nodes are reached
    in a logarithmic number of rounds.
    """
    links = written(pairs.select(F.col(node).alias("a"), F.col(nei).alias("b")).union(pairs.select(F.col(nei).alias("a"), F.col(node).alias("b"))).distinct(), "label-links")
    labels = written(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = links.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        least = labels.join(near, "a").select("a", F.least("label", "low").alias("label"))
        hop = least.select(F.col("a").alias("label"), F.col("label").alias("next"))
        new = written(least.join(hop, "label").select("a", F.least("label", "next").alias("label")), "labels")
        if new.agg(F.sum("label")).first() == labels.agg(F.sum("label")).first():
            return new.select(F.col("a").alias(node), "label")
        labels = new


def connected_component(pairs: DataFrame, seed: int) -> DataFrame:
    """All nodes that can be reached from one."""
    labels = component_labels(pairs)
    mine = labels.where(F.col("node_id") == seed).select("label")
    return labels.join(mine, "label", "left_semi").select("node_id")


def transect_geometry(nodes: DataFrame, elements: DataFrame, section: DataFrame) -> DataFrame:
    """(section, seq, ele_id, mx1, my1, mx2, my2, x, y, nx1, ny1, nx2, ny2, bx, by) of ordered section elements.

    m1 and m2 are the middles of the edges by which the section enters and leaves the element (on the boundary for the
    first and last), n1 and n2 the unit normals to the right of the two legs, b their bisector.
    """
    order = Window.partitionBy("section").orderBy("seq")
    steps = section.select("section", "seq", "ele_id", F.coalesce(F.lag("ele_id").over(order), F.lit(0)).alias("before"), F.coalesce(F.lead("ele_id").over(order), F.lit(0)).alias("after"))
    sides = element_neighbors(elements).join(edges(elements), ["ele_id", "slot"]).select("ele_id", F.col("nei_id").alias("nei"), "a", "b")
    lines = sides
    for c, i in (("a", 1), ("b", 2)):
        lines = lines.join(nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")), c)
    middle = lines.groupBy("ele_id", "nei").agg(F.min(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))).alias("m"))
    enter = middle.select("ele_id", F.col("nei").alias("before"), F.col("m.x").alias("mx1"), F.col("m.y").alias("my1"))
    leave = middle.select("ele_id", F.col("nei").alias("after"), F.col("m.x").alias("mx2"), F.col("m.y").alias("my2"))
    placed = steps.join(enter, ["ele_id", "before"]).join(leave, ["ele_id", "after"]).join(element_centers(nodes, elements).select("ele_id", "x", "y"), "ele_id")

    def normal(dx: Column, dy: Column) -> tuple[Column, Column]:
        size = F.sqrt(dx * dx + dy * dy)
        return dy / size, -dx / size

    (nx1, ny1), (nx2, ny2) = normal(F.col("x") - F.col("mx1"), F.col("y") - F.col("my1")), normal(F.col("mx2") - F.col("x"), F.col("my2") - F.col("y"))
    normals = placed.select("section", "seq", "ele_id", "mx1", "my1", "mx2", "my2", "x", "y", nx1.alias("nx1"), ny1.alias("ny1"), nx2.alias("nx2"), ny2.alias("ny2"))
    size = F.sqrt(F.pow(F.col("nx1") + F.col("nx2"), 2) + F.pow(F.col("ny1") + F.col("ny2"), 2))
    return normals.withColumns({"bx": (F.col("nx1") + F.col("nx2")) / size, "by": (F.col("ny1") + F.col("ny2")) / size})


def transect_distance(geometry: DataFrame) -> DataFrame:
    """geometry's keys with width, the length of both legs, and along, the running distance between centres."""
    order = Window.partitionBy("section").orderBy("seq")
    leg = lambda i: F.hypot(F.col(f"mx{i}") - F.col("x"), F.col(f"my{i}") - F.col("y"))
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    return geometry.select("section", "seq", "ele_id", (leg(1) + leg(2)).alias("width"), step.alias("step")).withColumn("along", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def transect_line(geometry: DataFrame) -> DataFrame:
    """(section, place, x, y): entry middles and centres in turn, and the last way out."""
    first = geometry.select("section", (2 * F.col("seq") - 1).alias("place"), F.col("mx1").alias("x"), F.col("my1").alias("y"))
    centre = geometry.select("section", (2 * F.col("seq")).alias("place"), "x", "y")
    last = geometry.groupBy("section").agg(F.max(F.struct("seq", "mx2", "my2")).alias("m")).select("section", (2 * F.col("m.seq") + 1).alias("place"), F.col("m.mx2").alias("x"), F.col("m.my2").alias("y"))
    return first.unionByName(centre).unionByName(last)


def transect_sides(nodes: DataFrame, elements: DataFrame, section: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """(section, node_id, upstream): the border nodes of a section and the side they lie on.

    The nodes of the edge by which the section enters an element are written in the basis of the vector from the
    centre to that edge's middle and the bisecting normal; a positive second part is upstream. Of the last element's
    boundary edge, the node not yet placed goes opposite the other.
    """
    g = transect_geometry(nodes, elements, section) if geometry is None else geometry
    order = Window.partitionBy("section").orderBy("seq")
    steps = g.select("section", "seq", "ele_id", "mx1", "my1", "x", "y", "bx", "by", F.coalesce(F.lag("ele_id").over(order), F.lit(0)).alias("nei_id"), F.lead("ele_id").over(order).alias("after"))
    sides = element_neighbors(elements).join(edges(elements), ["ele_id", "slot"]).select("ele_id", "nei_id", F.explode(F.array("a", "b")).alias("node_id"))
    xy = nodes.select("node_id", F.col("x").alias("px"), F.col("y").alias("py"))
    ax, ay = F.col("mx1") - F.col("x"), F.col("my1") - F.col("y")
    part = (ax * (F.col("py") - F.col("y")) - ay * (F.col("px") - F.col("x"))) / (ax * F.col("by") - ay * F.col("bx"))
    placed = steps.join(sides, ["ele_id", "nei_id"]).join(xy, "node_id").withColumn("part", part).where(F.abs("part") > 1e-12).select("section", "node_id", (F.col("part") > 0).alias("upstream")).distinct()
    end = steps.where("after is null").select("section", "ele_id").join(sides.where("nei_id = 0"), "ele_id").select("section", "node_id")
    known = end.join(placed, ["section", "node_id"]).select("section", (~F.col("upstream")).alias("upstream"))
    rest = end.join(placed, ["section", "node_id"], "left_anti").join(known, "section").select("section", "node_id", "upstream")
    return placed.unionByName(rest).distinct()


def thalweg_distance(nodes: DataFrame, thalweg: DataFrame) -> DataFrame:
    """(name, seq, node_id, km): running distance along ordered nodes, 0 at the first."""
    order = Window.partitionBy("name").orderBy("seq")
    placed = thalweg.join(nodes.select("node_id", "x", "y"), "node_id")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    return placed.withColumn("step", step).select("name", "seq", "node_id", (F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)) / 1000).alias("km"))


def control_volume(nodes: DataFrame, elements: DataFrame, section: DataFrame) -> DataFrame:
    """Nodes of the volume that the sections enclose: with one section its upstream side.

    Node links across a section are cut (from one of its sides to the other); of the components that remain, the one
    that touches every section is the volume; of two, as where sections lie on both sides of an island, the one upstream
    of the first section by name. None is an error, and so is a loop: a component that holds both sides
    of a section, which then bounds nothing, as when it ends inside the mesh or leaves another way round.
    """
    sides = written(transect_sides(nodes, elements, section), "cv-sides")
    up, down = (sides.where(w).select("section", F.col("node_id").alias(c)) for w, c in (("upstream", "u"), ("not upstream", "d")))
    across = up.join(down, "section").select("u", "d")
    cut = across.union(across.select("d", "u")).toDF("node_id", "nei_id")
    labels = written(component_labels(node_neighbors(elements).join(cut, ["node_id", "nei_id"], "left_anti")), "cv-labels")
    # a link for each section's side and the component that it lies in: as many as sections, not as nodes
    ends = written(sides.join(labels, "node_id").select("section", "upstream", "label").distinct(), "cv-ends")
    loops = ends.groupBy("section", "label").agg(F.count("*").alias("n")).where("n > 1")
    if loop := loops.orderBy("section").first():
        raise ValueError(f"loop detected: both sides of section {loop.section} lie in one part of the mesh")
    first, sections = section.agg(F.min("section"), F.countDistinct("section")).first()
    above = F.max(F.col("upstream") & (F.col("section") == first))
    touched = ends.groupBy("label").agg(F.countDistinct("section").alias("n"), above.alias("above"))
    fit = touched.where(F.col("n") == sections).orderBy(F.desc("above"), "label").select("label").limit(1)
    if fit.isEmpty():
        raise ValueError("no part of the mesh touches every section")
    return labels.join(fit, "label", "left_semi").select("node_id")


def section_direction(sides: DataFrame, cv: DataFrame) -> DataFrame:
    """(section, into): whether the upstream side lies in the control volume."""
    ups = sides.where("upstream").join(cv.select("node_id", F.lit(True).alias("inside")), "node_id", "left")
    return ups.groupBy("section").agg(F.min(F.coalesce("inside", F.lit(False))).alias("into"))


def domain_nodes(nodes: DataFrame, ring_edges: DataFrame, masked: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(node_id, h, masked): nodes inside a region, with their depth, the masked ones marked."""
    inside = points_in_region(nodes.select("node_id", "x", "y", "h"), ring_edges, tolerance)
    return inside.join(masked.select("node_id", F.lit(True).alias("masked")), "node_id", "left").select("node_id", "h", F.coalesce("masked", F.lit(False)).alias("masked"))
