"""What the steps of long and large inputs cost, and their results there."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from estuary.operators import loadings as L
from estuary.operators import mesh as M
from estuary.operators import observations as V
from estuary.operators import region as R
from tests.test_meshes import mesh
from tests.test_regions_and_stores import RING, inside, ring

LONG, T0 = 300, datetime.datetime(2024, 1, 5)


def strip():
    """A strip of one by 300 squares, in which every seventh square is a hole and its border a ring of its own."""
    outer = [(float(c), 0.0) for c in range(LONG + 1)] + [(float(c), 4.0) for c in range(LONG, -1, -1)]
    holes = [e for c in range(3, LONG, 7) for e in ring((c, 1.0), (c + 1.0, 1.2), (c + 0.9, 3.0), (c, 2.0))]
    return [tuple(map(float, e)) for e in ring(*outer) + holes]


def parity(edges, x, y):
    return sum(min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) for x1, y1, x2, y2 in edges) % 2 == 1


def test_long_regions_meet_edges_by_cell(spark):
    """A row of cells holds all edges of a strip, and a cell a few; points on rings' corners and cells' middles too."""
    edges = strip()
    grid = R.Grid(0.0, 0.0, LONG, 4.0, len(edges), 1e-9)
    met = R.edge_cells(spark.createDataFrame(edges, RING), grid).groupBy("i", "j").count().agg(F.max("count"), F.sum("count")).first()
    assert met[0] <= 16 and met[1] <= 8 * len(edges) and grid.across * grid.rows <= 3 * len(edges) + 1
    rng = np.random.default_rng(2)
    spots = [tuple(p) for p in rng.uniform((-2, -1), (LONG + 2, 5), (3000, 2))] + [(x, y) for x, y, _, _ in edges]
    spots += [(grid.x + (i + 0.5) * grid.width, grid.y + (j + 0.5) * grid.width) for i in range(grid.across) for j in range(grid.rows)]
    assert inside(spark, spots, edges) == {i for i, p in enumerate(spots) if parity(edges, *p)}


def test_long_regions_with_a_tolerance(spark):
    """Nodes and edge middles lie on borders: they meet the edges of their own cell, and so do points beside an edge."""
    edges = strip()
    grid = R.Grid(0.0, 0.0, LONG, 4.0, len(edges), 0.1)
    rows = R.edge_cells(spark.createDataFrame(edges, RING), grid)
    assert rows.groupBy("i", "j").count().agg(F.max("count")).first()[0] <= 24
    spots = [(x, y) for x, y, _, _ in edges] + [((a + c) / 2, (b + d) / 2) for a, b, c, d in edges] + [(x - 0.05, y + 0.05) for x, y, _, _ in edges]
    near = lambda x, y: any(_off(x, y, *e) <= 0.1 + 1e-9 for e in edges)
    assert inside(spark, spots, edges, 0.1) == {i for i, p in enumerate(spots) if near(*p) or parity(edges, *p)}


def _off(x, y, x1, y1, x2, y2):
    t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
    return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))


def test_points_in_a_corner_of_a_long_region(spark):
    """Stations that crowd one end are joined to its few cells' edges: no edge of the far end is met."""
    edges = strip()
    grid = R.Grid(0.0, 0.0, LONG, 4.0, len(edges), 1e-9)
    met = R.edge_cells(spark.createDataFrame(edges, RING), grid).where(F.col("i") <= grid.across // 20)
    assert met.count() < len(edges) / 4 and met.agg(F.max(F.least("x1", "x2"))).first()[0] < LONG / 4
    spots = [((397 * s % 3000) / 1000, (211 * s % 4000) / 1000) for s in range(3000)]
    assert inside(spark, spots, edges) == {i for i, p in enumerate(spots) if parity(edges, *p)}


def test_observations_in_a_long_region(spark):
    """select_obs keeps the observations of stations inside, by an index that has no more cells than a few an edge."""
    edges = strip()
    places = [(s, f"s{s}", (397 * s % (1000 * LONG)) / 1000, (211 * s % 4000) / 1000) for s in range(500)]
    station = spark.createDataFrame(places, "location_id int, description string, x double, y double")
    obs = spark.createDataFrame([(i, i % 500, "o2", T0) for i in range(2000)], "id int, location_id int, parameter_id string, ts timestamp")
    ring_edges = spark.createDataFrame(edges, RING)
    want = {i for i in range(2000) if parity(edges, *places[i % 500][2:])}
    assert {r.id for r in V.select_obs(obs, station, ["o2"], T0, T0, ring_edges).collect()} == want
    grid = R.Grid(0.0, 0.0, LONG, 4.0, len(edges), 1e-9)
    sides = R.cell_sides(ring_edges, grid).collect()
    assert len(sides) == grid.across * grid.rows <= 3 * len(edges) + 1


def test_paths_by_tiles_take_the_ways_of_the_plain_search(spark):
    """Over small tiles that a way leaves and enters again; a strip's many ways of equal length are told apart as in the plain search."""
    columns = 24
    xy = [(1000 * c + (37 * c + 17 * r) % 7 * 20, 1000 * r + (11 * c + 29 * r) % 5 * 20) for r in range(5) for c in range(columns)]
    nv = [n for r in range(4) for c in range(1, columns) for n in ((r * columns + c, r * columns + c + 1, (r + 1) * columns + c), (r * columns + c + 1, (r + 1) * columns + c + 1, (r + 1) * columns + c))]
    nodes, elements = mesh(spark, " ".join(f"{x},{y}" for x, y in xy), " ".join("-".join(map(str, n)) for n in nv))
    links = M.element_neighbors(elements).where("nei_id <> 0").select(F.col("ele_id").alias("src"), F.col("nei_id").alias("dst"))
    links = spark.createDataFrame(M.distance(links, M.element_centers(nodes, elements).select("ele_id", "x", "y"), "src", "dst", "ele_id").collect())
    want, found = {1: (0.0, 0)}, links.collect()
    while True:
        sent = {}
        for r in found:
            if r.src in want:
                sent[r.dst] = min(sent.get(r.dst, (math.inf, 0)), (want[r.src][0] + r.dist, r.src))
        lower = {e: s for e, s in sent.items() if e not in want or s[0] < want[e][0]}
        if not lower:
            break
        want |= lower
    goal = max(want, key=want.get)
    tiles = elements.select("ele_id", (F.col("ele_id") % 46 / 9).cast("int").alias("tile"))
    legs = spark.createDataFrame([("a", 1, goal)], "leg string, start int, goal int")
    rows = M.cheapest(legs, links, ["leg"], 2, tiles).collect()
    assert len(rows) == len(want) and {r.ele_id: (r.cost, r.prev) for r in rows} == want


def test_tiles_of_a_strip_lie_side_by_side(spark, monkeypatch):
    """No two tiles of a strip share x, so ways go from each to the next; those of a square are cut both ways, and of like size."""
    monkeypatch.setattr(M, "BUCKET", 0.05)
    at = lambda columns, rows: spark.createDataFrame([(r * columns + c, float(c), float(r)) for r in range(rows) for c in range(columns)], "ele_id int, x double, y double")
    long = at(400, 4)
    span = long.join(M.mesh_tiles(long), "ele_id").groupBy("tile").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("a").collect()
    assert len(span) == 8 and all(p.b < q.a for p, q in zip(span, span[1:], strict=False))
    square = at(40, 40)
    sizes = square.join(M.mesh_tiles(square), "ele_id").groupBy("tile").agg(F.count("*").alias("n"), F.countDistinct("x").alias("w"), F.countDistinct("y").alias("h")).collect()
    assert sum(r.n for r in sizes) == 1600 and len(sizes) == 9 and all(r.n == r.w * r.h and r.n <= 2 * 205 for r in sizes)


def test_scenarios_read_their_data_once(spark, tmp_path):
    """Neither the checks nor the result of a scenario go back to the data: they read the adjusted rows."""
    rows = [(datetime.date(2024, 1, 1), 1, 4.0, 1.0, 0.0, 2.0), (datetime.date(2024, 1, 2), 1, 6.0, 1.0, 0.0, 2.0)]
    spark.createDataFrame(rows, "date date, node_id int, discharge double, temp double, salt double, nh4 double").write.parquet(f"{tmp_path}/data")
    nodes = spark.createDataFrame([(1, 7, True)], "node_id int, fvcom_id long, icm_source boolean")
    classes = spark.createDataFrame([(7, "Snow")], "fvcom_id long, class string")
    factors = spark.createDataFrame([(rows[0][0], "Snow", 0.5)], "date date, class string, factor double")
    out = L.flow_scenario(spark.read.parquet(f"{tmp_path}/data"), nodes, factors, ["nh4"], "constload", classes=classes)
    assert [(r.discharge, r.nh4) for r in out.orderBy("date").collect()] == [(2.0, 4.0), (6.0, 2.0)]
    assert not any(f"{tmp_path}/data" in f for f in out.inputFiles())


def test_regressions_read_their_data_once(spark, tmp_path):
    """A river's sums stand beside its nodes' rows, and the JVM compiles the code of a row: it interprets methods of over 8,000 bytes."""
    day = datetime.date(2024, 3, 1)
    rows = [(day, 1, 4.0, 0.3), (day, 2, 6.0, 0.2), (day, 3, 0.0, 0.1), (datetime.date(2023, 12, 31), 2, 7.0, 0.4), (None, 1, 5.0, 0.1), (day, 9, 5.0, 0.1)]
    spark.createDataFrame(rows, "date date, node_id int, discharge double, talk double").write.parquet(f"{tmp_path}/data")
    rivers = spark.createDataFrame([(7, 1, 5.0), (7, 2, 5.0), (8, 3, 2.0)], "fvcom_id long, node_id int, area_km2 double")
    b = {"NO23N": [0.1, 0.2, -0.05, 0.03, 0.02, 0.01, -0.01, 1.05, None], "NH4N": [-1.2, 0.1, None, 0.05, None, None, None, None, 0.01], "pH": [0.9] + [None] * 8}
    table = spark.createDataFrame([(k, *v) for k, v in b.items()], "constituent string, " + ", ".join(f"b{i} double" for i in range(9)))
    out = L.update_by_regression(spark.read.parquet(f"{tmp_path}/data"), rivers, table)

    def form(k, q, yf):
        c = [d if x is None else x for x, d in zip(b.get(k, [None] * 9), [0.0] * 7 + [1.0, math.inf], strict=True)]
        lq, t = math.log10(q) if q else 0.0, 2 * math.pi * yf
        power = c[0] + c[1] * lq + c[2] * lq * lq + c[3] * math.sin(t) + c[4] * math.cos(t) + c[5] * math.sin(2 * t) + c[6] * math.cos(2 * t)
        return min(10**power * c[7], c[8]) if q else 0.0

    got = {(r.date, r.node_id): r for r in out.collect()}
    assert set(got) == {(r[0], r[1]) for r in rows[:4]}
    for (date, node), q, yf, alk in [((day, 1), 2.0, 61 / 366, 0.3), ((day, 2), 2.0, 61 / 366, 0.3), ((day, 3), 0.0, 61 / 366, 0.1), ((rows[3][0], 2), 1.4, 1.0, 0.4)]:
        r, no3, nh4, ph = got[date, node], *(form(k, q, yf) for k in ("NO23N", "NH4N", "pH"))
        h = 10 ** -max(ph, 6.5)
        dic = (alk + h - 10 ** (max(ph, 6.5) - 14)) / ((L.KA1 * h + 2 * L.KA1 * L.KA2) / (h * h + L.KA1 * h + L.KA1 * L.KA2))
        don = form("DTPN", q, yf) - no3 - nh4
        want = (no3, nh4, 0.9 * form("DOC", q, yf), 0.001 if don < 0 else don, dic)
        assert np.allclose((r.no32, r.nh4, r.ldoc, r.ldon, r.dic), want, rtol=1e-12)
        assert r.fvcom_id == (8 if node == 3 else 7)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [int(part.split(";")[0]) for part in code.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000
