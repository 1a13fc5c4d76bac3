"""Queries of mesh and section operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuary.operators import mesh as M
from estuary.operators import transport as T
from estuary.plans.base import Book
from estuary.plans.q_extract import SIGMA, sigma
from estuary.plans.q_thresholds import AREA

BOOK = Book()
query = BOOK.query
QUERIES, ORACLE_SQL = BOOK.queries, BOOK.oracle

VX = "vx AS (SELECT ele_id, unnest([0, 1, 2]) AS slot, unnest([n1, n2, n3]) AS node_id FROM v_mesh_element)"
EDGE = "edge AS (SELECT ele_id, unnest([0, 1, 2]) AS slot, unnest([least(n2, n3), least(n1, n3), least(n1, n2)]) AS a, unnest([greatest(n2, n3), greatest(n1, n3), greatest(n1, n2)]) AS b FROM v_mesh_element)"
CENTRE = f"{VX}, centre AS (SELECT ele_id, avg(x) AS x, avg(y) AS y, avg(h) AS h FROM vx JOIN v_mesh_node USING (node_id) GROUP BY ele_id)"
NEI = f"{EDGE}, nei AS (SELECT e.ele_id, e.slot, coalesce(o.ele_id, 0) AS nei_id, e.a, e.b FROM edge e LEFT JOIN edge o ON e.a = o.a AND e.b = o.b AND e.ele_id <> o.ele_id)"
WEIGHTS = f"""{CENTRE}, {NEI}, offs AS (SELECT n.ele_id, slot, nei_id, coalesce(d.x, (p.x + q.x) / 2) - c.x AS dx, coalesce(d.y, (p.y + q.y) / 2) - c.y AS dy FROM nei n
  JOIN centre c ON n.ele_id = c.ele_id LEFT JOIN centre d ON nei_id = d.ele_id JOIN v_mesh_node p ON n.a = p.node_id JOIN v_mesh_node q ON n.b = q.node_id),
sums AS (SELECT ele_id, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy FROM offs GROUP BY ele_id),
wt AS (SELECT ele_id, slot, nei_id, (syy * dx - sxy * dy) / (sxx * syy - sxy * sxy) AS wx, (sxx * dy - sxy * dx) / (sxx * syy - sxy * sxy) AS wy FROM offs JOIN sums USING (ele_id))"""
#: One section a cell column, from the first row of the lattice to the last.
SECTION = """section AS (SELECT 's' || lpad(CAST(c AS VARCHAR), 4, '0') AS section, CAST(2 * r + k AS INTEGER) AS seq, CAST(2 * (r * (ncol - 1) + c) + k AS INTEGER) AS ele_id
  FROM (SELECT unnest(range(0, ncol - 1)) AS c, ncol FROM v_dim) a, (VALUES (0), (1), (2), (3)) rr(r), (VALUES (1), (2)) kk(k))"""
GEOMETRY = f"""{CENTRE}, {NEI}, {SECTION},
step AS (SELECT *, coalesce(lag(ele_id) OVER w, 0) AS before, coalesce(lead(ele_id) OVER w, 0) AS after FROM section WINDOW w AS (PARTITION BY section ORDER BY seq)),
mid0 AS (SELECT ele_id, nei_id, (p.x + q.x) / 2 AS x, (p.y + q.y) / 2 AS y FROM nei JOIN v_mesh_node p ON a = p.node_id JOIN v_mesh_node q ON b = q.node_id),
mid AS (SELECT ele_id, nei_id, min((x, y))[1] AS x, min((x, y))[2] AS y FROM mid0 GROUP BY ele_id, nei_id),
legs AS (SELECT section, seq, s.ele_id, m1.x AS mx1, m1.y AS my1, m2.x AS mx2, m2.y AS my2, c.x, c.y FROM step s JOIN mid m1 ON s.ele_id = m1.ele_id AND s.before = m1.nei_id JOIN mid m2 ON s.ele_id = m2.ele_id AND s.after = m2.nei_id JOIN centre c ON s.ele_id = c.ele_id),
geo AS (SELECT *, (y - my1) / sqrt(pow(x - mx1, 2) + pow(y - my1, 2)) AS nx1, -(x - mx1) / sqrt(pow(x - mx1, 2) + pow(y - my1, 2)) AS ny1, (my2 - y) / sqrt(pow(mx2 - x, 2) + pow(my2 - y, 2)) AS nx2, -(mx2 - x) / sqrt(pow(mx2 - x, 2) + pow(my2 - y, 2)) AS ny2 FROM legs)"""


def sections(v):
    columns = v("v_dim").select("ncol", F.explode(F.sequence(F.lit(0), F.col("ncol") - 2)).alias("c"))
    steps = columns.select("c", "ncol", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r")).select("c", "ncol", "r", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    name = F.concat(F.lit("s"), F.lpad(F.col("c").cast("string"), 4, "0"))
    return steps.select(name.alias("section"), (2 * F.col("r") + F.col("k")).cast("int").alias("seq"), (2 * (F.col("r") * (F.col("ncol") - 1) + F.col("c")) + F.col("k")).cast("int").alias("ele_id"))


def geometry(v):
    return M.transect_geometry(v("v_mesh_node"), v("v_mesh_element"), sections(v))


def weights(v):
    return M.gradient_weights(v("v_mesh_node"), v("v_mesh_element"))


@query(f"WITH {CENTRE} SELECT * FROM centre", r="x y h")
def m1_element_centers(v):
    return M.element_centers(v("v_mesh_node"), v("v_mesh_element"))


@query(f"WITH {NEI} SELECT ele_id, slot, nei_id FROM nei")
def m2_element_neighbors(v):
    return M.element_neighbors(v("v_mesh_element"))


@query(f"WITH {EDGE} SELECT a, b FROM edge GROUP BY a, b HAVING count(*) = 1")
def m3_boundary_edges(v):
    return M.boundary_edges(v("v_mesh_element"))


@query(f"WITH {EDGE} SELECT ele_id % 3 AS part, a, b FROM edge GROUP BY ele_id % 3, a, b HAVING count(*) = 1")
def m3_part_outlines(v):
    return M.boundary_edges(v("v_mesh_element"), v("v_mesh_element").select("ele_id", (F.col("ele_id") % 3).alias("part")))


@query(f"WITH {EDGE} SELECT a AS node_id, b AS nei_id FROM edge UNION SELECT b, a FROM edge")
def m4_node_neighbors(v):
    return M.node_neighbors(v("v_mesh_element"))


@query(f"WITH {EDGE} SELECT DISTINCT a, b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.h - q.h, 2)) AS dist FROM edge JOIN v_mesh_node p ON a = p.node_id JOIN v_mesh_node q ON b = q.node_id", r="dist")
def m5_node_dist(v):
    return M.distance(M.edges(v("v_mesh_element")).select("a", "b").distinct(), v("v_mesh_node"), "a", "b", "node_id", ("x", "y", "h"))


@query(f"WITH {CENTRE}, {NEI} SELECT n.ele_id, n.nei_id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS dist FROM nei n JOIN centre p ON n.ele_id = p.ele_id JOIN centre q ON n.nei_id = q.ele_id", r="dist")
def m5_ele_dist(v):
    pairs = M.element_neighbors(v("v_mesh_element")).select("ele_id", "nei_id").withColumnRenamed("ele_id", "from_id")
    centres = M.element_centers(v("v_mesh_node"), v("v_mesh_element"))
    return M.distance(pairs, centres, "from_id", "nei_id", "ele_id").withColumnRenamed("from_id", "ele_id")


@query(f"WITH {AREA} SELECT * FROM na", r="area")
def m6_node_area(v):
    return M.node_area(v("v_mesh_node"), v("v_mesh_element"))


@query(f"""WITH {CENTRE}, {EDGE}, nb AS (SELECT a AS node_id, b AS nei_id FROM edge UNION SELECT b, a FROM edge), rim AS (SELECT DISTINCT unnest([a, b]) AS node_id FROM (SELECT a, b FROM edge GROUP BY a, b HAVING count(*) = 1)),
pts AS (SELECT node_id, centre.x, centre.y FROM vx JOIN centre USING (ele_id) UNION ALL SELECT n.node_id, (p.x + q.x) / 2, (p.y + q.y) / 2 FROM nb n JOIN v_mesh_node p USING (node_id) JOIN v_mesh_node q ON n.nei_id = q.node_id UNION ALL SELECT node_id, x, y FROM rim JOIN v_mesh_node USING (node_id)),
ring AS (SELECT node_id, atan2(pts.y - o.y, pts.x - o.x) AS angle, pts.x, pts.y FROM pts JOIN v_mesh_node o USING (node_id))
SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY angle, x, y) - 1 AS place, x, y FROM ring""", r="x y")
def m6b_node_polygon(v):
    ring = M.node_polygon(v("v_mesh_node"), v("v_mesh_element"))
    return ring.select("node_id", F.posexplode("ring").alias("place", "p")).select("node_id", F.col("place").cast("long").alias("place"), "p.x", "p.y")


@query(f"WITH {VX} SELECT t, layer, ele_id, avg(doxg) AS doxg FROM vx JOIN v_dense3d USING (node_id) GROUP BY ALL", r="doxg")
def m7_node_to_element(v):
    return M.node_to_element(v("v_dense3d"), v("v_mesh_element"), ["doxg"], ["t", "layer"])


@query(f"WITH {WEIGHTS} SELECT * FROM wt", r="wx:9 wy:9")
def m8_gradient_weights(v):
    return weights(v)


@query(f"""WITH {WEIGHTS} SELECT f.t, f.layer, f.ele_id, sum(wx * (CASE WHEN nei_id = 0 THEN 0 ELSE g.v END - f.v)) - sum(wy * (CASE WHEN nei_id = 0 THEN 0 ELSE g.u END - f.u)) AS vorticity
FROM v_ele3d f JOIN wt USING (ele_id) LEFT JOIN v_ele3d g ON g.t = f.t AND g.layer = f.layer AND g.ele_id = nei_id GROUP BY ALL""", r="vorticity:9")
def m9_vorticity(v):
    return M.vorticity(v("v_ele3d"), weights(v), ["t", "layer"])


@query(f"WITH {AREA}, {SIGMA} SELECT t, node_id, layer, area * dz * h * (1 + zeta / h) AS volume FROM v_dense2d JOIN na USING (node_id) JOIN v_mesh_node USING (node_id), sigma", r="volume:4")
def m10_layer_volume(v):
    return M.layer_volume(v("v_mesh_node"), v("v_mesh_element"), sigma(v), v("v_dense2d")).drop("zeta")


#: Every element's least cost from the first one and the element before it, after so many rounds as no path has elements; then the way back from the last.
PATHS = """WITH RECURSIVE own AS (SELECT ele_id, slot, least(p, q) AS a, greatest(p, q) AS b FROM (
  SELECT ele_id, 0 AS slot, n2 AS p, n3 AS q FROM v_mesh_element UNION ALL SELECT ele_id, 1, n1, n3 FROM v_mesh_element UNION ALL SELECT ele_id, 2, n1, n2 FROM v_mesh_element)),
centre AS (SELECT ele_id, (p.x + q.x + s.x) / 3 AS x, (p.y + q.y + s.y) / 3 AS y FROM v_mesh_element JOIN v_mesh_node p ON n1 = p.node_id JOIN v_mesh_node q ON n2 = q.node_id JOIN v_mesh_node s ON n3 = s.node_id),
link AS (SELECT o.ele_id AS src, n.ele_id AS dst, sqrt((c.x - d.x) * (c.x - d.x) + (c.y - d.y) * (c.y - d.y)) AS dist FROM own o JOIN own n ON o.a = n.a AND o.b = n.b AND o.ele_id <> n.ele_id JOIN centre c ON c.ele_id = o.ele_id JOIN centre d ON d.ele_id = n.ele_id),
best AS (SELECT 0 AS i, ele_id, CASE WHEN ele_id = 1 THEN CAST(0 AS DOUBLE) END AS cost, CASE WHEN ele_id = 1 THEN 0 END AS prev FROM v_mesh_element
  UNION ALL SELECT i + 1, b.ele_id, coalesce(least(b.cost, n.cost), b.cost, n.cost), CASE WHEN b.cost IS NULL OR n.cost < b.cost THEN n.src ELSE b.prev END
  FROM best b LEFT JOIN LATERAL (SELECT min(p.cost + l.dist) AS cost, arg_min(l.src, (p.cost + l.dist, l.src)) AS src FROM link l JOIN best p ON p.ele_id = l.src WHERE l.dst = b.ele_id AND p.cost IS NOT NULL) n ON true
  WHERE i < (SELECT 3 * ncol + 20 FROM v_dim)),
done AS (SELECT ele_id, prev FROM best WHERE i = (SELECT max(i) FROM best)),
back AS (SELECT 0 AS k, max(ele_id) AS ele_id FROM v_mesh_element UNION ALL SELECT k + 1, prev FROM back JOIN done USING (ele_id) WHERE prev <> 0)
SELECT CAST(row_number() OVER (ORDER BY k DESC) AS INTEGER) AS seq, ele_id FROM back"""


@query(PATHS)
def m11_shortest_path(v):
    """The path from the first element to the last one."""
    last = v("v_mesh_element").agg(F.max("ele_id")).first()[0]
    return M.shortest_path(v("v_mesh_node"), v("v_mesh_element"), 1, last)


REGION = "region_edge AS (SELECT p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM (SELECT a, b FROM edge JOIN (SELECT ele_id FROM v_mesh_element WHERE ele_id % 7 <> 0) USING (ele_id) GROUP BY a, b HAVING count(*) = 1) JOIN v_mesh_node p ON a = p.node_id JOIN v_mesh_node q ON b = q.node_id)"


def region(v):
    return M.edge_lines(v("v_mesh_node"), M.boundary_edges(v("v_mesh_element").where("ele_id % 7 <> 0")))


@query(f"WITH {EDGE}, {REGION} SELECT location_id, s.x, s.y FROM v_station s JOIN region_edge ON y1 <> y2 AND least(y1, y2) <= s.y AND s.y < greatest(y1, y2) AND s.x < x1 + (s.y - y1) / (y2 - y1) * (x2 - x1) GROUP BY location_id, s.x, s.y HAVING count(*) % 2 = 1", r="x y")
def m12_points_in_region(v):
    return M.points_in_region(v("v_station").select("location_id", "x", "y"), region(v))


@query(f"""WITH {EDGE}, {REGION}, re AS (SELECT x1 / 100000 AS x1, y1 / 100000 AS y1, x2 / 100000 AS x2, y2 / 100000 AS y2 FROM region_edge),
pt AS (SELECT 'node ' || CAST(node_id AS VARCHAR) AS name, x / 100000 AS x, y / 100000 AS y FROM v_mesh_node
  UNION ALL SELECT DISTINCT 'edge ' || CAST(a AS VARCHAR) || ' ' || CAST(b AS VARCHAR), (p.x + q.x) / 200000, (p.y + q.y) / 200000 FROM edge JOIN v_mesh_node p ON a = p.node_id JOIN v_mesh_node q ON b = q.node_id),
far AS (SELECT pt.*, re.*, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM pt, re)
SELECT name FROM far GROUP BY name HAVING min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) <= 1e-9
  OR count(*) FILTER (y1 <> y2 AND least(y1, y2) <= y AND y < greatest(y1, y2) AND x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1""")
def m12_region_borders(v):
    """All nodes and edge middles of the mesh, in degrees, inside the region or on its border."""
    nodes, scale = v("v_mesh_node"), F.lit(100000.0)
    ends = M.edge_lines(nodes, M.edges(v("v_mesh_element")).select("a", "b").distinct(), keep=True)
    name = lambda *c: F.concat_ws(" ", *c)
    points = nodes.select(name(F.lit("node"), F.col("node_id").cast("string")).alias("name"), (F.col("x") / scale).alias("x"), (F.col("y") / scale).alias("y"))
    middle = ends.select(name(F.lit("edge"), F.col("a").cast("string"), F.col("b").cast("string")).alias("name"), ((F.col("x1") + F.col("x2")) / 2 / scale).alias("x"), ((F.col("y1") + F.col("y2")) / 2 / scale).alias("y"))
    return M.points_in_region(points.union(middle), region(v).select(*((F.col(c) / scale).alias(c) for c in ("x1", "y1", "x2", "y2"))), 1e-9).select("name")


@query("""WITH RECURSIVE live AS (SELECT node_id FROM v_mesh_node WHERE x < 9500),
nb AS (SELECT e.a, e.b FROM (SELECT unnest([n1, n2, n3, n2, n3, n1]) AS a, unnest([n2, n3, n1, n1, n2, n3]) AS b FROM v_mesh_element) e WHERE a IN (FROM live) AND b IN (FROM live)),
reach AS (SELECT 1 AS node_id UNION SELECT b FROM reach JOIN nb ON node_id = a) SELECT CAST(node_id AS INTEGER) AS node_id FROM reach""")
def m13_connected_component(v):
    live = v("v_mesh_node").where("x < 9500").select("node_id")
    pairs = M.node_neighbors(v("v_mesh_element")).join(live, "node_id", "left_semi").join(live.withColumnRenamed("node_id", "nei_id"), "nei_id", "left_semi")
    return M.connected_component(pairs, 1)


@query(f"WITH {GEOMETRY} SELECT *, (nx1 + nx2) / sqrt(pow(nx1 + nx2, 2) + pow(ny1 + ny2, 2)) AS bx, (ny1 + ny2) / sqrt(pow(nx1 + nx2, 2) + pow(ny1 + ny2, 2)) AS \"by\" FROM geo", r="x y mx1 my1 mx2 my2 nx1 ny1 nx2 ny2 bx by")
def m14_transect_geometry(v):
    return geometry(v)


@query(f"WITH {GEOMETRY}, st AS (SELECT *, sqrt(pow(x - mx1, 2) + pow(y - my1, 2)) + sqrt(pow(x - mx2, 2) + pow(y - my2, 2)) AS width, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM geo WINDOW w AS (PARTITION BY section ORDER BY seq)) SELECT section, seq, ele_id, width, sum(step) OVER (PARTITION BY section ORDER BY seq) AS along FROM st", r="width along")
def m16_transect_distance(v):
    return M.transect_distance(geometry(v))


@query(f"WITH {GEOMETRY} SELECT section, 2 * seq - 1 AS place, mx1 AS x, my1 AS y FROM geo UNION ALL SELECT section, 2 * seq, x, y FROM geo UNION ALL SELECT section, 17, mx2, my2 FROM geo WHERE seq = 8", r="x y")
def m17_transect_line(v):
    return M.transect_line(geometry(v))


SIDES = f"""{GEOMETRY}, bis AS (SELECT *, (nx1 + nx2) / sqrt(pow(nx1 + nx2, 2) + pow(ny1 + ny2, 2)) AS bx, (ny1 + ny2) / sqrt(pow(nx1 + nx2, 2) + pow(ny1 + ny2, 2)) AS bz, coalesce(lag(ele_id) OVER w, 0) AS before, lead(ele_id) OVER w AS after FROM geo WINDOW w AS (PARTITION BY section ORDER BY seq)),
rim AS (SELECT ele_id, nei_id, unnest([a, b]) AS node_id FROM nei),
part AS (SELECT section, node_id, ((mx1 - g.x) * (p.y - g.y) - (my1 - g.y) * (p.x - g.x)) / ((mx1 - g.x) * bz - (my1 - g.y) * bx) AS part FROM bis g JOIN rim ON rim.ele_id = g.ele_id AND rim.nei_id = g.before JOIN v_mesh_node p USING (node_id)),
placed AS (SELECT DISTINCT section, node_id, part > 0 AS upstream FROM part WHERE abs(part) > 1e-12),
ending AS (SELECT section, node_id FROM bis g JOIN rim ON rim.ele_id = g.ele_id AND rim.nei_id = 0 WHERE after IS NULL),
sides AS (SELECT * FROM placed UNION SELECT e.section, e.node_id, NOT k.upstream FROM ending e JOIN (SELECT section, upstream FROM ending JOIN placed USING (section, node_id)) k USING (section) WHERE NOT EXISTS (FROM placed q WHERE q.section = e.section AND q.node_id = e.node_id))"""


@query(f"WITH {SIDES} SELECT * FROM sides")
def m15_transect_sides(v):
    return M.transect_sides(v("v_mesh_node"), v("v_mesh_element"), sections(v))


@query("WITH th AS (SELECT 'row' || CAST((node_id - 1) // ncol AS VARCHAR) AS name, (node_id - 1) % ncol + 1 AS seq, node_id, x, y FROM v_mesh_node, v_dim), st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM th WINDOW w AS (PARTITION BY name ORDER BY seq)) SELECT name, seq, node_id, sum(step) OVER (PARTITION BY name ORDER BY seq) / 1000 AS km FROM st", r="km")
def m18_thalweg_distance(v):
    rows = v("v_mesh_node").join(v("v_dim").select("ncol"), how="cross")
    line = F.concat(F.lit("row"), F.floor((F.col("node_id") - 1) / F.col("ncol")).cast("string"))
    return M.thalweg_distance(v("v_mesh_node"), rows.select(line.alias("name"), ((F.col("node_id") - 1) % F.col("ncol") + 1).alias("seq"), "node_id"))


@query(f"""WITH RECURSIVE {SIDES}, sd AS (SELECT * FROM sides WHERE section IN ('s0001', 's0003')),
across AS (SELECT u.node_id AS a, d.node_id AS b FROM sd u JOIN sd d USING (section) WHERE u.upstream AND NOT d.upstream),
link AS (SELECT a, b FROM (SELECT a, b FROM edge UNION SELECT b, a FROM edge) EXCEPT (SELECT a, b FROM across UNION SELECT b, a FROM across)),
reach AS (SELECT node_id AS seed, node_id FROM sd UNION SELECT seed, b FROM reach JOIN link ON node_id = a),
comp AS (SELECT seed, min(node_id) AS label FROM reach GROUP BY seed),
pick AS (SELECT label FROM sd JOIN comp ON sd.node_id = seed GROUP BY label HAVING count(DISTINCT section) = (SELECT count(DISTINCT section) FROM sd) ORDER BY bool_or(upstream AND section = (SELECT min(section) FROM sd)) DESC, label LIMIT 1)
SELECT DISTINCT node_id FROM reach JOIN comp USING (seed) WHERE label = (SELECT label FROM pick)""")
def m19_control_volume(v):
    ends = sections(v).where("section in ('s0001', 's0003')")
    return M.control_volume(v("v_mesh_node"), v("v_mesh_element"), ends)


@query(f'WITH {SIDES} SELECT section, bool_and(node_id IN (SELECT node_id FROM v_mesh_node WHERE x < 4500)) AS "into" FROM sides WHERE upstream GROUP BY section')
def m20_section_direction(v):
    near = v("v_mesh_node").where("x < 4500").select("node_id")
    return M.section_direction(M.transect_sides(v("v_mesh_node"), v("v_mesh_element"), sections(v)), near)


@query(f"WITH {EDGE}, {REGION} SELECT n.node_id, n.h, n.node_id % 11 = 0 AS masked FROM v_mesh_node n JOIN region_edge ON y1 <> y2 AND least(y1, y2) <= n.y AND n.y < greatest(y1, y2) AND n.x < x1 + (n.y - y1) / (y2 - y1) * (x2 - x1) GROUP BY n.node_id, n.h HAVING count(*) % 2 = 1", r="h")
def m21_domain_nodes(v):
    return M.domain_nodes(v("v_mesh_node"), region(v), v("v_mesh_node").where("node_id % 11 = 0"))


CELLS = f"{GEOMETRY}, {SIGMA}, cell AS (SELECT section, seq, ele_id, layer, centre.h, zz * centre.h AS z0, (sqrt(pow(geo.x - mx1, 2) + pow(geo.y - my1, 2)) + sqrt(pow(geo.x - mx2, 2) + pow(geo.y - my2, 2))) * dz * centre.h AS da0, sqrt(pow(geo.x - mx1, 2) + pow(geo.y - my1, 2)) AS l1, sqrt(pow(geo.x - mx2, 2) + pow(geo.y - my2, 2)) AS l2, nx1, ny1, nx2, ny2, mx1 - geo.x AS dx1, my1 - geo.y AS dy1, mx2 - geo.x AS dx2, my2 - geo.y AS dy2 FROM geo JOIN centre USING (ele_id), sigma)"


def cells(v):
    return T.section_cells(geometry(v), M.element_centers(v("v_mesh_node"), v("v_mesh_element")), sigma(v))


@query(f"WITH {CELLS} SELECT section, seq, ele_id, layer, h, z0, da0 FROM cell", r="h z0 da0")
def t1_section_cells(v):
    return cells(v).select("section", "seq", "ele_id", "layer", "h", "z0", "da0")


ZETA = f"ez AS (SELECT t, ele_id, avg(zeta) AS zeta FROM vx JOIN v_dense2d USING (node_id) GROUP BY ALL)"


def flow(v):
    surface = M.node_to_element(v("v_dense2d"), v("v_mesh_element"), ["zeta"], ["t"])
    return v("v_ele3d").join(surface, ["t", "ele_id"])


@query(f"WITH {CELLS}, {ZETA} SELECT section, seq, ele_id, layer, t, (l1 / (l1 + l2) * (u * nx1 + v * ny1) + l2 / (l1 + l2) * (u * nx2 + v * ny2)) * da0 * (1 + zeta / h) AS q FROM cell JOIN v_ele3d USING (ele_id, layer) JOIN ez USING (t, ele_id)", r="q:4")
def t3_section_flux_uniform(v):
    return T.section_flux(flow(v), cells(v), ["t"]).select("section", "seq", "ele_id", "layer", "t", "q")


@query(f"""WITH {WEIGHTS.replace(CENTRE + ', ' + NEI, CELLS)}, {ZETA},
sl AS (SELECT f.t, f.layer, f.ele_id, f.u, f.v, sum(wx * (g.u - f.u)) AS ux, sum(wy * (g.u - f.u)) AS uy, sum(wx * (g.v - f.v)) AS vx, sum(wy * (g.v - f.v)) AS vy FROM v_ele3d f JOIN wt USING (ele_id) LEFT JOIN v_ele3d g ON g.t = f.t AND g.layer = f.layer AND g.ele_id = nei_id WHERE nei_id <> 0 GROUP BY ALL)
SELECT section, seq, ele_id, layer, t, (l1 * (nx1 * (u + 0.5 * (ux * dx1 + uy * dy1)) + ny1 * (v + 0.5 * (vx * dx1 + vy * dy1))) + l2 * (nx2 * (u + 0.5 * (ux * dx2 + uy * dy2)) + ny2 * (v + 0.5 * (vx * dx2 + vy * dy2)))) / (l1 + l2) * da0 * (1 + zeta / h) AS q FROM cell JOIN sl USING (ele_id, layer) JOIN ez USING (t, ele_id)""", r="q:4")
def t4_section_flux_lstsq(v):
    return T.section_flux(flow(v), cells(v), ["t"], weights(v)).select("section", "seq", "ele_id", "layer", "t", "q")


@query(f"WITH {VX}, {SECTION} SELECT section, seq, ele_id, t, layer, avg(salinity) AS salinity, avg(doxg) AS doxg FROM section JOIN vx USING (ele_id) JOIN v_dense3d USING (node_id) GROUP BY ALL", r="salinity doxg")
def t5_section_tracers(v):
    return T.section_tracers(v("v_dense3d"), v("v_mesh_element"), sections(v), ["salinity", "doxg"], ["t", "layer"])
