"""Queries of extraction and water-column operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from estuary.operators import extraction as X
from estuary.operators import mesh as M
from estuary.operators import profile as N
from estuary.operators import thresholds as D
from estuary.plans.base import Book

BOOK = Book()
query = BOOK.query
QUERIES, ORACLE_SQL = BOOK.queries, BOOK.oracle

LAYERS = 10
SIGMA = """sigma AS (SELECT layer, z_top, z_bot, (z_top + z_bot) / 2 AS zz, z_top - z_bot AS dz FROM (
  SELECT CAST(k AS INTEGER) AS layer, -pow((k - 1) / 10.0, 1.5) AS z_top, -pow(k / 10.0, 1.5) AS z_bot FROM range(1, 11) r(k)) s0)"""
CV = "cv AS (SELECT node_id FROM v_mesh_node WHERE x < 6000)"


def cubic_sql(x: str, coefficients: tuple) -> str:
    return " + ".join(f"({c!r}) * pow({x}, {3 - i})" for i, c in enumerate(coefficients))


DENSITY = "((({first}) * ({warm}) + {cool}) * ({second}) - pow(temp - {coldest}, 2) * (temp + {shift}) / ({slope} * (temp + {pole})))".format(
    first=cubic_sql("salinity", (*N.SALT, N.SALT_ENDS[0])), second=cubic_sql("salinity", (*N.SALT, N.SALT_ENDS[1])), warm=cubic_sql("temp", N.WARM), cool=cubic_sql("temp", N.COOL), coldest=N.COLDEST, shift=N.SHIFT, slope=N.SLOPE, pole=N.POLE
)


def cv(v):
    return v("v_mesh_node").where("x < 6000").select("node_id")


def sigma(v):
    return N.sigma_layers(v.spark, LAYERS + 1)


@query("SELECT event_id, ts, value FROM events", r="value", t="ts")
def s1_read_field(v):
    return X.read_field(v.spark, [f"{v.sf_dir}/events.parquet"], ["event_id", "ts", "value"])


@query(f"WITH {CV} SELECT * FROM v_field2d WHERE node_id IN (SELECT node_id FROM cv)", r="doxg zeta", t="ts")
def x1_select_nodes(v):
    return X.select_nodes(v("v_field2d"), cv(v)).select("run", "ts", "node_id", "doxg", "zeta")


@query(f"WITH {CV} SELECT node_id FROM cv WHERE node_id % 5 <> 0")
def x2_mask_nodes(v):
    return X.mask_nodes(cv(v), v("v_mesh_node").where("node_id % 5 = 0"))


@query(f"WITH {CV} SELECT node_id FROM cv UNION SELECT node_id FROM v_mesh_node WHERE node_id % 7 = 0")
def x3_union_nodes(v):
    return X.union_nodes(cv(v), v("v_mesh_node").where("node_id % 7 = 0"))


@query(f"WITH {CV} SELECT ele_id FROM v_mesh_element WHERE n1 IN (SELECT node_id FROM cv) AND n2 IN (SELECT node_id FROM cv) AND n3 IN (SELECT node_id FROM cv)")
def x4_elements_within(v):
    return X.elements_within(v("v_mesh_element"), cv(v))


@query("SELECT * FROM v_field2d WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'", r="doxg zeta", t="ts")
def x5_time_range(v):
    return X.time_range(v("v_field2d"), datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 12))


@query("""WITH a AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t / 24.0 AS t FROM v_dense3d WHERE t % 2 = 0)),
b AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS j FROM (SELECT DISTINCT t / 24.0 + 0.00001 AS t FROM v_dense3d WHERE t % 2 = 0 AND t > 2))
SELECT CAST(min(i) AS INTEGER) AS first, CAST(max(i) + 1 AS INTEGER) AS last, CAST(min(j) AS INTEGER) AS "offset"
FROM a JOIN b ON round(a.t * 5000) = round(b.t * 5000)""")
def x6_align_times(v):
    days = v("v_dense3d").where("t % 2 = 0").select("t", (F.col("t") / 24.0).cast("double").alias("day"))
    return X.align_times(days, days.where("t > 2").withColumn("day", F.col("day") + 0.00001), "day")


@query("""WITH r AS (SELECT node_id, t, round((t * 3600 + 21) / 40.0) * 40 AS seconds FROM v_dense2d),
f AS (SELECT seconds AS s4 FROM (SELECT DISTINCT seconds FROM r) ORDER BY seconds LIMIT 1 OFFSET 3)
SELECT node_id, t, seconds + CASE WHEN (s4 + 40) % 60 = 0 THEN 40 WHEN (s4 - 40) % 60 = 0 THEN -40 ELSE 0 END AS seconds FROM r, f""", r="seconds")
def x7_tweak_times(v):
    return X.tweak_times(v("v_dense2d").select("node_id", "t", (F.col("t") * 3600 + 21).alias("seconds")))


@query("SELECT run, ts, node_id, doxg FROM v_field3d WHERE layer = 10", r="doxg", t="ts")
def x8_slice_layer(v):
    return X.slice_layer(v("v_field3d"), "bottom", LAYERS).select("run", "ts", "node_id", "doxg")


@query(f"WITH {SIGMA} SELECT run, ts, node_id, sum(doxg * dz) / sum(CASE WHEN doxg IS NOT NULL THEN dz END) AS doxg FROM (SELECT run, ts, node_id, layer, CASE WHEN doxg > 10 THEN doxg END AS doxg FROM v_field3d) f JOIN sigma USING (layer) GROUP BY ALL", r="doxg", t="ts")
def x9_reduce_layers(v):
    field = v("v_field3d").withColumn("doxg", F.when(F.col("doxg") > 10, F.col("doxg")))
    return X.reduce_layers(field, sigma(v), "doxg", "mean")


@query("""WITH a AS (SELECT *, avg(iavg) OVER (PARTITION BY node_id, layer ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM v_dense3d),
b AS (SELECT *, first_value(m) OVER (PARTITION BY t, node_id ORDER BY layer) AS top FROM a)
SELECT t, node_id, layer, CASE WHEN NOT (m = 0 OR m < top * 0.01) THEN doxg END AS doxg FROM b""", r="doxg")
def x10_photic_mask(v):
    return X.photic_mask(v("v_dense3d"), "doxg", steps=3).select("t", "node_id", "layer", "doxg")


@query("SELECT ts, node_id, max(doxg) FILTER (run = 'control') AS control_doxg, max(doxg) FILTER (run = 'scenario') AS scenario_doxg FROM v_field2d GROUP BY ts, node_id", r="control_doxg scenario_doxg", t="ts")
def x11_combine_runs(v):
    return X.combine_runs(v("v_field2d"), ["control", "scenario"], "doxg")


@query(f"""WITH {SIGMA}, {CV}, f AS (SELECT * FROM v_field3d WHERE node_id IN (SELECT node_id FROM cv) AND ts >= TIMESTAMP '2024-01-03')
SELECT * FROM (SELECT run, ts, node_id, doxg AS doxg_bottom FROM f WHERE layer = 10)
FULL JOIN (SELECT run, ts, node_id, sum(temp * dz) / sum(CASE WHEN temp IS NOT NULL THEN dz END) AS temp_mean FROM f JOIN sigma USING (layer) GROUP BY run, ts, node_id) USING (run, ts, node_id)
FULL JOIN (SELECT run, ts, node_id, max(salinity) AS salinity_max FROM f GROUP BY run, ts, node_id) USING (run, ts, node_id)""", r="doxg_bottom temp_mean salinity_max", t="ts")
def x12_extract(v):
    return X.extract(v("v_field3d"), sigma(v), LAYERS, ("DOXG:bottom", "TEMP:mean", "SALINITY:max"), cv(v), datetime.datetime(2024, 1, 3))


@query("SELECT a.run, a.ts, a.node_id, a.doxg, b.zeta FROM (SELECT * FROM v_field3d WHERE layer = 10) a LEFT JOIN v_field2d b USING (run, ts, node_id)", r="doxg zeta", t="ts")
def x13_zeta_per_run(v):
    return X.zeta_per_run(v("v_field3d").where("layer = 10").select("run", "ts", "node_id", "doxg"), v("v_field2d"))


@query("SELECT ts, max(temp) FILTER (node_id = 1) AS n1, max(temp) FILTER (node_id = 2) AS n2, max(temp) FILTER (node_id = 3) AS n3 FROM v_field3d WHERE run = 'control' AND layer = 3 AND node_id IN (1, 2, 3) AND temp IS NOT NULL GROUP BY ts", r="n1 n2 n3", t="ts")
def x14_station_matrix(v):
    return X.station_matrix(v("v_field3d").where("run = 'control'"), "temp", 3, [1, 2, 3])


@query("SELECT ts, node_id, temp FROM v_field3d WHERE run = 'control' AND layer = 3 AND temp IS NOT NULL", r="temp", t="ts")
def x14_station_series(v):
    return X.station_series(v("v_field3d").where("run = 'control'"), "temp", 3)


@query("SELECT ts, layer, temp, doxg FROM v_field3d WHERE node_id = 5", r="temp doxg", t="ts")
def x15_station_select(v):
    return X.station_select(v("v_field3d"), 5, ["temp", "doxg"])


@query("SELECT CAST(t AS BIGINT) AS step, t / 24.0 AS day, node_id, layer, doxg AS value FROM v_dense3d WHERE t < (SELECT max(t) FROM v_dense3d)", r="day value")
def s4_unpack_ijk(v):
    dense = v("v_dense3d").join(v("v_dense3d").agg(F.max("t").alias("last")), how="cross").where("t < last")
    order = F.sort_array(F.collect_list(F.struct("node_id", "layer", "doxg")))
    packed = dense.groupBy(F.col("t").cast("long").alias("step")).agg(F.transform(order, lambda x: x["doxg"]).alias("ijk"))
    return X.unpack_ijk(packed, LAYERS)


@query(f"SELECT t, node_id, layer, {DENSITY} AS rho FROM v_dense3d", r="rho")
def n1_density(v):
    return N.with_density(v("v_dense3d")).select("t", "node_id", "layer", "rho")


def column_fields(v):
    still = v("v_dense3d").join(v("v_dense2d"), ["t", "node_id"]).join(v("v_mesh_node").select("node_id", "h"), "node_id")
    return still.join(sigma(v), "layer")


N2_SQL = f"""WITH {SIGMA}, p AS (SELECT t, node_id, layer, zz * (h + zeta) AS z, {DENSITY} AS rho FROM v_dense3d JOIN v_dense2d USING (t, node_id) JOIN v_mesh_node USING (node_id) JOIN sigma USING (layer)),
a AS (SELECT *, lead(z) OVER w - z AS h1, (lead(rho) OVER w - rho) / (lead(z) OVER w - z) AS d1 FROM p WINDOW w AS (PARTITION BY t, node_id ORDER BY z)),
b AS (SELECT *, lag(h1) OVER w AS h0, lag(d1) OVER w AS d0, lag(h1, 2) OVER w AS h00, lag(d1, 2) OVER w AS d00, lead(h1) OVER w AS h2, lead(d1) OVER w AS d2 FROM a WINDOW w AS (PARTITION BY t, node_id ORDER BY z)),
e AS (SELECT *, CASE WHEN d0 IS NULL THEN h1 ELSE h0 END AS ha, CASE WHEN d0 IS NULL THEN h2 ELSE h00 END AS hb, CASE WHEN d0 IS NULL THEN d1 ELSE d0 END AS da, CASE WHEN d0 IS NULL THEN d2 ELSE d00 END AS db FROM b),
g AS (SELECT *, ((2 * ha + hb) * da - ha * db) / (ha + hb) AS raw FROM e),
s AS (SELECT *, CASE WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN CASE WHEN d0 * d1 <= 0 THEN 0 ELSE (3 * h1 + 3 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) END
  WHEN db IS NULL THEN da WHEN raw * da <= 0 THEN 0 WHEN da * db <= 0 AND abs(raw) > 3 * abs(da) THEN 3 * da ELSE raw END AS slope FROM g)
"""


@query(N2_SQL + "SELECT t, node_id, layer, -9.81 / (1000 + z) * slope AS n2 FROM s", r="n2:8")
def n2_buoyancy(v):
    field = N.with_density(column_fields(v)).withColumn("z", F.col("zz") * (F.col("h") + F.col("zeta")))
    return N.buoyancy(field, ["t", "node_id"]).select("t", "node_id", "layer", "n2")


@query(N2_SQL + "SELECT t, node_id, arg_min(-9.81 / (1000 + z) * slope, (slope, z)) AS n2_max FROM s GROUP BY t, node_id", r="n2_max:8")
def n2_buoyancy_max(v):
    field = N.with_density(column_fields(v)).withColumn("z", F.col("zz") * (F.col("h") + F.col("zeta")))
    return N.buoyancy(field, ["t", "node_id"], "max")


@query(f"WITH {SIGMA} SELECT t, node_id, layer, -(h + zeta) * zz AS depth, -(h + zeta) * z_top AS depth_top, -(h + zeta) * z_bot AS depth_bot FROM v_dense3d JOIN v_dense2d USING (t, node_id) JOIN v_mesh_node USING (node_id) JOIN sigma USING (layer)", r="depth depth_top depth_bot")
def n3_layer_depth(v):
    field = v("v_dense3d").join(v("v_dense2d"), ["t", "node_id"]).join(v("v_mesh_node").select("node_id", "h"), "node_id")
    return N.layer_depth(field.select("t", "node_id", "layer", "h", "zeta"), sigma(v)).drop("h", "zeta")


@query(f"WITH {SIGMA} SELECT node_id, layer, z_top * h AS z_top, z_bot * h AS z_bot, zz, dz FROM sigma, v_mesh_node", r="z_top z_bot zz dz")
def n4_sigma_layers(v):
    levels = sigma(v).join(v("v_mesh_node").select("node_id", "h"), how="cross")
    return levels.select("node_id", "layer", (F.col("z_top") * F.col("h")).alias("z_top"), (F.col("z_bot") * F.col("h")).alias("z_bot"), "zz", "dz")


@query(f"""WITH n AS (SELECT t, node_id, layer, temp, salinity, {DENSITY} * 1e-3 AS rho FROM v_dense3d),
vx AS (SELECT ele_id, unnest([n1, n2, n3]) AS node_id FROM v_mesh_element)
SELECT t, layer, ele_id, avg(temp) AS temp, avg(salinity) AS salinity, avg(rho) AS rho FROM vx JOIN n USING (node_id) GROUP BY ALL""", r="temp salinity rho")
def n5_derive_state(v):
    return M.node_to_element(N.with_density(v("v_dense3d"), 1e-3), v("v_mesh_element"), ["temp", "salinity", "rho"], ["t", "layer"])


FLAGSHIP = """WITH tri AS (SELECT e.ele_id, abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2 AS area, [n1, n2, n3] AS nv FROM v_mesh_element e
  JOIN v_mesh_node a ON n1 = a.node_id JOIN v_mesh_node b ON n2 = b.node_id JOIN v_mesh_node c ON n3 = c.node_id),
na AS (SELECT node_id, sum(area) / 3 AS area FROM (SELECT unnest(nv) AS node_id, area FROM tri) GROUP BY 1),
bottom AS (SELECT run, ts, node_id, doxg FROM v_field3d WHERE layer = 10)
SELECT run, ts, sum(CASE WHEN doxg < 40 THEN area END) / 1e6 AS area_km2 FROM bottom JOIN na USING (node_id) GROUP BY run, ts"""


@query(FLAGSHIP, r="area_km2", t="ts")
def flagship_hypoxic_area(v):
    bottom = X.slice_layer(v("v_field3d"), "bottom", LAYERS).select("run", "ts", "node_id", "doxg")
    return D.area_below(bottom, M.node_area(v("v_mesh_node"), v("v_mesh_element")), "doxg", 40.0)
