"""Queries of threshold and comparison operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuary.operators import mesh as M
from estuary.operators import thresholds as D
from estuary.operators.eof import eof
from estuary.plans.base import Book
from estuary.plans.q_extract import SIGMA, sigma

BOOK = Book()
query = BOOK.query
QUERIES, ORACLE_SQL = BOOK.queries, BOOK.oracle

LIMIT, CONTROL = 40.0, "control"
DELTA = "delta AS (SELECT s.run, ts, node_id, s.doxg - c.doxg AS delta FROM v_field2d s JOIN (SELECT * FROM v_field2d WHERE run = 'control') c USING (ts, node_id) WHERE s.run <> 'control')"
AREA = """tri AS (SELECT [n1, n2, n3] AS nv, abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2 AS area FROM v_mesh_element e
  JOIN v_mesh_node a ON n1 = a.node_id JOIN v_mesh_node b ON n2 = b.node_id JOIN v_mesh_node c ON n3 = c.node_id),
na AS (SELECT node_id, sum(area) / 3 AS area FROM (SELECT unnest(nv) AS node_id, area FROM tri) GROUP BY 1)"""
BELOW = f"{AREA}, below AS (SELECT run, ts, sum(CASE WHEN doxg < 40 THEN area END) / 1e6 AS area_km2 FROM v_field2d JOIN na USING (node_id) GROUP BY run, ts)"
HOURS = "hours AS (SELECT run, node_id, count(*) FILTER (doxg < 40) * CAST(24 AS DOUBLE) AS hours FROM v_field2d GROUP BY run, node_id)"


def delta(v):
    return D.run_delta(v("v_field2d"), CONTROL, "doxg")


def below(v):
    return D.area_below(v("v_field2d"), M.node_area(v("v_mesh_node"), v("v_mesh_element")), "doxg", LIMIT)


def hours(v):
    return D.duration_below(v("v_field2d"), "doxg", LIMIT, 24.0)


@query(f"WITH {DELTA} SELECT * FROM delta", r="delta", t="ts")
def d1_run_delta(v):
    return delta(v)


@query(f"WITH {DELTA} SELECT run, node_id, min(delta) AS worst FROM delta GROUP BY run, node_id", r="worst")
def d2_worst_by_node(v):
    return D.worst_by_node(delta(v))


@query(f"WITH {DELTA} SELECT run, ts, node_id, delta FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY delta, ts, node_id) AS i FROM delta) WHERE i = 1", r="delta", t="ts")
def d3_argmin_cell(v):
    return D.argmin_cell(delta(v))


@query(f"WITH {BELOW} SELECT * FROM below", r="area_km2", t="ts")
def d4_area_below(v):
    return below(v)


@query("SELECT run, node_id, count(*) FILTER (doxg < 40) * CAST(24 AS DOUBLE) AS hours, CAST((SELECT epoch(max(ts) FILTER (i = 3)) - epoch(max(ts) FILTER (i = 2)) FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM v_field2d))) AS BIGINT) AS step FROM v_field2d GROUP BY run, node_id", r="hours")
def d5_duration_below(v):
    return hours(v).join(D.time_step(v("v_field2d").select("ts").distinct()), how="cross")


@query(f"WITH {AREA}, {SIGMA} SELECT run, ts, sum(CASE WHEN doxg < 40 THEN area * dz * h END) / 1e9 AS volume_km3 FROM v_field3d JOIN na USING (node_id) JOIN v_mesh_node USING (node_id) JOIN sigma USING (layer) GROUP BY run, ts", r="volume_km3", t="ts")
def d6_volume_below(v):
    return D.volume_below(v("v_field3d"), M.layer_volume(v("v_mesh_node"), v("v_mesh_element"), sigma(v)), "doxg", LIMIT)


@query(f"WITH {HOURS}, d AS (SELECT s.run, s.hours - c.hours AS d FROM hours s JOIN hours c USING (node_id) WHERE s.run <> 'control' AND c.run = 'control') SELECT run, max(d) AS most, min(d) AS least, quantile_cont(abs(d), 0.999) AS spread FROM d GROUP BY run", r="most least spread")
def d7_duration_diff(v):
    return D.duration_diff(hours(v), CONTROL)


@query("SELECT run, node_id, quantile_cont(doxg, 0.1) AS q10, quantile_cont(doxg, 0.5) AS q50, min(doxg) AS q0 FROM v_field2d GROUP BY run, node_id", r="q10 q50 q0")
def d8_quantile_by_node(v):
    return D.quantile_by_node(v("v_field2d"), "doxg", [0.1, 0.5, 0.0])


@query(f"WITH {BELOW} SELECT run, date_trunc('week', ts) AS week, max(area_km2) AS area_km2 FROM below GROUP BY 1, 2", r="area_km2", t="week")
def d9_weekly_max(v):
    return D.weekly_max(below(v), "area_km2")


@query(f"WITH {BELOW} SELECT run, ts, area_km2 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY area_km2 DESC, ts) AS i FROM below WHERE area_km2 IS NOT NULL) WHERE i = 1", r="area_km2", t="ts")
def d10_peak(v):
    return D.peak(below(v).where("area_km2 is not null"), "area_km2")


@query(f"WITH {BELOW} SELECT max(p) AS largest, min(p) AS smallest FROM (SELECT max(area_km2) AS p FROM below GROUP BY run)", r="largest smallest")
def d10_peak_range(v):
    return D.peak_range(D.peak(below(v), "area_km2"), "area_km2")


@query(f"WITH {BELOW}, {DELTA}, pk AS (SELECT run, ts FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY area_km2 DESC NULLS LAST, ts) AS i FROM below) WHERE i = 1) SELECT run, node_id, delta FROM delta JOIN pk USING (run, ts)", r="delta")
def d11_slice_at_peak(v):
    return D.slice_at_peak(delta(v), D.peak(below(v), "area_km2"))


@query(f"WITH {BELOW} SELECT *, avg(area_km2) OVER (PARTITION BY run ORDER BY ts RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW) AS rolling FROM below", r="area_km2 rolling", t="ts")
def d12_rolling_mean(v):
    return D.rolling_mean(below(v), "area_km2")


@query("SELECT site, ts, max(doxg) FILTER (run = 'control') AS control, max(doxg) FILTER (run = 'scenario') AS scenario FROM v_field2d JOIN (SELECT node_id, 'site' || CAST(node_id AS VARCHAR) AS site FROM v_mesh_node WHERE node_id % 10 = 1) USING (node_id) GROUP BY site, ts", r="control scenario", t="ts")
def d13_site_series(v):
    sites = v("v_mesh_node").where("node_id % 10 = 1").select("node_id", F.concat(F.lit("site"), F.col("node_id").cast("string")).alias("site"))
    return D.site_series(v("v_field2d"), sites, ["control", "scenario"], "doxg")


@query(f"WITH {HOURS}, w AS (SELECT node_id FROM hours WHERE run <> 'control' ORDER BY hours DESC, node_id LIMIT 1) SELECT run, ts, node_id, doxg FROM v_field2d JOIN w USING (node_id)", r="doxg", t="ts")
def d14_worst_node_series(v):
    return D.worst_node_series(v("v_field2d"), hours(v), CONTROL, "doxg")


@query(f"WITH {BELOW} SELECT *, 100 * area_km2 / (SELECT sum(area) / 1e6 FROM na) AS pct FROM below", r="area_km2 pct", t="ts")
def d15_pct_of_total(v):
    total = M.node_area(v("v_mesh_node"), v("v_mesh_element")).agg((F.sum("area") / 1e6).alias("total"))
    return D.pct_of_total(below(v), total, "area_km2")


@query()
def d16_eof(v):
    bottom = v("v_dense3d").where("layer = 10").select("t", "node_id", F.col("doxg").alias("delta"))
    weights = M.node_area(v("v_mesh_node"), v("v_mesh_element")).join(v("v_mesh_node").select("node_id", "h"), "node_id")
    return eof(bottom, weights.select("node_id", (F.col("area") * F.col("h")).alias("weight")), modes=3)
