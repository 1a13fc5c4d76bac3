"""Queries of observation operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from estuary.operators import observations as V
from estuary.plans.base import Book
from estuary.plans.q_extract import SIGMA, sigma
from estuary.plans.q_mesh import EDGE, REGION, region
from estuary.session import scratch
from estuary.sources import store

BOOK = Book()
query = BOOK.query
QUERIES, ORACLE_SQL = BOOK.queries, BOOK.oracle

T0, T1 = datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 25)
INSIDE = f"{EDGE}, {REGION}, inside AS (SELECT location_id FROM v_station s JOIN region_edge ON y1 <> y2 AND least(y1, y2) <= s.y AND s.y < greatest(y1, y2) AND s.x < x1 + (s.y - y1) / (y2 - y1) * (x2 - x1) GROUP BY location_id HAVING count(*) % 2 = 1)"
#: Model steps every seven hours.
STEPS = "steps AS (SELECT DISTINCT ts FROM v_hourly WHERE epoch(ts) % (7 * 3600) = 0), span AS (SELECT ts, ts - (ts - lag(ts) OVER (ORDER BY ts)) / 2 AS lo, ts + (lead(ts) OVER (ORDER BY ts) - ts) / 2 AS hi FROM steps)"
SKILL = "count(*) AS n, avg(modelled) - avg(observed) AS bias, sqrt(avg((observed - modelled) * (observed - modelled))) AS rmse, 1 - avg((observed - modelled) * (observed - modelled)) / nullif(var_pop(observed), 0) AS nse, regr_slope(modelled, observed) AS slope, regr_intercept(modelled, observed) AS intercept, abs(corr(modelled, observed)) AS r"
LAYERED = f"{SIGMA}, layered AS (SELECT o.*, h, CAST(greatest(1, least(10, (SELECT count(*) FROM sigma WHERE -z_top * h < depth))) AS INTEGER) AS layer FROM v_obs o JOIN v_mesh_node n ON n.node_id = location_id + 1)"
PAIRS = f"{LAYERED}, pairs AS (SELECT l.id, l.ts, l.depth, l.location_id, l.cast_id, l.parameter_id, l.layer, l.value AS observed, f.doxg AS modelled FROM layered l JOIN (SELECT * FROM v_field3d WHERE run = 'control') f ON f.ts = date_trunc('day', l.ts) AND f.node_id = l.location_id + 1 AND f.layer = l.layer)"


def steps(v):
    return v("v_hourly").where("unix_seconds(ts) % (7 * 3600) = 0").select("ts")


def layered(v):
    placed = v("v_obs").withColumn("node_id", (F.col("location_id") + 1).cast("int")).join(v("v_mesh_node").select("node_id", "h"), "node_id").withColumn("zeta", F.lit(0.0))
    return V.sigma_of_depth(placed, sigma(v))


def pairs(v):
    obs = layered(v).withColumns({"model_ts": F.date_trunc("day", F.col("ts").cast("timestamp")), "observed": F.col("value")})
    field = V.model_value(v("v_field3d").where("run = 'control'"), "o2")
    return V.match_points(obs, field).select("id", "ts", "depth", "location_id", "cast_id", "parameter_id", "layer", "observed", "modelled")


@query("SELECT * FROM v_obs WHERE parameter_id = 'no3'", r="depth value", t="ts")
def s7_read_obs(v):
    path = scratch(v.spark, "observations")
    store.write_table(v("v_obs"), path, "parquet")
    return store.read_obs(v.spark, path).where("parameter_id = 'no3'")


@query(f"WITH {INSIDE} SELECT id, location_id, ts, depth, value FROM v_obs WHERE parameter_id IN ('o2', 'no3') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND location_id IN (FROM inside) AND id % 13 <> 0", r="depth value", t="ts")
def v1_select_obs(v):
    found = V.select_obs(v("v_obs"), v("v_station"), ["o2", "no3"], T0, T1, region(v), v("v_obs").where("id % 13 = 0"))
    return found.select("id", "location_id", "ts", "depth", "value")


@query("SELECT location_id, arg_min(node_id, (d, node_id)) AS node_id, min(d) AS dist FROM (SELECT location_id, node_id, sqrt(pow(n.x - s.x, 2) + pow(n.y - s.y, 2)) AS d FROM v_station s, v_mesh_node n) GROUP BY location_id", r="dist")
def v2_nearest_node(v):
    return V.nearest_node(v("v_station"), v("v_mesh_node"))


@query(f"WITH {STEPS} SELECT id, o.ts, s.ts AS model_ts FROM v_obs o JOIN span s ON (lo IS NULL OR o.ts > lo) AND (hi IS NULL OR o.ts <= hi)", t="ts model_ts")
def v3_nearest_time(v):
    return V.nearest_time(v("v_obs").select("id", "ts"), steps(v))


@query(f"WITH {LAYERED} SELECT id, layer FROM layered")
def v4_sigma_of_depth(v):
    return layered(v).select("id", "layer")


CASTS = f"""{SIGMA}, prof AS (SELECT cast_id, layer, -zz * h AS depth, temp AS modelled FROM (SELECT cast_id, CAST(min(location_id) + 1 AS INTEGER) AS node_id, min(date_trunc('day', ts)) AS ts FROM v_obs WHERE cast_id IS NOT NULL GROUP BY cast_id) c JOIN (SELECT ts, node_id, layer, avg(temp) AS temp FROM v_field3d GROUP BY ALL) f USING (ts, node_id) JOIN sigma USING (layer) JOIN v_mesh_node USING (node_id)),
pts AS (SELECT cast_id, depth AS d0, avg(value) AS v0 FROM v_obs WHERE cast_id IS NOT NULL GROUP BY ALL), seg AS (SELECT *, lead(d0) OVER w AS d1, lead(v0) OVER w AS v1 FROM pts WINDOW w AS (PARTITION BY cast_id ORDER BY d0)),
met AS (SELECT cast_id, layer, depth, CASE WHEN depth = d0 THEN v0 ELSE v0 + (v1 - v0) * (depth - d0) / (d1 - d0) END AS observed, modelled FROM prof JOIN seg USING (cast_id) WHERE depth >= d0 AND depth < d1 OR depth = d0)"""


def profiles(v):
    casts = v("v_obs").where("cast_id is not null").groupBy("cast_id").agg((F.min("location_id") + 1).cast("int").alias("node_id"), F.min(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("ts"))
    model = v("v_field3d").groupBy("ts", "node_id", "layer").agg(F.avg("temp").alias("modelled"))
    placed = casts.join(model, ["ts", "node_id"]).join(sigma(v), "layer").join(v("v_mesh_node").select("node_id", "h"), "node_id")
    return placed.select("cast_id", "layer", (-F.col("zz") * F.col("h")).alias("depth"), "modelled")


@query(f"WITH {CASTS} SELECT * FROM met", r="depth observed modelled")
def v5_match_cast(v):
    return V.match_cast(v("v_obs"), profiles(v))


@query("SELECT run, ts, node_id, layer, doxg * (1000.0 / 37) + temp * (1000.0 / 50) AS modelled FROM v_field3d", r="modelled", t="ts")
def v6_model_value(v):
    field = v("v_field3d").withColumns({"b1": F.col("doxg"), "b2": F.col("temp")})
    return V.model_value(field, "chla").select("run", "ts", "node_id", "layer", "modelled")


@query(f"WITH {PAIRS} SELECT * FROM pairs", r="depth observed modelled", t="ts")
def v7_match_points(v):
    return pairs(v)


@query(f"WITH {PAIRS} SELECT {SKILL} FROM pairs", r="bias rmse nse slope intercept r")
def v8_skill(v):
    return V.skill(pairs(v))


@query(f"WITH {PAIRS} SELECT layer, {SKILL} FROM pairs GROUP BY layer", r="bias rmse nse slope intercept r")
def v9_skill_by_layer(v):
    return V.skill(pairs(v), ["layer"])


@query(f"WITH {PAIRS} SELECT id, location_id FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ((id + 1) * 7919 % 104729) * 31 % 65537, id) AS i FROM pairs) WHERE i <= 20")
def v10_cap_per_station(v):
    return V.cap_per_station(pairs(v), 20).select("id", "location_id")


@query(f"WITH {PAIRS} SELECT id, modelled - observed AS residual FROM pairs", r="residual")
def v11_residuals(v):
    return V.residuals(pairs(v)).select("id", "residual")


NUTRIENTS = "nut AS (SELECT location_id, date_trunc('day', ts) AS ts, depth % 10 AS depth, parameter_id, avg(value) AS value FROM v_obs GROUP BY ALL)"


@query(f"WITH {NUTRIENTS} SELECT location_id, ts, depth, value * 14.01 / 1000 AS value FROM (SELECT location_id, ts, depth, value FROM nut WHERE parameter_id = 'no23' UNION ALL SELECT a.location_id, a.ts, a.depth, a.value + coalesce(b.value, 0) FROM (SELECT * FROM nut WHERE parameter_id = 'no3') a LEFT JOIN (SELECT * FROM nut WHERE parameter_id = 'no2') b USING (location_id, ts, depth))", r="value:9 depth", t="ts")
def v12_combine_no23(v):
    daily = v("v_obs").groupBy("location_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), (F.col("depth") % 10).alias("depth"), "parameter_id").agg(F.avg("value").alias("value"))
    return V.combine_no23(daily)


@query(f"""WITH {PAIRS}, c AS (SELECT location_id, layer, count(*) AS n FROM pairs GROUP BY ALL), b AS (SELECT *, min(layer) OVER (PARTITION BY location_id) AS lo, max(layer) OVER (PARTITION BY location_id) AS hi, sum(n) OVER (PARTITION BY location_id) AS total FROM c),
w AS (SELECT *, CASE WHEN hi > lo THEN cos(2 * pi() / (hi - lo) * (layer - lo)) ELSE 1 END + 6.8 * n / total AS val FROM b), t AS (SELECT *, coalesce(lag(val) OVER q, -1) AS p, coalesce(lead(val) OVER q, -1) AS s FROM w WINDOW q AS (PARTITION BY location_id ORDER BY layer))
SELECT location_id, min(layer) AS low, max(layer) AS high FROM t WHERE val > p AND val > s GROUP BY location_id""")
def v13_pick_layers(v):
    return V.pick_layers(pairs(v), 10)


NEAR = f"{LAYERED}, near AS (SELECT *, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) AS gap FROM layered WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) <= 2 * 86400000000)"


@query(f"""WITH {NEAR}, c AS (SELECT location_id, cast_id, row_number() OVER (PARTITION BY location_id ORDER BY abs(avg(epoch_us(ts)) - epoch_us(TIMESTAMP '2024-01-15')), cast_id) AS i FROM near WHERE cast_id IS NOT NULL GROUP BY location_id, cast_id)
SELECT id, location_id, cast_id, layer FROM near JOIN c USING (location_id, cast_id) WHERE i = 1
UNION ALL SELECT id, location_id, cast_id, layer FROM (SELECT *, row_number() OVER (PARTITION BY location_id, layer ORDER BY gap, id) AS i FROM near WHERE location_id NOT IN (SELECT location_id FROM c)) WHERE i = 1""")
def v14_best_obs(v):
    return V.best_obs(layered(v), datetime.datetime(2024, 1, 15), 2)


@query("""WITH m AS (SELECT ts + INTERVAL 8 HOURS AS ts, v / 10 AS observed FROM v_hourly), j AS (SELECT ts, observed, n AS modelled FROM m JOIN v_hourly USING (ts)), k AS (SELECT * FROM j WHERE ts >= (SELECT min(ts) FROM j) + INTERVAL 5 DAYS)
SELECT count(*) AS n, regr_slope(modelled, observed) AS slope, corr(modelled, observed) AS r, sqrt(avg(pow(observed - modelled, 2))) AS rmse, avg(modelled) - avg(observed) AS bias, round(100 * sqrt(avg(pow(observed - modelled, 2))) / (max(observed) - min(observed)), 1) AS pct_of_range FROM k""", r="slope r rmse bias pct_of_range")
def v15_tide_skill(v):
    hours = v("v_hourly")
    return V.tide_skill(hours.select("ts", (F.col("v") / 10).alias("level")), hours.select("ts", F.col("n").cast("double").alias("zeta")))


@query(f"WITH {LAYERED} SELECT id, f.temp AS model_temp, f.salinity AS model_salt FROM layered l LEFT JOIN (SELECT * FROM v_field3d WHERE run = 'control') f ON f.ts = date_trunc('day', l.ts) AND f.node_id = l.location_id + 1 AND f.layer = l.layer", r="model_temp model_salt")
def v16_refill_pairs(v):
    table = layered(v).select("id", "node_id", "layer", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("model_ts"))
    return V.refill_pairs(table, v("v_field3d").where("run = 'control'"), ["temp", "salt"]).select("id", "model_temp", "model_salt")


@query("SELECT parameter_id, count(*) AS n, count(DISTINCT cast_id) AS casts FROM v_obs GROUP BY parameter_id")
def v17_obs_counts(v):
    return V.obs_counts(v("v_obs"), ["parameter_id"])


@query("""WITH o AS (SELECT *, CAST(floor((day(ts) - 1) / (31 / 3.0)) AS INTEGER) AS band FROM v_obs), c AS (SELECT location_id, band, cast_id, row_number() OVER (PARTITION BY location_id, band ORDER BY cast_id) AS i FROM o WHERE cast_id IS NOT NULL GROUP BY location_id, band, cast_id HAVING count(*) >= 2),
p AS (SELECT location_id, band, cast_id, row_number() OVER (PARTITION BY location_id, band ORDER BY ((cast_id + 1) * 7919 % 104729) * 31 % 65537, cast_id) AS j FROM c WHERE i <= 10)
SELECT location_id, band, cast_id FROM (SELECT DISTINCT location_id, band FROM o) LEFT JOIN (FROM p WHERE j = 1) USING (location_id, band)""")
def v18_pick_cast(v):
    return V.pick_cast(v("v_obs"))


@query(f"WITH {CASTS} SELECT cast_id, layer, p.depth, observed, p.modelled FROM prof p LEFT JOIN met USING (cast_id, layer)", r="depth observed modelled")
def v19_profile_pair(v):
    return V.profile_pair(v("v_obs"), profiles(v))


@query(f"WITH {PAIRS}, m AS (SELECT * FROM pairs WHERE location_id = 3 AND layer = 10), s AS (SELECT {SKILL} FROM m HAVING count(*) > 2) SELECT m.id, m.ts, observed, modelled, (SELECT avg(depth) FROM m) AS mean_depth, s.* FROM m LEFT JOIN s ON true", r="observed modelled mean_depth bias rmse nse slope intercept r", t="ts")
def v20_station_layer_series(v):
    return V.station_layer_series(pairs(v), 3, 10)
