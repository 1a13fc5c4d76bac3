"""Queries of series filters, section sums and budgets."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from estuary.operators import budgets as B
from estuary.operators import mesh as M
from estuary.operators import series as S
from estuary.operators import transport as T
from estuary.plans.base import Book
from estuary.plans.q_extract import CV, SIGMA, cv, sigma
from estuary.plans.q_thresholds import AREA

BOOK = Book()
query = BOOK.query
QUERIES, ORACLE_SQL = BOOK.queries, BOOK.oracle

HOUR = 3600.0
PHI = ", ".join(repr(w) for w in S.gaussian_weights())
DERIV = f"""dn AS (SELECT ts, v, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM v_hourly),
dw AS (SELECT k - 4 AS k, list_extract([{PHI}], CAST(k + 1 AS BIGINT)) AS w FROM range(0, 9) r(k)),
deriv AS (SELECT a.ts, sum(w * b.v) / 3600 AS derivative FROM dn a, dw JOIN dn b ON b.i = CASE WHEN a.i + k < 1 THEN 1 - (a.i + k) WHEN a.i + k > a.n THEN 2 * a.n + 1 - (a.i + k) ELSE a.i + k END WHERE a.i > 1 GROUP BY a.ts)"""


def godin_sql(source: str, columns: list[str], name: str, keys: str = "") -> str:
    """Three chained means as CTEs name_1, name_2 and name."""
    out, previous, by = [], source, f"PARTITION BY {keys} " if keys else ""
    for i, (low, high) in enumerate(((12, 11), (11, 12), (12, 12))):
        here = name if i == 2 else f"{name}_{i + 1}"
        frame = f"OVER ({by}ORDER BY ts RANGE BETWEEN INTERVAL {low} HOURS PRECEDING AND INTERVAL {high} HOURS FOLLOWING)"
        swaps = ", ".join(f"CASE WHEN count({c}) {frame} = {low + high + 1} THEN avg({c}) {frame} END AS {c}" for c in columns)
        out.append(f"{here} AS (SELECT * REPLACE ({swaps}) FROM {previous})")
        previous = here
    return ", ".join(out)


INTO = "into_cv AS (SELECT section, section < 'p' AS \"into\" FROM (SELECT DISTINCT section FROM v_section_flux))"
TURNED = f"{INTO}, turned AS (SELECT f.* REPLACE (CASE WHEN \"into\" THEN q ELSE -q END AS q) FROM v_section_flux f JOIN into_cv USING (section))"
BULK = "bulk AS (SELECT section, ts, CAST(floor(salt / 1.5) AS INTEGER) AS bin, sum(q) AS q, (floor(salt / 1.5) + 0.5) * 1.5 AS s FROM v_section_flux GROUP BY section, ts, floor(salt / 1.5))"
SUMS = f"{INTO}, {BULK}, sums AS (SELECT section, ts, sum(CASE WHEN q > 0 THEN q ELSE 0 END) AS q_in, sum(CASE WHEN q < 0 THEN q ELSE 0 END) AS q_out, sum(CASE WHEN q > 0 THEN q * s ELSE 0 END) AS qs_in, sum(CASE WHEN q < 0 THEN q * s ELSE 0 END) AS qs_out FROM (SELECT b.* REPLACE (CASE WHEN \"into\" THEN q ELSE -q END AS q) FROM bulk b JOIN into_cv USING (section)) GROUP BY section, ts)"
LAYERS2 = f"{SUMS}, two AS (SELECT section, ts, q_in, q_out, qs_in / nullif(q_in, 0) AS s_in, qs_out / nullif(q_out, 0) AS s_out, q_in + q_out AS q_net FROM sums)"


def into(v):
    return v("v_section_flux").select("section").distinct().withColumn("into", F.col("section") < "p")


def sums(v):
    return T.bulk_in_out(T.salinity_bins(v("v_section_flux"), 1.5), into(v))


@query("SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM v_hourly WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20') WHERE i % 4 = 0", t="ts")
def t2_hourly_subset(v):
    return T.hourly_subset(v("v_hourly"), 4, datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 20))


@query("SELECT section, seq, layer, CAST(month(ts) AS INTEGER) AS month, avg(q) AS q_mean, avg(q) - 2 * stddev_pop(q) AS q_low, avg(q) + 2 * stddev_pop(q) AS q_high, avg(salt) AS salt_mean, avg(salt) - 2 * stddev_pop(salt) AS salt_low, avg(salt) + 2 * stddev_pop(salt) AS salt_high FROM (SELECT *, max(ts) OVER (PARTITION BY section, year(ts), month(ts)) AS last FROM v_section_flux) WHERE ts < last GROUP BY section, seq, layer, month(ts)", r="q_mean q_low q_high salt_mean salt_low salt_high")
def t6_section_monthly_mean(v):
    return T.section_monthly_mean(v("v_section_flux"), ["q", "salt"])


@query(f"WITH {TURNED} SELECT section, ts, sum(CASE WHEN q > 0 THEN q ELSE 0 END) AS q_in, sum(CASE WHEN q < 0 THEN q ELSE 0 END) AS q_out FROM turned GROUP BY section, ts", r="q_in q_out", t="ts")
def t7_prism_transport(v):
    return T.prism_transport(v("v_section_flux"), into(v))


@query(f"WITH {TURNED} SELECT section, ts, sum(CASE WHEN q > 0 THEN q * salt * (1 + zeta / h) ELSE 0 END) AS salt_in, sum(CASE WHEN q < 0 THEN q * salt * (1 + zeta / h) ELSE 0 END) AS salt_out FROM turned GROUP BY section, ts", r="salt_in salt_out", t="ts")
def t8_prism_salt(v):
    return T.prism_salt(v("v_section_flux"), into(v))


@query(f"WITH {SUMS} SELECT * FROM sums", r="q_in q_out qs_in qs_out", t="ts")
def t9_bulk_in_out(v):
    return sums(v)


@query(f"WITH {LAYERS2} SELECT * FROM two", r="q_in q_out s_in s_out q_net", t="ts")
def t10_bulk_two_layer(v):
    return T.bulk_two_layer(sums(v))


@query(f"WITH {LAYERS2} SELECT section, CAST(last_day(ts) - 15 AS DATE) AS stamp, avg(q_in) AS q_in, avg(s_in) AS s_in, CAST(dayofyear(last_day(ts) - 15) AS INTEGER) AS day FROM two GROUP BY section, last_day(ts)", r="q_in s_in")
def t11_bulk_monthly(v):
    return T.bulk_monthly(T.bulk_two_layer(sums(v)), ["q_in", "s_in"])


VOLUMES = f"{AREA}, {SIGMA}, {CV}, cell AS (SELECT t, node_id, layer, area, area * dz * h * (1 + zeta / h) AS volume FROM v_dense2d JOIN na USING (node_id) JOIN v_mesh_node USING (node_id), sigma)"


def volumes(v):
    return M.layer_volume(v("v_mesh_node"), v("v_mesh_element"), sigma(v), v("v_dense2d")).drop("zeta")


@query(f"WITH {VOLUMES} SELECT t, sum(volume) AS volume, sum(volume * salinity) AS v_salinity, sum(volume * doxg) AS v_doxg FROM v_dense3d JOIN cell USING (t, node_id, layer) WHERE node_id IN (FROM cv) GROUP BY t", r="volume:1 v_salinity:1 v_doxg:1")
def b1_cv_integrals(v):
    return B.cv_integrals(v("v_dense3d"), volumes(v), cv(v), ["salinity", "doxg"], ["t"])


@query(f"""WITH {VOLUMES}, c AS (SELECT * FROM v_dense3d JOIN cell USING (t, node_id, layer) WHERE node_id IN (FROM cv))
SELECT t, 'doxg' AS rate, sum(doxg * volume / 86400) AS total FROM c GROUP BY t UNION ALL SELECT t, 'temp', sum(temp * volume / 86400000) FROM c GROUP BY t
UNION ALL SELECT t, 'salinity', sum(CASE WHEN layer = 10 THEN salinity * area / 86400000 END) FROM c GROUP BY t UNION ALL SELECT t, 'iavg', sum(CASE WHEN layer = 10 THEN iavg * area / -86400 END) FROM c GROUP BY t""", r="total:3")
def b2_cv_rates(v):
    areas = M.node_area(v("v_mesh_node"), v("v_mesh_element"))
    return B.cv_rates(v("v_dense3d"), volumes(v), areas, cv(v), {"doxg": "per_day", "temp": "milli", "salinity": "flux", "iavg": "demand"}, ["t"], 10)


def hourly(v):
    return v("v_hourly").select("ts", "v", F.lit("all").alias("run"))


@query(f"WITH {DERIV} SELECT * FROM deriv", r="derivative:8", t="ts")
def b3_time_derivative(v):
    return S.time_derivative(hourly(v), "v", HOUR, ["run"]).select("ts", "derivative")


@query("""WITH k AS (SELECT ts, v FROM v_hourly WHERE n > 0), q AS (SELECT ts + INTERVAL 20 MINUTES AS ts FROM v_hourly WHERE ts < (SELECT max(ts) FROM v_hourly))
SELECT q.ts, k.v + (epoch(q.ts) - epoch(k.ts)) / (epoch(n.ts) - epoch(k.ts)) * (n.v - k.v) AS v FROM q ASOF JOIN k ON k.ts <= q.ts ASOF JOIN k n ON n.ts >= q.ts""", r="v", t="ts")
def b4_interp_to(v):
    last = v("v_hourly").agg(F.max("ts").alias("last"))
    asked = hourly(v).join(last, how="cross").where("ts < last").select("run", (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("ts"))
    return S.interpolate_to(hourly(v), asked, "v", ["run"]).drop("run")


@query(f"WITH {CV}, s AS (SELECT node_id FROM v_source_node WHERE node_id IN (FROM cv)) SELECT date, coalesce(sum(discharge) FILTER (node_id IN (FROM s)), 0) AS discharge, coalesce(sum(discharge * nh4) FILTER (node_id IN (FROM s)), 0) AS load_nh4 FROM v_loading GROUP BY date", r="discharge load_nh4")
def b5_river_inflow(v):
    return B.river_inflow(v("v_loading"), v("v_source_node"), cv(v), ["nh4"])


@query("SELECT ts, v FROM v_hourly WHERE ts <= (SELECT max(ts) FROM v_section_flux WHERE section = 'error')", r="v", t="ts")
def b6_truncate_to(v):
    return S.truncate_to(v("v_hourly").select("ts", "v"), v("v_section_flux").where("section = 'error'"))


@query(f"WITH {godin_sql('v_hourly', ['v'], 'g')} SELECT ts, v FROM g", r="v:9", t="ts")
def b7_godin(v):
    return S.godin(hourly(v), ["v"], ["run"]).select("ts", "v")


STORAGE = f"{DERIV}, ex AS (SELECT ts, sum(CASE WHEN q > 0 THEN q ELSE 0 END) AS q_in, sum(CASE WHEN q < 0 THEN q ELSE 0 END) AS q_out FROM v_section_flux WHERE section = 'view' GROUP BY ts), riv AS (SELECT ts, n / 10.0 AS q_r FROM v_hourly)"
VOLUME = f"{STORAGE}, base AS (SELECT ts, derivative AS dvdt, q_in, q_out, q_r FROM deriv LEFT JOIN ex USING (ts) LEFT JOIN riv USING (ts) WHERE q_in IS NOT NULL AND q_out IS NOT NULL), {godin_sql('base', ['dvdt', 'q_in', 'q_out', 'q_r'], 'g')}, vb AS (SELECT *, -dvdt + q_in + q_out + q_r AS error FROM g)"


def storage(v):
    return S.time_derivative(hourly(v), "v", HOUR, ["run"]).select("ts", F.col("derivative").alias("dvdt"))


def exchange(v):
    one = v("v_section_flux").where("section = 'view'")
    return T.prism_transport(one, one.select("section").distinct().withColumn("into", F.lit(True))).drop("section")


def rivers(v):
    return v("v_hourly").select("ts", (F.col("n") / 10.0).alias("q_r"))


@query(f"WITH {VOLUME} SELECT * FROM vb", r="dvdt:9 q_in:9 q_out:9 q_r:9 error:9", t="ts")
def b8_volume_budget(v):
    return B.volume_budget(storage(v), exchange(v), rivers(v))


SALT = f"{STORAGE}, sx AS (SELECT ts, sum(CASE WHEN q > 0 THEN q * salt * (1 + zeta / h) ELSE 0 END) AS s_in, sum(CASE WHEN q < 0 THEN q * salt * (1 + zeta / h) ELSE 0 END) AS s_out FROM v_section_flux WHERE section = 'view' GROUP BY ts) SELECT ts, derivative AS dsdt, s_in, s_out, -derivative + s_in + s_out AS error FROM deriv LEFT JOIN sx USING (ts)"


@query(f"WITH {SALT}", r="dsdt s_in s_out error", t="ts")
def b9_salt_budget(v):
    one = v("v_section_flux").where("section = 'view'")
    salt = T.prism_salt(one, one.select("section").distinct().withColumn("into", F.lit(True))).select("ts", F.col("salt_in").alias("s_in"), F.col("salt_out").alias("s_out"))
    return B.salt_budget(storage(v).withColumnRenamed("dvdt", "dsdt"), salt)


CONSTITUENT = f"{STORAGE}, base AS (SELECT ts, derivative AS dcdt, q_in, q_r FROM deriv LEFT JOIN ex USING (ts) LEFT JOIN riv USING (ts)), {godin_sql('base', ['dcdt', 'q_in', 'q_r'], 'g')} SELECT *, dcdt - coalesce(q_in, 0) - coalesce(q_r, 0) AS source_sink FROM g WHERE dcdt IS NOT NULL"


@query(f"WITH {CONSTITUENT}", r="dcdt:9 q_in:9 q_r:9 source_sink:9", t="ts")
def b10_constituent_budget(v):
    terms = rivers(v).join(exchange(v), "ts", "left").select("ts", "q_in", "q_r")
    return B.constituent_budget(storage(v).withColumnRenamed("dvdt", "dcdt"), terms, ["q_in", "q_r"])


@query(f"WITH {VOLUME} SELECT avg(error) AS mean_error, 100 * avg(error) / avg(q_r) AS pct_of_rivers, avg(abs(error)) / avg(abs(dvdt)) AS abs_per_storage, sqrt(avg(error * error)) AS rmse FROM (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM vb) WHERE i > 40", r="mean_error pct_of_rivers abs_per_storage rmse")
def b11_error_stats(v):
    return B.error_stats(B.volume_budget(storage(v), exchange(v), rivers(v)), 40)


@query(f"WITH {VOLUME} SELECT avg(error) AS mean_error, 100 * avg(error) / avg(q_r) AS pct_of_rivers, avg(abs(error)) / avg(abs(dvdt)) AS abs_per_storage, sqrt(avg(error * error)) AS rmse FROM (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM vb WHERE error IS NOT NULL) WHERE i > 5", r="mean_error pct_of_rivers abs_per_storage rmse")
def b12_tef_budget(v):
    return B.tef_budget(v("v_hourly").select("ts", F.col("v").alias("volume")), exchange(v), rivers(v), HOUR, skip=5)["stats"]


SECTIONS = ("click", "error", "purchase", "signup", "view")


def of_sections(sql: str) -> str:
    """The SQL of section 'view' for every section, with its name."""
    return " UNION ALL ".join(f"SELECT '{x}' AS section, * FROM (WITH {sql.replace(chr(39) + 'view' + chr(39), chr(39) + x + chr(39))})" for x in SECTIONS)


def budgets(v):
    """The budgets of all sections at once: the section is the key."""
    flux = v("v_section_flux")
    into = flux.select("section").distinct().withColumn("into", F.lit(True))
    salt = T.prism_salt(flux, into).select("section", "ts", F.col("salt_in").alias("s_in"), F.col("salt_out").alias("s_out"))
    both = T.prism_transport(flux, into).join(salt, ["section", "ts"])
    series = v("v_hourly").select("ts", F.col("v").alias("volume"), F.col("v").alias("v_salt"), F.col("v").alias("v_doxg"))
    storage = series.join(flux.select("section").distinct(), how="cross")
    return B.tef_budget(storage, both, rivers(v), HOUR, {"doxg": ["q_in", "q_r"]}, skip=5, keys=["section"])


@query(of_sections(f"{VOLUME} SELECT * FROM vb"), r="dvdt:9 q_in:9 q_out:9 q_r:9 error:9", t="ts")
def b12_tef_volumes(v):
    return budgets(v)["volume"]


@query(of_sections(f"{VOLUME} SELECT avg(error) AS mean_error, 100 * avg(error) / avg(q_r) AS pct_of_rivers, avg(abs(error)) / avg(abs(dvdt)) AS abs_per_storage, sqrt(avg(error * error)) AS rmse FROM (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM vb WHERE error IS NOT NULL) WHERE i > 5"), r="mean_error pct_of_rivers abs_per_storage rmse")
def b12_tef_stats(v):
    stats = budgets(v)["stats"]
    every = v("v_section_flux").select("section").distinct()
    return every.join(stats, "section", "left")


@query(of_sections(f"{SALT}"), r="dsdt s_in s_out error", t="ts")
def b12_tef_salt(v):
    return budgets(v)["salt"]


@query(of_sections(f"{CONSTITUENT}"), r="dcdt:9 q_in:9 q_r:9 source_sink:9", t="ts")
def b12_tef_constituent(v):
    return budgets(v)["doxg"]


#: Three volumes that overlap, and the sections that bound them.
REACHES = {"west": (0, 6000), "mid": (3000, 9000), "east": (5000, 1_000_000)}
BOUNDS = {"west": {"click": True, "error": True}, "mid": {"error": False, "purchase": True}, "east": {"purchase": False, "signup": False, "view": True}}


def deriv_sql(source: str, value: str, name: str) -> str:
    """CTEs name_n and name: the derivative of a value by run and cv."""
    return f"""{name}_n AS (SELECT run, cv, ts, {value} AS v, row_number() OVER (PARTITION BY run, cv ORDER BY ts) AS i, count(*) OVER (PARTITION BY run, cv) AS n FROM {source}),
{name} AS (SELECT a.run, a.cv, a.ts, sum(w * b.v) / 3600 AS {name} FROM {name}_n a, dw JOIN {name}_n b ON b.run = a.run AND b.cv = a.cv AND b.i = CASE WHEN a.i + k < 1 THEN 1 - (a.i + k) WHEN a.i + k > a.n THEN 2 * a.n + 1 - (a.i + k) ELSE a.i + k END WHERE a.i > 1 GROUP BY a.run, a.cv, a.ts)"""


MEMBERS = " UNION ALL ".join(f"SELECT '{cv}' AS cv, node_id FROM v_mesh_node WHERE x >= {low} AND x < {high}" for cv, (low, high) in REACHES.items())
DIRECTIONS = ", ".join(f"('{cv}', '{section}', {str(into).lower()})" for cv, bounds in BOUNDS.items() for section, into in bounds.items())
FIELDS = f"""{AREA}, {SIGMA}, member AS ({MEMBERS}), dir AS (SELECT * FROM (VALUES {DIRECTIONS}) d(cv, section, toward)),
dw AS (SELECT k - 4 AS k, list_extract([{PHI}], CAST(k + 1 AS BIGINT)) AS w FROM range(0, 9) r(k)),
load AS (SELECT date + CAST((SELECT CAST(min(ts) AS DATE) FROM v_section_flux) - (SELECT min(date) FROM v_loading) AS INTEGER) AS date, node_id, discharge, doxg FROM v_loading), ends AS (SELECT CAST(max(date) AS TIMESTAMP) AS last FROM load),
store AS (SELECT run, cv, ts, sum(area * dz * (h + zeta)) AS volume, sum(area * dz * (h + zeta) * salinity) AS v_salt, sum(area * dz * (h + zeta) * doxg) AS v_doxg, sum(growth * area * dz * (h + zeta) / 86400) AS growth
  FROM v_field_hourly JOIN v_surface_hourly USING (run, ts, node_id) JOIN na USING (node_id) JOIN v_mesh_node USING (node_id) JOIN sigma USING (layer) JOIN member USING (node_id) WHERE ts <= (SELECT last FROM ends) GROUP BY run, cv, ts),
flow AS (SELECT cv, ts, CASE WHEN toward THEN q ELSE -q END AS q, salt * (1 + zeta / h) AS s, (20 + salt / 2) * (1 + zeta / h) AS c FROM v_section_flux JOIN dir USING (section) WHERE ts <= (SELECT last FROM ends)),
ex AS (SELECT cv, ts, sum(CASE WHEN q > 0 THEN q ELSE 0 END) AS q_in, sum(CASE WHEN q < 0 THEN q ELSE 0 END) AS q_out, sum(CASE WHEN q > 0 THEN q * s ELSE 0 END) AS s_in, sum(CASE WHEN q < 0 THEN q * s ELSE 0 END) AS s_out,
  sum(CASE WHEN q > 0 THEN q * c ELSE 0 END) AS c_doxg_in, sum(CASE WHEN q < 0 THEN q * c ELSE 0 END) AS c_doxg_out FROM flow GROUP BY cv, ts),
daily AS (SELECT cv, date, CAST(date AS TIMESTAMP) AS ts, coalesce(sum(discharge) FILTER (m.node_id IS NOT NULL), 0) AS q, coalesce(sum(discharge * doxg) FILTER (m.node_id IS NOT NULL), 0) AS x
  FROM load, (SELECT DISTINCT cv FROM member) v LEFT JOIN (SELECT cv, node_id FROM member WHERE node_id IN (SELECT node_id FROM v_source_node)) m USING (cv) WHERE m.node_id = load.node_id GROUP BY cv, date
  UNION ALL BY NAME SELECT cv, date, CAST(date AS TIMESTAMP) AS ts, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS x FROM (SELECT DISTINCT date FROM load) d, (SELECT DISTINCT cv FROM member) v WHERE NOT EXISTS (FROM load l JOIN member m USING (node_id) WHERE l.date = d.date AND m.cv = v.cv AND l.node_id IN (SELECT node_id FROM v_source_node))),
riv AS (SELECT e.cv, e.ts, CASE WHEN a.ts = e.ts THEN a.q ELSE a.q + (epoch(e.ts) - epoch(a.ts)) / (epoch(b.ts) - epoch(a.ts)) * (b.q - a.q) END AS q_r, CASE WHEN a.ts = e.ts THEN a.x ELSE a.x + (epoch(e.ts) - epoch(a.ts)) / (epoch(b.ts) - epoch(a.ts)) * (b.x - a.x) END AS r_doxg
  FROM ex e ASOF JOIN daily a ON a.cv = e.cv AND a.ts <= e.ts ASOF JOIN daily b ON b.cv = e.cv AND b.ts >= e.ts)"""
FIELD_VOLUME = f"{FIELDS}, {deriv_sql('store', 'volume', 'dvdt')}, base AS (SELECT run, cv, ts, dvdt, q_in, q_out, q_r FROM dvdt JOIN ex USING (cv, ts) LEFT JOIN riv USING (cv, ts)), {godin_sql('base', ['dvdt', 'q_r'], 'g', 'run, cv')}, vb AS (SELECT *, -dvdt + q_in + q_out + q_r AS error FROM g)"


def field_budgets(v):
    """Budgets of all volumes and runs from the hourly fields; the loading's dates are moved so that it begins with the fields."""
    nodes = v("v_mesh_node")
    reach = F.array(*(F.struct(F.lit(cv).alias("cv"), F.lit(low).alias("low"), F.lit(high).alias("high")) for cv, (low, high) in REACHES.items()))
    members = nodes.select("node_id", "x", F.explode(reach).alias("r")).where("x >= r.low AND x < r.high").select("r.cv", "node_id")
    directions = v.spark.createDataFrame([(cv, s, into) for cv, bounds in BOUNDS.items() for s, into in bounds.items()], "cv string, section string, into boolean")
    began = v("v_section_flux").agg(F.min("ts").cast("date").alias("began")).join(v("v_loading").agg(F.min("date").alias("first")), how="cross")
    loading = v("v_loading").join(began, how="cross").withColumn("date", F.date_add("date", F.date_diff("began", "first"))).drop("began", "first")
    flux = v("v_section_flux").withColumn("doxg", 20 + F.col("salt") / 2)
    fixed = {"doxg": {"rates": {"growth": "per_day"}, "river": "doxg"}}
    return B.budgets_of_fields(
        v("v_field_hourly"), v("v_surface_hourly"), nodes, v("v_mesh_element"), sigma(v), members, flux, directions, loading,
        v("v_source_node"), HOUR, fixed, average="notq", skip=5,
    )


@query(f"WITH {FIELD_VOLUME} SELECT * FROM vb", r="dvdt:3 q_in q_out q_r error:3", t="ts")
def b12_field_volumes(v):
    return field_budgets(v)["volume"]


@query(f"WITH {FIELD_VOLUME} SELECT run, cv, avg(error) AS mean_error, 100 * avg(error) / avg(q_r) AS pct_of_rivers, avg(abs(error)) / avg(abs(dvdt)) AS abs_per_storage, sqrt(avg(error * error)) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY run, cv ORDER BY ts) AS i FROM vb WHERE error IS NOT NULL) WHERE i > 5 GROUP BY run, cv", r="mean_error:3 pct_of_rivers:3 abs_per_storage rmse:3")
def b12_field_stats(v):
    return field_budgets(v)["stats"]


@query(f"WITH {FIELDS}, {deriv_sql('store', 'v_salt', 'dsdt')} SELECT run, cv, ts, dsdt, s_in, s_out, -dsdt + s_in + s_out AS error FROM dsdt LEFT JOIN ex USING (cv, ts)", r="dsdt:2 s_in:4 s_out:4 error:2", t="ts")
def b12_field_salt(v):
    return field_budgets(v)["salt"]


@query(f"WITH {FIELDS}, {deriv_sql('store', 'v_doxg', 'dcdt')}, base AS (SELECT run, cv, ts, dcdt, c_doxg_in, c_doxg_out, r_doxg, growth FROM dcdt LEFT JOIN ex USING (cv, ts) LEFT JOIN riv USING (cv, ts) LEFT JOIN store USING (run, cv, ts)), {godin_sql('base', ['dcdt', 'c_doxg_in', 'c_doxg_out', 'r_doxg', 'growth'], 'g', 'run, cv')} SELECT *, dcdt - coalesce(c_doxg_in, 0) - coalesce(c_doxg_out, 0) - coalesce(r_doxg, 0) - coalesce(growth, 0) AS source_sink FROM g WHERE dcdt IS NOT NULL", r="dcdt:2 c_doxg_in:4 c_doxg_out:4 r_doxg:4 growth:2 source_sink:2", t="ts")
def b12_field_constituent(v):
    return field_budgets(v)["doxg"]
