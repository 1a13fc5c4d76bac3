"""Queries of loading operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from estuary.operators import loadings as L
from estuary.plans.base import Book
from estuary.plans.q_extract import CV

BOOK = Book()
query = BOOK.query
QUERIES, ORACLE_SQL = BOOK.queries, BOOK.oracle

VALUES = ["discharge", "temp", "salt", "no32", "nh4", "doxg", "dic", "talk"]
START, DAYS = datetime.date(1996, 1, 1), 400
HYDRO = "hydro AS (SELECT * FROM v_source_node WHERE node_id % 4 <> 0), qual AS (SELECT * REPLACE (upper(region) AS region) FROM v_source_node WHERE node_id % 3 <> 0)"
COEF = {"NO23N": (0.1, 0.2, -0.05, 0.03, 0.02, 0.01, -0.01, 1.05, None), "NH4N": (-1.2, 0.1, None, 0.05, 0.01, None, None, 1.1, 0.9), "DOC": (0.3, 0.15, 0.02, -0.04, 0.03, 0.01, 0.02, None, 9.0), "DTPN": (0.2, 0.1, 0.01, 0.02, 0.02, 0.0, 0.0, 1.0, None), "TPN": (0.4, 0.12, 0.01, 0.02, 0.02, 0.0, 0.0, 1.0, None), "pH": (0.86, 0.004, None, None, None, None, None, None, 8.5)}


def coefficients(v):
    lit = lambda x: F.lit(x).cast("double")
    rows = F.array(*(F.struct(F.lit(k).alias("constituent"), *(lit(x).alias(f"b{i}") for i, x in enumerate(b))) for k, b in COEF.items()))
    return v.spark.range(1).select(F.explode(rows).alias("c")).select("c.*")


def regress_sql(k: str, q: str, yf: str) -> str:
    b = COEF[k]
    c = [repr(x or 0.0) for x in b[:7]]
    power = f"{c[0]} + {c[1]}*log10({q}) + {c[2]}*pow(log10({q}), 2) + {c[3]}*sin(2*pi()*{yf}) + {c[4]}*cos(2*pi()*{yf}) + {c[5]}*sin(4*pi()*{yf}) + {c[6]}*cos(4*pi()*{yf})"
    value = f"pow(CAST(10 AS DOUBLE), {power}) * {1.0 if b[7] is None else b[7]}"
    value = value if b[8] is None else f"least({value}, {b[8]})"
    return f"CASE WHEN {q} = 0 THEN 0 ELSE {value} END"


YF = "dayofyear(date) / (CASE WHEN day(last_day(make_date(year(date), 2, 1))) = 29 THEN 366.0 ELSE 365.0 END)"


def hydro(v):
    return v("v_source_node").where("node_id % 4 <> 0")


def qual(v):
    return v("v_source_node").where("node_id % 3 <> 0").withColumn("region", F.upper("region"))


@query(f"WITH {HYDRO} SELECT coalesce(h.node_id, q.node_id) AS node_id, coalesce(h.name, q.name) AS name, coalesce(h.source_type, q.source_type) AS source_type, coalesce(h.region, q.region) AS region, coalesce(h.country, q.country) AS country, coalesce(h.dist_nodes, q.dist_nodes) AS dist_nodes, q.node_id IS NOT NULL AS icm_source FROM hydro h FULL JOIN qual q ON h.node_id = q.node_id")
def l1_merge_nodes(v):
    return L.merge_nodes(hydro(v), qual(v))


@query("SELECT node_id, l AS layer, 0.1 * l AS fraction FROM v_source_node, (VALUES (1), (2), (3), (4)) x(l)", r="fraction")
def l1_merge_vqdist(v):
    one = v("v_source_node").select("node_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("layer")).withColumn("fraction", F.col("layer") * F.lit(0.1))
    return L.merge_vqdist(one.where("layer < 4"), one.where("layer > 1")).withColumn("layer", F.col("layer").cast("int"))


@query("SELECT date, node_id, discharge, nh4 FROM v_loading WHERE node_id % 2 = 0 UNION ALL SELECT date, node_id, discharge, NULL FROM v_loading WHERE node_id % 2 <> 0", r="discharge nh4")
def l1_merge_data(v):
    rows = v("v_loading")
    return L.merge_data(rows.select("date", "node_id", "discharge"), rows.where("node_id % 2 = 0").select("date", "node_id", "discharge", "nh4")).select("date", "node_id", "discharge", "nh4")


@query("SELECT unnest(['temp', 'nh4']) AS \"column\" FROM (SELECT count(*) AS n FROM v_loading) WHERE n > 0")
def l2_tables_match(v):
    a = v("v_loading").select("date", "node_id", "discharge", "temp", "nh4")
    b = a.withColumn("temp", F.when(F.col("node_id") == 7, -1.0).otherwise(F.col("temp"))).withColumn("nh4", F.when(F.col("node_id") != 9, F.col("nh4")))
    return L.tables_match(a, b, ["date", "node_id"])


COMMENT_SQL = "CASE WHEN node_id % 8 = 0 THEN 'no comment' ELSE 'FVCOM ID/Node: ' || CAST(fvcom_id AS VARCHAR) || ' / ' || CAST(node_id + CASE WHEN node_id % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) || ', nodes/distribution : ' || CAST(dist_nodes AS VARCHAR) || '/1,   ' || 'Creek no' || CAST(node_id AS VARCHAR) || ',   ' || source_type || ', Basin, ' || country END"


@query("""SELECT node_id, CASE WHEN ok THEN CAST(fvcom_id AS INTEGER) END AS fvcom_id, CASE WHEN ok THEN dist_nodes END AS dist_nodes, CASE WHEN ok THEN '1' END AS dist_type, CASE WHEN ok THEN 'Creek no' || CAST(node_id AS VARCHAR) END AS name, CASE WHEN ok THEN source_type END AS source_type, CASE WHEN ok THEN 'Basin' END AS region, CASE WHEN ok THEN country END AS country, CASE WHEN ok THEN node_id % 9 = 0 END AS mismatch
FROM (SELECT *, node_id % 8 <> 0 AS ok FROM v_source_node)""")
def l3_parse_comment(v):
    comments = v.sql(f"SELECT node_id, {COMMENT_SQL.replace('AS VARCHAR', 'AS STRING')} AS comment FROM v_source_node")
    return L.parse_comment(comments).drop("comment")


@query("SELECT l_orderkey, l_linenumber, CAST(DATE '1995-01-01' AS TIMESTAMP) + (l_linenumber * 5) * INTERVAL 1 HOUR AS ts, CAST(l_linenumber * 5 AS DOUBLE) AS hours FROM lineitem", r="hours", t="ts")
def l4_dates_and_hours(v):
    data = v("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 5).alias("hours"))
    start = datetime.datetime(1995, 1, 1)
    return L.date_to_hours(L.hours_to_date(data, start), start)


BROKEN = """n AS (SELECT node_id, icm_source FROM v_source_node UNION ALL SELECT node_id, icm_source FROM v_source_node WHERE node_id = 5),
vq AS (SELECT node_id, l AS layer, CASE WHEN node_id = 6 THEN 0.3 ELSE 0.25 END AS fraction FROM v_source_node, (VALUES (1), (2), (3), (4)) x(l) UNION ALL SELECT 100000, 1, 1.0),
dt AS (SELECT date, node_id, discharge, CASE WHEN node_id = 8 THEN NULL ELSE temp END AS temp, salt, CASE WHEN node_id IN (9, 10) THEN NULL ELSE nh4 END AS nh4 FROM v_loading)"""


@query(f"""WITH {BROKEN} SELECT DISTINCT * FROM (
SELECT 1 AS rule, 'nodes' AS what, 'duplicate key' AS problem, node_id FROM n GROUP BY node_id HAVING count(*) > 1
UNION ALL SELECT 2, 'vqdist', 'duplicate key', node_id FROM vq GROUP BY node_id, layer HAVING count(*) > 1
UNION ALL SELECT 3, 'data', 'duplicate key', node_id FROM dt GROUP BY node_id, date HAVING count(*) > 1
UNION ALL SELECT 4, 'vqdist', 'no such node', node_id FROM vq WHERE node_id NOT IN (SELECT node_id FROM n)
UNION ALL SELECT 5, 'data', 'no such node', node_id FROM dt WHERE node_id NOT IN (SELECT node_id FROM n)
UNION ALL SELECT 6, 'vqdist', 'fractions do not sum to 1', node_id FROM vq GROUP BY node_id HAVING abs(sum(fraction) - 1) > 1e-6
UNION ALL SELECT 7, 'data', 'missing water quality', node_id FROM dt WHERE nh4 IS NULL AND node_id IN (SELECT node_id FROM n WHERE icm_source)
UNION ALL SELECT 8, 'data', 'missing discharge, temp or salt', node_id FROM dt WHERE discharge IS NULL OR temp IS NULL OR salt IS NULL)""")
def l5_check_inputs(v):
    nodes = v("v_source_node").select("node_id", "icm_source")
    nodes = nodes.union(nodes.where("node_id = 5"))
    vq = v("v_source_node").select("node_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("layer")).withColumn("fraction", F.when(F.col("node_id") == 6, 0.3).otherwise(0.25))
    vq = vq.union(vq.sparkSession.range(1).selectExpr("100000", "1", "1.0d"))
    data = v("v_loading").withColumn("temp", F.when(F.col("node_id") != 8, F.col("temp"))).withColumn("nh4", F.when(~F.col("node_id").isin(9, 10), F.col("nh4")))
    return L.check_inputs(nodes, vq, data, ["nh4"])


@query("WITH s AS (SELECT floor((max(t) - min(t)) * (1 + 1.0 / (count(DISTINCT t) - 1))) AS shift FROM v_dense2d) SELECT node_id, CAST(t + k * shift AS BIGINT) AS hours, zeta FROM v_dense2d, s, (VALUES (0), (1), (2)) x(k)", r="zeta")
def l6_repeat_data(v):
    return L.repeat_data(v("v_dense2d").select("node_id", F.col("t").cast("long").alias("hours"), "zeta"), 2)


@query("SELECT date, variable, [max(x) FILTER (node_id = 3), max(x) FILTER (node_id = 1), max(x) FILTER (node_id = 2)] AS \"values\" FROM (SELECT date, node_id, unnest(['temp', 'nh4']) AS variable, unnest([round(temp, 6), round(nh4, 6)]) AS x FROM v_loading WHERE node_id IN (1, 2, 3)) GROUP BY date, variable")
def l7_node_matrix(v):
    rows = v("v_loading").withColumns({c: F.round(c, 6) for c in ("temp", "nh4")})
    return L.node_matrix(rows, [3, 1, 2], ["temp", "nh4"])


@query("SELECT node_id, name FROM v_source_node WHERE icm_source")
def l8_icm_only(v):
    return L.icm_only(v("v_source_node")).select("node_id", "name")


@query(f"""WITH src AS (SELECT fvcom_id, date, avg(discharge) AS discharge, avg(nh4) AS nh4 FROM v_loading GROUP BY ALL),
cal AS (SELECT fvcom_id, CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-01-01' + 399, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT fvcom_id FROM v_loading)),
j AS (SELECT c.fvcom_id, c.date, s.discharge, s.nh4 FROM cal c ASOF LEFT JOIN src s ON c.fvcom_id = s.fvcom_id AND c.date >= s.date)
SELECT date, node_id, discharge / dist_nodes AS discharge, nh4, CAST(0 AS DOUBLE) AS lpon FROM j JOIN v_source_node USING (fvcom_id)""", r="discharge nh4 lpon")
def l9_apply_loadings(v):
    return L.apply_loadings(v("v_source_node"), v("v_loading"), ["discharge", "nh4"], ["discharge", "nh4", "lpon"], START, DAYS)


@query("""WITH r AS (SELECT fvcom_id, min(date) AS first, max(date) AS last FROM v_loading GROUP BY 1), u AS (SELECT first AS f, last AS l FROM (SELECT first, last, count(*) AS n FROM r GROUP BY ALL) ORDER BY n DESC, first DESC, last DESC LIMIT 1)
SELECT fvcom_id, first, last, first > DATE '1996-01-01' OR last < DATE '1996-01-01' + 399 AS short, first <> f OR last <> l AS odd FROM r, u""")
def l10_load_coverage(v):
    return L.load_coverage(v("v_loading"), START, DAYS)


FACTORS = "fac AS (SELECT date, avg(factor) AS factor FROM v_flow_factor GROUP BY date)"


@query(f"WITH {FACTORS} SELECT date, node_id, discharge * f AS discharge, temp, nh4 / f AS nh4 FROM (SELECT l.*, coalesce(factor, 1) AS f FROM v_loading l LEFT JOIN fac USING (date))", r="discharge temp nh4")
def l11_adjust_stream(v):
    factors = v("v_flow_factor").groupBy("date").agg(F.avg("factor").alias("factor"))
    return L.adjust_stream(v("v_loading"), factors, ["temp", "nh4"], "constload").select("date", "node_id", "discharge", "temp", "nh4")


@query("SELECT node_id, name FROM v_source_node WHERE source_type = 'River' AND country = 'United States' AND region IN ('ASIA', 'AMERICA', 'EUROPE')")
def l12_select_sources(v):
    return L.select_sources(v("v_source_node"), "River", "United States", ["ASIA", "AMERICA", "EUROPE"]).select("node_id", "name")


CLIM = """daily AS (SELECT river, CAST((dayofyear(date) - CASE WHEN day(last_day(make_date(year(date), 2, 1))) = 29 AND dayofyear(date) > 59 THEN 1 ELSE 0 END + 91) % 365 + 1 AS INTEGER) AS day, avg(discharge) AS x FROM v_hydrograph WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY 1, 2),
clim AS (SELECT river, day, CASE WHEN count(x) OVER w = 30 THEN avg(x) OVER w END AS discharge FROM daily WINDOW w AS (PARTITION BY river ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def clim(v):
    return L.climatology(v("v_hydrograph"), ["river"])


@query(f"WITH {CLIM} SELECT * FROM clim", r="discharge")
def l13_climatology(v):
    return clim(v)


@query(f"WITH {CLIM} SELECT *, discharge / sum(discharge) OVER (PARTITION BY river) AS share FROM clim", r="discharge share:9")
def l14_normalize(v):
    return L.normalize(clim(v), ["river"])


PEAKS = f"""{CLIM}, norm AS (SELECT river, day, round(discharge / sum(discharge) OVER (PARTITION BY river), 12) AS y, row_number() OVER (PARTITION BY river ORDER BY day) AS i FROM clim WHERE discharge IS NOT NULL),
numbered AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY river ORDER BY i) AS run FROM (SELECT *, y IS DISTINCT FROM lag(y) OVER (PARTITION BY river ORDER BY i) AS new FROM norm)),
flat AS (SELECT river, run AS i, any_value(y) AS y, min(i) AS a, max(i) AS b FROM numbered GROUP BY river, run),
runs AS (SELECT f.river, f.i, f.y, n.day FROM flat f JOIN norm n ON n.river = f.river AND n.i = (f.a + f.b) // 2),
lowest AS (SELECT a.river, a.i, a.day, a.y, (SELECT coalesce(max(b.i), 0) FROM runs b WHERE b.river = a.river AND b.i < a.i AND b.y > a.y) AS lo, (SELECT coalesce(min(b.i), 100000) FROM runs b WHERE b.river = a.river AND b.i > a.i AND b.y > a.y) AS hi FROM runs a),
pk AS (SELECT p.river, p.day, p.y, p.y - greatest(min(n.y) FILTER (n.i < p.i), min(n.y) FILTER (n.i > p.i)) AS prominence FROM lowest p JOIN runs n ON n.river = p.river AND n.i > p.lo AND n.i < p.hi
  JOIN runs l ON l.river = p.river AND l.i = p.i - 1 AND l.y < p.y JOIN runs r ON r.river = p.river AND r.i = p.i + 1 AND r.y < p.y GROUP BY p.river, p.day, p.y)"""


@query(f"WITH {PEAKS} SELECT river, day, y AS share, prominence FROM pk", r="share:8 prominence:8")
def l15_peaks(v):
    return L.peaks(L.normalize(clim(v), ["river"]).withColumn("share", F.round("share", 12)), ["river"])


@query(f"""WITH {PEAKS}, big AS (SELECT *, row_number() OVER (PARTITION BY river ORDER BY y DESC) AS k FROM pk WHERE prominence >= 0.0008),
f AS (SELECT river, CAST(max(day) - 1 AS INTEGER) AS last_peak, count(*) AS n, max(y) FILTER (k = 2) AS second FROM big GROUP BY river)
SELECT river, CASE WHEN last_peak < 200 THEN 'Rain-dominated' WHEN n = 1 OR second < 0.003 THEN 'Snow' WHEN n > 1 THEN 'Rain-snow Mix' END AS class, last_peak FROM (SELECT DISTINCT river FROM clim) LEFT JOIN f USING (river)""")
def l15_classify_stream(v):
    return L.classify_stream(clim(v), ["river"])


SOURCES = PEAKS.replace("v_hydrograph", "(SELECT fvcom_id AS river, date, discharge FROM v_loading)")


@query(f"""WITH {SOURCES}, big AS (SELECT *, row_number() OVER (PARTITION BY river ORDER BY y DESC) AS k FROM pk WHERE prominence >= 0.0008),
f AS (SELECT river, max(day) - 1 AS last_peak, count(*) AS n, max(y) FILTER (k = 2) AS second FROM big GROUP BY river),
c AS (SELECT river AS fvcom_id, CASE WHEN last_peak < 200 THEN 'Rain-dominated' WHEN n = 1 OR second < 0.003 THEN 'Snow' WHEN n > 1 THEN 'Rain-snow Mix' END AS class
  FROM f JOIN v_source_node ON fvcom_id = river WHERE source_type = 'River')
SELECT date, node_id, discharge * coalesce(factor, 1) AS discharge, nh4 / coalesce(factor, 1) AS nh4, doxg FROM v_loading LEFT JOIN c USING (fvcom_id) LEFT JOIN v_flow_factor USING (date, class)""", r="discharge nh4 doxg")
def l16_flow_scenario(v):
    """The rivers by their classes; point sources stay."""
    out = L.flow_scenario(v("v_loading"), v("v_source_node"), v("v_flow_factor"), ["nh4", "doxg"], "constload", source_type="River")
    return out.select("date", "node_id", "discharge", "nh4", "doxg")


SHEET = "sheet AS (SELECT CAST((s_suppkey - m) * 11 + k AS BIGINT) AS row, 'C' || CAST(c AS VARCHAR) AS constituent, s_name AS text, CAST(s_suppkey % 7 + k * c AS DOUBLE) AS value FROM supplier, (SELECT min(s_suppkey) AS m FROM supplier) mm, range(0, 11) kk(k), (VALUES (1), (2)) cc(c))"


def sheet(v):
    first = v("supplier").agg(F.min("s_suppkey").alias("m"))
    rows = v("supplier").join(first, how="cross").select("s_suppkey", "s_name", "m", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("c"))
    return rows.select(((F.col("s_suppkey") - F.col("m")) * 11 + F.col("k")).cast("long").alias("row"), F.concat(F.lit("C"), F.col("c").cast("string")).alias("constituent"), F.col("s_name").alias("text"), (F.col("s_suppkey") % 7 + F.col("k") * F.col("c")).cast("double").alias("value"))


B9 = ", ".join(f"max(value) FILTER (row % 11 = {i + 1}) AS b{i}" for i in range(9))
TABLE = f"{SHEET}, tab AS (SELECT constituent, {B9}, min(text) AS station FROM sheet GROUP BY row // 11, constituent)"


@query(f"WITH {TABLE} SELECT * FROM tab")
def l17_regression_table(v):
    return L.regression_table(sheet(v))


@query(f"""WITH {TABLE}, w AS (SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN (SELECT min(s_name) FROM supplier) ELSE 'nowhere' END AS regname, 'C1' AS constituent, CASE WHEN s_suppkey % 5 = 0 THEN 'Disabled' WHEN s_suppkey % 5 = 1 THEN (SELECT max(s_name) FROM supplier) END AS use FROM supplier)
SELECT name, regname, w.constituent, coalesce(o.station, CASE WHEN use IS NULL THEN coalesce(r.station, n.station) END) AS station, coalesce(o.b0, CASE WHEN use IS NULL THEN coalesce(r.b0, n.b0) END) AS b0
FROM w LEFT JOIN tab o ON o.station = use AND o.constituent = w.constituent LEFT JOIN tab r ON r.station = regname AND r.constituent = w.constituent LEFT JOIN tab n ON n.station = name AND n.constituent = w.constituent""")
def l18_pick_regression(v):
    ends = v("supplier").agg(F.min("s_name").alias("lo"), F.max("s_name").alias("hi"))
    k = v("supplier").join(ends, how="cross")
    wanted = k.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 1, F.col("lo")).when(F.col("s_suppkey") % 3 == 2, F.lit("nowhere")).alias("regname"), F.lit("C1").alias("constituent"))
    overrides = k.where("s_suppkey % 5 < 2").select(F.col("s_name").alias("name"), F.lit("C1").alias("constituent"), F.when(F.col("s_suppkey") % 5 == 0, "Disabled").otherwise(F.col("hi")).alias("use"))
    return L.pick_regression(wanted, L.regression_table(sheet(v)), overrides).select("name", "regname", "constituent", "station", "b0")


@query(f"SELECT date, node_id, {regress_sql('NH4N', '(discharge / 40)', YF)} AS nh4 FROM v_loading", r="nh4")
def l19_do_regression(v):
    b = [F.lit(x).cast("double") for x in COEF["NH4N"]]
    return v("v_loading").select("date", "node_id", L.do_regression(F.col("discharge") / 40, L.year_fraction(F.col("date")), b).alias("nh4"))


RIVER = "riv AS (SELECT node_id, fvcom_id // 3 AS rid, CAST(40 + fvcom_id // 3 AS DOUBLE) AS area FROM v_source_node)"
UPDATED = f"""{RIVER}, fl AS (SELECT rid, date, sum(discharge) / min(area) AS q, arg_min(talk, node_id) AS alk FROM (SELECT l.*, rid, area FROM v_loading l JOIN riv USING (node_id)) GROUP BY rid, date),
p AS (SELECT rid, date, alk, {', '.join(f"{regress_sql(k, 'q', YF)} AS {k}" for k in COEF)} FROM fl),
d AS (SELECT *, CASE WHEN DTPN - NO23N - NH4N < 0 THEN 0.001 ELSE DTPN - NO23N - NH4N END AS don, CASE WHEN TPN - DTPN < 0 THEN 0.001 ELSE TPN - DTPN END AS pon, greatest(pH, 6.5) AS phh FROM p),
e AS (SELECT *, pow(CAST(10 AS DOUBLE), -phh) AS hp, pow(CAST(10 AS DOUBLE), -6.35) AS k1, pow(CAST(10 AS DOUBLE), -10.33) AS k2 FROM d)"""


def rivers(v):
    rid = F.floor(F.col("fvcom_id") / 3)
    return v("v_source_node").select("node_id", rid.alias("fvcom_id"), (rid + 40).cast("double").alias("area_km2"))


@query(f"WITH {UPDATED} SELECT rid AS fvcom_id, date, l.node_id, NO23N AS no32, NH4N AS nh4, 0.9 * DOC AS ldoc, 0.1 * DOC AS rdoc, don AS ldon, 0 * don AS rdon, pon AS lpon, 0 * pon AS rpon, (alk + hp - pow(CAST(10 AS DOUBLE), phh - 14)) / ((k1 * hp + 2 * k1 * k2) / (hp * hp + k1 * hp + k1 * k2)) AS dic FROM (SELECT date, node_id FROM v_loading) l JOIN riv USING (node_id) JOIN e USING (rid, date)", r="no32 nh4 ldoc rdoc ldon rdon lpon rpon dic:8")
def l20_update_by_regression(v):
    return L.update_by_regression(v("v_loading").drop("fvcom_id"), rivers(v), coefficients(v)).withColumn("fvcom_id", F.col("fvcom_id").cast("long"))


@query("SELECT date, node_id, unnest(['nh4', 'doxg']) AS constituent, CASE WHEN discharge > 40 THEN unnest([nh4, doxg]) END AS before, CASE WHEN discharge > 40 THEN unnest([nh4 * 2, doxg * 2]) END AS after FROM v_loading", r="before after")
def l21_change_report(v):
    old = v("v_loading").withColumn("discharge", F.when(F.col("discharge") > 40, F.col("discharge")).otherwise(0.0))
    return L.change_report(old, old.withColumns({c: F.col(c) * 2 for c in ("nh4", "doxg")}), ["nh4", "doxg"])


LOAD = "ml AS (SELECT s.fvcom_id, avg(discharge * (nh4 + no32)) * 86.4 AS load FROM v_loading l JOIN v_source_node s USING (node_id) GROUP BY 1)"


def loads(v):
    return L.mean_loading(v("v_loading"), v("v_source_node"), ["nh4", "no32"])


@query(f"WITH {LOAD} SELECT * FROM ml", r="load")
def l22_mean_loading(v):
    return loads(v)


@query(f"WITH {LOAD}, t AS (SELECT fvcom_id, load, source_type FROM ml JOIN v_source_node USING (fvcom_id)) SELECT * FROM (SELECT source_type, CAST(row_number() OVER (PARTITION BY source_type ORDER BY load DESC, fvcom_id) AS INTEGER) AS place, fvcom_id, load, sum(load) OVER (PARTITION BY source_type) AS total FROM t) WHERE place <= 5", r="load total")
def l23_top_sources(v):
    typed = loads(v).join(v("v_source_node").select("fvcom_id", "source_type"), "fvcom_id")
    return L.top_sources(typed, 5)


@query("SELECT date, sum(discharge * nh4 * 86.4) FILTER (fvcom_id = 1) AS s1, sum(discharge * nh4 * 86.4) FILTER (fvcom_id = 2) AS s2 FROM v_loading WHERE fvcom_id IN (1, 2) GROUP BY date", r="s1 s2")
def l24_loading_series(v):
    return L.loading_series(v("v_loading"), [1, 2], "nh4")


@query(f"""WITH {LOAD}, t AS (SELECT fvcom_id, load, source_type FROM ml JOIN v_source_node USING (fvcom_id)),
top AS (SELECT DISTINCT source_type, fvcom_id FROM (SELECT source_type, fvcom_id, row_number() OVER (PARTITION BY source_type ORDER BY load DESC, fvcom_id) AS place FROM t) WHERE place <= 5)
SELECT date, source_type, fvcom_id, sum(discharge * nh4 * 86.4) AS load FROM v_loading JOIN top USING (fvcom_id) GROUP BY date, source_type, fvcom_id""", r="load")
def l24_top_series(v):
    typed = loads(v).join(v("v_source_node").select("fvcom_id", "source_type"), "fvcom_id")
    return L.top_loading_series(v("v_loading"), L.top_sources(typed, 5), "nh4")


@query("SELECT date, node_id, 'a' AS side FROM v_loading WHERE node_id % 10 = 0 UNION ALL SELECT date, node_id, 'b' FROM v_loading WHERE node_id % 10 = 1")
def l25_roundtrip_diff(v):
    rows = v("v_loading").select("date", "node_id")
    return L.roundtrip_diff(rows.where("node_id % 10 <> 1"), rows.where("node_id % 10 <> 0"))
