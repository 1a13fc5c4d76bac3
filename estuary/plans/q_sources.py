"""Queries of sources and sinks."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from estuary.plans.base import Book
from estuary.session import scratch
from estuary.sources import history, store

BOOK = Book()
query = BOOK.query
QUERIES, ORACLE_SQL = BOOK.queries, BOOK.oracle


@query("""WITH steps AS (SELECT t FROM v_dense3d WHERE layer = 1 GROUP BY t HAVING count(*) = (SELECT max(n_nodes) FROM v_dim))
SELECT t / 24.0 AS day, CAST(1 AS INTEGER) AS var, node_id, doxg AS value FROM v_dense3d WHERE layer = 1 AND t IN (SELECT t FROM steps)
UNION ALL SELECT t / 24.0, 2, node_id, temp FROM v_dense3d WHERE layer = 1 AND t IN (SELECT t FROM steps)""", r="day value")
def s2_scan_history(v):
    # a block is one time of a whole layer, so the mesh bounds it; the line end is the last character of its last number
    nodes, header, path = v("v_dim").first()["n_nodes"], 40, scratch(v.spark, "history")
    number = F.format_string(f"%{history.WIDTH}.6f", F.col("value"))
    surface = v("v_dense3d").where("layer = 1").select("t", "node_id", F.explode(F.array(*(F.struct(F.lit(k).alias("var"), F.col(c).alias("value")) for k, c in ((1, "doxg"), (2, "temp"))))).alias("x")).select("t", "node_id", "x.*")
    blocks = surface.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("var", "node_id", number.alias("text")))).alias("numbers")).where(F.size("numbers") == 2 * nodes)
    head = F.rpad(F.format_string(f"%.8f {history.VERSION} {nodes}", F.col("t") / 24), header, " ")
    last = F.substring(F.element_at("numbers.text", -1), 2, history.WIDTH - 1)
    body = F.array_join(F.slice("numbers.text", 1, 2 * nodes - 1), "")
    blocks.select(F.concat(head, body, last).alias("value")).write.text(path)
    return history.scan_history(v.spark, path, header, nodes, 2)


@query("""WITH hist AS (SELECT layer, t / 24.0 AS day, CAST(2 AS INTEGER) AS var, node_id, doxg AS value FROM v_dense3d UNION ALL SELECT layer, t / 24.0, 3, node_id, temp FROM v_dense3d WHERE layer > 1),
f AS (SELECT *, min(layer) OVER (PARTITION BY var) AS fl, min(day) OVER (PARTITION BY var) AS fd FROM hist)
SELECT CASE WHEN var = 2 THEN 'doxg' ELSE 'temp' END AS name, day * 86400 AS seconds, layer, node_id, value FROM f WHERE (var = 2 OR layer = fl) AND (var = 3 OR day = fd)""", r="seconds value")
def s3_apply_var_catalog(v):
    dense = v("v_dense3d").withColumn("day", F.col("t") / 24)
    rows = dense.select("layer", "day", F.lit(2).alias("var"), "node_id", F.col("doxg").alias("value"))
    rows = rows.union(dense.where("layer > 1").select("layer", "day", F.lit(3).alias("var"), "node_id", F.col("temp").alias("value")))
    catalog = v.spark.sql("SELECT * FROM VALUES (2, 'doxg', true, false), (3, 'temp', false, true) AS c(var, name, per_layer, per_time)")
    return history.apply_var_catalog(rows, catalog)


@query("SELECT run, ts, node_id, doxg FROM v_field2d", r="doxg", t="ts")
def s5_append_run(v):
    path, field = scratch(v.spark, "store"), v("v_field2d").select("run", "ts", "node_id", "doxg")
    for run in ("control", "scenario", "control"):
        store.append_run(field.where(F.col("run") == run).drop("run"), path, run, force=True)
    return v.spark.read.parquet(path).select("run", "ts", "node_id", "doxg")


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-09 18:00:00'", r="value", t="ts")
def s1_time_range(v):
    """All events in a table of files by time, and of these a range, which opens the files that hold it."""
    path = scratch(v.spark, "events")
    v("events").select("event_id", "ts", "value").repartitionByRange(16, "ts").write.parquet(path)
    store.index_times(v.spark, path)
    start, end = datetime.datetime(2024, 1, 5, 6), datetime.datetime(2024, 1, 9, 18)
    return store.read_range(v.spark, path, ["event_id", "ts", "value"], start, end)


@query("SELECT node_id, name, fvcom_id FROM v_source_node")
def s6_write_table(v):
    path = scratch(v.spark, "table")
    store.write_table(v("v_source_node").select("node_id", "name", "fvcom_id"), path)
    return v.spark.read.option("header", True).schema("node_id int, name string, fvcom_id long").csv(path)
