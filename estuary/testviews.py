"""Views over the driver's tables that give every operator canonical input: the same SQL for Spark and DuckDB.

The mesh is a lattice of five rows of nodes, so its cells have the rows 0 to 3; r < 4 in v_mesh_element is that, and
cuts nothing off.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Braces stand for the base tables.
VIEWS = {
    "v_dim": """
SELECT count(DISTINCT user_id) AS n_nodes, CAST(count(DISTINCT user_id) / 5 AS INT) AS ncol FROM {events}
""",
    "v_mesh_node": """
SELECT CAST(r * ncol + c + 1 AS INT) AS node_id,
       CAST(c * 1000 + ((c * 37 + r * 17) % 7) * 20 AS DOUBLE) AS x,
       CAST(r * 1000 + ((c * 11 + r * 29) % 5) * 20 AS DOUBLE) AS y,
       CAST(20 + ((c * 13 + r * 7) % 50) AS DOUBLE) AS h
FROM (SELECT CAST(u AS INT) AS u, CAST(floor(u / ncol) AS INT) AS r, CAST(u % ncol AS INT) AS c, ncol
      FROM (SELECT DISTINCT user_id AS u FROM {events}) a CROSS JOIN v_dim) b
""",
    "v_mesh_element": """
SELECT CAST(2 * (r * (ncol - 1) + c) + k AS INT) AS ele_id,
       CAST(CASE WHEN k = 1 THEN r * ncol + c + 1 ELSE r * ncol + c + 2 END AS INT) AS n1,
       CAST(CASE WHEN k = 1 THEN r * ncol + c + 2 ELSE (r + 1) * ncol + c + 2 END AS INT) AS n2,
       CAST((r + 1) * ncol + c + 1 AS INT) AS n3
FROM (SELECT CAST(floor(u / ncol) AS INT) AS r, CAST(u % ncol AS INT) AS c, ncol
      FROM (SELECT DISTINCT user_id AS u FROM {events}) a CROSS JOIN v_dim) b
CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) kk
WHERE r < 4 AND c < ncol - 1
""",
    "v_field2d": """
SELECT CASE WHEN event_type IN ('view', 'click') THEN 'control' ELSE 'scenario' END AS run,
       date_trunc('day', ts) AS ts, CAST(user_id + 1 AS INT) AS node_id,
       avg(value) AS doxg, avg(value) / 100.0 - 0.5 AS zeta
FROM {events} GROUP BY 1, 2, 3
""",
    "v_field3d": """
SELECT CASE WHEN event_type IN ('view', 'click') THEN 'control' ELSE 'scenario' END AS run,
       date_trunc('day', ts) AS ts, CAST(user_id + 1 AS INT) AS node_id,
       CAST(event_id % 10 + 1 AS INT) AS layer,
       avg(value) AS doxg, 5.0 + avg(value) / 50.0 AS temp, 25.0 + avg(value) / 100.0 AS salinity,
       max(value) / (event_id % 10 + 1) AS iavg
FROM {events} GROUP BY 1, 2, 3, 4, event_id % 10
""",
    "v_hourly": """
SELECT date_trunc('hour', ts) AS ts, CAST(sum(value) AS DOUBLE) AS v, count(*) AS n FROM {events} GROUP BY 1
""",
    "v_field_hourly": """
SELECT CASE WHEN event_type IN ('view', 'click') THEN 'control' ELSE 'scenario' END AS run,
       date_trunc('hour', ts) AS ts, CAST(user_id + 1 AS INT) AS node_id, CAST(event_id % 10 + 1 AS INT) AS layer,
       avg(value) AS doxg, 5.0 + avg(value) / 50.0 AS growth, 25.0 + avg(value) / 100.0 AS salinity
FROM {events} GROUP BY 1, 2, 3, 4
""",
    "v_surface_hourly": """
SELECT run, ts, node_id, avg(doxg) / 100.0 - 0.5 AS zeta FROM v_field_hourly GROUP BY run, ts, node_id
""",
    "v_ele3d": """
SELECT CAST(floor(step / 2) AS INT) AS t, CAST(step % 2 + 1 AS INT) AS layer, ele_id,
       value / 100.0 - 0.5 AS u, 0.5 - value / 120.0 AS v
FROM (SELECT CAST(floor(event_id / (8 * (ncol - 1))) AS INT) AS step,
             CAST(event_id % (8 * (ncol - 1)) + 1 AS INT) AS ele_id, value
      FROM {events} CROSS JOIN v_dim) a
""",
    "v_dense3d": """
SELECT CAST(floor(step / 10) AS INT) AS t, CAST(step % 10 + 1 AS INT) AS layer, node_id,
       value AS doxg, 5.0 + value / 50.0 AS temp, 25.0 + value / 100.0 AS salinity,
       value / (step % 10 + 1) AS iavg
FROM (SELECT CAST(floor(event_id / n_nodes) AS INT) AS step,
             CAST(event_id % n_nodes + 1 AS INT) AS node_id, value
      FROM {events} CROSS JOIN v_dim) a
""",
    "v_dense2d": """
SELECT t, node_id, avg(doxg) / 100.0 - 0.5 AS zeta FROM v_dense3d GROUP BY t, node_id
""",
    "v_section_flux": """
SELECT event_type AS section, date_trunc('hour', ts) AS ts, CAST(event_id % 10 + 1 AS INT) AS layer,
       CAST(user_id % 7 AS INT) AS seq, avg(value) - 48.0 AS q, 20.0 + avg(event_id % 15) AS salt,
       avg(value) / 100.0 - 0.5 AS zeta, CAST(20 + user_id % 7 AS DOUBLE) AS h
FROM {events} GROUP BY 1, 2, 3, 4, user_id % 7
""",
    "v_station": """
SELECT s_suppkey AS location_id, s_name AS description,
       CAST((s_suppkey * 397) % 3000 AS DOUBLE) AS x, CAST((s_suppkey * 211) % 4000 AS DOUBLE) AS y
FROM {supplier}
""",
    "v_obs": """
SELECT event_id AS id, ts, CAST(event_id % 60 AS DOUBLE) AS depth, value,
       user_id % 10 AS location_id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id * 100 + extract(day FROM ts) AS BIGINT) END AS cast_id,
       CASE WHEN event_type = 'error' THEN 'o2' WHEN event_type = 'signup' THEN 'no23'
            WHEN event_type = 'click' THEN 'no3' WHEN event_type = 'view' THEN 'no2' ELSE 'nh4' END AS parameter_id
FROM {events}
""",
    "v_loading": """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey + 1 AS INT) AS node_id, l_suppkey AS fvcom_id,
       CAST(sum(l_quantity) AS DOUBLE) AS discharge, 5.0 + avg(l_discount) * 100 AS temp, CAST(0 AS DOUBLE) AS salt,
       avg(l_tax) AS no32, avg(l_discount) AS nh4, 8.0 + avg(l_tax) AS doxg,
       1500.0 + avg(l_quantity) AS dic, 0.0018 + avg(l_tax) / 1000 AS talk
FROM {lineitem} GROUP BY 1, 2, 3
""",
    "v_hydrograph": """
SELECT l_returnflag AS river, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS DOUBLE) AS discharge
FROM {lineitem} GROUP BY 1, 2
""",
    "v_source_node": """
SELECT CAST(s_suppkey + 1 AS INT) AS node_id, s_suppkey AS fvcom_id, s_name AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Point Source' ELSE 'River' END AS source_type,
       r_name AS region, CASE WHEN s_suppkey % 4 = 0 THEN 'Canada' ELSE 'United States' END AS country,
       CAST(1 + s_suppkey % 2 AS INT) AS dist_nodes, (s_suppkey % 5 <> 0) AS icm_source
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
""",
    "v_flow_factor": """
SELECT CAST(o_orderdate AS DATE) AS date,
       CASE WHEN o_orderstatus = 'F' THEN 'Rain-dominated' WHEN o_orderstatus = 'O' THEN 'Snow' ELSE 'Rain-snow Mix' END AS class,
       CAST(0.5 + (count(*) % 10) / 10.0 AS DOUBLE) AS factor
FROM {orders} GROUP BY 1, 2
""",
}


def needed(text: str) -> list[str]:
    """The views that a text names, and those that they name, in order of definition."""
    names = set(re.findall(r"\bv_\w+", text)) & set(VIEWS)
    more = set().union(names, *(needed(VIEWS[n]) for n in names)) if names else set()
    return [n for n in VIEWS if n in more]


def with_views(body: str, table: str = "{name}") -> str:
    """body with the views it names before it; table says how a base table is written."""
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', lambda m: table.format(name=m[1]), VIEWS[n])})" for n in needed(body)]
    rest = re.sub(r"{(\w+)}", lambda m: table.format(name=m[1]), body).strip()
    if not parts:
        return rest
    return "WITH " + ",\n".join(parts) + (",\n" + rest[5:] if rest.upper().startswith("WITH ") else "\n" + rest)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of a data folder."""
    return spark.sql(with_views(f"SELECT * FROM {name}", f"parquet.`{sf_dir}/{{name}}.parquet`"))
