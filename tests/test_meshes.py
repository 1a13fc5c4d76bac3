"""The small meshes and series whose results are known by hand."""

import math

import pytest
from pyspark.sql import functions as F

from estuary.operators import extraction as X
from estuary.operators import loadings as L
from estuary.operators import mesh as M
from estuary.plans import registry
from estuary.sources import history

CHANNEL_XY = "2,0 4,0 3,1 2,2 4,2 1,3 3,3 5,3 0,4 2,4 4,4 6,4 1,5 3,5 5,5 2,6 4,6 3,7 2,8 4,8"
CHANNEL_NV = "1-2-3 1-3-4 2-3-5 3-4-5 4-6-7 4-5-7 5-7-8 6-9-10 6-7-10 7-8-11 8-11-12 9-10-13 10-13-14 11-14-15 11-12-15 13-14-16 14-16-17 14-15-17 16-17-18 16-18-19 17-18-20 18-19-20"


def mesh(spark, xy, nv):
    nodes = [(i, *map(float, p.split(",")), 1.0) for i, p in enumerate(xy.split(), 1)]
    elements = [(i, *map(int, e.split("-"))) for i, e in enumerate(nv.split(), 1)]
    return spark.createDataFrame(nodes, "node_id int, x double, y double, h double"), spark.createDataFrame(elements, "ele_id int, n1 int, n2 int, n3 int")


@pytest.fixture(scope="module")
def channel(spark):
    return mesh(spark, CHANNEL_XY, CHANNEL_NV)


@pytest.fixture(scope="module")
def block(spark):
    xy = " ".join(f"{x},{y}" for y in range(1, 5) for x in range(1, 5))
    # squares split from the lower left to the upper right corner
    nv = " ".join(f"{a}-{a + 1}-{a + 5} {a}-{a + 5}-{a + 4}" for a in (4 * r + c for r in range(3) for c in range(1, 4)))
    return mesh(spark, xy, nv)


def cv(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id int")


def section(spark, *lists):
    return spark.createDataFrame([(f"s{k}", i, e) for k, eles in enumerate(lists) for i, e in enumerate(eles, 1)], "section string, seq int, ele_id int")


def test_area_and_membership(spark, channel):
    nodes, elements = channel
    area = M.node_area(nodes, elements)
    assert math.isclose(X.select_nodes(area, cv(spark, 1, 2, 3)).agg(F.sum("area")).first()[0], 8 / 3)
    assert {r.node_id for r in X.mask_nodes(cv(spark, 1, 2, 3), cv(spark, 2)).collect()} == {1, 3}
    assert {r.ele_id for r in X.elements_within(elements, cv(spark, 6, 9, 10, 13)).collect()} == {8, 12}
    total = M.element_area(nodes, elements).agg(F.sum("area")).first()[0]
    assert math.isclose(area.agg(F.sum("area")).first()[0], total)


def test_control_volumes(spark, channel):
    nodes, elements = channel
    one = M.control_volume(nodes, elements, section(spark, [2, 4, 3]))
    assert {r.node_id for r in one.collect()} == {1, 2, 3}
    two = M.control_volume(nodes, elements, section(spark, [8, 9], [14, 15]))
    assert {r.node_id for r in two.collect()} == {*range(1, 9), 11, 12}
    direction = M.section_direction(M.transect_sides(nodes, elements, section(spark, [2, 4, 3])), one)
    assert [r["into"] for r in direction.collect()] == [True]


def test_neighbours_are_mutual(spark, channel):
    pairs = {(r.ele_id, r.nei_id) for r in M.element_neighbors(channel[1]).collect() if r.nei_id}
    assert pairs == {(b, a) for a, b in pairs}
    assert M.element_neighbors(channel[1]).count() == 66


def test_shortest_path_reaches(spark, channel):
    path = [r.ele_id for r in M.shortest_path(*channel, 1, 22).orderBy("seq").collect()]
    links = {(r.ele_id, r.nei_id) for r in M.element_neighbors(channel[1]).collect()}
    assert path[0] == 1 and path[-1] == 22 and all(p in links for p in zip(path, path[1:], strict=False))
    with pytest.raises(ValueError):
        M.shortest_path(*channel, 1, 99)


def test_vorticity_of_a_vortex_and_of_uniform_flow(spark, block):
    nodes, elements = block
    weights = M.gradient_weights(nodes, elements)
    centre = M.element_centers(nodes, elements)
    still = M.element_neighbors(elements).groupBy("ele_id").agg(F.min("nei_id").alias("edge")).where("edge > 0").select("ele_id")
    turning = centre.select(F.lit(0).alias("t"), "ele_id", (-F.col("y")).alias("u"), F.col("x").alias("v"))
    inner = M.vorticity(turning, weights, ["t"]).join(still, "ele_id").collect()
    assert inner and all(math.isclose(r.vorticity, 2.0) for r in inner)
    uniform = centre.select(F.lit(0).alias("t"), "ele_id", F.lit(1.0).alias("u"), F.lit(2.0).alias("v"))
    assert all(abs(r.vorticity) < 1e-9 for r in M.vorticity(uniform, weights, ["t"]).join(still, "ele_id").collect())


def test_align_times_reports_gaps(spark):
    axis = lambda *t: spark.createDataFrame([(float(x),) for x in t], "t double")
    assert tuple(X.align_times(axis(*range(0, 100, 2)), axis(*range(6, 60, 2))).first()) == (3, 30, 0)
    assert tuple(X.align_times(axis(*range(8, 100, 4)), axis(*range(0, 100, 4))).first()) == (0, 23, 2)
    with pytest.raises(Exception, match="do not match"):
        X.align_times(axis(0, 1, 2, 3, 4), axis(0, 2, 4)).collect()
    with pytest.raises(Exception, match="do not overlap"):
        X.align_times(axis(0, 1), axis(5, 6)).collect()


def test_river_adjustment(spark):
    data = spark.createDataFrame([(1, 5.0, 1.0), (2, 2.0, 3.0), (3, 3.0, 4.0)], "date int, discharge double, other double").withColumns({c: F.lit(1.0) for c in L.HELD})
    factors = spark.createDataFrame([(1, 0.1), (2, 1.0), (3, 0.5)], "date int, factor double")
    rows = L.adjust_stream(data, factors, ["other", *L.HELD], "constload").orderBy("date").collect()
    assert [r.discharge for r in rows] == [0.5, 2.0, 1.5] and [r.other for r in rows] == [10.0, 3.0, 8.0]


def test_climatology_of_two_years(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2005-01-01', DATE '2006-12-31')) AS date").withColumns({"discharge": F.dayofyear("date").cast("double"), "river": F.lit("r")})
    clim = L.climatology(days, ["river"]).orderBy("day").collect()
    assert len(clim) == 365 and clim[28].discharge is None and clim[29].discharge is not None


def test_repeat_data(spark):
    rows = spark.createDataFrame([(h,) for h in range(2, 14, 2)], "hours long")
    out = [r.hours for r in L.repeat_data(rows, 1).orderBy("hours").collect()]
    assert len(out) == 12 and out[6:] == [14, 16, 18, 20, 22, 24]
    assert L.repeat_data(rows, 2).count() == 18


def test_history_blocks(spark, tmp_path):
    header = f"{0.25:>10}{4:>5}{2:>5}"
    block = lambda day, xs: f"{day:>10}{4:>5}{2:>5}" + "".join(f"{x:>15.3f}" for x in xs)
    path = tmp_path / "h.out"
    path.write_text(block(0.25, [1, 2, 3, 4]) + block(0.5, [5, 6, 7, 8]))
    rows = sorted(tuple(r) for r in history.scan_history(spark, str(path), len(header), 2, 2).collect())
    assert rows[0] == (0.25, 1, 1, 1.0) and rows[-1] == (0.5, 2, 2, 8.0) and len(rows) == 8


def test_store_refuses_a_run_twice(spark, tmp_path):
    from estuary.sources import store

    df = spark.range(3)
    store.append_run(df, str(tmp_path / "s"), "a")
    store.append_run(df, str(tmp_path / "s"), "b")
    with pytest.raises(ValueError):
        store.append_run(df, str(tmp_path / "s"), "a")
    store.append_run(spark.range(1), str(tmp_path / "s"), "a", force=True)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("run").count().orderBy("run").collect() == [("a", 1), ("b", 3)]


def test_eof_rebuilds_the_field(spark):
    from estuary.operators.eof import eof

    values = {(t, n): math.sin(t * n) + t for t in range(4) for n in range(1, 6)}
    delta = spark.createDataFrame([(t, n, x) for (t, n), x in values.items()], "t int, node_id int, delta double")
    weights = spark.createDataFrame([(n, float(n)) for n in range(1, 6)], "node_id int, weight double")
    rows = eof(delta, weights, modes=4).collect()
    pc = {(r["mode"], r.t): r.pc for r in rows if r.t is not None}
    maps = {(r["mode"], r.node_id): r.eof_value for r in rows if r.node_id is not None}
    w = {n: n / 15 for n in range(1, 6)}
    for (t, n), x in values.items():
        mean = sum(values[t, m] * w[m] for m in w) / 5
        rebuilt = sum(pc[k, t] * maps[k, n] for k in range(1, 5)) * w[n]
        assert math.isclose(rebuilt, x * w[n] - mean, abs_tol=1e-6)


def test_eof_of_the_given_tables_equals_svd(spark, small):
    """The registered query over whole tables against NumPy, whatever the size of tiles and blocks."""
    import numpy as np

    from estuary.operators import eof as E
    from estuary.plans.base import Inputs

    v = Inputs(spark, small)
    weights = {r.node_id: r.area * r.h for r in M.node_area(v("v_mesh_node"), v("v_mesh_element")).join(v("v_mesh_node").select("node_id", "h"), "node_id").collect()}
    field = {}
    for r in v("v_dense3d").where("layer = 10").collect():
        field.setdefault(r.t, {})[r.node_id] = r.doxg
    nodes = sorted(weights)
    steps = sorted(t for t, x in field.items() if weights.keys() <= x.keys())
    w = np.array([weights[n] for n in nodes]) / sum(weights.values())
    x = np.array([[field[t][n] for n in nodes] for t in steps]) * w
    b = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(len(nodes))
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    rows = registry.queries()["d16_eof"](spark, small).collect()
    for k in range(min(3, len(steps))):
        mine = [r for r in rows if r["mode"] == k + 1]
        pc = np.array([r.pc for r in sorted((r for r in mine if r.t is not None), key=lambda r: r.t)])
        maps = np.array([r.eof_value for r in sorted((r for r in mine if r.node_id is not None), key=lambda r: r.node_id)])
        sign = np.sign(u[np.abs(u[:, k]).argmax(), k])
        assert np.allclose(pc, sign * u[:, k] * s[k], atol=1e-9) and math.isclose(mine[0].share, s[k] / s.sum(), rel_tol=1e-6)
        assert np.allclose(maps, sign * vt[k] * np.sqrt(len(nodes)) / w, rtol=1e-5, atol=1e-6 * np.abs(maps).max())
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(23, 17))
    df = spark.createDataFrame([(t, n, float(dense[t, n])) for t in range(23) for n in range(17)], "t int, node_id int, b double")
    for tile, block in ((5, 4), (23, 17), (100, 3)):
        order, g = E.gram(df, 17, tile, block)
        assert order == list(range(23)) and np.allclose(g, dense @ dense.T / 17)


def test_stations_far_from_all_nodes(spark):
    from estuary.operators.observations import nearest_node

    nodes = spark.createDataFrame([(i, 100.0 * i, 50.0 * (i % 3)) for i in range(1, 40)], "node_id int, x double, y double")
    places = [(1, 10.0, 10.0), (2, 90_000.0, -4e6), (3, 2_000.0, 30_000.0), (4, -1e7, 1e7)]
    spots = spark.createDataFrame([*places, (5, None, 1.0)], "location_id int, x double, y double")
    got = {r.location_id: (r.node_id, r.dist) for r in nearest_node(spots, nodes).collect()}
    want = {k: min((math.hypot(100.0 * i - x, 50.0 * (i % 3) - y), i) for i in range(1, 40)) for k, x, y in places}
    assert set(got) == set(want) and all(got[k][0] == i and math.isclose(got[k][1], d) for k, (d, i) in want.items())
    assert nearest_node(spots, nodes.limit(0)).count() == nearest_node(spots.limit(0), nodes).count() == 0


def test_observations_of_a_database(spark):
    """Partitions by id and pushed filters over an embedded database."""
    from estuary.sources.store import read_obs

    url, driver = "jdbc:derby:memory:obs", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 3 == 0, "no3").otherwise("o2").alias("parameter_id"), (F.col("id") / 4).alias("value"))
    rows.write.format("jdbc").option("url", f"{url};create=true").option("driver", driver).option("dbtable", "observations").option("createTableColumnTypes", "parameter_id VARCHAR(10)").save()
    back = read_obs(spark, url, partitions=3, driver=driver)
    assert back.rdd.getNumPartitions() == 3
    names = [c.lower() for c in back.columns]
    assert back.toDF(*names).exceptAll(rows).count() == rows.exceptAll(back.toDF(*names)).count() == 0
    some = read_obs(spark, url, partitions=3, driver=driver).where("parameter_id = 'no3'")
    assert some.count() == 34 and "PushedFilters: [" in some._jdf.queryExecution().toString() and "EqualTo(" in some._jdf.queryExecution().toString()


def test_budget_parts_and_missing_columns(spark):
    from estuary.operators import budgets as B

    one = spark.range(3).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit(1.0).alias("volume"))
    with pytest.raises(ValueError, match="q_in, q_out, v_no3"):
        B.tef_budget(one, one, one.withColumn("q_r", F.lit(0.0)), 3600.0, {"no3": []})


def test_live_feed(spark, tmp_path):
    """Exact means over steps, also where a step is empty of low values, as windows close."""
    from estuary.streaming.live import area_below_stream

    rows = spark.sql("""SELECT 'a' AS run, ts, id AS node_id, CAST(id AS DOUBLE) + up AS v FROM range(1, 5), VALUES
        (TIMESTAMP '2024-01-01 06:00:00', 0), (TIMESTAMP '2024-01-01 07:00:00', 1), (TIMESTAMP '2024-01-01 08:00:00', 9), (TIMESTAMP '2024-01-09 00:00:00', 0) AS s(ts, up)""")
    rows.write.parquet(str(tmp_path / "feed"))
    areas = spark.range(1, 5).select(F.col("id").alias("node_id"), F.lit(1e6).alias("area"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed"))
    q = area_below_stream(feed, areas, "v", 3.0).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    rows.where("node_id < 2").selectExpr("run", "ts + INTERVAL 9 DAYS AS ts", "node_id", "v").write.mode("append").parquet(str(tmp_path / "feed"))
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT window.start, area_km2 FROM live ORDER BY 1").collect()
    assert str(out[0][0]) == "2024-01-01 00:00:00" and out[0].area_km2 == 1.0
