"""Regions, control volumes, paths, filters over gaps, scenarios and stores: results known by hand or by brute force."""

import datetime
import heapq
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from estuary.operators import eof as E
from estuary.operators import loadings as L
from estuary.operators import mesh as M
from estuary.operators import series as S
from estuary.operators.region import points_in_region
from estuary.sources import history, store
from tests.test_meshes import CHANNEL_NV, CHANNEL_XY, mesh, section

RING = "x1 double, y1 double, x2 double, y2 double"


def ring(*corners):
    return [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


def inside(spark, points, edges, tolerance=None):
    spots = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    return {r.i for r in points_in_region(spots, spark.createDataFrame([tuple(map(float, e)) for e in edges], RING), tolerance).collect()}


def test_borders_of_a_square_count_alike(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    middles, corners = [(5, 0), (10, 5), (5, 10), (0, 5)], [(0, 0), (10, 0), (10, 10), (0, 10)]
    spots = [*middles, *corners, (5, 5), (10.5, 5), (-0.4, -0.2), (50, 5)]
    assert inside(spark, spots, square, 0.0) == set(range(9))
    assert inside(spark, spots, square, 0.5) == set(range(11)), "within the tolerance of an edge or of a corner"
    assert inside(spark, spots, square) == {0, 3, 4, 8}
    small = [tuple(c / 1e7 for c in e) for e in square]
    assert inside(spark, [(x / 1e7, y / 1e7) for x, y in spots], small, 0.5e-7) == set(range(11)), "in any unit"


@pytest.mark.parametrize("tolerance", [None, 0.0, 3.0])
def test_regions_equal_brute_force(spark, tolerance):
    """A star with a square hole, over points on a lattice that meets its corners, and far ones."""
    star = [(500 + r * math.cos(a), 300 + r * math.sin(a)) for a, r in ((k * math.pi / 40, 400 if k % 2 else 150) for k in range(80))]
    edges = ring(*star) + ring((450, 250), (550, 250), (550, 350), (450, 350))
    rng = np.random.default_rng(1)
    spots = [(float(x), float(y)) for x in range(50, 960, 50) for y in range(-150, 760, 50)] + [tuple(p) for p in rng.uniform(-200, 1200, (1500, 2))] + star[:10]

    def held(x, y):
        crossed, near = 0, math.inf
        for x1, y1, x2, y2 in edges:
            if min(y1, y2) <= y < max(y1, y2):
                crossed += x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            near = min(near, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        return crossed % 2 == 1 or tolerance is not None and near <= tolerance + 1e-9

    assert inside(spark, spots, edges, tolerance) == {i for i, p in enumerate(spots) if held(*p)}


def test_odd_points_and_empty_regions(spark):
    square = spark.createDataFrame([tuple(map(float, e)) for e in ring((0, 0), (2, 0), (2, 2), (0, 2))], RING)
    spots = spark.createDataFrame([(1.0, 1.0, "a"), (1.0, 1.0, "a"), (None, 1.0, "b")], "x double, y double, i string")
    assert [tuple(r) for r in points_in_region(spots, square).collect()] == [(1.0, 1.0, "a")] * 2
    assert points_in_region(spots, square.limit(0)).columns == spots.columns and points_in_region(spots, square.limit(0)).count() == 0
    assert points_in_region(spots.limit(0), square, 0.1).count() == 0


@pytest.fixture(scope="module")
def channel(spark):
    return mesh(spark, CHANNEL_XY, CHANNEL_NV)


@pytest.fixture(scope="module")
def lattice(spark):
    """Six by six nodes; each square is split from its lower left to its upper right corner."""
    xy = " ".join(f"{x},{y}" for y in range(6) for x in range(6))
    nv = " ".join(f"{a}-{a + 1}-{a + 7} {a}-{a + 7}-{a + 6}" for a in (6 * r + c for r in range(5) for c in range(1, 6)))
    return mesh(spark, xy, nv)


def test_volumes_of_two_and_three_sections(spark, channel):
    nodes, elements = channel
    ids = lambda *lists: {r.node_id for r in M.control_volume(nodes, elements, section(spark, *lists)).collect()}
    assert ids([14, 18], [10, 7]) == {8, 11, 12, 15}
    assert ids([2, 4, 3], [8, 9], [10, 11]) == {4, 5, 6, 7, 8}


def test_loops_are_errors(spark, channel, lattice):
    """A section around which water flows another way, and one that ends inside the mesh."""
    with pytest.raises(ValueError, match="loop detected: both sides of section s1"):
        M.control_volume(*channel, section(spark, [2, 4, 3], [8, 9]))
    nodes, elements = lattice
    column = lambda c, rows: [e for r in range(rows) for e in (10 * r + 2 * c + 1, 10 * r + 2 * c + 2)]
    across, half = column(0, 5), column(3, 3)
    one = {r.node_id for r in M.control_volume(nodes, elements, section(spark, across)).collect()}
    assert one in ({1 + 6 * r for r in range(6)}, {i for i in range(1, 37) if i % 6 != 1})
    with pytest.raises(ValueError, match="loop detected: both sides of section s1"):
        M.control_volume(nodes, elements, section(spark, across, half))


def costs(nodes, elements, start):
    centre = {r.ele_id: (r.x, r.y) for r in M.element_centers(nodes, elements).collect()}
    links = {}
    for r in M.element_neighbors(elements).where("nei_id <> 0").collect():
        links.setdefault(r.ele_id, []).append(r.nei_id)
    best, heap = {}, [(0.0, start)]
    while heap:
        c, e = heapq.heappop(heap)
        if e not in best:
            best[e] = c
            for n in links[e]:
                heapq.heappush(heap, (c + math.dist(centre[e], centre[n]), n))
    return best


@pytest.mark.parametrize(("bucket", "rounds"), [(1, 1), (2, 3), (8, 8)])
def test_least_costs_by_buckets(spark, lattice, monkeypatch, bucket, rounds):
    """All costs below the goal's bucket equal Dijkstra's, and each element is written once."""
    nodes, elements = lattice
    monkeypatch.setattr(M, "BUCKET", bucket)
    want = costs(nodes, elements, 1)
    goal = max(want, key=want.get)
    links = M.element_neighbors(elements).where("nei_id <> 0").select(F.col("ele_id").alias("src"), F.col("nei_id").alias("dst"))
    links = M.distance(links, M.element_centers(nodes, elements).select("ele_id", "x", "y"), "src", "dst", "ele_id")
    legs = spark.createDataFrame([("a", 1, goal), ("b", 1, 2)], "leg string, start int, goal int")
    rows = M.cheapest(legs, links, ["leg"], rounds).collect()
    mine = {r.ele_id: r.cost for r in rows if r.leg == "a"}
    assert mine.keys() == want.keys() and all(math.isclose(mine[e], c) for e, c in want.items())
    assert len(rows) == len({(r.leg, r.ele_id) for r in rows})
    assert sum(r.leg == "b" for r in rows) < len(want) or bucket == 8, "a leg stops when its goal is reached"


def test_filter_leaves_gaps_empty(spark):
    start = datetime.datetime(2024, 1, 1)
    hours = [h for h in range(200) if h != 100]
    rows = spark.createDataFrame([("a", start + datetime.timedelta(hours=h), float(h)) for h in hours], "k string, ts timestamp, v double")
    out = {(r.ts - start).total_seconds() / 3600: r.v for r in S.godin(rows, ["v"], ["k"]).collect()}
    held = {h for h, v in out.items() if v is not None}
    reach = (12 + 11 + 12, 11 + 12 + 12)
    assert held == {h for h in hours if reach[0] <= h <= 199 - reach[1] and not 100 - reach[1] <= h <= 100 + reach[0]}
    assert all(math.isclose(out[h], h) for h in held), "the filter leaves a straight line as it is, whatever gap lies near"


def test_scenario_classes_and_guard(spark):
    days = [datetime.date(2005, 1, 1) + datetime.timedelta(days=i) for i in range(730)]
    winter = lambda d: 10 + 50 * max(0.0, math.cos((d.timetuple().tm_yday - 15) / 365 * 2 * math.pi)) ** 3
    spring = lambda d: 10 + 50 * max(0.0, math.cos((d.timetuple().tm_yday - 170) / 365 * 2 * math.pi)) ** 3
    data = spark.createDataFrame([(d, n, f(d), 5.0, 0.0, 2.0) for d in days for n, f in ((1, winter), (2, spring), (3, spring), (4, winter))], "date date, node_id int, discharge double, temp double, salt double, nh4 double")
    nodes = spark.createDataFrame([(1, 1, "River", True), (2, 2, "River", True), (3, 2, "River", True), (4, 4, "Point Source", False)], "node_id int, fvcom_id int, source_type string, icm_source boolean")
    classes = {r.fvcom_id: r["class"] for r in L.source_classes(data, nodes).collect()}
    assert classes == {1: "Rain-dominated", 2: "Snow", 4: "Rain-dominated"}
    factors = spark.createDataFrame([(days[0], "Rain-dominated", 2.0), (days[0], "Snow", 0.5)], "date date, class string, factor double")
    out = L.flow_scenario(data, nodes, factors, ["nh4"], "constload", source_type="River")
    got = {r.node_id: (r.discharge, r.nh4, r.temp) for r in out.where(F.col("date") == F.lit(days[0])).collect()}
    assert got[1] == (2 * winter(days[0]), 1.0, 5.0) and got[2] == (spring(days[0]) / 2, 4.0, 5.0) == got[3] and got[4] == (winter(days[0]), 2.0, 5.0)
    assert out.count() == data.count() and set(out.columns) == set(data.columns)
    with pytest.raises(Exception, match="data : no such node at node 4"):
        L.flow_scenario(data, nodes.where("node_id < 4"), factors, ["nh4"]).collect()
    shares = spark.createDataFrame([(1, 1, 0.5)], "node_id int, layer int, fraction double")
    with pytest.raises(Exception, match="vqdist : fractions do not sum to 1 at node 1"):
        L.flow_scenario(data, nodes, factors, ["nh4"], vqdist=shares).collect()


def test_comments_follow_their_format(spark):
    good = "FVCOM ID/Node: 12 / 7, nodes/distribution : 2/even split,  Big Creek (north),  River, Basin, United States; more, of it"
    lines = [(7, good), (8, good), (7, good.replace("12", "1 2")), (7, good.replace("FVCOM ID", "ID")), (7, "no comment"), (7, None), (7, good.replace("Basin", "two words")), (7, "FVCOM ID/Node: 12 / 7, nodes/distribution : 2/even"), (7, "")]
    rows = L.parse_comment(spark.createDataFrame(lines, "node_id int, comment string")).collect()
    whole = (12, 2, "even split", "Big Creek (north)", "River", "Basin", "United States")
    assert tuple(rows[0])[2:] == (*whole, False) and tuple(rows[1])[2:] == (*whole, True)
    assert all(set(tuple(r)[2:]) == {None} for r in rows[2:])


def test_modes_of_few_nodes_and_by_subspace(spark):
    """Node by node where nodes are fewer, and by subspace iteration beyond the bound, all equal to the SVD."""
    rng = np.random.default_rng(5)
    for shape in ((40, 9), (9, 40)):
        x = rng.normal(size=shape) @ np.diag(3.0 ** -np.arange(shape[1])) + rng.normal(size=(shape[0], 1))
        w = rng.uniform(1, 2, shape[1])
        delta = spark.createDataFrame([(t, n + 1, float(x[t, n])) for t in range(shape[0]) for n in range(shape[1])], "t int, node_id int, delta double")
        weights = spark.createDataFrame([(n + 1, float(v)) for n, v in enumerate(w)], "node_id int, weight double")
        b = x * (w / w.sum())
        u, s, vt = np.linalg.svd((b - b.mean(1, keepdims=True)) / np.sqrt(shape[1]), full_matrices=False)
        for most in (100, 3):
            rows = E.eof(delta, weights, 2, most).collect()
            for k in range(2):
                mine = [r for r in rows if r["mode"] == k + 1]
                sign = np.sign(u[np.abs(u[:, k]).argmax(), k])
                pc = [r.pc for r in sorted((r for r in mine if r.t is not None), key=lambda r: r.t)]
                maps = [r.eof_value for r in sorted((r for r in mine if r.node_id is not None), key=lambda r: r.node_id)]
                assert np.allclose(pc, sign * u[:, k] * s[k], atol=1e-7 * s[0])
                assert np.allclose(maps, sign * vt[k] * np.sqrt(shape[1]) / (w / w.sum()), atol=1e-4)
                assert mine[0].share is None if most == 3 else math.isclose(mine[0].share, s[k] / s.sum(), rel_tol=1e-6)


def blocks_file(path, days, nodes, variables, version=4):
    head = lambda d: f"{d:>10}{version:>5}{nodes:>5}"
    path.write_text("".join(head(d) + "".join(f"{d * 100 + v * 10 + n:>15.3f}" for v in range(1, variables + 1) for n in range(1, nodes + 1)) for d in days))
    return len(head(0.25))


def test_histories_are_read_in_runs_of_blocks(spark, tmp_path):
    folder = tmp_path / "h"
    folder.mkdir()
    header = blocks_file(folder / "a.out", [1, 2, 3, 4, 5], 3, 4)
    blocks_file(folder / "b.out", [6], 3, 4)
    (folder / "_SUCCESS").write_text("")
    size = header + 15 * 3 * 4
    df = history.scan_history(spark, str(folder), header, 3, 4, split=2 * size)
    assert df.rdd.getNumPartitions() == 4, "runs of two blocks, three of a file of five"
    want = {(float(d), v, n, float(d * 100 + v * 10 + n)) for d in range(1, 7) for v in range(1, 5) for n in range(1, 4)}
    assert {tuple(r) for r in df.collect()} == want and df.count() == len(want)
    some = history.scan_history(spark, str(folder), header, 3, 4, wanted=[2, 4])
    assert {tuple(r) for r in some.collect()} == {r for r in want if r[1] in (2, 4)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = history.scan_history(spark, str(folder), header, 3, 4).where("var = 3 AND day > 2")
        assert {tuple(r) for r in pushed.collect()} == {r for r in want if r[1] == 3 and r[0] > 2}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (folder / "c.out").write_text("short")
    with pytest.raises(Exception, match="whole blocks"):
        history.scan_history(spark, str(folder), header, 3, 4).collect()


def test_pruned_variables_are_not_read(tmp_path):
    """The reader asks its file for the headers and the wanted numbers alone."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    header = blocks_file(tmp_path / "a.out", [1, 2], 3, 4)
    options = {"path": f"file://{tmp_path}/a.out", "header": str(header), "nodes": "3", "variables": "4"}
    reader = history.PruningReader(options)
    left = list(reader.pushFilters([In(("var",), (2, 3, 9)), EqualTo(("var",), 3), GreaterThan(("day",), 1.0)]))
    assert len(left) == 1 and reader.wanted == [3]
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert [b.column("var").to_pylist() for b in batches] == [[3] * 3] * 2 and batches[1].column("value").to_pylist() == [231.0, 232.0, 233.0]


def test_other_versions_are_refused(spark, tmp_path):
    header = blocks_file(tmp_path / "a.out", [1], 2, 1, version=5)
    with pytest.raises(Exception, match="unknown version: 5"):
        history.scan_history(spark, str(tmp_path / "a.out"), header, 2, 1).collect()


def test_a_failing_writer_leaves_the_store_alone(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.append_run(spark.range(3), path, "a/b 1")
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("id")).alias("id"))
    for run, force in (("new", False), ("a/b 1", True)):
        with pytest.raises(Exception, match="no more"):
            store.append_run(bad, path, run, force)
    assert store.stored_runs(spark, path) == {"a/b 1"} and spark.read.parquet(path).count() == 3
    assert store.stored_runs(spark, f"file://{tmp_path}/none") == set()
    assert not list((tmp_path / "s" / "_staged").iterdir()) and not list((tmp_path / "s" / "_locks").iterdir())


def test_one_of_two_writers_is_refused(spark, tmp_path):
    path, told = f"file://{tmp_path}/s", []

    def write(k):
        try:
            store.append_run(spark.range(100 + k), path, "r")
            told.append(k)
        except ValueError as e:
            assert "stored" in str(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(told) == 1 and spark.read.parquet(path).count() == 100 + told[0]


def test_a_lock_that_was_left_is_named(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    (tmp_path / "s" / "_locks").mkdir(parents=True)
    (tmp_path / "s" / "_locks" / "r").write_text("")
    with pytest.raises(ValueError, match="_locks/r was left"):
        store.append_run(spark.range(1), path, "r")
    assert store.stored_runs(spark, path) == set()


def test_files_out_of_range_are_not_opened(spark, tmp_path):
    path, start = f"file://{tmp_path}/t", datetime.datetime(2024, 1, 1)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    days = lambda first, n: spark.range(24 * first, 24 * (first + n)).select("id", at.alias("ts"), F.lit("x y").alias("run"))
    for d in range(6):
        days(d, 1).coalesce(1).write.mode("append").partitionBy("run").parquet(path)
    assert store.index_times(spark, path).count() == 6
    ask = lambda: store.read_range(spark, path, ["id", "run"], start + datetime.timedelta(days=2, hours=5), start + datetime.timedelta(days=3, hours=1))
    assert len(ask().inputFiles()) == 2 and sorted(r.id for r in ask().collect()) == list(range(53, 74))
    assert {r.run for r in ask().collect()} == {"x y"}
    days(2, 1).coalesce(1).write.mode("append").partitionBy("run").parquet(path)
    assert len(ask().inputFiles()) == 3 and ask().count() == 21 + 19, "a file newer than the index is opened"
    before = {r.file for r in store._last_index(spark, store.Folder(spark, path), "ts").collect()}
    assert store.index_times(spark, path).count() == 7 and len(before) == 6 and len(ask().inputFiles()) == 3
    late = store.read_range(spark, path, ["id"], start + datetime.timedelta(days=60))
    assert late.count() == 0 and late.columns == ["id"] and store.read_range(spark, path, ["id"]).count() == 168
