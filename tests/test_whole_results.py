"""Results that hold all rows their operators are for."""

import heapq
import math

import pytest

from estuary.operators import mesh as M
from estuary.plans import registry
from tests.oracle import duck_rows, spark_rows
from tests.test_meshes import CHANNEL_NV, CHANNEL_XY, mesh


@pytest.mark.parametrize("name", ["x14_station_series", "l24_top_series"])
def test_whole_series_equal_sql(spark, small, name):
    assert spark_rows(registry.queries()[name](spark, small)) == duck_rows(registry.oracle_sql()[name], small)


def test_series_of_all_nodes_and_top_sources(spark, small):
    run = lambda name: registry.queries()[name](spark, small)
    assert run("x14_station_series").select("node_id").distinct().count() > 3
    assert {(r.source_type, r.fvcom_id) for r in run("l24_top_series").collect()} == {(r.source_type, r.fvcom_id) for r in run("l23_top_sources").collect()}


def test_section_paths_pass_their_waypoints(spark):
    nodes, elements = mesh(spark, CHANNEL_XY, CHANNEL_NV)
    centre = {r.ele_id: (r.x, r.y) for r in M.element_centers(nodes, elements).collect()}
    links = {}
    for r in M.element_neighbors(elements).where("nei_id <> 0").collect():
        links.setdefault(r.ele_id, []).append(r.nei_id)

    def cost(start, goal):
        done, heap = set(), [(0.0, start)]
        while heap:
            c, e = heapq.heappop(heap)
            if e == goal:
                return c
            if e not in done:
                done.add(e)
                for n in links[e]:
                    heapq.heappush(heap, (c + math.dist(centre[e], centre[n]), n))

    sections = {"a": [1, 22, 8], "b": [13, 2], "c": [4, 4, 20, 5]}
    stops = spark.createDataFrame([(k, i, e) for k, v in sections.items() for i, e in enumerate(v)], "section string, seq int, ele_id int")
    out = {}
    for r in M.section_paths(nodes, elements, stops).orderBy("section", "seq").collect():
        out.setdefault(r.section, []).append(r.ele_id)
    assert set(out) == set(sections)
    for k, v in sections.items():
        path, left = out[k], iter(out[k])
        assert path[0] == v[0] and path[-1] == v[-1] and all(b in links[a] for a, b in zip(path, path[1:], strict=False))
        assert all(e in left for i, e in enumerate(v) if not i or e != v[i - 1])
        assert math.isclose(sum(math.dist(centre[a], centre[b]) for a, b in zip(path, path[1:], strict=False)), sum(cost(a, b) for a, b in zip(v, v[1:], strict=False)))
    turned = [r.ele_id for r in M.section_paths(nodes, elements, stops.where("section = 'a'"), reverse=True).orderBy("seq").collect()]
    assert turned == out["a"][::-1]
    with pytest.raises(ValueError):
        M.section_paths(nodes, elements, stops.where("seq = 0"))


def test_intermediate_tables_can_be_deleted(tmp_path):
    """In a process of its own, as other tests of this session still read theirs."""
    import pathlib
    import subprocess
    import sys

    code = f"""
from estuary.session import clear_scratch, local_session, run_dir, written
import os
spark = local_session("1", **{{"spark.checkpoint.dir": "file://{tmp_path}"}})
assert written(spark.range(3), "three").count() == 3 and written(spark.range(2), "two", compression="gzip").count() == 2
folder = run_dir(spark).removeprefix("file://")
assert len(os.listdir(folder)) == 2
clear_scratch(spark)
assert not os.path.exists(folder)
print("cleared")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert "cleared" in out.stdout, out.stderr[-2000:]
