"""Subsets of model output: domains, times, layers, runs and stations.

Fields are long tables: run, ts (or t), node_id, with layer for 3-D fields and one column for each variable. Layer 1
is the surface. Missing values are NULL.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_field(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Many files as one time axis; only the columns asked for are read."""
    return spark.read.parquet(*paths).select(*columns)


def select_nodes(field: DataFrame, cv: DataFrame) -> DataFrame:
    """Rows of the nodes in a control volume."""
    return field.join(cv.select("node_id"), "node_id", "left_semi")


def mask_nodes(cv: DataFrame, masked: DataFrame) -> DataFrame:
    """A control volume without some nodes."""
    return cv.join(masked.select("node_id"), "node_id", "left_anti")


def union_nodes(cv: DataFrame, more: DataFrame) -> DataFrame:
    """A control volume with further nodes, each once."""
    return cv.select("node_id").union(more.select("node_id")).distinct()


def vertices(elements: DataFrame) -> DataFrame:
    """(ele_id, slot 0..2, node_id) of a mesh."""
    return elements.select("ele_id", F.posexplode(F.array("n1", "n2", "n3")).alias("slot", "node_id"))


def elements_within(elements: DataFrame, cv: DataFrame) -> DataFrame:
    """Elements all of whose vertices lie in the control volume."""
    inside = select_nodes(vertices(elements), cv)
    return inside.groupBy("ele_id").agg(F.count("*").alias("n")).where("n = 3").select("ele_id")


def time_range(field: DataFrame, start=None, end=None, time: str = "ts") -> DataFrame:
    """Rows between two times, both included; either end may be open."""
    if start is not None:
        field = field.where(F.col(time) >= F.lit(start))
    return field if end is None else field.where(F.col(time) <= F.lit(end))


def _axis(times: DataFrame, time: str) -> DataFrame:
    """One row for each time step with its place. A time axis is small against the field it belongs to."""
    return times.select(F.col(time).alias("t")).distinct().withColumn("i", F.row_number().over(Window.orderBy("t")) - 1)


def align_times(axis: DataFrame, existing: DataFrame, time: str = "t", scale: int = 5000) -> DataFrame:
    """(first, last, offset): which part of a time axis (days) matches an existing one, last excluded, and where it goes.

    Times match if they are equal after rounding to 1/scale day. No match, or a gap inside the matching part, is an
    error when the row is read.
    """
    key = F.round(F.col("t") * scale).cast("long").alias("key")
    a = _axis(axis, time).select("i", key)
    b = _axis(existing, time).select(F.col("i").alias("j"), key)
    met = a.join(b, "key").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"), F.min("j").alias("offset"), F.count("*").alias("n"))
    fault = F.when(F.col("n") == 0, F.lit("the time ranges do not overlap")).when(F.col("last") - F.col("first") != F.col("n"), F.lit("the time intervals do not match"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("first")).alias("first")
    return met.select(checked, "last", "offset")


def tweak_times(field: DataFrame, time: str = "seconds", step: int = 40) -> DataFrame:
    """Times rounded to the model's step; the whole axis moves one step up, or else down, if that makes the fourth time a whole minute."""
    whole = F.round(F.col(time) / step) * step
    rounded = field.withColumn(time, whole)
    fourth = _axis(rounded, time).where("i = 3").select(F.col("t").alias("fourth"))
    shift = F.when((F.col("fourth") + step) % 60 == 0, step).when((F.col("fourth") - step) % 60 == 0, -step).otherwise(0)
    return rounded.join(fourth.select(shift.alias("shift")), how="cross").withColumn(time, F.col(time) + F.col("shift")).drop("shift")


def slice_layer(field: DataFrame, which: str, layers: int) -> DataFrame:
    """The bottom, the surface, or all of so many layers."""
    if which == "all":
        return field
    if which not in ("bottom", "surf"):
        raise ValueError(f"no such layer: {which}")
    return field.where(F.col("layer") == (layers if which == "bottom" else 1))


def reduce_layers(field: DataFrame, sigma: DataFrame, value: str, how: str, keys: tuple[str, ...] = ("run", "ts", "node_id")) -> DataFrame:
    """The depth axis collapsed to its min, max, or mean weighted by layer thickness; masked layers do not count."""
    if how in ("min", "max"):
        return field.groupBy(*keys).agg(getattr(F, how)(value).alias(value))
    if how != "mean":
        raise ValueError(f"no such reduction: {how}")
    weight = F.sum(F.when(F.col(value).isNotNull(), F.col("dz")))
    return field.join(sigma.select("layer", "dz"), "layer").groupBy(*keys).agg((F.sum(F.col(value) * F.col("dz")) / weight).alias(value))


def photic_mask(field: DataFrame, value: str, light: str = "iavg", steps: int = 24, keys: tuple[str, ...] = (), time: str = "t") -> DataFrame:
    """value set to NULL where light is short: the trailing mean over so many steps (fewer at the start) is 0 or under 1 % of the surface's."""
    trail = Window.partitionBy(*keys, "node_id", "layer").orderBy(time).rowsBetween(-(steps - 1), 0)
    column = Window.partitionBy(*keys, time, "node_id").orderBy("layer")
    lit = field.withColumn("light_avg", F.avg(light).over(trail))
    lit = lit.withColumn("light_top", F.first("light_avg").over(column))
    dark = (F.col("light_avg") == 0) | (F.col("light_avg") < F.col("light_top") * 0.01)
    return lit.withColumn(value, F.when(~dark, F.col(value))).drop("light_avg", "light_top")


def combine_runs(field: DataFrame, runs: list[str], value: str, keys: tuple[str, ...] = ("ts", "node_id")) -> DataFrame:
    """One column for each run on a common time axis; NULL where a run has no such time."""
    return field.groupBy(*keys).agg(*(F.max(F.when(F.col("run") == r, F.col(value))).alias(f"{r}_{value}") for r in runs))


def zeta_per_run(extract: DataFrame, surface: DataFrame) -> DataFrame:
    """An extract with the surface elevation of its run beside it."""
    return extract.join(surface.select("run", "ts", "node_id", "zeta"), ["run", "ts", "node_id"], "left")


def parse_spec(spec: str) -> tuple[str, list[str]]:
    """VAR:attr,attr as the variable and its attributes; no attribute means a 2-D variable."""
    name, _, attributes = spec.partition(":")
    return name.strip().lower(), [a.strip() for a in attributes.split(",") if a.strip()]


def extract(field3d: DataFrame, sigma: DataFrame, layers: int, specs: tuple[str, ...] = ("DOXG:bottom",), cv: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """One column for each spec, named <var>_<attributes>, over (run, ts, node_id) of a domain and a time range.

    Attributes: bottom, surf, min, max or mean, and photic before one of the last three.
    """
    field = time_range(select_nodes(field3d, cv) if cv is not None else field3d, start, end)
    parts = []
    for spec in specs:
        name, attributes = parse_spec(spec)
        mine = photic_mask(field, name, keys=("run",), time="ts") if "photic" in attributes else field
        column = "_".join([name, *attributes])
        how = next((a for a in attributes if a != "photic"), None)
        if how in ("bottom", "surf"):
            one = slice_layer(mine, how, layers).select("run", "ts", "node_id", F.col(name).alias(column))
        elif how:
            one = reduce_layers(mine, sigma, name, how).withColumnRenamed(name, column)
        else:
            one = mine.select("run", "ts", "node_id", F.col(name).alias(column))
        parts.append(one)
    return functools.reduce(lambda a, b: a.join(b, ["run", "ts", "node_id"], "full"), parts)


def station_matrix(series: DataFrame, value: str, layer: int, nodes: list[int], time: str = "ts") -> DataFrame:
    """Times by nodes for one layer and variable; the nodes are named so that the plan has no extra pass."""
    mine = series.where((F.col("layer") == layer) & F.col("node_id").isin(nodes) & F.col(value).isNotNull())
    return mine.groupBy(time).pivot("node_id", nodes).agg(F.max(value)).withColumnsRenamed({str(n): f"n{n}" for n in nodes})


def station_series(series: DataFrame, value: str, layer: int, time: str = "ts") -> DataFrame:
    """(time, node_id, value) for one layer and variable: all times of all nodes that have values, long."""
    return series.where((F.col("layer") == layer) & F.col(value).isNotNull()).select(time, "node_id", value)


def station_select(series: DataFrame, node: int, columns: list[str]) -> DataFrame:
    """All times and layers of a node."""
    return series.where(F.col("node_id") == node).select("ts", "layer", *columns)


def unpack_ijk(packed: DataFrame, layers: int, values: str = "ijk") -> DataFrame:
    """Flat vectors, one for each step, as (node_id, layer, value): index = node * layers + layer. Hourly steps count as days."""
    flat = packed.select("step", (F.col("step") / 24).alias("day"), F.posexplode(values).alias("at", "value"))
    return flat.select("step", "day", (F.floor(F.col("at") / layers) + 1).cast("int").alias("node_id"), (F.col("at") % layers + 1).cast("int").alias("layer"), "value")


def per_vertex(elements: DataFrame, nodes: DataFrame, columns: list[Column | str]) -> DataFrame:
    """Node columns at each vertex of each element."""
    return vertices(elements).join(nodes.select("node_id", *columns), "node_id")
