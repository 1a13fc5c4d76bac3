"""Section transport: fluxes through cross-sections and their two-layer sums.

Directions are defined once: "in" is toward the control volume and positive, "out" is negative. A section whose
upstream side lies outside the volume (into = false) has its flux reversed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estuary.operators import mesh


def section_cells(geometry: DataFrame, centres: DataFrame, sigma: DataFrame) -> DataFrame:
    """Geometry for each layer with h, z0 = zz * h, da0 = width * dz * h, the lengths of both legs and their offsets."""
    leg = lambda i: F.hypot(F.col(f"mx{i}") - F.col("x"), F.col(f"my{i}") - F.col("y"))
    legs = geometry.withColumns({"l1": leg(1), "l2": leg(2), "dx1": F.col("mx1") - F.col("x"), "dy1": F.col("my1") - F.col("y"), "dx2": F.col("mx2") - F.col("x"), "dy2": F.col("my2") - F.col("y")})
    wide = legs.join(centres.select("ele_id", "h"), "ele_id").join(sigma.select("layer", "zz", "dz"), how="cross")
    return wide.withColumns({"z0": F.col("zz") * F.col("h"), "da0": (F.col("l1") + F.col("l2")) * F.col("dz") * F.col("h")}).drop("zz", "dz")


def section_flux(flow: DataFrame, cells: DataFrame, keys: list[str], weights: DataFrame | None = None) -> DataFrame:
    """q, the volume flux of each cell of each section: flow (keys, ele_id, layer, u, v, zeta) along both legs' normals.

    With gradient weights the velocity varies linearly inside the element (boundary edges do not count) and is taken
    at the middle of each leg; without, it is uniform.
    """
    if weights is not None:
        slopes = mesh.velocity_slopes(flow.select(*keys, "layer", "ele_id", "u", "v"), weights, [*keys, "layer"], walls=False)
        flow = flow.join(slopes, [*keys, "layer", "ele_id"])

    def along(c: str, leg: int) -> Column:
        if weights is None:
            return F.col(c)
        return F.col(c) + 0.5 * (F.col(f"{c}_x") * F.col(f"dx{leg}") + F.col(f"{c}_y") * F.col(f"dy{leg}"))

    part = lambda leg: F.col(f"l{leg}") * (along("u", leg) * F.col(f"nx{leg}") + along("v", leg) * F.col(f"ny{leg}"))
    speed = (part(1) + part(2)) / (F.col("l1") + F.col("l2"))
    return flow.join(cells, ["ele_id", "layer"]).withColumn("q", speed * F.col("da0") * (1 + F.col("zeta") / F.col("h")))


def section_tracers(field: DataFrame, elements: DataFrame, section: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Tracers at the section's elements: the mean of three nodes. Only the section's elements are expanded."""
    mine = elements.join(section.select("ele_id").distinct(), "ele_id", "left_semi")
    means = mesh.node_to_element(field, mine, values, keys)
    return section.select("section", "seq", "ele_id").join(means, "ele_id").select("section", "seq", "ele_id", *keys, *values)


def hourly_subset(times: DataFrame, per_hour: int, start=None, end=None, time: str = "ts") -> DataFrame:
    """Every per_hour-th step, from the per_hour-th on, between two dates (both included); 60 must divide by per_hour."""
    if per_hour < 1 or 60 % per_hour:
        raise ValueError("the output interval must divide an hour")
    if start is not None:
        times = times.where(F.col(time) >= F.lit(start))
    if end is not None:
        times = times.where(F.col(time) <= F.lit(end))
    placed = times.select(time).distinct().withColumn("i", F.row_number().over(Window.orderBy(time)))
    return placed.where(F.col("i") % per_hour == 0).select(time)


def section_monthly_mean(flux: DataFrame, values: list[str]) -> DataFrame:
    """Mean of each value by calendar month, years pooled, with bounds of two population deviations; the last step of a month is left out."""
    month = F.month("ts")
    last = Window.partitionBy("section", F.year("ts"), month)
    kept = flux.withColumn("last", F.max("ts").over(last)).where("ts < last")
    stats = []
    for c in values:
        mean, spread = F.avg(c), F.stddev_pop(c)
        stats += [mean.alias(f"{c}_mean"), (mean - 2 * spread).alias(f"{c}_low"), (mean + 2 * spread).alias(f"{c}_high")]
    return kept.groupBy("section", "seq", "layer", month.alias("month")).agg(*stats)


def toward(flux: DataFrame, directions: DataFrame, columns: list[str]) -> DataFrame:
    """Fluxes with the sign turned where a section does not point into the volume."""
    sign = F.when(F.col("into"), 1.0).otherwise(-1.0)
    return flux.join(directions.select("section", "into"), "section").withColumns({c: F.col(c) * sign for c in columns}).drop("into")


def _in_out(value: Column, flux: Column, name: str) -> list[Column]:
    return [F.sum(F.when(flux > 0, value).otherwise(0.0)).alias(f"{name}_in"), F.sum(F.when(flux < 0, value).otherwise(0.0)).alias(f"{name}_out")]


def prism_transport(flux: DataFrame, directions: DataFrame) -> DataFrame:
    """(section, ts, q_in, q_out): sums over cells."""
    return toward(flux, directions, ["q"]).groupBy("section", "ts").agg(*_in_out(F.col("q"), F.col("q"), "q"))


def prism_salt(flux: DataFrame, directions: DataFrame) -> DataFrame:
    """(section, ts, salt_in, salt_out): transport weighted by salinity and 1 + zeta / h."""
    amount = F.col("q") * F.col("salt") * (1 + F.col("zeta") / F.col("h"))
    return toward(flux, directions, ["q"]).groupBy("section", "ts").agg(*_in_out(amount, F.col("q"), "salt"))


def salinity_bins(flux: DataFrame, width: float) -> DataFrame:
    """(section, ts, bin, q, s): flux summed in salinity classes, s their middle."""
    low = F.floor(F.col("salt") / width)
    return flux.groupBy("section", "ts", low.cast("int").alias("bin")).agg(F.sum("q").alias("q")).withColumn("s", (F.col("bin") + 0.5) * width)


def bulk_in_out(bulk: DataFrame, directions: DataFrame) -> DataFrame:
    """(section, ts, q_in, q_out, qs_in, qs_out): sums over bins of each direction; null bins are skipped."""
    turned = toward(bulk.where("q is not null"), directions, ["q"])
    return turned.groupBy("section", "ts").agg(*_in_out(F.col("q"), F.col("q"), "q"), *_in_out(F.col("q") * F.col("s"), F.col("q"), "qs"))


def bulk_two_layer(sums: DataFrame) -> DataFrame:
    """(section, ts, q_in, q_out, s_in, s_out, q_net): each direction's mean salinity by transport."""
    mean = lambda d: F.col(f"qs_{d}") / F.nullif(F.col(f"q_{d}"), F.lit(0.0))
    return sums.select("section", "ts", "q_in", "q_out", mean("in").alias("s_in"), mean("out").alias("s_out"), (F.col("q_in") + F.col("q_out")).alias("q_net"))


def bulk_monthly(layers: DataFrame, values: list[str]) -> DataFrame:
    """Monthly means, stamped 15 days before the month's end, with the day of the year."""
    stamp = F.date_sub(F.last_day("ts"), 15)
    return layers.groupBy("section", stamp.alias("stamp")).agg(*(F.avg(c).alias(c) for c in values)).withColumn("day", F.dayofyear("stamp"))
