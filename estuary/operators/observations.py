"""Matching observations to model output in space, time and depth, and scoring the fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estuary.operators.mesh import points_in_region
from estuary.session import written

# Which model variables make up a parameter, and in what ratio.
CATALOG = {"temp": {"temp": 1.0}, "salt": {"salinity": 1.0}, "o2": {"doxg": 1.0}, "chla": {"b1": 1000 / 37, "b2": 1000 / 50, "b3": 1.0}}


def select_obs(obs: DataFrame, station: DataFrame, parameters: list[str], start, end, ring_edges: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Observations of some parameters in a time range (both ends included), at stations inside a region, without excluded ids."""
    rows = obs.where(F.col("parameter_id").isin(parameters) & (F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
    places = station if ring_edges is None else points_in_region(station.select("location_id", "description", "x", "y"), ring_edges)
    rows = rows.join(places.select("location_id", "description"), "location_id")
    return rows if exclude is None else rows.join(exclude.select("id"), "id", "left_anti")


def nearest_node(station: DataFrame, nodes: DataFrame, cell: float = 1000.0, rings: int = 1) -> DataFrame:
    """(location_id, node_id, dist): the nearest node, the smaller id on ties.

    Nodes and stations meet in square cells; a node in the surrounding cells nearer than the ring's reach is sure.
    Stations without one are tried again with cells eight times as wide, until each has its node.
    """
    near = F.sequence(F.lit(-rings), F.lit(rings))
    spots = station.select("location_id", F.col("x").alias("px"), F.col("y").alias("py"))
    dist = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    best = F.min(F.struct(dist.alias("dist"), "node_id")).alias("m")
    found = None
    while True:
        at = lambda c: F.floor(F.col(c) / cell)
        placed = nodes.select("node_id", "x", "y", at("x").alias("cx"), at("y").alias("cy"))
        around = spots.select("*", F.explode(near).alias("i")).select("*", F.explode(near).alias("j")).withColumns({"cx": at("px") + F.col("i"), "cy": at("py") + F.col("j")})
        sure = around.join(placed, ["cx", "cy"]).groupBy("location_id").agg(best).where(F.col("m.dist") <= rings * cell).select("location_id", "m.node_id", "m.dist")
        sure = written(sure, "nearest-node")
        found = sure if found is None else found.unionByName(sure)
        spots = spots.join(sure, "location_id", "left_anti").where("px is not null and py is not null")
        if spots.isEmpty() or nodes.isEmpty():
            return found
        cell *= 8


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def nearest_time(obs: DataFrame, times: DataFrame, time: str = "ts") -> DataFrame:
    """obs with model_ts, the nearest model step: the earlier one half-way, the first or last outside the axis.

    As-of by union: steps and observations are sorted together, and each observation takes the last step before and
    the first after it. Keys would partition the sort; a day does, with the axis's neighbours of each day added.
    """
    day = lambda c: F.floor(_micros(c) / 86_400_000_000)
    axis = times.select(F.col("ts").alias("model_ts")).distinct().select("model_ts", _micros("model_ts").alias("s"), day("model_ts").alias("d"))
    order = Window.orderBy("s")
    axis = axis.withColumns({"low": F.lag("s").over(order), "high": F.lead("s").over(order)})
    low = F.coalesce((F.col("low") + F.col("s")) / 2, F.lit(float("-inf")))
    high = F.coalesce((F.col("high") + F.col("s")) / 2, F.lit(float("inf")))
    spans = axis.select("model_ts", low.alias("lo"), high.alias("hi"), F.col("low").isNull().alias("first"), F.col("high").isNull().alias("last"), "s", "low", "high")
    seen = obs.select(day(time).alias("d")).distinct()
    limits = spans.select("*", F.floor(F.when(F.col("first"), F.col("s")).otherwise(F.col("lo")) / 86_400_000_000).alias("d0"), F.floor(F.when(F.col("last"), F.col("s")).otherwise(F.col("hi")) / 86_400_000_000).alias("d1"))
    ends = seen.agg(F.min("d").alias("dmin"), F.max("d").alias("dmax"))
    days = limits.join(ends, how="cross").select("model_ts", "lo", "hi", F.explode(F.sequence(F.when(F.col("first"), F.least("d0", "dmin")).otherwise(F.col("d0")), F.when(F.col("last"), F.greatest("d1", "dmax")).otherwise(F.col("d1")))).alias("d"))
    placed = obs.withColumns({"d": day(time), "s": _micros(time)})
    return placed.join(days, "d").where((F.col("s") > F.col("lo")) & (F.col("s") <= F.col("hi"))).drop("d", "s", "lo", "hi")


def sigma_of_depth(obs: DataFrame, sigma: DataFrame) -> DataFrame:
    """obs (with h and zeta) with layer: how many upper bounds lie above its depth, from 1 to the number of layers."""
    bounds = sigma.agg(F.sort_array(F.collect_list(F.struct("layer", "z_top"))).alias("levels"))  # one short row
    above = F.size(F.filter("levels", lambda b: -b["z_top"] * (F.col("h") + F.col("zeta")) < F.col("depth")))
    return obs.join(bounds, how="cross").withColumn("layer", F.greatest(F.lit(1), F.least(above, F.size("levels")))).drop("levels")


def match_cast(obs: DataFrame, profile: DataFrame, keep_outside: bool = False) -> DataFrame:
    """(cast_id, layer, depth, observed, modelled): each cast's profile interpolated to the depths of the model's layers.

    obs: cast_id, depth, value; values at one depth are averaged. profile: cast_id, layer, depth, modelled. Depths
    outside the observed ones are dropped, or kept without an observed value. Each observed segment meets only the
    layers of its own cast.
    """
    order = Window.partitionBy("cast_id").orderBy("d0")
    points = obs.where("cast_id is not null and value is not null").groupBy("cast_id", F.col("depth").alias("d0")).agg(F.avg("value").alias("v0"))
    segments = points.withColumns({"d1": F.lead("d0").over(order), "v1": F.lead("v0").over(order)})
    inside = (F.col("depth") >= F.col("d0")) & (F.col("depth") < F.col("d1")) | (F.col("depth") == F.col("d0"))
    value = F.when(F.col("depth") == F.col("d0"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("depth") - F.col("d0")) / (F.col("d1") - F.col("d0")))
    met = profile.join(segments, "cast_id").where(inside).select("cast_id", "layer", "depth", value.alias("observed"), "modelled")
    if not keep_outside:
        return met
    rest = profile.join(points.select("cast_id").distinct(), "cast_id", "left_semi").join(met.select("cast_id", "layer"), ["cast_id", "layer"], "left_anti")
    return met.unionByName(rest.select("cast_id", "layer", "depth", F.lit(None).cast("double").alias("observed"), "modelled"))


def model_value(field: DataFrame, parameter: str, catalog: dict[str, dict[str, float]] = CATALOG) -> DataFrame:
    """field with modelled, the ratio-weighted sum of the parameter's variables; those the field lacks are skipped."""
    parts = [F.coalesce(F.col(c) * ratio, F.lit(0.0)) if len(catalog[parameter]) > 1 else F.col(c) * ratio for c, ratio in catalog[parameter].items() if c in field.columns]
    if not parts:
        raise ValueError(f"the field has no variable of {parameter}")
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return field.withColumn("modelled", total)


def match_points(obs: DataFrame, field: DataFrame, keys: tuple[str, ...] = ("model_ts", "node_id", "layer")) -> DataFrame:
    """Observations with the model's value at their step, node and layer."""
    return obs.join(field.select(F.col("ts").alias("model_ts"), "node_id", "layer", "modelled"), list(keys))


def skill(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, bias, rmse, nse, slope, intercept and r of modelled against observed, for each group."""
    o, m = F.col("observed"), F.col("modelled")
    rows = pairs.where(o.isNotNull() & m.isNotNull())
    square = F.avg((o - m) * (o - m))
    figures = [F.count("*").alias("n"), (F.avg(m) - F.avg(o)).alias("bias"), F.sqrt(square).alias("rmse"), (1 - square / F.nullif(F.var_pop(o), F.lit(0.0))).alias("nse"), F.regr_slope(m, o).alias("slope"), F.regr_intercept(m, o).alias("intercept"), F.abs(F.corr(m, o)).alias("r")]
    return rows.groupBy(*(by or [])).agg(*figures)


def mixed(key: Column, seed: int) -> Column:
    """A fixed order that looks random, in plain arithmetic so that any engine gives the same."""
    return ((key + seed) * 7919 % 104729) * 31 % 65537


def cap_per_station(pairs: DataFrame, n: int = 240, seed: int = 1) -> DataFrame:
    """At most n pairs a station, in a fixed pseudo-random order."""
    order = Window.partitionBy("location_id").orderBy(mixed(F.col("id"), seed), "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def residuals(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("residual", F.col("modelled") - F.col("observed"))


def combine_no23(obs: DataFrame) -> DataFrame:
    """(location_id, ts, depth, value): direct no23, and no3 plus no2 where that is known, in mg/l."""
    keys = ["location_id", "ts", "depth"]
    one = lambda p: obs.where(F.col("parameter_id") == p).select(*keys, "value")
    both = one("no3").join(one("no2").withColumnRenamed("value", "no2"), keys, "left").select(*keys, (F.col("value") + F.coalesce("no2", F.lit(0.0))).alias("value"))
    return one("no23").unionByName(both).withColumn("value", F.col("value") * 14.01 / 1000)


def pick_layers(pairs: DataFrame, layers: int, weight: float = 6.8) -> DataFrame:
    """(location_id, low, high): the first and last layer at which a value that favours extremes and many observations has a strict local maximum."""
    counts = pairs.where("observed is not null").groupBy("location_id", "layer").agg(F.count("*").alias("n"))
    all_of, order = Window.partitionBy("location_id"), Window.partitionBy("location_id").orderBy("layer")
    low, high = F.min("layer").over(all_of), F.max("layer").over(all_of)
    value = F.when(high > low, F.cos(2 * F.pi() / (high - low) * (F.col("layer") - low))).otherwise(1.0) + weight * F.col("n") / F.sum("n").over(all_of)
    valued = counts.withColumn("v", value)
    tops = valued.withColumns({"p": F.coalesce(F.lag("v").over(order), F.lit(-1.0)), "q": F.coalesce(F.lead("v").over(order), F.lit(-1.0))}).where("v > p AND v > q")
    found = tops.groupBy("location_id").agg(F.min("layer").alias("low"), F.max("layer").alias("high"))
    stations = pairs.select("location_id").distinct()
    return stations.join(found, "location_id", "left").select("location_id", F.coalesce("low", F.lit(1)).alias("low"), F.coalesce("high", F.lit(layers)).alias("high"))


def best_obs(obs: DataFrame, at, span_days: float) -> DataFrame:
    """Within so many days of a time: a location's nearest cast (by the cast's mean time), or without casts the nearest observation of each layer. The smaller id on ties."""
    gap = F.abs(_micros("ts") - F.unix_micros(F.lit(at).cast("timestamp")))
    near = obs.withColumn("gap", gap).where(F.col("gap") <= span_days * 86_400_000_000)
    casts = near.where("cast_id is not null").groupBy("location_id", "cast_id").agg(F.abs(F.avg(_micros("ts")) - F.unix_micros(F.lit(at).cast("timestamp"))).alias("off"))
    first = casts.withColumn("i", F.row_number().over(Window.partitionBy("location_id").orderBy("off", "cast_id"))).where("i = 1").select("location_id", "cast_id")
    with_cast = near.join(first, ["location_id", "cast_id"]).select("id", "location_id", "cast_id", "layer")
    loose = near.join(first.select("location_id"), "location_id", "left_anti")
    single = loose.withColumn("i", F.row_number().over(Window.partitionBy("location_id", "layer").orderBy("gap", "id"))).where("i = 1").select("id", "location_id", "cast_id", "layer")
    return with_cast.unionByName(single)


def tide_skill(levels: DataFrame, surface: DataFrame, hours_to_utc: int = 8, skip_days: int = 5) -> DataFrame:
    """(n, slope, r, rmse, bias, pct_of_range) of modelled against observed water levels at equal times, after the first days; r keeps its sign."""
    shifted = levels.select(F.timestamp_micros(_micros("ts") + hours_to_utc * 3_600_000_000).alias("ts"), F.col("level").alias("observed"))
    met = shifted.join(surface.select(F.col("ts").cast("timestamp").alias("ts"), F.col("zeta").alias("modelled")), "ts")
    start = met.agg(F.min("ts").alias("t0"))
    kept = met.join(start, how="cross").where(_micros("ts") >= _micros("t0") + skip_days * 86_400_000_000)
    o, m = F.col("observed"), F.col("modelled")
    rmse = F.sqrt(F.avg((o - m) * (o - m)))
    return kept.agg(F.count("*").alias("n"), F.regr_slope(m, o).alias("slope"), F.corr(m, o).alias("r"), rmse.alias("rmse"), (F.avg(m) - F.avg(o)).alias("bias"), F.round(100 * rmse / (F.max(o) - F.min(o)), 1).alias("pct_of_range"))


def refill_pairs(pairs: DataFrame, field: DataFrame, parameters: list[str]) -> DataFrame:
    """pairs with model_<parameter> read again at their node, step and layer; NULL where the model has none."""
    for p in parameters:
        again = model_value(field, p).select("node_id", F.col("ts").alias("model_ts"), "layer", F.col("modelled").alias(f"model_{p}"))
        pairs = pairs.join(again, ["node_id", "model_ts", "layer"], "left")
    return pairs


def obs_counts(obs: DataFrame, by: list[str]) -> DataFrame:
    return obs.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("cast_id").alias("casts"))


def pick_cast(obs: DataFrame, bands: int = 3, least: int = 2, most: int = 10, seed: int = 1) -> DataFrame:
    """(location_id, band, cast_id): one cast for each station and part of the month, pseudo-random among the first `most` with at least so many observations; NULL if none."""
    band = F.floor((F.day("ts") - 1) / F.lit(31 / bands)).cast("int")
    rows = obs.withColumn("band", band)
    full = rows.where("cast_id is not null").groupBy("location_id", "band", "cast_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = full.withColumn("i", F.row_number().over(Window.partitionBy("location_id", "band").orderBy("cast_id"))).where(F.col("i") <= most)
    one = first.withColumn("j", F.row_number().over(Window.partitionBy("location_id", "band").orderBy(mixed(F.col("cast_id"), seed), "cast_id"))).where("j = 1")
    return rows.select("location_id", "band").distinct().join(one.select("location_id", "band", "cast_id"), ["location_id", "band"], "left")


def profile_pair(obs: DataFrame, profile: DataFrame) -> DataFrame:
    """Observed and modelled profile at all layers of each cast."""
    return match_cast(obs, profile, keep_outside=True)


def station_layer_series(pairs: DataFrame, station: int, layer: int) -> DataFrame:
    """The station's series at a layer with its mean depth, and its skill where there are over two pairs."""
    mine = pairs.where((F.col("location_id") == station) & (F.col("layer") == layer))
    figures = mine.agg(F.avg("depth").alias("mean_depth")).join(skill(mine).where("n > 2"), how="left")
    return mine.select("id", "ts", "observed", "modelled").join(figures, how="cross")
