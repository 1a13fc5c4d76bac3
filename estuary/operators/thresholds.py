"""Threshold and comparison analytics: how much of an area, a volume or a time lies below a limit, and between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_delta(field: DataFrame, control: str, value: str, keys: tuple[str, ...] = ("ts", "node_id")) -> DataFrame:
    """Each run's value less the control's at the same place and time."""
    base = field.where(F.col("run") == control).select(*keys, F.col(value).alias("base"))
    return field.where(F.col("run") != control).join(base, list(keys)).select("run", *keys, (F.col(value) - F.col("base")).alias("delta"))


def worst_by_node(delta: DataFrame) -> DataFrame:
    """The least value of each node over time."""
    return delta.groupBy("run", "node_id").agg(F.min("delta").alias("worst"))


def argmin_cell(delta: DataFrame) -> DataFrame:
    """Where and when the least value is, the first in time and then in node order."""
    return delta.groupBy("run").agg(F.min(F.struct("delta", "ts", "node_id")).alias("m")).select("run", "m.ts", "m.node_id", "m.delta")


def area_below(field: DataFrame, areas: DataFrame, value: str, limit: float) -> DataFrame:
    """(run, ts, area_km2) below a limit, from node areas in square metres."""
    low = F.sum(F.when(F.col(value) < limit, F.col("area"))) / 1e6
    return field.join(areas, "node_id").groupBy("run", "ts").agg(low.alias("area_km2"))


def time_step(times: DataFrame, time: str = "ts") -> DataFrame:
    """(step): the third time less the second, in seconds; times is small, one row a step."""
    seconds = times.select(F.unix_seconds(F.col(time).cast("timestamp")).alias("s")).distinct()
    ranked = seconds.withColumn("i", F.row_number().over(Window.orderBy("s")))
    return ranked.agg((F.max(F.when(F.col("i") == 3, F.col("s"))) - F.max(F.when(F.col("i") == 2, F.col("s")))).alias("step"))


def duration_below(field: DataFrame, value: str, limit: float, step_hours: float) -> DataFrame:
    """(run, node_id, hours) below a limit."""
    return field.groupBy("run", "node_id").agg((F.count(F.when(F.col(value) < limit, 1)) * step_hours).alias("hours"))


def volume_below(field3d: DataFrame, volumes: DataFrame, value: str, limit: float) -> DataFrame:
    """(run, ts, volume_km3) below a limit, from cell volumes in cubic metres."""
    low = F.sum(F.when(F.col(value) < limit, F.col("volume"))) / 1e9
    return field3d.join(volumes, ["node_id", "layer"]).groupBy("run", "ts").agg(low.alias("volume_km3"))


def duration_diff(durations: DataFrame, control: str, q: float = 0.999) -> DataFrame:
    """(run, most, least, spread): extremes of each run's durations less the control's, and a quantile of their size."""
    base = durations.where(F.col("run") == control).select("node_id", F.col("hours").alias("base"))
    diff = durations.where(F.col("run") != control).join(base, "node_id").select("run", (F.col("hours") - F.col("base")).alias("d"))
    return diff.groupBy("run").agg(F.max("d").alias("most"), F.min("d").alias("least"), F.percentile(F.abs("d"), q).alias("spread"))


def quantile_by_node(field: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """(run, node_id, q<percent>) over time, with linear interpolation."""
    return field.groupBy("run", "node_id").agg(*(F.percentile(value, q).alias(f"q{round(q * 100)}") for q in quantiles))


def weekly_max(series: DataFrame, value: str) -> DataFrame:
    """The largest value of each week from Monday to Sunday."""
    return series.groupBy("run", F.date_trunc("week", "ts").alias("week")).agg(F.max(value).alias(value))


def peak(series: DataFrame, value: str) -> DataFrame:
    """When the largest value is, the first on ties, and what it is."""
    back = F.max(F.struct(F.col(value), (-F.unix_seconds("ts")).alias("back"))).alias("m")
    return series.groupBy("run").agg(back).select("run", F.timestamp_seconds(-F.col("m.back")).alias("ts"), F.col(f"m.{value}").alias(value))


def peak_range(peaks: DataFrame, value: str) -> DataFrame:
    """The largest and smallest peak across runs."""
    return peaks.agg(F.max(value).alias("largest"), F.min(value).alias("smallest"))


def slice_at_peak(delta: DataFrame, peaks: DataFrame) -> DataFrame:
    """Every node's value at the time of its run's peak."""
    return delta.join(peaks.select("run", "ts"), ["run", "ts"]).select("run", "node_id", "delta")


def rolling_mean(series: DataFrame, value: str, days: int = 14) -> DataFrame:
    """The mean over the days up to each time, the far end left out; fewer rows at the start."""
    micros = F.unix_micros("ts")
    window = Window.partitionBy("run").orderBy(micros).rangeBetween(-days * 86_400_000_000 + 1, 0)
    return series.withColumn("rolling", F.avg(value).over(window))


def site_series(field: DataFrame, sites: DataFrame, runs: list[str], value: str) -> DataFrame:
    """(site, ts, one column a run) at chosen nodes; a site without any row is an error when it is read."""
    found = sites.join(field.select("node_id").distinct().withColumn("there", F.lit(True)), "node_id", "left")
    checked = found.select("node_id", F.when(F.col("there"), F.col("site")).otherwise(F.raise_error(F.concat(F.lit("no such site: "), "site"))).alias("site"))
    return field.join(checked, "node_id").groupBy("site", "ts").agg(*(F.max(F.when(F.col("run") == r, F.col(value))).alias(r) for r in runs))


def worst_node_series(field: DataFrame, durations: DataFrame, control: str, value: str) -> DataFrame:
    """(ts, run, value) of all runs at the node where a run other than the control is longest below the limit."""
    worst = durations.where(F.col("run") != control).agg(F.max_by("node_id", F.struct("hours", (-F.col("node_id")).alias("n"))).alias("node_id"))
    return field.join(worst, "node_id", "left_semi").select("run", "ts", "node_id", value)


def pct_of_total(series: DataFrame, total: DataFrame, value: str) -> DataFrame:
    """A series as a share of the domain; total is one row in the same unit."""
    return series.join(total.select("total"), how="cross").withColumn("pct", 100 * F.col(value) / F.col("total")).drop("total")
