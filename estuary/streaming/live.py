"""Threshold areas over a live feed of bottom values, with the batch operator's meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def area_below_stream(feed: DataFrame, areas: DataFrame, value: str, limit: float, late: str = "2 days", every: str = "1 day") -> DataFrame:
    """(run, window, area_km2): the area below a limit, averaged over the time steps of each window; rows later than `late` are left out.

    Areas are summed by step, then averaged by window: two aggregations with one watermark, so the state is one sum for
    each open step and one mean for each open window. Output mode is append: a window comes out when it is complete. The
    node areas are a static side. Steps are told apart by the second.
    """
    low = F.sum(F.when(F.col(value) < limit, F.col("area")).otherwise(0.0)) / 1e6
    steps = feed.join(areas, "node_id").withWatermark("ts", late).groupBy("run", F.window("ts", "1 second").alias("step")).agg(low.alias("area"))
    timed = steps.select("run", F.window_time("step").alias("ts"), "area")
    return timed.groupBy("run", F.window("ts", every)).agg(F.avg("area").alias("area_km2"))
