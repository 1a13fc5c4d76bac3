"""Series filters: derivatives, interpolation, tidal averages and calendars.

A series has one row a step; key columns (run, section, variable) go into the window's partitions. A series is already
aggregated over space, so a partition is as long as the time axis, whatever the size of the field behind it.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gaussian_weights(sigma: float = 1.0, reach: int = 4) -> list[float]:
    """First-order Gaussian derivative filter, taps -reach..reach."""
    smooth = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(smooth)
    return [k / sigma**2 * s / total for k, s in zip(range(-reach, reach + 1), smooth, strict=True)]


def time_derivative(series: DataFrame, value: str, step: float, keys: list[str], time: str = "ts") -> DataFrame:
    """series with derivative: the filter over steps, ends mirrored, the first row dropped, divided by the step."""
    order = Window.partitionBy(*keys).orderBy(time)
    whole = Window.partitionBy(*keys)
    placed = series.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(whole)})
    weights = gaussian_weights()
    reach = len(weights) // 2
    ahead = {k: (F.lead(value, k) if k >= 0 else F.lag(value, -k)).over(order) for k in range(-reach, reach + 1)}
    edge = placed.withColumns({f"a{k + reach}": c for k, c in ahead.items()})
    first = [F.nth_value(value, j + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for j in range(reach)]
    last = [F.nth_value(value, j + 1).over(Window.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for j in range(reach)]
    edge = edge.withColumns({f"f{j}": c for j, c in enumerate(first)} | {f"l{j}": c for j, c in enumerate(last)})

    def tap(k: int):
        at, n, c = F.col("i") + k, F.col("n"), F.col(f"a{k + reach}")
        for j in range(reach):
            c = F.when(at == -j, F.col(f"f{j}")).when(at == n + 1 + j, F.col(f"l{j}")).otherwise(c)
        return c

    total = functools.reduce(operator.add, (F.lit(w) * tap(k) for k, w in zip(range(-reach, reach + 1), weights, strict=True) if k))
    return edge.withColumn("derivative", total / step).where("i > 1").select(*series.columns, "derivative")


def interpolate_to(series: DataFrame, times: DataFrame, value: str, keys: list[str], time: str = "ts") -> DataFrame:
    """(keys, time, value): linear interpolation at other times, by one union and two fills; a time outside the series is an error when read."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    known = series.select(*keys, F.col(time), F.col(value).alias("x"), seconds.alias("s"), F.lit(0).alias("asked"))
    asked = times.select(*keys, F.col(time), F.lit(None).cast("double").alias("x"), seconds.alias("s"), F.lit(1).alias("asked"))
    order = Window.partitionBy(*keys).orderBy("s", "asked")
    back, front = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("x").isNotNull(), F.struct("s", "x"))
    both = known.unionByName(asked).withColumns({"p": F.last(point, True).over(back), "q": F.first(point, True).over(front)})
    s0, x0, s1, x1 = F.col("p.s"), F.col("p.x"), F.col("q.s"), F.col("q.x")
    exact = F.col("s") == s0
    out = F.when(exact, x0).when(s0.isNull() | s1.isNull(), F.raise_error(F.lit("a time lies outside the series")).cast("double")).otherwise(x0 + (x1 - x0) * (F.col("s") - s0) / (s1 - s0))
    return both.where("asked = 1").select(*keys, time, out.alias(value))


def truncate_to(series: DataFrame, limits: DataFrame, time: str = "ts") -> DataFrame:
    """Rows not after the last time of another series."""
    last = limits.agg(F.max(time).alias("last"))
    return series.join(last, how="cross").where(F.col(time) <= F.col("last")).drop("last")


def godin(series: DataFrame, values: list[str], keys: list[str], time: str = "ts", step: float = 3600.0) -> DataFrame:
    """Values of every step passed through running means of 24, 24 and 25 of them (Godin 1972).

    The frames are spans of time, not of rows: a mean is NULL where one of its steps lacks a row or a value, so a gap
    shifts nothing and leaves NULL around it, as do the two ends. A series has a row a step at most.
    """
    order = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(time).cast("timestamp")))
    micros = round(step * 1e6)
    for low, high in ((-12, 11), (-11, 12), (-12, 12)):
        frame = order.rangeBetween(low * micros, high * micros)
        series = series.withColumns({c: F.when(F.count(c).over(frame) == high - low + 1, F.avg(c).over(frame)) for c in values})
    return series


def fill_calendar(series: DataFrame, keys: list[str], values: list[str], start, days: int, date: str = "date") -> DataFrame:
    """Every day from start on for each key, values carried forward from the last known day, also from before start."""
    calendar = series.select(*keys).distinct().withColumn(date, F.explode(F.sequence(F.lit(start), F.date_add(F.lit(start), days - 1))))
    order = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    both = series.select(*keys, date, *values, F.lit(True).alias("real")).join(calendar.withColumn("day", F.lit(True)), [*keys, date], "full")
    filled = both.withColumns({c: F.last(c, True).over(order) for c in values})
    return filled.where("day").select(*keys, date, *values)
