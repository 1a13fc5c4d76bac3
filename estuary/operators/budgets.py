"""Volume, salt and constituent budgets of a control volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estuary.operators import mesh
from estuary.operators import series as S
from estuary.session import written


def cv_integrals(field: DataFrame, volumes: DataFrame, cv: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """(keys, volume, and for each value the sum of volume times value) over the nodes and layers of a control volume.

    volumes: keys, node_id, layer, volume. Cells are joined by node_id.
    """
    inside = field.join(cv.select("node_id"), "node_id", "left_semi").join(volumes, [*keys, "node_id", "layer"])
    return inside.groupBy(*keys).agg(F.sum("volume").alias("volume"), *(F.sum(F.col("volume") * F.col(c)).alias(f"v_{c}") for c in values))


#: How a rate is summed: over volumes or areas, and what its unit is divided by.
RATES = (("per_day", "volume", 86_400.0), ("milli", "volume", 86_400.0 * 1000), ("flux", "area", 86_400.0 * 1000), ("demand", "area", -86_400.0))


def cv_rates(field: DataFrame, volumes: DataFrame, areas: DataFrame, cv: DataFrame, rates: dict[str, str], keys: list[str], bottom: int) -> DataFrame:
    """(keys, rate, total) per second: 3-D rates times cell volumes; 2-D rates (kinds flux and demand) times node areas, read at the bottom layer.

    rates maps a column to its kind: per_day; milli, in thousandths; flux, in thousandths per area; demand, per area and counted as a loss.
    """
    kinds = {k: (over, unit) for k, over, unit in RATES}
    cells = field.join(cv.select("node_id"), "node_id", "left_semi").join(volumes, [*keys, "node_id", "layer"]).join(areas, "node_id")

    def amount(column: str, kind: str) -> Column:
        over, unit = kinds[kind]
        value = F.col(column) * F.col(over) / unit
        return value if over == "volume" else F.when(F.col("layer") == bottom, value)

    parts = F.array(*(F.struct(F.lit(c).alias("rate"), amount(c, kind).alias("x")) for c, kind in rates.items()))
    rows = cells.select(*keys, F.explode(parts).alias("p"))
    return rows.groupBy(*keys, F.col("p.rate").alias("rate")).agg(F.sum("p.x").alias("total"))


def river_inflow(loading: DataFrame, sources: DataFrame, cv: DataFrame, concentrations: list[str]) -> DataFrame:
    """(date, discharge, and discharge times each concentration) of the sources in a control volume; zero on dates without any."""
    inside = sources.join(cv.select("node_id"), "node_id", "left_semi").select("node_id")
    dates = loading.select("date").distinct()
    sums = [F.sum("discharge").alias("discharge"), *(F.sum(F.col("discharge") * F.col(c)).alias(f"load_{c}") for c in concentrations)]
    found = loading.join(inside, "node_id", "left_semi").groupBy("date").agg(*sums)
    names = ["discharge", *(f"load_{c}" for c in concentrations)]
    return dates.join(found, "date", "left").select("date", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def _met(storage: DataFrame, others: list[DataFrame], time: str, keys: Sequence[str]) -> DataFrame:
    for other in others:
        storage = storage.join(other, [*(k for k in keys if k in other.columns), time], "left")
    return storage


def volume_budget(storage: DataFrame, exchange: DataFrame, rivers: DataFrame, average: str = "all", time: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, time, dvdt, q_in, q_out, q_r, error): error = -dvdt + q_in + q_out + q_r, NULL where q_r is; rows that lack a term of exchange go.

    keys tell series apart, such as runs and volumes; exchange and rivers join by those that they have.
    average: "all" or "notq" (storage and rivers only) passes terms through the tidal filter; "none" leaves them.
    """
    rows = _met(storage, [exchange, rivers], time, keys).dropna(subset=["dvdt", "q_in", "q_out"])
    filtered = {"all": ["dvdt", "q_in", "q_out", "q_r"], "notq": ["dvdt", "q_r"], "none": []}[average]
    rows = S.godin(rows, filtered, [*keys], time) if filtered else rows
    return rows.withColumn("error", -F.col("dvdt") + F.col("q_in") + F.col("q_out") + F.col("q_r"))


def salt_budget(storage: DataFrame, exchange: DataFrame, time: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, time, dsdt, s_in, s_out, error): error = -dsdt + s_in + s_out; a missing term makes it NULL."""
    return _met(storage, [exchange], time, keys).withColumn("error", -F.col("dsdt") + F.col("s_in") + F.col("s_out"))


def constituent_budget(storage: DataFrame, terms: DataFrame, names: list[str], time: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, time, dcdt, names, source_sink): tidal means of all; source_sink = dcdt less the terms, missing ones skipped; rows without dcdt go."""
    rows = S.godin(_met(storage, [terms], time, keys), ["dcdt", *names], [*keys], time)
    rest = F.col("dcdt")
    for c in names:
        rest = rest - F.coalesce(c, F.lit(0.0))
    return rows.withColumn("source_sink", rest).dropna(subset=["dcdt"])


def error_stats(budget: DataFrame, skip: int, time: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean_error, pct_of_rivers, abs_per_storage, rmse) after the first rows of each series."""
    rows = budget.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(time))).where(F.col("i") > skip)
    return rows.groupBy(*keys).agg(
        F.avg("error").alias("mean_error"),
        (100 * F.avg("error") / F.avg("q_r")).alias("pct_of_rivers"),
        (F.avg(F.abs("error")) / F.avg(F.abs("dvdt"))).alias("abs_per_storage"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
    )


def tef_budget(
    storage: DataFrame, exchange: DataFrame, rivers: DataFrame, step: float, constituents: dict[str, list[str]] | None = None,
    average: str = "all", skip: int = 0, time: str = "ts", keys: Sequence[str] = (), rates: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All budgets of one or many control volumes and runs: "volume", "stats" (its error figures), "salt" where there is salt, and one for each constituent.

    storage: keys, time, volume, and v_salt and v_<constituent> where budgets of these are wanted, as cv_integrals gives
    them. exchange: time, q_in, q_out, and s_in, s_out for salt. rivers: time, q_r. constituents maps a name to the
    columns of its terms (exchange, rates, river loads), which exchange, rivers or rates hold. Columns that lack are an error.
    """
    constituents = constituents or {}
    salty = "v_salt" in storage.columns
    frames = [exchange, rivers, *([rates] if rates is not None else [])]
    terms = {c for names in constituents.values() for c in names}
    lacking = {time, *keys, "volume", *(f"v_{c}" for c in constituents)} - set(storage.columns)
    lacking |= {time, "q_in", "q_out", *(("s_in", "s_out") if salty else ())} - set(exchange.columns)
    lacking |= {time, "q_r"} - set(rivers.columns)
    lacking |= terms.difference(*(f.columns for f in frames))
    if lacking:
        raise ValueError(f"missing: {', '.join(sorted(lacking))}")

    def change(value: str, name: str) -> DataFrame:
        series = storage.select(*keys, time, value).withColumn("all", F.lit(1))
        return S.time_derivative(series, value, step, [*keys, "all"], time).select(*keys, time, F.col("derivative").alias(name))

    def of(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
        return frame.select(*(k for k in keys if k in frame.columns), time, *columns)

    volume = volume_budget(change("volume", "dvdt"), of(exchange, ["q_in", "q_out"]), of(rivers, ["q_r"]), average, time, keys)
    out = {"volume": volume, "stats": error_stats(volume.dropna(subset=["error"]), skip, time, keys)}
    if salty:
        out["salt"] = salt_budget(change("v_salt", "dsdt"), of(exchange, ["s_in", "s_out"]), time, keys)
    for name, columns in constituents.items():
        parts, left = [], list(columns)
        for frame in frames:
            if mine := [c for c in left if c in frame.columns]:
                parts.append(of(frame, mine))
                left = [c for c in left if c not in mine]
        dcdt = _met(change(f"v_{name}", "dcdt"), parts[:-1], time, keys)
        out[name] = constituent_budget(dcdt, parts[-1] if parts else of(rivers, []), columns, time, keys)
    return out


def volume_sums(
    field: DataFrame, surface: DataFrame, nodes: DataFrame, elements: DataFrame, sigma: DataFrame, members: DataFrame,
    values: Sequence[str], rates: dict[str, str], keys: Sequence[str],
) -> DataFrame:
    """(keys, cv, volume, v_<value>, <rate>): the integrals and rates of many control volumes in one pass over the field.

    members: cv, node_id, where a node may belong to many volumes. Cells are summed by step and node first, in the
    partitions of the join with the surface, and only these sums are repeated for the volumes of their node. rates maps a
    column to its kind, as in cv_rates; those by area are read at the lowest layer.
    """
    kinds = {k: (over, unit) for k, over, unit in RATES}
    own = members.select("cv", "node_id").distinct()
    bottom = sigma.agg(F.max("layer").alias("bottom"))
    still = mesh.node_area(nodes, elements).join(nodes.select("node_id", "h"), "node_id").join(own.select("node_id"), "node_id", "left_semi")
    cells = still.join(sigma.select("layer", "dz"), how="cross").join(bottom, how="cross")
    placed = field.join(cells, ["node_id", "layer"]).join(surface.select(*keys, "node_id", "zeta"), [*keys, "node_id"])
    placed = placed.withColumn("cell", F.col("area") * F.col("dz") * (F.col("h") + F.col("zeta")))

    def rate(column: str, kind: str) -> Column:
        over, unit = kinds[kind]
        whole = F.col(column) * F.col("cell") / unit
        return whole if over == "volume" else F.when(F.col("layer") == F.col("bottom"), F.col(column) * F.col("area") / unit)

    sums = {"volume": F.col("cell")} | {f"v_{c}": F.col("cell") * F.col(c) for c in values} | {c: rate(c, kind) for c, kind in rates.items()}
    by_node = placed.groupBy(*keys, "node_id").agg(*(F.sum(x).alias(c) for c, x in sums.items()))
    return by_node.join(own, "node_id").groupBy(*keys, "cv").agg(*(F.sum(c).alias(c) for c in sums))


def volume_exchange(flux: DataFrame, directions: DataFrame, tracers: dict[str, str], keys: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """(keys, cv, time, q_in, q_out, and <name>_in and <name>_out for each tracer) over all sections of each volume.

    directions: cv, section, into. tracers maps the name of a transport to its column; salt and other tracers are weighted by
    1 + zeta / h. A section's in- and outflows are summed once and then handed, turned or not, to each of its volumes.
    """
    amounts = {"q": F.col("q")} | {name: F.col("q") * F.col(c) * (1 + F.col("zeta") / F.col("h")) for name, c in tracers.items()}
    side = lambda x, positive: F.sum(F.when(F.col("q") > 0 if positive else F.col("q") < 0, x).otherwise(0.0))
    sums = flux.groupBy(*keys, "section", time).agg(*(side(x, up).alias(f"{n}_{'up' if up else 'down'}") for n, x in amounts.items() for up in (True, False)))
    turned = sums.join(directions.select("cv", "section", "into"), "section")
    into = lambda n: F.sum(F.when(F.col("into"), F.col(f"{n}_up")).otherwise(-F.col(f"{n}_down"))).alias(f"{n}_in")
    out = lambda n: F.sum(F.when(F.col("into"), F.col(f"{n}_down")).otherwise(-F.col(f"{n}_up"))).alias(f"{n}_out")
    return turned.groupBy(*keys, "cv", time).agg(*(f(n) for n in amounts for f in (into, out)))


def volume_rivers(loading: DataFrame, sources: DataFrame, members: DataFrame, loads: dict[str, str], times: DataFrame, time: str = "ts") -> DataFrame:
    """(cv, time, q_r and each load): the rivers of each volume by date, zero where it has none, interpolated to times (cv, time).

    loads maps the name of a load to the column of its concentration. A time outside the loading's dates is an error.
    """
    mine = sources.join(members.select("cv", "node_id").distinct(), "node_id").select("cv", "node_id")
    sums = {"q_r": F.sum("discharge")} | {name: F.sum(F.col("discharge") * F.col(c)) for name, c in loads.items()}
    found = loading.join(mine, "node_id").groupBy("cv", "date").agg(*(x.alias(c) for c, x in sums.items()))
    every = loading.select("date").distinct().join(times.select("cv").distinct(), how="cross")
    daily = every.join(found, ["cv", "date"], "left").select("cv", F.col("date").cast("timestamp").alias(time), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in sums))
    asked = times.select("cv", F.col(time).cast("timestamp").alias(time)).distinct()
    out = asked
    for c in sums:
        out = out.join(S.interpolate_to(daily, asked, c, ["cv"], time), ["cv", time])
    return out


def budgets_of_fields(
    field: DataFrame, surface: DataFrame, nodes: DataFrame, elements: DataFrame, sigma: DataFrame, members: DataFrame, flux: DataFrame,
    directions: DataFrame, loading: DataFrame, sources: DataFrame, step: float, constituents: dict[str, dict] | None = None,
    salt: str = "salinity", average: str = "all", skip: int = 0, keys: Sequence[str] = ("run",), time: str = "ts",
) -> dict[str, DataFrame]:
    """The budgets of tef_budget for many control volumes and runs, from model fields, in one call.

    field: keys, time, node_id, layer and variables; surface: keys, time, node_id, zeta; members: cv, node_id, where
    volumes may overlap; flux: section, time, q, salt, zeta, h and variables, with the keys that it has; directions: cv,
    section, into; loading: date, node_id, discharge and concentrations; sources: node_id. constituents maps a variable
    to {"rates": {column: kind}, "river": column of the loading}, either of which may lack. Steps after the loading's
    last date are left out, as the reference conditions end there. Variables, rates and volumes that lack are an error.
    """
    constituents = constituents or {}
    rates = {c: kind for spec in constituents.values() for c, kind in spec.get("rates", {}).items()}
    lacking = ({salt, *constituents, *rates} - set(field.columns)) | ({"salt", *constituents} - set(flux.columns))
    lacking |= {spec["river"] for spec in constituents.values() if "river" in spec} - set(loading.columns)
    if lacking:
        raise ValueError(f"missing: {', '.join(sorted(lacking))}")
    if unbound := members.join(directions, "cv", "left_anti").first():
        raise ValueError(f"volume {unbound.cv} has no section")
    ends = loading.select(F.col("date").cast("timestamp").alias(time))
    field, flux = S.truncate_to(field, ends, time), S.truncate_to(flux, ends, time)
    every = {"salt": salt} | {c: c for c in constituents}
    storage = volume_sums(field, surface, nodes, elements, sigma, members, list(every.values()), rates, [*keys, time])
    storage = written(storage.withColumnRenamed(f"v_{salt}", "v_salt"), "budget-storage")
    tracers = {"s": "salt"} | {f"c_{c}": c for c in constituents}
    exchange = written(volume_exchange(flux, directions, tracers, [k for k in keys if k in flux.columns], time), "budget-exchange")
    loads = {f"r_{c}": spec["river"] for c, spec in constituents.items() if "river" in spec}
    rivers = written(volume_rivers(loading, sources, members, loads, exchange, time), "budget-rivers")
    terms = {c: [f"c_{c}_in", f"c_{c}_out", *([f"r_{c}"] if "river" in spec else []), *spec.get("rates", {})] for c, spec in constituents.items()}
    return tef_budget(storage, exchange, rivers, step, terms, average, skip, time, [*keys, "cv"], storage if rates else None)
