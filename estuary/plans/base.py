"""How a query is registered: a function of views, and DuckDB SQL over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estuary import testviews
from estuary.session import table, written


class Inputs:
    """Views and base tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.meshes: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name.startswith("v_mesh_"):
            # a mesh is a table of its own: the queries name it many times, and the view reads all events for it
            if name not in self.meshes:
                self.meshes[name] = written(testviews.view(self.spark, self.sf_dir, name), name)
            return self.meshes[name]
        if name.startswith("v_"):
            return testviews.view(self.spark, self.sf_dir, name)
        return table(self.spark, self.sf_dir, name)

    def sql(self, body: str) -> DataFrame:
        return self.spark.sql(testviews.with_views(body, f"parquet.`{self.sf_dir}/{{name}}.parquet`"))


class Book:
    """Queries with their SQL twins. Doubles are rounded and times written as text on both sides, so that values compare."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, r: str = "", t: str = ""):
        """r: double columns, each with :digits if not 6; t: timestamp columns."""
        digits = {c.partition(":")[0]: int(c.partition(":")[2] or 6) for c in r.split()}

        def register(fn: Callable[[Inputs], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = fn(Inputs(spark, sf_dir))
                columns = {c: F.round(F.col(c).cast("double"), d) + F.lit(0.0) for c, d in digits.items()}
                columns |= {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in t.split()}
                return df.withColumns(columns) if columns else df

            name = fn.__name__
            self.queries[name] = run
            if sql:
                swaps = [f'round(CAST("{c}" AS DOUBLE), {d}) + CAST(0 AS DOUBLE) AS "{c}"' for c, d in digits.items()]
                swaps += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in t.split()]
                body = sql.strip()
                wrapped = f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{body}\n) q" if swaps else body
                self.oracle[name] = _with_views(wrapped, body)
            return fn

        return register


def _with_views(wrapped: str, body: str) -> str:
    views = testviews.needed(body)
    if not views:
        return wrapped
    parts = ",\n".join(f"{n} AS ({_plain(testviews.VIEWS[n])})" for n in views)
    if wrapped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{wrapped[15:]}"
    return f"WITH {parts}\n{wrapped}" if not wrapped.upper().startswith("WITH ") else f"WITH {parts},\n{wrapped[5:]}"


def _plain(view: str) -> str:
    return view.replace("{", "").replace("}", "").strip()
