"""Stores of extracts: runs appended beside one another, tables out, observations in."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estuary.sources.files import Folder, fresh

#: Folders of a store that readers do not see, as their names begin with an underscore.
STAGED, LOCKS, TIMES = "_staged", "_locks", "_times"


def stored_runs(spark: SparkSession, path: str) -> set[str]:
    """The runs of a store, by its folders alone; none where there is no store."""
    folder = Folder(spark, path)
    return {folder.unescaped(n.removeprefix("run=")) for n in folder.names() if n.startswith("run=")}


def append_run(df: DataFrame, path: str, run: str, force: bool = False) -> None:
    """Add df as a run; a run that is there already is refused, or replaced alone with force.

    The rows are written to a staged folder, which readers do not see, and only a whole one is moved to its place. The
    move is made under a lock file, so of two writers of a run one is refused, whenever they began. A writer that fails
    leaves the store as it was; one that is killed in the middle of its move leaves the lock, which its message names.
    """
    folder = Folder(df.sparkSession, path)
    final, lock = f"run={folder.escaped(run)}", f"{LOCKS}/{folder.escaped(run)}"
    if not force and folder.has(final):
        raise ValueError(f"run {run} is stored already")
    staged, old = f"{STAGED}/{fresh('new')}", f"{STAGED}/{fresh('old')}"
    try:
        df.write.parquet(f"{path}/{staged}")
        if not folder.claim(lock):
            raise ValueError(f"run {run} is being stored by another writer, or {path}/{lock} was left by one that died")
        try:
            if folder.has(final):
                if not force:
                    raise ValueError(f"run {run} is stored already")
                folder.move(final, old)
            folder.move(staged, final)
        finally:
            folder.delete(lock)
    finally:
        folder.delete(staged)
        folder.delete(old)


def index_times(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """(file, low, high) of the table's files, kept beside it: only files that the last index lacks are read, their times alone.

    A new index is a new folder, so readers of the last one are not disturbed.
    """
    folder = Folder(spark, path)
    table = spark.read.parquet(path)
    files = spark.createDataFrame([(f,) for f in table.inputFiles()], "file string")
    known = _last_index(spark, folder, time)
    old = files.join(known, "file") if known is not None else None
    lacking = files if known is None else files.join(known, "file", "left_anti")
    new = [unquote(r.file) for r in lacking.collect()]
    parts = [old] if old is not None else []
    if new:
        rows = spark.read.parquet(*new).groupBy(F.input_file_name().alias("file"))
        parts.append(rows.agg(F.min(time).alias("low"), F.max(time).alias("high")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    number = max((int(n) for n in folder.names(f"{TIMES}/{time}")), default=0) + 1
    both.write.parquet(f"{path}/{TIMES}/{time}/{number:08}")
    return _last_index(spark, folder, time)


def _last_index(spark: SparkSession, folder: Folder, time: str) -> DataFrame | None:
    whole = [n for n in folder.names(f"{TIMES}/{time}") if folder.has(f"{TIMES}/{time}/{n}/_SUCCESS")]
    return spark.read.parquet(f"{folder.path}/{TIMES}/{time}/{max(whole)}") if whole else None


def read_range(spark: SparkSession, path: str, columns: Sequence[str], start=None, end=None, time: str = "ts") -> DataFrame:
    """The columns of the rows from start to end, both included, of a table with an index of times.

    Files that hold no such time are not opened; files that are newer than the index are, so that no row is lost. A file
    without any time holds no row of a range.
    """
    index = _last_index(spark, Folder(spark, path), time)
    table = spark.read.parquet(path)
    if index is not None and (start is not None or end is not None):
        meets = F.lit(True)
        if start is not None:
            meets &= F.col("high") >= F.lit(start)
        if end is not None:
            meets &= F.col("low") <= F.lit(end)
        files = spark.createDataFrame([(f,) for f in table.inputFiles()], "file string")
        chosen = files.join(index.withColumn("known", F.lit(True)), "file", "left").where(meets | F.col("known").isNull())
        schema, chosen = table.schema, [unquote(r.file) for r in chosen.select("file").collect()]
        # the rows' partition columns come from their folders
        table = spark.read.schema(schema).option("basePath", path).parquet(*chosen) if chosen else table.limit(0)
    if start is not None:
        table = table.where(F.col(time) >= F.lit(start))
    if end is not None:
        table = table.where(F.col(time) <= F.lit(end))
    return table.select(*columns)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Tabular results, as gzipped CSV with a header, or Parquet."""
    if fmt == "csv":
        df.write.option("header", True).option("compression", "gzip").csv(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no such format: {fmt}")


def read_obs(spark: SparkSession, source: str, table: str = "observations", partitions: int = 16, **options: str) -> DataFrame:
    """Observations from a Parquet path, or from a database by JDBC in partitions of the id, with filters pushed down.

    The database finds the least and greatest id itself; its own spelling and quoting of the column are used.
    """
    if not source.startswith("jdbc:"):
        return spark.read.parquet(source)
    reader = lambda **more: spark.read.format("jdbc").options(url=source, **options, **more)
    key = next(c for c in reader(dbtable=table).load().columns if c.lower() == "id")
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source).quoteIdentifier(key)
    low, high = reader(query=f"SELECT min({quoted}) AS lo, max({quoted}) AS hi FROM {table}").load().first()
    return reader(dbtable=table, partitionColumn=key, lowerBound=low or 0, upperBound=high or 1, numPartitions=partitions).load()
