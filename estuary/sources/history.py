"""Text histories of fixed-length time blocks, and the catalogue that names their variables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Characters of one number.
WIDTH = 15
VERSION = 4
#: Bytes of a partition.
SPLIT = 64 << 20


@dataclass
class Blocks(InputPartition):
    """A run of a file's blocks."""

    path: str
    first: int
    count: int


class HistoryReader(DataSourceReader):
    """Runs of blocks as partitions; of each block the header and the numbers of the wanted variables are read."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.header, self.nodes, self.variables = (int(options[k]) for k in ("header", "nodes", "variables"))
        self.wanted = sorted({int(x) for x in options.get("wanted", "").split(",") if x} or range(1, self.variables + 1))
        self.size = self.header + WIDTH * self.nodes * self.variables
        self.split = max(1, int(options.get("split", SPLIT)) // self.size)

    def partitions(self) -> Sequence[Blocks]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        out = []
        for file in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if file.size % self.size:
                raise ValueError(f"{file.base_name} does not hold whole blocks of {self.size} bytes")
            blocks = file.size // self.size
            out += [Blocks(file.path, i, min(self.split, blocks - i)) for i in range(0, blocks, self.split)]
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        line = WIDTH * self.nodes
        own = np.arange(1, self.nodes + 1, dtype=np.int32)
        with store.open_input_file(partition.path) as file:
            for block in range(partition.first, partition.first + partition.count):
                day, version, nodes = file.read_at(self.header, block * self.size).split()[:3]
                if int(version) != VERSION:
                    raise ValueError(f"unknown version: {int(version)}")
                if int(nodes) != self.nodes:
                    raise ValueError(f"another node count: {int(nodes)}")
                for var in self.wanted:
                    text = file.read_at(line, block * self.size + self.header + (var - 1) * line)
                    values = np.frombuffer(text, f"S{WIDTH}").astype(np.float64)
                    columns = [np.full(self.nodes, float(day)), np.full(self.nodes, var, np.int32), own, values]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["day", "var", "node_id", "value"])


class PruningReader(HistoryReader):
    """The reader where Spark pushes filters down, which spark.sql.python.filterPushdown.enabled says."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on var choose what is read; Spark applies all others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("var",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = [x for x in self.wanted if x in asked]
            else:
                yield f


class HistorySource(DataSource):
    """spark.read.format("history"): options header (characters), nodes and variables of a block, wanted (variables' numbers at commas, all by default), split (bytes of a partition), push (filters on var choose as well)."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return "day double, var int, node_id int, value double"

    def reader(self, schema) -> HistoryReader:
        options = dict(self.options)
        return (PruningReader if options.get("push") == "true" else HistoryReader)(options)


def scan_history(spark: SparkSession, path: str, header: int, nodes: int, variables: int, wanted: Sequence[int] = (), split: int = SPLIT) -> DataFrame:
    """(day, var, node_id, value) of a history: each block is a header (time, version, node count) and nodes * variables numbers of 15 characters.

    path is a file or a folder of files, in a store that pyarrow reads, each of whole blocks. Only the wanted variables'
    bytes are read, all by default. Another version or node count, or a part of a block, is an error.
    """
    spark.dataSource.register(HistorySource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("history").options(header=header, nodes=nodes, variables=variables, split=split, push=push)
    return reader.option("wanted", ",".join(map(str, wanted))).load(path if "://" in path else f"file://{path}")


def apply_var_catalog(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """history (layer, day, var, node_id, value) with variables named by the catalogue (var, name, per_layer, per_time).

    A variable that is not per layer keeps the first layer that has it; one that is not per time keeps the first time.
    Both are least values, which tasks find for their own rows before these few meet. Returns name, seconds, layer,
    node_id, value.
    """
    first = history.groupBy("var").agg(F.min("layer").alias("first_layer"), F.min("day").alias("first_day"))
    named = history.join(catalog.join(first, "var"), "var")
    kept = named.where((F.col("per_layer") | (F.col("layer") == F.col("first_layer"))) & (F.col("per_time") | (F.col("day") == F.col("first_day"))))
    return kept.select("name", (F.col("day") * 86_400).alias("seconds"), "layer", "node_id", "value")
