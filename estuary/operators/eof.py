"""Empirical orthogonal functions of a field of differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estuary.session import written

#: The Gram matrix of the smaller side is taken to the driver up to this size: so many squared make 200 MB.
MOST = 5_000
#: Rows and columns of the blocks that are multiplied: 8 MB each.
TILE, BLOCK = 512, 2048
#: Vectors beyond the modes in the subspace, its rounds at most, and the residual by the first singular value.
EXTRA, ROUNDS, RESIDUAL = 8, 300, 1e-9


def gram(b: DataFrame, nodes: int, tile: int = TILE, block: int = BLOCK, row: str = "t", col: str = "node_id", columns: int | None = None) -> tuple[list, np.ndarray]:
    """The rows' ids in order and B B' / nodes of a complete field (row, col, b).

    Columns are dealt to blocks and rows to tiles. Each pair of tiles of one block is a matrix product in a task, and
    the products of a pair are summed over the blocks row by row; only the sums go to the driver.
    """
    order = Window.orderBy(row)  # one line a row of the matrix
    numbered = b.select(row).distinct().withColumn("i", F.row_number().over(order) - 1)
    ids = [r[0] for r in numbered.orderBy("i").select(row).collect()]
    blocks, tiles = -(-(columns or nodes) // block), -(-len(ids) // tile)
    placed = b.join(numbered, row).select("i", F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int").alias("block"), F.col(col).alias("c"), "b")
    rows = placed.groupBy("i", "block").agg(F.array_sort(F.collect_list(F.struct("c", "b"))).alias("line")).select("i", "block", "line.b", F.floor(F.col("i") / tile).cast("int").alias("tile"))
    tiled = written(rows.groupBy("tile", "block").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("lines")).select("tile", "block", F.transform("lines", lambda x: x["b"]).alias("m")), "eof-tiles")
    left = tiled.select("block", F.col("tile").alias("p"), F.col("m").alias("a"), F.explode(F.sequence(F.col("tile"), F.lit(tiles - 1))).alias("q"))
    pairs = left.join(tiled.select("block", F.col("tile").alias("q"), F.col("m").alias("c")), ["block", "q"])

    def matrix(column, k: int) -> np.ndarray:
        lines = column[k].values
        return lines.flatten().to_numpy().reshape(len(lines), -1)

    def multiply(batches):
        for batch in batches:
            for k, (first, q) in enumerate(zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True)):
                out = matrix(batch.column("a"), k) @ matrix(batch.column("c"), k).T
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)) + first * tile), pa.array(np.full(len(out), q)), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "q", "g"])

    products = pairs.select("p", "q", "a", "c").mapInArrow(multiply, "i long, q long, g array<double>")
    nothing = F.array_repeat(F.lit(0.0), F.size(F.first("g")))
    # one product for each block of columns
    total = F.aggregate(F.collect_list("g"), nothing, lambda done, x: F.zip_with(done, x, lambda u, v: u + v))
    g = np.zeros((len(ids), len(ids)))
    for r in products.groupBy("i", "q").agg(total.alias("g")).toLocalIterator():
        g[r.i, r.q * tile : r.q * tile + len(r.g)] = r.g
    g = np.triu(g)
    return ids, (g + np.triu(g, 1).T) / nodes


def subspace(b: DataFrame, nodes: int, modes: int, row: str, col: str, rounds: int = ROUNDS, residual: float = RESIDUAL) -> tuple[list, np.ndarray, np.ndarray]:
    """(rows' ids, singular values, vectors over rows) of the first modes of B / sqrt(nodes), by subspace iteration.

    Each round multiplies a block of modes + EXTRA vectors by B' and by B in tasks, column by column of B, and sums
    the products by row: the driver and a task hold a block of vectors, never a matrix of rows by rows. It stops when
    B B' / nodes leaves the vectors of all modes where they are, but for the residual times the first value.
    """
    ids = [r[0] for r in b.select(row).distinct().orderBy(row).collect()]
    width, sc = min(len(ids), modes + EXTRA), b.sparkSession.sparkContext
    lines = b.groupBy(col).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "b"))).alias("line")).select(F.col("line.b").alias("line"))
    lines = written(lines, "eof-lines")
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(len(ids), width)))[0]
    for _ in range(rounds):
        block = sc.broadcast(q)

        def multiply(batches, block=block):
            out = np.zeros(block.value.shape)
            for batch in batches:
                m = batch.column("line").flatten().to_numpy().reshape(batch.num_rows, -1)
                out += m.T @ (m @ block.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "y"])

        sums = [F.sum(F.get("y", F.lit(k))).alias(f"y{k}") for k in range(width)]
        parts = lines.mapInArrow(multiply, "i long, y array<double>").groupBy("i").agg(*sums).toArrow()
        y = np.empty_like(q)
        y[parts["i"].to_numpy()] = np.stack([parts[f"y{k}"].to_numpy() for k in range(width)], 1) / nodes
        block.unpersist()
        values, turn = np.linalg.eigh(q.T @ y)
        turn = turn[:, ::-1]
        values = np.clip(values[::-1], 0, None)
        off = np.linalg.norm(y @ turn - (q @ turn) * values, axis=0)[:modes]
        if values[0] == 0 or (off <= residual * values[0]).all():
            return ids, np.sqrt(values[:modes]), (q @ turn)[:, :modes]
        q = np.linalg.qr(y @ turn)[0]
    raise RuntimeError(f"no {modes} modes after {rounds} rounds: they are as strong as those that follow")


def eof(delta: DataFrame, weights: DataFrame, modes: int = 3, most: int = MOST) -> DataFrame:
    """(mode, share, t, pc, node_id, eof_value) as two kinds of rows: per step the principal component, per node the map.

    Values times normalised weights (area times depth), less each step's spatial mean, give X (steps by nodes). The
    singular vectors over the smaller side, steps or nodes, come from its Gram matrix, of block products and sums in
    Spark, where that side has `most` at most; beyond, from subspace iteration, which holds a few vectors instead. The
    other side's are sums over it, again in Spark. Share is the singular value's part of the sum of all, NULL where
    these are not known, after subspace iteration. Steps that lack nodes are left out. Signs are fixed so that a
    component's largest part is positive, the first one of equals.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    w = weights.join(total, how="cross").select("node_id", (F.col("weight") / F.col("total")).alias("w"))
    nodes = w.count()
    x = delta.join(w, "node_id").select("t", "node_id", (F.col("delta") * F.col("w")).alias("x"), "w")
    means = x.groupBy("t").agg(F.avg("x").alias("mean"), F.count("*").alias("n")).where(F.col("n") == nodes)
    b = written(x.join(means, "t").select("t", "node_id", (F.col("x") - F.col("mean")).alias("b"), "w"), "eof-field")
    steps = b.select("t").distinct().count()
    row, col = ("t", "node_id") if steps <= nodes else ("node_id", "t")
    if min(steps, nodes) <= most:
        ids, g = gram(b, nodes, row=row, col=col, columns=max(steps, nodes))
        values, vectors = np.linalg.eigh(g)
        order = np.argsort(-values)
        singular, vectors = np.sqrt(np.clip(values[order], 0, None)), vectors[:, order]
        whole = float(singular.sum())
    else:
        ids, singular, vectors = subspace(b, nodes, modes, row, col)
        whole = None
    spark = delta.sparkSession
    found = range(min(modes, len(ids)))
    parts = [(k + 1, i, float(vectors[j, k])) for k in found for j, i in enumerate(ids)]
    values = spark.createDataFrame([(k + 1, float(singular[k]), float(singular[k]) / whole if whole else None) for k in found], "mode int, s double, share double")
    near = spark.createDataFrame(parts, f"mode int, {row} {dict(b.dtypes)[row]}, x double").join(F.broadcast(values), "mode")
    scale = F.sqrt(F.lit(float(nodes)))
    held = F.when(F.col("s") > 0, F.col("b") * F.col("x") / F.col("s")).otherwise(0.0) / scale
    far = b.join(near, row).groupBy("mode", "share", "s", col).agg(F.sum(held).alias("x"))
    over_steps, over_nodes = (near, far) if row == "t" else (far, near)
    largest = over_steps.groupBy("mode").agg(F.max_by("x", F.struct(F.abs("x").alias("size"), (-F.col("t")).alias("first"))).alias("top"))
    turn = F.broadcast(largest.select("mode", F.when(F.col("top") < 0, -1.0).otherwise(1.0).alias("sign")))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    pcs = over_steps.join(turn, "mode").select("mode", "share", "t", (F.col("sign") * F.col("x") * F.col("s")).alias("pc"), none("node_id", "int"), none("eof_value", "double"))
    maps = over_nodes.join(w, "node_id").join(turn, "mode")
    shown = (F.col("sign") * F.col("x") * scale / F.col("w")).alias("eof_value")
    return pcs.unionByName(maps.select("mode", "share", none("t", "int"), none("pc", "double"), "node_id", shown))
