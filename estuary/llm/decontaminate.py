"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm.common import join_dealt, keyed_texts, slices
from estuary.session import written

SHINGLE = 5
SIMILARITY = 0.8
#: Windows at similarity 0.8 differ from their item in 9.7 of 64 bits on average, with a deviation of 2.9: 19 bits
#: miss one in 2,000 of such edge cases.
RADIUS = 19
BLOCKS = 5
#: Words of the items that a task holds at once, about 40 bytes each. More items are taken in several parts, each
#: against all documents.
WORDS_AT_ONCE = 2_000_000
#: Windows in a run: a row stays small however long a text repeats an item.
RUN_WINDOWS = 4096

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + size])) for i in range(len(words) - size + 1)), np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each window of `size` shingles; a shingle counts as often as it occurs.

    The bits of the first window are counted, then each further window gains one shingle and loses one.
    """
    moves = len(hashes) - size
    ones = np.zeros((moves + 1, 64), np.int32)
    for i in range(0, size, 65_536):
        ones[0] += _bits(hashes[i : min(i + 65_536, size)]).sum(0, dtype=np.int32)
    if moves:
        ones[1:] = _bits(hashes[size:]).astype(np.int8) - _bits(hashes[:moves]).astype(np.int8)
        np.cumsum(ones, axis=0, out=ones)
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view("<i8")[:, 0]


def mixed(ids: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of so many word ids; 0 where a word has none (id 0)."""
    m = len(ids) - size + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    out, whole = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
        whole &= ids[k : k + m] > 0
    return np.where(whole, np.maximum(out, np.uint64(1)), np.uint64(0))


class ItemWords:
    """The words of a part of the items, and their shingles with the lengths of the items that hold them."""

    def __init__(self, texts: list[str], shingle: int, similarity: float):
        self.shingle, self.similarity = shingle, similarity
        self.ids: dict[str, int] = {}
        groups: dict[int, list[np.ndarray]] = defaultdict(list)
        for text in texts:
            words = words_of(text)
            if words:
                ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.uint64)
                groups[len(words)].append(mixed(ids, min(shingle, len(words))))
        unique = {n: np.unique(np.concatenate(parts)) for n, parts in groups.items()}
        #: (words in a shingle, shingles in order, item length of each)
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in sorted({min(shingle, n) for n in unique}):
            mine = [n for n in unique if min(shingle, n) == k]
            every = np.concatenate([unique[n] for n in mine])
            lengths = np.repeat(np.array(mine, np.int64), [len(unique[n]) for n in mine])
            order = np.argsort(every, kind="stable")
            self.tables.append((k, every[order], lengths[order]))

    def hits(self, words: list[str]):
        """(shingle, item length, places of the text's shingles that an item of that length holds, in order)."""
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(0)), np.uint64, len(words))
        for k, every, lengths in self.tables:
            runs = mixed(ids, k)
            at = np.flatnonzero(runs)
            low = np.searchsorted(every, runs[at])
            times = np.searchsorted(every, runs[at], side="right") - low
            if not times.any():
                continue
            ends = np.cumsum(times)
            places = np.repeat(at, times)
            length = lengths[np.repeat(low - (ends - times), times) + np.arange(ends[-1])]
            order = np.argsort(length, kind="stable")
            places, length = places[order], length[order]
            cuts = np.flatnonzero(np.diff(length)) + 1
            for n, mine in zip(length[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                yield k, n, mine

    def runs(self, words: list[str]):
        """(shingle, item length, words in a window, first start, last start) of the windows that hold enough of the items' shingles to reach the similarity with an item of that length at all.

        So many hits in a row lie in one window if it starts between two bounds. Both bounds rise from hit to hit, so
        their intervals join in order: time and memory are linear in the hits.
        """
        for k, n, mine in self.hits(words):
            size = min(n, len(words))
            there = size - k + 1
            least = math.ceil(self.similarity * (n - k + 1 + there) / (1 + self.similarity) - 1e-9)
            if len(mine) < least:
                continue
            low = np.maximum(mine[least - 1 :] - there + 1, 0)
            high = np.minimum(mine[: len(mine) - least + 1], len(words) - size)
            low, high = low[low <= high], high[low <= high]
            if not len(low):
                continue
            new = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
            firsts, lasts = low[np.concatenate(([0], new))], high[np.concatenate((new - 1, [len(high) - 1]))]
            for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
                for start in range(first, last + 1, RUN_WINDOWS):
                    yield k, n, size, start, min(start + RUN_WINDOWS - 1, last)


def candidate_runs(docs: DataFrame, items: ItemWords) -> DataFrame:
    """(id, item_words, start, size, fps, shingles) of the runs of neighbouring windows that may match; docs has id and text.

    fps are the windows' fingerprints from `start` on, shingles the hashes that the run's words make.
    """
    longs = T.ArrayType(T.LongType())
    fields = [("id", docs.schema["id"].dataType), ("item_words", T.LongType()), ("start", T.LongType()), ("size", T.LongType()), ("fps", longs), ("shingles", longs)]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def found_in(text: str):
        words = words_of(text)
        for k, n, size, first, last in items.runs(words) if words else ():
            hashes = shingle_hashes(words[first : last + size], k)
            yield n, first, size, simhashes(hashes, size - k + 1), hashes.view(np.int64)

    def batch_of(ids, rows, found):
        lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (3, 4)]
        columns = [ids.take(pa.array(rows, pa.int64())), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)), *lists]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def scan(batches):
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                ids, rows, found, held = batch.column("id"), [], [], 0
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for run in found_in(text):
                        rows.append(row)
                        found.append(run)
                        held += len(run[3]) + len(run[4])
                        if held > 1 << 20:
                            yield batch_of(ids, rows, found)
                            rows, found, held = [], [], 0
                yield batch_of(ids, rows, found)

    return docs.mapInArrow(scan, schema)


def block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def item_table(items: DataFrame, shingle: int) -> DataFrame:
    """(item_id, text, item_words, item_fp, item_shingles) of the items that have a word."""
    schema = T.StructType([T.StructField("item_id", items.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("item_words", T.LongType()), T.StructField("item_fp", T.LongType()), T.StructField("item_shingles", T.ArrayType(T.LongType()))])

    def measure(batches):
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    if words := words_of(text):
                        h = shingle_hashes(words, min(shingle, len(words)))
                        rows.append((row, len(words), int(simhashes(h, len(h))[0]), h.view(np.int64)))
                take = pa.array([r[0] for r in rows], pa.int64())
                columns = [batch.column("id").take(take), batch.column("text").take(take), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return items.mapInArrow(measure, schema)


def item_index(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Every item's number and fingerprint under all block values within its share of the radius.

    Fingerprints within the radius agree in at least one block up to radius // blocks bits, so none is missed.
    """
    schema = "item long, item_words long, item_fp long, block long, part long"
    masks, share = [m & (2**64 - 1) for m in block_masks(blocks)], radius // blocks
    flips = []
    for mask in masks:
        bits = [1 << b for b in range(64) if mask >> b & 1]
        flips.append(np.array([sum(f) for d in range(share + 1) for f in itertools.combinations(bits, d)], np.uint64))
    which = np.repeat(np.arange(blocks), [len(f) for f in flips])

    def index(batches):
        for batch in batches:
            for item, n, fp in zip(*(batch.column(c).to_pylist() for c in ("item", "item_words", "item_fp")), strict=True):
                bits = np.uint64(fp & (2**64 - 1))
                part = np.concatenate([bits & np.uint64(m) ^ f for m, f in zip(masks, flips, strict=True)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), v)) for v in (item, n, fp)), pa.array(which), pa.array(part)], names=["item", "item_words", "item_fp", "block", "part"])

    return items.select("item", "item_words", "item_fp").mapInArrow(index, schema)


def best_window(shingles: np.ndarray, item: np.ndarray, there: int, starts: np.ndarray) -> tuple[float, int]:
    """The greatest weighted Jaccard similarity of the windows of `there` shingles at these starts with an item, and the first such start.

    Each shingle weighs as often as it occurs. The window moves along the shingles, so the cost is linear in them.
    """
    values, wanted = np.unique(item, return_counts=True)
    place = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
    code = np.where(values[place] == shingles, place, -1)
    at, last = int(starts.min()), int(starts.max())
    inside = code[at : at + there]
    have = np.bincount(inside[inside >= 0], minlength=len(values))
    common = int(np.minimum(have, wanted).sum())
    have, need, codes, asked = have.tolist(), wanted.tolist(), code.tolist(), set(starts.tolist())
    best = (-1.0, -1)
    while True:
        if at in asked and (s := common / (there + len(item) - common)) > best[0]:
            best = (s, at)
        if at == last:
            return best
        if (gone := codes[at]) >= 0:
            have[gone] -= 1
            common -= have[gone] < need[gone]
        if (new := codes[at + there]) >= 0:
            common += have[new] < need[new]
            have[new] += 1
        at += 1


def verified(pairs: DataFrame, shingles: dict[int, np.ndarray], similarity: float) -> DataFrame:
    """(id, item_id, similarity, start, size) of the rows whose best window reaches the similarity.

    pairs: id, item_id, item, start, size, shingles of a run, and at, the numbers of its windows that met the item.
    """
    schema = T.StructType([pairs.schema["id"], pairs.schema["item_id"], T.StructField("similarity", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType())])

    def check(batches):
        for batch in batches:
            rows, best = [], []
            runs, met = batch.column("shingles"), batch.column("at")
            for row, (item, start, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item", "start", "there")), strict=True)):
                s, at = best_window(runs[row].values.to_numpy(), shingles[item], k, met[row].values.to_numpy())
                if s >= similarity - 1e-9:
                    rows.append(row)
                    best.append((s, start + at))
            take = pa.array(rows, pa.int64())
            columns = [batch.column("id").take(take), batch.column("item_id").take(take), pa.array([b[0] for b in best], pa.float64()), pa.array([b[1] for b in best], pa.int64()), batch.column("size").take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pairs.select("id", "item_id", "item", "start", "size", "there", "shingles", "at").mapInArrow(check, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, similarity, start, size): the best window of each document for each benchmark item it repeats.

    Words are runs of letters, digits and _ in lower case. Each window has as many words as the item (or is the whole
    text, if that is shorter); items with fewer words than a shingle are one shingle. A window must hold enough of
    the shingles of items of its length to reach the similarity at all; its SimHash then finds the items within the
    radius over Hamming blocks, and the weighted shingles of both decide. Of windows equally similar the first counts.

    Items are taken in parts of about words_at_once words, each written before the next: that is what the driver and
    a task hold of the benchmark. Windows go in runs of RUN_WINDOWS, so that long texts that repeat an item over and
    over make many small rows. Null or empty texts and items match nothing. Repeated documents give one row for each
    (doc_id, item_id). Other columns are ignored, whatever their names. Empty tables: no rows.
    """
    source = keyed_texts(docs, id_col, text_col)
    measured = item_table(keyed_texts(benchmark, item_col, item_text_col).distinct(), shingle)
    items = written(measured.withColumn("item", F.monotonically_increasing_id()), "decontaminate-items")
    parts = max(1, -(-(items.agg(F.sum("item_words")).first()[0] or 0) // words_at_once))
    found = []
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        found.append(_matches(source, mine, shingle, similarity, radius, blocks))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "size")).alias("best")
    rows = functools.reduce(DataFrame.unionByName, found).groupBy("id", "item_id").agg(best)
    return rows.select(F.col("id").alias("doc_id"), "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.start")).alias("start"), "best.size")


def _matches(source: DataFrame, items: DataFrame, shingle: int, similarity: float, radius: int, blocks: int) -> DataFrame:
    """(id, item_id, similarity, start, size) for a part of the items."""
    held = items.select("item", "text", "item_shingles").collect()
    words = ItemWords([r.text for r in held], shingle, similarity)
    runs = written(candidate_runs(source, words).withColumn("run", F.monotonically_increasing_id()), "decontaminate-runs")
    masks = F.array(*(F.lit(m) for m in block_masks(blocks)))
    prints = runs.select("item_words", F.explode("fps").alias("fp")).distinct().select("*", F.posexplode(masks).alias("block", "mask"))
    keyed = prints.select("item_words", "fp", F.col("block").cast("long").alias("block"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    pairs = keyed.join(item_index(items, radius, blocks), ["item_words", "block", "part"]).where(near).select("item_words", "fp", "item").distinct()
    met = written(pairs.join(items.select("item", "item_id"), "item"), "decontaminate-met")
    windows = runs.select("run", "item_words", F.posexplode("fps").alias("at", "fp"))
    met_at = join_dealt(windows, met, ["item_words", "fp"], "run").groupBy("run", "item").agg(F.first("item_id", ignorenulls=True).alias("item_id"), F.collect_list("at").alias("at"))
    there = (F.col("size") - F.least(F.lit(shingle), F.col("item_words")) + 1).alias("there")
    rows = met_at.join(runs.select("run", "id", "start", "size", "shingles", there), "run")
    return written(verified(rows, {r.item: np.array(r.item_shingles, np.int64) for r in held}, similarity), "decontaminate-part")
