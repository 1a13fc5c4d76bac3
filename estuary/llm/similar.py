"""Links between texts by the exact similarity of their five-word shingles, found by MinHash bands."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm import simhash
from estuary.llm.common import hot_keys, join_dealt, keyed_texts, slices
from estuary.session import written

SHINGLE, SEED = 5, 42
SIMILARITY = 0.8
#: Bands of so many rows: two texts of a similarity of 0.8 miss each other in all bands once in 70.
BANDS, ROWS = 14, 6
#: Hubs are drawn by the hash of their key: so many values of it.
DRAWN = 1 << 20
#: Keys of fewer rows are no hot keys, however few rows there are in all.
HOT = 1000
#: Bounds of shares of a size are taken so much wider, which admits a few comparisons more and misses none.
ROUNDING = 1e-6

_RNG = np.random.default_rng(8)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def band_keys(hashes: np.ndarray, block: int = 4096) -> np.ndarray:
    """A key for each band from the hashes of a text's shingles; equal only where all rows of the band agree."""
    import xxhash

    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), block):
        low = np.minimum(low, (hashes[i : i + block, None] * _TIMES + _PLUS).min(0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def signature(text: str) -> tuple[int, list[int]]:
    """How many shingles a text has, repeats included, and its bands' keys; no keys without words."""
    hashes = simhash.shingle_hashes(text, SHINGLE, SEED)
    return len(hashes), band_keys(hashes).tolist() if len(hashes) else []


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(key, shingles) of texts (key, text): the different hashes of shingles of those whose fingerprint is the key."""
    source = keyed_texts(texts, "key", "text")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def hashed(batches):
        for whole in batches:
            for batch in slices(whole):
                keys, sets = [], []
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if simhash.fingerprint(text) == key % 2**64:  # an id may stand for other texts as well
                        keys.append(key)
                        sets.append(np.unique(simhash.shingle_hashes(text, SHINGLE, SEED)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    return source.mapInArrow(hashed, schema).groupBy("key").agg(F.min("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (hub, key) whose shingle sets have the similarity. A hub's pairs may be many and are dealt to parts."""
    near = join_dealt(pairs, sets.select(F.col("key").alias("hub"), F.col("shingles").alias("a")), ["hub"], "key", hot_keys(pairs, ["hub"], least=HOT))
    near = near.join(sets.select("key", F.col("shingles").alias("b")), "key")
    common = F.size(F.array_intersect("a", "b"))
    return near.where(common >= least * (F.size("a") + F.size("b") - common)).select("hub", "key")


def shared(rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key others have as well, with n, the number of rows of the key.

    Keys are not dealt to parts here, for which all rows, most of them alone with their key, would go through one join
    more. The numbers lie in a table of their own, as Spark splits the skewed partitions of a join only where both sides
    are shuffled for it.
    """
    return rows.join(written(rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), "similar-shared"), on)


def rare_shingles(texts: DataFrame, least: float) -> DataFrame:
    """(key, size, degree, at, shingle) of texts (key, size, degree, shingles), each text's rarest shingles first.

    A text's shingles are in the order of the number of these texts that hold them, `at` counts from 0. Two texts as
    similar as asked share one of their first 1 - least of the shingles, so a text's later ones are left out, and those
    that no other text holds, which are all before the rest.
    """
    each = texts.select("key", "size", "degree", F.explode("shingles").alias("shingle"))
    own = shared(each, ["shingle"]).groupBy("key", "size", "degree").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("own"))
    alone = F.col("size") - F.size("own")
    first = F.floor((1 - least) * F.col("size") + ROUNDING) + 1 - alone
    first = own.select("key", "size", "degree", alone.alias("alone"), F.slice("own", 1, F.greatest(first, F.lit(0)).cast("int")).alias("own"))
    placed = first.select("key", "size", "degree", "alone", F.posexplode("own").alias("pos", "one"))
    return placed.select("key", "size", "degree", (F.col("alone") + F.col("pos")).alias("at"), "one.shingle")


def similar_links(firsts: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between fingerprints whose texts have a similarity of `least`, enough for their components.

    firsts: fp, first (an id), size and bands, a row for a fingerprint; texts: first, text. Texts meet where a band's
    keys are equal. Of those that share one, each is compared with a hub, the text that meets most others, and linked
    to it if their sets of shingles are as similar as asked. So groups of near copies cost one comparison a text
    whatever their size. Texts that are not as similar to their hub, and have others left in their group, meet again by
    the rarest shingles of each (see rare_shingles): of two that are as similar, one has a common shingle among the
    first (1 - least) / (1 + least) of its own, and only such texts are hubs then; what stands before a common shingle
    in both must leave enough to be common. So texts that have a passage or an original in common and are not
    similar do not meet, as what is their own is rarer. These groups take about twice as many hubs each round, until
    none has a text that may be one. No text is linked without the exact check. Two texts of a similarity of 0.8 share
    no band once in 70; and a text that links to a hub is not compared with the others of that group, which matters
    where they are near to it and not to the hub. Texts without words, and those whose ids are all null, are not
    compared.
    """
    members = firsts.where("size > 0 and first is not null").select(F.col("fp").alias("key"), "first", F.posexplode("bands").alias("band", "part"))
    on = ["band", "part"]
    met = written(shared(members, on), "similar-members")
    asked = written(met.groupBy("key", "first").agg(F.sum("n").alias("degree")), "similar-asked")
    sets = written(shingle_sets(texts.join(asked, "first").select("key", "text")).withColumn("size", F.size("shingles")), "similar-sets")
    known = asked.join(sets.select("key", "size"), "key").select("key", "size", "degree", F.lit(0).cast("long").alias("at"))
    left = written(met.select("key", *on).join(known, "key"), "similar-left")
    hot = written(hot_keys(left, on, least=HOT), "similar-hot")  # groups only shrink
    found, done, many, by_bands = [], None, 1, True
    early = (1 + least) * F.col("at") <= (1 - least) * F.col("size") + ROUNDING
    while True:
        most = F.max(F.when(early, F.struct("degree", "key"))).alias("top")
        groups = left.groupBy(*on).agg(F.count("*").alias("n"), F.count_if(early).alias("hubs"), most).where("n > 1 and hubs > 0")
        drawn = F.pmod(F.xxhash64("key"), F.lit(DRAWN)) * F.col("hubs") < F.lit(DRAWN * (many - 1))
        chosen = early & ((F.col("key") == F.col("top.key")) | drawn)
        marked = written(join_dealt(left, groups, on, "key", hot).select("key", "size", "degree", "at", *on, chosen.alias("chosen")), "similar-marked")
        if marked.isEmpty():
            break
        hubs = marked.where("chosen").select(*on, F.col("key").alias("hub"), F.col("size").alias("hub_size"), F.col("at").alias("hub_at"))
        fits = (1 + least) * F.least(F.expr("size - at"), F.expr("hub_size - hub_at")) >= least * F.expr("size + hub_size") - ROUNDING
        tried = written(join_dealt(marked.select("key", "size", "at", *on), hubs, on, "key", hot).where(F.expr("key <> hub") & fits), "similar-tried")
        pairs = tried.select("hub", "key").distinct()
        if done is not None:
            pairs = pairs.join(done, ["hub", "key"], "left_anti")
        pairs = written(pairs, "similar-pairs")
        found.append(written(verified(pairs, sets, least), "similar-good"))
        done = pairs if done is None else done.union(pairs)
        linked = functools.reduce(DataFrame.union, found).distinct()
        reached = tried.join(linked, ["hub", "key"], "left_semi").select("key", *on).distinct()
        rest = marked.where("not chosen").select("key", "size", "degree", "at", *on)
        left, many = written(rest.join(reached, ["key", *on], "left_anti"), "similar-left"), 2 * many
        if by_bands:
            others = left.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
            again = join_dealt(left, others, on, "key", hot).select("key", "degree").distinct()
            on, many, by_bands = ["shingle"], 1, False
            left = written(rare_shingles(sets.join(again, "key"), least), "similar-left")
            hot = written(hot_keys(left, on, least=HOT), "similar-hot")
    if not found:
        return firsts.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    return functools.reduce(DataFrame.union, found).select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")).distinct()
