"""SimHash near-duplicates: pigeonring candidates, Hamming check, and connected components."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm.common import join_dealt, keyed_texts, slices
from estuary.session import written

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 5
#: Keys with more fingerprints than this take the way over shared neighbours instead of pairs.
PAIRED = 48


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; the whole sequence is one if it has fewer words, and no words give none."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist() if len(words) >= shingle else [len(joined)]
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """64 bits: each is 1 if set in over half the hashes; 0 for none. Hashes are counted in blocks, so memory is bounded."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each is 1 if set in over half the XXH64 hashes of the text's shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, bands: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with bands also size and bands, for similar.similar_links()."""
    from estuary.llm import similar

    source = keyed_texts(docs, id_col, text_col)
    fields = [T.StructField("doc_id", source.schema["id"].dataType), T.StructField("fp", T.LongType())]
    fields += [T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))] if bands else []

    def hashed(batches):
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                texts = batch.column("text").to_pylist()
                columns = [batch.column("id"), pa.array(np.array([fingerprint(x, shingle, seed) for x in texts], np.uint64).view(np.int64))]
                if bands:
                    signed = [similar.signature(x) for x in texts]
                    columns += [pa.array([n for n, _ in signed], pa.int64()), pa.array([k for _, k in signed], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(hashed, T.StructType(fields))


def segment_masks(segments: int) -> list[int]:
    """64 bits as consecutive segments of nearly equal length, as signed longs."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def exact_chain(radius: int, segments: int) -> int:
    """The longest chain whose proportional budget, radius * length / segments, allows no difference at all."""
    return max(1, -(-segments // radius) - 1) if radius else segments


def chain_holds(difference: Column, start: Column, radius: int, segments: int) -> Column:
    """Some chain from segment start keeps each of its prefixes within the proportional budget (pigeonring)."""
    masks = segment_masks(segments)
    per_start = F.lit(False)
    for first in range(segments):
        running, ok = F.lit(0), F.lit(True)
        for length in range(1, segments + 1):
            running = running + F.bit_count(difference.bitwiseAND(F.lit(masks[(first + length - 1) % segments])))
            ok = ok & (running <= radius * length // segments)
        per_start = F.when(start == first, ok).otherwise(per_start)
    return per_start


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs within the radius.

    distinct has one row for each different fp. By the pigeonring principle two fingerprints within the radius have
    a ring position from which every chain of consecutive segments stays within its share of the radius; the first
    segments of that chain are equal, and they are the join key. Keys that few fingerprints share yield pairs, which
    must keep to the chain's budgets and then to the radius. Keys that more than `paired` share would yield pairs by
    the square; for radius 2 two fingerprints are linked just when some value lies within one bit of both, so their
    members are grouped by those 65 values: at most 65 fingerprints meet in a group, and no link is lost.
    """
    if radius > 2:
        raise ValueError("keys with many fingerprints are handled for a radius of 2 at most")
    masks, chain = segment_masks(segments), exact_chain(radius, segments)
    keys = []
    for i in range(segments):
        mask = functools.reduce(operator.or_, (masks[(i + k) % segments] for k in range(chain)))
        keys.append(F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(mask)).alias("part")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.ring", "key.part")
    sizes = keyed.groupBy("ring", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(sizes, ["ring", "part"]), "simhash-keys")
    few, many = met.where(F.col("n") <= paired), met.where(F.col("n") > paired).select("fp").distinct()
    left, right = few.select("ring", "part", F.col("fp").alias("a")), few.select("ring", "part", F.col("fp").alias("b"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        left.join(right, ["ring", "part"])
        .where(F.col("a") < F.col("b"))
        .where(chain_holds(difference, F.col("ring"), radius, segments))
        .where(F.bit_count(difference) <= radius)
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(2**63)).cast("long") for i in range(64)))
    near = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    balls = near.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = balls.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    if radius < 2:
        stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return pairs.union(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Alternates large-star and small-star steps over tables in the shared folder until nothing changes, which takes
    a number of rounds in the order of the logarithm of the size. Each step joins edges to one minimum per node.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "cc-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return found.union(found.select("root", "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Documents link where their fingerprints differ in `radius` bits at most; with a similarity also where their texts'
    five-word shingles are as similar (see similar.similar_links), for which the text of the smallest id stands for its
    fingerprint. Equal fingerprints count once until the end, so groups of copies cost one row each; fingerprints of
    over a thousandth of all rows, so under a thousand, have their rows dealt to parts in the last join. Texts of any
    length are read whole. Null and empty texts have fingerprint zero and link like any other. Repeated rows come back
    as often as they came. A null doc_id comes back with its group's id, null if the group has no other. Empty table:
    no rows.
    """
    prints = fingerprints(docs, id_col, text_col, shingle, seed, similarity is not None)
    prints = written(prints.withColumn("row", F.monotonically_increasing_id()), "simhash-fp")
    if similarity is not None:
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "size", "bands")).alias("least")
        firsts = prints.groupBy("fp").agg(least, F.count("*").alias("n")).select("fp", F.col("least.doc_id").alias("first"), "n", "least.size", "least.bands")
    else:
        firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    firsts = written(firsts, "simhash-distinct")
    hot = firsts.join(F.broadcast(firsts.agg((F.sum("n") / 1000).alias("often"))), F.col("n") > F.col("often"))
    near = links(firsts.select("fp"), radius)
    if similarity is not None:
        from estuary.llm import similar

        texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text"))
        near = near.union(similar.similar_links(firsts, texts, similarity)).distinct()
    roots = written(components(near), "simhash-roots")
    placed = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return join_dealt(prints.select("doc_id", "fp", "row"), named, ["fp"], "row", hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
