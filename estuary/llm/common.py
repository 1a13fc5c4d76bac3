"""Shared helpers of the training-data operators."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that end a word: space and U+0009 to U+000D. bytes.split() splits at just these.
BLANKS = " \t\n\x0b\x0c\r"

VOCABULARY = "byte_bpe_50k"
END_OF_TEXT = "<|endoftext|>"


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, a null text as an empty one, under names that cannot clash."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str | None = None):
    """The byte-level BPE as a tiktoken encoding, loaded once a Python worker.

    The rank file holds the same vocabulary as byte_bpe_50k.json; tests/llm compare the ids of both libraries over
    all code points. It is four times as fast as the other library, and time here is nearly all encoding.
    """
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path(f"{VOCABULARY}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Parts of a batch with about limit bytes of text each (one row at least), so that memory stays bounded."""
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        total += n or 0
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def hash_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most limit rows, the same ones at any partitioning: those whose key has the smallest hash, then the smallest.

    Select few columns first: each task sends its own smallest rows.
    """
    return df.orderBy(F.xxhash64(key), key, *(c for c in df.columns if c != key)).limit(limit)


def hot_keys(rows: DataFrame, on: list[str], share: int = 1000, least: int = 1) -> DataFrame:
    """The keys with more than one in so many of all rows, and `least` rows: fewer than `share` of them, at any size."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    often = counts.agg((F.sum("n") / share).alias("often"))
    return counts.join(F.broadcast(often), (F.col("n") > F.col("often")) & (F.col("n") >= least)).select(*on)


def join_dealt(many: DataFrame, few: DataFrame, on: list[str], by: str, hot: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """Inner join where a key may have a large share of the first side's rows.

    The rows of such hot keys (given, or found by hot_keys) are dealt to `parts` parts by the hash of the column `by`,
    and the second side's rows of these keys, few by assumption, are repeated for each part.
    """
    hot = F.broadcast((hot_keys(many, on) if hot is None else hot).select(*on, F.lit(parts).alias("_parts")))
    count = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), count).cast("int")).drop("_parts")
    spread = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), count - 1))).drop("_parts")
    return dealt.join(spread, [*on, "_part"]).drop("_part")
