"""Packing by power-of-two decomposition: documents are cut into pieces of binary lengths and equal lengths share a bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm.common import encoding, keyed_texts, slices
from estuary.session import scratch

LONGEST = 2048
END_ID = 1


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as full pieces and then the set bits of the rest, the largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """Pieces of every document, each a sequence of its own whose length is a power of two.

    A document is its token ids and end_id. No sequence crosses documents and none needs padding; pieces of one
    length form a bucket, so a batch from a bucket is a full rectangle. Returns doc_id, start, length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset (always 0); the sequence ids of a bucket lie
    together, those of shorter lengths first. There is no shuffle: each task encodes its own rows, a few MB at a time.

    Null or empty text: the single piece [end_id]. A text of any length is encoded whole. Repeated rows are packed once
    each. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    source = keyed_texts(docs, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )

    def cut(batches):
        encode = encoding(ranks_path).encode_to_numpy
        for whole in batches:
            for batch in slices(whole):
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    tokens = np.append(encode(text, allowed_special="all"), end_id).astype("<u4").tobytes()
                    n, start = len(tokens) // 4, 0
                    for length in piece_lengths(n, longest):
                        rows.append(row)
                        starts.append(start)
                        lengths.append(length)
                        totals.append(n)
                        ids.append(tokens[4 * start : 4 * (start + length)])
                        start += length
                columns = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = source.mapInArrow(cut, schema)
    bucket = F.bit_count(F.col("length") - 1).cast("long")  # the length's exponent, 62 at most with the row number
    return pieces.withColumn("sequence_id", F.shiftleft(bucket, 58) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """One folder for each length, ready to be read as rectangles; returns the pieces read from there. Nothing is shuffled."""
    pieces.write.partitionBy("length").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path).select(pieces.columns)


def bucketed(docs: DataFrame, **options) -> DataFrame:
    """pack() with the pieces of each length in a bucket of their own, under a new path in the shared folder."""
    return write_buckets(pack(docs, **options), scratch(docs.sparkSession, "packing-buckets"))


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
