"""Substring dedup by hashing lines and sentences: one copy of each normalised unit stays, the earliest; the offsets of the rest are kept."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm.common import keyed_texts, slices
from estuary.session import written

LEAST_WORDS = 5
#: Words of a sentence inside a line. Sentences of fewer coincide in unrelated documents.
LEAST_SENTENCE = 8
#: Units with more than one in so many of all repeated occurrences are hot: at most so many units are.
HOT_SHARE = 1000
#: Parts that a hot unit's occurrences are dealt to.
SALTS = 64

#: A sentence of a line with the marks that end it. The parts join to the line.
SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")


def units_of(text: str, least_words: int = LEAST_WORDS, least_sentence: int | None = LEAST_SENTENCE):
    """(start, stop, words) of the units of a text in order, in code points: a line, then the sentences within it.

    Words are in lower case with single spaces. A sentence that is all of its line is no unit of its own; without
    least_sentence there are lines alone.
    """
    at = 0
    for line in text.split("\n"):
        words = line.lower().encode().split()
        if len(words) >= least_words:
            yield at, at + len(line), b" ".join(words)
        if least_sentence and len(words) > least_sentence:
            for m in SENTENCE.finditer(line):
                part = m[0].lower().encode().split()
                if least_sentence <= len(part) < len(words):
                    yield at + m.start(), at + m.end(), b" ".join(part)
        at += len(line) + 1


def units(rows: DataFrame, least_words: int, least_sentence: int | None) -> DataFrame:
    """(row, id, unit, high, low): the units of every text by number, with a 128-bit digest."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("unit", "high", "low"))])

    def split(batches):
        import xxhash

        for whole in batches:
            for batch in slices(whole):
                source, numbers, digests = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    mine = [xxhash.xxh3_128_digest(words) for _, _, words in units_of(text, least_words, least_sentence)]
                    source += [row] * len(mine)
                    numbers += range(len(mine))
                    digests += mine
                pair = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                take = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("id").take(take), pa.array(numbers, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=schema.names)

    return rows.select("row", "id", "text").mapInArrow(split, schema)


def cut_text(text: str, gone: set[int], least_words: int, least_sentence: int | None) -> tuple[str, list[tuple[int, int]]]:
    """The text without the units of these numbers, and the spans taken out; a line goes with its line end."""
    spans: list[tuple[int, int]] = []
    for number, (start, stop, _) in enumerate(units_of(text, least_words, least_sentence)):
        if number in gone and not (spans and start < spans[-1][1]):
            spans.append((start, stop))
    kept, at, k = [], 0, 0
    for line in text.split("\n"):
        end, pieces, begin, whole = at + len(line), [], at, False
        while k < len(spans) and spans[k][1] <= end:
            whole = spans[k] == (at, end)
            pieces.append(text[begin : spans[k][0]])
            begin, k = spans[k][1], k + 1
        if not whole:
            kept.append("".join(pieces) + text[begin:end])
        at = end + 1
    return "\n".join(kept), spans


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_sentence: int | None = LEAST_SENTENCE) -> DataFrame:
    """One row for each document: doc_id, text (what stays), removed (start and stop of what goes) and n_removed.

    A line of least_words or more, or a sentence of least_sentence or more inside a line, goes if an equal unit stands
    earlier: in a document of smaller id, or before it in the same document. Sentences catch passages that stand in
    the middle of different lines; with least_sentence None lines go or stay as wholes. Shorter units always stay.

    Only digests and offsets are grouped: each task sends one row for a digest, then every occurrence joins the first
    place of its digest. Digests that make up over a thousandth of the repeated occurrences, so under a thousand, have
    their occurrences dealt to SALTS parts in that join. Null or empty text: empty, nothing removed. Texts of
    any length are read whole; what is grouped by document is one number for each unit that goes. Rows that repeat an id
    count as separate documents in file order. Null ids come first. Other columns are ignored, whatever their names.
    Empty table: no rows.
    """
    rows = written(keyed_texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "lines-rows")
    found = units(rows, least_words, least_sentence)
    places = found.groupBy("high", "low").agg(F.min(F.struct("id", "row", "unit")).alias("place"), F.count("*").alias("n"))
    first = written(places.where("n > 1").select("high", "low", F.col("place.row").alias("first_row"), F.col("place.unit").alias("first_unit"), "n"), "lines-first")
    often = first.agg((F.sum("n") / HOT_SHARE).alias("often"))
    hot = first.join(F.broadcast(often), F.col("n") > F.col("often")).select("high", "low", F.lit(SALTS).alias("salts"))
    dealt = found.drop("id").join(F.broadcast(hot), ["high", "low"], "left")  # under HOT_SHARE rows
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    parts = first.join(F.broadcast(hot), ["high", "low"], "left").select("high", "low", "first_row", "first_unit", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    again = salted.join(parts, ["high", "low", "salt"]).where("row <> first_row or unit <> first_unit")
    gone = again.groupBy("row").agg(F.collect_list(F.col("unit").cast("int")).alias("gone"))
    marked = rows.join(gone, "row", "left").select(F.col("id").alias("doc_id"), "text", "gone")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([marked.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("removed", span)])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches):
        for whole in batches:
            for batch in slices(whole):
                results = [cut_text(text, set(gone), least_words, least_sentence) if gone else (text, []) for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
                removed = [[{"start": a, "stop": b} for a, b in spans] for _, spans in results]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text for text, _ in results], pa.string()), pa.array(removed, arrow_span)], names=schema.names)

    return marked.mapInArrow(cut, schema).withColumn("n_removed", F.size("removed").cast("long"))


def removal_digest(deduped: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return deduped.select("doc_id", "n_removed", spans.alias("removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
