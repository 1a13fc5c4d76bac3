"""Quality rules: fixed rules on repeated and short texts, and boosted trees over document statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm import gbt
from estuary.llm.common import BLANKS, hash_sample, keyed_texts, slices

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LABELS = 4000
FALSE_REJECTS = 0.001

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "exclaim_per_word", "pipes_per_word", "distinct_share", "sentence_words", "short_word_share")
#: 1: the score of being bad may only rise with the feature.
MONOTONE = {"symbols_per_word": 1, "dup_line_share": 1, "repeat_share": 1}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which stands twice or more in the text."""
    import xxhash

    m = len(words) - window + 1
    if m < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(m, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(mixed, twice))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts and the features of a text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x and x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    letters = np.frombuffer(raw, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    per = 1 / max(n, 1)
    sizes = np.fromiter(map(len, words), np.int64, n)
    features = [np.log1p(n), word_chars * per, symbols * per, dup_lines / max(len(lines), 1), repeat * per, upper / max(word_chars, 1), digits / max(word_chars, 1), raw.count(b"!") * per, raw.count(b"|") * per, len(set(words)) * per, n / (1 + raw.count(b".")), float((sizes <= 2).sum()) * per]
    return [n, word_chars, symbols, dup_lines, repeat], features


@dataclass
class Model:
    trees: gbt.Trees
    threshold: float


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, features: bool = False) -> DataFrame:
    """doc_id, the counts, the model's score of being bad, and on demand the features.

    Null text: none of anything. Without a model the score is null.
    """
    source = keyed_texts(docs, id_col, text_col)
    fields = [T.StructField("doc_id", source.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("bad_score", T.DoubleType())]
    fields += [T.StructField("features", T.ArrayType(T.DoubleType()))] if features else []

    def measure(batches):
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                rows = [statistics(x) for x in batch.column("text").to_pylist()]
                counts = np.array([r[0] for r in rows], np.int64)
                x = np.array([r[1] for r in rows])
                score = pa.array(model.trees.probability(x)) if model else pa.nulls(len(rows), pa.float64())
                columns = [batch.column("id"), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), score]
                columns += [pa.array(x.tolist(), pa.list_(pa.float64()))] if features else []
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(measure, T.StructType(fields))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS, false_rejects: float = FALSE_REJECTS) -> Model | None:
    """Trees fitted to at most max_labels labelled documents (quality 1 good, 0 bad).

    Three quarters train them; the rest sets the threshold so that at most false_rejects of the good ones there are
    rejected. Documents that fail the base rules are left out, as the trees do not decide on them. None if a class has
    under ten rows. A document with both labels counts as bad; labels without a document are ignored.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("q")).where("id is not null and q in (0, 1)").groupBy("id").agg(F.min("q").alias("q"))
    chosen = F.broadcast(hash_sample(known, "id", max_labels))  # max_labels rows bound its size
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = document_statistics(mine, "id", "text", features=True).where(~base_failed()).join(chosen, F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min(F.struct("features", "q")).alias("r")).select("doc_id", "r.*").limit(max_labels).collect()
    rows.sort(key=lambda r: r.doc_id)
    x, bad = np.array([r.features for r in rows]), np.array([1 - r.q for r in rows])
    if len(rows) < 20 or min(bad.sum(), len(bad) - bad.sum()) < 10:
        return None
    held = gbt.split_rows(np.array([zlib.crc32(str(r.doc_id).encode()) for r in rows]))
    trees = gbt.train(x[~held], bad[~held], monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})
    return Model(trees, gbt.safe_threshold(trees.probability(x[held]), bad[held], false_rejects))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row for each document: counts, base_failed, bad_score and kept.

    Texts of any length are read whole; other columns are ignored, whatever their names; empty table: no rows.
    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT percent of them in repeated windows. kept: not
    base_failed, and the trees' score is at most the threshold. Null and empty texts have no words and fail.
    Repeated rows are judged once each. Without usable labels only the base rules count.
    """
    model = fit(docs, labels, id_col, text_col, **limits)
    out = document_statistics(docs, id_col, text_col, model)
    good = F.coalesce(F.col("bad_score") <= F.lit(model.threshold if model else 1.0), F.lit(True))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & good)
