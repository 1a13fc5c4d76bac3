"""Fill-in-middle: documents cut in three and reordered, so that a model learns to write the middle."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm.common import BLANKS, keyed_texts, slices
from estuary.llm.offsets import Offsets

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of 100 documents, how many are reordered, and of 100 of these, how many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80

_BLANK = np.isin(np.arange(256), [ord(c) for c in BLANKS])


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Byte positions where tokens end: blanks with the word after them are one, blanks at the end are one of their own."""
    if not len(raw):
        return np.empty(0, np.int64)
    blank = _BLANK[raw]
    return np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(raw))


def draws(key: object, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the document's id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearranged(key: object, text: bytes, unit: str, seed: int, rate: int, suffix_first: int):
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    raw = np.frombuffer(text, np.uint8)
    index = Offsets(raw)
    ends = token_ends(raw) if unit == "token" else None
    n = len(index) if ends is None else len(ends)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if ends is None:
        a, b = int(index.to_bytes(low)), int(index.to_bytes(high))
    else:
        a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
        low, high = int(index.to_chars(a)), int(index.to_chars(b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", low, high - low, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token", seed: int = SEED,
    rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row for each row: doc_id, n (units of the text), form, prefix_chars, middle_chars and output.

    A text is cut at two of its units, tokens or code points ("char"), that its id draws. Cuts between tokens are
    found in bytes and told in code points, cuts between code points the other way round, by Offsets. form is psm
    (prefix, suffix, middle), spm (suffix, prefix, middle) or plain, where lengths are null and output is the text:
    `rate` of 100 documents are reordered, and none that is empty or holds a mark. Null text: empty, plain. Null ids
    draw as an empty id, repeated rows draw alike. Texts of any length are cut whole, in linear time. Other columns
    are ignored, whatever their names. Empty table: no rows.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"no such unit: {unit}")
    source = keyed_texts(docs, id_col, text_col)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [source.schema["id"].dataType, T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, limit=8 << 20):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                keys = batch.column("id").to_pylist()
                rows = [rearranged(k, x, unit, seed, rate, suffix_first) for k, x in zip(keys, texts, strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    return source.mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Each mark stands in it once, as texts with marks are plain."""
    parts = F.split(output, "|".join(m.decode() for m in (PREFIX, SUFFIX, MIDDLE)), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    psm, spm = F.concat(piece(1), piece(3), piece(2)), F.concat(piece(2), piece(3), piece(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    """Rows of fill_in_middle() with SHA-256 of the output and of the text restored from it, in place of the output."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    back = hashed(restored(F.col("output"), F.col("form")))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        hashed(F.col("output")).alias("output_sha256"), back.alias("restored_sha256"),
    )
