"""Secrets: a keyword automaton over each text, anchored patterns at its hits, and checksums that tokens carry."""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estuary.llm.common import keyed_texts, slices
from estuary.llm.offsets import Offsets

#: The base kinds, then those that are checked by what they hold.
KINDS = ("assign", "access", "hex", "forge", "wallet", "webtoken", "key")
BASE = KINDS[:3]
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# Words before a value, and what tokens with checks begin with.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MARKS = {"access": "AKIA", "wallet": "xprv", "webtoken": "eyJ", "key": "-----BEGIN "}
FORGES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")

#: The anchored patterns. All are possessive or of disjoint classes, so a match costs its own length.
_PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "forge": re.compile(rb"(?:gh[oprsu]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "wallet": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
    "webtoken": re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)"),
    "key": re.compile(rb"-----BEGIN ((?:[A-Z]++ )*)PRIVATE KEY-----\s*+([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----"),
}
#: Before these kinds no such character may stand, so that a hit inside a longer run is not tried.
_INSIDE = {"forge": re.compile(rb"[A-Za-z0-9_]"), "wallet": re.compile(rb"[A-Za-z0-9]"), "webtoken": re.compile(rb"[A-Za-z0-9_.-]")}
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def number(digits: bytes, alphabet: bytes) -> int:
    out = 0
    for c in digits:
        out = out * len(alphabet) + alphabet.index(c)
    return out


def forge_holds(m: re.Match) -> bool:
    """The last six of 36 characters are the CRC-32 of those before them, in base 62."""
    return number(m[1][30:], _BASE62) == zlib.crc32(m[1][:30])


def wallet_holds(m: re.Match) -> bool:
    """82 bytes in base 58, the last four of which begin the double SHA-256 of the others."""
    value = number(m[0], _BASE58)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return raw != b"" and hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def webtoken_holds(m: re.Match) -> bool:
    """The first part is the base64url of a JSON object that names an algorithm, the second of a JSON object."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(m[i] + b"=" * (-len(m[i]) % 4))) for i in (1, 2))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def key_holds(m: re.Match) -> bool:
    """The body is base64, and its outer DER sequence is just as long as it says."""
    try:
        raw = base64.b64decode(b"".join(m[2].split()), validate=True)
    except binascii.Error:
        return False
    if m[1] == b"OPENSSH ":
        return raw.startswith(b"openssh-key-v1\0")
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    more = raw[1] & 0x7F if raw[1] & 0x80 else 0
    return len(raw) == 2 + more + (int.from_bytes(raw[2 : 2 + more], "big") if more else raw[1])


_CHECKS = {"forge": forge_holds, "wallet": wallet_holds, "webtoken": webtoken_holds, "key": key_holds}


@functools.lru_cache(maxsize=1)
def automaton():
    """All keywords in lower case, with their kind and length."""
    import ahocorasick

    out = ahocorasick.Automaton()
    words = [(w, "assign") for w in WORDS] + [(w, k) for k, w in MARKS.items()] + [(w, "forge") for w in FORGES]
    for word, kind in words:
        out.add_word(word.lower(), (kind, len(word)))
    out.make_automaton()
    return out


def hits(text: bytes) -> dict[str, list[int]]:
    """Where each kind's keywords begin in the text, in any case, in order."""
    out: dict[str, list[int]] = {}
    # Latin-1 makes a character of each byte, so the automaton's positions are those of bytes
    for end, (kind, size) in automaton().iter(text.lower().decode("latin-1")):
        out.setdefault(kind, []).append(end - size + 1)
    return {kind: sorted(at) for kind, at in out.items()}


def matches(kind: str, text: bytes, starts: list[int]) -> Iterator[re.Match]:
    """Leftmost matches that do not overlap, tried at the keyword hits alone."""
    last, pattern, inside = 0, _PATTERNS[kind], _INSIDE.get(kind)
    for start in starts:
        if start < last or inside and start and inside.match(text, start - 1):
            continue
        if m := pattern.match(text, start):
            last = m.end()
            yield m


def hex_runs(raw: np.ndarray) -> list[tuple[int, int]]:
    """Runs of lower-case hex digits that are long enough. They have no keyword; a table of bytes finds them."""
    edge = np.flatnonzero(np.diff(_HEX[raw], prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= LEAST_HEX
    return list(zip(start[long].tolist(), stop[long].tolist(), strict=True))


def spans_of(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of all secrets of a text in UTF-8, in order, in code points."""
    raw = np.frombuffer(text, np.uint8)
    found = [(a, 2, b) for a, b in hex_runs(raw)]
    for kind, starts in hits(text).items():
        k = KINDS.index(kind)
        for m in matches(kind, text, starts):
            good = len(m[1]) >= LEAST_VALUE if k == 0 else len(m[0]) >= LEAST_ACCESS if k == 1 else _CHECKS[kind](m)
            if good:
                found.append((m.start(), k, m.end()))
    if not found:
        return []
    index = Offsets(raw)
    if not len(index.byte_at):
        return sorted(found)
    start, kinds, stop = np.array(sorted(found)).T
    return list(zip(index.to_chars(start).tolist(), kinds.tolist(), index.to_chars(stop).tolist(), strict=True))


SPAN = [("kind", T.StringType(), pa.string()), ("start", T.LongType(), pa.int64()), ("stop", T.LongType(), pa.int64()), ("base", T.BooleanType(), pa.bool_())]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, stop, base) in code points, by start and then kind.

    Base spans are those of the fixed rules: a named value, an access key, a run of hex digits. The others are tokens
    whose own checksum or structure holds: forge and package tokens (CRC-32), extended private keys (double SHA-256),
    web tokens (JSON) and private keys (lengths of DER); they may lie inside a base span. Null or empty text: no
    spans. Repeated rows come back once each, a null id stays null. Texts of any length are scanned whole, in time
    linear in their length. Other columns are ignored, whatever their names. Empty table: no rows.
    """
    source = keyed_texts(docs, id_col, text_col)
    spans = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind, _ in SPAN]))
    schema = T.StructType([T.StructField("doc_id", source.schema["id"].dataType), T.StructField("spans", spans)])
    inner = pa.struct([(name, kind) for name, _, kind in SPAN])

    def scan(batches):
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                each = [spans_of(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                rows = [[(KINDS[k], a, b, k < len(BASE)) for a, k, b in found] for found in each]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(inner))], names=schema.names)

    return source.mapInArrow(scan, schema)


def digest(found: DataFrame) -> DataFrame:
    """Rows of find() as counts of base spans by kind, the SHA-256 of these, and all spans as kind:start:stop."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = named(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def redact_text(text: str) -> str:
    """Text with every run of overlapping secrets replaced by the kind of the first, in brackets."""
    out, last = [], 0
    for start, kind, stop in spans_of(text.encode()):
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, stop)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets in the text replaced. Null and empty texts stay as they are."""
    at = docs.columns.index(text_col)

    def cleaned(batches):
        for whole in batches:
            for batch in slices(whole, text_col, 16 << 20):
                texts = [None if x is None else redact_text(x) for x in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(cleaned, docs.schema)
