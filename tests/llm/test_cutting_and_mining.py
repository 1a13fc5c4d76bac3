"""Fill-in-middle, secrets and collocations against plain versions on small fixtures."""

import base64
import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estuary.llm import collocations, fim, secrets
from estuary.llm.offsets import Offsets
from estuary.llm.queries import QUERIES

WIDE = st.text(alphabet="aZ é€\U0001f600\t\n\x0b <PSM>ß́", max_size=60)
TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names could clash."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "wörd €5 " * 30_000), (None, "a b"), (5, " \t\n"), (6, "x" * 120_000), (7, "a <P> b"), (8, "\U0001f600 é token=abcdef"), (9, "p<S" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({"id": F.lit(9), "n": F.lit("r"), "output": F.lit(1.5), "spans": F.lit(None).cast("int"), "phrase": F.lit("q")})


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


@given(WIDE)
@settings(max_examples=200, deadline=None)
def test_offsets_equal_those_of_python(text):
    raw = text.encode()
    index = Offsets(np.frombuffer(raw, np.uint8))
    at = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert len(index) == len(text)
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == at.tolist()
    assert index.to_chars(at).tolist() == list(range(len(text) + 1))


# fill-in-middle


def plain_cut(key, text, seed=42):
    tokens = TOKENS.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.integers(0, 500), WIDE)
@settings(max_examples=300, deadline=None)
def test_cuts_equal_a_plain_version(key, text):
    n, form, prefix, middle, out = fim.rearranged(key, text.encode(), "token", 42, 50, 80)
    assert (n, form, prefix, middle, out.decode()) == plain_cut(key, text)


def test_cuts_between_code_points(spark):
    words = ["é€\U0001f600x" * k for k in range(1, 40)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    rows = fim.fill_in_middle(docs, unit="char", rate=100).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in rows} == {"psm", "spm"}
    for r in rows:
        text = words[r.doc_id]
        h = fim.draws(r.doc_id, 42)
        low, high = sorted(x % (len(text) + 1) for x in h[:2])
        assert (r.n, r.prefix_chars, r.middle_chars, r.back) == (len(text), low, high - low, text)
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="line")


def test_fill_in_middle_of_odd_documents(odd_docs):
    rows = fim.digest(fim.fill_in_middle(odd_docs)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(r.doc_id, *plain_cut(r.doc_id, r.text or "")[:4], sha(plain_cut(r.doc_id, r.text or "")[4]), sha(r.text or "")) for r in odd_docs.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert fim.digest(fim.fill_in_middle(odd_docs.limit(0))).count() == 0


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PLAIN = (ASSIGN, re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def plain_secrets(text):
    long = (lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24)
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(zip(PLAIN, long, strict=True)) for m in p.finditer(text) if good(m))


def based(spans):
    return [s for s in spans if s[1] < len(secrets.BASE)]


PIECES = ["password", "PassWd", "secret", "ſecret", "toKen", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc123", "x", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é", "\n", "ghp_", "eyJ", ".", "-----BEGIN "]


@given(st.lists(st.sampled_from(PIECES), max_size=14))
@settings(max_examples=800, deadline=None)
def test_base_secrets_equal_a_plain_version(pieces):
    text = "".join(pieces)
    assert based(secrets.spans_of(text.encode())) == plain_secrets(text)


def test_base_secrets_of_all_documents(spark, small, texts):
    name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    rows = QUERIES["op12_secret_scan"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_secrets(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(name(want).encode()).hexdigest() and r.spans == name(want)


def base62(n, size):
    out = ""
    for _ in range(size):
        n, d = divmod(n, 62)
        out = chr(secrets._BASE62[d]) + out
    return out


def planted():
    """Tokens whose checks hold, by kind."""
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    forge = [f"{p}{body}{base62(zlib.crc32(body.encode()), 6)}" for p in ("ghp_", "npm_")]
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    n, wallet = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big"), ""
    while n:
        n, d = divmod(n, 58)
        wallet = chr(secrets._BASE58[d]) + wallet
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    web = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'é'})}.c2ln"
    der = b"\x30\x82\x01\x00" + bytes(256)
    lines = "\n".join(re.findall(".{1,64}", base64.b64encode(der).decode()))
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    return {"forge": forge, "wallet": [wallet], "webtoken": [web], "key": [key]}


def test_tokens_with_checks_are_found_and_damaged_ones_left():
    for kind, found in planted().items():
        for s in found:
            text = f"é {s} ü"
            assert [x for x in secrets.spans_of(text.encode()) if x[1] >= 3] == [(2, secrets.KINDS.index(kind), 2 + len(s))]
            assert secrets.redact_text(text) == f"é [{kind.upper()}] ü"
            at = {"webtoken": 5, "key": 40}.get(kind, len(s) - 8)
            damaged = s[:at] + ("B" if s[at] == "A" else "A") + s[at + 1 :] if kind != "key" else s.replace("MIIBA", "MIIBB")
            assert not [x for x in secrets.spans_of(damaged.encode()) if x[1] >= 3]
    assert not [x for x in secrets.spans_of(b"x" + planted()["forge"][0].encode()) if x[1] >= 3]


def test_secrets_of_odd_and_hostile_documents(spark, odd_docs):
    import time

    rows = secrets.digest(secrets.find(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and {r.doc_id: r.spans for r in rows}[8] == "assign:4:16"
    assert secrets.find(odd_docs.limit(0)).count() == 0 and secrets.redact(odd_docs).columns == odd_docs.columns
    assert {r.text for r in secrets.redact(odd_docs).where("doc_id = 2").collect()} == {None}
    for bomb in ("eyJ" * 100_000, "token " * 100_000, "ghp_" * 100_000, "-----BEGIN A " * 50_000, "token" + " " * 500_000, "eyJa.eyJa." * 50_000, "xprv" * 100_000, "secret=" * 100_000):
        began = time.time()
        assert based(secrets.spans_of(bomb.encode())) == plain_secrets(bomb)
        assert time.time() - began < 10


# collocations


def plain_phrases(rows, least, top=2000):
    """rows: (lang, text)."""
    n, f = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    gone = {(p[0], *p[i:j]) for p, a in held.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * a >= 80 * f[(p[0], *p[i:j])]}
    out = []
    for p, a in held.items():
        if p not in gone:
            cuts = [(2_000_000 * a // (f[p[:k]] + f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            out.append((p[0], " ".join(p[1:]), a, f[p[:k]], f[(p[0], *p[k:])], n[p[0]], score))
    rows = []
    for lang in sorted({x[0] for x in out}):
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        rows += [(lang, i, *x[1:]) for i, x in enumerate(mine, 1)]
    return rows


@pytest.fixture(scope="module")
def speech(spark):
    rng = np.random.default_rng(3)
    words = ["a", "b", "C", "dé", "e€", "\U0001f600", "the", "x" * 40, "K"]
    rows = []
    for lang in ("en", None, "und", "f r", ""):
        for _ in range(40):
            picked = rng.choice(words, 60, p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05])
            rows.append((lang, "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!"], p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03]) for w in picked)))
    rows += [("en", None), ("en", ""), (None, "..!\n"), ("long", "one two three four five " * 20_000)]
    return rows


@pytest.mark.parametrize(("least", "at_once", "top"), [(5, 10_000, 2000), (12, 7, 2000), (3, 50, 4)])
def test_collocations_equal_a_plain_version(spark, speech, least, at_once, top):
    docs = spark.createDataFrame(speech, "lang string, text string").withColumns({"n": F.lit("z"), "phrase": F.lit(1), "h": F.lit(None).cast("long")})
    rows = collocations.mine(docs, least=least, at_once=at_once, top=top).collect()
    assert sorted(map(tuple, rows)) == sorted(plain_phrases(speech, least, top))


def test_collocations_of_nothing(spark, speech):
    docs = spark.createDataFrame(speech, "lang string, text string")
    assert collocations.mine(docs.limit(0)).count() == 0 and collocations.mine(docs, least=10**9).count() == 0


def test_texts_are_read_as_often_at_any_number_of_candidates(spark, speech):
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(speech, "lang string, text string").mapInArrow(through, "lang string, text string")
    rows = collocations.mine(docs, least=3, at_once=200).collect()
    assert sorted(map(tuple, rows)) == sorted(plain_phrases(speech, 3)) and len(rows) > 70
    assert read.value <= 4 * len(speech)


def test_phrases_of_one_hash_are_told_apart():
    words = collocations.Words([b"a b a b c a b", b"b c", b"a b"], ["l", "m", "l"])
    for k in (1, 2, 3):
        words.hashes(k)
    words._hashes = [x * np.uint64(0) for x in words._hashes]
    got = collections.Counter()
    for k in (1, 2, 3):
        at, h, n = collocations.spelled(words, k, {})
        for i, phrase, f in zip(at, words.phrases(at, k).to_pylist(), n, strict=True):
            got[words.langs[words.lang[i]], phrase.decode()] += int(f)
    want = collections.Counter()
    for lang, text in (("l", "a b a b c a b"), ("m", "b c"), ("l", "a b")):
        w = text.split()
        want.update((lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == want


@given(st.lists(st.lists(st.integers(0, 3), max_size=5), max_size=6))
@settings(max_examples=100, deadline=None)
def test_buckets_stay_whole(batches):
    buckets, last = [], 0
    for batch in batches:
        buckets.append([last := last + step // 2 for step in batch])
    got = list(collocations.whole_buckets(pa.RecordBatch.from_arrays([pa.array(b, pa.int32())], names=["bucket"]) for b in buckets))
    parts = [[b for x in held for b in x.column("bucket").to_pylist()] for held in got]
    assert [b for part in parts for b in part] == [b for part in buckets for b in part]
    assert all(parts) and all(x[-1] < y[0] for x, y in zip(parts, parts[1:], strict=False))


@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=4), max_size=80), st.lists(st.integers(0, 330), max_size=120))
@settings(max_examples=60, deadline=None)
def test_tries_count_what_they_hold(phrases, words):
    held = sorted({" ".join(f"w{i}" for i in p) for p in phrases})
    trie = collocations.Trie(["l"] * len(held), held)
    text = " ".join(f"w{i}" for i in words)
    want = [sum(words[i : i + len(p.split())] == [int(w[1:]) for w in p.split()] for i in range(len(words))) for p in held]
    assert trie.count(collocations.Words([text.encode()], ["l"])).tolist() == want
    assert trie.count(collocations.Words([text.encode()], ["other"])).tolist() == [0] * len(held)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10**17
    found = spark.createDataFrame([("l", "a b", big, 2), ("l", "a", big, 1), ("l", "b", big + 1, 1)], "lang string, phrase string, f long, words int")
    (row,) = collocations.best_cuts(found).collect()
    assert (row.l, row.r, row.score) == (big, big + 1, 2_000_000 * big // (2 * big + 1))
