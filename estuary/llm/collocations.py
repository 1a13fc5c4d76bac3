"""Collocations: frequent phrases of two to four words, counted exactly in four scans, and their best splits.

Each search level hashes the phrases whose two halves of one word less may be frequent. The hashes' counts are never
under those of the phrases, and a bit filter of fixed size carries the frequent ones to the next level, so no frequent
phrase is lost. A last scan spells the words and the phrases that pass the filters and adds them up by their letters,
so counts are exact, and the number of scans does not depend on that of the phrases.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estuary.llm.common import join_dealt, slices
from estuary.session import written

LONGEST = 4
LEAST_COUNT = 30
TOP = 2000
SCALE = 2_000_000
#: A phrase goes if a longer one around it has so many percent of its occurrences.
ABSORBED = 80
UNKNOWN = "und"
#: Bits of a level's filter: 8 MB.
FILTER_BITS = 26
#: Phrases that a task sends on at a time, or that a trie holds.
PHRASES_AT_ONCE = 250_000
#: Phrases are added up in so many buckets, by the first bits of their hash; a search level sends 32 bits more of it.
BUCKET_BITS = 12
REST_BITS = 64 - BUCKET_BITS - 32
#: Bytes of text that a task takes at a time.
BLOCK = 6 << 20
#: Parts of a language that are ranked by themselves before their first rows meet.
RANKED_APART = 256

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: 0 for bytes of words, 1 for blanks, 2 for those that end a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts one after another: a number for each different word, its piece, language and text."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = b"\n".join(texts).lower()  # a line end ends a piece, so no phrase spans two texts
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        ends = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
        letters = np.ascontiguousarray(raw[kind == 0])
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        self.distinct = words.dictionary
        self.word = words.indices.to_numpy()
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        self.langs = sorted(set(langs))
        code = {lang: i for i, lang in enumerate(self.langs)}
        held = np.diff(np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in texts])))  # words of each text
        self.lang = np.repeat(np.array([code[x] for x in langs], np.int32), held)
        self._hashes: list[np.ndarray] = []

    def together(self, k: int) -> np.ndarray:
        """Whether the k words from each position on stand in one piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def hashes(self, k: int) -> np.ndarray:
        """64 bits of the language and the k words from each position on."""
        import xxhash

        if not self._hashes:
            own = b"".join(map(xxhash.xxh64_digest, self.distinct.to_numpy(zero_copy_only=False)))
            self._own = np.frombuffer(own, ">u8").astype(np.uint64)[self.word]
            roots = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs], np.uint64)
            self._hashes.append(mixed(roots[self.lang] * _MIX[2] + self._own))
        while len(self._hashes) < k:
            n = max(0, len(self._own) - len(self._hashes))
            self._hashes.append(mixed(self._hashes[-1][:n] * _MIX[2] + self._own[len(self._hashes) :]))
        return self._hashes[k - 1]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each of the positions on, with spaces between them."""
        parts = [self.distinct.take(pa.array(self.word[at + i])) for i in range(k)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))


def read_words(batches):
    """Words of the batches' texts, in blocks of bounded size; a longer text is a block of its own."""
    for whole in batches:
        for batch in slices(whole, limit=BLOCK):
            yield Words(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist())


_MASK = (1 << FILTER_BITS) - 1


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits at the places of these hashes are set."""
    at = h >> np.uint64(REST_BITS) & np.uint64(_MASK)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def hopeful(words: Words, k: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases of k words whose first and last k - 1 words pass the filter."""
    ok = words.together(k)
    if bits is not None:
        part = passes(bits, words.hashes(k - 1))
        ok = ok & part[: len(ok)] & part[1 : len(ok) + 1]
    at = np.flatnonzero(ok)
    return at, words.hashes(k)[at]


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for the items from each cut to the next."""
    ends = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind) -> np.ndarray:
    """The items of all binary values one after another."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(kind)


def lengths(column: pa.Array) -> np.ndarray:
    """The numbers of items in the binary values, of four bytes each."""
    return pc.binary_length(column).to_numpy() // 4


def buckets_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def whole_buckets(batches):
    """Lists of batches that hold whole buckets, of batches in order of their buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if held and (cut or held[-1].column("bucket")[0].as_py() != bucket[-1]):
                yield [*held, batch.slice(0, cut)] if cut else held
                held = []
            elif cut:
                yield [batch.slice(0, cut)]
            held.append(batch.slice(cut))
    if held:
        yield held


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a bucket come together, in any number of partitions, and a task holds some buckets at a time."""
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def frequent_hashes(texts: DataFrame, k: int, bits, least: int, at_once: int) -> DataFrame:
    """(h): hashes, without their last bits, of phrases of k words with the least count or more.

    Each block sends its different hashes and their counts, packed by bucket.
    """

    def count(batches):
        for words in read_words(batches):
            h = np.sort(hopeful(words, k, bits and bits.value)[1])
            first = runs(h)
            h, n = h[first], np.diff(np.append(first, len(h))).astype(np.uint32)
            for at in range(0, len(h), at_once):
                mine = h[at : at + at_once]
                bucket = buckets_of(mine)
                cuts = np.append(runs(bucket), len(mine))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), packed((mine >> np.uint64(REST_BITS)).astype(np.uint32), cuts), packed(n[at : at + at_once], cuts)], names=["bucket", "hashes", "counts"])

    def add(batches):
        for held in whole_buckets(batches):
            bucket = np.concatenate([np.repeat(x.column("bucket").to_numpy(), lengths(x.column("hashes"))) for x in held]).astype(np.uint64)
            h = bucket << np.uint64(64 - BUCKET_BITS) | np.concatenate([unpacked(x.column("hashes"), np.uint32) for x in held]).astype(np.uint64) << np.uint64(REST_BITS)
            n = np.concatenate([unpacked(x.column("counts"), np.uint32) for x in held]).astype(np.int64)
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = runs(h)
            yield pa.RecordBatch.from_arrays([pa.array(h[first][np.add.reduceat(n, first) >= least].view(np.int64))], names=["h"])

    return dealt(texts.mapInArrow(count, "bucket int, hashes binary, counts binary")).mapInArrow(add, "h long")


def filter_of(keys: DataFrame):
    """A broadcast bit filter of the hashes (h). It has 8 MB at any number of them, and so has what the driver collects."""
    at = F.shiftrightunsigned("h", REST_BITS).bitwiseAND(F.lit(_MASK))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    found = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("line")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[found["line"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def spelled(words: Words, k: int, filters: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, counts) of the different phrases of k words, a position each, without those that a filter stops.

    Phrases are told apart by their words: of two with one hash, either may come more than once.
    """
    if k == 1:
        of = words.lang.astype(np.int64) * len(words.distinct) + words.word
        n, at = np.bincount(of), np.zeros(of.max(initial=-1) + 1, np.int64)
        at[of] = np.arange(len(of))
        at, n = at[n > 0], n[n > 0]
        order = np.argsort(words.hashes(1)[at])
        return at[order], words.hashes(1)[at[order]], n[order]
    at, h = hopeful(words, k, filters[k - 1].value if k - 1 in filters else None)
    if k in filters:
        ok = passes(filters[k].value, h)
        at, h = at[ok], h[ok]
    order = np.argsort(h)
    at, h = at[order], h[order]
    first = runs(h, words.lang[at], *(words.word[at + i] for i in range(k)))
    return at[first], h[first], np.diff(np.append(first, len(h)))


def sent(tables: list[pa.Table], langs: list[str], at_once: int):
    """Phrases (lang, phrase, words, h, n) with the counts of equal ones added up, packed by language and bucket."""
    sums = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("words", "min"), ("h", "min"), ("n", "sum")])
    lang, words, h, n = (sums[x].to_numpy() for x in ("lang", "words_min", "h_min", "n_sum"))
    order = np.lexsort((h, lang))
    for start in range(0, len(order), at_once):
        i = order[start : start + at_once]
        phrase = sums["phrase"].combine_chunks().take(pa.array(i))
        ends = np.frombuffer(phrase.buffers()[1], np.int64)[: len(i) + 1]
        bucket = buckets_of(h[i])
        cuts = np.append(runs(lang[i], bucket), len(i))
        total = np.add.reduceat(np.where(words[i] == 1, n[i], 0), cuts[:-1])
        letters = packed(np.frombuffer(phrase.buffers()[2], np.uint8)[: ends[-1]], ends[cuts])
        columns = [pa.array(bucket[cuts[:-1]]), pa.array(langs, pa.string()).take(pa.array(lang[i][cuts[:-1]])), pa.array(total), letters]
        columns += [packed(np.diff(ends).astype(np.int32), cuts), packed(n[i].astype(np.uint32), cuts)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "total", "letters", "sizes", "counts"])


def frequent_phrases(texts: DataFrame, filters: dict, least: int, at_once: int) -> DataFrame:
    """(lang, phrase, f): phrases with the least count or more, counted exactly; with phrase null, parts of a language's words.

    A task sends its words and the phrases that pass their level's filter, with their counts, packed by language and
    bucket; it adds up some blocks before, until they have four times at_once. A bucket adds up the counts of equal phrases.
    """

    def count(batches):
        codes: dict[str, int] = {}
        held, size = [], 0
        for words in read_words(batches):
            code = np.array([codes.setdefault(x, len(codes)) for x in words.langs], np.int32)
            for k in range(1, LONGEST + 1):
                at, h, n = spelled(words, k, filters)
                phrase = words.phrases(at, k).cast(pa.large_binary())
                held.append(pa.table({"lang": code[words.lang[at]], "phrase": phrase, "words": np.full(len(at), k, np.int32), "h": h, "n": n}))
                size += len(at)
            if size >= 4 * at_once:
                yield from sent(held, [*codes], at_once)
                held, size = [], 0
        if held:
            yield from sent(held, [*codes], at_once)

    def add(batches):
        for held in whole_buckets(batches):
            ends = np.concatenate(([0], np.cumsum(np.concatenate([unpacked(x.column("sizes"), np.int32) for x in held])))).astype(np.int64)
            letters = np.concatenate([unpacked(x.column("letters"), np.uint8) for x in held])
            phrase = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
            n = np.concatenate([unpacked(x.column("counts"), np.uint32) for x in held]).astype(np.int64)
            names = pa.concat_arrays([x.column("lang") for x in held]).dictionary_encode()
            code, total = names.indices.to_numpy(), np.concatenate([x.column("total").to_numpy() for x in held])
            lang = np.repeat(code, np.concatenate([lengths(x.column("sizes")) for x in held]))
            sums = pa.table({"lang": lang, "phrase": phrase, "f": n}).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
            lang, phrase, f = (x.combine_chunks() for x in sums.filter(pc.greater_equal(sums["f_sum"], least)).select(["lang", "phrase", "f_sum"]).columns)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(lang), phrase.cast(pa.binary()).cast(pa.string()), f], names=["lang", "phrase", "f"])
            each = np.zeros(len(names.dictionary), np.int64)
            np.add.at(each, code, total)
            yield pa.RecordBatch.from_arrays([names.dictionary, pa.nulls(len(each), pa.string()), pa.array(each)], names=["lang", "phrase", "f"])

    rows = texts.mapInArrow(count, "bucket int, lang string, total long, letters binary, sizes binary, counts binary")
    return dealt(rows).mapInArrow(add, "lang string, phrase string, f long")


class Trie:
    """A double-array trie of phrases: base and check, a root for each language, and the number of the phrase at a node.

    A word's number is spelled in digits of base 16, so that a node has 16 children at most: nodes with five or more
    take 16 places of their own, the others are put where places are free, all in a few rounds over arrays.
    """

    def __init__(self, langs: list[str], phrases: list[str]):
        lines = [p.encode().split(b" ") for p in phrases]
        self.langs, self.words = sorted(set(langs)), sorted({w for line in lines for w in line})
        number, root = {w: i for i, w in enumerate(self.words)}, {x: i for i, x in enumerate(self.langs)}
        self.digits = max(1, -(-(max(1, len(self.words) - 1)).bit_length() // 4))
        ids = np.full((len(lines), LONGEST), -1, np.int64)
        for i, line in enumerate(lines):
            ids[i, : len(line)] = [number[w] for w in line]
        length = self.digits * (ids >= 0).sum(1)
        node = np.array([root[x] for x in langs], np.int64)
        nodes, parents, labels = len(self.langs), [], []
        for t in range(int(length.max(initial=0))):
            alive = np.flatnonzero(length > t)
            digit = self.digit(ids[alive, t // self.digits], t % self.digits)
            key, inverse = np.unique(node[alive] * 16 + digit, return_inverse=True)
            parents.append(key // 16)
            labels.append(key % 16)
            node[alive] = nodes + inverse
            nodes += len(key)
        self.place(nodes, np.concatenate(parents or [[]]).astype(np.int64), np.concatenate(labels or [[]]).astype(np.int64))
        self.accept = np.full(len(self.base), -1, np.int32)
        self.accept[self.slot[node]] = np.arange(len(phrases))
        self.size = len(phrases)
        del self.slot

    def digit(self, ids: np.ndarray, place: int) -> np.ndarray:
        return (ids >> 4 * (self.digits - 1 - place)) & 15

    def place(self, nodes: int, parent: np.ndarray, label: np.ndarray) -> None:
        """base, check and slot of nodes from edges in order of their children, which follow the roots."""
        order = np.argsort(parent, kind="stable")
        p, d = parent[order], label[order]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        count = np.diff(np.append(first, len(p)))
        wide = count >= 5
        size = 1 << int(2 * len(p) + 16 * wide.sum() + 64).bit_length()
        base, used = np.zeros(len(first), np.int64), np.zeros(size, bool)
        base[wide] = 16 * np.arange(wide.sum())
        group = np.repeat(np.arange(len(first)), count)
        used[(base[group] + d)[wide[group]]] = True
        left, owner, rng = np.flatnonzero(~wide), np.empty(size, np.int64), np.random.default_rng(0)
        while len(left):
            base[left] = rng.integers(0, size - 16, len(left))
            mine = np.flatnonzero(np.isin(group, left, assume_unique=False)) if len(left) < len(first) // 4 else np.flatnonzero(np.bincount(left, minlength=len(first))[group] > 0)
            at = base[group[mine]] + d[mine]
            owner[at] = group[mine]
            good = ~used[at] & (owner[at] == group[mine])
            starts = np.flatnonzero(np.diff(group[mine], prepend=-1))
            placed = np.logical_and.reduceat(good, starts)
            used[at[np.repeat(placed, np.diff(np.append(starts, len(mine))))]] = True
            left = group[mine][starts][~placed]
        roots = nodes - len(p)
        slot = np.empty(nodes, np.int64)
        slot[:roots] = size + np.arange(roots)
        slot[roots + order] = base[group] + d
        self.base, self.check = np.zeros(size + roots, np.int32), np.full(size + roots, -1, np.int32)
        self.base[slot[p[first]]] = base
        self.check[slot[roots + order]] = slot[p]
        self.slot, self.roots = slot, slot[:roots].astype(np.int32)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of those that go on, their states) after a word, digit by digit, all states at once."""
        alive = np.flatnonzero(word >= 0)
        state, word = state[alive], word[alive]
        for place in range(self.digits):
            onward = self.base[state] + self.digit(word, place).astype(np.int32)
            held = self.check[onward] == state
            alive, state, word = alive[held], onward[held], word[held]
        return alive, state

    def count(self, words: Words) -> np.ndarray:
        """How often each phrase stands in the texts."""
        known = pa.array(self.words, pa.binary())
        number = pc.fill_null(pc.index_in(words.distinct, known), -1).to_numpy().astype(np.int64)
        lang = np.array([self.langs.index(x) if x in self.langs else -1 for x in words.langs], np.int64)
        out = np.zeros(self.size, np.int64)
        if not len(words.word) or not self.size:
            return out
        word = number[words.word]
        at = np.flatnonzero(lang[words.lang] >= 0)
        state = self.roots[lang[words.lang[at]]]
        for k in range(LONGEST):
            here = at + k
            inside = np.flatnonzero((here < len(word)) & (words.piece[np.minimum(here, len(word) - 1)] == words.piece[at]))
            at, state = at[inside], state[inside]
            alive, state = self.step(state, word[at + k])
            at = at[alive]
            found = self.accept[state]
            out += np.bincount(found[found >= 0], minlength=self.size)
        return out


def counted(texts: DataFrame, phrases: DataFrame, at_once: int) -> DataFrame:
    """(lang, phrase, f) of phrases that are given (lang, phrase): a trie and a scan of the texts for each part of bounded size.

    It suits a list of some 100,000 phrases; mine() counts by buckets, as its phrases grow with the texts.
    """
    spark = texts.sparkSession
    total = phrases.count()
    parts = max(1, -(-total // at_once))
    dealt = phrases.withColumns({"part": F.pmod(F.xxhash64("lang", "phrase"), F.lit(parts)), "id": F.monotonically_increasing_id()})
    dealt = written(dealt, "phrases")
    sums = []
    for part in range(parts):
        mine = dealt.where(F.col("part") == part).select("id", "lang", "phrase").toArrow()
        ids = spark.sparkContext.broadcast((Trie(mine["lang"].to_pylist(), mine["phrase"].to_pylist()), mine["id"].to_numpy()))

        def count(batches, ids=ids):
            trie, own = ids.value
            total = np.zeros(len(own), np.int64)
            for words in read_words(batches):
                total += trie.count(words)
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own[met]), pa.array(total[met])], names=["id", "f"])

        shards = texts.mapInArrow(count, "id long, f long")
        sums.append(written(shards.groupBy("id").agg(F.sum("f").alias("f")), "phrase-counts"))
        ids.unpersist()
    return dealt.join(functools.reduce(DataFrame.union, sums), "id").select("lang", "phrase", "f")


def parts_of(phrase: str, first: str, size: str) -> str:
    """SQL of the words of a phrase from `first` (0 is the first one), `size` of them."""
    return f"substring_index(substring_index({phrase}, ' ', {first} + {size}), ' ', -({size}))"


def best_cuts(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more: the cut with the lowest score, then the first."""
    rows = found.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.expr("explode(sequence(1, words - 1)) AS k"))
    sides = F.expr(f"array(struct(true AS head, {parts_of('phrase', '0', 'k')} AS part), struct(false AS head, {parts_of('phrase', 'k', '(words - k)')} AS part))")
    rows = rows.select("lang", "phrase", "a", "k", F.inline(sides))
    # a word may begin or end a large share of all phrases, so its rows are dealt
    rows = join_dealt(rows, found.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"], "phrase")
    counts = [F.max(F.when((F.col("k") == k) & (F.col("head") == head), F.col("f"))).alias(f"{name}{k}") for k in range(1, LONGEST) for name, head in (("l", True), ("r", False))]
    score = "(CAST({scale} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{k} AS DECIMAL(20,0)))"
    cuts = ", ".join(f"struct({score.format(scale=SCALE, k=k)} AS score, {k} AS k, l{k} AS l, r{k} AS r)" for k in range(1, LONGEST))
    cut = F.expr(f"array_min(filter(array({cuts}), x -> x.score IS NOT NULL))")
    return rows.groupBy("lang", "phrase", "a").agg(*counts).withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def absorbed(found: DataFrame) -> DataFrame:
    """(lang, phrase) of phrases inside a longer one that has ABSORBED percent of their occurrences or more."""
    inner = F.expr("""flatten(transform(sequence(2, words - 1), size ->
        transform(sequence(0, words - size), first -> struct(first, size))))""")
    rows = found.where("words > 2").select("lang", "phrase", "f", F.explode(inner).alias("i"))
    rows = rows.select("lang", F.expr(parts_of("phrase", "i.first", "i.size")).alias("phrase"), "f")
    largest = rows.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    big = lambda factor, c: f"{factor} * CAST({c} AS DECIMAL(30,0))"
    return found.join(largest, ["lang", "phrase"]).where(f"{big(100, 'longer')} >= {big(ABSORBED, 'f')}").select("lang", "phrase")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, top: int = TOP,
    at_once: int = PHRASES_AT_ONCE,
) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), split to pieces at marks and line ends and these to words at blanks. A phrase of
    two to four words that stands `least` times in pieces is cut where 2,000,000 a / (l + r) is lowest, with a its
    count and l and r those of its two parts; n counts the language's words. Phrases that mostly stand in a longer one
    go. A null text is empty, a null language `und`; documents need no id, and repeated rows count each time. A text is
    read whole; one that is longer than BLOCK is a block of its own. Other columns are ignored, whatever their names.
    Empty table: no rows. Equal scores rank by a, then by the phrase's bytes.

    The driver and the tasks hold filters of 8 MB. A task sends on `at_once` phrases at a time and adds up whole
    buckets, a 4,096th of all phrases each.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    filters = {}
    for k in range(2, LONGEST + 1):
        filters[k] = filter_of(frequent_hashes(texts, k, filters.get(k - 1), least, at_once))
    names = written(frequent_phrases(texts, filters, least, at_once), "phrases-found")
    found = names.where("phrase is not null").withColumn("words", F.size(F.split("phrase", " ")))
    kept = best_cuts(found).join(absorbed(found), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    apart = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(apart)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    sizes = names.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
