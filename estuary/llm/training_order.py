"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot; range partitions write fixed-stride shards."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from estuary.llm.common import encoding, keyed_texts, slices
from estuary.session import scratch, written

LENGTH = 1024
SHARD_RECORDS = 8192
KEY = 0x5EED
ROUNDS = 6
END_ID = 50256
END = np.array([END_ID], "<u2")
#: Token ids in a group, and bytes of ids that make the dictionary sequences are compressed with on their way.
GROUP_IDS, DICTIONARY = 1 << 20, 110_000
#: After each record stand two zero bytes: the row separator of Spark's text writer. A record takes 2 * length + 2 bytes.
SEPARATOR = "\x00\x00"
#: Row groups of the table of ids: a reader holds one at a time, and large reads stay in a JVM's buffers for good.
SMALL_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}


def stride(length: int) -> int:
    return 2 * length + len(SEPARATOR)


def _round_value(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked along its cycle until it is back below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index, np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> shift, out[todo] & mask
        for turn in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round_value(left, key, turn, mask), left
            else:
                left, right = right, left ^ _round_value(right, key, turn, mask)
        out[todo] = left << shift | right
        todo = out >= n
    return out.astype(np.int64)


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, file, at): the texts with their file and row number where docs is read from files that tell them, else with neither."""
    source = keyed_texts(docs, id_col, text_col)
    try:
        place = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        place.schema  # noqa: B018 - analysis fails here where there are no files
    except AnalysisException:
        return source.select("*", F.lit("").alias("file"), F.lit(-1).cast("long").alias("at"))
    texts = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(id_col).alias("id"), texts, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def token_groups(docs: DataFrame, length: int, ranks_path: str | None) -> DataFrame:
    """The token ids of all documents, END_ID after each, in groups of about GROUP_IDS ids.

    A chunk is a run of rows of one file in order; a group tells its chunk, the ids before it there, and where the
    chunk's first row stands (file, at). docs: id, text, file, at. blob holds the ids, little-endian unsigned 16-bit,
    compressed; head and tail hold the first and last `length` of them as they are.
    """
    id_type = docs.schema["id"].dataType
    fields = [("chunk", T.LongType()), ("file", T.StringType()), ("at", T.LongType()), ("before", T.LongType()), ("n", T.LongType()), ("doc_ids", T.ArrayType(id_type)), ("counts", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*f) for f in fields] + [T.StructField(c, T.BinaryType()) for c in ("blob", "head", "tail")])

    def encode_all(batches):
        encode, pack = encoding(ranks_path).encode_to_numpy, zstandard.ZstdCompressor(level=5).compress
        part, chunks, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, named, size, place, last = [], [], [], 0, None, ("", -1)

        def group():
            raw = b"".join(ids)
            doc_ids = pa.concat_arrays(named)
            row = [pa.array([v], pa.int64()) for v in (part << 24 | chunks, place[1], before, len(raw) // 2)]
            whole = pa.array([0, len(counts)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, doc_ids), pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64()))]
            blobs = [pa.array([b], pa.binary()) for b in (pack(raw), raw[: 2 * length], raw[-2 * length :])]
            return pa.RecordBatch.from_arrays([row[0], pa.array([place[0]]), *row[1:], *lists, *blobs], names=schema.names)

        for whole in batches:
            for batch in slices(whole):
                keys, first = batch.column("id"), 0
                rows = zip(*(batch.column(c).to_pylist() for c in ("text", "file", "at")), strict=True)
                for i, (text, file, at) in enumerate(rows):
                    here = (file, at if at >= 0 else part)
                    if place and (file != last[0] or here[1] < last[1]):
                        if i > first:
                            named.append(keys.slice(first, i - first))
                        if counts:
                            yield group()
                        ids, counts, named, size, first, before, place, chunks = [], [], [], 0, i, 0, None, chunks + 1
                    place, last = place or here, here
                    ids += [encode(text, disallowed_special=()).astype("<u2").tobytes(), END.tobytes()]
                    counts.append(len(ids[-2]) // 2 + 1)
                    size += counts[-1]
                    if size >= GROUP_IDS:
                        named.append(keys.slice(first, i + 1 - first))
                        yield group()
                        before, first = before + size, i + 1
                        ids, counts, named, size = [], [], [], 0
                if batch.num_rows > first:
                    named.append(keys.slice(first))
        if counts:
            yield group()

    return docs.mapInArrow(encode_all, schema)


def materialise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_records: int = SHARD_RECORDS, key: int = KEY, ranks_path: str | None = None) -> DataFrame:
    """Write docs as shuffled training sequences under path; return (slot, shard, record, doc_ids, ids_crc32) of each.

    The documents are encoded once, in groups written to the shared folder. Their ids make one stream in the order of
    files and rows, END_ID after each document, cut every `length` ids; the last sequence is filled with END_ID.
    Sequence i has slot permute(i); shard slot // shard_records holds it as record slot % shard_records, at byte
    record * stride(length) of its only file under shard=<number>, little-endian unsigned 16-bit ids. Every shard but
    the last is full, so a reader resumes at any slot with one seek. The same files and key give the same shards on any
    cluster, however the files are split; docs that are not read straight from files stand in the order of their
    partitions.

    Null or empty text: END_ID alone. The end's own string in a text is plain text, so it forges no boundary. A text of
    any length is encoded whole. Repeated rows are written as often as
    they come. Other columns are ignored, whatever their names. Empty table: no files, no rows.
    """
    spark = docs.sparkSession
    groups = written(token_groups(located(docs, id_col, text_col), length, ranks_path), "order-ids", **SMALL_GROUPS)
    # one row for each split of the input, in the order of files; the running sum of a few bytes a split
    chunks = groups.groupBy("chunk").agg(F.min(F.struct("file", "at")).alias("place"), F.sum("n").alias("n"))
    before = Window.orderBy("place.file", "place.at", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    table = chunks.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n").toArrow().sort_by("chunk")
    ids = pc.sum(table["n"]).as_py() or 0
    starts = spark.sparkContext.broadcast((table["chunk"].to_numpy(), table["start"].to_numpy()))
    id_type = groups.schema["doc_ids"].dataType
    if not ids:
        return spark.createDataFrame([], T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("record", T.LongType()), T.StructField("doc_ids", id_type), T.StructField("ids_crc32", T.LongType())]))
    total = -(-ids // length)
    shards = -(-total // shard_records)
    sample = zstandard.decompress(groups.select("blob").first().blob)[:DICTIONARY]

    def starts_of(batch) -> np.ndarray:
        chunk, start = starts.value
        return start[np.searchsorted(chunk, batch.column("chunk").to_numpy())] + batch.column("before").to_numpy()

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(sample)).compress
        for batch in batches:
            for start, blob in zip(starts_of(batch).tolist() if batch.num_rows else (), batch.column("blob"), strict=True):
                raw = unpack(blob.as_py())
                first, last = -(-start // length), (start + len(raw) // 2) // length
                for a in range(first, last, 512):
                    mine = range(a, min(last, a + 512))
                    records = [pack(raw[2 * (i * length - start) : 2 * ((i + 1) * length - start)]) for i in mine]
                    slot = permute(np.arange(mine.start, mine.stop), total, key)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(records, pa.binary()), pa.array(np.ones(len(slot), bool))], names=["slot", "ids", "packed"])

    def edges(batches):
        for batch in batches:
            rows = []
            for start, n, head, tail in zip(starts_of(batch).tolist() if batch.num_rows else (), *(batch.column(c).to_pylist() for c in ("n", "head", "tail")), strict=True):
                fill = END.tobytes() * (total * length - ids) if start + n == ids else b""
                first, last = start // length, (start + n) // length
                if start % length:
                    rows.append((first, start % length, head[: 2 * (length - start % length)] + (fill if first == last else b"")))
                if (first < last or start % length == 0) and (start + n) % length:
                    rows.append((last, 0, tail[len(tail) - 2 * ((start + n) % length) :] + fill))
            slot = permute(np.array([r[0] for r in rows], np.int64), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["slot", "from", "ids"])

    def unpacked(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(sample)).decompress
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = [unpack(x) if z else x for x, z in zip(batch.column("ids").to_pylist(), batch.column("packed").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slot"), pa.array(ids, pa.binary())], names=["shard", "slot", "ids"])

    inner = groups.select("chunk", "before", "blob").mapInArrow(cut, "slot long, ids binary, packed boolean")
    pieces = groups.select("chunk", "before", "n", "head", "tail").mapInArrow(edges, "slot long, from long, ids binary")
    # a sequence that spans groups: its pieces in order, `length` at most
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("from", "ids"))), F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    outer = pieces.groupBy("slot").agg(joined.alias("ids")).select("slot", "ids", F.lit(False).alias("packed"))
    ways = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = inner.union(outer).withColumn("shard", F.floor(F.col("slot") / shard_records))
    ranged = placed.repartitionById(ways, (F.col("shard") * ways / shards).cast("int"))
    ordered = ranged.mapInArrow(unpacked, "shard long, slot long, ids binary").sortWithinPartitions("shard", "slot")
    ordered.select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", SEPARATOR).text(path)

    def inside(batches):
        for batch in batches:
            for row, start in enumerate(starts_of(batch).tolist() if batch.num_rows else ()):
                ends = start + np.cumsum(batch.column("counts")[row].values.to_numpy())
                begins = np.concatenate(([start], ends[:-1]))
                first, last = begins // length, (ends - 1) // length
                many = last - first + 1
                doc = np.repeat(np.arange(len(ends)), many)
                sequence = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(doc))
                doc_ids = batch.column("doc_ids")[row].values.take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(permute(sequence, total, key)), pa.array(begins[doc]), doc_ids], names=["slot", "begin", "doc_id"])

    seen = groups.select("chunk", "before", "doc_ids", "counts").mapInArrow(inside, T.StructType([T.StructField("slot", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("doc_id", id_type.elementType)]))
    listed = seen.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("begin", "doc_id"))).alias("docs"))
    return records(spark, path, length, shard_records).join(listed, "slot").select("slot", "shard", "record", F.col("docs.doc_id").alias("doc_ids"), "ids_crc32")


def records(spark, path: str, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(slot, shard, record, ids_crc32) read back from the shards, one shard at a time in a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("shard").cast("long").alias("shard"), "content")

    def read(batches):
        step = stride(length)
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                view = memoryview(content.as_buffer())
                n = len(view) // step
                if len(view) % step:
                    raise RuntimeError(f"shard {shard} is not a whole number of records")
                crc = [zlib.crc32(view[i * step : i * step + 2 * length]) for i in range(n)]
                record = np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(shard * shard_records + record), pa.array(np.full(n, shard)), pa.array(record), pa.array(crc, pa.int64())], names=["slot", "shard", "record", "ids_crc32"])

    return files.mapInArrow(read, "slot long, shard long, record long, ids_crc32 long")


def materialised(docs: DataFrame, **options) -> DataFrame:
    """materialise() to a new path in the shared folder."""
    return materialise(docs, scratch(docs.sparkSession, "training-order"), **options)
