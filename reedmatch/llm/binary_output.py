"""Token-ID binary output: a static range asymmetric numeral system over shared frequency tables.

Format of a folder (all parts are Parquet containers, so any store that Spark reads will do):

* ``blocks``: one row per block of at most ``BLOCK`` ids: shard, block_no, first (ids of the
  shard before the block), n_ids, and for each document with ids in the block its doc_id,
  ordinal in the shard, ids here (``piece_ids``), ids before in the document (``piece_first``)
  and in all (``doc_ids_total``); ``payload`` is the coded block. Shards, blocks and documents
  are in ascending doc_id order.
* ``shards``: shard and base (ids of all shards before).
* ``tables``: one row, the shared symbol frequencies that every block is coded with.

A block is coded by interleaved lanes of 64-bit states with 32-bit words. It holds check-points:
lane states and word position at every ``EVERY`` steps with a checksum of the ids from there to
the next, so each of these segments, like each block, can be decoded on its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop_staged, map_stream, partitions, scratch, staged
from .tokens import Library, packed, units, unpacked

BLOCK, LANES, EVERY, PRECISION = 1 << 19, 2048, 128, 18
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIIII")  # magic, ids, lanes, steps, check-points, words
BLOCKS = "shard int, block_no int, first long, n_ids int, doc_id array<long>, ordinal array<long>, piece_ids array<long>, piece_first array<long>, doc_ids_total array<long>, payload binary"


class Tables:
    """Frequencies that sum to 2**bits, every symbol that occurs having one at least."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), np.uint64(bits)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.common = int(np.argmax(freq))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Tables:
        bits = max(PRECISION, int(np.count_nonzero(counts)).bit_length() + 2)
        counts = counts if counts.any() else np.eye(1, len(counts), dtype=np.int64)[0]
        scaled = counts * ((1 << bits) / counts.sum())
        freq = np.where(counts > 0, np.maximum(1, np.floor(scaled)), 0).astype(np.int64)
        over = int(freq.sum()) - (1 << bits)
        order = np.argsort(-freq, kind="stable")
        for k in order:  # the most frequent symbols pay for those raised to one
            if over <= 0:
                break
            cut = min(over, int(freq[k]) // 2)
            freq[k] -= cut
            over -= cut
        freq[order[0]] -= over
        return cls(freq, bits)


def encode_block(ids: np.ndarray, t: Tables) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, 1 << max(0, (n // EVERY).bit_length() - 1)))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, t.common, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    words, points, count = [], [], 0
    room = np.uint64(63) - t.bits
    for k in range(steps - 1, -1, -1):
        f = t.freq[grid[k]]
        over = x >= (f << room)
        if over.any():
            out = x[over]
            words.append(out.astype(np.uint32))
            count += len(out)
            x[over] = out >> np.uint64(32)
        q = x // f
        x = (q << t.bits) + (x - q * f) + t.cum[grid[k]]
        if k % EVERY == 0:
            points.append((k, count, zlib.crc32(ids[k * lanes : (k + EVERY) * lanes].astype("<u4").tobytes()), x.tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    out = [HEAD.pack(b"RAN1", n, lanes, steps, len(points), count)]
    for k, at, crc, states in reversed(points):
        out.append(struct.pack("<III", k, count - at, crc) + states)
    body = b"".join(out) + stream
    return body + struct.pack("<I", zlib.crc32(body))


def decode_segments(data: bytes, t: Tables, segments: slice = slice(None)) -> Iterator[np.ndarray]:
    """The ids of a block's segments between check-points; raises ValueError on a wrong checksum."""
    body, (crc,) = data[:-4], struct.unpack("<I", data[-4:])
    magic, n, lanes, steps, n_points, n_words = HEAD.unpack_from(body)
    if magic != b"RAN1" or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    size = 12 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, HEAD.size + n_points * size).astype(np.uint64)
    low_bits = np.uint64((1 << int(t.bits)) - 1)
    for p in range(n_points)[segments]:
        k, at, wanted = struct.unpack_from("<III", body, HEAD.size + p * size)
        x = np.frombuffer(body, "<u8", lanes, HEAD.size + p * size + 12).astype(np.uint64)
        upto = min(steps, k + EVERY)
        out = np.empty((upto - k, lanes), np.uint32)
        for row in range(upto - k):
            slot = x & low_bits
            s = t.symbol[slot]
            out[row] = s
            x = t.freq[s] * (x >> t.bits) + slot - t.cum[s]
            under = np.flatnonzero(x < LOW)
            if len(under):
                x[under] = (x[under] << np.uint64(32)) | words[at : at + len(under)]
                at += len(under)
        ids = out.ravel()[: n - k * lanes]
        if zlib.crc32(ids.astype("<u4").tobytes()) != wanted:
            raise ValueError("wrong checksum")
        yield ids


def decode_block(data: bytes, t: Tables) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *decode_segments(data, t)])


def tokenized(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, n_tokens and packed ids of every whole text (null is empty), end_id appended. Each task
    adds a row with n_tokens -1, whose `ids` holds the number of times it met each id (`<u8`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = units(path), np.zeros(0, np.int64)
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        names = ["doc_id", "n_tokens", "ids"]
        for batch in batches:
            ids, sizes = encoder.encode(batch.column("text"))
            met = np.bincount(ids, minlength=len(total))
            met[: len(total)] += total
            total = met
            out = [packed(np.concatenate([x, tail])) for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes + len(tail)), pa.array(out, pa.binary())], names)
            if len(tail):
                total = np.concatenate([total, np.zeros(max(0, end_id + 1 - len(total)), np.int64)])
                total[end_id] += len(sizes)
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([total.astype("<u8").tobytes()], pa.binary())], names)

    return map_stream(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids binary")


def frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all rows; the driver gets one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0):
                counts = np.frombuffer(data.as_py(), "<u8").astype(np.int64)
                total[: len(counts)] += counts
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in map_stream(tokens.where("n_tokens < 0").select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, folder: str, path: str, end_id: int | None) -> str:
    """Encode all documents to `folder` in the format above.

    Null text is empty; rows with a null doc_id come first; repeated rows are kept, each as a
    document of its own; an empty table gives a folder without blocks. A text of any length is
    cut over blocks. Extra columns are ignored.
    """
    spark = docs.sparkSession
    tokens = staged(tokenized(docs, path, end_id), "token-ids")
    counts = frequencies(tokens, max(Library(path).vocab_size, (end_id or 0) + 1))
    tables = Tables.of_counts(counts)
    spark.createDataFrame([(int(tables.bits), tables.freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{folder}/tables")
    shared = spark.sparkContext.broadcast((tables.freq.astype(np.int64), int(tables.bits)))  # one number for each id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, shard = Tables(*shared.value), TaskContext.get().partitionId()
        parts, docs_here, held, ordinal, first, block = [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, first, block, parts, docs_here
            row = [shard, block, first, held, *map(list, zip(*docs_here)), encode_block(np.concatenate(parts), t)]
            first, block, parts, docs_here = first + held, block + 1, [], []
            held = 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 5, pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids, at = unpacked(data.as_py()), 0
                while True:
                    piece = ids[at : at + BLOCK - held]
                    docs_here.append((doc_id, ordinal, len(piece), at, len(ids)))
                    parts.append(piece)
                    held, at = held + len(piece), at + len(piece)
                    if held == BLOCK:
                        yield flush()
                    if at == len(ids):
                        break
                ordinal += 1
        if docs_here:
            yield flush()

    # the row's number in the staged table tells rows of one doc_id apart, so that many of them are cut over tasks
    ranged = tokens.where("n_tokens >= 0").select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    map_stream(ranged, run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    drop_staged(tokens)
    base, rows = 0, []
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # one row for each shard
        rows.append((r["shard"], base))
        base += r["n"]
    spark.createDataFrame(rows, "shard int, base long").coalesce(1).write.parquet(f"{folder}/shards")
    return folder


def load_tables(spark: SparkSession, folder: str) -> Tables:
    r = spark.read.parquet(f"{folder}/tables").first()
    return Tables(np.frombuffer(r["freq"], "<u4").astype(np.int64), r["bits"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of documents decoded from a folder: shard, ordinal, doc_id, start (ids of all
    documents before), n_tokens (of the whole document), piece_first and ids (uint32, little-endian)."""
    tables = load_tables(spark, folder)
    shared = spark.sparkContext.broadcast((tables.freq.astype(np.int64), int(tables.bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["payload"], t)
                if len(ids) != r["n_ids"]:
                    raise ValueError("block length")
                sizes = np.array(r["piece_ids"])
                ends = np.cumsum(sizes)
                n = len(sizes)
                start = r["first"] + ends - sizes - np.array(r["piece_first"])
                raw = [ids[e - s : e].astype("<u4").tobytes() for s, e in zip(sizes, ends)]
                yield pa.record_batch(
                    [pa.array([r["shard"]] * n, pa.int32()), *(pa.array(r[c], pa.int64()) for c in ("ordinal", "doc_id")), pa.array(start, pa.int64()), *(pa.array(r[c], pa.int64()) for c in ("doc_ids_total", "piece_first")), pa.array(raw, pa.binary())],
                    ["shard", "ordinal", "doc_id", "in_shard", "n_tokens", "piece_first", "ids"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    out = map_stream(blocks, run, "shard int, ordinal long, doc_id long, in_shard long, n_tokens long, piece_first long, ids binary")
    shards = F.broadcast(spark.read.schema("shard int, base long").parquet(f"{folder}/shards"))  # one row for each shard
    return out.join(shards, "shard").withColumn("start", F.col("base") + F.col("in_shard")).drop("base", "in_shard")


def checksums(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document; those cut over blocks are joined by
    the identity crc(ab) = crc(0..0 after crc(a)) ^ crc(0..0) ^ crc(b)."""
    sums = pieces.select("shard", "ordinal", "doc_id", "start", "n_tokens", "piece_first", (F.length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc"))
    sums = staged(sums, "piece-sums")
    one = F.col("n") == F.col("n_tokens")

    def join(pdf):
        pdf = pdf.sort_values("piece_first")
        crc = 0
        for n, c in zip(pdf["n"], pdf["crc"]):
            zeros = b"\0" * (4 * int(n))
            crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ int(c)
        first = pdf.iloc[:1]
        return first.assign(crc=crc)[["doc_id", "start", "n_tokens", "crc"]]

    cut = sums.where(~one & (F.col("n") > 0)).groupBy("shard", "ordinal").applyInPandas(join, "doc_id long, start long, n_tokens long, crc long")
    return sums.where(one).select("doc_id", "start", "n_tokens", "crc").union(cut).withColumnRenamed("crc", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    folder = f"{scratch(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return checksums(read(docs.sparkSession, write(docs, folder, path, end_id)))
