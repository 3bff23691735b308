"""Packing along a space-filling curve.

Every document's pairs of adjacent ids are hashed and projected to few dimensions, the Hilbert key
of that point orders the documents (range sort, ties by doc_id), and the ids of neighbours on the curve fill
sequences one after the other: a document goes on where the one before it ended, and is cut
where a sequence is full. So sequences hold similar documents and only the last one is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, mix, running_sum, staged
from .tokens import packed, units, unpacked

DIMENSIONS, BITS = 4, 12


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of (n, dimensions) integer points below 2**bits (Skilling's transposition)."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected(features: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the hashed +-1 rows of each document's features, a column for each dimension.

    Two dimensions share one 64-bit sum of set bits, 32 bits each; a sum of bits b of n is 2b - n."""
    h = mix(features + np.uint64(0x9E3779B97F4A7C15))
    columns = []
    for k in range(0, DIMENSIONS, 2):
        low, high = h >> np.uint64(7 * k) & np.uint64(1), h << np.uint64(25 - 7 * k) & np.uint64(1 << 32)
        bits = np.add.reduceat(low | high, begins)
        columns += [bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)]
    return 2 * np.stack(columns, 1).astype(np.int64) - sizes[:, None]


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents, whose vectors hold the counts of adjacent id pairs hashed to
    features; a document's first id is paired with none, so its key depends on its own ids alone."""
    sums = np.zeros((len(counts), DIMENSIONS))
    filled = counts > 0
    begins = (np.cumsum(counts) - counts)[filled]
    if len(begins):
        pairs = ids.astype(np.uint64) * np.uint64(1 << 20)
        pairs[1:] += ids[:-1]
        pairs[begins] = ids[begins] * np.uint64(1 << 20) + np.uint64((1 << 20) - 1)
        sums[filled] = projected(pairs, begins, counts[filled])
    z = sums / np.sqrt(np.maximum(counts, 1))[:, None]
    cells = np.clip((np.tanh(z / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


def placed_tokens(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, n_tokens, curve key and packed ids of every whole text, end_id appended."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        ids, sizes = units(path).encode(batch.column("text"))
        keys = curve_keys(ids, sizes)
        out = [packed(np.concatenate([x, tail])) for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []
        return pa.record_batch([batch.column("doc_id"), pa.array(sizes + len(tail)), pa.array(keys), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "curve_key", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, curve_key long, ids binary")


def pack(docs: DataFrame, path: str, end_id: int | None = 2, size: int = 4096) -> DataFrame:
    """Pieces of documents in sequences of `size` ids: doc_id, start (ids of the document before
    the piece), length, ids (uint32, little-endian), doc_tokens, sequence_id, offset, curve_key.

    Every id lies in exactly one piece; sequences are gapless from offset 0 and all but the last
    are full. A null or empty text has only its end id. Repeated rows are separate documents; a
    null doc_id stays null and counts as smallest in ties. A text of any length is cut over
    sequences. An empty table has no pieces; extra columns are ignored.
    """
    tokens = staged(placed_tokens(docs, path, end_id).withColumn("row_no", F.monotonically_increasing_id()), "placed-tokens")
    order = tokens.select("curve_key", "doc_id", "row_no", "n_tokens")
    places = running_sum(order, ["curve_key", "doc_id", "row_no"], {"n_tokens": "start"}, "curve-order").select("row_no", "start")
    placed = tokens.where("n_tokens > 0").join(places, "row_no")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(8)]
        for doc_id, n, key, data, begin in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "curve_key", "ids", "start"))):
            ids, at = unpacked(data), 0
            while at < n:
                sequence, offset = divmod(begin + at, size)
                length = min(n - at, size - offset)
                for column, v in zip(rows, (doc_id, at, length, ids[at : at + length].astype("<u4").tobytes(), n, sequence, offset, key)):
                    column.append(v)
                at += length
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"])

    return map_batches(placed, cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long")
