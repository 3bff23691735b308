"""Near-dedup by circulant MinHash.

Words are lower-cased (A-Z) and cut at ASCII white space; a document's set holds its distinct
five-word shingles. One permutation places each shingle, a second one, circularly shifted by k,
gives coordinate k of the signature: the least shifted value over the set. Some coordinates make
a band; documents that agree in a band meet in a bucket.

1. Documents with equal sets are one class (128-bit fingerprint), so copies never meet as pairs.
2. In each bucket the members' sets are compared with that of the smallest member only. The links
   found settle most buckets: all their members are in one component.
3. In what is left, members of different components are compared in blocks of bounded size. A
   pair is looked at in the first band that its signatures share, if sizes and signatures allow
   the similarity, until it is known to be connected. Only links that join something are sent on,
   never pairs.

Every link is confirmed on the full sets of 64-bit shingle hashes. A band has as many coordinates as leave a pair at the
least similarity without a common bucket with a probability of at most MISS, less above it: 8 for
a similarity of 0.85 (40 bands, 3e-6), 6 for 0.8 (53 bands, 1e-7).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, components, join_few, map_batches, map_stream, mix, on_change, partitions, small, staged

U = np.uint64
SHINGLE, COORDINATES, MISS = 5, 320, 1e-5
UNIVERSE = 1 << 21
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Five standard deviations of a signature's estimate, below the least similarity.
SLACK = 5.0
ODD = (np.arange(1, 2 * SHINGLE, 2, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


on_change(_hashes.clear)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a UTF-8 text; of fewer words, one hash of them all."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, cuts at exactly \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(_hashes) > 150_000:
        _hashes.clear()
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, U(width))
    for j in range(width):  # scrambled after each word: a plain sum lets words change places unseen
        total = mix(total * ODD[j] + h[j : j + n])
    return np.unique(total)


@lru_cache(maxsize=1)
def circulant() -> np.ndarray:
    """Row p of the result holds the second permutation at p, p-1, ... as seen from position p."""
    values = np.random.Generator(np.random.PCG64(20240229)).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: COORDINATES - 1]]), COORDINATES)


on_change(circulant.cache_clear)


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates of a set."""
    places = (mix(hashes ^ U(0xD1B54A32D192ED03)) % U(UNIVERSE)).astype(np.int64)
    out = np.full(COORDINATES, UNIVERSE, np.uint32)
    rows = circulant()
    for part in range(0, len(places), 512):
        np.minimum(out, rows[places[part : part + 512]].min(0), out=out)
    return out


def band_rows(percent: int) -> int:
    """Coordinates of a band: the most by which a pair at this similarity is missed with at most MISS."""
    fit = (r for r in range(1, COORDINATES + 1) if (1 - (percent / 100) ** r) ** (COORDINATES // r) <= MISS)
    return max(fit, default=1)


def banded(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """The last axis cut into (bands, rows); coordinates left over are in no band."""
    bands = COORDINATES // rows
    return coordinates[..., : bands * rows].reshape(*coordinates.shape[:-1], bands, rows)


def buckets(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = banded(sig, rows).astype(np.uint64)
    sums = mix(bands + ODD[0] * np.arange(1, rows + 1, dtype=np.uint64)).sum(1)
    return mix(sums + np.arange(len(bands), dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, band: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, a and b (fingerprint of the set) and bands (the bucket of each band; null for empty sets)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b, bands = [], [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            n.append(len(s))
            a.append(int(s.sum().view(np.int64)) if len(s) else 0)
            b.append(int(mix(s ^ U(0xA5A5A5A5)).sum().view(np.int64)) if len(s) else 0)
            bands.append(buckets(signature(s), band) if len(s) else None)
        columns = [batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.record_batch(columns, ["doc_id", "t", "n_shingles", "a", "b", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), F.col("text").cast("binary"))
    return map_batches(rows, run, "doc_id long, t long, n_shingles long, a long, b long, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, its set (sorted hashes as bytes) and signature, for nodes (node, first_id, first_t)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t.as_py()) for t in batch.column("text")]
        sigs = [signature(s).astype("<u4").tobytes() for s in found]
        return pa.record_batch([batch.column("node"), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(sigs, pa.binary())], ["node", "items", "sig"])

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    found = texts.join(nodes, F.col("d").eqNullSafe(F.col("first_id")) & (F.col("t") == F.col("first_t")))
    return map_batches(found.dropDuplicates(["node"]).select("node", "text"), run, "node long, items binary, sig binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Forest:
    """Union-find over the members of one block."""

    def __init__(self, groups: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(g, k) for k, g in enumerate(groups)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _compare(band: int, nodes: list[int], groups: list[int], sigs: np.ndarray, items: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join members of one bucket's block; sides: 1 and 2, or 3 for both, of a pair of blocks."""
    forest, out, n = Forest(groups), [], len(nodes)
    sizes = np.array([len(s) for s in items])
    least = percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / COORDINATES)
    group = np.unique(np.array(groups), return_inverse=True)[1]
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[((sides[i] | sides[rest]) == 3) & (100 * small >= percent * large) & (group[rest] != group[i])]
        if not len(rest):
            continue
        same = sigs[rest] == sigs[i]
        rest, same = rest[same.mean(1) >= least], same[same.mean(1) >= least]
        if not len(rest):
            continue
        first = banded(same, band_rows(percent)).all(2).argmax(1)  # every pair here shares `band`
        for j in rest[first == band]:
            if forest.root(i) != forest.root(int(j)) and linked(items[i], items[j], percent):
                forest.join(i, int(j))
                out.append((nodes[i], nodes[j]))
    return out


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of a component), kept (doc_id is that
    one), t (hash of the text) and chosen for each row.

    Texts without words, null or empty, have an empty set and link with nothing. Rows are told
    apart by doc_id and text: rows repeated with both are one node, one id on several texts is
    several. Rows with a null doc_id have a null component_id and are `kept`. `chosen` marks one (doc_id,
    text) in each component, where such rows take part too, after all others. Texts may be of any
    length; extra columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    all_rows = staged(sketches(docs, band_rows(percent)), "sketches")
    usable = all_rows.where("n_shingles > 0")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    classes = usable.groupBy("a", "b").agg(F.min(rep).alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    classes = staged(classes.select("a", "b", F.col("rep.doc_id").alias("first_id"), F.col("rep.t").alias("first_t"), "bands", "size", F.monotonically_increasing_id().alias("node")), "classes")

    by_band = classes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    full = by_band.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("head"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # equal sets of members need one look: the first band's
    full = full.groupBy("n", "members", "head").agg(F.min(F.struct("band", "bucket", "total")).alias("x")).select("n", "head", "x.band", "x.bucket", "x.total")
    full = staged(full, "buckets")
    met = staged(join_few(by_band, full, ["band", "bucket"], "node").select("node", "head", "band", "bucket", "n", "total"), "members")

    # the head met in most buckets first
    heads = met.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("times")).groupBy("node").agg(F.max_by("head", F.struct("times", -F.col("head"))).alias("head"))
    heads = staged(heads, "heads")
    seen = classes.select("node", "first_id", "first_t").join(met.select("node").distinct(), "node", "left_semi")
    sets = staged(sets_of(docs, small(staged(seen, "met-nodes"))), "sets")
    pairs = heads.join(sets.select("node", "items"), "node").join(sets.select(F.col("node").alias("head"), F.col("items").alias("other")), "head")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [linked(np.frombuffer(a.as_py(), U), np.frombuffer(b.as_py(), U), percent) for a, b in zip(batch.column("items"), batch.column("other"))]
        t = pa.record_batch([batch.column("node"), batch.column("head")], ["u", "v"])
        return t.filter(pa.array(ok, pa.bool_()))

    links = staged(map_batches(pairs.select("node", "head", "items", "other"), check, "u long, v long"), "links")
    groups = components(links, "settled")

    grouped = met.join(groups, "node", "left").select("node", "band", "bucket", "n", "total", F.coalesce("component", "node").alias("grp"))
    grouped = staged(grouped, "grouped")
    open_buckets = grouped.groupBy("band", "bucket").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("band", "bucket")
    left = join_few(grouped, staged(open_buckets, "open-buckets"), ["band", "bucket"], "node")
    # blocks of bounded rows and, on average, bytes
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    block = F.pmod(F.xxhash64("node"), count).cast("int")
    left = left.withColumn("blocks", count).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("node", "grp", "band", "bucket", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    rows = left.join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            held.sort(key=lambda r: r[0])
            sigs = np.stack([np.frombuffer(r[2], "<u4") for r in held])
            sides = np.array([3 if now[2] == now[3] else 1 if r[4] == now[2] else 2 for r in held])
            return _compare(now[0], [r[0] for r in held], [r[1] for r in held], sigs, [np.frombuffer(r[3], U) for r in held], sides, percent)

        for batch in batches:
            out = []
            for key, *row in zip(zip(*(batch.column(c).to_pylist() for c in ("band", "bucket", "x", "y"))), *(batch.column(c).to_pylist() for c in ("node", "grp", "sig", "items", "block"))):
                if key != now:
                    out += flush()
                    now, held = key, []
                held.append(row)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])
        out = flush()
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    keys = ["band", "bucket", "x", "y"]
    dealt = rows.select(*keys, "node", "grp", "sig", "items", "block").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    more = staged(map_stream(dealt, compare, "u long, v long"), "more-links")
    whole = components(links.union(more), "all-links")
    rooted = staged(classes.join(whole, "node", "left").select("a", "b", "first_id", "first_t", "node", F.coalesce("component", "node").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("best"))
    by_class = rooted.join(staged(best, "components"), "root")  # staged, so that adaptive execution splits a very large component
    by_class = by_class.select("a", "b", F.col("best.first_id").alias("component_id"), F.when(F.col("best.node") == F.col("node"), F.col("first_t")).alias("chosen_t"))
    rows = usable.select("doc_id", "t", "n_shingles", "a", "b").join(staged(by_class, "by-class"), ["a", "b"])
    rows = rows.select("doc_id", "t", "n_shingles", "component_id", (F.coalesce(F.col("t") == F.col("chosen_t"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("chosen"))
    rest = all_rows.where("n_shingles = 0").select("doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"))
    out = rows.union(rest)
    named = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", named.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "t", "chosen")
