"""Embedding near-dedup by collision-counting projections.

Vectors of one label and dimension are projected on many random lines. On each line the vectors
are sorted, and all within a window centred on a query collide with it once. A pair passes if it
collides often enough; the count is calibrated, by the binomial distribution of collisions of a
pair exactly at the least cosine, to miss less than one such pair in a hundred million. Passing pairs are
verified by their cosine in double precision.

Equal vectors are one class, so copies are never paired. Before the windows, vectors of a label are
dealt to cells by the signs of further projections: `tables` times over, so that a pair at the least
cosine shares no cell with a probability of at most CELL_MISS, wherever the pair lies: that depends on its
angle alone. The number of signs grows with the label, so that cells stay small: work grows with about
the 1.2th power of a label's vectors, not with its square. What cells would cost is counted, not
assumed: a label whose cells hold more pairs than it has itself, as a small one's do (at a cosine of
0.93, one of up to about 23,000 distinct vectors) or one whose vectors share a direction, is one
cell, where every pair is compared. `exact=True` takes that way for all labels.

Cells are dealt to blocks of bounded size, and each pair of blocks is one unit of work that sends on, for
each vector, its number of links and the smallest vector it is connected to: rows in proportion to
vectors. A pair is looked at in the first table whose cell it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, join_few, map_batches, map_stream, partitions, staged

LINES, BLOCK, MISS, CELL_MISS = 64, 1024, 1e-8, 1e-6


def window_and_count(least: float, lines: int = LINES, miss: float = MISS) -> tuple[float, int]:
    """Half-width of the windows for unit vectors, and the greatest count that a pair at the least
    cosine stays below with probability under `miss`."""
    distance = math.sqrt(max(2 * (1 - least), 1e-12))
    p = math.erf(1 / math.sqrt(2))  # within one standard deviation of that pair's difference
    total, count = 0.0, 0
    for k in range(lines):
        total += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if total >= miss:
            break
        count = k + 1
    return distance, count


def candidates(x: np.ndarray, y: np.ndarray, lines: np.ndarray, window: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) of unit vectors that collide on `count` lines or more."""
    hits = np.zeros((len(x), len(y)), np.uint8)
    px, py = x @ lines, y @ lines
    whole, unsigned = (np.int16, np.uint16) if len(y) < 1 << 15 else (np.int32, np.uint32)
    for k in range(lines.shape[1]):
        order = np.argsort(py[:, k], kind="stable")
        line = py[order, k]
        rank = np.empty(len(y), whole)
        rank[order] = np.arange(len(y))
        low = np.searchsorted(line, px[:, k] - window, "left").astype(whole)
        high = np.searchsorted(line, px[:, k] + window, "right").astype(whole)
        # one comparison for both ends of the window
        hits += (rank[None, :] - low[:, None]).view(unsigned) < (high - low).astype(unsigned)[:, None]
    return np.nonzero(hits >= count)


def directions(dimension: int, lines: int = LINES, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dimension])).standard_normal((dimension, lines))


def near_components(vectors: DataFrame, least: float = 0.93, exact: bool = False, bits: int | None = None) -> DataFrame:
    """vec_id, n_links (other rows of its label with cosine >= least), component_id, kept for each row.

    Vectors that are null, zero, or hold null or non-finite numbers, and rows with a null label or
    vec_id, link with nothing and are their own component (null for a null vec_id). Vectors of
    different dimension aren't compared. Repeated rows link like copies, and rows that share a vec_id but
    not the vector are compared each on its own. Extra columns are ignored; an empty table gives none.
    exact: compare all pairs of each label, without cells. bits: signs of a cell for all labels, instead of
    a number by the label's size, whatever the cells then cost.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as they are; products are of doubles
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), e.cast(kind).alias("embedding")).withColumn("good", good)
    rows = rows.withColumns({"a": F.xxhash64("label", "embedding"), "b": F.xxhash64(F.lit(7), "embedding", "label")})
    rows = staged(rows, "vectors")
    usable = rows.where("good")
    # a class holds equal vectors of a label; one vec_id on several vectors is in several classes
    classes = usable.groupBy("a", "b").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = staged(classes.withColumn("dimension", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    counts = classes.groupBy("label", "dimension").agg(F.count("*").alias("n"))
    same_sign = 1 - math.acos(least) / math.pi  # of a pair at the least cosine on one line
    by_size = F.greatest(F.lit(0), F.round(F.log2(F.col("n") / F.lit(float(BLOCK))))).cast("int")
    tables = F.when(F.col("bits") > 0, F.ceil(math.log(CELL_MISS) / F.log(1 - F.pow(F.lit(same_sign), "bits")))).otherwise(1).cast("int")
    counts = counts.withColumn("bits", F.lit(0) if exact else by_size if bits is None else F.lit(bits)).withColumn("tables", tables)
    if bits is None:
        worth = F.col("tables") < F.pow(F.lit(2.0), "bits")
        counts = counts.select("label", "dimension", "n", F.when(worth, F.col("bits")).otherwise(0).alias("bits"), F.when(worth, F.col("tables")).otherwise(1).alias("tables"))
    counts = staged(counts, "label-cells")
    nodes = join_few(classes.select("node", "copies", "label", "dimension", "embedding"), counts, ["label", "dimension"], "node")

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes: list[np.ndarray] = [np.zeros(1, np.int64)] * batch.num_rows
        shape = np.stack([batch.column(c).to_numpy() for c in ("dimension", "bits", "tables")], 1)
        for d, k, t in np.unique(shape, axis=0).tolist():
            if k:
                at = np.flatnonzero((shape == (d, k, t)).all(1))
                v = np.array([batch.column("embedding")[int(i)].as_py() for i in at], np.float64)
                signs = (v / np.abs(v).max(1, keepdims=True)) @ directions(d, k * t, seed=12) > 0
                for i, row in zip(at, signs.reshape(len(at), t, k) @ (1 << np.arange(k))):
                    codes[i] = row
        keep = ["node", "copies", "label", "dimension", "embedding"]
        return pa.record_batch([*(batch.column(c) for c in keep), pa.array(codes, pa.list_(pa.int64()))], [*keep, "codes"])

    nodes = staged(map_batches(nodes.select("node", "copies", "label", "dimension", "embedding", "bits", "tables"), coded, f"node long, copies long, label string, dimension int, embedding {kind}, codes array<long>"), "vector-cells")
    cells = ["label", "dimension", "part", "code"]
    placed = nodes.select("*", F.posexplode("codes").alias("part", "code"))
    sizes = staged(placed.groupBy(*cells).agg(F.count("*").alias("n")).where("n > 1"), "cell-sizes")
    if bits is None and not exact:  # labels whose cells hold more pairs than the labels themselves become one cell
        pairs = sizes.groupBy("label", "dimension").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
        whole = counts.where("bits > 0").join(pairs, ["label", "dimension"]).where("pairs >= cast(n as double) * n").select("label", "dimension", F.lit(True).alias("whole"))
        whole = staged(whole, "whole-labels")
        if not whole.isEmpty():
            one = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(F.col("codes"))
            nodes = staged(nodes.join(whole, ["label", "dimension"], "left").withColumn("codes", one).drop("whole"), "vector-cells")
            placed = nodes.select("*", F.posexplode("codes").alias("part", "code"))
            sizes = staged(placed.groupBy(*cells).agg(F.count("*").alias("n")).where("n > 1"), "cell-sizes")
    sizes = sizes.select(*cells, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = join_few(placed, staged(sizes, "cell-blocks"), cells, "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*cells, "x", "y"]
    dealt = dealt.select(*cells, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "copies", "embedding", "block", "codes")
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        window, count = window_and_count(least)

        def flush() -> pa.RecordBatch | None:
            part, x, y = now[2], now[4], now[5]
            first = [r for r in held if r[3] == x]
            second = first if x == y else [r for r in held if r[3] == y]
            if not first or not second:
                return None
            lines = directions(now[1])
            raw = [np.array([r[2] for r in side], np.float64) for side in (first, second)]
            scaled = [v / np.abs(v).max(1, keepdims=True) for v in raw]  # against overflow; the cosine is the same
            norms = [np.sqrt((v * v).sum(1)) for v in scaled]
            units = [v / n[:, None] for v, n in zip(scaled, norms)]
            i, j = candidates(*units, lines, window, count)
            if second is first:
                i, j = i[i < j], j[i < j]
            if part:  # pairs that an earlier table has shown
                codes = [np.array([r[4] for r in side]) for side in (first, second)]
                new = np.concatenate([~(codes[0][i[s : s + 65536], :part] == codes[1][j[s : s + 65536], :part]).any(1) for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                i, j = i[new], j[new]
            cosine = np.concatenate([np.einsum("kd,kd->k", scaled[0][i[s : s + 65536]], scaled[1][j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            ok = cosine / (norms[0][i] * norms[1][j]) >= least
            i, j = i[ok], j[ok]
            both = first if second is first else first + second
            shift = 0 if second is first else len(first)
            weight = np.array([r[1] for r in both], np.float64)
            links = np.bincount(i, weight[j + shift], len(both)) + np.bincount(j + shift, weight[i], len(both))
            node = np.array([r[0] for r in both])
            least_node = node.copy()
            while True:  # smallest node reachable inside the block
                before = least_node.copy()
                np.minimum.at(least_node, i, before[j + shift])
                np.minimum.at(least_node, j + shift, before[i])
                if (least_node == before).all():
                    break
            found = links > 0
            return pa.record_batch([pa.array(node[found]), pa.array(links[found].astype(np.int64)), pa.array(least_node[found])], ["node", "links", "least"])

        for batch in batches:
            for key, *row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), *(batch.column(c).to_pylist() for c in ("node", "copies", "embedding", "block", "codes"))):
                if key != now:
                    out = flush() if held else None
                    if out is not None:
                        yield out
                    now, held = key, []
                held.append(row)
        out = flush() if held else None
        if out is not None:
            yield out

    found = staged(map_stream(dealt, compare, "node long, links long, least long"), "vector-links")
    whole = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")), "vector-components")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = classes.select("a", "b", "first_id", "copies", "node").join(counts, "node", "left").join(whole, "node", "left")
    by_class = staged(by_class.select("a", "b", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")), "vector-roots")
    least_ids = by_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = by_class.join(staged(least_ids, "vector-least"), "root").select("a", "b", "n_links", "component_id")
    linked = usable.select("vec_id", "a", "b").join(staged(by_class, "vector-results"), ["a", "b"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
