"""Centroid clustering of integer vectors by Walsh-Hadamard progressive search.

Components become integers floor(1024 * x), and each vector its 64 exact Walsh-Hadamard
coefficients, coarse ones (few changes of sign) first. The transform keeps squared distances but for a
factor of 64, so the sum over the first coefficients is a lower bound of a distance. A vector's leader
after the first group of coefficients is finished at once; at each further group, centroids whose sum is
already strictly greater than the leader's whole distance are out, and those that stay are finished on all 64.
All sums are integers, so nothing depends on rounding, on batches or on the order of tasks. Batches whose
squared distances might not fit 64 bits are computed with integers of any size.

The coefficients are staged once. A round is one pass over them: tasks return 64 sums and a count for each
centroid, which Spark adds up; centroids * 64 numbers come to the driver, whatever the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, map_stream, staged

WIDTH, SCALE = 64, 1024
#: Up to here the sums of squared differences of coefficients fit 64 bits; beyond it they are Python's integers.
MOST = 1 << 24
#: Coefficients of components from here on would not fit 64 bits.
TOO_WIDE = 1 << 57
#: Ends of the groups of coefficients, coarse to fine.
GROUPS = (4, 8, 16, 32, 64)


def _natural() -> np.ndarray:
    h = np.ones((1, 1), np.int64)
    while len(h) < WIDTH:
        h = np.block([[h, h], [h, -h]])
    return h


#: Rows of the natural matrix by number of changes of sign.
ORDER = np.argsort((_natural()[:, 1:] != _natural()[:, :-1]).sum(1))


def hadamard() -> np.ndarray:
    """The 64 Walsh functions as rows of +-1, coarse first."""
    return _natural()[ORDER]


def transformed(x: np.ndarray) -> np.ndarray:
    """Coefficients of integer rows by butterflies, coarse first."""
    out, n = np.array(x, np.int64), len(x)
    step = 1
    while step < WIDTH:
        pairs = out.reshape(n, WIDTH // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, WIDTH)
        step *= 2
    return out[:, ORDER]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, smaller numbers at ties; squared distance; coefficient differences
    taken) of rows of coefficients."""
    n, k = len(x), len(centroids)
    rows = np.arange(n)
    whole = np.iinfo(np.int64).max
    if max(int(np.abs(m).max(initial=0)) for m in (x, centroids)) > WIDTH * MOST:
        x, centroids, whole = x.astype(object), centroids.astype(object), 1 << 200

    def more(row: np.ndarray, centre: np.ndarray, begin: int, end: int) -> np.ndarray:
        d = x[row, begin:end] - centroids[centre, begin:end]
        return (d * d).sum(1) if d.dtype == object else np.einsum("ij,ij->i", d, d)

    row, centre = np.repeat(rows, k), np.tile(np.arange(k), n)
    sums = more(row, centre, 0, GROUPS[0])
    taken = len(row) * GROUPS[0]
    leader = sums.reshape(n, k).argmin(1) if n else np.zeros(0, np.int64)
    bound = sums.reshape(n, k)[rows, leader] + more(rows, leader, GROUPS[0], WIDTH)
    taken += n * (WIDTH - GROUPS[0])
    alive = (sums <= bound[row]) & (centre != leader[row])
    for begin, end in zip(GROUPS, GROUPS[1:]):
        row, centre, sums = row[alive], centre[alive], sums[alive]
        sums = sums + more(row, centre, begin, end)
        taken += len(row) * (end - begin)
        alive = sums <= bound[row]
    best = np.full((n, k), whole, x.dtype)
    best[rows, leader] = bound
    best[row[alive], centre[alive]] = sums[alive]
    at = best.argmin(1) if n else leader
    return at, best[rows, at] // WIDTH, taken


def _encoded(coefs: np.ndarray) -> list[bytes]:
    """Each row's coefficients as 32-bit integers in little-endian order, or as 64-bit ones where they need it."""
    wide = (np.abs(coefs) >> 31).any(1)
    return [row.astype("<i8" if w else "<i4").tobytes() for row, w in zip(coefs, wide)]


def _matrix(rows: list[bytes]) -> np.ndarray:
    if all(len(r) == WIDTH * 4 for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(-1, WIDTH).astype(np.int64)
    return np.stack([np.frombuffer(r, "<i4" if len(r) == WIDTH * 4 else "<i8").astype(np.int64) for r in rows])


def coefficients(vectors: DataFrame) -> DataFrame:
    """vec_id and coefs (64 coefficients as in `_encoded`) of the vectors that are kept."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < TOO_WIDE))
    rows = vectors.where(F.coalesce((F.size(e) == WIDTH) & fine, F.lit(False)))
    whole = rows.select(F.col("vec_id").cast("long"), F.transform(e, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("whole"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("whole")
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        return pa.record_batch([batch.column("vec_id"), pa.array(_encoded(transformed(x)), pa.binary())], ["vec_id", "coefs"])

    return map_batches(whole, run, "vec_id long, coefs binary")


def first_centroids(coefs: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the least sha256 of `seed:vec_id` (a null id counts as empty; ties: by coefficients)."""
    keyed = coefs.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "coefs")
    found = [r["coefs"] for r in keyed.orderBy("h", "coefs").limit(k).collect()]  # k rows
    return _matrix(found) if found else np.zeros((0, WIDTH), np.int64)


def _round(coefs: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Transformed centroids after one round: exact floors of the means, empty clusters as they were."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, WIDTH), object), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("coefs").to_pylist())
            at = nearest(x, centroids)[0]
            wide = np.abs(x).max(initial=0) > WIDTH * MOST
            for c in np.unique(at):
                sums[c] += (x[at == c].astype(object) if wide else x[at == c]).sum(0)
            counts += np.bincount(at, minlength=k)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.record_batch([pa.array(some), pa.array(counts[some]), pa.array([[str(s) for s in line] for line in sums[some]], pa.list_(pa.string()))], ["c", "n", "sums"])

    parts = map_stream(coefs.select("coefs"), run, "c long, n long, sums array<string>")
    by_place = parts.select("c", "n", F.posexplode("sums").alias("at", "s")).groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    whole = [[0] * WIDTH for _ in range(k)]
    count = [0] * k
    for r in by_place.collect():  # 64 rows for each centroid
        whole[r["c"]][r["at"]], count[r["c"]] = int(r["s"]), r["n"]
    back = hadamard().T
    out = centroids.copy()
    for c in range(k):
        if count[c]:
            plain = [sum(int(a) * b for a, b in zip(line, whole[c])) // WIDTH for line in back]  # exact: the sums of the components
            out[c] = transformed(np.array([[s // count[c] for s in plain]]))[0]
    return out


def fits(v: int) -> int | None:
    return v if v < 1 << 63 else None


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for each kept vector.

    Kept are vectors of exactly 64 components, none null or non-finite, nor beyond +-2**47 (not even their
    coefficients fit a long). Fewer vectors than k give fewer centroids; repeated rows and a repeated vec_id
    are vectors each, a null vec_id stays null; distances and sums that don't fit a long are null. Extra columns
    are ignored, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    coefs = staged(coefficients(vectors), "coefficients")
    centroids = first_centroids(coefs, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = _round(coefs, centroids)
        if (after == centroids).all():  # all further rounds are the same
            break
        centroids = after

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, distance, _ = nearest(_matrix(batch.column("coefs").to_pylist()), centroids)
        return pa.record_batch([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(map(fits, distance.tolist()), pa.int64())], ["vec_id", "cluster", "distance"])

    placed = staged(map_batches(coefs, assign, "vec_id long, cluster int, distance long"), "assigned")
    known = F.coalesce(F.col("distance").cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)"))  # null: does not fit
    total = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(known).alias("s")).collect()}  # at most k rows
    plain = (centroids @ hadamard()) // WIDTH
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in plain.tolist()]
    rows = [(c, fits(total.get(c, 0)), fits(sum(total.values())), names[c]) for c in range(len(centroids))]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """DuckDB SQL of clustered(), a round after the other."""
    steps = [
        f"v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as k, e as c from v qualify k < {k})",
    ]
    near = "select r, min(list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 1024 + k) as m from v, c{i} group by r"
    for i in range(rounds):
        steps += [
            f"a{i} as ({near.format(i=i)})",
            f"s{i} as (select m % 1024 as k, p, sum(e[p])::hugeint as s, count(*)::hugeint as n from a{i} join v using (r), range(1, {WIDTH + 1}) as t(p) group by 1, 2)",
            f"c{i + 1} as (select c{i}.k, coalesce(n.c, c{i}.c) as c from c{i} left join (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by p) as c from s{i} group by k) n on n.k = c{i}.k)",
        ]
    steps.append(f"f as (select vec_id, (m % 1024)::int as cluster, (m // 1024)::bigint as distance from ({near.format(i=rounds)}) join v using (r))")
    return (
        "with " + ",\n".join(steps) + "\nselect vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, "
        f"sha256(array_to_string(c, ',')) as centroid_sha256 from f join c{rounds} on c{rounds}.k = f.cluster"
    )
