"""What the operators share: staged tables, bounded Arrow batches, running sums and hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import delete, shared_folder as scratch, staged, staged_alone  # noqa: F401

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; they may not have its folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"  # the driver's file server hands it out
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast if it has at most most_rows; else the
    table itself, whose joins are then shuffled."""
    return F.broadcast(df) if df.count() <= most_rows else df


#: Copies of each row of the smaller side when a join on few keys is shuffled: a key that holds a third
#: of all rows is dealt over as many tasks.
SPREAD = 16


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], spread_by: str, most_rows: int = 1_000_000) -> DataFrame:
    """rows joined with a staged table of at most one row for each key: broadcast where it is small, else
    shuffled with the rows of a key spread by another column."""
    if few.count() <= most_rows:
        return rows.join(F.broadcast(few), keys)
    copies = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("__part", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int")).join(copies, [*keys, "__part"]).drop("__part")


#: Arrow batches are cut by size, so that a batch of very long texts still fits a Python worker; one
#: value for all plans of a session, as Spark reads it when a plan runs.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_forget: list[Callable[[], None]] = []
_task = ""


def on_change(forget: Callable[[], None]) -> None:
    """Register what empties a cache that a worker process keeps between tasks."""
    _forget.append(forget)


def enter(task: str) -> None:
    """Called by each task in a Python worker: Spark uses workers again for other stages, so caches
    that tasks of another kind left are emptied first."""
    global _task
    if task != _task:
        pa.set_memory_pool(pa.system_memory_pool())
        for forget in _forget:
            forget()
        gc.collect()
        give_back()
        _task = task


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_stream(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of all record batches of a task."""
    bounded_batches(df.sparkSession)
    task = f"{function.__module__}.{function.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(task)
        for out in function(batches):
            if out is not None and out.num_rows:
                large = out.nbytes > 1 << 18
                yield out
                out = None
                if large:  # else a worker grows by what each batch leaves between small objects that stay
                    give_back()
        out = None
        give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    each.__module__, each.__qualname__ = function.__module__, function.__qualname__
    return map_stream(df, each, schema)


def pieces(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of at most `most` in sum, or of one item."""
    begin, total, k = 0, 0, -1
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if k >= begin:
        yield slice(begin, k + 1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[k] .. starts[k] + lengths[k] - 1 for every k, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: list[str], sums: dict[str, str], label: str) -> DataFrame:
    """df with a column for each pair (value, name) of `sums`: the sum of the value over all rows before
    this one in the global order.

    Rows are range-sorted; each task sums its own range, and only one total for each
    range comes to the driver, to be added as that range's base. df should be staged.
    """
    spark = df.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{c}` long" for c in sums.values()) + ", range_no int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, totals = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns = list(batch.columns)
            for value, total in totals.items():
                values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(values) + total
                columns.append(pa.array(ends - values))
                totals[value] = int(ends[-1]) if len(ends) else total
            columns.append(pa.array(np.full(batch.num_rows, at, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *sums.values(), "range_no"])

    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = staged(map_stream(ranged, run, schema), label)
    base, bases = dict.fromkeys(sums, 0), []
    for r in rows.groupBy("range_no").agg(*(F.sum(v).alias(v) for v in sums)).orderBy("range_no").collect():
        bases.append((r["range_no"], *base.values()))
        base = {v: n + r[v] for v, n in base.items()}
    lookup = F.broadcast(spark.createDataFrame(bases, "range_no int" + "".join(f", `__{c}` long" for c in sums.values())))
    whole = rows.join(lookup, "range_no").withColumns({c: F.col(c) + F.col(f"__{c}") for c in sums.values()})
    return whole.drop("range_no", *(f"__{c}" for c in sums.values()))


def components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of (u, v) edges: rows (node, component), component = smallest node reachable.

    Alternating star contraction: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones; each round is written to the shared folder. Minima are
    combined before the shuffle and the joins back are plain equi-joins, which adaptive
    execution splits where one node has very many links. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    now = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = staged(now, label)
    # (u, v) always has u < v below
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = now.join(least, "u").select(F.col("m").alias("u"), "v")  # v > u goes to u's least neighbour
        large = large.where("u <> v").distinct()
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        after = staged(small.where("u <> v").distinct(), label)
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(now)
        now = after
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError("components: no fixed point")
    least = now.groupBy("v").agg(F.min("u").alias("component"))
    return least.select(F.col("v").alias("node"), "component").union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
