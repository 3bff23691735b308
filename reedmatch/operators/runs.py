"""A profile build as one run that can be taken up again: cached passages are not read a second time."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from math import ceil

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import content_key
from ..sources.staging import delete, shared_folder, staged
from .calls import Policy, made
from .profile import has_content, merged, percent, shaped

#: Least number of parts of a wave's passages when they are written.
PARTS = 8
#: Up to this many cached keys are broadcast to the passages; beyond, up to so many hashes of the keys that are not cached.
MOST_KEYS, MOST_HASHES = 500_000, 1_000_000
CACHE = "unit_key string, extract string"


def _batches(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path(folder))] if files.exists(path(folder)) else []
    return sorted(f"{folder}/{n}" for n in names if n.startswith("batch-") and files.exists(path(f"{folder}/{n}/_SUCCESS")))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """unit_key and extract of all finished batches; a key that several hold counts once."""
    found = _batches(spark, folder)
    rows = spark.read.schema(CACHE).parquet(*found) if found else spark.createDataFrame([], CACHE)
    return rows.groupBy("unit_key").agg(F.min("extract").alias("extract"))


def append(cache: DataFrame, folder: str, batch: str) -> None:
    """Adds rows (unit_key, extract) as one batch; a batch of the same name is replaced, so a write may be repeated."""
    cache.select("unit_key", "extract").write.mode("overwrite").parquet(f"{folder}/batch-{batch}")


def compact(spark: SparkSession, folder: str) -> None:
    """All batches as one. The old ones go only when it is whole; until then a reader sees keys twice, which count once."""
    old = _batches(spark, folder)
    if len(old) > 1:
        append(read_cache(spark, folder), folder, uuid.uuid4().hex)
        for path in old:
            delete(spark, path)


@dataclass(frozen=True)
class ProfileRun:
    """counters: a row for each profile; extracts: what its passages gave (profile, idx, extract); calls: a row for each
    passage that was read in this run (unit_key, extract, error, kind, tries)."""

    counters: DataFrame
    extracts: DataFrame
    calls: DataFrame

    @cached_property
    def items(self) -> DataFrame:
        """The merged profiles (profile, key, pos, item); merging is some jobs, which run when this is first asked for."""
        return merged(self.extracts)


def warned(n_units: Column, n_failed: Column, n_hits: Column, first_error: Column) -> Column:
    """What to tell of a build; null if all is well."""
    because = F.coalesce(F.concat(F.lit(": "), F.nullif(first_error, F.lit(""))), F.lit(""))
    part = F.concat(n_failed.cast("string"), F.lit(" of "), n_units.cast("string"), F.lit(" passages"))
    return (
        F.when(n_units == 0, F.lit("there is nothing to read"))
        .when((n_failed > 0) & (n_hits == 0), F.concat(F.lit("no profile yet, "), part, F.lit(" failed"), because))
        .when(n_failed > 0, F.concat(part, F.lit(" ("), percent(n_failed, n_units).cast("string"), F.lit("%) failed, so the profile may lack something"), because))
        .when(n_hits == 0, F.lit("nothing usable was found in the documents"))
    )


def build(units: DataFrame, folder: str, extractor: Callable[[str], str], at_once: int = 8, policy: Policy = Policy(), batch: str | None = None, wave: int = 50_000) -> ProfileRun:
    """Profiles of units (profile, idx, text, and request if the extractor reads more than the text).

    Passages whose extract is in the cache under `folder` are not read again; the others are read once for each
    distinct text; extracts with something in them are added to the cache, failed and empty ones are not, so the next
    run reads them again. The union of a profile's extracts is its profile.

    `units` is computed twice, once for the keys and once for the passages that are not cached: texts that are dear to make or
    differ each time should be staged before. Passages are read in waves of about `wave`, each added to the cache when it is
    done: a build that breaks off, or a task that is lost, costs a wave's calls at most."""
    spark = units.sparkSession
    batch = batch or uuid.uuid4().hex
    asked = F.col("request" if "request" in units.columns else "text").alias("request")
    asked = units.select(content_key("text").alias("unit_key"), asked)
    units = staged(units.select("profile", "idx", content_key("text").alias("unit_key")), "units")
    keys = units.select("unit_key").distinct()
    cached = staged(read_cache(spark, folder).join(keys, "unit_key", "left_semi"), "cached")
    n_cached = cached.count()
    n_missing = keys.count() - n_cached
    waves = max(1, ceil(n_missing / wave))
    # as many tasks as there are cores for, each with fewer threads: at_once still bounds the calls; each task gets as many parts
    policy = replace(policy, threads=max(1, min(policy.threads, at_once // min(at_once, spark.sparkContext.defaultParallelism))))
    tasks = max(1, at_once // policy.threads)
    parts = tasks * ceil(PARTS / tasks)
    # written once with a folder for each wave, so that a wave reads its own passages alone; texts are moved once, as
    # cached keys too many to broadcast are dealt with them instead of being joined before. Of a run that is taken up again few
    # keys are not cached: texts without the hash of such a key are not moved at all (a cached key with one is dealt with them)
    path = f"{shared_folder(spark)}/todo-{uuid.uuid4().hex}"
    of_wave, part = F.pmod(F.xxhash64("unit_key"), F.lit(waves)).cast("int"), F.coalesce(F.pmod(F.crc32("unit_key"), F.lit(parts)), F.lit(0)).cast("int")
    known = cached.select("unit_key")
    todo = asked.withColumn("known", F.lit(False))
    if n_cached <= MOST_KEYS:
        todo = todo.join(F.broadcast(known), "unit_key", "left_anti")
    else:
        todo = todo.union(known.select("unit_key", F.lit(None).cast("string"), F.lit(True)))
        if n_missing <= MOST_HASHES:
            hashed = F.xxhash64("unit_key").alias("hash")
            missing = staged(keys.join(known, "unit_key", "left_anti").select(hashed), "missing")
            todo = todo.select("*", hashed).join(F.broadcast(missing), "hash", "left_semi").drop("hash")
    dealt = todo.withColumns({"wave": of_wave, "part": part}).repartition(waves * parts, "wave", "part")
    grouped = dealt.groupBy("wave", "part", "unit_key").agg(F.min("request").alias("request"), F.max("known").alias("known")).where("not known")
    grouped.select("wave", "part", "unit_key", "request").write.partitionBy("wave", "part").parquet(path)
    todo = spark.read.schema("unit_key string, request string, wave int, part int").parquet(path)
    path = f"{shared_folder(spark)}/extracts-{uuid.uuid4().hex}"

    def add(w: int, schema: StructType) -> None:
        mine = spark.read.schema(schema).parquet(f"{path}/{w}")
        append(mine.where(F.col("error").isNull() & has_content(shaped(F.col("extract")))), folder, f"{batch}-{w}")

    # a wave is added to the cache while the calls of the next one run; a build that breaks off adds the last one first
    with ThreadPoolExecutor(1) as beside:
        added = None
        for w in range(waves):
            # its parts are even and follow one another, so putting them together leaves the calls' tasks even
            mine = reduce(DataFrame.union, (todo.where((F.col("wave") == w) & (F.col("part") == k)) for k in range(parts)))
            replies = made(mine, "unit_key", extractor, at_once, policy, True).withColumnRenamed("reply", "extract")
            replies.write.parquet(f"{path}/{w}")
            if added:
                added.result()
            added = beside.submit(inheritable_thread_target(spark)(add), w, replies.schema)
        added.result()
    calls = spark.read.schema(replies.schema).parquet(*(f"{path}/{w}" for w in range(waves)))
    fresh = spark.read.schema(CACHE).parquet(*(f"{folder}/batch-{batch}-{w}" for w in range(waves)))  # told from empty ones when they were added
    known = cached.select("unit_key", "extract", F.lit("cached").alias("how")).union(fresh.withColumn("how", F.lit("fresh")))
    known = staged(known.union(calls.where("error is not null").select("unit_key", F.lit(None).cast("string"), F.lit("failed"))), "known")
    rows = units.join(known, "unit_key", "left").join(calls.where("error is not null").select("unit_key", "error"), "unit_key", "left")
    how = F.col("how")
    counts = rows.groupBy("profile").agg(
        F.count("*").alias("n_units"), F.count_if(how == "cached").alias("n_cached"), F.count_if(how == "failed").alias("n_failed"),
        F.count_if(how.isin("cached", "fresh")).alias("n_hits"), F.min(F.when(how == "failed", F.struct("idx", "error")))["error"].alias("first_error"),
    )
    counts = counts.withColumn("failed_percent", percent(F.col("n_failed"), F.col("n_units")))
    counts = counts.withColumn("warning", warned(F.col("n_units"), F.col("n_failed"), F.col("n_hits"), F.col("first_error")))
    return ProfileRun(counts, rows.where(how.isin("cached", "fresh")).select("profile", "idx", "extract"), calls)
