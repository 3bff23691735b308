"""A written index of terms: pruned when read, kept up to date by segments.

A segment is a folder with four tables:

* `items`: its own items, each with its terms and their counts as two values, from which segments are merged.
* `postings`, partitioned by a hash of the term: a row for each term and block of about `block` items (unless given, 512, and
  of shorter ones as many as have some number of words), with the block's postings as two arrays and, beside them, their number,
  the greatest tf, the least length and whether a title holds the term. Items of a block have about the same length. Rows lie sorted by term and block in
  files of about equal numbers of rows, dealt by a hash of the block, so a frequent term, which has many blocks, is spread over files.
* `gone` (idx, dl): the items of earlier segments that this one replaces or deletes.
* `documents` (idx, dl): its own items; written last, so a segment whose writing broke off is not seen.

A change writes a segment of its own and reads no earlier text; `compact` merges all into one. A segment is named
after the changes that it holds, first and last, and a wider one takes the place of those inside it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staging import broadcast_if_small, delete, run, staged
from .terms import PACKED, counted

BLOCK, ROWS_OF_FILE = 512, 400_000
#: A block of short items has more than BLOCK of them, up to about this many words: most lists of a block are short, so larger blocks have fewer rows.
WORDS_OF_BLOCK = 1 << 19
POSTINGS_OF_TASK, POSTINGS_OF_PASS = 2_000_000, 1_000_000
#: Up to this many terms are named in the scan's filters; more are joined.
MOST_TERMS = 2000
#: What a ranking needs to know of a segment before it reads any: its buckets, items and words, and those that it took away.
LAYOUT = "buckets int, n long, words long, n_gone long, words_gone long"
#: A posting list of a term and block: a posting is an idx and, at its place in numbers, dl * 2**32 + 2 * tf, and one more if the title has the term.
LISTS = "term string, block long, n long, max_tf long, min_dl long, any_title boolean, ids array<long>, numbers array<long>"
HITS = "idx long, dl long, term string, tf long, in_title boolean"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def segments(spark: SparkSession, folder: str) -> list[tuple[int, int, str]]:
    """(first change, last change, path) of the live segments in order."""
    files, path = _files(spark, folder)
    found = []
    for status in files.listStatus(path(folder)) if files.exists(path(folder)) else []:
        m = re.fullmatch(r"segment-(\d+)-(\d+)", status.getPath().getName())
        if m and files.exists(path(f"{folder}/{m[0]}/documents/_SUCCESS")):
            found.append((int(m[1]), int(m[2]), f"{folder}/{m[0]}"))
    live: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], -s[1])):
        if not live or s[0] > live[-1][1]:
            live.append(s)
    return live


def lists_of(placed: DataFrame) -> DataFrame:
    """LISTS of items (PACKED) with their block; rows of a block lie together, in order of idx."""
    most_of_pass = POSTINGS_OF_PASS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(t: pa.Table) -> pa.RecordBatch:
            block, dl, idx = (t[c].combine_chunks() for c in ("block", "dl", "idx"))
            block, dl, known = block.to_numpy(), dl.to_numpy(), idx.is_valid().to_numpy(zero_copy_only=False)
            terms = pc.split_pattern(t["terms"].combine_chunks(), " ").flatten().dictionary_encode()
            numbers = np.frombuffer(b"".join(t["numbers"].to_pylist()), "<i4").astype(np.int64)
            row, width = np.repeat(np.arange(len(block)), t["n"].to_numpy()), max(1, len(terms.dictionary))
            key = np.cumsum(np.diff(block, prepend=block[:1]) != 0)[row] * width + terms.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key, row, tf, head = key[order], row[order], numbers[order] >> 1, numbers[order] & 1
            ids, first = idx.fill_null(0).to_numpy()[row], np.ones(len(key), bool)
            same = np.stack([key, ids, dl[row], known[row]])
            first[1:] = (same[:, 1:] != same[:, :-1]).any(0)
            if not first.all():  # an item that is there twice counts once
                at = np.flatnonzero(first)
                key, row, tf, head = key[at], row[at], np.add.reduceat(tf, at), np.maximum.reduceat(head, at)
            at = np.flatnonzero(np.diff(key, prepend=-1))
            ends, size = pa.array(np.append(at, len(key)).astype(np.int32)), dl[row]
            most = (lambda x, f=np.maximum: f.reduceat(x, at)) if len(at) else (lambda x, f=None: x)
            columns = [
                terms.dictionary.take(pa.array(key[at] % width)), pa.array(block[row[at]]), pa.array(np.diff(np.append(at, len(key)))), pa.array(most(tf)), pa.array(most(size, np.minimum)), pa.array(most(head) > 0),
                pa.ListArray.from_arrays(ends, idx.take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(size << 32 | tf << 1 | head)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "max_tf", "min_dl", "any_title", "ids", "numbers"])

        def passes(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole blocks of some postings at a time."""
            ends = np.append(np.flatnonzero(np.diff(t["block"].to_numpy())) + 1, t.num_rows)
            postings, begin = np.cumsum(t["n"].to_numpy())[ends - 1], 0
            for k, end in enumerate(ends):
                if k + 1 == len(ends) or postings[k + 1] - (postings[begin - 1] if begin else 0) > most_of_pass:
                    at = ends[begin - 1] if begin else 0
                    yield made(t.slice(at, end - at))
                    begin = k + 1

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([*held, batch])
                block = t["block"].to_numpy()
                last = int(np.searchsorted(block, block[-1]))  # the last block may go on in the next batch
                if last:
                    yield from passes(t.slice(0, last))
                held = t.slice(last).to_batches()
        if held:
            yield from passes(pa.Table.from_batches(held))

    return placed.mapInArrow(run, LISTS)


def _kept(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """The items (PACKED) of a new segment, written once and read again."""
    items.write.parquet(f"{path}/items")
    return spark.read.schema(PACKED).parquet(f"{path}/items")


def _write(spark: SparkSession, path: str, items: DataFrame, gone: DataFrame, block: int | None, rows_of_file: int) -> None:
    """The rest of a segment whose items (PACKED) are written."""
    documents = staged(items.select("idx", "dl").distinct(), "lengths")
    # lengths within a tenth are one class; a class is dealt to blocks by a hash
    kind = F.floor(F.log(F.col("dl").cast("double")) / math.log(1.1)).cast("int")
    sizes = documents.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy("kind").collect()  # some hundred classes
    begin, rows = 0, []
    for r in sizes:
        blocks = max(1, round(r["n"] / (block or max(BLOCK, WORDS_OF_BLOCK / 1.1 ** r["kind"]))))
        rows.append({"kind": r["kind"], "first": begin, "blocks": blocks})
        begin += blocks
    kinds = pa.schema([("kind", pa.int32()), ("first", pa.int64()), ("blocks", pa.int64())])
    classes = F.broadcast(spark.createDataFrame(pa.Table.from_pylist(rows, kinds)))  # from Arrow, so that no Python worker starts for it
    placed = items.where("n > 0").withColumn("kind", kind).join(classes, "kind").withColumn("block", F.col("first") + F.pmod(F.xxhash64("idx"), "blocks"))
    placed = placed.select("block", "idx", "dl", "n", "terms", "numbers")
    total = items.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0

    def listed(some: DataFrame, postings: float, step: int = 1) -> DataFrame:
        """Blocks go to tasks in turn, so that each has as many of every length."""
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(postings / POSTINGS_OF_TASK))
        return lists_of(some.repartitionById(tasks, F.expr(f"cast(block div {step} % {tasks} as int)")).sortWithinPartitions("block", "idx"))

    # the number of files follows from some blocks, evenly chosen; every list is written
    step = max(1, begin // 24)
    about = step * listed(placed.where(F.col("block") % step == 0), total / step, step).count()
    files = max(1, math.ceil(about / rows_of_file))
    buckets = 1 << max(0, math.ceil(math.log2(files / 4)))  # some files for each
    each = math.ceil(files / buckets)
    by_bucket = listed(placed, total).withColumn("bucket", bucket_of(F.col("term"), buckets))
    dealt = by_bucket.repartitionById(buckets * each, (F.col("bucket") * each + F.pmod(F.xxhash64("block"), F.lit(each))).cast("int"))
    dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    gone.select("idx", "dl").write.parquet(f"{path}/gone")
    sums = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())
    row = (buckets, *sums(documents), *sums(spark.read.schema("idx long, dl long").parquet(f"{path}/gone")))
    spark.createDataFrame([row], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    documents.write.parquet(f"{path}/documents")


def write(items: DataFrame, folder: str, block: int | None = None, rows_of_file: int = ROWS_OF_FILE) -> None:
    """A new index of items in one segment."""
    spark = items.sparkSession
    if segments(spark, folder):
        raise ValueError(f"{folder} holds an index")
    with run(spark):
        path = f"{folder}/segment-1-1"
        _write(spark, path, _kept(spark, path, counted(items, packed=True)), spark.range(0).select(F.col("id").alias("idx"), F.col("id").alias("dl")), block, rows_of_file)


def change(spark: SparkSession, folder: str, items: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
    """Adds items, replaces those with a known idx, and deletes those of `deleted` (idx); an idx in both is replaced.
    An unknown idx to delete is ignored. Of two changes at once the second to begin fails, as its segment's folder is there."""
    index = read(spark, folder)
    last = index.parts[-1].last if index.parts else 0
    with run(spark):
        if items is None:
            items = spark.createDataFrame([], "idx long, title string, text string")
        path = f"{folder}/segment-{last + 1}-{last + 1}"
        found = _kept(spark, path, counted(items, packed=True))
        ids = found.select("idx")
        ids = staged((ids if deleted is None else ids.union(deleted.select("idx"))).distinct(), "changed")
        gone = index.documents().join(ids, "idx", "left_semi")
        _write(spark, path, found, gone, None, ROWS_OF_FILE)


def compact(spark: SparkSession, folder: str, keep: int = 0, block: int | None = None, rows_of_file: int = ROWS_OF_FILE) -> None:
    """Merges all segments but the first `keep` into one and deletes them, so that many small changes need not rewrite a
    large segment before them. Readers of the old ones must be done."""
    parts = read(spark, folder).parts
    earlier, merged = Index(spark, parts[:keep]), Index(spark, parts[keep:])
    if len(merged.parts) < 2:
        return
    with run(spark):
        gone = earlier.documents().join(merged._all("gone", "idx long, dl long").select("idx").distinct(), "idx", "left_semi")
        path = f"{folder}/segment-{merged.parts[0].first}-{merged.parts[-1].last}"
        _write(spark, path, _kept(spark, path, merged.items()), gone, block, rows_of_file)
    for part in merged.parts:
        delete(spark, part.path)


@dataclass(frozen=True)
class Segment:
    first: int
    last: int
    path: str
    buckets: int
    n: int
    words: int
    n_gone: int
    words_gone: int


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    parts: list[Segment]

    def _all(self, table: str, schema: str) -> DataFrame:
        """One table of all segments, with `segment`, the number of its last change."""
        tables = [self.spark.read.schema(schema).parquet(f"{p.path}/{table}").withColumn("segment", F.lit(p.last)) for p in self.parts]
        return reduce(DataFrame.union, tables) if tables else self.spark.createDataFrame([], f"{schema}, segment int")

    def dead(self) -> DataFrame | None:
        """idx and until: of an item that a later segment replaces or deletes, the last such one; None if there is one segment."""
        if len(self.parts) < 2:
            return None
        return self._all("gone", "idx long, dl long").groupBy("idx").agg(F.max("segment").alias("until"))

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows (idx, segment, ...) of items that are in force."""
        dead = self.dead()
        if dead is None:
            return rows
        old = broadcast_if_small(staged(dead, "dead"))
        return rows.join(old, "idx", "left").where("until is null or segment >= until").drop("until")

    def documents(self) -> DataFrame:
        """idx and dl of all items in force."""
        return self.alive(self._all("documents", "idx long, dl long")).select("idx", "dl")

    def items(self) -> DataFrame:
        """PACKED of all items in force."""
        return self.alive(self._all("items", PACKED)).select("idx", "dl", "n", "terms", "numbers")

    def statistics(self) -> DataFrame:
        """One row: n and avg_len, from the sums that each segment keeps."""
        n, words = (sum(getattr(p, c) - getattr(p, f"{c}_gone") for p in self.parts) for c in ("n", "words"))
        return self.spark.range(1).select(F.lit(max(n, 1)).cast("long").alias("n"), F.lit(words / n if n else 1.0).alias("avg_len"))

    def named(self, terms: DataFrame) -> dict[str, int] | None:
        """The distinct terms with their hashes, if there are at most MOST_TERMS."""
        found = terms.select("term", F.xxhash64("term").alias("h")).where("term is not null").distinct().limit(MOST_TERMS + 1).collect()
        return {r["term"]: r["h"] for r in found} if len(found) <= MOST_TERMS else None

    def lists(self, terms: DataFrame | None, few: dict[str, int] | None = None) -> DataFrame:
        """segment and LISTS of the wanted terms (term), of all for None. A few (`named`,
        unless given) are named in the scan, which then reads their buckets and row groups alone; more are joined by
        bucket and term."""
        schema = f"{LISTS}, bucket int"
        out = []
        if few is None and terms is not None:
            few = self.named(terms)
        if few is None and terms is not None:
            terms = staged(terms.select("term").where("term is not null").distinct(), "terms")
        for p in self.parts:
            rows = self.spark.read.schema(schema).parquet(f"{p.path}/postings")
            if few is not None:
                rows = rows.where(F.col("bucket").isin(sorted({h % p.buckets for h in few.values()})) & F.col("term").isin(list(few)))
            elif terms is not None:
                rows = rows.join(broadcast_if_small(terms.withColumn("bucket", bucket_of(F.col("term"), p.buckets))), ["bucket", "term"], "left_semi")
            out.append(rows.drop("bucket").withColumn("segment", F.lit(p.last)))
        return reduce(DataFrame.union, out) if out else self.spark.createDataFrame([], f"{schema}, segment int").drop("bucket")

    def postings(self, lists: DataFrame) -> DataFrame:
        """HITS of lists: the postings of items in force."""
        rows = lists.select("segment", "term", F.explode(F.arrays_zip("ids", "numbers")).alias("p")).select("segment", "term", F.col("p.ids").alias("idx"), F.col("p.numbers").alias("p"))
        p = F.col("p")
        rows = rows.select("segment", "idx", F.shiftright(p, 32).alias("dl"), "term", F.shiftright(p, 1).bitwiseAND((1 << 31) - 1).alias("tf"), (p.bitwiseAND(1) == 1).alias("in_title"))
        return self.alive(rows).select("idx", "dl", "term", "tf", "in_title")

    def hits(self, terms: DataFrame | None) -> DataFrame:
        return self.postings(self.lists(terms))

    def frequencies(self, lists: DataFrame) -> DataFrame:
        """term and df. Of one segment only the numbers beside the postings are read; else also the postings' ids."""
        if len(self.parts) < 2:
            return lists.groupBy("term").agg(F.sum("n").alias("df"))
        rows = lists.select("segment", "term", F.explode("ids").alias("idx"))
        return self.alive(rows).groupBy("term").agg(F.count("*").alias("df"))


def read(spark: SparkSession, folder: str) -> Index:
    """The index as it is now; changes made later are not seen."""
    live = segments(spark, folder)
    if not live:
        return Index(spark, [])
    where = F.regexp_extract(F.input_file_name(), r"/(segment-\d+-\d+)/layout/", 1)
    rows = spark.read.schema(LAYOUT).parquet(*(f"{path}/layout" for _, _, path in live)).select(where.alias("name"), "*").collect()  # one row for each segment
    layouts = {r["name"]: tuple(r)[1:] for r in rows}
    return Index(spark, [Segment(first, last, path, *layouts[f"segment-{first}-{last}"]) for first, last, path in live])
