"""Terms of items (columns: idx, title, text): counts, lengths and statistics, always after the filter."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import STOPWORDS, tokens
from ..sources.staging import broadcast_if_small


def words_of(items: DataFrame) -> DataFrame:
    """idx, words, heads (distinct terms of the title) and dl (number of words, 1 for an item without any)."""
    cut = items.select("idx", tokens("text").alias("words"), F.array_distinct(tokens("title")).alias("heads"))
    return cut.withColumn("dl", F.greatest(F.size("words"), F.lit(1)).cast("long"))


def entries(items: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """idx, dl, term, tf, in_title, from one pass over the items. Each item has a row with a null term. With
    `terms` (term), other terms are left out."""
    # plain strings are exploded: "" stands for the item, a tab marks a term of the title
    heads = F.transform("heads", lambda t: F.concat(F.lit("\t"), t))
    rows = words_of(items).select("idx", "dl", F.explode(F.concat(F.array(F.lit("")), "words", heads)).alias("e"))
    head = F.col("e").startswith("\t")
    rows = rows.select("idx", "dl", F.when(head, F.substring("e", 2, 1 << 30)).when(F.col("e") != "", F.col("e")).alias("term"), F.when(head | (F.col("e") == ""), 0).otherwise(1).alias("n"), head.alias("head"))
    if terms is not None:
        wanted = terms.select("term").distinct().withColumn("wanted", F.lit(True))
        rows = rows.join(broadcast_if_small(wanted), "term", "left").where("term is null or wanted")
    # terms of an item lie together, so they are counted before the shuffle
    counted = rows.groupBy("idx", "dl", "term").agg(F.sum("n").cast("long").alias("tf"), F.max("head").alias("in_title"))
    return counted.where("term is null or tf > 0")


#: An item with its terms: numbers[k] is twice the tf of terms[k], and one more if the title has it; n: how many terms.
COUNTED = "idx long, dl long, n int, terms array<string>, numbers array<int>"
#: The same with the terms as one string, joined by spaces, and the numbers as 32-bit little-endian integers: two values for an item, however many terms it has.
PACKED = "idx long, dl long, n int, terms string, numbers binary"
#: Texts are cut to terms in slices of about this many characters.
SLICE_CHARS = 4 << 20


def counted(items: DataFrame, packed: bool = False) -> DataFrame:
    """COUNTED, or PACKED: the terms of `tokens` for each item, counted where its text lies, so that nothing is shuffled."""
    stop, most = tuple(STOPWORDS), SLICE_CHARS
    kinds = np.zeros(256, np.uint8)  # of the characters of TOKEN: 1 may begin a word, 2 may only go on
    kinds[[ord(c) for c in string.digits + "+#.-"]], kinds[[ord(c) for c in string.ascii_lowercase]] = 2, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(texts: list[str | None]) -> tuple[np.ndarray, pa.StringArray]:
            """The texts' words of three characters at least, and the text of each."""
            low = [x.lower().encode() if x else b"" for x in texts]
            data = np.frombuffer(b" ".join([*low, b""]), np.uint8)
            kind = kinds[data]
            edge = np.diff((kind > 0).view(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            late = np.flatnonzero(kind[begin] != 1)  # such a word begins at its first letter
            letters = np.append(np.flatnonzero(kind == 1), len(kind)) if len(late) else begin
            begin[late] = letters[np.searchsorted(letters, begin[late])]
            size = end - begin
            begin, end, size = begin[size > 2], end[size > 2], size[size > 2]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[begin], inside[end] = 1, -1
            chars = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
            words = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(chars))
            last = np.cumsum([len(x) + 1 for x in low])
            return np.repeat(np.arange(len(low)), np.diff(np.searchsorted(begin, last), prepend=0)), words

        def coded(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
            """The code of each word's term, -1 for a stop word, and the terms; stop words go before dots and hyphens."""
            found = words.dictionary_encode()
            terms = pc.ascii_rtrim(found.dictionary, characters=".-").dictionary_encode()
            stops = pc.is_in(found.dictionary, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)
            codes = np.where(stops, -1, terms.indices.to_numpy()).astype(np.int64)
            return codes[found.indices.to_numpy()], terms.dictionary

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, (row, words), (in_row, heads) = batch.num_rows, cut(batch.column("text").to_pylist()), cut(batch.column("title").to_pylist())
            (code, names), (head, head_names) = coded(words), coded(heads)
            row, code = row[code >= 0], code[code >= 0]
            in_row, head = in_row[head >= 0], head[head >= 0]
            head = pc.fill_null(pc.index_in(head_names, value_set=names), -1).to_numpy().astype(np.int64)[head]
            in_row, head = in_row[head >= 0], head[head >= 0]
            dl, width = np.maximum(np.bincount(row, minlength=n), 1), max(1, len(names))
            keys, tf = np.unique(row * width + code, return_counts=True)
            sizes = np.bincount(keys // width, minlength=n)
            at = np.append(0, np.cumsum(sizes)).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(at), names.take(pa.array(keys % width)))
            numbers = (2 * tf + np.isin(keys, in_row * width + head)).astype("<i4")
            if packed:
                both = [pc.binary_join(terms, " "), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(4 * at), pa.py_buffer(numbers)])]
            else:
                both = [terms, pa.ListArray.from_arrays(pa.array(at), pa.array(numbers))]
            return pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(dl), pa.array(sizes.astype(np.int32)), *both], names=["idx", "dl", "n", "terms", "numbers"])

        for batch in batches:
            ends = np.cumsum(batch.column("chars").to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
                yield part(batch.slice(begin, end - begin))
                begin = end

    rows = items.select(F.col("idx").cast("long").alias("idx"), "title", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return rows.mapInArrow(run, PACKED if packed else COUNTED)


def postings(items: DataFrame) -> DataFrame:
    """idx, term, tf, in_title."""
    return entries(items).where("term is not null").select("idx", "term", "tf", "in_title")


def lengths(items: DataFrame) -> DataFrame:
    """idx and number of terms; 1 for items without a term."""
    return words_of(items).select("idx", "dl")


def averages(lengths: DataFrame) -> DataFrame:
    """One row: n and avg_len of (idx, dl); 1 of each for an empty table."""
    return lengths.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_len"))


def corpus(items: DataFrame) -> DataFrame:
    """One row: n and avg_len, over all items."""
    return averages(lengths(items))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_idf(items: DataFrame) -> DataFrame:
    """term, df, idf: a term counts once for each item, so nothing but terms is shuffled."""
    df = words_of(items).select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = items.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))  # one row
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))
