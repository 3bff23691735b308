"""Line dedup by overlapping three-line windows.

A text's lines with a word in them are numbered; each run of three consecutive ones (compared
without white space at their ends) is a window. Windows are hashed to 128 bits, the first place
of each, by (doc_id, line), is found for the whole corpus, and every line that any later
occurrence covers goes, with the blank lines that follow it. So a line that goes always has an
equal line before it that stays. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

BLANKS = "\x20\t\n\x0b\x0c\r"
#: A line end with the blanks around it, further line ends included; a run of blanks is read once.
ENDS = r"(?<![\x20\x09\x0B-\x0D])[\x20\x09\x0B-\x0D]*+\n[\x20\x09-\x0D]*+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once for each row, however often `then` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trimmed(text: Column) -> Column:
    """A text's lines with a word, without white space at their ends, joined by single line ends."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), ENDS, "\n"), F.lit(BLANKS))


def units(text: Column) -> Column:
    """A text cut before every line with a word: each unit is such a line with the blank ones after it;
    the first unit may be blank lines alone."""
    return F.split(text, r"\n(?=[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D])", -1)


def windows_of(lines: Column) -> Column:
    """array<struct<k, a, b>>: two hashes of each run of three lines, k being the place of the first."""
    both = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x, F.lit(2)).alias("b")))

    def window(h: Column) -> Column:
        three = lambda k, c: F.xxhash64(*(F.get(h, k + j)[c] for j in range(3)))
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda k: F.struct(k.alias("k"), three(k, "a").alias("a"), three(k, "b").alias("b")))

    return let(both, lambda h: F.when(F.size(h) >= 3, window(h)))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places of the array `gone`; linear in its lines."""

    def kept(u: Column) -> Column:
        blank = F.btrim(F.get(u, F.lit(0)), F.lit(BLANKS)) == ""  # blank lines before the first word are no line
        lead = F.when(blank, F.lit(1)).otherwise(F.lit(0))
        stay = F.array_except(F.sequence(F.lit(0), F.size(u) - 1), F.transform(gone, lambda k: k + lead))
        return F.array_join(F.transform(stay, lambda k: F.get(u, k)), "\n")

    return let(units(text), kept)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with their text deduplicated, and columns n_lines (lines with a word) and n_removed.

    Texts with fewer than three lines have no window and stay as they are; null text stays null
    with no lines; a null doc_id orders before all; repeated rows (one doc_id, one text) are one
    document and are treated alike. Blank lines before the first line with a word stay. Extra
    columns are kept, but for those named n_lines or n_removed; so are all rows, and a text may
    become empty.
    """
    base = docs.withColumn("__t", F.xxhash64("text"))
    lines = F.split(trimmed(F.col("text")), "\n", -1)
    found = base.select(F.col("doc_id").alias("d"), F.col("__t").alias("t"), F.explode(windows_of(lines)).alias("w"))
    windows = staged(found.select("d", "t", "w.k", "w.a", "w.b"), "windows")
    # one row for each window and task reaches the shuffle, however often it occurs
    repeated = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "k")).alias("first")).where("n > 1")
    later = windows.join(repeated, ["a", "b"]).where(~F.struct("d", "t", "k").eqNullSafe(F.col("first")))
    covered = later.select(F.col("d").alias("__d"), F.col("t").alias("__h"), F.explode(F.array("k", F.col("k") + 1, F.col("k") + 2)).alias("k")).groupBy("__d", "__h").agg(F.collect_set("k").alias("__gone"))
    joined = base.join(covered, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")), "left")
    whole = trimmed(F.col("text"))
    n_lines = let(whole, lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1))
    return (
        joined.withColumn("n_lines", n_lines.cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("__gone"))))
        .drop("__t", "__gone", "__d", "__h")
    )


ORACLE = r"""
with cut as (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') as h from documents),
w as (select doc_id, h, unnest(generate_series(1, len(h) - 2)) as k from cut where len(h) >= 3),
v as (select doc_id, k, row_number() over (partition by h[k], h[k + 1], h[k + 2] order by doc_id, k) as n from w),
gone as (select distinct doc_id, k + unnest([0, 1, 2]) as k from v where n > 1),
g as (select doc_id, list(k) as ks from gone group by doc_id)
select cut.doc_id, len(h)::bigint as n_lines, coalesce(len(ks), 0)::bigint as n_removed,
  md5(array_to_string(list_filter(h, lambda x, i: ks is null or not list_contains(ks, i)), chr(10))) as kept_md5
from cut left join g using (doc_id)
"""


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the kept lines, trimmed and without blank ones."""
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5(trimmed(F.col("text"))).alias("kept_md5"))
