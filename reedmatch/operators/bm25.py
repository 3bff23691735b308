"""BM25 over a corpus of items (columns: idx, title, text), statistics always after the filter.

Rankings read the items' texts once, or a written index (`index.py`) and there only the terms of the bags.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.staging import broadcast_if_small, staged
from . import index as indexes
from .index import Index
from .terms import averages, corpus, entries, idf, lengths, postings, term_idf

__all__ = ["averages", "corpus", "entries", "idf", "lengths", "postings", "term_idf", "scores", "statistics", "top", "top_of_many", "top_by_bounds", "kept", "read_index", "write_index"]
K1, B, TITLE_BOOST = 1.5, 0.75, 1.6


def write_index(items: DataFrame, folder: str, **layout: int) -> None:
    indexes.write(items, folder, **layout)


def read_index(spark: SparkSession, folder: str) -> Index:
    return indexes.read(spark, folder)


def kept(items: DataFrame, column: str, allowed: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """Items whose column is among the allowed values; none allowed means no filter, and null is no value."""
    return items.where(F.col(column).isin(list(allowed))) if allowed else items


def statistics(index: Index | DataFrame) -> DataFrame:
    """One row: n and avg_len, over all items of an index or of entries."""
    return index.statistics() if isinstance(index, Index) else averages(index.where("term is null"))


@dataclass(frozen=True)
class Hits:
    """What the bags' terms match: rows (idx, dl, term, tf, in_title), staged, and statistics of all items."""

    rows: DataFrame
    statistics: DataFrame


def hits_of(items: DataFrame, bags: DataFrame) -> Hits:
    """From one pass over the items' texts."""
    found = staged(entries(items, bags), "hits")
    return Hits(found.where("term is not null"), statistics(found))


def gain(w: Column, tf: Column, dl: Column, avg_len: Column, in_title: Column) -> Column:
    """What a term adds to an item's score; w: its weight in the bag times its idf."""
    return w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_len)) * F.when(in_title, TITLE_BOOST).otherwise(1.0)


def weighted(bags: DataFrame, df: DataFrame, statistics: DataFrame) -> DataFrame:
    """profile, term, w, avg_len of the bags' terms that occur."""
    rows = bags.join(df, "term").crossJoin(F.broadcast(statistics))  # one row
    return rows.select("profile", "term", (F.col("qw") * idf(F.col("df"), F.col("n"))).alias("w"), "avg_len")


def scores(hits: Hits, bags: DataFrame) -> DataFrame:
    """profile, idx, score for the items with a term of a bag (profile, term, qw)."""
    weights = weighted(bags, hits.rows.groupBy("term").agg(F.count("*").alias("df")), hits.statistics)
    return _scored(hits.rows, weights)


def _scored(hits: DataFrame, weights: DataFrame) -> DataFrame:
    rows = hits.join(weights, "term")
    return rows.groupBy("profile", "idx").agg(F.sum(gain(F.col("w"), F.col("tf"), F.col("dl"), F.col("avg_len"), F.col("in_title"))).alias("score"))


def _from_index(index: Index, bags: DataFrame, lists_only: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """(postings of the bags' terms, or their lists, their weights, whether the bags are empty). Bags of few terms come to the driver once and
    are then constants of the plan, their weights broadcast; frequencies of one segment come from the numbers beside the postings,
    those of several from the postings, which are staged to be read and told from replaced ones once."""

    def found(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        if lists_only:
            return lists, index.frequencies(lists)
        if len(index.parts) < 2:
            return index.postings(lists), index.frequencies(lists)
        hits = staged(index.postings(lists), "hits")
        return hits, hits.groupBy("term").agg(F.count("*").alias("df"))

    few = bags.select("profile", "term", "qw", F.xxhash64("term").alias("h")).limit(indexes.MOST_TERMS + 1).collect()
    if len(few) > indexes.MOST_TERMS:
        bags = staged(bags.select("profile", "term", "qw"), "bags")
        rows, df = found(index.lists(bags))
        return rows, broadcast_if_small(staged(weighted(bags, df, index.statistics()), "weights")), False
    rows, df = found(index.lists(bags, {r["term"]: r["h"] for r in few if r["term"] is not None}))
    kinds = f"profile {bags.schema['profile'].dataType.simpleString()}, term string, qw double"
    bags = F.broadcast(index.spark.createDataFrame([(r["profile"], r["term"], float(r["qw"])) for r in few], kinds))
    return rows, F.broadcast(weighted(bags, df, index.statistics())), not few


def top(items: DataFrame, bag: DataFrame, width: int, index: Index | None = None) -> DataFrame:
    """idx and score of the best `width` items for one bag (term, qw); ties keep corpus order.
    width <= 0: all items with score 0; an empty bag: the first `width` items with score 0.

    The items' texts are read once, when this is called (none of them if there is an index), and only what
    the bag's terms match is staged."""
    zero = (items if index is None else index.documents()).select("idx", F.lit(0.0).alias("score"))
    if width <= 0:
        return zero
    bag = bag.select(F.lit(0).alias("profile"), "term", "qw")
    if index is not None:
        rows, weights, empty = _from_index(index, bag)
        return zero.orderBy("idx").limit(width) if empty else _best(_scored(rows, weights), width)
    scored = scores(hits_of(items, bag), bag).select("idx", F.round("score", 9).alias("score"))
    return _or_first(scored, zero, bag, width)


def _best(scored: DataFrame, width: int) -> DataFrame:
    return scored.select("idx", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "idx").limit(width)


def _or_first(ranked: DataFrame, zero: DataFrame, bag: DataFrame, width: int) -> DataFrame:
    empty = bag.agg(F.count("*").alias("n")).where("n = 0").select()  # one row or none
    first = zero.orderBy("idx").limit(width).crossJoin(F.broadcast(empty))
    return ranked.union(first).orderBy(F.desc("score"), "idx").limit(width)


def top_by_bounds(index: Index, bag: DataFrame, width: int, seeds: int = 64) -> tuple[DataFrame, int, int]:
    """(the rows of `top`, posting lists of the bag's terms, those of them that were read).

    The numbers beside the postings bound what a block of items can score. The `seeds` blocks with the
    greatest bounds are scored first; the score of their width-th item is the threshold, and of the other
    blocks only those whose bound reaches it are read. A block below it can't hold any of the best, ties included."""
    if width <= 0:
        return top(None, bag, width, index), 0, 0
    lists, weights, empty = _from_index(index, bag.select(F.lit(0).alias("profile"), "term", "qw"), lists_only=True)
    if empty:
        return top(None, bag, width, index), 0, 0
    weights = broadcast_if_small(staged(weights, "weights"))  # as many rows as the bag has terms
    blocks = ["segment", "block"]
    most = gain(F.col("w"), F.col("max_tf"), F.col("min_dl"), F.col("avg_len"), F.col("any_title"))
    about = lists.select(*blocks, "term", "max_tf", "min_dl", "any_title").join(weights, "term")
    bounds = staged(about.groupBy(*blocks).agg(F.sum(most).alias("bound"), F.count("*").alias("n_lists")), "bounds")

    def scored(some: DataFrame) -> DataFrame:
        return _scored(index.postings(lists.join(some.select(*blocks), blocks, "left_semi")), weights)

    first = F.broadcast(bounds.orderBy(F.desc("bound"), *blocks).limit(seeds))
    best = [r["score"] for r in _best(scored(first), width).collect()]  # width numbers
    least = best[-1] - 1e-6 if len(best) == width else float("-inf")
    wanted = staged(bounds.where(F.col("bound") >= least), "blocks-read")
    count = lambda df: df.agg(F.sum("n_lists")).first()[0] or 0
    return _best(scored(broadcast_if_small(wanted)), width), count(bounds), count(wanted)


def top_of_many(items: DataFrame, bags: DataFrame, width: int, index: Index | None = None) -> DataFrame:
    """profile, idx, score, rank_no of the best `width` items for each bag."""
    if index is None:
        # hits of an item lie together before each of them becomes a row for every profile with its term: sums need no further shuffle
        hits = hits_of(items, bags)
        frequencies = hits.rows.groupBy("term").agg(F.count("*").alias("df"))
        weights = broadcast_if_small(staged(weighted(bags, frequencies, hits.statistics), "weights"))
        scored = _scored(hits.rows.repartition("idx"), weights)
    else:
        rows, weights, _ = _from_index(index, bags)
        scored = _scored(rows, weights)
    order = W.partitionBy("profile").orderBy(F.desc("score"), "idx")
    ranked = scored.withColumn("score", F.round("score", 9)).withColumn("rank_no", F.row_number().over(order))
    return ranked.where(F.col("rank_no") <= width)
