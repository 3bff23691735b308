"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of documents. `run` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reedmatch.llm import line_dedup, minhash, mixing, packing, quality
from reedmatch.llm.common import staged_alone, table
from reedmatch.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the trees, fitted on this input's labels, keep.

    Null and empty texts have no words and go; texts of any length are read whole; repeated rows
    are judged alike; a null doc_id is judged by its text; labels without a document are ignored. An
    empty table gives an empty one. Columns beyond those of documents are dropped.
    """
    trees = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs.select(COLUMNS), trees).where("kept").select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three-line windows repeat; a document that loses every line goes.

    Null texts and texts without a line stay as they are; repeated rows are one document and keep
    their lines; of equal windows the first by (doc_id, line) stays, a null doc_id coming first. Texts
    may be of any length and an empty table gives an empty one. n_chars is counted anew.
    """
    out = line_dedup.dedup(docs.select(COLUMNS)).where("n_removed < n_lines or n_lines = 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 or more: that with the smallest doc_id.

    Rows repeated with one doc_id and text become one; one id on several texts counts as several
    documents, of which a group keeps one; a null doc_id takes part and yields to any other. Null and
    empty texts link with nothing, and stay once for each doc_id. Texts may be of any length; an empty
    table gives an empty one.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("__t"))
    verdict = minhash.near_components(docs, percent=80).where("chosen").select(F.col("doc_id").alias("__id"), F.col("t").alias("__h")).distinct()
    kept = rows.join(verdict, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__t"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources weigh the square root of their counts.

    Copies of a document keep its doc_id, and rows repeated with one doc_id get one count each. Null and
    empty sources are one source; null and empty texts are copied like others; a null doc_id is hashed as
    empty. Texts may be of any length; an empty table gives an empty one.
    """
    return mixing.mix(docs.select(COLUMNS), power=0.5, seed=17).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents along the space-filling curve in sequences of 4096 ids.

    Null and empty texts have their end id alone; repeated rows are separate documents with equal
    keys, so neighbours on the curve; a null doc_id stays null. A text of any length is cut over
    sequences; an empty table has no pieces; columns other than doc_id and text are ignored.
    """
    pieces = packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2, size=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL has no way to fit the trees or to apply the tokenizer; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
