"""What reviews found in earlier operators: recall of the cells, very long turns, empty tables, clashing columns."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedmatch.llm import chat, embedding_dedup, line_dedup, mixing, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("skewed", [False, True])
def test_recall_with_production_cells(spark, skewed):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((400, 64))
    if skewed:
        base += 2.0  # mean cosine 0.8
    noise = 0.37 * np.sqrt((base[:300] ** 2).mean(1, keepdims=True)) * rng.standard_normal((300, 64))
    x = np.concatenate([base, base[:300] + noise]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    want = ((u @ u.T) >= 0.93).sum(1) - 1
    for way in ({"bits": 12}, {"exact": True}):  # 12 bits: 57 tables
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_components(df, 0.93, **way).collect()}
        assert want.sum() > 150 and [got[k] for k in range(len(x))] == want.tolist()


def test_labels_that_cells_do_not_divide_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((900, 64)) * 0.2 + 1.0).astype(np.float32)  # one direction
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_components(df, 0.965).collect()}
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    assert [got[k] for k in range(900)] == (((u @ u.T) >= 0.965).sum(1) - 1).tolist()


def test_windows_miss_no_close_pair():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    away = rng.standard_normal((600, 64))
    away -= (away * x).sum(1)[:, None] * x
    away /= np.sqrt((away**2).sum(1))[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * away  # cosine exactly at the bound
    i, j = embedding_dedup.candidates(x, y, embedding_dedup.directions(64), *embedding_dedup.window_and_count(0.93))
    found = set(zip(i.tolist(), j.tolist()))
    assert all((k, k) in found for k in range(600)) and len(found) < 600 * 600 * 0.05


LONG_TURNS = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from reedmatch.llm import chat
s = SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "6m").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
word = F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" "))
turns = s.range(40).select((F.col("id") % 3).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(word, 130_000).alias("text"))
rows = chat.round_trip(turns, {path!r}).collect()
print("TURNS", sum(r["n_turns"] for r in rows), min(r["formatted_chars"] for r in rows) > 8_000_000)
"""


def test_long_turns_never_reach_the_driver():
    """40 turns of about a megabyte with 6 MB of results allowed."""
    code = LONG_TURNS.format(repo=str(Path(__file__).resolve().parents[2]), path=BYTE)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "TURNS 40 True" in out.stdout, out.stderr[-2000:]


def test_turns_of_one_number(spark):
    rows = [(1, 0, "user", t) for t in ("b", "a", "", None, "x" * 70 + "b", "x" * 70 + "a")] + [(1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (chat.round_trip(d, BYTE).first() for d in (df, df.repartition(3).orderBy(F.desc("text"))))
    assert a == b and a["n_turns"] == 7


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert line_dedup.dedup(docs).count() == 0 and line_dedup.digest(docs).count() == 0
    assert chat.round_trip(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), BYTE).count() == 0
    nothing = spark.createDataFrame([], "blob string, kind string, version int, start long, end long")
    paths, ledger, findings = secrets.advanced(docs.select(F.col("doc_id").alias("path"), "text"), nothing.drop("start", "end"), nothing)
    assert paths.count() == ledger.count() == findings.count() == 0


def test_mixing_long_texts_and_clashing_columns(spark):
    rows = [(k, "long " * 400_000 if k == 0 else f"t{k}", "en", "a" if k % 3 else "b", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = Counter(tuple(r) for r in mixing.mix(docs, power=0.5, seed=17).select("doc_id", "copy_no").collect())
    for c in ("n_copies", "copy_no", "shuffle_key", "__source", "__mean"):
        docs = docs.withColumn(c, F.lit(7))
    out = mixing.mix(docs, power=0.5, seed=17)
    assert Counter(tuple(r) for r in out.select("doc_id", "copy_no").collect()) == plain
    assert {r[0] for r in out.where("doc_id = 0").select(F.length("text")).collect()} <= {2_000_000}
