"""Stages of the pipeline and registered queries against brute force, with odd rows in each."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reedmatch.llm import binary_output, minhash, quality, queries, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS)


def clashing(df):
    for c in ("ids", "node", "k", "t", "a", "b", "n", "start", "kept", "score", "n_copies", "copy_no", "row", "line", "n_tokens", "curve_key", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def prose(k, words=30):
    rng = random.Random(k)
    return " ".join(rng.choice("oak elm ash fir yew bay box fig may nut".split()) + str(rng.randint(0, 400)) for _ in range(words)) + "."


def odd_rows():
    rows = [(k, prose(k), "ab"[k % 2]) for k in range(30)]
    rows += [(100 + k, "### $$ !! " * 15, "a") for k in range(20)]
    rows += [(200, None, "a"), (201, "", None), (None, prose(300), "b"), (202, " ".join(prose(k, 400) for k in range(60)), "b"), (3, prose(3), "b"), (3, prose(3), "b")]
    return rows


def test_quality_rules(spark, tmp_path):
    rows = odd_rows()
    docs = clashing(documents(spark, rows))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 30, 2)] + [(100 + k, 0, 0) for k in range(0, 20, 2)] + [(9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = STAGE["quality_rules"](spark, docs, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    trees = quality.fit_on(docs, labels)
    base, x = quality.statistics([None if t is None else t.encode() for _, t, _ in rows])
    kept = ~quality.base_failed(base) & (trees.score(x) >= trees.keep_from)
    want = Counter((i, t) for (i, t, _), k in zip(rows, kept) if k)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert {k for k in range(30)} | {None} <= {i for i, _ in want} and not {i for i, _ in want} & set(range(100, 202))


def brute_line_dedup(docs):
    """Texts by (doc_id, text) without the lines of repeated three-line windows; a text that loses every line goes."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    seen, out = set(), {}
    for key in order:
        lines = (key[1] or "").split("\n")
        full = [k for k, line in enumerate(lines) if line.strip()]
        gone = set()
        for w in range(len(full) - 2):
            window = tuple(lines[k].strip() for k in full[w : w + 3])
            if window in seen:
                gone.update(full[w : w + 3])
            seen.add(window)
        for a, b in zip(full, [*full[1:], len(lines)]):  # with the blank lines that follow
            if a in gone:
                gone.update(range(a, b))
        left = [line for k, line in enumerate(lines) if k not in gone]
        if key[1] is None or not full or len(gone & set(full)) < len(full):
            out[key] = None if key[1] is None else "\n".join(left)
    return out


def test_line_dedup_stage(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "\n".join(rng.choice(["x", "y", "z", "", " w", "u" + str(k)]) for _ in range(rng.randint(0, 12)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "long line " * 20_000 + "\nx\ny\nz"), (53, "x\ny\nz\nx\ny\nz"), (7, rows[7][1])]
    docs = clashing(documents(spark, [(*r, "s") for r in rows]))
    got = STAGE["line_dedup"](spark, docs, str(tmp_path)).collect()
    want = brute_line_dedup(rows)
    assert {r["doc_id"]: r["text"] for r in got} == {k: v for (k, _), v in want.items()}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert len(got) == sum(r in want for r in rows)


def test_mix_stage(spark, tmp_path):
    rows = odd_rows() + [(400 + k, f"t{k}", "c") for k in range(3)]
    docs = clashing(documents(spark, rows))
    got = STAGE["mix_sources"](spark, docs, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    counts = Counter(s or "" for _, _, s in rows)
    weight = {s: math.sqrt(n) for s, n in counts.items()}
    rate = {s: len(rows) * weight[s] / (n * sum(weight.values())) for s, n in counts.items()}

    def copies(i, s):
        draws = max(1, math.ceil(rate[s] / 16))
        n = 0
        for j in range(1, draws + 1):
            u = int(md5(f"17:{'' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = below = math.exp(-rate[s] / draws)
            k = 0
            while below <= u:
                k += 1
                p *= rate[s] / draws / k
                below += p
            n += k
        return n

    want = Counter()
    for i, t, s in rows:
        want[i, t] += copies(i, s or "")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == +want


def test_pack_stage(spark, tmp_path):
    rows = odd_rows()
    docs = clashing(documents(spark, rows))
    got = STAGE["pack_sequences"](spark, docs, str(tmp_path)).collect()
    lib = tokens.Library(WORD)
    want, pieces = defaultdict(list), defaultdict(list)
    for i, t, _ in rows:
        want[i].append(lib.whole(t or "") + [2])
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for spans in by_sequence.values():  # gapless from 0
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) == -(-sum(len(x) for xs in want.values() for x in xs) // 4096)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, docs_of in want.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, docs_of))
        assert all(any(r["doc_tokens"] == len(x) and r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]]) for x in docs_of) for r in pieces[i])


def test_registered_quality_and_minhash(spark, tmp_path):
    rows = [(k, t, s) for k, (_, t, s) in enumerate(odd_rows())]
    rows += [(500 + k, prose(k, 60) + f" tail{k}", "a") for k in range(3)] + [(510 + k, prose(k, 60) + f" other{k}", "a") for k in range(3)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(30 + k, 0, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    base, _ = quality.statistics([None if t is None else t.encode() for _, t, _ in rows])
    failed = quality.base_failed(base)
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, str(tmp_path)).collect()}
    for k, (i, _, _) in enumerate(rows):
        assert [got[i][c] for c in quality.BASE] == base[k].tolist() and got[i]["base_failed"] == failed[k] and not (failed[k] and got[i]["kept"])
    assert all(got[k]["kept"] for k in range(30)) and not any(got[30 + k]["kept"] for k in range(20))
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op10_minhash(spark, str(tmp_path)).collect()}
    assert got == {i: (len(s), least[i], least[i] == i) for i, s in sets.items()} and sum(a != b for a, b in least.items()) >= 5


def test_files_of_one_id(spark):
    """Rows of one id are cut over tasks and still come back whole, one after the other."""
    rows = [(7, f"text number {k} " * (k % 5 + 1), "s") for k in range(60)] + [(None, "no id", "s")] * 5 + [(8, "x", "s")]
    got = sorted(binary_output.round_trip(documents(spark, rows), BYTE, 2).collect(), key=lambda r: r["start"])
    lib, at = tokens.Library(BYTE), 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [None] * 5 + [7] * 60 + [8]
    crc = lambda t: zlib.crc32(np.array(lib.whole(t) + [2], "<u4").tobytes())
    assert Counter(r["ids_crc32"] for r in got) == Counter(crc(t) for _, t, _ in rows)


def test_band_compare_uses_whole_coordinates(spark):
    sig = minhash.signature(minhash.shingles(b"one two three four five six seven"))
    assert sig.dtype == np.uint32 and sig.max() >= 1 << 16
