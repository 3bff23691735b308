"""Language ID, centroid clustering and the prefix trie against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedmatch.llm import centroids, language, prefix_trie

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ka ro mi ta", "bb": "sch ein der und", "cc": "que los ció", "dd": "eau oui ère"}


def prose(lang, seed, words=40):
    rng = np.random.default_rng([seed, sum(map(ord, lang))])
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(words))


def corpus(spark, n=240, languages=tuple(SYLLABLES)):
    rows = [(k, prose(languages[k % len(languages)], k), languages[k % len(languages)], "s", 0) for k in range(n)]
    return spark.createDataFrame(rows, COLUMNS), rows


def clashing(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_languages_held_out(spark):
    docs, rows = corpus(spark)
    odd = [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 !? 34", "bb", "s", 0), (None, prose("bb", 1), None, "s", 0), (904, prose("cc", 7, 30_000), None, None, 0), (905, "ж", "aa", "s", 0), (1, rows[1][1], "bb", "s", 0)]
    docs = clashing(docs.union(spark.createDataFrame(odd, COLUMNS)), "h", "out", "nth", "last", "score", "held_out", "answers")
    codes = language.fit(docs.select("doc_id", "text", "lang"))
    assert codes.languages == sorted(SYLLABLES) and codes.words.shape == (4, 7)
    got = language.predicted(docs, codes).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
    assert all(by_id[i][0]["lang_pred"] == lang for i, _, lang, _, _ in rows)
    assert [by_id[i][0]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by_id[None][0]["lang_pred"] == "bb" and by_id[904][0]["lang_pred"] == "cc"
    assert by_id[905][0]["lang_pred"] in SYLLABLES and len({tuple(r) for r in by_id[1]}) == 1 and len(by_id[1]) == 2


def test_sample_is_bounded(spark):
    docs, rows = corpus(spark, 400)
    hot = spark.range(600).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("hot "), F.col("id").cast("string")).alias("text"), F.lit("dd").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    got = language.sample(docs.union(hot).union(docs), 20).collect()
    by = defaultdict(list)
    for r in got:
        by[r["lang"]].append(r["h"])
    assert set(by) == set(SYLLABLES) and all(len(v) == len(set(v)) == 20 for v in by.values())
    everything = language.sample(docs.union(hot), 10_000).groupBy("lang").count().collect()
    ids = defaultdict(set)
    for i, _, lang, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            ids[lang].add(i)
    assert {r["lang"]: r["count"] for r in everything} == {k: len(v) for k, v in ids.items()}


def test_held_out_labels_are_never_read(spark):
    docs, _ = corpus(spark, 120)
    wrong = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (language.fit(d.select("doc_id", "text", "lang")) for d in (docs, wrong))
    assert a.languages == b.languages and (a.tables == b.tables).all() and (a.weights == b.weights).all()


def test_few_languages_and_none(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert language.fit(none) is None and language.predicted(none, None).count() == 0
    docs, _ = corpus(spark, 9, ("aa",))
    assert language.predicted(docs, None).select("lang_pred").distinct().first()[0] == "und"
    codes = language.fit(docs)
    assert {(r["lang_pred"], r["score"]) for r in language.predicted(docs, codes).collect()} == {("aa", 1.0)}
    docs, rows = corpus(spark, 12, ("aa", "bb"))  # too few for a part of their own
    got = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs, language.fit(docs)).collect()}
    assert got == {i: lang for i, _, lang, _, _ in rows}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9, 40])
def test_codewords_are_apart(n):
    words = language.codewords(n)
    least = min(int((a != b).sum()) for i, a in enumerate(words) for b in words[:i])
    assert least >= (2 ** (n - 2) if n <= 5 else max(3, words.shape[1] // 4))
    if n > 5:  # one wrong bit doesn't change the answer
        codes = language.Codes([f"{k:02}" for k in range(n)], words, None, np.ones(words.shape[1]), np.zeros(words.shape[1]), np.full(words.shape, 1 / words.shape[1]))
        answers = words * 3.0
        answers[:, 2] *= -1
        best, _, unsure = codes.decoded(answers)
        assert (best == np.arange(n)).all() and not unsure.any()
        assert codes.decoded(np.zeros((1, words.shape[1])))[2].all()


def test_pieces_of_a_text_count_alike(monkeypatch):
    text = prose("dd", 3, 500) + " ÀÉ 12 -- X"
    whole = np.bincount(np.concatenate(list(language.ngrams(text))), minlength=language.BUCKETS)
    monkeypatch.setattr(language, "PIECE", 37)
    parts = np.bincount(np.concatenate(list(language.ngrams(text))), minlength=language.BUCKETS)
    assert (whole == parts).all()


def brute_clusters(rows, k, rounds, seed):
    kept = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())[:k]
    x, c = np.array([v for _, v in kept]), np.array([v for _, v in first])
    for _ in range(rounds):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([np.floor_divide(x[at == j].sum(0), (at == j).sum()) if (at == j).any() else c[j] for j in range(len(c))])
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    at, d = d.argmin(1), d.min(1)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted((i, int(a), int(e), int(d[at == a].sum()), int(d.sum()), sha[a]) for (i, _), a, e in zip(kept, at, d))


def vectors(spark, rows):
    return clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int"), "coefs", "cluster", "n", "c", "distance")


@pytest.mark.parametrize("kind", ["spread", "grouped", "ties", "wide"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "spread":
        x = rng.normal(0, 0.1, (150, 64))
    elif kind == "wide":  # some beyond what 64 times a squared distance leaves in 64 bits
        x = rng.normal(0, 1, (150, 64)) * np.where(np.arange(150) % 10 == 0, 20_000, 1)[:, None]
    elif kind == "grouped":
        x = np.repeat(rng.normal(0, 3, (5, 64)), 30, 0) + rng.normal(0, 0.01, (150, 64))
    else:
        x = np.repeat(rng.integers(-1, 2, (3, 64)).astype(float), 20, 0)
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(x)]
    rows += [(500, None), (501, []), (502, [0.5] * 63), (503, [None] + [0.5] * 63), (504, [float("nan")] * 64), (505, [float("inf")] * 64)]
    got = sorted(tuple(r) for r in centroids.clustered(vectors(spark, rows), 8, 4).collect())
    assert got == brute_clusters(rows, 8, 4, 3)


def test_few_vectors_and_none(spark):
    rows = [(None, [1.0] * 64), (7, [2.0] * 64), (7, [2.0] * 64), (8, [1e30] * 64)]
    got = centroids.clustered(vectors(spark, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["7", "7", "None"] and {r["inertia"] for r in got} == {0}
    assert centroids.clustered(vectors(spark, rows[3:])).count() == 0
    far = centroids.clustered(vectors(spark, [(1, [1e12] * 64), (2, [-1e12] * 64), (3, [1e12] * 64)]), 1, 1).collect()
    assert sorted((r["vec_id"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in far) == [(k, None, None, None) for k in (1, 2, 3)]


def test_search_is_exact_and_leaves_out_worse_centroids():
    rng = np.random.default_rng(0)
    c = rng.integers(-20_000, 20_000, (16, 64))
    x = c[rng.integers(0, 16, 400)] + rng.integers(-50, 50, (400, 64))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (centroids.transformed(x) == x @ centroids.hadamard().T).all()
    at, distance, taken = centroids.nearest(centroids.transformed(x), centroids.transformed(c))
    assert (at == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert taken < 0.25 * 400 * 16 * 64
    wide = np.array([[centroids.MOST] * 64, [-centroids.MOST] * 64])
    at, distance, _ = centroids.nearest(centroids.transformed(wide), centroids.transformed(wide[:1]))
    assert distance.tolist() == [0, 64 * (2 * centroids.MOST) ** 2]


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    seq = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = seq.get(c - c % 100, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        s = tuple(built[c])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        kids = sum(len(q) == len(p) + 1 for q in below)
        sha = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids, len(childless), saved, sha))
    return sorted(out, key=str)


def conversations():
    rng = np.random.default_rng(2)
    rows = []
    for c in [0, 1, 2, 3, 5, 8, 99, 100, 101, 150, 199, 200, *range(300, 330), 405]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ("user", "assistant")[t % 2], f"text {rng.integers(0, 2)}" * int(rng.integers(1, 3))))
    rows += [(500 + k, t, "user", "same") for k in range(12) for t in range(7)]  # copies
    rows += [(700, None, None, None), (700, 3, "user", ""), (700, 4, None, "x" * 50_000), (None, 1, "user", "y")]
    rows += [(801, 0, "user", "once"), (802, 0, "user", "once"), (802, 1, "user", "twice"), (803, 0, "user", "once")]
    return rows + rows[:3]  # repeated rows


@pytest.mark.parametrize("limit", [1, 3, 2000])
def test_trie(spark, limit):
    rows = conversations()
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "d", "a", "n", "unit", "cm", "h1")
    assert sorted((tuple(r) for r in prefix_trie.trie(turns, limit).collect()), key=str) == brute_trie(rows)


def test_tries_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, 0, "user", "a")], [(0, 0, "user", "a")], [(7, t, "user", "a") for t in range(9)], [(c, 0, "u", "a") for c in (100, 101)]):
        got = prefix_trie.trie(spark.createDataFrame(rows, schema), 1).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_parentheses():
    rng = np.random.default_rng(1)
    for n in (1, 40, 3000):
        seq, depth, left = [], 0, n
        while left or depth:
            up = left and (depth == 0 or rng.random() < 0.6)
            seq.append(bool(up))
            left, depth = left - bool(up), depth + (1 if up else -1)
        stack, close = [], {}
        for i, x in enumerate(seq):
            if x:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = prefix_trie.Parentheses(np.array(seq))
        at = np.array(sorted(close))
        assert (tree.findclose(at) == [close[i] for i in at]).all()
        assert tree.rank[-1] == sum(a and not b for a, b in zip(seq, seq[1:]))
    parent = np.arange(-1, 20_000)  # one chain below the other
    leaves, saved = prefix_trie.subtree_totals(parent, np.zeros(20_001, int), np.zeros(20_001, int), np.ones(20_001, int))
    assert (leaves == 1).all() and (saved == 20_001 - np.arange(20_001)).all()
