"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

Statistics of whole texts are made with numpy for a batch of documents at once. The trees are
fitted on a bounded sample of labelled rows (`most_rows`, by a hash of doc_id) with histogram
splits; chosen features may only lower the score as they rise (or only raise it). All trees are
flattened into node arrays, so scoring is a few gathers for each level of each tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, pieces

WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30  # words at least; percent of words in repeated windows at most
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_share",
    "short_share", "long_share", "bar_share", "bang_share", "quote_share", "line_words", "end_share", "same_next_share", "top_share", "lower_start_share", "rare_share",
]
#: -1: a higher value may only lower the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1, "same_next_share": -1, "digit_share": -1}


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in a window of 8 words found twice or more in it.

    Windows are ranked exactly by doubling: a rank for each pair of words, of pairs, of fours."""
    rank, width = ids.astype(np.int64), 1
    while width < WINDOW:
        if len(rank) <= width:
            return np.zeros(n_docs, np.int64)
        pair = rank[:-width] * np.int64(rank.max() + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    same = doc[: len(rank)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(same)
    _, group, counts = np.unique(doc[at] * np.int64(rank.max() + 1) + rank[at], return_inverse=True, return_counts=True)
    steps = np.zeros(len(ids) + 1, np.int64)
    hit = at[counts[group] > 1]
    steps[hit] += 1
    steps[hit + WINDOW] -= 1
    return np.bincount(doc[np.cumsum(steps[:-1]) > 0], minlength=n_docs)


def statistics(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(BASE counts, FEATURES) of UTF-8 texts, a row for each."""
    n = len(texts)
    words = [(t or b"").split() for t in texts]  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    n_words = np.fromiter(map(len, words), np.int64, n)
    flat = [w for ws in words for w in ws]
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    names = list(numbers)
    doc = np.repeat(np.arange(n), n_words)
    base, x = np.zeros((n, len(BASE)), np.int64), np.zeros((n, len(FEATURES)))
    size = np.fromiter((len(w) for w in names), np.int64, len(names))
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in names), np.int64, len(names))
    lower = np.fromiter((w[:1].islower() for w in names), bool, len(names))
    per_doc = lambda v: np.bincount(doc, v[ids], minlength=n)
    base[:, 0] = n_words
    base[:, 1] = per_doc(chars).astype(np.int64) if len(flat) else 0
    base[:, 4] = _repeated(ids, doc, n) if len(flat) else 0
    safe = np.maximum(n_words, 1)
    if len(flat):
        x[:, 9] = per_doc(chars <= 3) / safe
        x[:, 10] = per_doc(chars >= 13) / safe
        x[:, 18] = per_doc(lower) / safe
        key = doc * np.int64(len(names)) + ids
        found, counts = np.unique(key, return_counts=True)
        where = found // len(names)
        x[:, 5] = np.bincount(where, minlength=n) / safe
        most = np.zeros(n, np.int64)
        np.maximum.at(most, where, counts)
        x[:, 17] = most / safe
        x[:, 19] = np.bincount(where[counts == 1], minlength=n) / safe
        nearby = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
        x[:, 16] = np.bincount(doc[1:][nearby], minlength=n) / safe
    del size
    for k, t in enumerate(texts):
        if not t:
            continue
        lines = [line for line in t.split(b"\n") if line and not line.isspace()]
        base[k, 3] = len(lines) - len(set(lines))
        total = max(int(base[k, 1]), 1)
        hist = np.bincount(np.frombuffer(t, np.uint8), minlength=128)
        base[k, 2] = hist[[ord(c) for c in SYMBOLS]].sum()
        x[k, 3] = base[k, 3] / max(len(lines), 1)
        x[k, 6:9] = hist[65:91].sum() / total, hist[48:58].sum() / total, hist[[33, 44, 46, 58, 59, 63]].sum() / total
        x[k, 11:14] = hist[124] / total, hist[33] / total, hist[[34, 39, 61, 64]].sum() / total
        x[k, 14] = n_words[k] / max(len(lines), 1)
        x[k, 15] = sum(line.rstrip()[-1:] in b".?!" for line in lines) / max(len(lines), 1)
    x[:, 0] = np.log1p(n_words)
    x[:, 1] = base[:, 1] / safe
    x[:, 2] = base[:, 2] / np.maximum(base[:, 1], 1)
    x[:, 4] = base[:, 4] / safe
    return base, x


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays: node k sends rows with x[feature] <= threshold to left, else
    to right; leaves point to themselves. `roots` are the first nodes, `keep_from` the least score kept."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float
    keep_from: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 1.0, monotone: dict[str, int] | None = None) -> Trees:
    """Logistic boosting. `monotone` by feature name; a split that breaks a direction is refused and
    the values of both sides are kept on their sides of the middle."""
    signs = np.array([(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, len(cuts)), np.int64)
    p0 = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    start = float(np.log(p0 / (1 - p0)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(feature)
        for column, z in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, v)):
            column.append(z)
        return k

    score = np.full(len(x), start)
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        root = node(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(x)), 0, -np.inf, np.inf)]
        while todo:
            k, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            v = float(np.clip(gs / (hs + ridge), low, high))
            value[k] = rate * v
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and hs >= 2 * least * 0.05:
                for j in range(x.shape[1]):
                    if not len(cuts[j]):
                        continue
                    m = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], m))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], m))[:-1]
                    nl = np.cumsum(np.bincount(code[rows, j], minlength=m))[:-1]
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((gs - gl) / (hs - hl + ridge), low, high)
                    gain = gl * vl - (hl + ridge) * vl**2 / 2 + (gs - gl) * vr - (hs - hl + ridge) * vr**2 / 2 - (gs * v - (hs + ridge) * v**2 / 2)
                    ok = (nl >= least) & (len(rows) - nl >= least) & (signs[j] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (gain[b], j, b, vl[b], vr[b])
            if best[1] < 0:
                score[rows] += value[k]
                continue
            _, j, b, vl, vr = best
            feature[k], threshold[k] = j, cuts[j][b]
            left[k], right[k] = node(0.0), node(0.0)
            goes = code[rows, j] <= b
            middle = (vl + vr) / 2
            lo_l, hi_l, lo_r, hi_r = low, high, low, high
            if signs[j] > 0:
                hi_l, lo_r = middle, middle
            elif signs[j] < 0:
                lo_l, hi_r = middle, middle
            todo.append((left[k], rows[goes], level + 1, lo_l, hi_l))
            todo.append((right[k], rows[~goes], level + 1, lo_r, hi_r))
    keep_from = float(min(0.0, np.quantile(score[y == 1], 0.005))) if (y == 1).any() else -np.inf
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, start, keep_from)


def sampled_statistics(docs: DataFrame, labels: DataFrame, most_rows: int) -> pd.DataFrame:
    """Features and label of at most most_rows labelled documents, those with the least hashes of doc_id."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column("text").to_pylist(), []
        for part in pieces((len(t or b"") for t in texts), 2_000_000):
            out.append(statistics(texts[part])[1])
        x = np.concatenate(out)
        return pa.record_batch([batch.column("doc_id"), batch.column("quality"), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], ["doc_id", "quality", *FEATURES])

    # at most most_rows ids are broadcast
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(F.broadcast(rows), "doc_id")
    found = map_batches(picked.select("doc_id", F.col("quality").cast("int"), "text"), run, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES))
    # a doc_id on many rows could exceed the bound
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most_rows).toPandas()


def fit_on(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> Trees:
    got = sampled_statistics(docs, labels, most_rows).sort_values(FEATURES, ignore_index=True)
    return fit(got[FEATURES].to_numpy(float), (got["quality"] == 1).to_numpy(float))


def judged(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with the BASE counts, base_failed, score and kept.

    Null and empty texts have no words and fail; repeated rows are judged alike; other columns,
    null doc_ids included, are kept as they are, but for those with a result's name. Whole texts
    of any length are read, about 2 MB of text at a time.
    """
    names = [*BASE, "base_failed", "score", "kept"]
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # some thousand nodes
    ready = docs.drop(*names).withColumn("__bytes", F.col("text").cast("binary"))
    keep = [f for f in ready.columns if f != "__bytes"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, base, score = batch.column("__bytes").to_pylist(), [], []
        for part in pieces((len(t or b"") for t in texts), 2_000_000):
            b, x = statistics(texts[part])
            base.append(b)
            score.append(shared.value.score(x))
        b, s = np.concatenate(base), np.concatenate(score)
        failed = base_failed(b)
        new = [*(pa.array(b[:, j]) for j in range(len(BASE))), pa.array(failed), pa.array(s), pa.array(~failed & (s >= shared.value.keep_from))]
        return pa.record_batch([*(batch.column(c) for c in keep), *new], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "__bytes")
    return map_batches(ready, run, f"{schema}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")
