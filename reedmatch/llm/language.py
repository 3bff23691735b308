"""Language identification by error-correcting output codes.

Each language has a codeword of +-1 bits; for each bit a binary classifier tells the languages with +1 from
those with -1. A classifier is a table of log-odds of hashed byte n-grams (2 to 4 bytes of the lower-cased
text, everything but letters a space): each side is the mean of its languages' distributions, so
frequent languages don't drown rare ones. Its answer is the mean over all n-grams of a text, scaled by a
logistic fit on texts that the tables haven't seen.

Decoding is loss-weighted: a language's distance is the logistic loss of its bits, each weighted by how
often that bit's classifier was right on that language. The nearest codeword wins (ties: the smaller name);
`ambiguous` flags a text whose second-nearest is about as near, or whose hard bits differ from the
codeword by more than the code can correct.

Fitted on at most `most_rows` documents of each language (least hashes of doc_id); tables and distances
are made in tasks, of which the driver gets one table for each language and a few numbers for each document of
the sample. Prediction is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import map_batches, map_stream, partitions, small, staged

MOST_ROWS, BUCKETS, ORDERS, UNKNOWN = 3000, 1 << 16, (2, 3, 4), "und"
PIECE = 1 << 20  # bytes of a text looked at together
CLEAR = 0.2  # least difference of the two best shares of a text that isn't ambiguous
#: Lower-cases ASCII; what is neither a letter nor part of a longer character becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def folded(text: str) -> np.ndarray:
    """Bytes of a text: lower-cased, runs of spaces as one, a space at both ends."""
    data = text if text.isascii() else text.lower()
    raw = np.frombuffer(b" " + data.encode("utf-8", "replace").translate(FOLD) + b" ", np.uint8)
    space = raw == 32
    return raw[np.concatenate(([True], ~(space[1:] & space[:-1])))]


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, a bounded piece at a time."""
    data = folded(text or "")
    for begin in range(0, max(len(data) - 1, 0), PIECE):
        b = data[begin : begin + PIECE + max(ORDERS) - 1].astype(np.uint32)
        value, out = b, []
        for n in range(2, max(ORDERS) + 1):
            value = (value[:-1] << np.uint32(8)) | b[n - 1 :]
            if n in ORDERS:
                fresh = value[: max(0, min(len(value), PIECE))]
                out.append((fresh * np.uint32(MULTIPLIERS[n])) >> np.uint32(16))
        yield np.concatenate(out)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +-1 bits for each of n languages. Up to 5: all ways to part them, so that two rows differ in
    2**(n - 2) bits. More: of 50 random codes that with the greatest least distance between rows."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        ways = [[1, *((way >> k) & 1 for k in range(n - 1))] for way in range(2 ** (n - 1) - 1)]
        return np.array(ways, np.int8).T * 2 - 1
    bits, best, found = math.ceil(12 * math.log2(n)), -1, None
    rng = np.random.default_rng([seed, n])
    for _ in range(50):
        code = np.where(rng.random((n, bits)) < 0.5, -1, 1).astype(np.int8)
        same = code.astype(np.int32) @ code.T
        least = (bits - np.max(same - (2 * bits) * np.eye(n, dtype=np.int32))) // 2
        if least > best and (np.abs(code.sum(0)) < n).all():
            best, found = least, code
    return found


@dataclass(frozen=True)
class Codes:
    """Languages, their codewords, the tables of the bits (BUCKETS, bits), scale and offset of each bit, and
    the weight of each language's bits (rows sum to 1)."""

    languages: list[str]
    words: np.ndarray
    tables: np.ndarray
    scale: np.ndarray
    offset: np.ndarray
    weights: np.ndarray

    def answers(self, text: str | None) -> np.ndarray:
        """Mean log-odds of each bit."""
        total, n = np.zeros(self.words.shape[1]), 0
        for grams in ngrams(text):
            counts = np.bincount(grams, minlength=BUCKETS)
            some = np.flatnonzero(counts)
            total += counts[some] @ self.tables[some]
            n += len(grams)
        return total / max(n, 1)

    def decoded(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the languages, scores from 0 to 1, ambiguous) for rows of answers."""
        if len(self.languages) == 1:
            return np.zeros(len(answers), int), np.ones(len(answers)), np.zeros(len(answers), bool)
        margin = answers * self.scale + self.offset
        loss = np.logaddexp(0, -margin[:, None, :] * self.words[None])
        distance = (loss * self.weights[None]).sum(2)
        share = np.exp(-(distance - distance.min(1, keepdims=True)) * min(self.words.shape[1], 8))
        share /= share.sum(1, keepdims=True)
        best = distance.argmin(1)  # languages are in order of their names
        ranked = np.sort(share, 1)
        wrong = (np.where(margin >= 0, 1, -1) != self.words[best]).sum(1)
        apart = min(int((a != b).sum()) for i, a in enumerate(self.words) for b in self.words[:i])
        unsure = (ranked[:, -1] - ranked[:, -2] < CLEAR) | (wrong > (apart - 1) // 2)
        return best, ranked[:, -1], unsure


def held_out() -> F.Column:
    """crc32 of doc_id as text, modulo 3, is 1; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def sample(docs: DataFrame, most_rows: int) -> DataFrame:
    """Staged (lang, text, h) of at most most_rows doc_ids of each language, those with the least hashes; of rows with one
    doc_id and language the least text.

    Hashes are uniform, so a bound that about one and a half times as many ids stay below follows from the number of
    ids; what is below it is combined by id before the shuffle, and only that is ranked."""
    usable = docs.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"), held_out().alias("out")).where("not out and lang is not null and text is not null")
    share = 1.5 * most_rows / F.greatest(F.approx_count_distinct("h"), F.lit(1))
    bound = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    bounds = staged(usable.groupBy("lang").agg(bound.alias("bound")), "language-bounds")
    near = usable.join(small(bounds, 100_000), "lang").where("h <= bound").groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = staged(near, "language-near").withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    return staged(ranked.where(F.col("nth") <= most_rows).select("lang", "text", "h"), "language-sample")


def fit(docs: DataFrame, most_rows: int = MOST_ROWS) -> Codes | None:
    """Codes learned from documents (doc_id, text, lang) that aren't held out; None without any."""
    rows = sample(docs, most_rows)
    spark = docs.sparkSession
    tables = F.pmod(F.shiftright(F.col("h"), 3), F.lit(3)) < 2  # two thirds for the tables, the rest to calibrate

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang = lang.as_py()
                if lang != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([now]), pa.array([counts.astype("<i8").tobytes()])], ["lang", "counts"])
                    now, counts = lang, np.zeros(BUCKETS, np.int64)
                for grams in ngrams(text.as_py()):
                    counts += np.bincount(grams, minlength=BUCKETS)
        if now is not None:
            yield pa.record_batch([pa.array([now]), pa.array([counts.astype("<i8").tobytes()])], ["lang", "counts"])

    def tables_of(part: DataFrame) -> dict[str, np.ndarray]:
        by_language = part.select("lang", "text").repartition(partitions(spark), "lang").sortWithinPartitions("lang")
        return {r["lang"]: np.frombuffer(r["counts"], "<i8") for r in map_stream(by_language, count, "lang string, counts binary").collect()}  # one row for each language

    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    counts = tables_of(rows.where(tables))
    if len(counts) < len(languages):  # a language with a few documents: they serve for both
        counts = tables_of(rows)
    grams = np.array([counts.get(name, np.zeros(BUCKETS)) for name in languages]) + 0.5
    smooth = grams / grams.sum(1, keepdims=True)
    words = codewords(len(languages))
    bits = words.shape[1]
    log_odds = np.stack([np.log(smooth[words[:, k] > 0].mean(0)) - np.log(smooth[words[:, k] < 0].mean(0)) for k in range(bits)], 1) if bits else np.zeros((BUCKETS, 0))
    codes = Codes(languages, words, log_odds.astype(np.float32), np.ones(bits), np.zeros(bits), np.full((len(languages), bits), 1 / max(bits, 1)))
    if not bits:
        return codes
    shared = spark.sparkContext.broadcast(codes)  # BUCKETS * bits numbers

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [shared.value.answers(t.as_py()).tolist() for t in batch.column("text")]
        return pa.record_batch([batch.column("lang"), pa.array(out, pa.list_(pa.float64()))], ["lang", "answers"])

    unseen = rows.where(~tables)
    held = map_batches(unseen.select("lang", "text"), answer, "lang string, answers array<double>").collect()  # at most most_rows of each language
    if {r["lang"] for r in held} != set(languages):
        held = map_batches(rows.select("lang", "text"), answer, "lang string, answers array<double>").collect()
    x = np.array([r["answers"] for r in held])
    where = np.array([languages.index(r["lang"]) for r in held])
    scale, offset, right = np.empty(bits), np.empty(bits), np.empty((len(languages), bits))
    balance = 1 / np.bincount(where, minlength=len(languages))[where]
    for k in range(bits):
        y = words[where, k] > 0
        scale[k], offset[k] = logistic(x[:, k], y, np.where(y, balance / balance[y].sum(), balance / balance[~y].sum()))
        hit = (x[:, k] * scale[k] + offset[k] >= 0) == y
        right[:, k] = np.bincount(where, hit, len(languages)) / np.bincount(where, minlength=len(languages))
    right = np.maximum(right, 1e-3)
    return Codes(languages, words, codes.tables, scale, offset, right / right.sum(1, keepdims=True))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Scale and offset of a logistic fit of y by one number, by Newton's method, with a small penalty so that
    they stay finite where the sides are apart."""
    spread = float(np.std(x)) or 1.0
    z, w = np.stack([x / spread, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])


def predicted(docs: DataFrame, codes: Codes | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for each row.

    A null text or one without a letter is `und` with score 0, not ambiguous; so is every text where
    nothing was learned. Texts may be of any length and are read whole; equal texts get equal answers;
    repeated rows stay; a null doc_id stays null and counts as empty text for held_out. Columns other than
    doc_id and text are never read here; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = shared.value
        n = batch.num_rows
        names, score, unsure = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        at, answers = [], []
        for k, text in enumerate(batch.column("text")):
            text = text.as_py()
            if codes is not None and has_letter(text):
                at.append(k)
                answers.append(codes.answers(text))
        if at:
            best, share, flags = codes.decoded(np.array(answers).reshape(len(at), -1))
            score[at], unsure[at] = share, flags
            for k, b in zip(at, best):
                names[k] = codes.languages[b]
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
