"""Exact token counts at every prefix of every text, by dynamic programming over byte-pair merges.

Inside one pre-token, the last token of a prefix's encoding is the one suffix in the vocabulary
that forms a stable pair with the last token of the encoding before it (a pair is stable if the
library's merges leave its two tokens apart). So the count of a prefix is one more than the
count before that token, and one pass over the places of all new pre-tokens of a batch, with
numpy, gives the counts of all their prefixes. A text's table adds, at every character, the tokens
of the pre-tokens before. The library counts every pre-token too, as a check of the last entry;
short pre-tokens with rare characters it counts prefix by prefix.

The table of a text is stored compressed; truncation and budget questions are look-ups in it.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, map_batches, on_change, ragged
from .tokens import ALPHABET, CUT, SPELLED_CUT, WORD_LEVEL, Known, Library, read_spec, spelled, zstd

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Longer pre-tokens are counted one by one.
TOGETHER = 48
#: Units whose tables are gathered at once.
STRETCH = 100_000


class Table:
    """Vocabulary tokens by length: sorted hashes of their bytes, and their ids."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ids, self.by_length = tokens, {}
        lengths: dict[int, list[bytes]] = {}
        for t in tokens:
            lengths.setdefault(len(t), []).append(t)
        for m, ts in lengths.items():
            h = hashes(np.frombuffer(b"".join(ts), np.uint8).reshape(len(ts), m))[:, -1]
            order = np.argsort(h)
            self.by_length[m] = (h[order], np.array([tokens[t] for t in ts], np.int64)[order])
        self.longest = max(self.by_length)
        #: lengths of the tokens with these last two bytes (or this one), the longest first
        self.lengths: dict[bytes, list[int]] = {}
        for m in sorted(lengths, reverse=True):
            for end in {t[-2:] for t in lengths[m]}:
                self.lengths.setdefault(end, []).append(m)

    def find(self, m: int, h: np.ndarray) -> np.ndarray:
        """Id of the token of m bytes with each hash, -1 where there is none."""
        if m not in self.by_length:
            return np.full(len(h), -1)
        known, ids = self.by_length[m]
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        return np.where(known[at] == h, ids[at], -1)


def hashes(rows: np.ndarray) -> np.ndarray:
    """Column i: hash of each row's first i bytes. A suffix has the hash of the whole less that of
    what is before it times BASE to the power of its length."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), U)
    for i in range(rows.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + rows[:, i] + U(1)
    return out


class Merges:
    """Prefix counts of single pre-tokens."""

    def __init__(self, library: Library):
        from tokenizers import models

        model = read_spec(library.path)["model"]
        self.library, self.suffix = library, model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.closed_model = library.model
        self.open_model = models.BPE(vocab=model["vocab"], merges=merges) if self.suffix else library.model
        back = {chr(c): b for b, c in ALPHABET.items()}
        opened, closed = {}, {}
        for token, i in model["vocab"].items():
            end = bool(self.suffix) and token.endswith(self.suffix)
            plain = token[: -len(self.suffix)] if end else token
            if plain and all(c in back for c in plain):
                (closed if end else opened)[bytes(back[c] for c in plain)] = i
        self.spelled = {i: t.decode("latin-1").translate(ALPHABET) for ts in (opened, closed) for t, i in ts.items()}
        self.open, self.closed = Table(opened), Table(closed) if self.suffix else None
        self.pairs = _Pairs(self)

    def stable(self, closing: bool, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave tokens a and b, side by side, as they are."""
        keys = ((a << 33) | (b << 1) | int(closing)).tolist()
        return np.fromiter(map(self.pairs.__getitem__, keys), bool, len(keys))

    def many(self, words: list[bytes]) -> np.ndarray:
        """For all words, one after the other: the count of a word's first byte, first two bytes, ... each as a pre-token of its own.

        One pass over the places of all words at once; words with a common prefix share its state."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        width = int(size[0]) if len(size) else 0
        rows = np.zeros((len(words), width), np.uint8)
        rows[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        h, powers = hashes(rows), np.cumprod(np.concatenate([[U(1)], np.full(width, BASE)]), dtype=U)
        counts, last, out = np.zeros((len(words), width + 1), np.int32), np.zeros((len(words), width + 1), np.int64), np.zeros((len(words), width + 1), np.int32)
        for i in range(1, width + 1):
            n = int(np.searchsorted(-size, -i, "right"))
            _, row, node = np.unique(h[:n, i], return_index=True, return_inverse=True)
            for table in (self.open, self.closed) if self.closed else (self.open,):
                todo, count, token = np.arange(len(row)), np.zeros(len(row), np.int32), np.zeros(len(row), np.int64)
                for m in range(min(i, table.longest), 0, -1):
                    r = row[todo]
                    found = table.find(m, h[r, i] - h[r, i - m] * powers[m])
                    hit = np.flatnonzero(found >= 0)
                    if m < i and len(hit):
                        hit = hit[self.stable(table is self.closed, last[r[hit], i - m], found[hit])]
                    if len(hit):
                        at = todo[hit]
                        count[at], token[at] = counts[r[hit], i - m] + 1, found[hit]
                        todo = np.delete(todo, hit)
                    if not len(todo):
                        break
                else:
                    raise LookupError("a byte without a token")
                if table is self.open:
                    counts[:n, i], last[:n, i] = count[node], token[node]
                if table is self.closed or not self.closed:
                    out[:n, i] = count[node]
        self.pairs.bound()
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return out[place, 1:][np.arange(width)[None, :] < size[place, None]]

    def long(self, clusters: Iterable[Iterable[bytes]]) -> list[int]:
        """Counts along one pre-token of any length. A cluster gives what its first character, its first
        two, ... are when they end the pre-token; only the last of them is what later clusters follow."""
        counts, last, s, base, out = [0], [0], bytearray(), 0, []
        for cluster in clusters:
            for prefix in cluster:
                same = len(os.path.commonprefix([bytes(s[base:]), prefix]))
                del s[base + same :], counts[base + same + 1 :], last[base + same + 1 :]
                for byte in prefix[same:]:
                    s.append(byte)
                    count, token = self._step(s, self.open, counts, last)
                    counts.append(count)
                    last.append(token)
                out.append(self._step(s, self.closed, counts, last)[0] if self.closed else counts[-1])
            base = len(s)
        return out

    def _step(self, s: bytearray, table: Table, counts: list[int], last: list[int]) -> tuple[int, int]:
        i, closing = len(s), int(table is self.closed)
        for m in (*table.lengths.get(bytes(s[-2:]), ()), 1):
            token = table.ids.get(bytes(s[i - m : i])) if m <= i else None
            if token is not None and (m == i or self.pairs[(last[i - m] << 33) | (token << 1) | closing]):
                return counts[i - m] + 1, token
        raise LookupError("a byte without a token")


class _Pairs(dict):
    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, key: int) -> bool:
        m, a, b = self.merges, key >> 33, key >> 1 & 0xFFFFFFFF
        found = (m.closed_model if key & 1 else m.open_model).tokenize(m.spelled[a] + m.spelled[b])
        self[key] = got = len(found) == 2 and found[0].id == a
        return got

    def bound(self) -> None:
        if len(self) > 200_000:
            self.clear()


#: What the tokenizer drops between pre-tokens.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(WORD_LEVEL.pattern + r"|\s+")


def normal(text: str) -> str:
    return "".join(map(str.lower, unicodedata.normalize("NFC", text)))


def clusters(piece: str) -> list[str]:
    """Cut before every character that never joins the one before it in a composed character."""
    starts = [k for k, c in enumerate(piece) if not k or c.isascii() or not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff")]
    return [piece[a:b] for a, b in zip(starts, [*starts[1:], len(piece)])]


def one_class(text: str) -> str:
    """L: letters only; P: neither letters, numbers nor white space; else nothing."""
    kinds = {"L" if (c := unicodedata.category(ch)[0]) == "L" else "N" if c == "N" or ch in SPACE else "P" for ch in text}
    return kinds.pop() if len(kinds) == 1 and kinds != {"N"} else ""


class PrefixCounts:
    """Prefix tables of whole texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, most: int = 100_000):
        self.library = Library(path)
        if self.library.kind != "word":
            raise ValueError("prefix tables need a word-level byte-pair file whose white space is dropped")
        self.merges = Merges(self.library)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.library.specials, key=len, reverse=True))) + ")") if self.library.specials else None
        self.pre = Known(most)
        self.pre.numbers([CUT])
        self.pre.learn(np.zeros(1, np.int32), np.ones(1, np.int64))

    def _by_library(self, text: str) -> list[int]:
        return [len(self.library.whole(text[: k + 1])) for k in range(len(text))]

    def _pretokens(self, words: list[str]) -> list[np.ndarray]:
        """The table of each pre-token: by the merges, and checked against the library's count."""
        out: list = [None] * len(words)
        together, raw = [], []
        for k, p in enumerate(words):
            if p.isspace():
                out[k] = np.zeros(len(p), np.int32)
            elif len(p) > 1 and p[0] == "'" and p[1].isalpha():  # a contraction; cut short, it is two pre-tokens
                out[k] = np.array(self._by_library(p), np.int32)
            elif len(b := p.encode()) > TOGETHER:
                out[k] = np.array(self.merges.long([c.encode()] for c in p), np.int32)
            else:
                together.append(k)
                raw.append(b)
        flat, data = self.merges.many(raw), np.frombuffer(b"".join(raw), np.uint8)
        flat = flat[np.append((data[1:] & 0xC0) != 0x80, len(data) > 0)] if len(data) else flat  # where a character ends
        at = 0
        for k in together:
            n = len(words[k])
            out[k] = flat[at : at + n]
            at += n
        tokenize = self.library.model.tokenize
        for k, s in enumerate(spelled(CUT.join(words)).split(SPELLED_CUT)):
            if out[k][-1] != len(tokenize(s)) and not words[k].isspace():
                out[k] = np.array(self._by_library(words[k]), np.int32)
        return out

    def _odd_unit(self, unit: str) -> list[int]:
        """Units with rare characters or special strings, cut at the special strings; a prefix that ends
        inside one goes to the library together with the pre-token before it."""
        out, base, tail, before = [], 0, "", 0
        for k, part in enumerate(self.special.split(unit) if self.special else [unit]):
            if k % 2:
                out += [before + len(self.library.whole(tail + part[:j])) for j in range(1, len(part))]
                base += 1
                out.append(base)
                tail, before = "", base
            elif part:
                counts, start = self._stretch(part)
                out += [base + n for n in counts]
                tail, before = part[start:], base + (counts[start - 1] if start else 0)
                base += counts[-1]
        return out

    def _stretch(self, text: str) -> tuple[list[int], int]:
        """(table, start of the last pre-token) of a text without special strings: pre-tokens lie
        where the library's offsets say, and each has its own table."""
        encoding = self.library.tokenizer.encode(text, add_special_tokens=False)
        begins, reach, now = [], 0, None
        for word, (a, b) in zip(encoding.word_ids, encoding.offsets):
            if word != now and a >= reach:  # a character written as two may end one pre-token and begin the next
                begins.append(a)
            reach, now = max(reach, b), word
        out, base, quote = [0] * (begins[0] if begins else len(text)), 0, ("", 0)
        for a, end in zip(begins, [*begins[1:], len(text)]):
            piece = text[a:end].rstrip(SPACE)
            got = self._piece(piece)
            here = [base + n for n in got]
            if quote[0].endswith("'"):  # a mark may make no contraction of what was one before it
                here[:2] = [quote[1] + len(self.library.whole(quote[0] + piece[: j + 1])) for j in range(len(here[:2]))]
            out += here + [base + got[-1]] * (end - a - len(piece))
            quote, base = (text[a:end], base), base + got[-1]
        if base != len(encoding.ids):
            out = self._by_library(text)
        return out, begins[-1] if begins else 0

    def _piece(self, piece: str) -> list[int]:
        """The table of one pre-token as it stands in a text: short ones by the library, long ones by the merges."""
        if len(piece) > 16 and piece[0] != "'":
            kind = one_class(normal(piece[:1]))

            def prefixes(cluster: str) -> Iterator[bytes]:
                for j in range(len(cluster)):
                    p = normal(cluster[: j + 1])
                    if not kind or one_class(p) != kind:
                        raise LookupError("more than one pre-token")
                    yield p.encode()

            try:
                return self.merges.long(map(prefixes, clusters(piece)))
            except LookupError:
                pass
        return self._by_library(piece)

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tables of distinct units one after the other, size of each); each has one entry more, for the space after it."""
        odd = self.library.odd(words)
        plain = pc.if_else(pa.array(odd), "", words) if odd.any() else words
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), plain), CUT)[0].as_py() + CUT
        number = self.pre.numbers(PIECES.findall(joined.lower()))
        if self.pre.number.new:
            got = self._pretokens(list(self.pre.number.new))
            self.pre.learn(np.concatenate(got), np.array([len(x) for x in got], np.int64))
        values, sizes = self.pre.gather(number)
        last = self.pre.values[self.pre.begins[number] + sizes - 1].astype(np.int64)
        before, cut = np.cumsum(last) - last, number == self.pre.number[CUT]
        unit = np.cumsum(cut) - cut
        base = before - before[np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1])][unit]
        flat, size = values + np.repeat(base, sizes).astype(np.int32), np.bincount(unit, sizes, len(words)).astype(np.int64)
        self.pre.settle(number)
        if odd.any():
            parts = np.split(flat, np.cumsum(size)[:-1])
            for k in np.flatnonzero(odd):
                got = self._odd_unit(words[int(k)].as_py())
                parts[k] = np.array([*got, got[-1]], np.int32)
            flat, size = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, size

    def tables(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts after each character of all texts one after the other, int32; characters and tokens of each text)."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        cut = pc.split_pattern(column, " ")
        if not len(cut.values):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        words = cut.values.dictionary_encode()
        flat, size = self._units(words.dictionary)
        number, begin = words.indices.to_numpy(), np.cumsum(size) - size
        total = flat[begin + size - 1].astype(np.int64)
        text_end = cut.offsets.to_numpy()[1:]
        units = np.diff(text_end, prepend=0)
        ends = np.concatenate([[0], np.cumsum(total[number])])
        tokens = ends[text_end] - ends[text_end - units]
        base = (ends[:-1] - np.repeat(ends[text_end - units], units)).astype(np.int32)
        sizes = size[number]
        sizes[text_end - 1] -= 1  # no space after a text's last unit
        out = []
        for k in range(0, len(number), STRETCH):
            part = slice(k, k + STRETCH)
            out.append(flat[ragged(begin[number[part]], sizes[part])] + np.repeat(base[part], sizes[part]))
        chars = np.add.reduceat(sizes, text_end - units)
        return np.concatenate(out), chars, tokens


@lru_cache(maxsize=1)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


on_change(prefix_counts.cache_clear)


def stored(table: np.ndarray) -> bytes:
    steps = np.diff(table, prepend=np.int32(0))
    small = not len(steps) or (steps.min() >= -128 and steps.max() < 128)
    return (b"\x01" if small else b"\x04") + zstd()[0].compress(steps.astype("i1" if small else "<i4").tobytes())


def loaded(data: bytes) -> np.ndarray:
    """Entry k is the number of tokens of the text's first k characters."""
    steps = np.frombuffer(zstd()[1].decompress(data[1:]), "i1" if data[:1] == b"\x01" else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars and prefix_counts (see `loaded`) of every whole text.

    A null text is empty: no bytes, one entry. Repeated rows give repeated rows; null doc_ids stay
    null; extra columns are ignored; no length limit (tables of one text at a time are in memory).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        flat, chars, _ = prefix_counts(path).tables(column)
        ends = np.cumsum(chars)
        out = [stored(flat[e - n : e]) for e, n in zip(ends.tolist(), chars.tolist())]
        n_bytes = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
        return pa.record_batch([batch.column("doc_id"), n_bytes, pa.array(chars), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "n_chars", "prefix_counts"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, n_chars long, prefix_counts binary")


def with_budget(tables: DataFrame, budget: int) -> DataFrame:
    """Adds, from the stored tables: n_tokens, over_limit, and fit_chars (the longest prefix, in
    characters, of at most `budget` tokens) without encoding anything again."""
    bounded_batches(tables.sparkSession)

    @F.pandas_udf("n_tokens long, fit_chars long")
    def look_up(column: pd.Series) -> pd.DataFrame:
        n, fit = [], []
        for data in column:
            counts = loaded(data)
            n.append(int(counts[-1]))
            fit.append(int(np.flatnonzero(counts <= budget)[-1]))
        return pd.DataFrame({"n_tokens": n, "fit_chars": fit})

    got = tables.withColumn("found", look_up("prefix_counts"))
    return got.select("*", "found.*").drop("found").withColumn("over_limit", F.col("n_tokens") > budget)
