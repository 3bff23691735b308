"""Token ids of many texts by a file of the tokenizers library, with a bounded cache of units.

Byte-pair merges never cross the tokenizer's own pre-tokens, and a single space always begins
one, so texts are split at single spaces into units, the units of a batch are numbered by Arrow, the
library encodes each pre-token that a worker hasn't met, and ids of whole batches are gathered with numpy. Texts with characters
whose classes could differ between regular-expression libraries, or with a special token's
string in them, are encoded whole by the library. Results equal the library's for every text.
"""

from __future__ import annotations

import json
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import on_change, ragged

#: Outside of these, characters are left to the library.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ɏ]")
#: Stands between units that are cut together; no text with it takes this path.
CUT = "\x01"
BYTE_LEVEL = re.compile(r"\x01|'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s\x01]|_)+|\s+(?![^\s\x01])|\s+")
WORD_LEVEL = re.compile(r"\x01|'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s\x01]|_)+")
#: White space on both sides of a space, or a space at the end: there a byte-level pre-token may hold
#: a space that isn't its first character.
CROSSED = r"  | \z|[\t\n\r] [\t\n\r]"
#: Units whose ids are gathered at once.
STRETCH = 200_000
WORD_LEVEL_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, int]:
    """The printable character by which byte-level tokenizers write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown)) | {b: 256 + k for k, b in enumerate(rest)}


ALPHABET = byte_alphabet()


SPELLED_CUT = chr(ALPHABET[ord(CUT)])


def spelled(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(ALPHABET)


class Fresh(dict):
    """Numbers keys in order of first sight and lists those that are new."""

    def __init__(self, keys=()):
        super().__init__((k, i) for i, k in enumerate(keys))
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


def _mask(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def read_spec(path: str) -> dict:
    """A tokenizer file as JSON: read where it is needed and not kept, as its lists of merges are large."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Library:
    """The tokenizer file and what of its set-up decides how texts may be split."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.path, spec = path, read_spec(path)
        self.model = self.tokenizer.model
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.vocab_size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.kind = self._kind(spec)
        self.pattern = {"byte": BYTE_LEVEL, "word": WORD_LEVEL}.get(self.kind)

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
            return "other"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        if norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence":
            split, *rest = pre["pretokenizers"]
            if split.get("pattern") == {"Regex": WORD_LEVEL_FILE} and split.get("invert") and [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["use_regex"]:
                return "word"
        return "other"

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def odd(self, column: pa.Array) -> np.ndarray:
        """Which texts of a column aren't `plain`."""
        out = _mask(pc.match_substring_regex(column, UNSAFE.pattern))
        for s in self.specials:
            out |= _mask(pc.match_substring(column, s))
        return out

    def plain(self, text: str) -> bool:
        return self.kind != "other" and not UNSAFE.search(text) and not any(s in text for s in self.specials)

    def token_bytes(self) -> list[bytes]:
        """By id, the bytes it stands for (byte-level files only)."""
        back, spec = {c: b for b, c in ALPHABET.items()}, read_spec(self.path)
        out = [b""] * self.vocab_size
        for token, i in spec["model"]["vocab"].items():
            out[i] = bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else token.encode()
        for t in spec["added_tokens"]:
            out[t["id"]] = t["content"].encode()
        return out


class Known:
    """A bounded memory: strings, numbered in order of first sight, with an array of numbers for each."""

    def __init__(self, most: int):
        self.most, self.number = most, Fresh()
        self.values, self.sizes, self.seen = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begins = self.sizes

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, keys), np.int32, len(keys))

    def learn(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Arrays of all new strings, one after the other."""
        self.values, self.sizes = np.concatenate([self.values, values.astype(np.int32)]), np.concatenate([self.sizes, sizes])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.seen = np.concatenate([self.seen, np.zeros(len(sizes), np.int64)])
        self.number.new.clear()

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        return self.values[ragged(self.begins[numbers], sizes)], sizes

    def settle(self, numbers: np.ndarray) -> None:
        """Count what was met; over the bound, keep strings met at least twice since the last time, up to half of it."""
        self.seen += np.bincount(numbers, minlength=len(self.seen))
        if len(self.number) <= self.most:
            return
        keep = np.argsort(-self.seen, kind="stable")[: self.most // 2]
        keep = np.sort(keep[self.seen[keep] > 1])
        names = list(self.number)
        self.values, self.sizes = self.gather(keep)
        self.begins, self.seen = np.cumsum(self.sizes) - self.sizes, np.zeros(len(keep), np.int64)
        self.number = Fresh(names[k] for k in keep)


class Units:
    """Encoder for columns of texts; keeps at most about `most` pre-tokens between calls."""

    def __init__(self, path: str, most: int = 100_000):
        self.library = Library(path)
        self.pre = Known(most)
        self.pre.numbers([CUT])
        self.pre.learn(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _ids_of(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of n units one after the other, number of ids of each). Each unit has CUT before it; they
        are cut into pre-tokens together, and the library encodes each pre-token that isn't known."""
        pre = self.pre
        number = pre.numbers(self.library.pattern.findall(joined))
        if pre.number.new:
            tokenize, flat, sizes = self.library.model.tokenize, [], []
            for word in spelled(CUT.join(pre.number.new)).split(SPELLED_CUT):
                ids = [t.id for t in tokenize(word)]
                flat += ids
                sizes.append(len(ids))
            pre.learn(np.array(flat, np.int32), np.array(sizes, np.int64))
        ids, sizes = pre.gather(number)
        unit = np.cumsum(number == pre.number[CUT]) - 1
        pre.settle(number)
        return ids, np.bincount(unit, sizes, n).astype(np.int64)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint32, number of ids of each text); null is empty."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        n = len(column)
        odd = np.ones(n, bool) if self.library.kind == "other" else self.library.odd(column)
        single = ~odd & _mask(pc.match_substring_regex(column, CROSSED)) if self.library.kind == "byte" else np.zeros(n, bool)
        cut = pc.split_pattern(column.filter(pa.array(~odd & ~single)), " ")
        words = cut.values.dictionary_encode()
        number, distinct = words.indices.to_numpy(), len(words.dictionary)
        byte, offsets = self.library.kind == "byte", cut.offsets.to_numpy()
        joined = CUT.join(["", *pc.binary_join(pa.ListArray.from_arrays(pa.array([0, distinct], pa.int32()), words.dictionary), f"{CUT} " if byte else CUT).to_pylist()]) if distinct else ""
        units = np.zeros(n, np.int64)
        units[~odd & ~single] = np.diff(offsets)
        if byte:  # a unit has its space before it, but for the first of a text
            joined = joined.replace(CUT, f"{CUT} ", 1)
            bare = Fresh()
            firsts = [bare[w] for w in words.dictionary.take(pa.array(number[offsets[:-1]])).to_pylist()]
            number = number.copy()
            number[offsets[:-1]] = np.array(firsts, number.dtype) + distinct
            wholes = [bare[t] for t in column.filter(pa.array(single)).to_pylist()]
            units[single] = 1
            number = np.insert(number, (np.cumsum(units) - units)[single] - np.arange(len(wholes)), np.array(wholes, number.dtype) + distinct)
            joined, distinct = CUT.join([joined, *bare]), distinct + len(bare)
        else:
            joined = joined.lower()
        flat, sizes = self._ids_of(joined, distinct)
        begins, out = np.cumsum(sizes) - sizes, []
        for k in range(0, len(number), STRETCH):
            part = number[k : k + STRETCH]
            out.append(flat[ragged(begins[part], sizes[part])].astype(np.uint32))
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes[number])])[np.cumsum(units)]
        counts = np.diff(ends, prepend=0)
        if odd.any():
            parts = []
            for k, text in enumerate(column):
                parts.append(np.array(self.library.whole(text.as_py()), np.uint32) if odd[k] else ids[ends[k] - counts[k] : ends[k]])
                counts[k] = len(parts[-1])
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(maxsize=1)
def units(path: str) -> Units:
    """The encoder of this worker process; it outlives tasks of one kind where workers are reused."""
    return Units(path)


on_change(units.cache_clear)


@lru_cache(maxsize=1)
def zstd():
    """(compressor, decompressor) of this worker process."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 16-bit numbers where they fit (one flag byte), compressed."""
    narrow = not len(ids) or ids.max() < 65536
    return (b"\x02" if narrow else b"\x04") + zstd()[0].compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = zstd()[1].decompress(data[1:])
    return np.frombuffer(raw, "<u2" if data[:1] == b"\x02" else "<u4").astype(np.uint32)


assert sys.byteorder == "little"
