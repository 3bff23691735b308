"""Chat formatting by token-level assembly.

Each turn is laid out as ``<|im_start|>`` role ``\\n`` text ``<|im_end|>`` ``\\n``. Role and text
are encoded on their own, the two markers are spliced in as reserved ids, so no content can make
a marker, and prefix sums over the segment lengths give every turn's place and the loss mask.
Control strings inside content are escaped (a backslash after ``<`` in ``<|``, one more where
there are some already), which ``unescape`` undoes exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, map_stream, partitions, running_sum, staged
from .tokens import Library, packed, units, unpacked

START, END = "<|im_start|>", "<|im_end|>"
HEAD = 64  # characters of role and text that order turns with one number


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


def assemble(turns: DataFrame, path: str, loss_role: str = "assistant") -> DataFrame:
    """One row for each turn: conv_id, turn_no (from 0), role ids and text between reserved ids in
    `ids`, loss_from and loss_to (ids of this turn under the loss mask), and token_start (ids of
    the conversation's turns before).

    Turns are ordered by turn (nulls first), those of one turn by the first 64 characters of role and of
    text, then by a hash of both; null role or text is empty; a null conv_id is a conversation of its own;
    repeated rows are repeated turns; a turn's text may be of any length, as texts themselves are never
    keys of a sort. Extra columns are ignored, an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = units(path)
        size = encoder.library.vocab_size
        roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
        n = len(roles)
        ids, counts = encoder.encode([escape_role(r or "") for r in roles] + ["\n"] + [escape(t or "") for t in texts])
        ends = np.cumsum(counts)
        parts = np.split(ids, ends[:-1])
        line = parts[n]
        out, lengths = [], np.empty((n, 6), np.int64)
        for k in range(n):
            segments = [np.array([size], np.uint32), parts[k], line, parts[n + 1 + k], np.array([size + 1], np.uint32), line]
            lengths[k] = [len(s) for s in segments]
            out.append(packed(np.concatenate(segments)))
        places = np.cumsum(lengths, 1)
        loss = np.array([r == loss_role for r in roles], bool)
        a = np.where(loss, places[:, 2], 0) if n else np.zeros(0, np.int64)
        b = np.where(loss, places[:, 3], 0) if n else np.zeros(0, np.int64)
        total = places[:, 5] if n else np.zeros(0, np.int64)
        columns = [*(batch.column(c) for c in kept), pa.array(out, pa.binary()), pa.array(total), pa.array(a), pa.array(b)]
        return pa.record_batch(columns, [*kept, "ids", "n_ids", "loss_from", "loss_to"])

    kept = ["conv_id", "turn", "role_head", "text_head", "both"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumns({"role_head": F.substring("role", 1, HEAD), "text_head": F.substring("text", 1, HEAD), "both": F.xxhash64("role", "text")})
    encoded = map_batches(rows, run, "conv_id long, turn long, role_head string, text_head string, both long, ids binary, n_ids long, loss_from long, loss_to long")
    rows = staged(encoded.withColumn("row_no", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")), "chat-turns")
    # one global order, so that a conversation of any size is cut over tasks
    placed = running_sum(rows, [*kept, "row_no"], {"n_ids": "token_start", "one": "turn_no"}, "chat").select("conv_id", "turn_no", "ids", "n_ids", "loss_from", "loss_to", "token_start")
    firsts = staged(placed.groupBy(F.col("conv_id").alias("conv")).agg(F.min("turn_no").alias("first_turn"), F.min("token_start").alias("first_token")), "chat-firsts")
    whole = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv"))).withColumns({"turn_no": F.col("turn_no") - F.col("first_turn"), "token_start": F.col("token_start") - F.col("first_token")})
    return whole.drop("conv", "first_turn", "first_token")


def mask(loss_from: int, loss_to: int, n_ids: int) -> np.ndarray:
    """The loss mask of a turn: the running sum of +1 where the loss text begins and -1 where it ends."""
    steps = np.zeros(n_ids + 1, np.int8)
    steps[loss_from] += 1
    steps[loss_to] -= 1
    return np.cumsum(steps)[:n_ids].astype(bool)


def decoded(formatted: DataFrame, path: str) -> DataFrame:
    """What each turn's ids say, decoded where they lie: conv_id, turn_no, token_start, n_ids, said (role, line end, text, line end in
    UTF-8), loss (the text under the loss mask), loss_chars and chars (of the formatted turn)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        library = Library(path)
        table, size = library.token_bytes(), library.vocab_size
        text_of = lambda ids: b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        out = []
        for data, a, b in zip(*(batch.column(c).to_pylist() for c in ("ids", "loss_from", "loss_to"))):
            ids = unpacked(data)
            if ids[0] != size:
                raise ValueError("a turn must begin with its marker")
            end = int(np.flatnonzero(ids == size + 1)[0])
            content = text_of(ids[1:end])
            role, _, text = content.partition("\n")
            under = unescape(text_of(ids[mask(a, b, len(ids))]))
            said = f"{unescape_role(role)}\n{unescape(text)}\n"
            out.append((len(ids), said.encode("utf-8", "surrogatepass"), under.encode("utf-8", "surrogatepass"), len(under), len(START) + len(content) + len(END) + len(text_of(ids[end + 1 :]))))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        made = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        return pa.record_batch([*(batch.column(c) for c in ("conv_id", "turn_no", "token_start")), *made], ["conv_id", "turn_no", "token_start", "n_ids", "said", "loss", "loss_chars", "chars"])

    rows = formatted.select("conv_id", "turn_no", "token_start", "ids", "loss_from", "loss_to")
    return map_batches(rows, run, "conv_id long, turn_no long, token_start long, n_ids long, said binary, loss binary, loss_chars long, chars long")


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Digests of each conversation from its ids alone: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars and n_ids. Turns are decoded in all tasks. The two digests are of a whole conversation, in order,
    so one task feeds its turns' bytes to the hashes, a turn at a time in memory, and does nothing else."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*done))], names)

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            said, loss = batch.column("said"), batch.column("loss")
            for k, (conv, start, n_ids, loss_chars, chars) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "token_start", "n_ids", "loss_chars", "chars")))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if start != state[5]:
                    raise ValueError("a turn must begin where the one before ended")
                state[0] += 1
                state[1].update(said[k].as_buffer())
                state[2] += loss_chars
                state[3].update(loss[k].as_buffer())
                state[4] += chars
                state[5] += n_ids
            if len(done) >= 1000:
                yield rows()
                done = []
        close()
        if done:
            yield rows()

    ordered = decoded(formatted, path).repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn_no")
    return map_stream(ordered, run, schema)


def round_trip(turns: DataFrame, path: str) -> DataFrame:
    return read_back(assemble(turns, path), path)
