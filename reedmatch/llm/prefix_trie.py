"""Prefix trie of rebuilt conversations, kept as balanced parentheses.

Conversations are rebuilt as rows of numbers: hashes of role and text, code points, no text. One range sort
puts every conversation's turns in order, and prefix hashes (two 64-bit lanes, exclusive or of each turn's
hash mixed with its place) name the node of every turn; a conversation of any length is cut over tasks.
Grouping by node gives members, and nodes with the same members form a chain, named by its smallest
member and their number. A turn with one member needs no tree: it is a leaf chain.

Chains of two or more members make the tree. Those with more than `limit` members are the shared
spine; what hangs below is dealt to shards by its topmost chain, which has at most `limit` members. A
shard writes its chains in depth-first order as parentheses, each leaf chain as a pair "()". The excess
is kept in blocks under a tree of block minima: findclose delimits a subtree, the rank of "()" between both ends
counts its leaves, and cumulative arrays give its savings. Totals of the shards' tops are added to the
spine, which is one more such sequence. As every pair of a chain above the limit and a member is a row,
the spine has at most rows / limit chains: `limit` grows with the input so that this stays below a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_few, map_stream, partitions, staged

LIMIT, MOST_SPINE = 2_000, 1_000_000
BLOCK = 64
SHARED_TURNS = 5  # the most turns taken from another conversation


class Parentheses:
    """A sequence of balanced parentheses (True opens) with excess blocks under a tree of their minima."""

    def __init__(self, opens: np.ndarray):
        self.opens = np.asarray(opens, bool)
        n = len(self.opens)
        blocks = max(1, -(-n // BLOCK))
        excess = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        excess[:n] = np.cumsum(np.where(self.opens, 1, -1))
        self.excess = excess.reshape(blocks, BLOCK)
        self.minima = [self.excess.min(1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int64).max)
            self.minima.append(low.reshape(-1, 2).min(1))
        pair = np.zeros(n + 1, np.int64)
        pair[1:n] = self.opens[: n - 1] & ~self.opens[1:]
        self.rank = np.cumsum(pair)  # pairs "()" that begin before a place

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those opened at `at`: the first place after it where the
        excess falls below its own."""
        at = np.asarray(at, np.int64)
        block, target = at // BLOCK, self.excess[at // BLOCK, at % BLOCK] - 1
        out = np.full(len(at), -1)
        self._inside(out, np.arange(len(at)), block, target, at % BLOCK)
        left = np.flatnonzero(out < 0)
        node, want = block[left], target[left]
        level = np.zeros(len(left), np.int64)
        up = np.ones(len(left), bool)
        while True:  # up to the first right neighbour that falls low enough, then down to its leftmost such block
            moved = False
            for k, low in enumerate(self.minima):
                here = np.flatnonzero(up & (level == k))
                if len(here):
                    moved = True
                    beside = node[here] + 1
                    right = (node[here] % 2 == 0) & (beside < len(low))
                    right[right] = low[beside[right]] <= want[here][right]
                    node[here] = np.where(right, beside, node[here] // 2)
                    level[here[~right]] += 1
                    up[here[right]] = False
            if not moved:
                break
        for k in range(len(self.minima) - 1, 0, -1):
            here = np.flatnonzero(level == k)
            if len(here):
                child = 2 * node[here]
                node[here] = np.where(self.minima[k - 1][child] <= want[here], child, child + 1)
                level[here] -= 1
        self._inside(out, left, node, want, np.full(len(left), -1))
        return out

    def _inside(self, out: np.ndarray, which: np.ndarray, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> None:
        for s in range(0, len(which), 1 << 14):
            part = slice(s, s + (1 << 14))
            hit = (self.excess[block[part]] <= target[part, None]) & (np.arange(BLOCK) > after[part, None])
            first = hit.argmax(1)
            found = hit[np.arange(len(first)), first]
            out[which[part][found]] = (block[part] * BLOCK + first)[found]


def subtree_totals(parent: np.ndarray, singles: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, savings) over the subtree of each chain of a forest. parent: index or -1; singles: leaf
    chains that hang from it; leaves, saved: what else it adds itself."""
    n = len(parent)
    order = np.argsort(parent, kind="stable")
    begin = np.searchsorted(parent[order], np.arange(-1, n))
    end = np.searchsorted(parent[order], np.arange(-1, n), "right")
    kids = end - begin
    # depth-first order with an explicit stack; an opened chain is followed by its leaf pairs
    opened, closes_before = np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    stack, at, done = [int(k) for k in order[begin[0] : end[0]][::-1]], 0, 0
    while stack:
        k = stack.pop()
        if k < 0:
            closes_before[at] += 1
            continue
        opened[at] = k
        at += 1
        stack.append(-1)
        if kids[k + 1]:
            stack.extend(order[begin[k + 1] : end[k + 1]][::-1].tolist())
    # a chain without anything below it is a leaf itself: "()" alone; one with leaf pairs has them inside
    inner = singles[opened]
    width = 1 + 2 * inner
    gap = closes_before[1:]
    starts = np.concatenate(([0], np.cumsum(width + gap)[:-1])) if n else np.zeros(0, np.int64)
    size = int((width + gap).sum())
    opens = np.zeros(size, bool)
    opens[starts] = True
    if inner.sum():
        nth = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
        opens[np.repeat(starts + 1, inner) + 2 * nth] = True
    tree = Parentheses(opens)
    closes = tree.findclose(starts)
    own = np.zeros((2, size + 1), np.int64)
    own[0, starts + 1], own[1, starts + 1] = leaves[opened], saved[opened]
    sums = np.cumsum(own, 1)
    out = np.empty((2, n), np.int64)
    out[0, opened] = tree.rank[closes] - tree.rank[starts] + sums[0, closes] - sums[0, starts]
    out[1, opened] = sums[1, closes] - sums[1, starts]
    return out[0], out[1]


def _segmented(rows: DataFrame, key: str, order: list[str], sums: dict[str, str], xors: dict[str, str], label: str) -> DataFrame:
    """Staged rows of long columns with, for each pair (value, name), the sum or exclusive or of the value over
    the rows of its key up to this one, in the order given (which begins with the key).

    Rows are range-sorted and each task runs over its own range. Of a range its first and last key and the last
    one's state come to the driver, which carries them on to the ranges after it."""
    spark = rows.sparkSession
    made, given = [*sums.values(), *xors.values()], rows.columns
    names = [*given, *made, "opening", "first_key", "range_no", "summary"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{c}` long" for c in made), "opening boolean, first_key long, range_no int, summary boolean"])
    kinds = [f.dataType.simpleString() for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, first, now, state = TaskContext.get().partitionId(), None, None, [0] * len(made)
        for batch in batches:
            n, keys = batch.num_rows, batch.column(key).to_numpy()
            if not n:
                continue
            first = int(keys[0]) if first is None else first
            goes_on = keys[0] == now
            begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
            out = []
            for k, c in enumerate([*sums, *xors]):
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                acc = np.cumsum(v) if k < len(sums) else np.bitwise_xor.accumulate(v)
                before = (acc - v if k < len(sums) else acc ^ v)[begin]
                if goes_on:
                    before[0] = -state[k] if k < len(sums) else state[k]
                out.append(acc - before[group] if k < len(sums) else acc ^ before[group])
            state, now = [int(v[-1]) for v in out], int(keys[-1])
            whole = [np.full(n, first), np.full(n, number, np.int32), np.zeros(n, bool)]
            yield pa.record_batch([*batch.columns, *map(pa.array, out), pa.array(keys == first), *map(pa.array, whole)], names)
        if first is not None:
            fields = [pa.nulls(1, {"long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) if c != key else pa.array([now]) for c, t in zip(given, kinds)]
            yield pa.record_batch([*fields, *(pa.array([v]) for v in state), pa.array([now == first]), pa.array([first]), pa.array([number], pa.int32()), pa.array([True])], names)

    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    done = staged(map_stream(ranged, run, schema), label)
    carried, last, held = [], None, [0] * len(made)
    for r in done.where("summary").orderBy("range_no").collect():  # one row for each range
        carry = held if r["first_key"] == last else [0] * len(made)
        carried.append((r["range_no"], *carry))
        own = [r[c] for c in made]
        held = [a + b if k < len(sums) else a ^ b for k, (a, b) in enumerate(zip(carry, own))] if r["opening"] else own
        last = r[key]
    lookup = F.broadcast(spark.createDataFrame(carried, "range_no int" + "".join(f", `__{c}` long" for c in made)))
    here = done.where("not summary").join(lookup, "range_no")
    moved = {c: F.when(F.col("opening"), F.col(c) + F.col(f"__{c}") if k < len(sums) else F.col(c).bitwiseXOR(F.col(f"__{c}"))).otherwise(F.col(c)) for k, c in enumerate(made)}
    return here.withColumns(moved).select(*given, *made)


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows of all rebuilt conversations in numbers: conv, d (place from 1), a, b (prefix hashes), pa, pb (those of
    the place before), chars, total (code points so far), ended = false; and for each conversation a row with
    ended = true that carries its number of turns and its last prefix hashes.

    A conversation c takes the first h turns of c - c % 100, h = crc32(c) % 6, then its own after its first h."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit("second"), role).alias("h2"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one")
    )
    placed = _segmented(rows, "conv", ["conv", "turn", "h1", "h2"], {"one": "at"}, {}, "turns-placed").select("conv", "at", "h1", "h2", "chars")
    own = placed.groupBy("conv").agg(F.count("*").alias("n"))
    named = staged(own.select("conv", "n", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string")) % 6).alias("h")), "conversations")
    bases = named.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))  # at most 199 conversations share a base
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    named = staged(named.join(bases, "base", "left").select("conv", "base", "h", taken.alias("taken")), "conversations")
    later = join_few(placed, named.select("conv", "h", "taken"), ["conv"], "at").where("at > h").select("conv", (F.col("taken") + F.col("at") - F.col("h")).alias("d"), "h1", "h2", "chars")
    shared = placed.where(f"at <= {SHARED_TURNS} and conv % 100 = 0").withColumnRenamed("conv", "base")
    spine = named.where("taken > 0").join(shared, "base").where("at <= taken").select("conv", F.col("at").alias("d"), "h1", "h2", "chars")
    turn_rows = later.union(spine).select("conv", "d", F.xxhash64("d", "h1").alias("g1"), F.xxhash64("h2", "d").alias("g2"), "chars", F.lit(1).cast("long").alias("step"))
    zero = F.lit(0).cast("long")
    ends = named.select("conv", F.lit((1 << 63) - 1).alias("d"), zero.alias("g1"), zero.alias("g2"), zero.alias("chars"), zero.alias("step"))
    out = _segmented(turn_rows.union(ends), "conv", ["conv", "d"], {"step": "place", "chars": "total"}, {"g1": "a", "g2": "b"}, "turns-hashed")
    return out.select("conv", F.col("place").alias("d"), "a", "b", F.col("a").bitwiseXOR(F.col("g1")).alias("pa"), F.col("b").bitwiseXOR(F.col("g2")).alias("pb"), "chars", "total", (F.col("step") == 0).alias("ended"))


def _digests(ends: DataFrame) -> DataFrame:
    """d, a, b and sha of the ids of the conversations that end at a node, for nodes where two or more do.

    Ids are sorted and joined over all tasks; a node's one task only feeds finished pieces to the hash."""
    spark = ends.sparkSession
    keys = ["a", "b", "d"]
    piece_schema = "a long, b long, d long, range_no int, piece_no long, n long, ids string"
    names = [c.split()[0] for c in piece_schema.split(", ")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, out, now, held, count, size, edge = TaskContext.get().partitionId(), [], None, [], 0, 0, True

        def close(last: bool) -> None:
            nonlocal held, size, count, edge
            if edge or last or count > 1:  # else a node with this one end
                out.append((*now, number, count, len(held), ",".join(held)))
            held, size = [], 0

        for batch in batches:
            for a, b, d, conv in zip(*(batch.column(c).to_pylist() for c in (*keys, "conv"))):
                if (a, b, d) != now:
                    if now is not None:
                        close(False)
                        edge = False
                    now, count = (a, b, d), 0
                elif size > 1 << 20:
                    out.append((*now, number, count, len(held), ",".join(held)))
                    held, size = [], 0
                held.append(str(conv))
                size += 20
                count += 1
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names)
                out = []
        if now is not None:
            close(True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n, done = None, None, 0, []
        for batch in batches:
            for a, b, d, count, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "n", "ids"))):
                if (a, b, d) != now:
                    if n > 1:
                        done.append((*now, sha.hexdigest()))
                    now, sha, n = (a, b, d), hashlib.sha256(), 0
                sha.update(f"{',' * (n > 0)}{ids}".encode())
                n += count
            if len(done) > 10_000:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], [*keys, "sha"])
                done = []
        if n > 1:
            done.append((*now, sha.hexdigest()))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], [*keys, "sha"])

    order = [*keys, "conv"]
    ranged = ends.select(*order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    pieces = staged(map_stream(ranged, join, piece_schema), "end-pieces")
    dealt = pieces.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "range_no", "piece_no")
    return map_stream(dealt, digest, "a long, b long, d long, sha string")


CHAIN = ["cm", "n", "pcm", "pn", "singles", "leaves", "saved"]
TOTALS = "cm long, n long, pcm long, pn long, kids long, all_leaves long, all_saved long, top boolean"


def _of_forest(rows: list[tuple], spine: bool) -> pa.RecordBatch:
    """Totals of chains (CHAIN) that hold whole subtrees; `top` marks those whose parent is elsewhere."""
    cm, n, pcm, pn, singles, leaves, saved = zip(*rows)
    index = {key: k for k, key in enumerate(zip(cm, n))}
    parent = np.array([index.get(key, -1) for key in zip(pcm, pn)], np.int64)
    kids = np.bincount(parent[parent >= 0], minlength=len(parent))
    single, extra = np.array(singles, np.int64), np.array(leaves, np.int64)
    if spine:  # what hangs from it was counted elsewhere; the pair of a chain with such leaves isn't one itself
        extra, single = extra + single, np.zeros(len(rows), np.int64)
        extra -= (kids == 0) & (extra > 0)
    all_leaves, all_saved = subtree_totals(parent, single, extra, np.array(saved, np.int64))
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in (cm, n, pcm, pn)), pa.array(kids), pa.array(all_leaves), pa.array(all_saved), pa.array(parent < 0)], [c.split()[0] for c in TOTALS.split(", ")])


def _shards(chains: DataFrame, spine: bool) -> DataFrame:
    """TOTALS of chains (unit, CHAIN); a unit is a subtree and is one task's."""
    spark = chains.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for unit, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", *CHAIN))):
                if unit != now and len(held) >= 1 << 16:
                    yield _of_forest(held, spine)
                    held = []
                now = unit
                held.append(tuple(row))
        if held:
            yield _of_forest(held, spine)

    dealt = chains.repartition(1 if spine else partitions(spark), "unit").sortWithinPartitions("unit", "cm", F.desc("n"))
    return staged(map_stream(dealt.select("unit", *CHAIN), run, TOTALS), "trie-spine" if spine else "trie-shards")


def trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 for each node.

    Turns are ordered by turn (null first), those of one turn by hashes of role and text; null and empty role
    or text are the same; repeated rows are repeated turns. Rows with a null conv_id belong to no conversation
    and are ignored. Texts and conversations may be of any length; nodes are told apart by 128 bits of hash.
    Extra columns are ignored; an empty table has no nodes, not even the root.
    """
    spark = turns.sparkSession
    rows = rebuilt(turns.select("conv_id", "turn", "role", "text"))
    rows = staged(rows, "trie-rows")
    key = ["d", "a", "b"]
    alive, gone = ~F.col("ended"), F.col("ended")
    nodes = rows.groupBy(*key).agg(
        F.count_if(alive).alias("n"), F.count_if(gone).alias("n_ends"), F.min("conv").alias("cm"), F.min(F.when(gone, F.col("conv"))).alias("end_min"),
        F.max(F.when(alive, F.col("pa"))).alias("pa"), F.max(F.when(alive, F.col("pb"))).alias("pb"), F.max("chars").alias("chars"), F.max("total").alias("total"),
    )
    nodes = staged(nodes, "trie-nodes")
    n_convs, least = rows.where("ended").agg(F.count("*"), F.min("conv")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n_convs:
        return spark.createDataFrame([], schema)
    turnless = nodes.where("d = 0").select("n_ends", "end_min").first() or (0, None)
    kept = ["d", "a", "b", "cm", "n", "n_ends", "end_min", "chars", "total"]
    root = spark.createDataFrame([(0, 0, 0, least, n_convs, *turnless, 0, 0, None, None)], ", ".join(f"{c} long" for c in (*kept, "pcm", "pn")))
    parents = nodes.where("d > 0").select(F.col("d").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("cm").alias("pcm"), F.col("n").alias("pn"))
    deep = nodes.where("d > 1").withColumn("pd", F.col("d") - 1).join(parents, ["pd", "pa", "pb"]).select(*kept, "pcm", "pn")
    high = nodes.where("d = 1").select(*kept, F.lit(least).cast("long").alias("pcm"), F.lit(n_convs).cast("long").alias("pn"))
    nodes = staged(root.union(high).union(deep), "trie-linked")

    limit = max(limit, ceil(rows.count() / MOST_SPINE))
    many = nodes.where("n > 1")
    chains = many.groupBy("cm", "n").agg(F.max("d").alias("tail"), F.max_by("total", "d").alias("reached"), F.min_by(F.col("total") - F.col("chars"), "d").alias("before"), F.min_by("pcm", "d").alias("pcm"), F.min_by("pn", "d").alias("pn"))
    singles = nodes.where("n = 1 and pn > 1").groupBy(F.col("pcm").alias("cm"), F.col("pn").alias("n")).agg(F.count("*").alias("singles"))
    own = (F.col("n") - 1) * (F.col("reached") - F.col("before"))
    chains = staged(chains.join(singles, ["cm", "n"], "left").select("cm", "n", "tail", "reached", "before", "pcm", "pn", F.coalesce("singles", F.lit(0)).cast("long").alias("singles"), own.alias("own")), "trie-chains")
    # the topmost node with at most `limit` members of each conversation names its unit; there are at most
    # rows / limit nodes above it
    units = chains.select("cm").distinct().withColumn("unit", F.lit(0).cast("long"))  # the whole tree is one
    if n_convs > limit:
        above = F.broadcast(nodes.where(F.col("n") > limit).select(*key))
        units = rows.where("not ended").join(above, key, "left_anti").groupBy("conv").agg(F.min_by(F.struct(*key), "d").alias("unit"))
        units = units.select(F.col("conv").alias("cm"), F.xxhash64("unit.d", "unit.a", "unit.b").alias("unit"))
    zero = F.lit(0).cast("long")
    low = chains.where(F.col("n") <= limit).join(units, "cm").select("unit", "cm", "n", "pcm", "pn", "singles", zero.alias("leaves"), F.col("own").alias("saved"))
    shards = _shards(low, spine=False)
    tops = shards.where("top").groupBy(F.col("pcm").alias("cm"), F.col("pn").alias("n")).agg(F.count("*").alias("tops"), F.sum("all_leaves").alias("leaves"), F.sum("all_saved").alias("below"))
    spine = chains.where(F.col("n") > limit).join(tops, ["cm", "n"], "left")
    spine = staged(spine.select(zero.alias("unit"), "cm", "n", "pcm", "pn", "singles", F.coalesce("leaves", zero).alias("leaves"), (F.col("own") + F.coalesce("below", zero)).alias("saved"), F.coalesce("tops", zero).alias("tops")), "trie-top")
    whole = _shards(spine.drop("tops"), spine=True).join(spine.select("cm", "n", "tops"), ["cm", "n"]).withColumn("kids", F.col("kids") + F.col("tops"))
    totals = shards.select("cm", "n", "kids", "all_leaves", "all_saved").union(whole.select("cm", "n", "kids", "all_leaves", "all_saved"))
    about = staged(chains.select("cm", "n", "tail", "before", "singles").join(totals, ["cm", "n"]), "trie-totals")

    in_tree = many.join(about, ["cm", "n"]).select(
        *(many[c] for c in (*key, "n_ends", "end_min", "pcm")), "cm", "n",
        F.when(F.col("d") == F.col("tail"), F.col("kids") + F.col("singles")).otherwise(1).alias("n_children"), F.col("all_leaves").alias("n_leaves"),
        (F.col("all_saved") - (F.col("n") - 1) * (F.col("total") - F.col("chars") - F.col("before"))).alias("saved_tokens"),
    )
    empty = F.sha2(F.lit(""), 256)
    lone_children = F.when((F.col("n_ends") > 0), 0).otherwise(1)
    lone = nodes.where("n = 1").select(*in_tree.columns[:8], lone_children.alias("n_children"), F.lit(1).alias("n_leaves"), zero.alias("saved_tokens"))
    some = in_tree.where("n_ends > 1").join(_digests(rows.where("ended").select(*key, "conv")), key)
    rest = in_tree.where("n_ends < 2").union(lone).withColumn("sha", F.when(F.col("n_ends") == 0, empty).otherwise(F.sha2(F.col("end_min").cast("string"), 256)))
    out = some.select(*rest.columns).union(rest)
    as_long = lambda c, name: F.col(c).cast("long").alias(name)
    return out.select(as_long("cm", "conv_id"), as_long("d", "depth"), as_long("pcm", "parent_conv_id"), as_long("n", "n_convs"), as_long("n_children", "n_children"), as_long("n_leaves", "n_leaves"), as_long("saved_tokens", "saved_tokens"), F.col("sha").alias("ends_sha256"))


#: DuckDB SQL of trie(): crc32 digit by digit, then prefixes as lists of ranks of their turns.
ORACLE = """
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as i, dense_rank() over (order by coalesce(role, ''), coalesce(text, '')) as w, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
k as (select c, count(*) as n, c - c % 100 as base, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''), lambda x: list_concat([ascii(x)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))), lambda s, x: case when x >= 0 then xor(s, x) when s % 2 = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295) % 6 as h from t group by c),
r as (select c, list(w order by part, i) as ws, list(chars order by part, i) as cs from (
  select k.c, 0 as part, t.i, t.w, t.chars from k join t on t.c = k.base and t.i <= k.h union all select k.c, 1, t.i, t.w, t.chars from k join t on t.c = k.c and t.i > k.h) group by c),
v as (select k.c, coalesce(ws, []) as ws, coalesce(cs, []) as cs from k left join r on r.c = k.c),
p as (select c, d, ws[1:d] as p, ws[1:d - 1] as up, case when d > 0 then cs[d] else 0 end as chars, len(ws) = d as ended from (select *, unnest(generate_series(0, len(ws))) as d from v)),
n as (select d, p, any_value(up) as up, min(c) as c, count(*) as n, any_value(chars) as chars, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ended), '')) as ends from p group by d, p),
kids as (select d - 1 as d, up as p, count(*) as kids from n where d > 0 group by all),
m as (select n.*, coalesce(kids, 0) as kids, case when n.d > 0 then u.c end as pc from n left join kids on kids.d = n.d and kids.p = n.p left join n u on u.d = n.d - 1 and u.p = n.up),
s as (select e as d, p[1:e] as p, sum((kids = 0)::int) as leaves, sum((n - 1) * chars) as saved from (select *, unnest(generate_series(0, d)) as e from m) group by all)
select c as conv_id, m.d::bigint as depth, pc as parent_conv_id, n::bigint as n_convs, kids::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, ends as ends_sha256 from m join s on s.d = m.d and s.p = m.p
"""
