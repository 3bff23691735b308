"""Profiles: query bags, cached extracts, first-wins union, tree reduction, warnings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import entries_of
from ..functions.text import bound, content_key, tokens
from ..sources.staging import staged
from .calls import Policy, made
from .rows import numbered_in

KEYS = ("skills", "domains", "projects", "experience", "interests", "achievements", "constraints")
FAN_IN = 6
# The weight of a profile's parts: of a plain entry, then of an object's fields. A skill's name weighs by its strength.
STRENGTHS = {"demonstrated": 3.0, "used": 2.0, "mentioned": 1.0}
PLAIN_SKILL = 1.5
WEIGHTS: dict[str, tuple[float, dict[str, float]]] = {
    "skills": (PLAIN_SKILL, {"name": PLAIN_SKILL}),
    "domains": (2.5, {}),
    "interests": (3.0, {}),
    "projects": (1.0, {"name": 2.0, "what": 1.0}),
    "experience": (1.0, {"role": 1.0, "what": 1.0}),
}


def strength_weight(c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(w)) for k, w in STRENGTHS.items()), F.lit(PLAIN_SKILL))


def weighted_bag(parts: DataFrame) -> DataFrame:
    """profile, term, qw from rows (profile, text, weight); each occurrence of a term counts."""
    rows = parts.select("profile", "weight", F.explode(tokens("text")).alias("term"))
    return rows.groupBy("profile", "term").agg(F.sum("weight").alias("qw"))


def parts(items: DataFrame) -> DataFrame:
    """profile, text, weight from entries (profile, key, item): plain strings, or objects as JSON text, whose fields weigh
    on their own. Of a key whose objects have no weighed field an object counts as its text; other keys weigh nothing."""
    item = F.col("item")
    is_object = item.startswith("{")
    none = F.array().cast("array<struct<text:string,weight:double>>")

    def weighed(plain: float, fields: dict[str, float]) -> Column:
        part = lambda text, weight: F.struct(F.coalesce(text, F.lit("")).alias("text"), weight.alias("weight"))
        alone = F.array(part(item, F.lit(plain)))
        if not fields:
            return alone
        field = lambda f: F.get_json_object(item, f"$.{f}")
        by_field = F.array(*(part(field(f), strength_weight(field("strength")) if w == PLAIN_SKILL else F.lit(w)) for f, w in fields.items()))
        return F.when(is_object, by_field).otherwise(alone)

    by_key = F.coalesce(*(F.when(F.col("key") == k, weighed(plain, fields)) for k, (plain, fields) in WEIGHTS.items()), none)
    return items.select("profile", F.explode(by_key).alias("p")).select("profile", "p.text", "p.weight")


def bags_of(items: DataFrame) -> DataFrame:
    """profile, term, qw: the bags of merged profiles (profile, key, item), ready for a ranking."""
    return weighted_bag(parts(items))


def split_by_cache(units: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units to read, units with their cached extract) by content key; the cache is (unit_key, extract)."""
    keyed = units.withColumn("unit_key", content_key("text"))
    return keyed.join(cache, "unit_key", "left_anti"), keyed.join(cache, "unit_key")


def passage_request(text: Column, source: Column, section: Column | None = None) -> Column:
    """What an extractor reads: where the passage is from, with its section if it has one, and the passage."""
    where = F.lit("") if section is None else F.coalesce(F.concat(F.lit(", section: "), F.nullif(section, F.lit(""))), F.lit(""))
    return F.concat(F.lit("PASSAGE (source: "), F.coalesce(source, F.lit("")), where, F.lit("):\n\n"), text)


def extracted(todo: DataFrame, extractor: Callable[[str], str], at_once: int = 8, policy: Policy = Policy()) -> DataFrame:
    """One call for each distinct passage: unit_key, extract (JSON) and error; a failed call is a row, not an exception.
    The extractor gets `request` where there is such a column, else the text. At most `at_once` calls run at a time."""
    asked = F.min("request" if "request" in todo.columns else "text").alias("request")
    replies = made(todo.groupBy("unit_key").agg(asked), "unit_key", extractor, at_once, policy)
    return replies.withColumnRenamed("reply", "extract")


def fingerprint(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def shaped(c: Column) -> Column:
    """An extract (JSON text) as struct of KEYS, each array<string>: anything but an object has none,
    empty entries go, a lone value is one entry, unknown keys are dropped; objects stay JSON text."""
    return F.struct(*(entries_of(c, k).alias(k) for k in KEYS))


def has_content(shape: Column) -> Column:
    """Whether a shaped extract has an entry under any key."""
    return F.greatest(*(F.size(shape[k]) for k in KEYS)) > 0


def item_fingerprint(item: Column) -> Column:
    """An entry's name, else its role, else the whole of it, lower-cased and stripped."""
    named = F.coalesce(*(F.nullif(F.get_json_object(item, f"$.{k}"), F.lit("")) for k in ("name", "role")), item)
    return fingerprint(F.when(item.startswith("{"), named).otherwise(item))


def first_wins(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Of rows with one fingerprint in a group, the first in order; blank ones go. Firsts are combined before the
    shuffle, so that a very common fingerprint is no hot key."""
    printed = rows.withColumn("fingerprint", item_fingerprint(F.col(value))).where("fingerprint <> ''")
    rest = [c for c in rows.columns if c not in (group, *order)]
    first = printed.groupBy(group, "fingerprint").agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__x"))
    return first.select(group, "fingerprint", "__x.*").select(*rows.columns, "fingerprint")


def merged(extracts: DataFrame) -> DataFrame:
    """profile, key, pos, item: the union of extracts (profile, idx, extract as JSON) key by key, in
    order of idx and place; of entries with one fingerprint the first stays."""
    shape = extracts.select("profile", "idx", shaped(F.col("extract")).alias("shape")).where(has_content(F.col("shape")))
    keyed = F.array(*(F.struct(F.lit(k).alias("key"), F.col("shape")[k].alias("items")) for k in KEYS))
    rows = shape.select("profile", "idx", F.explode(keyed).alias("e")).select("profile", "idx", "e.key", F.posexplode("e.items").alias("at", "item"))
    rows = rows.withColumn("fingerprint", item_fingerprint(F.col("item"))).where("fingerprint <> ''")
    # the first of each fingerprint is combined before the shuffle, so a very common one is no hot key
    kept = rows.groupBy("profile", "key", "fingerprint").agg(F.min(F.struct("idx", "at", "item")).alias("x"))
    kept = kept.select("profile", "key", F.struct("profile", "key").alias("part"), "x.idx", "x.at", "x.item")
    return numbered_in(kept, "part", ["idx", "at"], "pos").select("profile", "key", "pos", "item")


def reduce_layers(n: Column, fan_in: int = FAN_IN) -> Column:
    """Layers of a tree reduction of n pieces; 0 for none or one."""
    return F.when(n <= 1, 0).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(F.lit(float(fan_in)), k) < n))).cast("long")


def tree_reduced(pieces: DataFrame, combine: Callable[[list[str]], str], fallback: Callable[[list[str]], str], fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """One piece of pieces (idx, piece), and the number of layers: `trees_reduced` of one profile."""
    rows = trees_reduced(pieces.select(F.lit(0).alias("profile"), "idx", "piece"), combine, fallback, fan_in)
    layers = rows.agg(F.coalesce(F.max("layers"), F.lit(0))).first()[0]
    return rows.select(F.lit(0).cast("long").alias("idx"), "piece"), layers


def trees_reduced(pieces: DataFrame, combine: Callable[[list[str]], str], fallback: Callable[[list[str]], str], fan_in: int = FAN_IN) -> DataFrame:
    """profile, piece, n_pieces, layers, n_failed from pieces (profile, idx, piece): for each profile its pieces folded, fan_in
    of them in each call, in order of idx, until one is left. Blank pieces go first; a failed call falls back, so no branch
    is lost; a profile of one piece is folded by no call, and one without any has no row.

    A layer is one job over all profiles, and no task holds more than fan_in pieces of one fold. Pieces get their
    places over all tasks, so one profile may have most of them. Each layer is written to the shared folder."""
    kind = pieces.schema["profile"].dataType.simpleString()
    filled = pieces.where(F.coalesce("piece", F.lit("")).rlike(r"(?U)\S"))
    placed = numbered_in(filled.select("profile", "idx", "piece"), "profile", ["idx", "piece"], "pos").select("profile", "pos", "piece", F.lit(0).cast("long").alias("n_failed"))
    now = staged(placed, "pieces")
    sizes = staged(now.groupBy("profile").agg(F.count("*").alias("n_pieces")).withColumn("layers", reduce_layers(F.col("n_pieces"), fan_in)), "sizes")
    layers = sizes.agg(F.coalesce(F.max("layers"), F.lit(0))).first()[0]

    def fold(batches):
        for pdf in batches:
            out = []
            for profile, slot, failed, found in zip(pdf["profile"], pdf["slot"], pdf["n_failed"], pdf["found"]):
                items = [x["piece"] for x in found]
                try:
                    piece = combine(items)
                except Exception:  # noqa: BLE001
                    piece, failed = fallback(items), failed + 1
                out.append((profile, slot, piece, failed))
            yield pd.DataFrame(out, columns=["profile", "pos", "piece", "n_failed"])

    for layer in range(layers):
        slots = now.join(sizes.where(F.col("layers") > layer).select(F.col("profile").alias("__p"), F.lit(True).alias("__on")), F.col("profile").eqNullSafe(F.col("__p")), "left").withColumn("goes_on", F.col("__on").isNotNull()).drop("__p", "__on")
        groups = slots.where("goes_on").groupBy("profile", F.floor(F.col("pos") / fan_in).alias("slot")).agg(F.sum("n_failed").alias("n_failed"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("found"))
        folded = groups.mapInPandas(fold, f"profile {kind}, pos long, piece string, n_failed long")
        now = staged(folded.union(slots.where("not goes_on").select("profile", "pos", "piece", "n_failed")), "pieces")
    return now.join(sizes.withColumnRenamed("profile", "__p"), F.col("profile").eqNullSafe(F.col("__p"))).select("profile", "piece", "n_pieces", "layers", "n_failed")


def percent(part: Column, whole: Column) -> Column:
    return F.bround(100 * part / F.greatest(whole, F.lit(1)), 0).cast("long")


def warning(n_units: int, n_failed: int, n_hits: int, first_error: str | None) -> str | None:
    if not n_units:
        return "there is nothing to read"
    if n_failed == n_units:
        return f"every passage failed: {first_error}"
    if n_failed:
        return f"{round(100 * n_failed / n_units)}% of passages failed ({n_failed} of {n_units}): {first_error}"
    return None if n_hits else "nothing usable was found in the documents"


# The labels and their order.
LABELS = {"skills": "SKILLS", "domains": "DOMAINS", "interests": "RESEARCH INTERESTS", "projects": "PROJECTS", "experience": "EXPERIENCE", "achievements": "ACHIEVEMENTS", "constraints": "CONSTRAINTS"}


def rendered(shape: Column, most: int = 6000) -> Column:
    """A shaped profile as labelled lines in a fixed order, blank entries left out, cut at `most` characters."""

    def shown(key: str, item: Column) -> Column:
        part = lambda k: F.coalesce(F.get_json_object(item, f"$.{k}"), F.lit("None"))
        form = {
            "skills": lambda: F.concat(part("name"), F.lit(" ("), part("strength"), F.lit(")")),
            "projects": lambda: F.concat(part("name"), F.lit(" — "), part("what")),
            "experience": lambda: F.concat(part("role"), F.lit(" at "), part("org"), F.lit(" — "), part("what")),
        }.get(key)
        return F.when(item.startswith("{"), form()).otherwise(item) if form else item

    def line(items: Column, key: str, label: str) -> Column:
        said = F.filter(F.transform(items, lambda x: shown(key, x)), lambda t: t.rlike(r"(?U)\S"))
        return bound(F.array_join(said, "; "), lambda t: F.when(t != "", F.concat(F.lit(f"{label}: "), t)))

    lines = bound(shape, lambda x: F.concat_ws("\n", *(line(x[k], k, label) for k, label in LABELS.items())))
    return bound(lines, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit(" …[truncated]"))))
