"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds the
(blob, rule version) pairs scanned so far; only pairs outside it are scanned, one text for each
blob, and the findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import small, staged


@dataclass(frozen=True)
class Rule:
    """kind and version name a rule; every match of `pattern`, leftmost and not overlapping, counts
    if `keep` matches the whole of it. `gate` is a cheaper pattern that each kept match contains."""

    kind: str
    pattern: str
    keep: str
    gate: str
    version: int = 1


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", ASSIGN + r"[A-Za-z0-9+/_.=-]+", "^" + ASSIGN + r"[A-Za-z0-9+/_.=-]{12,}$", ASSIGN + r"[A-Za-z0-9+/_.=-]{12,}"),
    Rule("access", r"AKIA[A-Z0-9]+", r"^AKIA[A-Z0-9]{14,}$", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}", r"^[0-9a-f]{16,}$", r"[0-9a-f]{16,}"),
)
FINDINGS = "blob string, kind string, version int, start long, end long"
LEDGER = "blob string, kind string, version int"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """FINDINGS for rows (blob, text, kinds: the rules to apply): start and end in code points.

    Splitting a text at a pattern gives the pieces between its matches, so the running sum of
    the lengths of pieces and matches gives their places.
    """
    found = []
    for r in rules:
        here = F.array_contains("kinds", r.kind) & F.col("text").rlike(r.gate)
        found.append(F.when(here, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.keep).alias("keep"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("matches"), F.split("text", r.pattern, -1).alias("between"))))
    rows = blobs.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    rows = rows.select("blob", "f.kind", "f.version", "f.keep", F.posexplode(F.arrays_zip("f.matches", "f.between")).alias("k", "m")).where("m.matches is not null")
    order = W.partitionBy("blob", "kind").orderBy("k")
    rows = rows.select("blob", "kind", "version", "k", F.length("m.between").alias("gap"), F.length("m.matches").alias("size"), F.rlike(F.col("m.matches"), F.col("keep")).alias("kept"))
    end = F.sum(F.col("gap") + F.col("size")).over(order).cast("long")
    return rows.withColumn("end", end).where("kept").select("blob", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end")


#: Rows of the ledger's unseen blobs up to which they are broadcast: about 150 bytes each.
MOST_BROADCAST = 100_000


def update(versions: DataFrame, ledger: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what the ledger lacks: rows of `versions` are (path, text), one for each version of a path.

    Returns (paths: path and blob for each row of versions, new ledger rows, new findings), all
    staged. Null text is empty; repeated rows and copies share one blob and are scanned once; a
    null path is kept in `paths`; extra columns are ignored. `advanced` adds the earlier findings.
    """
    paths = staged(versions.select("path", blob_id(F.col("text")).alias("blob")), "paths")
    # copies are combined before the shuffle, so a blob with very many paths is no hot key
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    kinds = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    wanted = first.select("blob", F.explode(kinds).alias("r")).select("blob", "r.kind", "r.version")
    new = staged(wanted.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti"), "ledger")
    todo = small(staged(new.groupBy("blob").agg(F.collect_list("kind").alias("kinds")).join(first, "blob"), "unseen"), MOST_BROADCAST)
    texts = versions.select(F.col("path").alias("p"), F.coalesce("text", F.lit("")).alias("text"), blob_id(F.col("text")).alias("b"))
    unseen = texts.join(todo, F.col("p").eqNullSafe(F.col("path")) & (F.col("b") == F.col("blob")))
    gate = F.lit(False)
    for r in rules:
        gate = gate | (F.array_contains("kinds", r.kind) & F.col("text").rlike(r.gate))  # bound to the unseen pairs
    scanned = unseen.where(gate).select("blob", "text", "kinds").dropDuplicates(["blob"])
    return paths, new, staged(scan_blobs(scanned, rules), "findings")


def advanced(versions: DataFrame, ledger: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One whole step: (paths as from `update`, the ledger with its new rows, the findings of the
    rules' current versions, earlier and new). Earlier findings count if the ledger holds their pair."""
    paths, new, found = update(versions, ledger, findings, rules)
    pairs = ledger.select("blob", "kind", "version").distinct()
    earlier = current(findings, rules).join(pairs, ["blob", "kind", "version"], "left_semi").select("blob", "kind", "version", "start", "end")
    return paths, pairs.union(new.select("blob", "kind", "version")), earlier.union(found.select("blob", "kind", "version", "start", "end"))


def current(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of the versions that the rules have now."""
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return findings.where(now)


def spans_by_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of paths: its number of findings by kind (n_<kind>) and `spans`, an array of
    (start, rank of the kind in the rules, kind, end) in that order; empty without findings.
    Findings of other versions than the rules' are left out."""
    rank = F.coalesce(*(F.when(F.col("kind") == r.kind, F.lit(k)) for k, r in enumerate(rules)))
    by_blob = current(findings, rules).groupBy("blob").agg(*(F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules), F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    out = paths.join(small(staged(by_blob, "spans"), MOST_BROADCAST), "blob", "left")  # written, so that a blob with very many paths can be split
    return out.select("path", "blob", *(F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules), "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; empty for none."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
