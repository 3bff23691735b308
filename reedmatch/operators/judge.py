"""Judging: batches, verdict JSON, the join back with every miss counted, ranking, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.jsons import clamped, lenient, strings
from .calls import Policy, made
from .profile import percent
from .rows import numbered

BATCH = 6
VERDICTS = "struct<verdicts:array<struct<projectId:string,score:string,rationale:string,evidence:string,gaps:string>>>"


def batched(ranked: DataFrame, order: list[Column], size: int = BATCH, limited: bool = True) -> DataFrame:
    """pos (from 0) and batch_no. `limited`: the few rows that a limit has left; else rows of a whole corpus, which are
    numbered over all tasks."""
    if limited:
        rows = ranked.withColumn("pos", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    else:
        rows = numbered(ranked, order, "pos")
    return rows.withColumn("batch_no", F.floor(F.col("pos") / size))


def item_json(title: Column, description: Column, skills: Column, roles: Column, id: Column | None = None, area: Column | None = None) -> Column:
    """What a judge sees of an item: the description with its area after it, cut at 2200 characters, and
    skills and roles cut at 600; empty ones are left out."""
    cut = lambda c, n: F.nullif(F.substring(F.coalesce(c, F.lit("")), 1, n), F.lit(""))
    full = F.concat_ws(" ", F.nullif(description, F.lit("")), *([] if area is None else [F.nullif(area, F.lit(""))]))
    first = [] if id is None else [id.alias("id")]
    return F.to_json(F.struct(*first, F.coalesce(title, F.lit("")).alias("title"), F.substring(full, 1, 2200).alias("description"), cut(skills, 600).alias("skills"), cut(roles, 600).alias("roles")))


def requests(candidates: DataFrame, profile_text: str) -> DataFrame:
    """batch_no and request, the text of one call: the profile and its items (batch_no, pos, item) in order."""
    lists = candidates.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), ",\n")
    return lists.select("batch_no", F.concat(F.lit(f"PROFILE:\n{profile_text}\n\nITEMS:\n["), body, F.lit("]")).alias("request"))


def called(requests: DataFrame, judge: Callable[[str], str], at_once: int = 8, policy: Policy = Policy()) -> DataFrame:
    """batch_no, reply, error, kind and tries of one call for each request, at most `at_once` at a time. A failed call is a
    row with an error, not an exception."""
    return made(requests, "batch_no", judge, at_once, policy)


def verdicts(replies: DataFrame) -> DataFrame:
    """batch_no, id, verdict from replies (batch_no, reply, error); the last of one id in a batch counts."""
    rows = replies.where("error is null").select("batch_no", F.posexplode(F.from_json(lenient(F.col("reply")), VERDICTS)["verdicts"]).alias("k", "v"))
    rows = rows.withColumn("id", F.trim(F.col("v.projectId"))).where("id <> ''")
    return rows.groupBy("batch_no", "id").agg(F.max_by("v", "k").alias("v"))


def joined(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates (batch_no, id, ...) with state judged, omitted or failed, and score, rationale,
    evidence, gaps of those judged, and the error of a failed call. Verdicts for ids that a batch
    doesn't hold are ignored."""
    failed = replies.where("error is not null").select("batch_no", "error")
    rows = candidates.join(verdicts(replies), ["batch_no", "id"], "left").join(failed, "batch_no", "left")
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("v").isNull(), "omitted").otherwise("judged")
    return rows.select(*candidates.columns, state.alias("state"), clamped(F.col("v.score")).alias("match_score"), F.coalesce("v.rationale", F.lit("")).alias("rationale"), strings(F.col("v.evidence")).alias("evidence"), strings(F.col("v.gaps")).alias("gaps"), "error")


def counters(rows: DataFrame) -> DataFrame:
    """One row: items and calls, each miss by its kind, and the error of the first failed call."""
    failed = F.col("state") == "failed"
    return rows.agg(
        F.count("*").alias("n_screened"),
        F.count_if(F.col("state") == "judged").alias("n_judged"),
        F.countDistinct("batch_no").alias("judge_calls"),
        F.countDistinct(F.when(failed, F.col("batch_no"))).alias("n_failed"),
        F.count_if(F.col("state") == "omitted").alias("n_dropped"),
        F.min(F.when(failed & (F.col("error") != ""), F.struct("batch_no", "error")))["error"].alias("first_error"),
    )


def warned(counts: DataFrame) -> DataFrame:
    """counters with a warning: what failed, or that nothing could be judged; null if all is well."""
    part = F.concat(F.col("n_failed").cast("string"), F.lit(" of "), F.col("judge_calls").cast("string"), F.lit(" calls ("), percent(F.col("n_failed"), F.col("judge_calls")).cast("string"), F.lit("%) failed"), F.coalesce(F.concat(F.lit(": "), F.col("first_error")), F.lit("")))
    return counts.withColumn("warning", F.when(F.col("n_failed") > 0, part).when(F.col("n_screened") == 0, "there is nothing to judge").when(F.col("n_judged") == 0, "no item could be judged"))


def ranked(rows: DataFrame, top_n: int | None = 20) -> DataFrame:
    """The best by score, ties in candidate order, with rank_no from 1."""
    n = min(100, max(1, top_n or 20))
    best = rows.where("state = 'judged'").orderBy(F.desc("match_score"), "pos").limit(n)
    return best.withColumn("rank_no", F.row_number().over(W.orderBy(F.desc("match_score"), "pos")))


def match_view(best: DataFrame, counts: DataFrame, item: Column, pool_size: int) -> DataFrame:
    """rank_no and view, a match as JSON: rank, score, rationale, evidence, gaps, its item, and the run's statistics;
    pool_size: items that the ranking chose from."""
    stats = F.struct(F.lit(pool_size).alias("poolSize"), F.col("n_screened").alias("screened"), F.col("n_judged").alias("judged"), F.col("judge_calls").alias("judgeCalls"), F.col("n_failed").alias("failedJudge"), F.col("n_dropped").alias("droppedIds"))
    match = F.struct(F.col("rank_no").alias("rank"), F.col("match_score").alias("score"), "rationale", "evidence", "gaps", item.alias("project"), stats.alias("stats"))
    return best.crossJoin(F.broadcast(counts)).select("rank_no", F.to_json(match).alias("view"))  # one row of counts


def markdown(c_rank: Column, score: Column, title: Column, body: Column, evidence: Column, gaps: Column, start: Column | None = None, id: Column | None = None, rationale: Column | None = None) -> Column:
    """One match as Markdown: its id, body and start date, the judge's rationale, how to find it again, evidence and
    gaps; what is null or empty is left out, and so is what no column is given for."""
    bullets = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n**{head}**\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))).otherwise("")
    framed = lambda before, c, after: F.lit("") if c is None else F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit("")), F.lit(after)), F.lit(""))
    head = F.concat(F.lit("## "), c_rank.cast("string"), F.lit(". ["), score.cast("string"), F.lit("] "), title, F.lit("\n\n"))
    about = F.concat(framed("ID `", id, "` · "), body, framed(" · starts ", start, ""), F.lit("\n"))
    search = framed("\nSearch for: `", None if id is None else title, "`\n")
    return F.concat(head, about, framed("\n", rationale, "\n"), search, bullets("Evidence", evidence), bullets("Gaps", gaps))


def export(matches: DataFrame, counts: DataFrame, pool_size: int, judge_name: str, note: str = "") -> DataFrame:
    """One row `markdown`: a head with the numbers read, the run's warning and a hand-off note if there
    are any, and all matches (rank_no, markdown) in order; no row without a match."""
    parts = matches.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank_no", "markdown"))).alias("ms")).where("n > 0")
    head = F.concat(F.lit("# Matches\n\n*"), F.col("n").cast("string"), F.lit(" items, ranked. Read "), F.col("n_screened").cast("string"), F.lit(f" of {pool_size} · {judge_name}.*\n"))
    quoted = lambda c: F.coalesce(F.concat(F.lit("\n> "), c, F.lit("\n")), F.lit(""))
    body = F.array_join(F.transform("ms", lambda m: F.concat(F.lit("\n"), m["markdown"])), "")
    return parts.crossJoin(F.broadcast(warned(counts))).select(F.concat(head, quoted(F.col("warning")), quoted(F.nullif(F.lit(note), F.lit(""))), body).alias("markdown"))
