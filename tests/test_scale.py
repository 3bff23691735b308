"""The index and its segments, row numbers, trees of profiles, runs and calls."""

import glob
import json
import random
import re
from collections import defaultdict
from statistics import median

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from reedmatch.functions import jsons
from reedmatch.operators import bm25, calls, index, judge, profile, rows, runs, terms
from reedmatch.sources import ingest, staging

ITEM = "idx long, title string, text string"


def corpus(spark, n=400, seed=3):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(120)]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(120)], k=rng.randint(0, 60))) for _ in range(n)]
    return [(k, " ".join(t.split()[:2]), t) for k, t in enumerate(texts)]


def bag(spark, terms):
    return spark.createDataFrame(list(terms.items()), "term string, qw double")


BAG = {"word3": 2.0, "word40": 1.0, "word7": 1.5, "absent": 4.0, "word110": 3.0}


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_index_is_pruned_and_balanced(spark, tmp_path):
    items = spark.createDataFrame(corpus(spark, 1500), ITEM)
    folder = str(tmp_path / "index")
    bm25.write_index(items, folder, block=16, rows_of_file=300)
    ix = bm25.read_index(spark, folder)
    assert ix.parts[0].buckets > 1
    plan = ix.lists(bag(spark, BAG))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term, ", plan)
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{folder}/*/postings/*/*.parquet")]
    assert len(sizes) > 10 and max(sizes) <= 2 * median(sizes)
    frequent = [f for f in glob.glob(f"{folder}/*/postings/*/*.parquet") if "word0" in pq.read_table(f, columns=["term"], partitioning=None)["term"].to_pylist()]
    assert frequent
    assert pairs(bm25.top(None, bag(spark, BAG), 25, ix)) == pairs(bm25.top(items, bag(spark, BAG), 25))
    assert tuple(bm25.statistics(ix).first()) == tuple(bm25.corpus(items).first())
    with pytest.raises(ValueError):
        bm25.write_index(items, folder)


def test_terms_are_counted_in_place(spark, monkeypatch):
    """As the plain functions have them, also over slices; a written index needs no shuffle of its words."""
    odd = ["The. the of. C++ node.js -- a-b- c+", "Étude \u0130st K\u212aLVIN 3d 86x-y ...tail. 9abc", "x" * 70_000, "", None, "a\tb\nabc\u0000def -.-abc.-", "3.14 #tag data. data"]
    rows_ = [(k, t and t[:9], t) for k, t in enumerate(odd)] + [(k + 10, *r[1:]) for k, r in enumerate(corpus(spark, 60))] + [(None, None, "none here")]
    items = spark.createDataFrame(rows_, ITEM).coalesce(1)
    monkeypatch.setattr(terms, "SLICE_CHARS", 300)
    got = terms.counted(items)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    flat = {(r["idx"], r["dl"], t, x >> 1, x % 2 == 1) for r in got for t, x in zip(r["terms"], r["numbers"])}
    assert flat == {tuple(r) for r in terms.entries(items).where("term is not null").collect()}
    assert all(r["n"] == len(r["terms"]) == len(r["numbers"]) for r in got)
    assert {(r["idx"], r["dl"]) for r in got} == {tuple(r) for r in terms.lengths(items).collect()}


def test_items_are_two_values_and_lists_are_made_in_passes(spark, tmp_path, monkeypatch):
    """an item's terms are kept as one string and its numbers as one value; lists of few blocks at a time are the same lists."""
    items = spark.createDataFrame(corpus(spark, 90), ITEM)
    monkeypatch.setattr(index, "POSTINGS_OF_PASS", 40)
    bm25.write_index(items, str(tmp_path / "index"), block=8)
    ix = bm25.read_index(spark, str(tmp_path / "index"))
    kept = ix.items()
    assert kept.schema["terms"].dataType.simpleString() == "string" and kept.schema["numbers"].dataType.simpleString() == "binary"
    assert {(r["idx"], r["dl"], t, x >> 1, x % 2 == 1) for r in kept.collect() for t, x in zip(r["terms"].split(" "), memoryview(r["numbers"]).cast("i"))} == {tuple(r) for r in terms.entries(items).where("term is not null").collect()}
    assert sorted(pairs(ix.hits(None))) == sorted(pairs(terms.entries(items).where("term is not null").select("idx", "dl", "term", "tf", "in_title")))


def test_items_that_are_there_twice(spark, tmp_path):
    """Equal rows of one item are one posting, and a null idx is an item."""
    rows_ = [*corpus(spark, 50), *corpus(spark, 50)[:9], (None, "word3", "word3 word7"), (None, "word3", "word3 word7")]
    items = spark.createDataFrame(rows_, ITEM)
    bm25.write_index(items, str(tmp_path / "index"))
    ix = bm25.read_index(spark, str(tmp_path / "index"))
    want = terms.entries(items)
    assert sorted(map(repr, pairs(ix.hits(None)))) == sorted(map(repr, pairs(want.where("term is not null").select("idx", "dl", "term", "tf", "in_title"))))
    assert tuple(bm25.statistics(ix).first()) == tuple(bm25.statistics(want).first())


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame(corpus(spark, 100), ITEM)
    bm25.write_index(items, str(tmp_path / "index"), rows_of_file=200)
    monkeypatch.setattr(index, "MOST_TERMS", 2)
    ix = bm25.read_index(spark, str(tmp_path / "index"))
    assert pairs(bm25.top(None, bag(spark, BAG), 10, ix)) == pairs(bm25.top(items, bag(spark, BAG), 10))


def test_changes_equal_a_rebuild(spark, tmp_path):
    rows_ = corpus(spark)
    folder = str(tmp_path / "index")
    old, new = rows_[:250], rows_[250:300]
    bm25.write_index(spark.createDataFrame(old, ITEM), folder)
    index.change(spark, folder, spark.createDataFrame(new, ITEM))
    changed = [(k, "word40", "word3 word3 new") for k in range(0, 300, 9)]
    index.change(spark, folder, spark.createDataFrame(changed, ITEM), spark.createDataFrame([(5,), (6,), (9,), (260,), (9999,)], "idx long"))
    back = [(5, "word7", "word7 is back")]
    index.change(spark, folder, spark.createDataFrame(back, ITEM))
    now = {r[0]: r for r in old + new} | {r[0]: r for r in changed}
    for k in (5, 6, 260):
        now.pop(k, None)
    now |= {5: back[0]}
    whole = spark.createDataFrame(list(now.values()), ITEM)
    want = pairs(bm25.top(whole, bag(spark, BAG), 40))

    def holds():
        ix = bm25.read_index(spark, folder)
        assert pairs(bm25.top(None, bag(spark, BAG), 40, ix)) == want
        got, n, read = bm25.top_by_bounds(ix, bag(spark, BAG), 7, seeds=2)
        assert pairs(got) == want[:7] and read <= n
        assert tuple(ix.statistics().first()) == pytest.approx(tuple(bm25.corpus(whole).first()))
        assert sorted(r[0] for r in ix.documents().select("idx").collect()) == sorted(now)
        return ix

    ix = holds()
    assert len(ix.parts) == 4
    plan = ix.hits(bag(spark, BAG))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
    index.compact(spark, folder, keep=1)
    assert [(p.first, p.last) for p in holds().parts] == [(1, 1), (2, 4)]
    index.compact(spark, folder)
    assert len(holds().parts) == 1
    index.change(spark, folder, deleted=spark.createDataFrame([(0,)], "idx long"))
    assert len(bm25.read_index(spark, folder).parts) == 2


def test_unfinished_segments_are_not_seen(spark, tmp_path):
    folder = str(tmp_path / "index")
    bm25.write_index(spark.createDataFrame(corpus(spark, 20), ITEM), folder)
    (tmp_path / "index" / "segment-2-2" / "postings").mkdir(parents=True)
    assert len(bm25.read_index(spark, folder).parts) == 1
    assert bm25.read_index(spark, str(tmp_path / "none")).documents().count() == 0
    assert bm25.top(None, bag(spark, BAG), 5, bm25.read_index(spark, str(tmp_path / "none"))).count() == 0


def test_bounds_leave_lists_unread(spark, tmp_path):
    rows_ = corpus(spark, 3000)
    rows_ += [(5000 + k, "word110 word40", "word110 word40 word3 " * 3) for k in range(12)]  # ties at the top
    items = spark.createDataFrame(rows_, ITEM)
    folder = str(tmp_path / "index")
    bm25.write_index(items, folder, block=8)
    ix = bm25.read_index(spark, folder)
    for width in (1, 5, 12, 30):
        got, n, read = bm25.top_by_bounds(ix, bag(spark, BAG), width, seeds=16)
        assert pairs(got) == pairs(bm25.top(items, bag(spark, BAG), width))
        assert width > 12 or read < 0.5 * n
    none = bag(spark, {"x": 1.0}).where("false")
    assert pairs(bm25.top_by_bounds(ix, none, 3)[0]) == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert bm25.top_by_bounds(ix, bag(spark, BAG), 0)[0].count() == len(rows_)


def test_no_allowed_values_is_no_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "idx long, source string")
    assert [bm25.kept(df, "source", v).count() for v in (None, (), ["a"], ("a", "b"), ["z"])] == [3, 3, 1, 2, 0]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = rows.numbered(df, [F.desc("k")], "no", parts=7)
    assert sorted((r["no"], r["k"]) for r in got.collect()) == [(i, 999 - i) for i in range(1000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    inside = rows.numbered_in(df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), "g", ["k"]).collect()
    by = defaultdict(list)
    for r in sorted(inside, key=lambda r: r["k"]):
        by[r["g"]].append(r["pos"])
    assert len(by) == 3 and all(v == list(range(len(v))) for v in by.values())
    assert rows.numbered(df.where("false"), ["k"]).count() == 0
    batches = judge.batched(df, [F.col("k")], 6, limited=False).collect()
    assert all(r["batch_no"] == r["pos"] // 6 for r in batches) and {r["pos"] for r in batches} == set(range(1000))


def fold(pieces, fan_in, fails):
    layers, failed = 0, 0
    while len(pieces) > 1:
        groups = [pieces[k : k + fan_in] for k in range(0, len(pieces), fan_in)]
        failed += sum(any(fails in p for p in g) for g in groups)
        pieces = ["|".join(g) if any(fails in p for p in g) else "(" + "+".join(g) + ")" for g in groups]
        layers += 1
    return pieces[0], layers, failed


def test_trees_of_many_profiles(spark):
    sizes = {"a": 1, "b": 2, "c": 6, "d": 7, "e": 36, "f": 37, "g": 400, None: 8}
    made = [(p, k, f"{p}{k}") for p, n in sizes.items() for k in range(n)] + [("h", 0, " "), ("h", 1, None), ("a", 5, "")]

    def combine(xs):
        if any("g77" in x for x in xs):
            raise RuntimeError
        return "(" + "+".join(xs) + ")"

    df = spark.createDataFrame(made, "profile string, idx long, piece string").repartition(5)
    got = {r["profile"]: r for r in profile.trees_reduced(df, combine, "|".join).collect()}
    assert set(got) == set(sizes)
    for p, n in sizes.items():
        want = fold([f"{p}{k}" for k in range(n)], 6, "g77")
        assert (got[p]["piece"], got[p]["layers"], got[p]["n_failed"], got[p]["n_pieces"]) == (*want, n)
    assert profile.trees_reduced(df.where("false"), combine, "|".join).count() == 0


class Clock:
    def __init__(self):
        self.waits = []

    def sleep(self, s):
        self.waits.append(s)


def policy(clock, **more):
    return calls.Policy(sleep=clock.sleep, jitter=lambda: 0.0, **more)


@pytest.mark.parametrize(
    "failure, waits, tries, error",
    [
        (calls.CallFailed("429 slow down", 429, "7"), [7.0, 7.0], 3, "429 slow down"),
        (calls.CallFailed("429", 429, None, '{"error": {"details": [{"retryDelay": "12.5s"}]}}'), [12.5, 12.5], 3, "429"),
        (calls.CallFailed("429", 429, None, "please retry in 900 s"), [50.0, 50.0], 3, "429"),
        (calls.CallFailed("bad key", 401, "9"), [], 1, "bad key"),
        (calls.CallFailed("down", 503), [1.5, 3.0], 3, "down"),
        (ValueError("could not parse JSON"), [1.5, 3.0], 3, "could not parse JSON"),
        (KeyError(), [1.5, 3.0], 3, "KeyError"),
    ],
)
def test_waits_of_calls(failure, waits, tries, error):
    clock = Clock()

    def call(_):
        raise failure

    assert policy(clock).reply(call, "x") == (None, error, tries) and clock.waits == waits
    left = [failure]

    def once(_):
        if left:
            raise left.pop()
        return "fine"

    assert policy(clock).reply(once, "x") == ((None, error, 1) if tries == 1 else ("fine", None, 2))


def test_named_waits_equal_the_columns(spark):
    cases = [("2.5", "{}"), (None, '{"details": [{"retryDelay": "45s"}]}'), (None, "please retry in 7.5 s"), (None, ""), ("soon", '{"error": {"message": "Retry in 3"}}')]
    df = spark.createDataFrame(cases, "h string, b string")
    assert [r[0] for r in df.select(jsons.retry_delay(F.col("h"), F.col("b"))).collect()] == [calls.wait_named(*c) for c in cases]


def test_calls_of_a_table(spark):
    def call(request):
        if request == "3":
            raise calls.CallFailed("429 quota", 401)
        if request == "4":
            raise RuntimeError("connect timeout")
        return request * 2

    df = spark.range(30).select(F.col("id").alias("k"), F.when(F.col("id") != 5, F.col("id").cast("string")).alias("request"))
    got = {r["k"]: tuple(r)[1:] for r in calls.made(df, "k", call, at_once=6, policy=calls.Policy(threads=3, attempts=1)).collect()}
    assert len(got) == 30 and got[7] == ("77", None, 1, None)
    assert got[3] == (None, "429 quota", 1, "rate_limit") and got[4] == (None, "connect timeout", 1, "network") and got[5] == (None, "no request", 0, "other")
    assert calls.made(df, "k", call, at_once=6, policy=calls.Policy(threads=3)).rdd.getNumPartitions() == 2


def test_a_run_is_taken_up_again(spark, tmp_path):
    texts = ["good one", "good two", "bad", "empty", "good one", "worse"]
    units = spark.createDataFrame([("p" if k < 5 else "q", k, t) for k, t in enumerate(texts)], "profile string, idx long, text string")
    seen = tmp_path / "seen"
    seen.mkdir()

    def extractor(well):
        def call(text):
            (seen / f"{well}-{text.replace(' ', '_')}-{random.random()}").touch()
            if text == "worse" or (text == "bad" and not well):
                raise calls.CallFailed("no quota", 402)
            return "{}" if text == "empty" else json.dumps({"skills": [{"name": text.split()[-1]}], "interests": "all"})

        return call

    asked = lambda well: sorted(p.name.split("-")[1] for p in seen.glob(f"{well}-*"))
    folder = str(tmp_path / "cache")
    one = runs.build(units, folder, extractor(0))
    counts = {r["profile"]: r for r in one.counters.collect()}
    assert [counts["p"][c] for c in ("n_units", "n_cached", "n_failed", "n_hits", "first_error")] == [5, 0, 1, 3, "no quota"]
    assert counts["p"]["warning"].startswith("1 of 5 passages (20%) failed") and counts["q"]["warning"].startswith("no profile yet")
    assert asked(0) == ["bad", "empty", "good_one", "good_two", "worse"]
    two = runs.build(units, folder, extractor(1), batch="again")
    assert asked(1) == ["bad", "empty", "worse"]
    counts = {r["profile"]: r for r in two.counters.collect()}
    assert [counts["p"][c] for c in ("n_units", "n_cached", "n_failed", "n_hits", "warning")] == [5, 3, 0, 4, None]
    assert [(r["key"], r["item"]) for r in two.items.orderBy("key", "pos").collect()] == [("interests", "all"), ("skills", '{"name":"one"}'), ("skills", '{"name":"two"}'), ("skills", '{"name":"bad"}')]
    before = sorted(map(tuple, runs.read_cache(spark, folder).collect()))
    runs.append(runs.read_cache(spark, folder).where("false"), folder, "again2")
    (tmp_path / "cache" / "batch-broken").mkdir()
    runs.compact(spark, folder)
    assert sorted(map(tuple, runs.read_cache(spark, folder).collect())) == before and len(before) == 3
    runs.append(spark.createDataFrame(before, runs.CACHE), folder, "x")
    runs.append(spark.createDataFrame(before, runs.CACHE), folder, "x")  # a repeated write
    assert len(before) == runs.read_cache(spark, folder).count()
    nothing = runs.build(units.where("false"), folder, extractor(1))
    assert nothing.counters.count() == nothing.items.count() == nothing.calls.count() == 0


def test_a_run_that_breaks_off_keeps_its_waves(spark, tmp_path):
    units = spark.createDataFrame([("p", k, f"text {k}") for k in range(60)], "profile string, idx long, text string")
    seen = tmp_path / "seen"
    seen.mkdir()

    def extractor(stops):
        def call(text):
            if stops and text == "text 31":
                raise SystemExit("lost")
            (seen / f"{stops}-{text}-{random.random()}").touch()
            return json.dumps({"skills": [text]})

        return call

    folder = str(tmp_path / "cache")
    with pytest.raises(Exception):  # noqa: B017
        runs.build(units, folder, extractor(True), wave=6)
    done = runs.read_cache(spark, folder).count()
    run = runs.build(units, folder, extractor(False), wave=6)
    assert 60 - done == len(list(seen.glob("False-*"))) and run.counters.first()["n_hits"] == 60
    assert run.calls.count() == 60 - done and run.items.count() == 60


def test_passage_requests(spark):
    df = spark.createDataFrame([("t", "s", "h"), ("t", "s", ""), ("t", None, None)], "t string, s string, h string")
    got = [r[0] for r in df.select(profile.passage_request(F.col("t"), F.col("s"), F.col("h"))).collect()]
    assert got == ["PASSAGE (source: s, section: h):\n\nt", "PASSAGE (source: s):\n\nt", "PASSAGE (source: ):\n\nt"]


def test_delimiters(spark):
    texts = {
        'name;"a,b,c,d"\n1;2': ";",
        "a,b;c\n1,2;3": ",",  # a tie
        'x|y\n"a,b|c"|2\n"line\none,,"|3': "|",
        "k\tv\n1\t2,3\n": "\t",
        "only": ",",
        "": ",",
        "a;b\n" + "1,2;3\n" * 3000: ";",
        '"q""x,y";z\n1;2': ";",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ingest.delimiter_of(F.col("t"))).collect()] == list(texts.values())
    docs = spark.createDataFrame([("0", "t", 'name;"a,b,c,d"\n1;2', "csv", "")], ingest.SCHEMA)
    assert ingest.labelled_rows(docs, F.lit(True)).first()["text"] == "# t\n\n## Row 1\nname: 1\na,b,c,d: 2"


def test_files_in_a_table(spark):
    rows_ = [("/x/a.md", b"one"), ("/x/b.csv", "k;v\n1;é\n".encode("utf-8-sig")), ("c.txt", None), ("d.docx", b"no archive"), ("e.txt", "\u00e9".encode("utf-16"))]
    got = {r["title"]: (r["text"], r["kind"], r["error"][:23]) for r in ingest.documents_of(spark.createDataFrame(rows_, "path string, content binary")).collect()}
    assert got["a.md"] == ("one", "md", "") and got["b.csv"] == ("# b.csv\n\n## Row 1\nk: 1\nv: é", "csv", "")
    assert got["c.txt"] == ("", "text", "the file is empty") and got["d.docx"] == ("", "docx", "could not read the file") and got["e.txt"][0] == "\u00e9"


def test_export_names_what_it_shows(spark):
    row = spark.createDataFrame([(1, 80, "Title", "body", ["e"], [], "id7", "because")], "r int, s int, t string, b string, e array<string>, g array<string>, i string, w string")
    md = row.select(judge.markdown(F.col("r"), F.col("s"), F.col("t"), F.col("b"), F.col("e"), F.col("g"), None, F.col("i"), F.col("w"))).first()[0]
    assert md == "## 1. [80] Title\n\nID `id7` · body\n\nbecause\n\nSearch for: `Title`\n\n**Evidence**\n- e\n"


def test_runs_delete_what_they_staged(spark):
    with staging.run(spark) as folder:
        a = staging.staged(spark.range(3), "a")
        with staging.run(spark) as deeper:
            assert deeper.startswith(folder)
            staging.staged(spark.range(3), "b")
        assert not glob.glob(f"{deeper}/*") and a.count() == 3
        kept = staging.staged_alone(spark, lambda: staging.staged(spark.range(5), "c"), "d")
        assert kept.count() == 5 and not glob.glob(f"{folder}/run-*")
    assert not glob.glob(f"{folder}/*")


def test_small_scans_are_spread_by_bytes(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert staging.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(staging, "SMALL_SCAN", 10)
    assert staging.spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_an_index_follows_a_stream(spark, tmp_path):
    from reedmatch.streaming import indexed_items

    rows_ = corpus(spark, 60)
    source, folder, checkpoint = (str(tmp_path / n) for n in ("items", "index", "checkpoint"))
    changed = (7, "word3 word40", "word3 word40 word110")
    for step in (rows_[:40], [*rows_[40:], changed]):
        spark.createDataFrame(step, ITEM).coalesce(1).write.mode("append").parquet(source)
        indexed_items(spark, source, folder, checkpoint).awaitTermination()
    now = spark.createDataFrame([r for r in rows_ if r[0] != 7] + [changed], ITEM)
    ix = bm25.read_index(spark, folder)
    assert len(ix.parts) == 2 and pairs(bm25.top(None, bag(spark, BAG), 20, ix)) == pairs(bm25.top(now, bag(spark, BAG), 20))


def test_counts_by_hour(spark):
    from reedmatch.streaming import counts_by_hour

    df = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:00:00', 'b'")
    assert sorted(r["n"] for r in counts_by_hour(df).collect()) == [1, 2]


def test_a_build_moves_texts_once_and_merges_on_demand(spark, tmp_path, monkeypatch):
    """cached keys that are too many to broadcast are dealt with the passages; what is staged holds no text; profiles are merged when asked for."""
    labels, merges = [], []
    stage, merge = runs.staged, runs.merged
    monkeypatch.setattr(runs, "staged", lambda df, label: (labels.append((label, df.columns)), stage(df, label))[1])
    monkeypatch.setattr(runs, "merged", lambda df: (merges.append(1), merge(df))[1])
    units = spark.createDataFrame([("p", k, f"word{k % 25} text" if k else None) for k in range(60)], "profile string, idx long, text string")
    counts = {}
    for most in (0, 500_000):
        monkeypatch.setattr(runs, "MOST_KEYS", most)
        folder, asked = str(tmp_path / f"cache-{most}"), lambda text: json.dumps({"skills": [text.split()[0]] if int(text[4:6]) % 3 else []})
        runs.build(units.where("idx < 40"), folder, asked)
        run = runs.build(units, folder, asked, wave=4)
        assert not merges
        counts[most] = [tuple(run.counters.first()), sorted(map(str, run.calls.collect())), sorted(map(str, run.items.collect()))]
        assert merges and not merges.clear()
    assert counts[0] == counts[500_000] and len(counts[0][2]) == 16 and len(counts[0][1]) == 10
    assert labels and not any({"text", "request"} & set(columns) for _, columns in labels)


def test_a_wave_reads_its_own_passages(spark, tmp_path, monkeypatch):
    plans, made = [], runs.made
    monkeypatch.setattr(runs, "made", lambda todo, *a: (plans.append(todo._jdf.queryExecution().executedPlan().toString()), made(todo, *a))[1])
    units = spark.createDataFrame([("p", k, f"word{k % 25} text") for k in range(40)], "profile string, idx long, text string")
    run = runs.build(units, str(tmp_path / "cache"), lambda text: json.dumps({"skills": [text.split()[0]]}), wave=6)
    assert len(plans) == 5 and all(re.search(rf"PartitionFilters: \[[^]]*wave#\d+ = {k}\)", plan) for k, plan in enumerate(plans))
    assert run.calls.count() == 25 and run.items.count() == 25
    assert run.counters.select("n_units", "n_hits", "n_cached").first() == (40, 40, 0)


def test_scores_of_many_profiles_are_summed_where_hits_lie(spark):
    items = spark.createDataFrame(corpus(spark, 80), ITEM)
    bags = spark.createDataFrame([(p, f"word{k}", 1.0 + p) for p in range(4) for k in range(p, 40, 3)], "profile long, term string, qw double")
    got = bm25.top_of_many(items, bags, 5)
    assert not re.search(r"hashpartitioning\(profile#\d+L?, idx", got._jdf.queryExecution().executedPlan().toString())
    for p in range(4):
        want = [tuple(r) for r in bm25.top(items, bags.where(F.col("profile") == p).select("term", "qw"), 5).collect()]
        assert sorted((r["rank_no"], r["idx"], r["score"]) for r in got.where(F.col("profile") == p).collect()) == [(k + 1, *w) for k, w in enumerate(want)]


def test_short_items_share_larger_blocks(spark, tmp_path, monkeypatch):
    """unless its size is given, a block has as many short items as have some number of words, so fewer rows; long ones keep theirs."""
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "WORDS_OF_BLOCK", 300)
    rows_ = [(k, "word3", f"word3 word{k % 5} word40") for k in range(200)] + [(200 + k, "word7", "word7 word40 word110 " * 100) for k in range(16)]
    items = spark.createDataFrame(rows_, ITEM)
    bm25.write_index(items, str(tmp_path / "index"))
    ix = bm25.read_index(spark, str(tmp_path / "index"))
    blocks = ix.hits(None).select("idx", "dl").distinct().join(ix.lists(None).select("block", F.explode("ids").alias("idx")).distinct(), "idx")
    found = {r["short"]: r["n"] for r in blocks.groupBy((F.col("dl") < 10).alias("short")).agg(F.countDistinct("block").alias("n")).collect()}
    assert found[True] <= 4 and 2 < found[False] <= 4
    assert pairs(bm25.top(None, bag(spark, BAG), 30, ix)) == pairs(bm25.top(items, bag(spark, BAG), 30))
    assert pairs(bm25.top_by_bounds(ix, bag(spark, BAG), 9, seeds=2)[0]) == pairs(bm25.top(items, bag(spark, BAG), 9))


def test_a_change_writes_items_once_and_postings_are_told_from_dead_ones_once(spark, tmp_path, monkeypatch):
    """a change's items are written into its segment alone; a ranking over segments explodes its postings once."""
    labels, exploded, stage, posted = [], [], staging.staged, index.Index.postings
    for module in (index, bm25):
        monkeypatch.setattr(module, "staged", lambda df, label: (labels.append(label), stage(df, label))[1])
    monkeypatch.setattr(index.Index, "postings", lambda self, lists: (exploded.append(1), posted(self, lists))[1])
    monkeypatch.setattr(index.Index, "frequencies", lambda self, lists: pytest.fail("postings are read twice"))
    old, new = corpus(spark, 60), [(k, "word40", "word3 word3 new") for k in range(50, 70)]
    bm25.write_index(spark.createDataFrame(old, ITEM), str(tmp_path / "index"))
    index.change(spark, str(tmp_path / "index"), spark.createDataFrame(new, ITEM))
    assert "counted" not in labels
    got = pairs(bm25.top(None, bag(spark, BAG), 25, bm25.read_index(spark, str(tmp_path / "index"))))
    assert got == pairs(bm25.top(spark.createDataFrame(old[:50] + new, ITEM), bag(spark, BAG), 25))
    assert labels.count("hits") == 2 and len(exploded) == 1  # once from the index, once from the texts


def test_calls_of_a_wave_shuffle_no_request(spark, tmp_path, monkeypatch):
    """passages lie in parts for the calls' tasks; what was added to the cache is not parsed again; at most at_once calls run."""
    plans, shapes, made, shaped = [], [], runs.made, runs.shaped

    def watched(*args):
        replies = made(*args)
        plans.append((replies._jdf.queryExecution().executedPlan().toString(), replies.rdd.getNumPartitions()))
        return replies

    monkeypatch.setattr(runs, "made", watched)
    monkeypatch.setattr(runs, "shaped", lambda c: (shapes.append(1), shaped(c))[1])
    units = spark.createDataFrame([("p", k, f"word{k % 25} text") for k in range(40)], "profile string, idx long, text string")
    for at_once in (1, 3, 11):
        folder = str(tmp_path / f"cache-{at_once}")
        run = runs.build(units, folder, lambda text: json.dumps({"skills": [text.split()[0]] if "7" not in text else []}), at_once=at_once, wave=9)
        assert len(shapes) == len(plans) == 3  # one for each wave
        assert all("Exchange" not in plan and tasks * max(1, min(4, at_once // min(at_once, spark.sparkContext.defaultParallelism))) <= at_once for plan, tasks in plans)
        assert run.calls.count() == 25 and sorted(r["unit_key"] for r in runs.read_cache(spark, folder).collect()) == sorted(r["unit_key"] for r in run.calls.where("extract like '%word%'").collect())
        assert run.counters.select("n_units", "n_hits", "n_cached", "n_failed").first() == (40, 37, 0, 0)
        plans.clear(), shapes.clear()


def test_a_build_that_breaks_off_adds_the_wave_before(spark, tmp_path, monkeypatch):
    """A wave is added beside the next one's calls; if those break off, it is in the cache all the same."""
    made, waves = runs.made, []
    monkeypatch.setattr(runs, "made", lambda *args: (waves.append(1), made(*args) if len(waves) < 3 else 1 / 0)[1])
    units = spark.createDataFrame([("p", k, f"word{k} text") for k in range(30)], "profile string, idx long, text string")
    asked = lambda text: json.dumps({"skills": [text.split()[0]]})
    with pytest.raises(ZeroDivisionError):
        runs.build(units, str(tmp_path / "cache"), asked, wave=10)
    known = runs.read_cache(spark, str(tmp_path / "cache")).count()
    assert 0 < known < 30
    monkeypatch.setattr(runs, "made", made)
    assert runs.build(units, str(tmp_path / "cache"), asked).counters.select("n_cached", "n_hits").first() == (known, 30)


def test_texts_of_cached_keys_are_not_shuffled(spark, tmp_path, monkeypatch):
    """also where cached keys are too many to broadcast, a run that is taken up again moves the texts alone that it reads."""
    units = spark.createDataFrame([("p", k, f"word{k % 50} text") for k in range(100)] + [("p", 100, None)], "profile string, idx long, text string")
    asked = lambda text: json.dumps({"skills": [text.split()[0]] if int(text.split()[0][4:]) % 5 else []})
    dealt, found = [], {}
    write = DataFrameWriter.parquet

    def seen(writer, path, *a, **k):
        write(writer, path, *a, **k)
        if "/todo-" in path:
            dealt.append(writer._df)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    for name, most, hashes in (("broadcast", 500, 500), ("hashes", 0, 500), ("same hash", 0, 500), ("dealt", 0, 0)):
        with monkeypatch.context() as m:
            m.setattr(runs, "MOST_KEYS", most)
            m.setattr(runs, "MOST_HASHES", hashes)
            if name == "same hash":  # then cached keys pass with those that are not, and are told apart where they meet
                hashed = F.xxhash64
                m.setattr(runs.F, "xxhash64", lambda *c: F.pmod(hashed(*c), F.lit(3)))
            folder = str(tmp_path / name)
            runs.build(units, folder, asked)
            run = runs.build(units, folder, asked)
            found[name] = [tuple(run.counters.first()), sorted(map(str, run.calls.collect())), sorted(map(str, run.items.collect()))]
            rows = dealt[-1]._jdf.queryExecution().optimizedPlan().toString()
            assert ("LeftSemi" in rows) == (name in ("hashes", "same hash"))
    assert found["broadcast"] == found["hashes"] == found["same hash"] == found["dealt"]
    assert found["hashes"][0][1:4] == (101, 80, 0) and len(found["hashes"][1]) == 11
