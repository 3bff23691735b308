import gzip
import html
import json
import math
import re
import zipfile
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reedmatch.functions import jsons, text as tx
from reedmatch.operators import bm25, judge, profile
from reedmatch.plans import oracles, queries
from reedmatch.sources import ingest


def model_tokens(t):
    return [x.strip(".-") for x in re.findall(r"[a-z][a-z0-9+#.\-]+", t.lower()) if len(x) > 2 and x not in tx.STOPWORDS]


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column(F.col("x"))).collect()]


def test_tokens_keep_their_quirks(spark):
    texts = ["The. the of. C++ node.js -- a-b-", "Étude café 3d x86", "", None]
    assert one(spark, tx.tokens, *texts) == [model_tokens(t or "") for t in texts]
    assert "the" in model_tokens("the.") and "of" in model_tokens("of.")


def items(spark, rows):
    return spark.createDataFrame(rows, "idx long, title string, text string")


CORPUS = [(0, "Rust compilers", "Rust compilers parse grammar grammar"), (1, "Bird song", "bird song recordings and grammar"), (2, "", ""), (3, None, "parse bird")]


def test_scores_follow_the_formula(spark):
    bag = {"grammar": 2.0, "rust": 1.0, "absent": 5.0}
    bags = spark.createDataFrame(list(bag.items()), "term string, qw double")
    got = {r["idx"]: r["score"] for r in bm25.top(items(spark, CORPUS), bags, 10).collect()}
    docs = {i: Counter(model_tokens(t or "")) for i, _, t in CORPUS}
    n, avg = len(docs), sum(max(1, sum(c.values())) for c in docs.values()) / len(docs)
    want = {}
    for i, title, _ in CORPUS:
        s = 0.0
        for term, qw in bag.items():
            tf, df = docs[i][term], sum(c[term] > 0 for c in docs.values())
            if tf:
                dl = max(1, sum(docs[i].values()))
                s += qw * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)) * (1.6 if term in model_tokens(title or "") else 1)
        if s:
            want[i] = s
    assert got == pytest.approx(want) and list(got) == [0, 1]


def test_width_and_empty_bag(spark):
    none = spark.createDataFrame([], "term string, qw double")
    assert bm25.top(items(spark, CORPUS), none, 0).count() == 4
    assert [tuple(r) for r in bm25.top(items(spark, CORPUS), none, 2).collect()] == [(0, 0.0), (1, 0.0)]


def squeezed(text):
    return re.sub(r"\s+", "", text)


def check_packed(text, sections, parts, ceiling, overlap):
    """What passages of a text must satisfy, whatever way they were made."""
    assert squeezed("".join(body for _, body in sections)) == squeezed(text)  # sections rebuild the text
    at = 0  # sections that the parts so far have used up
    for k, (crumb, part) in enumerate(parts):
        while not sections[at][1].strip():
            at += 1
        first = at
        assert crumb == sections[first][0] and part
        if len(sections[first][1]) > ceiling:  # slices of one section: each goes on `overlap` before the last one's end
            body = sections[first][1]
            mine = [p for _, p in parts[k:]][: 1 + max(0, -(-(len(body) - ceiling) // (ceiling - overlap)))]
            joined = mine[0] + "".join(p[overlap:] for p in mine[1:])
            assert joined == body and all(len(p) <= ceiling for p in mine)
            assert all(a[len(a) - overlap :] == b[:overlap] for a, b in zip(mine, mine[1:]))
            parts[k + 1 : k + len(mine)] = []
            at += 1
            continue
        taken, size = [], 0
        while at < len(sections) and squeezed("".join(taken)) != squeezed(part):
            taken.append(sections[at][1])
            size += len(sections[at][1]) + (2 if size else 0)
            at += 1
        assert squeezed("".join(taken)) == squeezed(part)  # whole sections, none left out
        assert len(part) <= ceiling + 2 * len(taken)
        if at < len(sections) and len(sections[at][1]) <= ceiling and sections[at][1]:
            assert size + len(sections[at][1]) > ceiling  # the next one didn't fit
    assert all(not body.strip() for _, body in sections[at:])


def pairs(rows):
    return [tuple(r) for r in rows]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["# One", "## Two x", "alpha beta", "", "word " * 9, "#no", "y" * 70]), max_size=9), min_size=20, max_size=20))
def test_passages_hold(spark, docs):
    texts = ["\n".join(d) for d in docs]
    found, got = one(spark, tx.sections, *texts), one(spark, lambda c: tx.packed(tx.sections(c), 60, 10), *texts)
    for text, sections, parts in zip(texts, found, got):
        check_packed(text, pairs(sections), pairs(parts), 60, 10)


def test_passages_by_hand(spark):
    text = "intro\n# A\n" + "a" * 20 + "\n# B\nb\n# C\n" + "c" * 75 + "\n# D\nd"
    got = one(spark, lambda c: tx.packed(tx.sections(c), 40, 10), text)[0]
    assert pairs(got) == [("", "intro\n\n# A\n" + "a" * 20 + "\n\n# B\nb"), ("C", "# C\n" + "c" * 36), ("C", "c" * 40), ("C", "c" * 19), ("D", "# D\nd")]


def test_packing_is_linear(spark):
    import time

    def took(n):
        rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.cast("string").alias("crumb"), F.repeat(F.lit("x"), k % 50).alias("body"))).alias("s"))
        rows = rows.select(F.size(tx.packed(F.col("s"), 500, 50)).alias("n"))
        rows.collect()
        began = time.time()
        rows.collect()
        return time.time() - began

    took(1000)
    assert took(100_000) < 4 * took(50_000) + 1


def test_slices_refuse_a_ceiling_below_the_overlap():
    with pytest.raises(ValueError):
        tx.slices(F.lit("x"), 800, 800)


def test_html(spark):
    page = "<html><style>p{}</style><h2 class=a>A &amp; B</h2><p>one<br>two</p><script>x<1</script><ul><li>three</li></ul></html>"
    assert one(spark, tx.html_to_text, page) == ["## A & B one\ntwo\n three"]


#: Pages, and what is left of them before references are replaced.
ENTITY_PAGES = {
    "<h1>Caf&eacute; &mdash; na&#239;ve</h1><p>it&#8217;s &#x27;so&#X27; &hellip;</p>": "# Caf&eacute; &mdash; na&#239;ve it&#8217;s &#x27;so&#X27; &hellip;",
    "<p>&amp;eacute; &amp;amp;lt; &amp;#8217;</p>": "&amp;eacute; &amp;amp;lt; &amp;#8217;",  # one pass
    "<p>AT&T &copy2024 &notit; &nosuch; &#0; &#xD800; &#99999999; R&D &nbsp;x&NBSP;</p>": "AT&T &copy2024 &notit; &nosuch; &#0; &#xD800; &#99999999; R&D &nbsp;x&NBSP;",
    "<p>&quot;&lt;b&gt;&amp;&copy;&middot;&#39;&quot;</p>": "&quot;&lt;b&gt;&amp;&copy;&middot;&#39;&quot;",
    "<p>a&nbsp;b &Auml;&NotEqualTilde;</p><a href='?x=1&y=2'>&am<b>p;</b></a>": "a&nbsp;b &Auml;&NotEqualTilde;\n &am p;",
    "<h2>&Uuml;ber</h2><p>one &euro;5</p>\n<h2>Zwei &ndash;</h2><p>two &#10;&#10; x</p>": "## &Uuml;ber one &euro;5\n\n## Zwei &ndash; two &#10;&#10; x",
}


def test_every_entity(spark):
    want = [html.unescape(t) for t in ENTITY_PAGES.values()]
    assert one(spark, tx.html_to_text, *ENTITY_PAGES, None, "") == [*want, "", ""]
    got = one(spark, lambda c: tx.packed(tx.sections(tx.html_to_text(c)), 20, 5), *ENTITY_PAGES)
    for text, sections, parts in zip(want, one(spark, tx.sections, *want), got):
        check_packed(text, pairs(sections), pairs(parts), 20, 5)


def test_registered_passages(spark):
    rows = [("p1", "<h1>One</h1><p>" + "alpha " * 300 + "</p><h2>Two</h2><p>beta</p>"), ("p2", "<p>plain &amp; short</p>"), ("p3", "<script>x</script>"), ("p4", "<h1>A</h1><p>" + "word " * 120 + "</p><h1>B</h1>" + "x " * 500)]
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = {r["id"]: tuple(r)[1:] for r in queries.passages_packed(spark, folder).collect()}
    texts = one(spark, tx.html_to_text, *(h for _, h in rows))
    sections = one(spark, tx.sections, *texts)
    for k, (url, _) in enumerate(rows):
        mine = [got[f"doc:{k}#{i}"] for i in range(sum(key.startswith(f"doc:{k}#") for key in got))]
        assert [m[1] for m in mine] == ([url] if len(mine) == 1 else [f"{url} — part {i + 1}/{len(mine)}" for i in range(len(mine))])
        assert {m[0] for m in mine} <= {k}
        check_packed(texts[k], pairs(sections[k]), [("" if c == url else c, t) for _, _, c, t in mine], 1500, 200)
    assert len(got) > 5


@pytest.mark.parametrize("name", ["html_sections", "html_to_text", "passages_packed"])
def test_page_queries_equal_their_sql(spark, tmp_path, name):
    import duckdb

    pages = ["<title>A cut &amp</title><h2>One &amp; two</h2><p>x &lt;b&gt; &amp;lt;</p>", "<h1>Caf&eacute; &mdash; &#8217;&#39;</h1><p>&copy2024 &quot;q&quot;</p>", "<p>plain &ampere</p>", "", None]
    rows = [(k, f"u{k}", h) for k, h in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lenient_json(spark):
    values = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": "}"} done', "[1, 2] tail", "nothing", None]
    got = one(spark, jsons.lenient, *values)
    assert [json.loads(g) if g else None for g in got] == [{"a": 1}, {"a": 1}, {"a": "}"}, [1, 2], None, None]


def test_lenient_json_leaves_whole_replies_to_spark(spark):
    values = ['{"a": {"b": [1]}} {"c": 2}', 'x [1 {"a": 1}', '{"a": "\\"}"} tail', "{broken [3]", "", '```\n[1]\n```']
    got = one(spark, jsons.lenient, *values)
    assert [json.loads(g) if g else None for g in got] == [{"a": {"b": [1]}}, {"a": 1}, {"a": '"}'}, [3], None, [1]]


def test_reply_text(spark):
    bodies = ['{"choices": [{"message": {"content": " hi \\n"}}]}', '{"candidates": [{"content": {"parts": [{"text": "a"}, {"x": 1}, {"text": "b"}]}}]}', '{"promptFeedback": {"blockReason": "SAFETY"}}', "{}", '{"candidates": [{"finishReason": "MAX_TOKENS"}]}', '{"candidates": [{"finishReason": "OTHER"}]}']
    got = [tuple(r) for r in one(spark, jsons.reply_text, *bodies)]
    assert got == [("hi", None), ("ab", None), (None, "blocked: SAFETY"), (None, "no candidates"), (None, "the whole budget went into tokens before the text"), (None, "empty response (OTHER)")]


def test_clamp(spark):
    assert one(spark, jsons.clamped, "87.9", "-3", "1e12", "inf", "nan", "x", None, "true") == [87, 0, 100, 100, 0, 0, 0, 1]


def test_retry_and_refusal(spark):
    rows = spark.createDataFrame([("2.5", "{}"), (None, '{"details": [{"retryDelay": "45s"}]}'), (None, "please retry in 7.5 s"), (None, "")], "h string, b string")
    assert [r[0] for r in rows.select(jsons.retry_delay(F.col("h"), F.col("b"))).collect()] == [2.5, 45.0, 7.5, 0.0]
    body = spark.createDataFrame([(429, '{"error": {"message": "slow down"}}'), (500, "<html>")], "s int, b string")
    assert [r[0] for r in body.select(jsons.refusal("P", F.col("s"), F.col("b"))).collect()] == ["P refused (HTTP 429): slow down", "P refused (HTTP 500)"]


def test_verdicts_are_joined_and_counted(spark):
    cands = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (1, "c", 2), (2, "d", 3)], "batch_no long, id string, pos long")
    replies = spark.createDataFrame(
        [(0, 'Here: {"verdicts": [{"projectId": "a", "score": 10}, {"projectId": "a", "score": "140", "evidence": ["x", ""], "gaps": "one"}, {"projectId": "ghost", "score": 99}]}', None), (1, None, "boom"), (2, "[]", None)],
        "batch_no long, reply string, error string",
    )
    rows = judge.joined(cands, replies)
    got = {r["id"]: (r["state"], r["match_score"], r["evidence"], r["gaps"]) for r in rows.collect()}
    assert got["a"] == ("judged", 100, ["x"], ["one"])
    assert [got[k][0] for k in "bcd"] == ["omitted", "failed", "omitted"]
    assert [(r["id"], r["rank_no"]) for r in judge.ranked(rows).collect()] == [("a", 1)]


def test_calls_are_made_by_batch_and_counted(spark):
    cands = spark.createDataFrame([(i // 6, str(i), i) for i in range(20)], "batch_no long, id string, pos long")
    item = judge.item_json(F.concat(F.lit("t"), F.col("id")), F.lit("d"), F.lit(None).cast("string"), F.lit(""), F.col("id"), F.lit("area"))
    asked = judge.requests(cands.withColumn("item", item), "PROFILE TEXT")
    first = asked.where("batch_no = 0").first()["request"]
    assert "PROFILE TEXT" in first and [m for m in re.findall(r'"id":"(\d+)"', first)] == list("012345") and '"description":"d area"' in first and "skills" not in first

    def call(text):
        ids = re.findall(r'"id":"(\d+)"', text)
        if "7" in ids:
            raise RuntimeError("busy")
        return json.dumps({"verdicts": [{"projectId": i, "score": 50} for i in ids[:-1]] + [{"projectId": "ghost", "score": 1}]})

    rows = judge.joined(cands, judge.called(asked, call, 2))
    counts = judge.warned(judge.counters(rows)).first()
    assert tuple(counts) == (20, 11, 4, 1, 3, "busy", "1 of 4 calls (25%) failed: busy")
    nothing = judge.warned(judge.counters(rows.where("false"))).first()
    assert nothing["warning"] == "there is nothing to judge"
    assert judge.export(rows.where("false").select(F.lit(1).alias("rank_no"), F.lit("").alias("markdown")), judge.counters(rows), 20, "x").count() == 0


def test_extracts_are_shaped_and_merged(spark):
    values = ['{"skills": [{"name": "Rust"}, "go", null, "", {}], "domains": "one", "interests": 0, "other": [1]}', "[1]", "nonsense", "{}"]
    got = one(spark, profile.shaped, *values)
    assert [json.loads(x) if x[:1] == "{" else x for x in got[0]["skills"]] == [{"name": "Rust"}, "go"] and got[0]["domains"] == ["one"] and got[0]["interests"] == []
    assert one(spark, lambda c: profile.has_content(profile.shaped(c)), *values) == [True, False, False, False]
    rows = [("p", 1, '{"skills": ["RUST ", {"name": "go", "strength": "used"}], "experience": [{"role": "dev"}]}'), ("p", 0, '{"skills": [{"name": "rust"}, " "], "domains": ["x"]}'), ("q", 5, '{"skills": ["rust"]}')]
    out = profile.merged(spark.createDataFrame(rows, "profile string, idx long, extract string"))
    assert sorted((r["profile"], r["key"], r["pos"], r["item"]) for r in out.collect()) == [("p", "domains", 0, "x"), ("p", "experience", 0, '{"role":"dev"}'), ("p", "skills", 0, '{"name":"rust"}'), ("p", "skills", 1, '{"name":"go","strength":"used"}'), ("q", "skills", 0, "rust")]


def test_rendered_profile(spark):
    text = '{"skills": [{"name": "rust", "strength": "used"}, "go"], "projects": [{"name": "x", "what": "y"}], "experience": [{"role": "dev", "org": "o"}], "interests": [" ", "i"], "constraints": "c"}'
    got = one(spark, lambda c: profile.rendered(profile.shaped(c)), text, "{}")
    assert got == ["SKILLS: rust (used); go\nRESEARCH INTERESTS: i\nPROJECTS: x — y\nEXPERIENCE: dev at o — None\nCONSTRAINTS: c", ""]
    assert one(spark, lambda c: profile.rendered(profile.shaped(c), 10), text) == ["SKILLS: ru …[truncated]"]


def test_written_index_ranks_alike(spark, tmp_path):
    bags = spark.createDataFrame([("grammar", 2.0), ("rust", 1.0), ("absent", 5.0)], "term string, qw double")
    bm25.write_index(items(spark, CORPUS), str(tmp_path / "index"))
    index = bm25.read_index(spark, str(tmp_path / "index"))
    assert bm25.top(items(spark, CORPUS), bags, 10, index).collect() == bm25.top(items(spark, CORPUS), bags, 10).collect() != []
    assert tuple(bm25.statistics(index).first()) == tuple(bm25.corpus(items(spark, CORPUS)).first())


def test_one_read_of_the_corpus(spark, tmp_path):
    items(spark, CORPUS).write.parquet(str(tmp_path / "items"))
    rows = spark.read.parquet(str(tmp_path / "items"))
    bags = spark.createDataFrame([("grammar", 1.0)], "term string, qw double")
    plan = bm25.top(rows, bags, 3)._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "FileScan" in line and str(tmp_path / "items") in line)


def test_redaction(spark):
    assert one(spark, tx.redacted, "key sk-abcdefgh1", "AIza0123456789", "sk-short", None) == ["[redacted]", "[redacted]", "sk-short", None]


def test_blank_pieces_go_before_a_reduction(spark):
    rows = spark.createDataFrame([(0, "a"), (1, " "), (2, None), (3, "b")], "idx long, piece string")
    out, layers = profile.tree_reduced(rows, "+".join, "|".join)
    assert layers == 1 and out.first()["piece"] == "a+b"
    none, layers = profile.tree_reduced(rows.where("idx in (1, 2)"), "+".join, "|".join)
    assert layers == 0 and none.count() == 0


def test_tree_reduction_keeps_failed_branches(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(14)], "idx long, piece string")

    def combine(xs):
        if "7" in xs:
            raise RuntimeError
        return "+".join(xs)

    out, layers = profile.tree_reduced(rows, combine, lambda xs: "|".join(xs))
    assert layers == 2 and sorted(re.split(r"[+|]", out.first()["piece"]), key=int) == [str(i) for i in range(14)]


def test_cache_and_extraction(spark):
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "bad")], "id long, text string")
    cache = spark.createDataFrame([("a",)], "t string").select(tx.content_key("t").alias("unit_key"), F.lit("{}").alias("extract"))
    todo, good = profile.split_by_cache(units, cache)
    assert todo.count() == 3 and good.count() == 1

    def call(t):
        if t == "bad":
            raise RuntimeError("no")
        return "{}"

    assert sorted(r["error"] or "" for r in profile.extracted(todo, call).collect()) == ["", "no"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,city\nAda,Paris\n,\nBob,\n")
    (tmp_path / "b.md").write_text("# T\nbody")
    (tmp_path / "c.bin").write_bytes(bytes(range(128)))
    (tmp_path / "e.pdf").write_bytes(b"%PDF-bad")
    got = {r["title"]: r for r in ingest.read_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"]["text"] == "# a.csv\n\n## Row 1\nname: Ada\ncity: Paris\n\n## Row 2\nname: Bob"
    assert got["b.md"]["kind"] == "md" and not got["b.md"]["error"]
    assert all(got[k]["error"] for k in ("c.bin", "e.pdf"))
    assert ingest.parsed("d.txt", b"")[2] and ingest.parsed("x.txt", b" " * (ingest.MOST_BYTES + 1))[2]
    assert ingest.usable(ingest.read_files(spark, str(tmp_path))).count() == 2


def test_delimited_text(spark):
    texts = ['a;b\n1;"x;""y"""\n\n;;\n ; z ', "name,city\n", "", "h\tk\n1\t2\t3\n,\t5", ",x\n1,2"]
    docs = spark.createDataFrame([(str(k), "t", x, "csv", "") for k, x in enumerate(texts)], ingest.SCHEMA)
    got = {r["id"]: (r["text"], bool(r["error"])) for r in ingest.labelled_rows(docs, F.lit(True)).collect()}
    assert got == {
        "0": ('# t\n\n## Row 1\na: 1\nb: x;"y"\n\n## Row 2\nb: z', False),
        "1": ("# t", False),
        "2": ("", True),
        "3": ("# t\n\n## Row 1\nh: 1\nk: 2\n\n## Row 2\nh: ,\nk: 5", False),
        "4": ("# t\n\n## Row 1\n: 1\nx: 2", False),
    }


def test_word_files_and_corpora(spark, tmp_path):
    w = ingest.WORDS
    para = lambda t, style="": f'<p xmlns="{w[1:-1]}"><pPr><pStyle xmlns:w="{w[1:-1]}" w:val="{style}"/></pPr><r><t>{t}</t></r></p>'
    cell = lambda t: f'<tc xmlns="{w[1:-1]}"><p><r><t>{t}</t></r></p></tc>'
    body = f'<document xmlns="{w[1:-1]}"><body>{para("Top", "Heading2")}{para(" ")}{para("Lone", "Heading")}{para("text")}<tbl><tr>{cell("a")}{cell(" ")}{cell("b")}</tr><tr>{cell("")}</tr></tbl></body></document>'
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "in" / "b.html").write_text("<h1>T</h1><p>x &eacute;</p>")
    (tmp_path / "in" / "c.html").write_text("<script>1</script>")
    got = {r["title"]: r for r in ingest.read_files(spark, str(tmp_path / "in")).collect()}
    assert got["a.docx"]["text"] == "## Top\n\n# Lone\n\ntext\n\na | b" and got["b.html"]["text"] == "# T x é" and got["c.html"]["error"]
    assert ingest.read_corpus(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "corpus.json").write_text('[{"id": "1"}, {"id": "2"}]')
    with gzip.open(tmp_path / "corpus.json.gz", "wt") as f:
        f.write('[{"id": "3"}]')
    assert ingest.read_corpus(spark, str(tmp_path)).count() == 2
    (tmp_path / "corpus.json").unlink()
    assert ingest.read_corpus(spark, str(tmp_path)).count() == 1
    assert ingest.pasted(spark, "note").first()["title"] == "Pasted note"
    sent = spark.createDataFrame([(None, None, "x", None, None), ("1", "t", " ", "md", "")], ingest.SCHEMA)
    assert [(r["title"], r["kind"], r["error"]) for r in ingest.carried(sent).collect()] == [("untitled", "text", "")]


def test_bag_weights(spark):
    items = [("skills", '{"name":"rust","strength":"used"}'), ("skills", '{"name":"c++","strength":"odd"}'), ("skills", "golang"), ("projects", '{"name":"engine","what":"parsing"}'), ("projects", "zig"), ("interests", "birds"), ("domains", "physics"), ("domains", '{"a":"odd1"}'), ("experience", '{"role":"tester","org":"nowhere"}'), ("achievements", "prize"), ("constraints", "remote")]
    rows = spark.createDataFrame([("p", k, i) for k, i in items], "profile string, key string, item string")
    got = Counter((r["text"], r["weight"]) for r in profile.parts(rows).collect() if r["text"])
    assert got == Counter([("rust", 2.0), ("c++", 1.5), ("golang", 1.5), ("engine", 2.0), ("parsing", 1.0), ("zig", 1.0), ("birds", 3.0), ("physics", 2.5), ('{"a":"odd1"}', 2.5), ("tester", 1.0)])
    bag = {r["term"]: r["qw"] for r in profile.bags_of(rows.union(rows)).collect()}
    assert bag["rust"] == 4.0 and "prize" not in bag and "nowhere" not in bag
    assert profile.warning(8, 1, 5, "e") == "12% of passages failed (1 of 8): e"


def test_plans(spark):
    rows = items(spark, CORPUS)
    bags = spark.createDataFrame([("grammar", 1.0)], "term string, qw double")
    plan = bm25.top(rows, bags, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_new_passages_stream(spark, tmp_path):
    from reedmatch.streaming import new_passages

    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, explode(array('a','a','b')) as text").write.parquet(src)
    got = []
    new_passages(spark, src, lambda df, _: got.extend(r["text"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == ["a", "b"]
