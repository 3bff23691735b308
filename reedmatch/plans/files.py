"""Queries that read files: the given tables are written as files of several kinds, or packed into file contents, and
come back as documents. Also records, responses and refusals made of the tables' rows."""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions import jsons
from ..operators import profile
from ..sources import ingest
from ..sources.staging import shared_folder, spread
from .queries import load

#: Executors may lack this package: its functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of one written file: files stay far below what the reader takes.
ROWS, TEXTS = 20_000, 200


def folder(s) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def ingested_tables(s, d):
    """Customers in files cut at semicolons and parts in files cut at tabs, read as labelled rows: a row for each block."""
    path = folder(s)
    money = lambda c: F.col(c).cast("decimal(12,2)").cast("string").alias(c)
    made = {
        ";": load(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", money("c_acctbal"), "c_mktsegment"),
        "\t": load(s, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(', the "'), F.col("p_type"), F.lit('"; new')).alias("p_name"), "p_brand", "p_size", money("p_retailprice")),
    }
    for k, (mark, rows) in enumerate(made.items()):
        rows.write.options(header=True, sep=mark, escape='"', maxRecordsPerFile=ROWS).csv(f"{path}/{k}")
    docs = ingest.read_files(s, path)
    blocks = docs.select("kind", "error", F.explode(F.slice(F.split("text", r"(?:^|\n\n)## Row \d+\n"), 2, 1 << 30)).alias("block"))
    return blocks.select("kind", "error", F.split_part("block", F.lit("\n"), F.lit(1)).alias("first"), F.md5("block").alias("block_md5"))


def ingested_texts(s, d):
    """Texts of the documents in text files: how often each line comes back."""
    path = folder(s)
    load(s, d, "documents").where("text is not null").select("text").write.option("maxRecordsPerFile", TEXTS).text(path)
    lines = ingest.read_files(s, path).select("kind", "error", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("kind", "error", F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


def turn_files(s, d, kind: str, content) -> DataFrame:
    """Documents of one file for each turn, whose contents lie in a table."""
    rows = load(s, d, "conversations")
    name = F.concat_ws("-", F.lit("turn"), "conv_id", "turn")
    docs = ingest.documents_of(rows.select(F.concat(F.lit("/mail/"), name, F.lit(kind)).alias("path"), content.alias("content")))
    part = lambda k: F.regexp_extract("title", r"^turn-(\d+)-(\d+)\.", k).cast("long")
    return docs.select(part(1).alias("conv_id"), part(2).alias("turn"), "kind", "error", F.md5("text").alias("text_md5"))


def ingested_markdown(s, d):
    """Turns as Markdown, every other one in UTF-16."""
    return turn_files(s, d, ".md", F.when((F.col("turn") % 2 == 1) & (F.col("text") != ""), F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")))


def word_file(role: str | None, text: str | None, cells: list[str]) -> bytes:
    """A .docx with a heading, a paragraph and a table of one row."""
    run = lambda t: f"<w:r><w:t>{escape(t or '')}</w:t></w:r>"
    head = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run(role)}</w:p>'
    table = "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in cells)
    body = f"<w:tbl><w:tr>{table}</w:tr></w:tbl>{head}<w:p>{run(text)}</w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ingest.WORDS[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def ingested_word(s, d):
    """Turns as .docx files: the role a heading, the text a paragraph, then a table with both numbers."""
    pack = F.pandas_udf(lambda r, t, c, n: pd.Series([word_file(*x[:2], x[2:]) for x in zip(r, t, c, n)]), "binary")
    return turn_files(s, d, ".docx", pack("role", "text", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


def corpus_records(s, d):
    """A corpus in JSON files, each one array of records."""
    path = folder(s)
    docs = load(s, d, "documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "source", "lang")
    lists = docs.groupBy(F.floor(F.col("id") / TEXTS).alias("k")).agg(F.collect_list(F.struct("id", "title", "source", "lang")).alias("x"))
    lists.select(F.to_json("x").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/corpus.json")
    return ingest.read_corpus(s, path).select(F.col("id").cast("long").alias("doc_id"), F.md5("title").alias("title_md5"), "source", "lang")


def carried_documents(s, d):
    """Documents as records of a caller, some without an id, a title or a kind."""
    docs = load(s, d, "documents")
    title = F.when(F.col("doc_id") % 4 > 0, F.split_part("text", F.lit("\n"), F.lit(1)))
    records = docs.select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).alias("id"), title.alias("title"), "text", F.col("lang").alias("kind"), F.lit(None).cast("string").alias("error"))
    return ingest.carried(records).select("id", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"), "kind", "error")


def profile_texts(s, d):
    """A profile for each document, as the text that a judge reads."""
    skill = F.struct(F.col("source").alias("name"), F.lit("used").alias("strength"))
    role = F.struct(F.col("source").alias("role"), F.col("lang").alias("org"), F.col("text").alias("what"))
    extract = F.to_json(F.struct(F.array("text").alias("achievements"), F.array(role).alias("experience"), F.col("source").alias("interests"), F.array(F.col("lang"), F.lit("")).alias("domains"), F.array(skill).alias("skills")))
    made = spread(load(s, d, "documents")).select("doc_id", extract.alias("extract"))
    texts = made.select("doc_id", profile.shaped(F.col("extract")).alias("shape")).select("doc_id", profile.rendered(F.col("shape")).alias("text"))
    return texts.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


def reply_texts(s, d):
    """Turns as responses of two kinds: those of the user as candidates with parts, the others as choices."""
    parts = F.struct(F.array(F.struct("text"), F.struct(F.lit(" ").alias("text"))).alias("parts"))
    candidates = F.to_json(F.struct(F.array(F.struct(parts.alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates")))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    reply = jsons.reply_text(F.when(F.col("role") == "user", candidates).otherwise(choices))
    return load(s, d, "conversations").select("conv_id", "turn", reply["error"].alias("error"), F.md5(reply["text"]).alias("text_md5"))


def refused_calls(s, d):
    """Events as refusals of three forms, some with a header: what they say and how long to wait."""
    k = (F.col("event_id") % 50).cast("string")
    said = F.to_json(F.struct(F.struct(F.concat("event_type", F.lit("; please retry in "), k, F.lit(" s")).alias("message")).alias("error")))
    detail = F.array(F.struct(F.concat(k, F.lit(".5s")).alias("retryDelay")))
    named = F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("raw")).alias("metadata"), detail.alias("details")).alias("error")))
    form = F.col("event_id") % 3
    body = F.when(form == 0, said).when(form == 1, named).otherwise(F.col("event_type"))
    header = F.when(F.col("event_id") % 7 == 0, F.col("value").cast("string"))
    status = 400 + F.col("event_id") % 5
    return load(s, d, "events").select("event_id", jsons.refusal("Judge", status, body).alias("message"), F.round(jsons.retry_delay(header, body), 2).alias("seconds"))


def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def block(**columns: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"'{k}: ' || nullif({trimmed(f'{v}::varchar')}, '')" for k, v in columns.items()) + ")"


PROFILE_TEXT = r"""concat_ws(chr(10), 'SKILLS: ' || coalesce(source, 'None') || ' (used)', 'DOMAINS: ' || nullif(lang, ''), 'RESEARCH INTERESTS: ' || nullif(source, ''),
  'EXPERIENCE: ' || coalesce(source, 'None') || ' at ' || coalesce(lang, 'None') || ' — ' || coalesce(text, 'None'), case when regexp_matches(text, '\S') then 'ACHIEVEMENTS: ' || text end)"""
CUSTOMER = block(c_custkey="c_custkey", c_name="c_name", c_nationkey="c_nationkey", c_acctbal="c_acctbal::decimal(12,2)", c_mktsegment="c_mktsegment")
PART = block(p_partkey="p_partkey", p_name="""(p_name || ', the "' || p_type || '"; new')""", p_brand="p_brand", p_size="p_size", p_retailprice="p_retailprice::decimal(12,2)")
OF_TURN = "select conv_id, turn, {} as kind, case when {} then 'the file is empty' else '' end as error, md5({}) as text_md5 from conversations"
FULL = r"regexp_matches(coalesce(text, ''), '\S')"

ORACLES = {
    "ingested_tables": f"with b as (select {CUSTOMER} as block from customer union all select {PART} from part) select 'csv' as kind, '' as error, split_part(block, chr(10), 1) as first, md5(block) as block_md5 from b",
    "ingested_texts": "with l as (select unnest(string_split(text, chr(10))) as line from documents) select 'text' as kind, '' as error, md5(line) as line_md5, count(*)::bigint as n from l where line <> '' group by line",
    "ingested_markdown": OF_TURN.format("'md'", f"not {FULL}", f"case when {FULL} then text else '' end"),
    "ingested_word": OF_TURN.format("'docx'", "false", f"concat_ws(chr(10) || chr(10), '## ' || nullif({trimmed('role')}, ''), nullif({trimmed('text')}, ''), concat_ws(' | ', conv_id::varchar, turn::varchar))"),
    "corpus_records": "select doc_id, md5(split_part(text, chr(10), 1)) as title_md5, source, lang from documents",
    "carried_documents": f"""select case when doc_id % 3 > 0 then doc_id::varchar else substr(sha1(text), 1, 12) end as id, md5(coalesce(nullif(case when doc_id % 4 > 0 then split_part(text, chr(10), 1) end, ''), 'untitled')) as title_md5,
  md5(text) as text_md5, coalesce(nullif(lang, ''), 'text') as kind, '' as error from documents where {FULL}""",
    "profile_texts": f"with t as (select doc_id, {PROFILE_TEXT} as t from documents), c as (select doc_id, case when length(t) > 6000 then substr(t, 1, 6000) || ' …[truncated]' else t end as t from t) select doc_id, md5(t) as text_md5, length(t)::bigint as chars from c",
    "reply_texts": """with t as (select *, nullif(trim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10)), '') as t from conversations)
select conv_id, turn, case when t is null then case when role = 'user' then 'empty response (STOP)' when text is null then 'no candidates' else 'empty response' end end as error, md5(t) as text_md5 from t""",
    "refused_calls": """select event_id, 'Judge refused (HTTP ' || (400 + event_id % 5) || ')' || case event_id % 3 when 0 then coalesce(': ' || event_type || '; please retry in ' || (event_id % 50) || ' s', '') when 1 then coalesce(': ' || event_type, '') else '' end as message,
  round(coalesce(case when event_id % 7 = 0 then value end, case event_id % 3 when 0 then (event_id % 50)::double when 1 then event_id % 50 + 0.5 else 0.0 end), 2)::double as seconds from events""",
}

QUERIES = {f.__name__: f for f in (ingested_tables, ingested_texts, ingested_markdown, ingested_word, corpus_records, carried_documents, profile_texts, reply_texts, refused_calls)}
