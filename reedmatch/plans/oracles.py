"""DuckDB SQL for the registered queries."""

from __future__ import annotations

# Fixed values, written out again, so that a wrong list in the code under test shows.
TOKEN = r"[a-z][a-z0-9+#.\-]{1,}"
STOPWORDS = (
    "aim aims all also and any approach are area areas based between both but can canada canadian data develop "
    "developing development during each faculty field for from goal goals has have high how including intern "
    "internship into its large may method methods model models more most new not novel one other our over project "
    "projects provide research results some student students studies study such supervisor support system systems "
    "team than that the their them then these they this those two under university use used using was well what "
    "when where which who why will with within work working"
).split()
ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}
ERROR_CLASSES = {
    "rate_limit": r"429|rate.?limit|quota|too many requests",
    "auth": r"401|403|api key|unauthor|forbidden",
    "credits": r"402|credit|billing|payment",
    "bad_model": r"404|model not found|no such model",
    "bad_output": r"json|parse|unparseable|empty response",
    "network": r"timeout|timed out|network|connect",
}
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tok(c: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{TOKEN}'), lambda x: length(x) > 2 and not list_contains({STOP}, x)), lambda x: trim(x, '.-'))"


ITEMS = "items as (select doc_id as idx, split_part(text, chr(10), 1) as title, text from documents where {})"
CHANGED = """items as (select doc_id as idx, case when lang = 'de' then source || ' ' || split_part(text, chr(10), 1) else split_part(text, chr(10), 1) end as title,
  case when lang = 'de' then 'the of and que ' || text else text end as text from documents where source <> 'src5' or source is null)"""


def index(where: str = "true", items: str = ITEMS, bags: str | None = None) -> str:
    return f"""
{items.format(where)},
toks as (select idx, {tok("text")} as ts, list_distinct({tok("title")}) as tt from items),
post as (select idx, term, count(*)::bigint as tf, bool_or(list_contains(tt, term)) as in_title from (select idx, tt, unnest(ts) as term from toks) group by 1, 2),
dl as (select idx, greatest(len(ts), 1)::bigint as dl from toks),
st as (select greatest(count(*), 1)::bigint as n, coalesce(avg(dl), 1.0) as avg_len from dl),
idf as (select term, count(*)::bigint as df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as w from post, st group by term, n),
{bags or BAGS},
sc as (select profile, idx, round(sum(qw * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len)) * case when in_title then 1.6 else 1.0 end), 9) as score
  from post join bags using (term) join idf using (term) join dl using (idx), st group by 1, 2)"""


BAGS = f"bags as (select item_id as profile, term, count(*)::double as qw from (select item_id, unnest({tok('text')}) as term from benchmark) group by 1, 2)"


def top(where: str = "true", items: str = ITEMS) -> str:
    return f"{index(where, items)}, best as (select idx, score from sc where profile = 0 order by score desc, idx limit 60)"


CANDS = """,
cands as (select idx, score, (row_number() over (order by score desc, idx) - 1)::bigint as pos from best),
j as (select idx, pos, (pos // 6)::bigint as batch_no, case when pos // 6 = 7 then 'failed' when l.doc_id is null then 'omitted' else 'judged' end as state,
  case when pos // 6 <> 7 and l.doc_id is not null then (quality * 60 + (1 - toxic) * 25 + idx % 10)::int else 0 end as match_score, quality, toxic
  from cands left join labels l on l.doc_id = idx),
m as (select row_number() over (order by match_score desc, pos) as rank_no, idx, match_score, batch_no, quality, toxic from j where state = 'judged' order by match_score desc, pos limit 20)"""

SHOWN = """,
shown as (select rank_no, '## ' || rank_no || '. [' || match_score || '] ' || title || chr(10) || chr(10) || 'ID `' || idx || '` · ' || source || ' · starts 2024' || chr(10)
  || chr(10) || 'by label of ' || idx || chr(10) || coalesce(chr(10) || 'Search for: `' || nullif(title, '') || '`' || chr(10), '') || chr(10) || '**Evidence**' || chr(10) || '- quality ' || quality || chr(10)
  || case when toxic = 1 then chr(10) || '**Gaps**' || chr(10) || '- toxic' || chr(10) else '' end as markdown
  from m join (select doc_id as idx, split_part(text, chr(10), 1) as title, source from documents) using (idx))"""

# The profile run: what its extractor makes of a text (words are cut at white space).
RUN = r"""
u as (select source as profile, doc_id as idx, text, length(text) as n, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents where source is not null and text is not null),
e as (select *, case when n % 13 = 0 then 'failed' when n % 5 = 0 or len(w) < 2 then 'empty' else 'hit' end as one,
  case when n % 13 = 0 and n % 2 = 1 then 'failed' when (n + case when n % 13 = 0 then 1 else 0 end) % 5 = 0 or len(w) < 2 then 'empty' else 'hit' end as two from u),
r as (select *, case when one = 'hit' then 'cached' else two end as how from e)"""
RUN_BAGS = rf"""{RUN},
x as (select profile, idx, w[1] as name, 2.0 as weight, 'skills' as key from r where how in ('cached', 'hit') union all select profile, idx, w[2], 3.0, 'interests' from r where how in ('cached', 'hit')),
f as (select profile, key, name, weight from x where trim(name) <> '' qualify row_number() over (partition by profile, key, lower(trim(name)) order by idx) = 1),
bags as (select profile, term, sum(weight)::double as qw from (select profile, weight, unnest({tok('name')}) as term from f) group by 1, 2)"""

#: Folds of conversations, a layer after the other; a conversation of one piece waits.
_FOLD = """l{k} as (select c, pos, piece, failed, count(*) over (partition by c) as n from (
  select c, pos // 6 as pos, case when bool_or(n = 1) then any_value(piece) when bool_or(starts_with(piece, '0')) then string_agg(piece, '|' order by pos) else '(' || string_agg(piece, '+' order by pos) || ')' end as piece,
    sum(failed) + case when bool_or(n = 1) then 0 when bool_or(starts_with(piece, '0')) then 1 else 0 end as failed from l{j} group by c, pos // 6))"""
REDUCED = ", ".join(
    ["l0 as (select conv_id as c, row_number() over (partition by conv_id order by turn) - 1 as pos, substr(sha1(text), 1, 6) as piece, 0 as failed, count(*) over (partition by conv_id) as n from conversations where text is not null)"]
    + [_FOLD.format(k=k + 1, j=k) for k in range(6)]
)

#: Sections of pages, as html_sections has them, packed one after the other.
PACKED = r"""
s as (select page_id, url, list_transform(list_filter(list_transform(parts, lambda x, i: {'crumb': case when i > 1 then regexp_replace(regexp_extract(x, '(?m)^(#{1,6})\s+(.+)$', 2), '^\s+|\s+$', '', 'g') else '' end, 'body': case when len(parts) = 1 then x else regexp_replace(x, '^\s+|\s+$', '', 'g') end}), lambda y: len(parts) = 1 or y.body <> ''),
  lambda y: {'done': []::struct(crumb varchar, text varchar)[], 'crumb': '', 'buf': '', 'c': y.crumb, 'b': y.body}) as xs from p),
k as (select page_id, url, list_reduce(list_concat([{'done': []::struct(crumb varchar, text varchar)[], 'crumb': '', 'buf': '', 'c': '', 'b': ''}], xs), lambda a, x:
  case when length(x.b) > 1500 then {'done': list_concat(a.done, case when trim(a.buf, chr(10) || chr(9) || ' ') <> '' then [{'crumb': a.crumb, 'text': trim(a.buf, chr(10) || chr(9) || ' ')}] else [] end,
      list_transform(generate_series(0, ceil((length(x.b) - 1500) / 1300.0)::int), lambda i: {'crumb': x.c, 'text': substr(x.b, 1 + 1300 * i, 1500)})), 'crumb': a.crumb, 'buf': '', 'c': '', 'b': ''}
    when a.buf = '' or length(a.buf) + length(x.b) > 1500 then {'done': list_concat(a.done, case when trim(a.buf, chr(10) || chr(9) || ' ') <> '' then [{'crumb': a.crumb, 'text': trim(a.buf, chr(10) || chr(9) || ' ')}] else [] end), 'crumb': x.c, 'buf': x.b, 'c': '', 'b': ''}
    else {'done': a.done, 'crumb': a.crumb, 'buf': a.buf || chr(10) || chr(10) || x.b, 'c': '', 'b': ''} end) as a from s),
d as (select page_id, url, list_concat(a.done, case when trim(a.buf, chr(10) || chr(9) || ' ') <> '' then [{'crumb': a.crumb, 'text': trim(a.buf, chr(10) || chr(9) || ' ')}] else [] end) as done from k),
o as (select page_id, url, done, unnest(generate_series(1, len(done))) as i from d)
select 'doc:' || page_id || '#' || (i - 1) as id, page_id as source_id, case when len(done) = 1 then url else url || ' — part ' || i || '/' || len(done) end as source_anchor, coalesce(nullif(done[i].crumb, ''), url) as breadcrumb, done[i].text as text from o"""

CALLS = """,
c as (select idx, score, (row_number() over (order by score desc, idx) - 1)::bigint as pos from best),
b as (select *, (pos // 6)::bigint as batch_no, first_value(idx) over (partition by pos // 6 order by pos) % 3 = 0 as failed from c),
j as (select idx, pos, batch_no, case when failed then 'failed' when idx % 5 = 0 then 'omitted' else 'judged' end as state from b)"""

HTML = "regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')"
for _n in range(1, 7):
    HTML = f"regexp_replace({HTML}, '(?i)<h{_n}[^>]*>', chr(10) || chr(10) || '{'#' * _n} ', 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, '(?i)<br[^>]*>|</(p|div|li|tr)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _e, _c in ENTITIES.items():
    HTML = "replace({}, '{}', '{}')".format(HTML, _e, _c.replace("'", "''"))
HTML = rf"regexp_replace(regexp_replace(regexp_replace({HTML}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

ORACLES = {
    "tokenize_tf": f"with {index()} select idx, term, tf, in_title from post",
    "doc_lengths": f"with {index()} select idx, dl from dl",
    "corpus_stats": f"with {index()} select n, round(avg_len, 6) as avg_len from st",
    "term_idf": f"with {index()} select term, df, round(w, 6) as idf from idf",
    "bm25_topk": f"with {top()} select idx, round(score, 6) as score from best",
    "bm25_from_index": f"with {top()} select idx, round(score, 6) as score from best",
    "index_texts": "select doc_id, md5(coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(text, '')) as text_md5 from documents",
    "redacted_texts": "select doc_id, md5(case when regexp_matches(text, 'sk-[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{10,}') then '[redacted]' else text end) as text_md5 from documents",
    "bm25_filtered": f"""with {top("source in ('src0', 'src1', 'src2', 'src3') and lower(coalesce(lang, '')) = 'en'")} select idx, round(score, 6) as score from best""",
    "bm25_title_boost": f"with {index()} select idx, count(*)::bigint as n_title_terms, sum(qw) as title_weight from post join bags using (term) where in_title and profile = 0 group by idx",
    "bm25_multi_profile": f"with {index()}, r as (select profile, idx, score, row_number() over (partition by profile order by score desc, idx) as rank_no from sc) select profile, idx, rank_no, round(score, 6) as score from r where rank_no <= 5",
    "bm25_width_zero": "select doc_id as idx, 0.0::double as score from documents",
    "bm25_empty_bag": "select doc_id as idx, 0.0::double as score from documents order by doc_id limit 60",
    "query_bag_weighted": f"select profile, term, sum(w)::double as qw from (select item_id as profile, ([3.0, 2.0, 1.0, 1.5])[item_id % 4 + 1] as w, unnest({tok('text')}) as term from benchmark) group by 1, 2",
    "html_to_text": f"select page_id, {HTML} as text from pages",
    "html_sections": rf"""
with t as (select page_id, {HTML} as text from pages),
p as (select page_id, string_split(regexp_replace(text, '(?m)^(#{{1,6}})\s+(.+)$', chr(1) || '\0', 'g'), chr(1)) as parts from t),
x as (select page_id, case when len(parts) = 1 then [{{'crumb': '', 'body': parts[1]}}] else list_filter(list_transform(parts, lambda x, i: {{'crumb': case when i > 1 then regexp_replace(regexp_extract(x, '(?m)^(#{{1,6}})\s+(.+)$', 2), '^\s+|\s+$', '', 'g') else '' end, 'body': regexp_replace(x, '^\s+|\s+$', '', 'g')}}), lambda y: y.body <> '') end as s from p),
e as (select page_id, s, unnest(generate_series(0, len(s) - 1)) as k from x)
select page_id, k::bigint as k, s[k + 1].crumb as crumb, md5(s[k + 1].body) as body_md5 from e""",
    "passages_hard_split": "with e as (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 12000) / 11200.0)::int))) as k from documents), p as (select doc_id, k, substr(text, k * 11200 + 1, 12000) as part from e) select doc_id, k::bigint as k, length(part)::bigint as n, substr(sha1(part), 1, 16) as unit_key from p",
    "content_keys": "select doc_id, substr(sha1(text), 1, 16) as unit_key from documents",
    "cache_antijoin": "with k as (select doc_id, substr(sha1(text), 1, 16) as unit_key from documents) select doc_id, unit_key from k where unit_key not in (select unit_key from k where doc_id % 3 = 0)",
    "usable_documents": r"select doc_id, length(text)::bigint as chars from documents where regexp_matches(text, '\S')",
    "merge_first_wins": "with r as (select conv_id, turn, split_part(text, ' ', 1) as name from conversations) select conv_id, turn, name from r where trim(name) <> '' qualify row_number() over (partition by conv_id, lower(trim(name)) order by turn) = 1",
    "merged_profiles": """
with k as (select source as profile, doc_id, ' ' || upper(lang) || '-' || doc_id % 7 as name, lang from documents),
e as (select profile, 'skills' as key, name as item, doc_id as idx, doc_id as from_idx from k union all select profile, 'domains', lang, doc_id, null from k where lang <> '' union all select profile, 'interests', profile, doc_id, null from k where profile <> ''),
f as (select profile, key, item, idx, from_idx from e where trim(item) <> '' qualify row_number() over (partition by profile, key, lower(trim(item)) order by idx) = 1)
select profile, key, (row_number() over (partition by profile, key order by idx) - 1)::bigint as pos, item, from_idx from f""",
    "reduce_layers": "with c as (select conv_id, count(*)::bigint as n from conversations group by 1) select conv_id, n, len(list_filter(generate_series(0, 40), lambda k: n > 1 and pow(6.0, k) < n))::bigint as layers from c",
    "bm25_after_changes": f"with {top(items=CHANGED)} select idx, round(score, 6) as score from best",
    "bm25_compacted": f"with {top(items=CHANGED)} select idx, round(score, 6) as score from best",
    "bm25_by_bounds": f"with {top()} select idx, round(score, 6) as score from best order by best.score desc, idx limit 20",
    "bm25_no_filter": f"with {top()} select idx, round(score, 6) as score from best",
    "profile_run": f"""with {RUN}, c as (select profile, count(*)::bigint as n_units, count_if(how = 'cached')::bigint as n_cached, count_if(how = 'failed')::bigint as n_failed, count_if(how in ('cached', 'hit'))::bigint as n_hits, max(case when how = 'failed' then '429 quota exceeded' end) as first_error from r group by 1)
select *, case when n_units = 0 then 'there is nothing to read' when n_failed > 0 and n_hits = 0 then 'no profile yet, ' || n_failed || ' of ' || n_units || ' passages failed: ' || first_error
  when n_failed > 0 then n_failed || ' of ' || n_units || ' passages (' || round_even(100.0 * n_failed / n_units, 0)::bigint || '%) failed, so the profile may lack something: ' || first_error when n_hits = 0 then 'nothing usable was found in the documents' end as warning from c""",
    "profile_run_calls": f"with {RUN} select case when two = 'failed' then 'rate_limit' else 'none' end as kind, 1::int as tries, count(distinct text)::bigint as n from r where one <> 'hit' group by 1",
    "profile_bags": f"with {RUN_BAGS} select profile, term, qw from bags",
    "profile_ranking": f"with {RUN_BAGS}, {index(bags='unused as (select 1)')}, k as (select profile, idx, score, row_number() over (partition by profile order by score desc, idx) as rank_no from sc) select profile, idx, rank_no, round(score, 6) as score from k where rank_no <= 5",
    "reduced_conversations": f"with {REDUCED}, s as (select c, n from l0 group by all) select c as conv_id, piece, s.n::bigint as n_pieces, len(list_filter(generate_series(0, 40), lambda k: s.n > 1 and pow(6.0, k) < s.n))::bigint as layers, failed::bigint as n_failed from l6 join s using (c)",
    "judge_all_batches": "select doc_id as idx, (row_number() over (order by doc_id) - 1)::bigint as pos, ((row_number() over (order by doc_id) - 1) // 6)::bigint as batch_no from documents",
    "profile_counters": f"with {RUN}, c as (select count(*)::bigint as n_units, count_if(how = 'cached')::bigint as n_cached, count_if(how = 'failed')::bigint as n_failed, count_if(how in ('cached', 'hit'))::bigint as n_hits from r) select *, round_even(100.0 * n_failed / greatest(n_units, 1), 0)::bigint as failed_percent from c",
    "passages_packed": rf"with t as (select page_id, url, {HTML} as text from pages), p as (select page_id, url, string_split(regexp_replace(text, '(?m)^(#{{1,6}})\s+(.+)$', chr(1) || '\0', 'g'), chr(1)) as parts from t), {PACKED}",
    "failure_pct": "with c as (select source, count(*)::bigint as n, count_if(quality = 0)::bigint as n_failed from documents join labels using (doc_id) group by 1) select *, round_even(100.0 * n_failed / greatest(n, 1), 0)::bigint as failed_percent from c",
    "judge_batches": f"with {top()} {CANDS} select idx, pos, batch_no, least(length(text), 2200)::bigint as shown_chars from j join items using (idx)",
    "verdict_join": f"with {top()} {CANDS} select idx, batch_no, state, match_score from j",
    "run_counters": f"with {top()} {CANDS} select count(*)::bigint as n_screened, count_if(state = 'judged')::bigint as n_judged, count(distinct batch_no)::bigint as judge_calls, count(distinct case when state = 'failed' then batch_no end)::bigint as n_failed, count_if(state = 'omitted')::bigint as n_dropped, max(case when state = 'failed' then 'call failed' end) as first_error from j",
    "call_verdicts": f"with {top()} {CALLS} select idx, batch_no, state, case when state = 'judged' then idx * 7 % 101 else 0 end::int as match_score, case when state = 'judged' then 'item ' || idx else '' end as evidence, case when state = 'failed' then 'no answer' else '' end as error from j",
    "call_counters": f"""with {top()} {CALLS}, n as (select count(*)::bigint as n_screened, count_if(state = 'judged')::bigint as n_judged, count(distinct batch_no)::bigint as judge_calls,
  count(distinct case when state = 'failed' then batch_no end)::bigint as n_failed, count_if(state = 'omitted')::bigint as n_dropped, max(case when state = 'failed' then 'no answer' end) as first_error from j)
select *, case when n_failed > 0 then n_failed || ' of ' || judge_calls || ' calls (' || round_even(100.0 * n_failed / judge_calls, 0)::bigint || '%) failed: ' || first_error
  when n_screened = 0 then 'there is nothing to judge' when n_judged = 0 then 'no item could be judged' end as warning from n""",
    "score_clamp": "select event_id, case when event_id % 5 = 0 then 0 when event_id % 7 = 0 then 100 else trunc(greatest(0.0, least(100.0, round(value - 50, 2))))::int end::int as score from events",
    "json_fields": "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "match_pipeline": f"with {top()} {CANDS} select rank_no, idx, match_score, batch_no from m",
    "export_markdown": f"with {top()} {CANDS} {SHOWN} select rank_no, markdown from shown",
    "match_views": f"with {top()} {CANDS} select rank_no, match_score as score, 'by label of ' || idx as rationale, idx::varchar as id, title, (select count(*) from documents)::bigint as pool_size, (select count(*) from j where state = 'judged')::bigint as judged, (select count(distinct batch_no) from j where state = 'failed')::bigint as failed from m join items using (idx)",
    "export_report": f"""with {top()} {CANDS} {SHOWN}, n as (select count(*) as n_screened, count(distinct batch_no) as calls, count(distinct case when state = 'failed' then batch_no end) as n_failed from j),
t as (select string_agg(chr(10) || markdown, '' order by rank_no) as body, count(*) as n from shown)
select '# Matches' || chr(10) || chr(10) || '*' || n || ' items, ranked. Read ' || n_screened || ' of ' || (select count(*) from documents) || ' · by label.*' || chr(10)
  || case when n_failed > 0 then chr(10) || '> ' || n_failed || ' of ' || calls || ' calls (' || round_even(100.0 * n_failed / calls, 0)::bigint || '%) failed: call failed' || chr(10) else '' end
  || chr(10) || '> Search the title.' || chr(10) || body as markdown from t, n where n > 0""",
    "facets": "select distinct source from documents where source <> ''",
    "source_counts": "select source, count(*)::bigint as n, sum(length(text))::bigint as total_chars from documents group by 1",
    "error_classes": "select source, case "
    + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '{p}') then '{k}'" for k, p in ERROR_CLASSES.items())
    + " else 'other' end as class, count(*)::bigint as n from documents group by 1, 2",
}
