"""The catalogue's queries as SQL for DuckDB, with RE2 patterns where Java's read differently."""

from __future__ import annotations

from paraweft.config import TYPE_SETTINGS, VOTES
from paraweft.functions import lexicon as L
from paraweft.functions.vectors import gauss

# Small Chinese texts, as no test table has any.
ZH_TEXTS = [
    "这是第一句话。这是第二句话！这是第三句话？",
    "人工智能正在改变世界。然而，很多人仍然担心它的影响。2024年，研究人员发布了新的模型；结果令人惊讶！",
    "他转身走向门口。突然，她低声说：\"你真的要走吗？\"他沉默了很久，然后点了点头。窗外下着雨。",
    "This is English. 但是这里有中文。Mixed text，混合文本。",
    "",
    "   ",
    "首先，我们安装 Python 环境。其次，配置数据库和服务器。最后，运行 `test.run()` 并检查结果。",
    "「早上好」，师父说道。弟子们齐声回答：\"师父早！\"昨天的任务还没有完成，今天必须继续。短句。",
]

WS = r"[\s\x1C-\x1F\x{85}\p{Z}]"
NOT_WS = r"[^\s\x1C-\x1F\x{85}\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace({clean(x)}, '{WS}*([。！？；：，、]){WS}*', '\1', 'g'), '([。！？])({NOT_WS})', '\1 \2', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sents(x: str, e: str = ".!?;:") -> str:
    return f"list_filter(list_transform(regexp_extract_all({clean(x)}, '[^{e}]*[{e}]|[^{e}]+$'), lambda s: trim(s)), lambda s: length(s) > 3)"


def ratio(x: str) -> str:
    visible, chinese = f"len(regexp_extract_all({x}, '{NOT_WS}'))", rf"len(regexp_extract_all({x}, '[\x{{4E00}}-\x{{9FFF}}]'))"
    return f"(case when {visible} > 0 then {chinese} / {visible} else 0.0::double end)"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def re2(pattern: str) -> str:
    """Unicode classes by name."""
    return pattern.replace(r"\w", r"[\p{L}\p{M}\p{N}\p{Pc}]").replace(r"\s", WS)


SPLIT = f"sentences as (select doc_id, {sents(norm('text'))} as s from documents)"
ROWS = "rows as (select doc_id, (i - 1)::integer as pos, s[i] as sentence from sentences, unnest(range(1, len(s) + 1)) as u(i))"
ORACLE_SQL: dict[str, str] = {}
O = ORACLE_SQL  # noqa: E741

O["validate_documents"] = f"""
select doc_id, is_valid, case when not is_valid then case when not regexp_matches(text, '{NOT_WS}') then 'blank' else 'too long' end end as error
from (select *, regexp_matches(text, '{NOT_WS}') and length(text) <= 10000 as is_valid from documents)"""

O["request_validation"] = f"""
select doc_id, case when t = '' then 'text is missing or blank' when length(t) > 10000 then 'text is too long'
  when not (doc_id % 7 / 5 between 0 and 1) then 'threshold is not within 0 and 1' when doc_id % 3 = 1 then 'unknown text type' end as error
from (select doc_id, {strip('text')} as t from documents)"""

_WIDE = rf"regexp_replace(regexp_replace(translate(b, ',.!?:;', '，。！？：；'), '([\x{{4E00}}-\x{{9FFF}}]){WS}+([a-zA-Z])', '\1 \2', 'g'), '([a-zA-Z]){WS}+([\x{{4E00}}-\x{{9FFF}}])', '\1 \2', 'g')"
O["clean_normalize"] = f"""
select doc_id, {clean('text')} as cleaned, case when {ratio('b')} > 0.5 then {_WIDE} else b end as normalized
from (select doc_id, text, {norm('text')} as b from documents)"""

O["sentence_split"] = f"with {SPLIT}, {ROWS} select doc_id, pos, sentence from rows"

_MEAN = "coalesce(list_sum(l) / nullif(len(l), 0), 0.0)"
O["sentence_stats"] = f"""
with {SPLIT}, lens as (select doc_id, len(s)::integer as n_sentences, list_transform(s, lambda x: length(x)::double) as l from sentences),
means as (select *, {_MEAN} as m from lens)
select doc_id, n_sentences, round(m, 6) as avg_length, round(coalesce(sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / nullif(len(l), 0)), 0.0), 6) as std_length from means"""

O["sentence_split_report"] = f"""
with {SPLIT}, {ROWS} select lang, count(*) as n_sentences, round(avg(length(sentence)), 6) as avg_length, count(distinct source) as n_sources
from rows join documents using (doc_id) group by lang"""


def present(words) -> str:
    return f"len(list_filter({listed(w.lower() for w in dict.fromkeys(words))}, lambda k: contains(lower(text), k)))::integer"


_CODE = " + ".join(count("text", re2(p)) for p in L.CODE)
_DIALOGUE = " + ".join(count("text", p) for p in L.DIALOGUE) + f" + floor(3 * {count('text', chr(34))} / 2)::integer"
_NARRATION = " + ".join(count("text", p) for p in L.NARRATION) + f" + floor({count('text', L.PRONOUN)} / 10)::integer"
O["keyword_counts"] = f"select doc_id, {present(L.TECHNICAL)} as technical_keywords, {present(L.NOVEL)} as novel_keywords, {present(L.ACADEMIC)} as academic_keywords, {present(L.NEWS)} as news_keywords from documents"
O["code_patterns"] = f"select doc_id, ({_CODE})::integer as n from documents"
O["dialogue_patterns"] = f"select doc_id, ({_DIALOGUE})::integer as n, ({_NARRATION})::integer as narration from documents"

_PARTS = f"list_filter(list_transform(regexp_split_to_array(text, '[。！？；]'), lambda x: {strip('x')}), lambda x: x <> '')"
_STRUCTURE = f"""parts as (select *, {_PARTS} as p from documents),
structured as (select * exclude (p), coalesce(list_sum(list_transform(p, lambda x: length(x))) / nullif(len(p), 0), 0.0) as avg_length,
  coalesce({count('text', '[，,]')} / nullif(len(p), 0), 0.0) as complexity, coalesce({count('text', '[？?]')} / nullif(len(p), 0), 0.0) as question_ratio from parts)"""
O["sentence_structure"] = f"with {_STRUCTURE} select doc_id, round(avg_length, 6) as avg_length, round(complexity, 6) as complexity, round(question_ratio, 6) as question_ratio from structured"

TYPED = f"""{_STRUCTURE},
evidence as (select *, {present(L.TECHNICAL)} as tk, {present(L.NOVEL)} as vk, {present(L.ACADEMIC)} as ak, {present(L.NEWS)} as nk, {_CODE} as code, {_DIALOGUE} as dia, {_NARRATION} as nar, length(text) as len from structured),
scores as (select *, (tk * 2 + code * 3) / len * 1000 as s1, (vk * 1.5::double + dia * 1.5::double + nar * 2) / len * 1000 as s2, (ak * 2 + complexity * 5) / len * 1000 as s3, nk / len * 1000 as s4, dia / len * 1000 as s5 from evidence),
tops as (select *, greatest(s1, s2, s3, s4, s5) as top, s1 + s2 + s3 + s4 + s5 as total, list_reverse_sort([s1, s2, s3, s4, s5]) as ranked from scores),
judged as (select *, case when total > 0 then top / total else 0.0 end as conf,
  case when s1 = top then 'technical' when s2 = top then 'novel' when s3 = top then 'academic' when s4 = top then 'news' else 'dialogue' end as best from tops),
mixes as (select *, coalesce((top > 0 and ranked[2] / nullif(top, 0) > 0.6), false) or len(list_filter(ranked, lambda x: x > top * 0.4)) >= 3 or (best = 'academic' and top > 50 and ak <= 1 and (vk > 0 or tk > 0)) as mixed from judged),
fits as (select *, coalesce(length({strip('text')}) >= 50, false) as fit from mixes),
typed as (select doc_id, text, lang, case when not fit or top < 1.0 then 'unknown' when mixed or conf < 0.25 then 'mixed' else best end as text_type,
  case when fit then conf else 0.0 end as confidence, case when fit then top end as max_score, case when fit then mixed end as is_mixed from fits)"""
O["detect_text_type"] = f"with {TYPED} select doc_id, text_type, round(confidence, 6) as confidence, round(max_score, 6) as max_score, is_mixed from typed"
O["type_distribution_by_lang"] = f"with {TYPED} select lang, text_type, count(*) as n, round(avg(confidence), 6) as confidence from typed group by all"
_SETTINGS = ", ".join(f"('{k}', {v[0]}::double, {v[1]}, {v[2]}, {v[3]}, {str(v[4]).lower()})" for k, v in TYPE_SETTINGS.items())
SETTINGS = f"settings as (select * from (values {_SETTINGS}) as v(text_type, threshold, window_size, min_paragraph_length, max_paragraph_length, use_structure_hints))"
O["segmentation_config_join"] = f"with {TYPED}, {SETTINGS} select doc_id, text_type, threshold, window_size, min_paragraph_length, max_paragraph_length, use_structure_hints from typed join settings using (text_type)"


def phrases(x: str, k: int) -> str:
    return rf"array_to_string(list_slice(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: regexp_full_match(w, '\p{{L}}{{3,}}')), 1, {k}), '|')"


O["key_phrases"] = f"select doc_id, {phrases(norm('text'), 5)} as phrases from documents"

# vectors: each label of the embeddings is a document
VECTORS = "vectors as (select label, row_number() over (partition by label order by vec_id) - 1 as pos, list_transform(embedding, lambda x: x::double) as v from embeddings)"


def cosine(a: str, b: str) -> str:
    size = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"round(case when {size} > 0 then list_dot_product({a}, {b}) / {size} else 0.0 end, 9)"


def mean(ls: str) -> str:
    return f"list_transform(range(1, 65), lambda i: list_sum(list_transform({ls}, lambda w: w[i])) / len({ls}))"


_W = "over (partition by label order by pos rows between {} and {})"
SIMS = f"""{VECTORS},
windows as (select label, pos, v, lead(v) over (partition by label order by pos) as nv,
  list(v) {_W.format('1 preceding', 'current row')} as l3, list(v) {_W.format('current row', '1 following')} as r3,
  list(v) {_W.format('2 preceding', 'current row')} as l5, list(v) {_W.format('current row', '2 following')} as r5 from vectors),
means as (select label, pos, v, nv, {mean('l3')} as m3, {mean('r3')} as n3, {mean('l5')} as m5, {mean('r5')} as n5 from windows where nv is not null),
sims as (select label, pos::integer as pos, {cosine('v', 'nv')} as scale_1, {cosine('m3', 'n3')} as scale_3, {cosine('m5', 'n5')} as scale_5 from means)"""
O["adjacent_similarity_embeddings"] = f"with {SIMS} select label, pos, round(scale_1, 6) as sim from sims"
O["multi_scale_similarity"] = f"with {SIMS} select label, pos, round(scale_1, 6) as scale_1, round(scale_3, 6) as scale_3, round(scale_5, 6) as scale_5 from sims"


def smoothed(k: int) -> str:
    n = f"len(s{k})"
    at = lambda d: f"((i + {d}) % (2 * {n}) + 2 * {n}) % (2 * {n})"
    term = lambda w, d: f"{w!r}::double * s{k}[1 + (case when {at(d)} >= {n} then 2 * {n} - 1 - {at(d)} else {at(d)} end)]"
    total = " + ".join(term(w, d) for d, w in zip(range(-4, 5), gauss(), strict=True))
    return f"case when {n} >= 3 then list_transform(range(0, {n}), lambda i: round({total}, 9)) else s{k} end as t{k}"


SMOOTH = f"""{SIMS}, series as (select label, list(scale_1 order by pos) as s1, list(scale_3 order by pos) as s3, list(scale_5 order by pos) as s5 from sims group by label),
smoothed as (select label, {smoothed(1)}, {smoothed(3)}, {smoothed(5)} from series),
points as (select label, i::integer as pos, t1, t3, t5 from smoothed, unnest(range(0, len(t1))) as u(i))"""
O["smoothed_similarity"] = f"with {SMOOTH} select label, pos, round(t1[pos + 1], 6) as sim from points"


def candidate(t: str, threshold: str) -> str:
    here, before, after = f"{t}[pos + 1]", f"{t}[pos]", f"{t}[pos + 2]"
    inner = f"pos > 0 and pos < len({t}) - 1 and {here} < {before} and {here} < {after}"
    drop = f"pos > 0 and {before} > 0 and round(({before} - {here}) / {before}, 9) > 0.15"
    return f"(coalesce({inner}, false) or coalesce({drop}, false) or ({threshold} > 0 and {here} < {threshold}))"


O["boundary_candidates"] = f"with {SMOOTH} select label, pos as boundary from points where {candidate('t1', '0.05::double')}"
_NOVEL = VOTES["novel"]
_TERMS = " + ".join(f"case when {candidate(t, f'{th}::double')} then {w}::double * (1 - {t}[pos + 1]) else 0.0 end" for t, (w, th) in zip(("t1", "t3", "t5"), _NOVEL[:3], strict=True))
_ANY = " or ".join(candidate(t, f"{th}::double") for t, (_, th) in zip(("t1", "t3", "t5"), _NOVEL[:3], strict=True))
O["boundary_vote"] = f"with {SMOOTH} select label, pos as boundary from points where ({_ANY}) and round(0.0::double + {_TERMS}, 9) >= {_NOVEL[3]}::double"
O["boundary_min_distance"] = f"""
with recursive {SMOOTH}, found as (select label, list(pos order by pos) as c from points where {candidate('t1', '0.05::double')} group by label),
walk as (select label, c, 1 as k, c[1] as last, true as kept from found
  union all select label, c, k + 1, case when c[k + 1] - last >= 4 then c[k + 1] else last end, c[k + 1] - last >= 4 from walk where k < len(c))
select label, last as boundary from walk where kept"""
O["sliding_window_boundaries"] = f"""
with {VECTORS}, windows as (select label, pos, list(v) {_W.format('3 preceding', '1 preceding')} as l, list(v) {_W.format('current row', '2 following')} as r, count(*) over (partition by label) as n from vectors),
means as (select label, pos, {mean('l')} as ml, {mean('r')} as mr from windows where pos >= 3 and pos < n - 3)
select label, pos::integer as boundary from means where {cosine('ml', 'mr')} < 0.3"""

_TITLE = f"length(sentence) < 50 and (starts_with(sentence, '#') or ends_with(sentence, '：') or ends_with(sentence, ':') or {count('sentence', NOT_WS + '+')} <= 5)"
_ITEM = r"regexp_matches(trim(sentence), '^(?:[•\-*]|1\.|2\.|3\.|一、|二、|三、|（一）|（二）)')"
O["structure_boundaries"] = f"with {SPLIT}, {ROWS} select doc_id, pos as boundary from rows where pos > 0 and (({_TITLE}) or {_ITEM})"

# paragraphs that begin at every second sentence; sums[i] are the characters before sentence i
_CUTS = f"""{SPLIT}, summed as (select doc_id, len(s) as n, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)) as sums from sentences),
cuts as (select *, range(2, n, 2) as b from summed where n > 2)"""


def span(a: str, b: str) -> str:
    return f"(sums[{b} + 1] - sums[{a} + 1] + greatest({b} - {a} - 1, 0))"


O["length_repair"] = f"""
with recursive {_CUTS},
walk as (select doc_id, sums, b, 0 as k, 0::bigint as start, []::bigint[] as made from cuts
  union all select doc_id, sums, b, k + 1, case when {span('start', 'b[k + 1]')} < 100 then start else b[k + 1] end,
    case when {span('start', 'b[k + 1]')} < 100 then [] when {span('start', 'b[k + 1]')} > 300 and b[k + 1] - start > 2 then [start + (b[k + 1] - start) // 2, b[k + 1]] else [b[k + 1]] end
  from walk where k < len(b))
select doc_id, unnest(made)::integer as boundary from walk"""
O["transformer_length_repair"] = f"""
with {_CUTS}, each as (select doc_id, sums, b[k] as e, case when k > 1 then b[k - 1] else 0 end as a from cuts, unnest(range(1, len(b) + 1)) as u(k)),
made as (select doc_id, case when {span('a', 'e')} < 100 then [] when {span('a', 'e')} > 300 and e - a > 2 then [a + (e - a) // 2, e] else [e] end as m from each)
select doc_id, unnest(m)::integer as boundary from made"""

_METHOD = "case when length(text) < 500 or length(text) > 5000 then 'enhanced' when text_type in ('novel', 'dialogue') then 'transformer' when text_type = 'mixed' then 'hybrid' else 'enhanced' end"
O["method_selection"] = f"with {TYPED} select doc_id, text_type, case when doc_id % 10 = 0 then 'transformer' else {_METHOD} end as method from typed"
O["method_recommendation"] = f"""
with {TYPED}, chosen as (select *, {_METHOD} as recommended_method from typed)
select doc_id, recommended_method, concat_ws('; ', case when length(text) < 500 then 'short text: the enhanced method is faster' when length(text) > 5000 then 'long text: the enhanced method is steadier' end,
  case when text_type = 'mixed' then 'mixed type: both methods are worth running' when text_type in ('novel', 'dialogue') then 'literary or spoken text: the transformer understands more' else 'technical or academic text: the enhanced method is more precise' end) as reasons,
  array_to_string(list_filter(['enhanced', 'transformer', 'hybrid'], lambda m: m <> recommended_method), ',') as alternatives from chosen"""
O["method_ranking"] = """
with scores as (select doc_id, m.method, round(n_chars * m.k % 101 / 100, 2) as score from documents, (values ('enhanced', 3), ('transformer', 7), ('hybrid', 11), ('multi_task', 13)) as m(method, k)),
tops as (select *, max(score) over (partition by doc_id) as top from scores)
select doc_id, method, score, rank() over (partition by doc_id order by score desc)::integer as rank, min(case when score = top then method end) over (partition by doc_id) as best_method, round(top - score, 9) as behind_best from tops"""

# Markdown of the documents, line by line
NOTED = r"""noted as (select doc_id, concat('# ', source, chr(10), chr(10), text, chr(10), chr(10), '- ', lang, chr(10), '- n', n_chars::varchar, chr(10), chr(10),
  case when doc_id % 2 = 0 then concat('end', chr(10), chr(10)) else '' end, '```text', chr(10), 'doc ', doc_id::varchar, chr(10), '```', chr(10), chr(10),
  '> quoted ', lang, chr(10), chr(10), '| id | lang |', chr(10), '|----|------|', chr(10), '| ', doc_id::varchar, ' | ', lang, ' |', chr(10), chr(10), '---') as markdown from documents)"""
BLOCKS = rf"""{NOTED},
lines as (select doc_id, i - 1 as line, l[i] as raw, {strip('l[i]')} as s from (select doc_id, string_split(markdown, chr(10)) as l from noted), unnest(range(1, len(l) + 1)) as u(i)),
fenced as (select *, sum(case when starts_with(s, '```') then 1 else 0 end) over (partition by doc_id order by line) as fences, max(line) over (partition by doc_id) as last_line from lines),
kinds as (select *, case when starts_with(s, '```') then 'fence' when fences % 2 = 1 then 'code' when s = '' then 'blank' when regexp_matches(s, '^#{{1,6}}{WS}+.') then 'heading'
  when regexp_matches(s, '^>{WS}*.') then 'quote' when regexp_matches(s, '^([-*+]|[0-9]+\.){WS}+.') then 'list' when regexp_matches(s, '^[-*_]{{3,}}$') then 'horizontal_rule'
  when regexp_matches(s, '^\|.+\|$') then 'table' else 'paragraph' end as kind from fenced),
code as (select doc_id, min(line) as line_start, max(line) as line_end, 'code_block' as type, coalesce(string_agg(case when kind = 'code' then raw end, chr(10) order by line), '') as content,
  null::integer as level, max(case when kind = 'fence' and fences % 2 = 1 then {strip("substr(s, 4)")} end) as language, null::bigint as closer, null::bigint as last_solid
  from kinds where kind in ('fence', 'code') group by doc_id, ceil(fences / 2)),
solid as (select *, lag(kind) over w as bk, lag(line) over w as bl from kinds where kind not in ('blank', 'fence', 'code') window w as (partition by doc_id, fences order by line)),
runs as (select *, sum(case when bk is null or bk <> kind or kind in ('heading', 'horizontal_rule') or (kind = 'paragraph' and line - bl > 1) then 1 else 0 end) over (partition by doc_id, fences order by line) as run from solid),
grouped as (select doc_id, fences, run, any_value(kind) as type, min(line) as line_start, max(line) as last_solid, any_value(last_line) as last_line,
  case when any_value(kind) in ('list', 'table') then array_to_string(list(case when kind = 'heading' then {strip("regexp_replace(s, '^#{1,6}', '')")} when kind = 'quote' then {strip("substr(s, 2)")} when kind = 'list' then regexp_replace(s, '^([-*+]|[0-9]+\.){WS}+', '\1 ') else s end order by line), chr(10)) else array_to_string(list(case when kind = 'heading' then {strip("regexp_replace(s, '^#{1,6}', '')")} when kind = 'quote' then {strip("substr(s, 2)")} when kind = 'list' then regexp_replace(s, '^([-*+]|[0-9]+\.){WS}+', '\1 ') else s end order by line), ' ') end as content, max(case when kind = 'heading' then length(regexp_extract(s, '^#{{1,6}}')) end)::integer as level
  from runs group by doc_id, fences, run),
closed as (select g.*, (select min(k.line) from kinds k where k.doc_id = g.doc_id and k.line > g.last_solid and k.kind not in ('code', 'blank')) as closer from grouped g),
plain as (select doc_id, line_start, case when type in ('heading', 'horizontal_rule') then line_start when type = 'paragraph' then last_solid else coalesce(closer - 1, last_line) end as line_end,
  type, content, level, null::varchar as language, closer, last_solid from closed),
kept as (select * from plain where __KEEP__ union all select * from code),
blocks as (select doc_id, (row_number() over (partition by doc_id order by line_start) - 1)::integer as block, type, content, level, language, line_start::integer as line_start, line_end::integer as line_end from kept)"""
_ALL = BLOCKS.replace("__KEEP__", "true")
_REFERENCE = BLOCKS.replace("__KEEP__", "not ((type in ('list', 'quote', 'table') or (type = 'paragraph' and closer = last_solid + 1)) and exists (select 1 from kinds k where k.doc_id = plain.doc_id and k.line = plain.closer and k.kind = 'fence' and k.fences % 2 = 1))")
O["markdown_parse"] = f"with {_ALL} select doc_id, block, type, content, level, language, line_start, line_end from blocks"
O["markdown_parse_compat"] = f"with {_REFERENCE} select doc_id, block, type, line_start, line_end from blocks"
_N = ", ".join(f"count(*) filter (type = '{k}') as n_{k}" for k in ("heading", "paragraph", "code_block", "list", "quote", "table", "horizontal_rule"))
_LEVELS = ", ".join(f"count(*) filter (level = {k}) as n_level_{k}" for k in range(1, 7))
O["markdown_stats"] = f"""with {_ALL} select doc_id, count(*) as total_blocks, {_N}, {_LEVELS}, coalesce(sum(length(content)) filter (type = 'paragraph'), 0)::bigint as paragraph_chars,
  round(coalesce(sum(length(content)) filter (type = 'paragraph') / nullif(count(*) filter (type = 'paragraph'), 0), 0.0), 2) as average_paragraph from blocks group by doc_id"""
_PLAIN = "content"
for _p in (r"\[([^\]]+)\]\([^)]+\)", r"!\[([^\]]*)\]\([^)]+\)", r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
    _PLAIN = rf"regexp_replace({_PLAIN}, '{_p}', '\1', 'g')"
O["markdown_extract_text"] = rf"""with {_ALL}, parts as (select doc_id, block, case when type = 'list' then list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^([-*+]|[0-9]+\.) ', '')) else [{_PLAIN}] end as items
  from blocks where type in ('paragraph', 'heading', 'quote', 'list')),
joined as (select doc_id, array_to_string(list_filter(flatten(list(items order by block)), lambda x: x <> ''), chr(10) || chr(10)) as t from parts group by doc_id)
select doc_id, md5(t) as text_md5, length(t)::integer as n_chars from joined"""
O["markdown_reconstruct"] = f"""with {_ALL}, rendered as (select doc_id, block, type, lead(type) over (partition by doc_id order by block) as after,
  case type when 'heading' then repeat('#', level) || ' ' || content when 'code_block' then '```' || coalesce(language, '') || chr(10) || content || chr(10) || '```' when 'quote' then '> ' || content else content end as body from blocks),
joined as (select doc_id, string_agg(body || case when after is null then '' when after = type and type in ('list', 'quote', 'table') then chr(10) else chr(10) || chr(10) end, '' order by block) as t from rendered group by doc_id)
select doc_id, md5(t) as markdown_md5, length(t)::integer as n_chars from joined"""
O["markdown_chunks"] = f"""with recursive {_ALL}, sized as (select doc_id, list(length(content) order by block) as ns from blocks group by doc_id),
walk as (select doc_id, ns, 1 as k, 0 as chunk, ns[1]::bigint as size from sized
  union all select doc_id, ns, k + 1, case when size + ns[k + 1] > 1000 then chunk + 1 else chunk end, case when size + ns[k + 1] > 1000 then ns[k + 1] else size + ns[k + 1] end from walk where k < len(ns))
select doc_id, chunk::integer as chunk, (min(k) - 1)::integer as first_block, count(*) as n_blocks, sum(ns[k])::bigint as size from walk group by doc_id, chunk"""
O["markdown_segment"] = f"""with {_ALL}, split as (select doc_id, type, case when type = 'paragraph' and length(content) > 200 and len({sents('content')}) > 0 then {sents('content')} else [content] end as parts from blocks)
select doc_id, type, count(*) as n, sum(length(piece))::bigint as chars from (select doc_id, type, unnest(parts) as piece from split) group by doc_id, type"""

# conversations: each turn a paragraph
TURNS = "turns as (select conv_id as doc_id, turn as para, text from conversations)"
_STOP = listed(sorted(set("的 了 在 是 我 有 和 就 不 人 都 一 the a an of to and in is it that".split())))
TERMS = rf"""{TURNS}, words as (select doc_id, para, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]{{2,}}'), lambda w: not list_contains({_STOP}, w))) as term from turns),
tf as (select doc_id, para, term, count(*) as tf from words group by all)"""
TFIDF = rf"""{TERMS}, sizes as (select doc_id, count(*) as n from turns group by doc_id),
kept_words as (select doc_id, para, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]{{2,}}'), lambda w: not list_contains({_STOP}, w)) as w from turns),
gram_tf as (select doc_id, para, term, count(*) as tf from (select doc_id, para, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from kept_words) group by all),
gram_df as (select doc_id, term, count(*) as df, sum(tf) as total from gram_tf group by all),
chosen as (select doc_id, term, df, n, row_number() over (partition by doc_id order by total desc, term) as place from gram_df join sizes using (doc_id) where df <= 0.9 * n),
raw as (select doc_id, para, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from gram_tf join chosen using (doc_id, term) where place <= 1000),
weights as (select doc_id, para, term, round(w / sqrt(sum(w * w) over (partition by doc_id, para)), 9) as weight from raw)"""
O["lexical_tfidf"] = f"with {TFIDF} select doc_id, para, term, round(weight, 6) as weight from weights"
O["lexical_similarity"] = f"with {TFIDF} select a.doc_id, a.para as i, b.para as j, round(sum(a.weight * b.weight), 6) as sim from weights a join weights b on a.doc_id = b.doc_id and a.term = b.term and a.para < b.para group by all"
O["keyword_overlap"] = f"""with {TERMS}, best as (select *, row_number() over (partition by doc_id, para order by tf desc, term) as r from tf),
tops as (select doc_id, para, list(term) as words from best where r <= 5 group by doc_id, para),
pairs as (select doc_id, para, coalesce(words, []::varchar[]) as a, lead(coalesce(words, []::varchar[])) over (partition by doc_id order by para) as b from turns left join tops using (doc_id, para))
select doc_id, para, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 0.0), 9) as overlap from pairs where b is not null"""


def hashed(x: str) -> str:
    """Counts of a text's words in 64 dimensions; a cosine of counts is that of their unit vectors."""
    words = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"
    return f"(list_transform(range(0, 64), lambda d: len(list_filter(list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 64), lambda b: b = d))::double))"


PAIRS = f"hashes as (select doc_id, para, {hashed('text')} as v from turns)"
O["similarity_matrix"] = f"""with {TURNS}, {PAIRS}, placed as (select *, row_number() over (partition by doc_id order by para) - 1 as i from hashes)
select a.doc_id, a.i::integer as i, b.i::integer as j, round({cosine('a.v', 'b.v')}, 6) as sim from placed a join placed b on a.doc_id = b.doc_id and a.i < b.i"""


def unit(h: str) -> str:
    return f"case when list_dot_product({h}, {h}) > 0 then list_transform({h}, lambda x: x / sqrt(list_dot_product({h}, {h}))) else {h} end"


def mean_of_pairs(vs: str) -> str:
    """Mean cosine of all pairs of a list of unit vectors, from their sum."""
    total = f"list_transform(range(1, 65), lambda i: list_sum(list_transform({vs}, lambda w: w[i])))"
    return f"case when len({vs}) > 1 then (list_dot_product({total}, {total}) - list_sum(list_transform({vs}, lambda w: list_dot_product(w, w)))) / (len({vs}) * (len({vs}) - 1)) else 1.0 end"


INNER = f"""split as (select doc_id, para, {sents('text')} as s from turns),
sentence_counts as (select doc_id, para, i, {hashed('s[i]')} as h from split, unnest(range(1, len(s) + 1)) as u(i)),
sentence_lists as (select doc_id, para, list({unit('h')} order by i) as vs from sentence_counts group by doc_id, para),
inner_ones as (select doc_id, para, coalesce({mean_of_pairs('vs')}, 1.0) as consistency from turns left join sentence_lists using (doc_id, para))"""
O["internal_consistency"] = f"with {TURNS}, {INNER} select doc_id, para, round(consistency, 6) + 0.0 as consistency from inner_ones"

_JS = "list_sum(list_transform(range(1, 65), lambda i: ({p}[i] + 1e-10) * ln(({p}[i] + 1e-10) / (({a}[i] + {b}[i]) / 2 + 1e-10))))"


def topic_gaps(shares: str) -> str:
    """CTEs up to ``told`` (doc_id, coherence, smoothness, n_boundaries) of neighbouring paragraphs' topics, ``shares`` of counts h."""
    return f"""shared as (select doc_id, para, {shares} as p from hashes),
beside as (select doc_id, p, lead(p) over (partition by doc_id order by para) as q from shared),
gaps as (select doc_id, {cosine('p', 'q')} as sim, exp(-(0.5::double * {_JS.format(p='p', a='p', b='q')} + 0.5::double * {_JS.format(p='q', a='p', b='q')})) as smooth from beside where q is not null),
told as (select doc_id, coalesce(avg(sim), 1.0) as coherence, coalesce(avg(smooth), 1.0) as smoothness, (count(*) filter (sim < 0.3))::integer as n_boundaries from (select distinct doc_id from hashes) left join gaps using (doc_id) group by doc_id)"""


_SQUARES = "case when list_dot_product(v, v) > 0 then list_transform(v, lambda x: x * x / list_dot_product(v, v)) else v end"
_SHARES = "case when list_sum(v) > 0 then list_transform(v, lambda x: x / list_sum(v)) else v end"
O["topic_coherence"] = f"with {TURNS}, {PAIRS}, {topic_gaps(_SQUARES)} select doc_id, round(coherence, 6) as coherence, round(smoothness, 6) as smoothness, n_boundaries from told"
O["consistency_score"] = f"""with {TFIDF}, {PAIRS}, {topic_gaps(_SHARES)}, {INNER},
lexical as (select doc_id, sum(sim) as sims from (select a.doc_id, a.para, b.para, round(sum(a.weight * b.weight), 12) as sim from weights a join weights b on a.doc_id = b.doc_id and a.term = b.term and a.para < b.para group by all) group by doc_id),
word_overlaps as (select doc_id, avg(overlap) as keywords from ({O["keyword_overlap"].replace('with ' + TERMS + ',', 'with')}) group by doc_id),
unit_lists as (select doc_id, list({unit('v')}) as vs from hashes group by doc_id),
per as (select doc_id, len(vs) as n, {mean_of_pairs('vs')} as semantic from unit_lists),
own as (select doc_id, avg(consistency) as internal from inner_ones group by doc_id),
parts as (select doc_id, n, semantic, coalesce(sims / (n * (n - 1) / 2), 0.0) as lexical, internal, coalesce(keywords, 0.0) as keywords, coherence, smoothness, n_boundaries
  from per join own using (doc_id) join told using (doc_id) left join lexical using (doc_id) left join word_overlaps using (doc_id) where n > 1),
scored as (select *, round(greatest(0.0::double, least(1.0::double, 0.3::double * semantic + 0.2::double * lexical + 0.2::double * coherence + 0.15::double * smoothness + 0.1::double * internal + 0.05::double * keywords)), 6) as score from parts)
select doc_id, n::integer as n_paragraphs, round(semantic, 6) + 0.0 as semantic, round(lexical, 6) as lexical, round(internal, 6) + 0.0 as internal, round(keywords, 6) as keywords, round(coherence, 6) as coherence, round(smoothness, 6) as smoothness, n_boundaries, score,
  case when score > 0.7 then 'high' when score > 0.4 then 'medium' else 'low' end as grade from scored"""
O["task_status_rollup"] = """with tasks as (select case when event_id % 4 = 0 then 'completed' when event_id % 4 = 1 then 'pending' else 'processing' end as status, (event_id % 100)::integer as p from events),
told as (select status, case when status <> 'processing' then status when p < 20 then 'reading' when p < 40 then 'parsing' when p < 80 then 'segmenting' else 'assembling' end as message,
  case when status = 'processing' and p > 0 then round(120.0::double / (p / 100) - 120.0, 3) end as remaining from tasks)
select status, message, count(*) as n, round(avg(remaining), 3) as remaining from told group by all"""
O["event_windows"] = "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"
O["event_sessions"] = """with gaps as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events),
numbered as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from gaps)
select user_id, min(ts) as session_start, count(*) as n from numbered group by user_id, k"""
O["deduplicated_sentences"] = f"with {SPLIT}, {ROWS} select sentence, count(*) as n, min(doc_id) as first_doc from rows group by sentence"
O["longest_sentences"] = f"""with {SPLIT}, {ROWS}, ranked as (select lang, doc_id, pos, length(sentence)::integer as n, row_number() over (partition by lang order by length(sentence) desc, doc_id, pos)::integer as rank from rows join documents using (doc_id))
select lang, rank, doc_id, pos, n from ranked where rank <= 3"""

_ZH = f"""based_texts as (select doc_id, ([{', '.join(map(q, ZH_TEXTS))}])[doc_id % {len(ZH_TEXTS)} + 1] as b, source, n_chars from documents),
zh as (select doc_id, case when trim(b) = '' then b else concat(b, '编号', doc_id::varchar, '的文本来自', source, '，共', n_chars::varchar, '字。') end as text from based_texts)"""
O["zh_ratio"] = f"with {_ZH}, based as (select doc_id, text, {norm('text')} as b from zh) select doc_id, round({ratio('text')}, 9) as ratio, case when {ratio('b')} > 0.5 then {_WIDE} else b end as normalized from based"
O["zh_transitions"] = f"with {_ZH}, sentences as (select doc_id, {sents('text', '。！？；：')} as s from zh), {ROWS} select doc_id, pos from rows where regexp_matches(sentence, {q('|'.join([*L.TRANSITIONS, *L.MARKERS, *L.TIMES]))})"
_LINED = rf"""regexp_replace(regexp_replace(text, '([。！？；])(["])', '\1' || chr(10) || '\2', 'g'), '(["])([。！？；])', '\1\2' || chr(10), 'g')"""
_SPLIT_ZH = f"""parts as (select doc_id, list_filter(list_transform(regexp_extract_all({_LINED}, '[^。！？；]*[。！？；]|[^。！？；]+$'), lambda s: {strip('s')}), lambda s: s <> '') as p from zh),
walk as (select doc_id, p, 1 as k, [p[1]] as out from parts where len(p) > 0
  union all select doc_id, p, k + 1, case when length(p[k + 1]) < 10 then list_append(out[1:-2], out[-1] || p[k + 1]) else list_append(out, p[k + 1]) end from walk where k < len(p)),
done as (select doc_id, out from walk where k = len(p))"""
O["zh_split"] = f"with recursive {_ZH}, {_SPLIT_ZH} select doc_id, (i - 1)::integer as pos, out[i] as sentence from done, unnest(range(1, len(out) + 1)) as u(i)"


def tokens(x: str) -> str:
    """Pairs of neighbouring Chinese characters and words of Latin letters and digits."""
    runs = rf"regexp_extract_all(lower({x}), '[\x{{4E00}}-\x{{9FFF}}]{{2,}}|[\p{{Latin}}\p{{N}}]{{2,}}')"
    return rf"flatten(list_transform({runs}, lambda r: case when regexp_matches(r, '^[\x{{4E00}}-\x{{9FFF}}]') then list_transform(range(1, greatest(length(r) - 1, 1) + 1), lambda i: substr(r, i, 2)) else [r] end))"


def spans(x: str, pattern: str) -> str:
    """Start, end and inner words of each match, from the lengths of matches and of the gaps between them."""
    got, inner, gap = (f"regexp_extract_all({x}, {q(pattern)})", f"regexp_extract_all({x}, {q(pattern)}, 1)", f"regexp_split_to_array({x}, {q(pattern)})")
    upto = f"coalesce(list_sum(list_transform(({gap})[1:k], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(({got})[1:k - 1], lambda y: length(y))), 0)"
    return f"list_transform(range(1, len({got}) + 1), lambda k: {{'a': {upto}, 'z': {upto} + length(({got})[k]), 'c': ({inner})[k]}})"


_SPOKEN = f"list_distinct({' || '.join(spans('text', p) for p in L.SPOKEN)})"
O["zh_dialogue"] = f"with {_ZH}, found as (select doc_id, unnest({_SPOKEN}) as s from zh) select doc_id, s.a::integer as start, s.z::integer as end, s.c as content from found"
O["zh_keywords"] = f"""with {_ZH}, listed as (select doc_id, {tokens('text')} as t from zh), placed as (select doc_id, i as nth, t[i] as word from listed, unnest(range(1, len(t) + 1)) as u(i)),
counted as (select doc_id, word, count(*) as n, min(nth) as first from placed group by all),
ranked as (select *, row_number() over (partition by doc_id order by n desc, first, word)::integer as rank, sum(n) over (partition by doc_id) as total from counted)
select doc_id, rank, word, 'x' as pos, round(n / total, 9) as score from ranked where rank <= 5"""
_PUNCT = "[" + L.PUNCTUATION + '"' + "]"
O["zh_features"] = f"""with recursive {_ZH}, {_SPLIT_ZH},
lists as (select doc_id, text, {tokens('text')} as t, {_SPOKEN} as sp, coalesce(out, []::varchar[]) as s from zh left join done using (doc_id)),
lens as (select *, list_transform(s, lambda x: length(x)::double) as l, length(text) as n from lists),
means as (select *, coalesce(list_sum(l) / nullif(len(l), 0), 0.0) as m from lens)
select doc_id, round({ratio('text')}, 9) as chinese_ratio, round(m, 9) as avg_sentence_length, round(coalesce(sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / nullif(len(l), 0)), 0.0), 9) as sentence_length_std,
  round(coalesce({count('text', _PUNCT)} / nullif(n, 0), 0.0), 9) as punctuation_density, round(coalesce(coalesce(list_sum(list_transform(sp, lambda x: x.z - x.a)), 0) / nullif(n, 0), 0.0), 9) as dialogue_ratio,
  round(coalesce(len(list_filter({listed(L.TRANSITIONS)}, lambda w: contains(text, w))) / nullif(len(s), 0), 0.0), 9) as transition_density, round(coalesce(len(list_distinct(t)) / nullif(len(t), 0), 0.0), 9) as lexical_diversity from means"""
_TURNING = q("|".join([*L.TRANSITIONS, *L.MARKERS, *L.TIMES]))
_SAID = " or ".join(f"regexp_matches(a || b, {q(p)})" for p in L.SPOKEN)
O["zh_narrative_boundaries"] = f"""with {_ZH}, sentences as (select doc_id, {sents('text', '。！？；：')} as s from zh), {ROWS},
pairs as (select doc_id, pos, sentence as a, lead(sentence) over (partition by doc_id order by pos) as b from rows),
known as (select doc_id, pos, a, b, list_distinct({tokens('a')}) as ta, list_distinct({tokens('b')}) as tb, {cosine(hashed('a'), hashed('b'))} as sim from pairs where b is not null),
limits as (select *, 0.5::double * case when regexp_matches(b, {_TURNING}) then 0.7::double else 1.0::double end * case when {_SAID} then 0.8::double else 1.0::double end
  * case when coalesce(len(list_intersect(ta, tb)) / nullif(len(list_distinct(ta || tb)), 0), 0.0) < 0.2 then 0.9::double else 1.0::double end as most from known)
select doc_id, (pos + 1)::integer as boundary from limits where sim < most"""

# the whole method: types, sentences, unit vectors of hashed words, smoothed similarities, votes, hints, repair, paragraphs
_VOTES = ", ".join(f"('{k}', " + ", ".join(f"{w}::double, {th}::double" for w, th in v[:3]) + f", {v[3]}::double)" for k, v in VOTES.items())
_BY_TYPE = list(zip(("t1", "t3", "t5"), ("w1", "w3", "w5"), ("h1", "h3", "h5"), strict=True))
_SCORE = " + ".join(f"case when {candidate(t, h)} then {w} * (1 - {t}[pos + 1]) else 0.0 end" for t, w, h in _BY_TYPE)
_CANDIDATE = " or ".join(candidate(t, h) for t, _, h in _BY_TYPE)
_SMOOTH_TEXTS = SMOOTH.replace(VECTORS, "vectors as (select doc_id as label, pos, v from units)")


def segmented(kind: str, hints: str, shortest: str, longest: str) -> str:
    """CTEs up to ``paras``; ``kind`` is a document's type, the others its settings, in terms of typed and settings."""
    return f"""{TYPED}, {SETTINGS},
set_up as (select doc_id, {kind} as text_type, {norm('text')} as normalized, {hints} as hints, {shortest} as shortest, {longest} as longest from typed join settings s on s.text_type = {kind}),
sentences as (select doc_id, {sents('normalized')} as s from set_up), {ROWS},
hashes as (select doc_id, pos, {hashed('sentence')} as h from rows),
units as (select doc_id, pos, case when list_dot_product(h, h) > 0 then list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) else h end as v from hashes),
{_SMOOTH_TEXTS},
votes as (select * from (values {_VOTES}) as v(text_type, w1, h1, w3, h3, w5, h5, least)),
voted as (select label as doc_id, pos from points join set_up on doc_id = label join votes using (text_type) where ({_CANDIDATE}) and round(0.0::double + {_SCORE}, 9) >= least),
hinted as (select doc_id, pos from rows join set_up using (doc_id) where hints and pos > 0 and (({_TITLE}) or {_ITEM})),
cuts as (select doc_id, list(pos order by pos) as b from (select * from voted union select * from hinted) group by doc_id),
summed as (select doc_id, len(s) as n, s, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)) as sums from sentences),
walk as (select doc_id, sums, b::bigint[] as b, shortest, longest, 0 as k, 0::bigint as start, []::bigint[] as made from cuts join summed using (doc_id) join set_up using (doc_id) where n >= 2
  union all select doc_id, sums, b, shortest, longest, k + 1, case when {span('start', 'b[k + 1]')} < shortest and shortest > 50 then start else b[k + 1] end,
    case when {span('start', 'b[k + 1]')} < shortest and shortest > 50 then [] when {span('start', 'b[k + 1]')} > longest and b[k + 1] - start > 2 then [start + (b[k + 1] - start) // 2, b[k + 1]] else [b[k + 1]] end
  from walk where k < len(b)),
repaired as (select doc_id, flatten(list(made)) as m from walk group by doc_id),
ends as (select doc_id, s, n, list_sort([0::bigint] || coalesce(m, []::bigint[]) || [n]) as e, len(coalesce(m, []::bigint[])) as boundary_count from summed left join repaired using (doc_id) where n >= 2),
ranges as (select doc_id, s, e[i] as a, e[i + 1] as z from ends, unnest(range(1, len(e))) as u(i) where e[i] < e[i + 1]),
texts as (select doc_id, a, z, {norm("array_to_string(s[a + 1:z], ' ')")} as t from ranges),
paras as (select doc_id, (row_number() over (partition by doc_id order by a) - 1)::integer as para, trim(t) as text,
    case when length(t) < 50 then 'title' when regexp_matches(t, '^(?:[•\\-*]|1\\.|2\\.)') then 'list_item' else 'content' end as type,
    length(t)::integer as length, (z - a)::integer as sentence_count, a::integer as start_idx, z::integer as end_idx, {phrases('t', 3)} as key_phrases from texts where t <> ''
  union all select doc_id, 0, normalized, 'content', length(normalized)::integer, n::integer, 0, n::integer, {phrases('normalized', 3)} from set_up join summed using (doc_id) where n < 2 and normalized <> '')"""


_OWN = segmented("typed.text_type", "use_structure_hints", "min_paragraph_length", "max_paragraph_length")
_QUALITY = f"""text_vectors as (select doc_id, para, {hashed('text')} as v from paras),
next_ones as (select doc_id, {cosine('v', 'nv')} as sim from (select *, lead(v) over (partition by doc_id order by para) as nv from text_vectors) where nv is not null),
same as (select doc_id, avg(sim) as sim from next_ones group by doc_id),
measured as (select doc_id, count(*) as n, avg(length) as avg_length, stddev_pop(length) as length_std, avg(sentence_count) as avg_sentences, count(*) filter (length < shortest) as short, count(*) filter (length > longest) as long,
  1 - abs(count(*) filter (type = 'content') / count(*) - 0.8::double) as structure from paras join set_up using (doc_id) join ends using (doc_id) group by doc_id),
scored as (select *, greatest(0.0::double, least(1.0::double, (1 - 0.1::double * short / n - 0.1::double * long / n) * (1 + coalesce(sim, 0.0) * 0.2::double) * structure * case when n < 2 then 0.8::double when n > 20 then 0.9::double else 1.0::double end)) as score from measured left join same using (doc_id))"""
O["segment_enhanced"] = f"with recursive {_OWN} select doc_id, text_type, para, text, type, length, sentence_count, start_idx, end_idx, key_phrases from paras join set_up using (doc_id)"
O["segment_quality"] = f"""with recursive {_OWN}, {_QUALITY}
select u.doc_id, u.text_type, t.n::integer as sentence_count, e.boundary_count::integer as boundary_count, q.n::integer as paragraph_count, round(q.avg_length, 2) as avg_length, round(q.length_std, 2) as length_std,
  round(q.avg_sentences, 2) as avg_sentence_count, q.short::integer as too_short_count, q.long::integer as too_long_count, round(case when q.n is not null then coalesce(q.sim, 0.0) end, 3) as semantic_consistency, round(q.structure, 3) as structure_score, round(q.score, 3) as quality_score
from set_up u join summed t using (doc_id) left join ends e using (doc_id) left join scored q using (doc_id)"""
O["format_output"] = f"""with recursive {_OWN}, out as (select doc_id, coalesce(array_to_string(list_filter(list({strip('text')} order by para), lambda x: x <> ''), chr(10) || chr(10)), '') as o from paras group by doc_id)
select doc_id, md5(o) as output_md5, length(o)::integer as n_chars from out"""
O["segment_forced_dialogue"] = f"""with recursive {segmented("'dialogue'", "true", "min_paragraph_length", "max_paragraph_length")}
select doc_id, count(*) as n, sum(length)::bigint as chars, sum(sentence_count)::bigint as sentences from paras group by doc_id"""
_SHORT = segmented("typed.text_type", "use_structure_hints", "50", "500")
O["segment_multi_task"] = f"""with recursive {_SHORT}, {_QUALITY}, sizes as (select doc_id, count(*) as np from paras group by doc_id)
select u.doc_id, u.text_type, np::integer as n_paragraphs, round(q.score, 3) as quality_score from set_up u left join sizes using (doc_id) left join scored q using (doc_id)"""

_ZH_NORMAL = f"case when {ratio(norm('text'))} > 0.5 then {_WIDE.replace('(b,', '(' + norm('text') + ',')} else {norm('text')} end"
_ZH_OWN = _OWN.replace("from documents", "from zh").replace("lang, case when not fit", "case when not fit").replace(f"{norm('text')} as normalized", f"{_ZH_NORMAL} as normalized")
_ZH_CUT = _SPLIT_ZH.replace("from zh", "from set_up").replace("text,", "normalized,").replace("walk", "split_walk").replace("parts", "split_parts").replace("done", "split_done")
_ZH_OWN = _ZH_OWN.replace(f"sentences as (select doc_id, {sents('normalized')} as s from set_up)", f"{_ZH_CUT},\nsentences as (select doc_id, case when {ratio('normalized')} > 0.5 then coalesce(out, []::varchar[]) else {sents('normalized', '。！？；：')} end as s from set_up left join split_done using (doc_id))")
_ZH_OWN = _ZH_OWN.replace("fits as (select *,", f"fits as (select *,").replace("from typed join settings", "from typed_all join settings")
_ZH_OWN = _ZH_OWN.replace("set_up as (select", f"typed_all as (select * from typed where regexp_matches(text, '{NOT_WS}')),\nset_up as (select").replace("typed.text_type", "typed_all.text_type")
O["zh_segment"] = f"with recursive {_ZH}, {_ZH_OWN} select doc_id, text_type, para, text, type, 1::integer as level, length, sentence_count, start_idx, end_idx from paras join set_up using (doc_id)"
