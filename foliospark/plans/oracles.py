"""DuckDB SQL for the queries of plans.queries. Shared steps are common table expressions, added as far as a query names them."""

from __future__ import annotations

import re

from ..functions.text import CAPTION, CHAPTER, EQUATION, NUMBERED, PAGE_NUMBER, SECTION, SPACES
from ..operators.recognition import VOCABULARY
from ..sources.sentences import SENTENCES

_ROMAN = "case c when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 else 0 end"


def _roman(s: str) -> str:
    vals = f"list_transform(string_split(lower(trim({s})), ''), lambda c: {_ROMAN})"
    total = f"list_sum(list_transform(range(1, len({vals}) + 1), lambda i: case when {vals}[i] >= coalesce({vals}[i + 1], 0) then {vals}[i] else -{vals}[i] end))"
    return f"cast(case when regexp_full_match(trim({s}), '\\d+') then cast(trim({s}) as bigint) when {total} > 0 then {total} else 1 end as bigint)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TOK = f"list_filter(regexp_split_to_array({{0}}, '[{SPACES}]+'), lambda t: t <> '')"

STEPS: dict[str, str] = {
    "lines_": """
select doc_id, source, cast(k as bigint) as k, trim(raw) as line
from (select doc_id, source, unnest(str_split(text, chr(10))) as raw, generate_subscripts(str_split(text, chr(10)), 1) - 1 as k from documents)
where trim(raw) <> ''""",
    "sheets_": """
select source, doc_id, sheet, row_number() over (partition by source order by doc_id, sheet) as page_number
from (select distinct source, doc_id, k // 60 as sheet from lines_)""",
    "plines_": """
select 'doc_' || substr(sha256(l.source), 1, 16) as document_id, page_number, l.doc_id, s.sheet, l.k % 60 as kk, l.line
from lines_ l join sheets_ s on l.source = s.source and l.doc_id = s.doc_id and l.k // 60 = s.sheet""",
    "vpages_": """
select document_id, page_number, doc_id, sheet, string_agg(line, chr(10) order by kk) as raw_text from plines_ group by all""",
    "qdocs_": "select *, row_number() over (partition by source order by doc_id) as page_number from documents",
    "qpages_": """
select 'doc_' || substr(sha256(source), 1, 16) as document_id, page_number, doc_id, doc_id % 2 as image_count, text as t from qdocs_
union all
select 'doc_' || substr(sha256(source), 1, 16), page_number + 1000000, doc_id, doc_id % 2, case when doc_id % 17 = 0 then '' else repeat(chr(65533), cast(floor(n_chars / 4) as bigint)) || text end
from qdocs_ where doc_id % 17 = 0 or doc_id % 13 = 0""",
    "feat_": r"""
select *, length(t) as n,
  cast(length(regexp_replace(t, '[^\x20-\x7E\t\n\r\x0B\x0C]', '', 'g')) as double) / nullif(length(t), 0) as pr,
  cast(length(t) - length(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]', '', 'g')) as double) / nullif(length(t), 0) as gr,
  cast(length(t) - length(regexp_replace(t, '[""" + SPACES + r"""]', '', 'g')) as double) / nullif(length(t), 0) as wr,
  """ + _TOK.format("t") + r""" as toks
from qpages_""",
    "scored_": """
select *, case when len(toks) > 0 then cast(list_sum(list_transform(toks, lambda w: length(w))) as double) / len(toks) else 0 end as awl from feat_""",
    "quality_": """
select document_id, page_number, doc_id, image_count, cast(n as bigint) as text_character_count, cast(len(toks) as bigint) as word_count,
  case when n > 0 then round(pr, 3) else 0.0 end as printable_ratio, case when n > 0 then round(wr, 3) else 0.0 end as whitespace_ratio,
  case when n > 0 then round(gr, 3) else 1.0 end as garbage_ratio,
  case when n > 0 then greatest(0.0, least(1.0, round(cast(1.0 as double)
    - case when pr < 0.95 then (cast(0.95 as double) - pr) * 2 else 0.0 end
    - case when gr > 0.01 then least(1.0, gr * 10) else 0.0 end
    - case when awl < 2.2 or awl > 25 then 0.35 else 0.0 end
    - case when n < 150 and image_count > 0 then 0.30 else 0.0 end
    - case when wr > 0.40 or (n > 50 and wr < 0.05) then 0.25 else 0.0 end, 3))) else 0.0 end as text_quality_score
from scored_""",
    "routed_": """
select *, case when text_character_count > 0 and text_quality_score >= 0.70 then 'DIGITAL_TEXT' when text_character_count > 0 then 'POOR_TEXT_LAYER' else 'SCANNED_OR_IMAGE_ONLY' end as route
from quality_""",
    "dpages_": "select distinct document_id, page_number, doc_id from plines_",
    "blocks_": """
select document_id, page_number, doc_id, kk as ord,
  case when kk = 0 and (page_number - 1) % 5 = 0 then 'Chapter ' || ((page_number - 1) // 5 + 1) || ': ' || substr(line, 1, 40)
       when kk = 0 and page_number % 2 = 0 then ((page_number - 1) // 5 + 1) || '.' || page_number || ' ' || substr(line, 1, 40) else line end as text,
  case when kk = 0 and (page_number - 1) % 5 = 0 then 18.0 when kk = 0 and page_number % 2 = 0 then 14.0 else 11.0 end::double as font,
  case when doc_id % 3 = 0 and not (kk = 0 and ((page_number - 1) % 5 = 0 or page_number % 2 = 0)) and kk % 2 = 1 then 332.0 else 72.0 end::double as x0,
  (72 + 10 * kk)::double as y0,
  case when doc_id % 3 = 0 and not (kk = 0 and ((page_number - 1) % 5 = 0 or page_number % 2 = 0)) and kk % 2 = 0 then 280.0 else 540.0 end::double as x1,
  (80 + 10 * kk)::double as y1
from plines_
union all select document_id, page_number, doc_id, 500, trim(substr(line, 41)), 11.0, 72.0, 76.0, 540.0, 80.0 from plines_ where kk = 0 and ((page_number - 1) % 5 = 0 or page_number % 2 = 0) and length(line) > 40
union all select document_id, page_number, doc_id, -1, document_id, 10.0, 72.0, 30.0, 540.0, 40.0 from dpages_
union all select document_id, page_number, doc_id, 1000, cast(page_number as varchar), 10.0, 540.0, 760.0, 560.0, 770.0 from dpages_""",
    "tables_": "select document_id, page_number, 72.0::double as x0, 300.0::double as y0, 540.0::double as x1, 360.0::double as y1 from dpages_ where doc_id % 7 = 0",
    "images_": """
select document_id, page_number, 72.0::double as x0, case when doc_id % 8 = 0 then 500.0 else 310.0 end::double as y0, 272.0::double as x1, (case when doc_id % 8 = 0 then 500.0 else 310.0 end + 40.0)::double as y1
from dpages_ where doc_id % 4 = 0""",
    "words_": """
select document_id, page_number, ord * 10000 + i as word_ordinal, tok as text, (x0 + 6.0 * before)::double as x0, (y0 + 1.75 * (i % 3))::double as top,
  (x0 + 6.0 * before + 6.0 * length(tok))::double as x1, (y0 + 1.75 * (i % 3) + 8.0)::double as bottom, case when i % 4 = 3 then 0.0 else 11.0 end::double as size
from (select *, coalesce(sum(length(tok) + 1) over (partition by document_id, page_number, ord order by i rows between unbounded preceding and 1 preceding), 0) as before
  from (select document_id, page_number, ord, x0, y0, unnest(str_split(text, ' ')) as tok, generate_subscripts(str_split(text, ' '), 1) - 1 as i from blocks_))
where tok <> ''""",
    "wordseq_": "select *, row_number() over (partition by document_id, page_number order by top, x0, word_ordinal) as r from words_",
    "lineno_": """
select document_id, page_number, word_ordinal, r, top as anchor, 1 as line_no from wordseq_ where r = 1
union all
select w.document_id, w.page_number, w.word_ordinal, w.r, case when abs(w.top - l.anchor) > 3.5 then w.top else l.anchor end, l.line_no + case when abs(w.top - l.anchor) > 3.5 then 1 else 0 end
from lineno_ l join wordseq_ w on w.document_id = l.document_id and w.page_number = l.page_number and w.r = l.r + 1""",
    "median_": """
select document_id, page_number, s[len(s) // 2 + 1] as median_font_size
from (select document_id, page_number, list(font order by font) filter (font > 0) as s from blocks_ group by all)""",
    "typed_": f"""
select b.*, case
  when y0 < 792 * 0.08 then case when regexp_matches(t, {_q(PAGE_NUMBER)}) and length(t) < 12 then 'PAGE_NUMBER' else 'HEADER' end
  when y1 > 792 * 0.92 then case when regexp_matches(t, {_q(PAGE_NUMBER)}) and length(t) < 12 then 'PAGE_NUMBER' else 'FOOTER' end
  when regexp_matches(t, {_q(CAPTION)}) then 'CAPTION'
  when font >= median_font_size * 1.5 then 'HEADING' when font >= median_font_size * 1.25 then 'SUBHEADING'
  when length(t) < 80 and regexp_matches(t, {_q(EQUATION)}) and contains(t, '(') and contains(t, ')') and (contains(t, '=') or contains(t, '+')) then 'EQUATION'
  else 'BODY' end as type
from (select *, trim(text) as t from blocks_) b join median_ m using (document_id, page_number)
where t <> ''""",
    "regions_": """
select *, row_number() over (partition by document_id, page_number order by kind, ord) as region_no
from (
  select document_id, page_number, 0 as kind, cast(y0 as bigint) as ord, 'TABLE' as type, 'page | ' || page_number || chr(10) || ' | end' as text, x0, y0, x1, y1, 0.98::double as confidence from tables_
  union all
  select document_id, page_number, 1, ord, type, t, x0, y0, x1, y1, 0.95 from typed_ b
  where not exists (select 1 from tables_ t where t.document_id = b.document_id and t.page_number = b.page_number and (b.x0 + b.x1) / 2 between t.x0 and t.x1 and (b.y0 + b.y1) / 2 between t.y0 and t.y1)
  union all
  select document_id, page_number, 2, cast(y0 as bigint), 'FIGURE', '[Figure Image]', x0, y0, x1, y1, 0.90 from images_ b
  where not exists (select 1 from tables_ t where t.document_id = b.document_id and t.page_number = b.page_number and (b.x0 + b.x1) / 2 between t.x0 and t.x1 and (b.y0 + b.y1) / 2 between t.y0 and t.y1))""",
    "zoned_": """
select *, case when type in ('HEADER', 'PAGE_NUMBER') and y0 < 792 * 0.15 then 0 when type in ('FOOTER', 'PAGE_NUMBER') and y1 > 792 * 0.85 then 2 else 1 end as zone,
  x1 - x0 <= 612 * 0.65 as narrow, (x0 + x1) / 2 as cx
from regions_""",
    "columns_": """
select document_id, page_number, bool_or(narrow and cx < 306 - 30.6) and bool_or(narrow and cx > 306 + 30.6) as two from zoned_ where zone = 1 group by all""",
    "wide_": """
select document_id, page_number, region_no, y0, y1, row_number() over w as span, coalesce(lag(y1) over w, 0.0) as low
from zoned_ join columns_ using (document_id, page_number) where zone = 1 and two and not narrow
window w as (partition by document_id, page_number order by y0, x0, region_no)""",
    "bands_": """
select document_id, page_number, span, low, y0 as high from wide_
union all
select document_id, page_number, max(span) + 1, arg_max(y1, span), 'infinity'::double from wide_ group by all
union all
select document_id, page_number, 1, 0.0, 'infinity'::double from columns_ c where two and not exists (select 1 from wide_ w where w.document_id = c.document_id and w.page_number = c.page_number)""",
    "banded_": """
select z.*, coalesce(c.two, false) and zone = 1 as two, case when not (coalesce(c.two, false) and zone = 1) then 0 when not narrow then w.span else b.span end as band,
  case when not (coalesce(c.two, false) and zone = 1) then 0 when not narrow then 2 when cx < 306 then 0 else 1 end as part
from zoned_ z left join columns_ c using (document_id, page_number)
left join wide_ w on w.document_id = z.document_id and w.page_number = z.page_number and w.region_no = z.region_no
left join bands_ b on b.document_id = z.document_id and b.page_number = z.page_number and c.two and zone = 1 and narrow and z.y0 >= b.low and z.y0 < b.high""",
    "ordered_": """
select document_id, page_number, region_no, printf('r%03d', region_no) as region_id, type, text, x0, y0, x1, y1, confidence, kind,
  row_number() over (partition by document_id, page_number order by zone, band, part, y0, x0, region_no) as reading_order
from banded_ where band is not null""",
    "rlines_": """
select document_id, page_number, reading_order, type, line_no, trim(raw) as line
from (select document_id, page_number, reading_order, type, unnest(str_split(text, chr(10))) as raw, generate_subscripts(str_split(text, chr(10)), 1) - 1 as line_no from ordered_)
where trim(raw) <> '' and length(trim(raw)) <= 120""",
    "explicit_": f"""
select document_id, page_number, reading_order, line_no, 0 as rule, {_roman('num')} as number, case when ti <> '' then ti else 'Chapter ' || {_roman('num')} end as title,
  case when type in ('HEADING', 'SUBHEADING') then 0.96 else 0.88 end::double as confidence, 'pattern_explicit' as detection_method
from (select *, regexp_extract(line, {_q(CHAPTER)}, 1) as num, trim(coalesce(regexp_extract(line, {_q(CHAPTER)}, 2), '')) as ti from rlines_ where regexp_matches(line, {_q(CHAPTER)}))""",
    "numbered_": f"""
select document_id, page_number, reading_order, line_no, 1 as rule, cast(regexp_extract(line, {_q(NUMBERED)}, 1) as bigint) as number, trim(regexp_extract(line, {_q(NUMBERED)}, 2)) as title, 0.85::double as confidence, 'pattern_numbered_heading' as detection_method
from rlines_ where type = 'HEADING' and regexp_matches(line, {_q(NUMBERED)}) and not starts_with(lower(line), 'section') and try_cast(regexp_extract(line, {_q(NUMBERED)}, 1) as bigint) between 1 and 99""",
    "cands_": """
select * exclude (r) from (
  select *, row_number() over (partition by document_id, page_number order by reading_order, line_no, rule) as r from (select * from explicit_ union all select * from numbered_))
where r = 1""",
    "span_": "select document_id, min(page_number) as first_page, max(page_number) as last_page from dpages_ group by 1",
    "chapters_": """
select s.document_id, coalesce(chapter_no, 1) as chapter_no, printf('ch_%03d', coalesce(chapter_no, 1)) as chapter_id, coalesce(number, 1) as number, coalesce(title, 'Introduction / Main Content') as title,
  coalesce(page_number, first_page) as page_start, case when nxt is null then last_page else greatest(page_number, nxt - 1) end as page_end, coalesce(confidence, 0.5)::double as confidence,
  coalesce(detection_method, 'fallback_single_chapter') as detection_method
from span_ s left join (
  select *, row_number() over (partition by document_id order by page_number) as chapter_no, lead(page_number) over (partition by document_id order by page_number) as nxt from cands_) c using (document_id)""",
    "nch_": "select document_id, count(*) as n_chapters from chapters_ group by 1",
    "pch_": """
select p.document_id, p.page_number, c.chapter_id, c.chapter_no, c.number, c.page_start, c.page_end, n_chapters
from dpages_ p join chapters_ c on p.document_id = c.document_id and p.page_number between c.page_start and c.page_end join nch_ n on n.document_id = p.document_id""",
    "seccand_": f"""
select l.document_id, p.chapter_id, p.chapter_no, l.page_number, reading_order, line_no, line as title, p.page_end as chapter_end
from rlines_ l join pch_ p using (document_id, page_number)
where case when regexp_matches(line, {_q(SECTION)}) then starts_with(regexp_replace(regexp_extract(line, {_q(SECTION)}, 1), '\\s+', '', 'g'), number || '.') or n_chapters = 1
  else type = 'SUBHEADING' and len({_TOK.format('line')}) < 10 end""",
    "sections_": """
select document_id, chapter_id, section_no, chapter_id || printf('_s%03d', section_no) as section_id, title, page_number as page_start, coalesce(greatest(page_number, nxt - 1), chapter_end) as page_end
from (
  select *, row_number() over w as section_no, lead(page_number) over w as nxt
  from (select *, row_number() over (partition by document_id, chapter_id, page_number, title order by reading_order, line_no) as d from seccand_) where d = 1
  window w as (partition by document_id, chapter_id order by page_number, reading_order, line_no))""",
    "active_": """
select p.document_id, p.page_number, p.chapter_id, arg_min(s.section_id, s.section_no) as section_id
from pch_ p left join sections_ s on s.document_id = p.document_id and s.chapter_id = p.chapter_id and p.page_number between s.page_start and s.page_end group by all""",
    "units_": f"""
select o.document_id, a.chapter_id, o.page_number, o.reading_order, o.region_id, a.section_id, trim(o.text) as text, len({_TOK.format('o.text')}) as tokens,
  row_number() over (partition by o.document_id, a.chapter_id order by o.page_number, o.reading_order, o.region_id) as i
from ordered_ o join active_ a using (document_id, page_number) where o.type not in ('HEADER', 'FOOTER', 'PAGE_NUMBER') and trim(o.text) <> ''""",
    "fold_": """
select document_id, chapter_id, i, tokens, 1 as n, tokens as last, coalesce(section_id, '') as sec, 1 as chunk, false as carried from units_ where i = 1
union all
select document_id, chapter_id, i, case when split and n > 1 then last when split then 0 else had end + tokens, case when split and n > 1 then 1 when split then 0 else n end + 1, tokens, sec, chunk + split::int, split and n > 1
from (
  select u.document_id, u.chapter_id, u.i, u.tokens, f.tokens as had, f.n, f.last, coalesce(u.section_id, '') as sec, f.chunk, f.tokens >= 300 and (f.tokens + u.tokens > 800 or coalesce(u.section_id, '') <> f.sec) as split
  from fold_ f join units_ u on u.document_id = f.document_id and u.chapter_id = f.chapter_id and u.i = f.i + 1)""",
    "assigned_": """
select u.document_id, u.chapter_id, u.page_number, u.region_id, u.section_id, u.text, u.tokens, u.i - 1 as unit_no, cast(f.chunk as bigint) as chunk_no,
  coalesce(lead(f.carried) over (partition by u.document_id, u.chapter_id order by u.i), false) as carried
from units_ u join fold_ f using (document_id, chapter_id, i)""",
    "members_": "select * from assigned_ union all select * replace (chunk_no + 1 as chunk_no) from assigned_ where carried",
    "chunks_": """
select document_id, chapter_id, chunk_no, chapter_id || printf('_chk_%04d', chunk_no) as chunk_id, arg_max(struct_pack(s := section_id), unit_no).s as section_id, min(page_number) as page_start, max(page_number) as page_end,
  string_agg(region_id, ',' order by unit_no) as source_regions, cast(sum(tokens) as bigint) as token_count, string_agg(text, chr(10) || chr(10) order by unit_no) as text
from members_ group by document_id, chapter_id, chunk_no""",
    # With planted defects, for the audit.
    "ordered_x": "select * replace (case when region_no % 29 = 0 then 1 else reading_order end as reading_order) from ordered_ where page_number % 3 <> 0 or type <> 'HEADING'",
    "chapters_x": "select * replace (case when chapter_no % 7 = 0 then number - 1 when chapter_no % 5 = 0 then number + 5 else number end as number, case when chapter_no % 9 = 0 then page_start - 1 else page_end end as page_end) from chapters_",
    "sections_x": """
select document_id, chapter_id, section_no, case when i % 6 = 0 then 'dup' else section_id end as section_id, title, page_start - case when i % 4 = 0 then 1 else 0 end as page_start, page_end + case when i % 5 = 0 then 4 else 0 end as page_end
from (select *, row_number() over (partition by document_id order by chapter_id, section_no) as i from sections_)""",
    "chunks_x": """
select document_id, case when i % 11 = 0 then null when i % 13 = 0 then 'ch_999' else chapter_id end as chapter_id, chunk_no, chunk_id, page_start, page_end + case when i % 5 = 0 then 7 else 0 end as page_end, token_count % 97 as token_count
from (select *, row_number() over (partition by document_id order by chapter_id, chunk_no) as i from chunks_)""",
    "docs_": "select distinct document_id from dpages_",
    "headn_": "select document_id, count(*) filter (type = 'HEADING') as heading_count, count(*) filter (type = 'SUBHEADING') as subheading_count from ordered_x group by 1",
    "vheading_": """
select document_id, coalesce(heading_count, 0) as heading_count, coalesce(subheading_count, 0) as subheading_count, coalesce(c, 0) as chapters_detected, case when coalesce(c, 0) > 0 and coalesce(heading_count, 0) = 0 then 0.85 else 1.0 end::double as score
from docs_ left join headn_ using (document_id) left join (select document_id, count(*) as c from chapters_x group by 1) using (document_id)""",
    "gaps_": """
select document_id, number, next_number from (
  select document_id, number, lead(number) over (partition by document_id order by number) as next_number, count(*) over (partition by document_id) as n from chapters_x where number <> 0)
where n >= 3 and next_number - number > 2""",
    "vchapter_": """
select document_id, case when n is null then 'not_detected' else 'numbered' end as scheme, n as total_numbered_chapters, case when n is not null then coalesce(d, 0) end as duplicate_numbers, case when n is not null then coalesce(g, 0) end as gaps,
  case when coalesce(d, 0) > 0 then 0.85 else 1.0 end::double as score
from docs_ left join (select document_id, count(*) as n from chapters_x where number <> 0 group by 1) using (document_id)
left join (select document_id, count(*) as d from (select document_id, number from chapters_x where number <> 0 group by all having count(*) > 1) group by 1) using (document_id)
left join (select document_id, count(*) as g from gaps_ group by 1) using (document_id)""",
    "vsection_": r"""
select document_id, n as total_sections, case when n is not null then coalesce(d, 0) end as duplicate_sections, case when n is not null then coalesce(o, 0) end as unrelated_prefix_count,
  round(1.0::double - case when coalesce(d, 0) > 0 then 0.15 else 0.0 end - case when coalesce(o, 0) > 0 then 0.1 else 0.0 end, 3) as score
from docs_ left join (select document_id, count(*) as n from sections_x group by 1) using (document_id)
left join (select document_id, count(*) as d from (select document_id, section_id from sections_x group by all having count(*) > 1) group by 1) using (document_id)
left join (select s.document_id, count(*) as o from sections_x s join chapters_x c using (document_id, chapter_id) join nch_ n using (document_id)
  where c.number <> 0 and n_chapters > 1 and regexp_extract(trim(s.title), '^(\d+)\.\d+', 1) not in ('', cast(c.number as varchar)) group by 1) using (document_id)""",
    "orphans_": """
select document_id, chunk_id, 'orphan' as problem from chunks_x where coalesce(chapter_id, '') = ''
union all
select document_id, chunk_id, 'invalid_parent' from chunks_x k where coalesce(chapter_id, '') <> '' and not exists (select 1 from chapters_x c where c.document_id = k.document_id and c.chapter_id = k.chapter_id)""",
    "kn_": "select document_id, count(*) as kn from chunks_x group by 1",
    "vparent_": """
select document_id, coalesce(o, 0) as orphan_chunks, coalesce(v, 0) as invalid_parent_refs,
  greatest(0.0, round(1.0::double - least(0.3::double, coalesce(o, 0) / greatest(1, coalesce(kn, 0))) - least(0.4::double, coalesce(v, 0) / greatest(1, coalesce(kn, 0))), 3)) as score
from docs_ left join kn_ using (document_id) left join (select document_id, count(*) filter (problem = 'orphan') as o, count(*) filter (problem = 'invalid_parent') as v from orphans_ group by 1) using (document_id)""",
    "vbound_": """
select document_id, coalesce(v, 0) as boundary_violations, last_page as max_page, round(1.0::double - least(1.0::double, coalesce(v, 0) / greatest(1, coalesce(n, 0))), 3) as score
from span_ left join (
  select r.document_id, count(*) filter (r.page_start < 1 or r.page_end > s.last_page or r.page_start > r.page_end) as v, count(*) as n
  from (select document_id, page_start, page_end from chapters_x union all select document_id, page_start, page_end from chunks_x) r join span_ s using (document_id) group by 1) using (document_id)""",
    "vdup_": """
select document_id, round(coalesce(e, 0) / greatest(1, coalesce(n, 0)), 4)::double as duplicate_rate, coalesce(l, 0) as legitimate_duplicates, coalesce(e, 0) as likely_duplicate_errors
from docs_ left join (select document_id, count(*) as n, count(*) filter (occurrences between 2 and 5) as l, count(*) filter (occurrences > 5) as e from heads_ group by 1) using (document_id)""",
    "heads_": "select document_id, lower(trim(text)) as heading, count(*) as occurrences from ordered_x where type in ('HEADING', 'SUBHEADING') and length(trim(text)) > 5 group by all",
    "content_": """
select c.document_id, c.chapter_id, coalesce(n, 0) as n_chunks, case when n is null then 'EMPTY' when n = 1 and t < 50 then 'LOW_CONTENT' else 'NORMAL' end as classification
from chapters_x c left join (select document_id, chapter_id, count(*) as n, max(token_count) as t from chunks_x group by all) k on k.document_id = c.document_id and k.chapter_id = c.chapter_id""",
    "vempty_": """
select document_id, round(count(*) filter (classification = 'EMPTY') / greatest(1, count(*)), 4)::double as empty_rate, count(*) filter (classification = 'EMPTY') as empty_chapter_count, count(*) filter (classification = 'LOW_CONTENT') as low_content_chapters
from content_ group by 1""",
    "bounds_": """
select s.document_id, s.chapter_id, s.section_id, s.page_start, s.page_end, c.page_start as ch_start, c.page_end as ch_end,
  case when s.page_start >= c.page_start and s.page_end <= c.page_end then 'VALID' when s.page_end > c.page_end + 1 or s.page_start < c.page_start - 1 then 'INVALID' else 'QUESTIONABLE' end as status
from sections_x s join chapters_x c using (document_id, chapter_id)""",
    "vcross_": """
select document_id, coalesce(n, 0) as checked, coalesce(i, 0) as invalid, coalesce(q, 0) as questionable, (coalesce(i, 0) / greatest(1, coalesce(n, 0)))::double as rate
from docs_ left join (select document_id, count(*) as n, count(*) filter (status = 'INVALID') as i, count(*) filter (status = 'QUESTIONABLE') as q from bounds_ group by 1) using (document_id)""",
    "mis_": """
select k.document_id, k.chapter_id, k.chunk_id, k.page_start, k.page_end, c.page_start as ch_start, c.page_end as ch_end
from chunks_x k join chapters_x c using (document_id, chapter_id) where k.page_start < c.page_start or k.page_end > c.page_end""",
    "valign_": """
select document_id, coalesce(kn, 0) as total_chunks, coalesce(m, 0) as misaligned_chunks, greatest(0.0, round(1.0::double - coalesce(m, 0) / greatest(1, coalesce(kn, 0)), 3)) as score
from docs_ left join kn_ using (document_id) left join (select document_id, count(*) as m from mis_ group by 1) using (document_id)""",
    "vread_": """
select document_id, count(*) filter (dup) as duplicate_order_pages, count(*) filter (down) as non_monotonic_pages, case when count(*) filter (dup) > 0 then 0.9 else 1.0 end::double as score
from (select document_id, page_number, count(reading_order) <> count(distinct reading_order) as dup, bool_or(coalesce(down, false)) as down
  from (select *, reading_order < lag(reading_order) over (partition by document_id, page_number order by region_no) as down from ordered_x) group by all) group by 1""",
    "metrics_": """
select d.document_id, h.score as heading_hierarchy, c.score as chapter_numbering, s.score as section_numbering, p.score as parent_child_integrity, b.score as page_boundary_integrity, r.score as reading_order,
  u.duplicate_rate as duplicate_heading_rate, e.empty_rate as empty_chapter_rate, x.rate as cross_boundary_section_rate, a.score as chunk_alignment
from docs_ d join vheading_ h using (document_id) join vchapter_ c using (document_id) join vsection_ s using (document_id) join vparent_ p using (document_id) join vbound_ b using (document_id)
join vread_ r using (document_id) join vdup_ u using (document_id) join vempty_ e using (document_id) join vcross_ x using (document_id) join valign_ a using (document_id)""",
    "recs_": """
select document_id, unnest(r) as recommendation, generate_subscripts(r, 1) - 1 as position
from (select document_id, case when len(r) > 0 then r else ['Document structure is internally consistent and verified.'] end as r
  from (select document_id, list_filter([case when parent_child_integrity < 0.9 then 'Review orphan chunks or sections that lack valid chapter association.' end,
    case when cross_boundary_section_rate > 0.05 then 'Check chapter boundary heuristics as multiple sections extend past their parent chapter.' end,
    case when empty_chapter_rate > 0.2 then 'Multiple empty chapters detected; verify if title/preface pages were classified as chapters.' end], lambda x: x is not null) as r from metrics_))""",
    "msgs_": """
select document_id, 1::bigint as category_no, 0::bigint as position, 'WARNING' as severity, 'Chapters detected but zero HEADING regions classified on pages.' as message from vheading_ where score < 1
union all
select document_id, 2, 0, 'WARNING', 'Duplicate chapter numbers found: [' || string_agg('''' || number || '''', ', ' order by number) || ']' from (select document_id, number from chapters_x where number <> 0 group by all having count(*) > 1) group by 1
union all
select document_id, 2, 1, 'INFO', 'Chapter numbering has gaps: [' || string_agg('(' || number || ', ' || next_number || ')', ', ' order by number, next_number) || ']' from gaps_ group by 1
union all
select document_id, 3, 0, 'WARNING', 'Duplicate section IDs found: [' || string_agg('''' || section_id || '''', ', ' order by section_id) || ']' from (select document_id, section_id from sections_x group by all having count(*) > 1) group by 1
union all
select document_id, 3, 1, 'INFO', unrelated_prefix_count || ' section numbers do not match parent chapter prefix' from vsection_ where unrelated_prefix_count > 0
union all
select document_id, 4, 0, 'WARNING', 'Found ' || orphan_chunks || ' chunks without a parent chapter ID.' from vparent_ where orphan_chunks > 0
union all
select document_id, 4, 1, 'ERROR', 'Found ' || invalid_parent_refs || ' chunks referencing non-existent chapter IDs.' from vparent_ where invalid_parent_refs > 0
union all
select document_id, 5, chapter_no, 'ERROR', 'Invalid chapter page range [' || page_start || ', ' || page_end || '] for ''' || title || '''' from chapters_x join span_ using (document_id) where page_start < 1 or page_end > last_page or page_start > page_end
union all
select document_id, 6, 0, 'INFO', 'Duplicate reading order indices found on ' || duplicate_order_pages || ' pages.' from vread_ where duplicate_order_pages > 0
union all
select document_id, 9, row_number() over (partition by document_id), 'INFO', '' from bounds_ where status = 'INVALID'""",
    "olines_": """
select *, row_number() over (partition by document_id, page_number order by y, x, w, h) as line_no
from (select 'd' || (user_id % 20) as document_id, user_id % 7 + 1 as page_number, event_id * 7 % 600 as x, event_id as y, event_id % 90 as w, event_id % 14 as h from events) where w > 10 and h > 6""",
    "preds_": "select *, case when y % 5 = 0 then '' else 'line  of ' || y end as said, y % 100 / 100.0::double as confidence from olines_",
    "recog_": """
select document_id, page_number, line_no, case when said <> '' then said else '[Line ' || line_no || ']' end as text, round(x * (612.0::double / 1275.0), 2) as x0, round(y * (792.0::double / 1650.0), 2) as y0,
  round((x + w) * (612.0::double / 1275.0), 2) as x1, round((y + h) * (792.0::double / 1650.0), 2) as y1, round(h * (792.0::double / 1650.0) * 0.75::double, 2) as avg_font_size, 'CRNN_OCR' as fontname,
  case when said = '' then 0 else 3 end::bigint as word_count, confidence from preds_""",
    "jobs_": """
select cast(user_id as varchar) as document_id, ts, event_id, case when event_type = 'signup' then 'queued' when event_type in ('view', 'click') then 'processing' when event_type = 'purchase' then 'completed' else 'failed' end as status, event_id % 50 as pages_processed
from events""",
    "state_": "select document_id, event_id, status, pages_processed from (select *, row_number() over (partition by document_id order by ts desc, event_id desc) as r from jobs_) where r = 1",
    "ocr_": r"select 'line_' || item_id as path, ref, replace(ref, 'th', 't') as hyp from (select item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') as ref from benchmark)",
    "ctc_": """
select vec_id // 16 as sample, vec_id % 16 as t, list_position(embedding, list_max(embedding)) - 1 as idx, 1.0 / list_sum(list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double))) as p from embeddings""",
    "ctck_": "select *, idx <> 0 and idx <> coalesce(lag(idx) over (partition by sample order by t), 0) as keep from ctc_",
    "epochs_": """
select event_id % 4 as run, event_id // 4 as epoch, round(3.0::double / (event_id + 1), 4) as loss, ((event_id * 7919 % 1000 + 20) / 1000.0)::double as cer, ((event_id * 104729 % 1000) / 1000.0)::double as wer from events""",
}

MAIN: dict[str, str] = {
    "scan_documents": "select document_id, page_number, doc_id, sheet, 612.0::double as width, 792.0::double as height, length(raw_text) as chars from vpages_",
    "content_hash_id": "select doc_id, sha256(text) as sha256, 'doc_' || substr(sha256(text), 1, 16) as content_id from documents",
    "scan_page_range": "select document_id, page_number, true as is_partial_run from dpages_ where page_number between 2 and 9",
    "scan_line_manifest": "select '/data/img_' || item_id as path, case when item_id % 3 = 0 then '' else trim(regexp_replace(text, '\\s+', ' ', 'g') || chr(9) || 'x') end as text from benchmark where item_id % 5 <> 0 and item_id % 7 <> 0",
    "upload_validate": """
select reject_reason, case when reject_reason is null then 202 when reject_reason = 'too_large' then 413 else 400 end::bigint as status_code, count(*) as uploads, cast(sum(size) as bigint) as bytes
from (select size, case when doc_id % 31 = 0 then 'no_file' when doc_id % 11 = 0 then 'extension' when size = 0 then 'empty' when doc_id % 19 = 0 then 'magic' when size > 262144000 then 'too_large' when doc_id % 23 = 0 then 'unreadable' when doc_id % 29 = 0 then 'no_pages' end as reject_reason
  from (select doc_id, case when doc_id % 13 = 0 then 0 when doc_id % 17 = 0 then 262144001 else n_chars end as size from documents)) group by all""",
    "page_dimensions": "select document_id, count(*) as pages, 612.0::double as width, 792.0::double as height from qpages_ group by 1",
    "log_line": """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || case when status = 'failed' then 'ERROR' else 'INFO' end || '] ocr_service: Stage ocr ' || case when status = 'failed' then 'failed' else 'completed' end
  || ' document_id=' || document_id || case when event_id % 3 = 0 then ' page_number=' || pages_processed else '' end || ' stage=ocr duration_ms=' || round(event_id % 1000 / 8.0::double, 2) || ' status=' || status
  || case when status = 'failed' then ' error=unreadable' else '' end as line from jobs_""",
    "scan_yaml_config": "select * from (values ('model.name', 'crnn'), ('model.height', '32'), ('model.dropout', '0.1'), ('model.layers.0', '64'), ('model.layers.1', '128'), ('train.shuffle', 'True'), ('train.seeds.0', '1'), ('train.seeds.1', '2'), ('note', 'a: b')) as t(path, value)",
    "object_store": "select * from (values ('a/one.txt', 'second', true, true), ('b/two.json', 'é', true, true), ('c.bin', null, false, false)) as t(key, value, found, listed)",
    "gen_synthetic_lines": f"""
select 'images/line_' || lpad(cast(id as varchar), 5, '0') || '.png' as path,
  case when b < 0.2 then array_to_string(list_slice(w, cast(floor(c * len(w)) as bigint) + 1, cast(floor(c * len(w)) as bigint) + cast(floor(d * (len(w) - floor(c * len(w)))) as bigint) + 1), ' ') else s end as text
from (select *, string_split(s, ' ') as w from (select id, b, c, d, [{', '.join(_q(v) for v in SENTENCES)}][cast(floor(a * {len(SENTENCES)}) as bigint) + 1] as s
  from (select id, ('0x' || md5('42-1-' || id)[1:8])::bigint / 4294967296.0::double as a, ('0x' || md5('42-2-' || id)[1:8])::bigint / 4294967296.0::double as b,
    ('0x' || md5('42-3-' || id)[1:8])::bigint / 4294967296.0::double as c, ('0x' || md5('42-4-' || id)[1:8])::bigint / 4294967296.0::double as d from (select unnest(range(500)) as id))))""",
    "scan_digital_page": """
select document_id, page_number, word_ordinal, text, round(a, 2) as x0, round(b, 2) as top, round(greatest(a, least(x1 - 80.126::double, 500.0)), 2) as x1, round(greatest(b, least(bottom + 0.377::double, 600.0)), 2) as bottom, case when size <> 0 then size end as size
from (select *, greatest(0.0::double, least(x0 - 80.126::double, 500.0)) as a, greatest(0.0::double, least(top + 0.377::double, 600.0)) as b from words_)""",
    "digital_tables": "select document_id, page_number, 72.0::double as x0, 300.0::double as y0, 500.0::double as x1, 360.0::double as y1, 3::bigint as rows, 2::bigint as cols from tables_",
    "digital_images": """
select document_id, page_number, 0.0::double as x0, y0 as top, x1, least(y1, 600.0::double) as bottom, round(x1, 2) as image_width, round(least(y1, 600.0::double) - y0, 2) as image_height from images_""",
    "digital_counts": """
select document_id, page_number, coalesce(sum(w), 0)::bigint as word_count, coalesce(sum(t), 0)::bigint as table_count, coalesce(sum(i), 0)::bigint as image_count
from (select document_id, page_number, 1 as w, 0 as t, 0 as i from words_ union all select document_id, page_number, 0, 1, 0 from tables_ union all select document_id, page_number, 0, 0, 1 from images_) group by all""",
    "baseline_ocr_blocks": """
select document_id, page_number, line_no, '[Scanned text line ' || line_no || ']' as text, x0, y0, x1, y1, avg_font_size, 'BaselineOCRFont' as fontname, 4::bigint as word_count, 0.85::double as confidence from recog_""",
    "baseline_ocr_words": """
select document_id, page_number, line_no, word_no, 'word_' || word_no as text, round((x + wx) * (612.0::double / 1275.0), 2) as x0, round((y + wy) * (792.0::double / 1650.0), 2) as y0, round((x + wx + ww) * (612.0::double / 1275.0), 2) as x1,
  round((y + wy + 5) * (792.0::double / 1650.0), 2) as y1, 'BaselineOCRFont' as fontname, round(5 * (792.0::double / 1650.0) * 0.75::double, 2) as size
from (select *, row_number() over (partition by document_id, page_number, line_no order by wx) as word_no
  from (select *, 30 - k * 9 as wx, k as wy, (y + k) % 9 as ww from (select *, unnest(range(4)) as k from olines_)) where ww > 4)""",
    "crnn_ocr_blocks": "select * from recog_",
    "crnn_ocr_pages": """
select document_id, page_number, 'cnn_ocr' as method, floor(round(avg(confidence), 4) * 1000 + 0.000001::double) / 1000 as confidence, md5(string_agg(text, chr(10) order by line_no)) as text_md5, count(*) as detected_regions from recog_ group by all
union all select 'none', 1, 'cnn_ocr', 1.0, md5(''), 0""",
    "scan_ocr_page": """
select model, case when doc_id % 9 <> 0 then case when model then 'cnn_ocr' else 'baseline_ocr' end end as method, case when doc_id % 9 = 0 then 'an image array is expected, not str' end as error, count(*) as pages
from documents, (select unnest([true, false]) as model) group by all""",
    "ctc_valid_lengths": f"""
select sample, coalesce(string_agg(coalesce([{', '.join(_q(v) for v in VOCABULARY)}][idx + 1], ''), '' order by t) filter (keep), '') as text, coalesce(string_agg(cast(idx as varchar), ',' order by t) filter (keep), '') as tokens,
  round(coalesce(round(avg(p) filter (keep), 4), 0.0), 3) as confidence from ctck_ where t < greatest(1, (sample % 15 * 4 + 3) // 4) group by 1""",
    "page_quality": "select * exclude (doc_id) from routed_",
    "page_route": "select document_id, page_number, route, text_character_count > 0 as text_layer_available, route = 'DIGITAL_TEXT' as should_use_text_layer from routed_",
    "profile_document": """
select document_id, count(*) as page_count, count(*) filter (route = 'DIGITAL_TEXT') as text_layer_pages, count(*) filter (route = 'POOR_TEXT_LAYER') as poor_text_pages, count(*) filter (route = 'SCANNED_OR_IMAGE_ONLY') as zero_text_pages,
  count(*) filter (image_count > 0) as image_pages, round(sum(text_character_count) / count(*), 2)::double as average_chars_per_page, round(sum(word_count) / count(*), 2)::double as average_words_per_page from routed_ group by 1""",
    "routing_counts": "select document_id, count(*) filter (route = 'DIGITAL_TEXT') as digital_text, count(*) filter (route = 'POOR_TEXT_LAYER') as poor_text_layer, count(*) filter (route = 'SCANNED_OR_IMAGE_ONLY') as scanned_or_image_only from routed_ group by 1",
    "extraction_counts": "select document_id, count(*) filter (route = 'DIGITAL_TEXT') as pdfplumber, count(*) filter (route = 'POOR_TEXT_LAYER') as cnn_ocr, count(*) filter (route = 'SCANNED_OR_IMAGE_ONLY') as baseline_ocr from routed_ group by 1",
    "cluster_lines": "select document_id, page_number, word_ordinal, cast(line_no as bigint) as line_no from lineno_",
    "block_agg": """
select document_id, page_number, cast(line_no as bigint) as line_no, string_agg(text, ' ' order by x0, top, word_ordinal) as text, round(min(x0), 2) as x0, round(min(top), 2) as y0, round(max(x1), 2) as x1, round(max(bottom), 2) as y1,
  round(coalesce(avg(size) filter (size > 0), 10.0), 2) as avg_font_size, 'Times' as fontname, count(*) as word_count
from words_ join lineno_ using (document_id, page_number, word_ordinal) group by all""",
    "approx_word_boxes": """
select document_id, page_number, ord, i, word, round(x0 + unit * before, 2) as x0, round(x0 + unit * (before + length(word)), 2) as x1, y0, y1
from (select *, 6.0::double as unit, coalesce(sum(length(word) + 1) over (partition by document_id, page_number, ord order by i rows between unbounded preceding and 1 preceding), 0) as before
  from (select *, unnest(regexp_split_to_array(trim(text), '\\s+')) as word, generate_subscripts(regexp_split_to_array(trim(text), '\\s+'), 1) - 1 as i from blocks_)) where word <> ''""",
    "scale_bbox": "select document_id, page_number, ord, round(x0 * (612.0::double / 1275.0), 2) as x0, round(y0 * (792.0::double / 1650.0), 2) as y0, round(x1 * (612.0::double / 1275.0), 2) as x1, round(y1 * (792.0::double / 1650.0), 2) as y1, round((y1 - y0) * (792.0::double / 1650.0) * 0.75, 2) as font_size from blocks_",
    "line_box_filter": """
select image, x, y, greatest(0, x - 2) as px0, greatest(0, y - 2) as py0, least(612, x + w + 2) as px1, least(10000, y + h + 2) as py1, row_number() over (partition by image order by y, x) as line_no
from (select user_id % 20 as image, event_id * 7 % 600 as x, event_id as y, event_id % 90 as w, event_id % 14 as h from events) where w > 10 and h > 6""",
    "line_width": "select doc_id, cast(ceil(greatest(32, least(1024, cast(round_even(32.0::double * case when doc_id % 50 > 0 then n_chars::double / (doc_id % 50) else 1.0 end, 0) as bigint))) / 4.0) * 4 as bigint) as width from documents",
    "median_font": "select * from median_",
    "classify_block": "select document_id, page_number, ord, type from typed_",
    "skip_empty_block": "select document_id, count(*) as blocks from blocks_ where ord % 9 <> 0 group by 1",
    "semi_anti_in_table": """
select document_id, page_number, ord from blocks_ b
where not exists (select 1 from tables_ t where t.document_id = b.document_id and t.page_number = b.page_number and (b.x0 + b.x1) / 2 between t.x0 and t.x1 and (b.y0 + b.y1) / 2 between t.y0 and t.y1)""",
    "table_text": "select document_id, page_number, 'page | ' || page_number || chr(10) || ' | end' as text from tables_",
    "region_ids": "select document_id, page_number, region_no, printf('r%03d', region_no) as region_id, type from regions_",
    "union_regions": "select document_id, page_number, count(*) as regions, count(*) filter (type = 'TABLE') as tables, count(*) filter (type = 'FIGURE') as figures, round(sum(confidence), 4) as confidence from regions_ group by all",
    "clamp_bbox": """
select document_id, page_number, ord, round(a, 2) as x0, round(b, 2) as y0, round(greatest(a, least(x1 + 80.456, 612.0)), 2) as x1, round(greatest(b, least(y1 + 30.789, 792.0)), 2) as y1
from (select *, greatest(0.0, least(x0 - 80.123, 612.0)) as a, greatest(0.0, least(y0 - 35.777, 792.0)) as b from blocks_)""",
    "normalize_regions": """
select document_id, page_number, region_id, document_id as prov_document, page_number as prov_page, printf('%.2f;%.2f;%.2f;%.2f', x0, y0, x1, y1) as prov_bbox, 'pdfplumber' as prov_source, confidence as prov_confidence from ordered_""",
    "reading_order": "select document_id, page_number, region_id, reading_order from ordered_",
    "union_zones": """
select document_id, case when type in ('HEADER', 'PAGE_NUMBER') and y0 < 118.8 then 'header' when type in ('FOOTER', 'PAGE_NUMBER') and y1 > 673.2 then 'footer' else 'body' end as zone, count(*) as regions, min(reading_order) as first_order, max(reading_order) as last_order
from ordered_ group by all""",
    "debug_overlay": """
select distinct document_id, unnest(list_concat(list_filter(ps, lambda p: p in (1, 50, 100, 200, 500)), [ps[1], ps[len(ps) // 2 + 1], ps[len(ps)]])) as page_number
from (select document_id, list(distinct page_number order by page_number) as ps from dpages_ group by 1)""",
    "debug_label": """
select document_id, page_number, region_id, printf('#%d [%s] (%.2f)', reading_order, type, confidence) as label,
  case type when 'HEADING' then '0,0,200' when 'SUBHEADING' then '0,100,200' when 'BODY' then '200,0,0' when 'CAPTION' then '0,180,180' when 'TABLE' then '0,150,0' when 'HEADER' then '150,150,150' when 'FOOTER' then '150,150,150' when 'PAGE_NUMBER' then '120,120,120' when 'FIGURE' then '150,0,150' else '0,120,255' end as colour
from ordered_""",
    "explode_lines": "select * from lines_",
    "long_line_filter": "select doc_id, k, length(line) as length from lines_ where length(line) <= 120",
    "chapter_match_explicit": "select document_id, page_number, reading_order, number, title, confidence from explicit_",
    "chapter_match_numbered": f"""
select document_id, page_number, reading_order, cast(regexp_extract(line, {_q(NUMBERED)}, 1) as bigint) as number, trim(regexp_extract(line, {_q(NUMBERED)}, 2)) as title
from (select document_id, page_number, kk as reading_order, (doc_id % 120) || ' ' || line as line from plines_)
where regexp_matches(line, {_q(NUMBERED)}) and not starts_with(lower(line), 'section') and try_cast(regexp_extract(line, {_q(NUMBERED)}, 1) as bigint) between 1 and 99""",
    "roman_to_int": f"select doc_id, numeral, cast({_roman('numeral')} as bigint) as value from (select doc_id, ['MCMXCIV', 'xiv', 'IIX', '12', 'mix', 'abc', 'LXXXIX', 'd'][doc_id % 8 + 1] as numeral from documents)",
    "first_match_per_page": "select document_id, page_number, reading_order, number, detection_method from cands_",
    "dedup_pages": "select document_id, count(*) as candidates, count(distinct page_number) as pages from cands_ group by 1",
    "chapter_ranges": "select * from chapters_",
    "join_source_pages": "select document_id, chapter_id, count(*) as n_pages, string_agg(document_id || printf('_p%04d', page_number), ',' order by page_number) as source_pages from pch_ group by all",
    "join_chapter_pages": "select document_id, page_number, chapter_id, n_chapters from pch_",
    "section_match": "select document_id, page_number, chapter_id, reading_order, title from seccand_",
    "section_ranges": "select * from sections_",
    "join_active_section": "select * from active_",
    "distinct_titles": "select distinct document_id, title from sections_",
    "exclude_furniture": "select document_id, type, count(*) as regions from ordered_ where type not in ('HEADER', 'FOOTER', 'PAGE_NUMBER') group by all",
    "chunk_units": "select document_id, page_number, chapter_id, region_id, unit_no, chunk_no, carried from assigned_",
    "chunk_agg": "select document_id, chapter_id, chunk_id, section_id, page_start, page_end, token_count, source_regions, md5(text) as text_md5 from chunks_",
    "join_chunk_chapter": "select * from mis_",
    "join_chapter_chunks": "select * from content_",
    "anti_orphan_chunks": "select * from orphans_",
    "join_section_chapter": "select * from bounds_",
    "heading_counts": "select * from headn_",
    "duplicate_ids": "select document_id, section_id, count(*) as n from sections_x group by all having count(*) > 1",
    "number_gaps": "select * from gaps_",
    "repeated_headings": "select * from heads_",
    "audit_heading_hierarchy": "select * from vheading_",
    "audit_chapter_numbering": "select * from vchapter_",
    "audit_section_numbering": "select * from vsection_",
    "audit_parent_child": "select * from vparent_",
    "audit_page_boundaries": "select * from vbound_",
    "audit_reading_order": "select * from vread_",
    "audit_duplicate_headings": "select * from vdup_",
    "audit_empty_chapters": "select * from vempty_",
    "audit_cross_boundary": "select * from vcross_",
    "audit_chunk_alignment": "select * from valign_",
    "audit_metrics": "select * from metrics_",
    "audit_recommendations": "select * from recs_",
    "audit_messages": "select * from msgs_",
    "sink_audit": """
select d.document_id, concat_ws(chr(10), '# Structural Validation Report — ' || d.document_id, '', '## Structural Summary', printf('- **Parent-Child Integrity**: %.2f', round(p.score, 2)),
  printf('- **Page Boundary Integrity**: %.2f', round(b.score, 2)), printf('- **Reading Order Score**: %.2f', round(r.score, 2)), printf('- **Chunk Alignment Score**: %.2f', round(a.score, 2)),
  '', '## Heading Hierarchy', '- Headings: ' || h.heading_count, '- Subheadings: ' || h.subheading_count, '', '## Chapter Numbering', '- Scheme: `' || c.scheme || '`', '- Numbered Chapters: ' || coalesce(c.total_numbered_chapters, 0),
  '', '## Section Numbering', '- Total Sections: ' || coalesce(s.total_sections, 0), '- Duplicate Section IDs: ' || coalesce(s.duplicate_sections, 0),
  '', '## Parent-Child Relationships', '- Orphan Chunks: ' || p.orphan_chunks, '- Invalid Parent References: ' || p.invalid_parent_refs, '', '## Page Boundaries', '- Total Boundary Violations: ' || b.boundary_violations,
  '', '## Reading Order', '- Non-monotonic Pages: ' || r.non_monotonic_pages, '', '## Duplicate Headings', '- Likely Duplicate Errors: ' || u.likely_duplicate_errors,
  '', '## Empty / Near-Empty Chapters', '- Empty Chapters: ' || e.empty_chapter_count, '', '## Cross-Boundary Sections', '- Total Checked: ' || x.checked, '', '## Chunk Alignment', '- Total Chunks: ' || a.total_chunks, '- Misaligned Chunks: ' || a.misaligned_chunks,
  '', '## Detected Issues', coalesce(i.said, '- No structural issues detected.'), '', '## Recommendations', q.said, '') as markdown
from docs_ d join vheading_ h using (document_id) join vchapter_ c using (document_id) join vsection_ s using (document_id) join vparent_ p using (document_id) join vbound_ b using (document_id)
join vread_ r using (document_id) join vdup_ u using (document_id) join vempty_ e using (document_id) join vcross_ x using (document_id) join valign_ a using (document_id)
left join (select document_id, string_agg('- **[' || severity || ']** ' || message, chr(10) order by category_no, position, severity, message) as said from msgs_ group by 1) i using (document_id)
join (select document_id, string_agg('- ' || recommendation, chr(10) order by position) as said from recs_ group by 1) q using (document_id)""",
    "sink_audit_json": """
select document_id, 'structural_validation.json' as name, round(duplicate_heading_rate, 4)::double as value from metrics_
union all select document_id, 'chapter_audit.json', empty_chapter_count from vempty_
union all select document_id, 'section_audit.json', invalid from vcross_
union all select document_id, 'chunk_audit.json', misaligned_chunks from valign_
union all select document_id, 'reading_order_audit.json', non_monotonic_pages from vread_""",
    "corpus_wer": """
select count(*) as samples, round(sum(levenshtein(array_to_string(list_transform(r, lambda x: chr(cast(list_position(v, x) as int))), ''), array_to_string(list_transform(h, lambda x: chr(cast(list_position(v, x) as int))), ''))) / sum(len(r)), 5)::double as wer
from (select r, h, list_distinct(list_concat(r, h)) as v from (select regexp_split_to_array(trim(ref), '\\s+') as r, regexp_split_to_array(trim(hyp), '\\s+') as h from ocr_))""",
    "audit_issues": """
select document_id, 1::bigint as category_no, 'WARNING' as severity, 'heading_hierarchy' as category, chapters_detected as n from vheading_ where score < 1
union all select document_id, 2, 'WARNING', 'chapter_numbering', duplicate_numbers from vchapter_ where duplicate_numbers > 0
union all select document_id, 2, 'INFO', 'chapter_numbering', gaps from vchapter_ where gaps > 0
union all select document_id, 3, 'WARNING', 'section_numbering', duplicate_sections from vsection_ where duplicate_sections > 0
union all select document_id, 3, 'INFO', 'section_numbering', unrelated_prefix_count from vsection_ where unrelated_prefix_count > 0
union all select document_id, 4, 'WARNING', 'parent_child_integrity', orphan_chunks from vparent_ where orphan_chunks > 0
union all select document_id, 4, 'ERROR', 'parent_child_integrity', invalid_parent_refs from vparent_ where invalid_parent_refs > 0
union all select document_id, 5, 'ERROR', 'page_boundary', chapter_no from chapters_x join span_ using (document_id) where page_start < 1 or page_end > last_page or page_start > page_end
union all select document_id, 6, 'INFO', 'reading_order', duplicate_order_pages from vread_ where duplicate_order_pages > 0
union all select document_id, 9, 'ERROR', 'cross_boundary_section', 1 from bounds_ where status = 'INVALID'""",
    "top3_examples": """
select document_id, string_agg(chapter_id || ':' || page_start || ':' || section_id, ',' order by r) as examples
from (select *, row_number() over (partition by document_id order by chapter_id, page_start, section_id) as r from bounds_ where status <> 'VALID') where r <= 3 group by 1""",
    "manifest_agg": """
select document_id, page_count, processed_pages, 0::bigint as failed_pages, coalesce(c, 0) as chapters, coalesce(s, 0) as sections, coalesce(k, 0) as chunks, pages
from (select document_id, max(page_number) as page_count, count(*) as processed_pages, string_agg(printf('pages/%04d.json', page_number), ',' order by page_number) as pages from dpages_ group by 1)
left join (select document_id, count(*) as c from chapters_ group by 1) using (document_id) left join (select document_id, count(*) as s from sections_ group by 1) using (document_id) left join (select document_id, count(*) as k from chunks_ group by 1) using (document_id)""",
    "anti_cached_pages": "select document_id, page_number from dpages_ where page_number % 3 <> 1",
    "running_progress": "select document_id, page_number, row_number() over w as done, count(*) over (partition by document_id) as total, round(row_number() over w / count(*) over (partition by document_id) * 100, 1) as progress from dpages_ window w as (partition by document_id order by page_number)",
    "latest_job_state": "select * from state_",
    "status_progress": "select document_id, round(pages_processed / 50 * 100, 2)::double as progress, 0.0::double as no_total from state_",
    "join_status_fallback": """
select document_id, case when n % 5 in (0, 1) then status when n % 5 < 4 then case when pages_processed % 2 = 0 then 'completed' else 'completed_with_errors' end else 'not_found' end as status,
  case n % 5 when 0 then 'job' when 1 then 'memory' when 4 then 'none' else 'manifest' end as found_in from (select *, cast(document_id as bigint) as n from state_)""",
    "performance_agg": """
select cast(user_id as varchar) as document_id, event_type as stage, sum(cast(round(value, 2) as decimal(18, 2)))::double as total_ms, round((sum(cast(round(value, 2) as decimal(18, 2))) / greatest(1, max(user_id % 30)))::decimal(30, 10), 2)::double as average_page_ms from events group by all""",
    "sink_toon": """
select document_id, 'TOON_V1' as format, document_id || '.pdf' as filename, page_count, coalesce(k, 0) as chunks_count, title as first_chapter, text as first_text
from (select document_id, max(page_number) as page_count from dpages_ group by 1) left join (select document_id, count(*) as k from chunks_ group by 1) using (document_id)
left join (select document_id, title from chapters_ where chapter_no = 1) using (document_id) left join (select document_id, text from ordered_ where page_number = 1 and reading_order = 1) using (document_id)""",
    "toon_validate": """
select document_id, not (substr(document_id, 5, 1) < '8') as valid, p as pages, coalesce(c, 0) as chapters, coalesce(s, 0) as sections, coalesce(k, 0) as chunks
from (select document_id, max(page_number) as p from dpages_ group by 1)
left join (select document_id, count(*) as c from chapters_ group by 1) using (document_id) left join (select document_id, count(*) as s from sections_ group by 1) using (document_id) left join (select document_id, count(*) as k from chunks_ group by 1) using (document_id)""",
    "corpus_cer": "select count(*) as samples, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 5)::double as cer from ocr_",
    "zip_predictions": "select path, levenshtein(ref, hyp) as edits, length(ref) as ref_length from ocr_ where cast(substr(path, 6) as bigint) % 7 <> 0",
    "ctc_collapse": f"""
select sample, coalesce(string_agg(coalesce([{', '.join(_q(v) for v in VOCABULARY)}][idx + 1], ''), '' order by t) filter (keep), '') as text, coalesce(string_agg(cast(idx as varchar), ',' order by t) filter (keep), '') as tokens,
  round(coalesce(round(avg(p) filter (keep), 4), 0.0), 3) as confidence from ctck_ group by 1""",
    "mean_confidence": "select document_id, page_number, coalesce(round(avg((ord % 100) / 100.0::double) filter (ord >= 0), 4), 0.9) as confidence from blocks_ group by all",
    "vocab_encode": f"""
select item_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, ''), lambda c: list_position([{', '.join(_q(v) for v in VOCABULARY)}], c) - 1), lambda i: i >= 0), ','), '') as codes from benchmark""",
    "training_history": """
select run, epoch, loss, cer, wer, min(cer) over (partition by run order by epoch) as best_cer, coalesce(cer < min(cer) over p, true) as is_best, coalesce(min(cer) over p <= 0.05, false) as stopped
from epochs_ window p as (partition by run order by epoch rows between unbounded preceding and 1 preceding)""",
    "sink_checkpoint": "select run, epoch, cer, wer from (select *, row_number() over (partition by run order by cer, epoch) as r from epochs_) where r = 1",
    "limit_samples": "select * from ocr_ order by path limit 20",
    "sort_keys": "select source || '/' || lpad(cast(doc_id as varchar), 8, '0') as key from documents order by key",
    "sort_pages": "select document_id, page_number, row_number() over (partition by document_id order by page_number) as position from dpages_",
    "sort_words": "select document_id, page_number, word_ordinal, r as position from wordseq_",
    "scan_vocab": f"select generate_subscripts(v, 1) - 1 as idx, unnest(v) as token from (select [{', '.join(_q(v) for v in VOCABULARY)}] as v)",
    "valid_bbox": "select document_id, page_number, ord, round(greatest(0.0, x0 - 100), 2) as x0, round(greatest(0.0, y0 - 50.5551), 2) as y0, round(greatest(greatest(0.0, x0 - 100), greatest(0.0, x1 - 300)), 2) as x1, round(greatest(greatest(0.0, y0 - 50.5551), y1), 2) as y1 from blocks_",
    "batch_width": """
select batch, cast(ceil(max(w) / 4.0) * 4 as bigint) as width
from (select doc_id // 8 as batch, ceil(greatest(32, least(1024, cast(round_even(32.0::double * case when doc_id % 50 > 0 then n_chars::double / (doc_id % 50) else 1.0 end, 0) as bigint))) / 4.0) * 4 as w from documents) group by 1""",
    "sink_pages": "select document_id, page_number, document_id || printf('_p%04d', page_number) as page_id, count(*) as regions, arg_min(text, reading_order) as first_text from ordered_ group by all",
    "scan_pages_json": "select document_id, page_number, region_id, type, reading_order from ordered_",
    "sink_chapters": "select document_id, chapter_id, title, page_start, page_end from chapters_",
    "sink_chunks_jsonl": "select document_id, chapter_id, chunk_id, token_count, md5(text) as text_md5 from chunks_",
    "sink_errors": "select document_id, event_id, 'ocr' as stage from jobs_ where status = 'failed'",
    "list_keys": "select distinct source from documents",
    "html_regions": r"""
select page_id, case lower(tag) when 'h1' then 'HEADING' when 'p' then 'BODY' when 'footer' then 'FOOTER' else 'HEADER' end as type, count(*) as regions, cast(sum(length(body)) as bigint) as chars
from (select page_id, unnest(regexp_extract_all(html, '(?is)<(h1|p|li|footer)[^>]*>(.*?)</', 1)) as tag, unnest(regexp_extract_all(html, '(?is)<(h1|p|li|footer)[^>]*>(.*?)</', 2)) as body from pages) group by all""",
}


def _stripping(s: str) -> str:
    """s with every trim taking all white space of Unicode."""
    out, at = "", 0
    for m in re.finditer(r"\btrim\(", s):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(s[i], 0)
            i += 1
        out += s[at : m.start()]
        inner = _stripping(s[m.end() : i - 1])
        if m.start() >= at:
            out += f"trim({inner}, '{SPACES}')"
            at = i
    return out + s[at:]


def sql(body: str) -> str:
    """body with the steps that it names, in order."""
    need: list[str] = []

    def visit(s: str) -> None:
        for name in re.findall(r"\b\w+_x?\b", s):
            if name in STEPS and name not in need:
                need.append(name)
                visit(STEPS[name])

    visit(body)
    order = [n for n in _sorted(need)]
    return ("with recursive " + ",\n".join(f"{n} as ({STEPS[n].strip()})" for n in order) + "\n" if order else "") + body.strip()


def _sorted(need: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str, path: tuple[str, ...] = ()) -> None:
        if name in out or name in path:
            return
        for other in re.findall(r"\b\w+_x?\b", STEPS[name]):
            if other in STEPS and other != name:
                add(other, (*path, name))
        out.append(name)

    for n in need:
        add(n)
    return out


MAIN["sink_json_entity"] = MAIN["profile_document"]

ORACLES = {k: _stripping(sql(v)) for k, v in MAIN.items()}
