"""Independent DuckDB SQL for every registered query.

The SQL is written by hand against the pre-registered driver views and shares
neither code nor values with the Spark operators.  Each query is a ``WITH`` chain: the fixture tables are
derived from ``documents`` / ``labels`` exactly as in ``pagewise.sources.
fixtures`` and every operator is re-expressed in SQL.
"""

from __future__ import annotations

import string

# White space as code points and as the body of a character
# class, month names and bullets of the rules.
PY_WHITESPACE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}-\x{2029}\x{202f}\x{205f}\x{3000}"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
BULLETS = "•\\-\\*\\+◦◆◇○●■□▪▫"

P = string.punctuation.replace("'", "''")
WSCHARS = "||".join(f"chr({c})" for c in PY_WHITESPACE)
NWS = f"[^{WS}]"
SWS = f"[{WS}]"
D = r"\p{Nd}"


def strip(x: str) -> str:
    return f"trim({x}, {WSCHARS})"


def num_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NWS}+'))"


def font_weight(x: str) -> str:
    n = f"lower(coalesce({x}, ''))"
    return (f"(case when contains({n}, 'black') or contains({n}, 'heavy') then 2 "
            f"when contains({n}, 'bold') then 1 else 0 end)")


def is_upper(x: str) -> str:
    return f"(regexp_matches({x}, '\\p{{Lu}}') and not regexp_matches({x}, '[\\p{{Ll}}\\p{{Lt}}]'))"


def numbering_depth(x: str) -> str:
    m = f"regexp_extract({x}, '^{D}+(?:\\.{D}+)*', 0)"
    return f"(case when {m} = '' then 0 else len(string_split({m}, '.')) end)"


def percent_punct(x: str) -> str:
    return (f"(case when length({x}) > 0 then cast(length({x}) - length(translate({x}, '{P}', '')) as double)"
            f" / length({x}) else 0.0 end)")


def ieee_div(a: str, b: str) -> str:
    return (f"(case when {b} <> 0 then cast({a} as double) / {b} when {a} is null or {b} is null then null "
            f"when isnan({a}) or {a} = 0 then 'nan'::double when {a} > 0 then 'inf'::double else '-inf'::double end)")


# ---------------------------------------------------------------- fixtures
CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTE[name] = (sql, deps)


cte("lines", (), """select doc_id, i-1 as line_no, l as raw from (select doc_id, unnest(string_split(text,chr(10))) as l,
 generate_subscripts(string_split(text,chr(10)),1) as i from documents)""")

def other_words(n: int) -> str:
    return f"regexp_replace(raw, '^([^ ]+ ){{0,{n}}}[^ ]+ ?', '')"


cte("layout", ("lines",), f"""select doc_id, page_num, cast(src*2 + k as int) as line_no, text, cast(x0 as double) as x0, cast(y0 as double) as y0,
 cast(width as double) as width, cast(height as double) as height, cast(size as double) as size, font,
 cast(612 as double) as page_width, cast(792 as double) as page_height, cast(kind as int) as kind, src from (
select doc_id, src, 0 as k, cast(1+floor(src/12) as int) as page_num,
 case when src%12=0 then 'Running Header ' || cast(doc_id as string)
      when kind=0 then upper(replace(regexp_extract(raw,'^([^ ]+ ){{0,2}}[^ ]+',0),'ß','s'))
      when kind=1 then cast(cast(1+floor(src/12) as int) as string) || '.' || cast(src%12 as string) || ' ' || regexp_extract(raw,'^([^ ]+ ){{0,3}}[^ ]+',0)
      when kind=2 and src%3=0 then regexp_extract(raw,'^([^ ]+ ){{0,8}}[^ ]+',0)
      when kind=2 then regexp_extract(raw,'^([^ ]+ ){{0,4}}[^ ]+',0)
      when kind=3 then case doc_id%12
        when 0 then '- ' || regexp_extract(raw,'^([^ ]+ ){{0,2}}[^ ]+',0)
        when 1 then '12/05/2024 release'  when 2 then 'Page ' || cast(src as string)
        when 3 then '10  20  30 40'       when 4 then '第１章　概要'
        when 5 then '***---!!!'           when 6 then '42'
        when 7 then 'ab'                  when 8 then 'March 5, 2024 report'
        when 9 then 'Item  10  20  30'    when 10 then 'VERSION 2.1'
        else 'Document version' end
      else raw end as text,
 50 + case when kind=0 then 150 else (src%3)*5 end as x0, case when src%12=0 then 20 else 40 + (src%12)*60 end as y0,
 case when kind in (0,1,2,3) then 250 else 500 end as width, case when kind in (4,5) then 58 else 20 end as height,
 cast(case when kind=0 then 18 when kind=1 then 14+(src%4)*0.8 when kind=2 then 12+(src%7)*0.4 when kind=3 then 12 when kind=9 then 11.5
      else 10+(doc_id%3)*0.5 end as double) as size,
 case when src%12=0 then 'Helvetica' when kind=0 then 'Arial-Black' when kind in (1,3) then 'Arial-BoldMT' else 'Times-Roman' end as font, kind
from (select *, line_no as src, (doc_id*7+line_no*13)%10 as kind from lines) z
union all
select doc_id, src, 1, cast(1+floor(src/12) as int), rest, 50 + (src%3)*5, case when src%12=0 then 85 else 65 + (src%12)*60 end,
 500, case when src%12=0 then 12 else 20 end, cast(10+(doc_id%3)*0.5 as double), 'Times-Roman', 6
from (select *, case when src%12=0 then raw when kind=0 then {other_words(2)} when kind=1 then {other_words(3)}
   when kind=2 and src%3=0 then {other_words(8)} when kind=2 then {other_words(4)}
   when kind=3 and doc_id%12=0 then {other_words(2)} when kind=3 then raw else '' end as rest
 from (select *, line_no as src, (doc_id*7+line_no*13)%10 as kind from lines) y) z where rest <> '') u""")

cte("layout_lines", ("layout",), """select doc_id, page_num, line_no, text, x0, y0, x0+width as x1, y0+height as y1,
 size, font, page_width, page_height from layout""")

cte("images1", ("layout",), """select distinct doc_id*1000+page_num as image_id, 'PNG/p' || cast(doc_id as string) || '_' || cast(page_num as string) || '.png' as file_name,
 'doc_' || cast(doc_id as string) as doc_name, page_num as page_no,
 case when page_num%5=0 then null else page_width end as coco_width, case when page_num%5=0 then null else page_height end as coco_height from layout""")

cte("images", ("images1",), """select * from images1 union all select image_id + 500, replace(file_name, 'PNG/p', 'PNG/n'), doc_name,
 page_no + 500, coco_width, coco_height from images1 where page_no%7=0""")

cte("cells", ("layout",), """select stem || cast(doc_id as string) || '_' || cast(page_num as string) as page_key, line_no as cell_no, ' ' || text || ' ' as text,
 x0 as x, y0 as y, width as w, height as h, size as font_size, font as font_name from layout
 join (values ('p'), ('q')) s(stem) on stem = 'p' or page_num%7=0""")

cte("annotations", ("layout",), """select image_id, line_no*2+k as ann_id, category_id, cast(x as double) as x, cast(y as double) as y,
 cast(w as double) as w, cast(h as double) as h from (
 select doc_id*1000+page_num as image_id, line_no, 0 as k,
  case when kind=0 then 11 when kind in (1,2) then 8 when kind=3 and doc_id%24<12 then 9 else 10 end as category_id,
  x0-5 + case when kind=9 and src%2=0 then 700 else 0 end as x, y0-5 as y, width+10 as w, height+10 as h from layout
 union all select doc_id*1000+page_num, line_no, 1, 10, x0-5, y0-5, width+10, height+10 from layout where kind=1 and src%2=0) u""")

cte("categories", (), """select * from (values (8,'Section-header'),(9,'Table'),(10,'Text'),(11,'Title')) t(category_id,name)""")

cte("scored", (), """select doc_id, quality as label, cast(least(999, quality*250 + (doc_id*7919)%700) as int) as score_milli from labels""")

cte("expected_outline", ("layout",), """select doc_id, line_no as seq, 'H' || cast(kind+1 as string) as level, text || ' ' as text, page_num-1 as page
 from layout where kind in (0,1,2) and src%12<>0 and doc_id%10<>0""")

cte("actual_outline", ("layout",), """select doc_id, line_no as seq, 'H' || cast(case when src%3=0 then 4 else kind+1 end as string) as level, text, page_num as page
 from layout where kind in (0,1,2,3) and src%12<>0 and src%5<>0 and doc_id%17<>3""")

cte("layout_words", ("layout",), """select * exclude (i, w), i-1 as span_no, w as word from (select l.*, unnest(string_split(text,' ')) as w,
 generate_subscripts(string_split(text,' '),1) as i from layout l)""")

cte("spans", ("layout_words",), """select doc_id, page_num, line_no, cast(no as int) as span_no, t as text,
 size + cast(case when span_no%2=1 then 0.2 else 0 end as double) as size, case when span_no%5=4 then 'Times-Bold' else font end as font,
 x0, y0, x0+width as x1, y0+height as y1, page_width, page_height, bt as block_type
from (select *, span_no*2 as no, word || ' ' as t, 0 as bt from layout_words
 union all select *, span_no*2+1, ' ', 0 from layout_words where span_no%6=5
 union all select *, -1, '[image]', 1 from layout_words where doc_id%50=49 and src%4=3 and span_no=0) w""")

# ------------------------------------------------------- blocks & features
cte("line_starts", ("layout_lines",), f"""select *, case
   when lag(y1) over w is null then 1
   when not isnan(size) and not isnan(lag(size) over w) and not isnan(y0) and not isnan(lag(y1) over w)
    and y0 - lag(y1) over w < (lag(size) over w) * 0.5 and abs(size - lag(size) over w) < 1
    and {font_weight('font')} = lag({font_weight('font')}) over w then 0 else 1 end as st
 from layout_lines window w as (partition by doc_id, page_num order by y0, line_no)""")

cte("grouped_lines", ("line_starts",), """select * exclude (st), cast(sum(st) over (partition by doc_id, page_num order by y0, line_no
 rows between unbounded preceding and current row) as int) as block_no from line_starts""")

cte("blocks", ("grouped_lines",), """select doc_id, page_num, block_no, string_agg(text, ' ' order by y0, line_no) as text,
 min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, first(size order by y0, line_no) as font_size,
 first(font order by y0, line_no) as font_name, max(page_width) as page_width, max(page_height) as page_height,
 cast(count(*) as int) as n_lines from grouped_lines group by doc_id, page_num, block_no""")

cte("block_feats0", ("blocks",), f"""select *, {font_weight('font_name')} as font_weight,
 {ieee_div('x0', 'page_width')} as norm_x, {ieee_div('y0', 'page_height')} as norm_y,
 cast(length(text) as int) as text_length, cast({num_words('text')} as int) as num_words,
 case when {is_upper('text')} and length({strip('text')}) > 1 then 1 else 0 end as is_all_caps,
 case when abs(x0 + (x1 - x0) / 2.0 - page_width / 2.0) < page_width * 0.15 then 1 else 0 end as is_centered,
 cast({numbering_depth(strip('text'))} as int) as numbering_depth,
 {percent_punct('text')} as percent_punct from blocks""")

cte("body_infer", ("block_feats0",), """select doc_id, font_size as body_font_size from (
 select doc_id, font_size, row_number() over (partition by doc_id order by count(*) desc, font_size) as rn
 from block_feats0 where num_words > 6 group by doc_id, font_size) where rn = 1""")

cte("block_feats", ("block_feats0", "body_infer"), f"""select f.*, coalesce(b.body_font_size, 10.0) as body_font_size,
 {ieee_div('f.font_size', 'coalesce(b.body_font_size, 10.0)')} as relative_font_size
 from block_feats0 f left join body_infer b using (doc_id)""")

cte("running_headers", ("block_feats",), """select doc_id, text, count(distinct page_num) as n_pages from block_feats
 where norm_y < 0.1 or norm_y > 0.9 group by doc_id, text having count(distinct page_num) > 3""")

cte("fixed_scored", ("block_feats",), """select *, 4.0 * (relative_font_size - 1.1137) + font_weight * 1.0 + is_all_caps * 0.5
 + least(numbering_depth, 1) * 0.3 - num_words * 0.05 as score from block_feats""")

RULES = (f"""percent_punct < 0.4
 and not regexp_matches(text, '(?i)^(?:{D}{{1,2}}[/\\-]{D}{{1,2}}[/\\-]{D}{{2,4}}|(?:{MONTHS})[a-z]*{SWS}+{D}{{1,2}},?{SWS}+{D}{{4}})')
 and not regexp_matches(text, '(?i)^(?:page{SWS}*{D}+|{D}+{SWS}+{D}+{SWS}+{D}+{SWS}+{D}+\\n?\\z|version|copyright)')
 and not regexp_matches(text, '^{D}+(?:{SWS}+{D}+)+\\n?\\z')
 and not regexp_matches(text, '^[{BULLETS}]{SWS}+')
 and not regexp_matches(text, '^[A-Za-z]{{1,2}}\\z')
 and not (regexp_matches(text, '{NWS} {{2,}}{NWS}') and len(regexp_extract_all(text, '{D}+')) > 2)
 and num_words <= 15""")

cte("heading_cands", ("fixed_scored", "running_headers"), f"""select s.* from fixed_scored s
 where score > 0 and not exists (select 1 from running_headers r where r.doc_id = s.doc_id and r.text = s.text)
 and {RULES}""")

cte("ordered_headings", ("heading_cands",), """select *, cast(row_number() over (partition by doc_id order by page_num, norm_y, block_no) as int) as seq
 from heading_cands""")

_SIB = "(not isnan(c) and not isnan(stack[{i}].s) and abs(c - stack[{i}].s) <= 0.05)"
_CHILD = "(not isnan(c) and not isnan(stack[{i}].s) and c < stack[{i}].s - 0.05)"


def fold_cte(src: str, name: str, rel: str = "relative_font_size") -> None:
    """Recursive stack fold over (doc_id, seq) of ``src``."""
    k = ("list_max(list_transform(range(1, len(stack) + 1), lambda i: case when "
         + _SIB.format(i="i") + " or " + _CHILD.format(i="i") + " then i else 0 end))")
    use_child = (f"(case when k = len(stack) then {_CHILD.format(i='k')} else not {_SIB.format(i='k')} end)")
    cte(name, (src,), f"""select doc_id, seq, stack, lv from (
  select doc_id, seq, [{{'l': 1, 's': {rel}}}] as stack, 1 as lv from {src} where seq = 1)
 union all
 select doc_id, seq,
  case when k = 0 then [{{'l': 1, 's': c}}]
       when uc then list_concat(stack[1:k], [{{'l': lv2, 's': c}}])
       else list_concat(stack[1:k-1], [{{'l': lv2, 's': c}}]) end as stack,
  lv2 as lv from (
   select *, case when k = 0 then 1 when uc then least(stack[k].l + 1, 6) else stack[k].l end as lv2 from (
    select *, case when k = 0 then false else {use_child} end as uc from (
     select *, {k} as k from (
      select h.doc_id, h.seq, h.{rel} as c, f.stack from {name} f join {src} h on h.doc_id = f.doc_id and h.seq = f.seq + 1))))""")
    CTE[name] = (CTE[name][0], CTE[name][1], True)  # recursive marker


fold_cte("ordered_headings", "heading_fold")

cte("leveled_headings", ("ordered_headings", "heading_fold"), """select h.*, cast(f.lv as int) as level_num, 'H' || cast(f.lv as string) as level
 from ordered_headings h join heading_fold f using (doc_id, seq)""")

cte("titles", ("leveled_headings",), f"""select doc_id, title from (select doc_id, {strip('text')} as title,
 row_number() over (partition by doc_id order by (level_num = 1) desc,
   case when isnan(relative_font_size - norm_y) then '-inf'::double else relative_font_size - norm_y end desc, seq) as rn
 from leveled_headings where page_num = 1) where rn = 1""")

cte("outline_flat", ("block_feats", "titles", "leveled_headings"), f"""select d.doc_id, coalesce(t.title, '') as title, e.seq, e.level, e.text, e.page
 from (select distinct doc_id from block_feats) d
 left join titles t using (doc_id)
 left join (select doc_id, seq, level, {strip('text')} as text, cast(page_num as int) as page from leveled_headings) e using (doc_id)""")


def build(final: str, deps: tuple[str, ...]) -> str:
    """Assemble ``WITH [RECURSIVE] ... final`` with the CTEs ``deps`` need,
    in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][1]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    recursive = any(len(CTE[n]) > 2 for n in order)
    body = ",\n".join(f"{n} AS (\n{CTE[n][0]}\n)" for n in order)
    stripped = final.lstrip()
    if stripped.lower().startswith("with "):
        # the final query brings its own CTEs: append them to the chain
        if not order:
            return stripped
        return f"WITH {'RECURSIVE ' if recursive else ''}{body},\n{stripped[5:]}"
    if not order:
        return final
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{final}"


QUERIES: dict[str, str] = {}


def q(name: str, deps: tuple[str, ...], final: str) -> None:
    QUERIES[name] = build(final, deps)


q("extract_outlines", ("outline_flat",), "select * from outline_flat")

# ---------------------------------------------------------- inference parts
cte("span_fonts", ("spans",), """select doc_id, page_num, line_no, font from (
 select doc_id, page_num, line_no, font, row_number() over (partition by doc_id, page_num, line_no order by count(*) desc, font) as rn
 from spans where block_type = 0 group by doc_id, page_num, line_no, font) where rn = 1""")

q("spans_to_lines", ("spans", "span_fonts"), f"""select * from (
 select s.doc_id, s.page_num, s.line_no,
  coalesce(string_agg({strip('s.text')}, ' ' order by s.span_no) filter (where {strip('s.text')} <> ''), '') as text,
  min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, round(avg(size), 9) as size, any_value(f.font) as font,
  max(page_width) as page_width, max(page_height) as page_height
 from spans s join span_fonts f using (doc_id, page_num, line_no) where s.block_type = 0
 group by s.doc_id, s.page_num, s.line_no) where length(text) > 0""")

q("group_lines", ("grouped_lines",), "select doc_id, page_num, line_no, block_no from grouped_lines")
q("lines_to_blocks", ("blocks",), "select * from blocks")
q("text_features", ("block_feats0",), """select doc_id, page_num, block_no, font_weight, norm_x, norm_y, text_length,
 num_words, is_all_caps, is_centered, numbering_depth, percent_punct from block_feats0""")
q("body_font_size_infer", ("body_infer",), "select * from body_infer")
q("relative_font_size", ("block_feats",), "select doc_id, page_num, block_no, body_font_size, relative_font_size from block_feats")
FEATS = ("font_size, font_weight, norm_x, norm_y, text_length, num_words, is_all_caps, is_centered, numbering_depth, "
         "relative_font_size, percent_punct")
q("block_features", ("block_feats",), f"select doc_id, page_num, block_no, text, {FEATS} from block_feats")
q("select_features", ("block_feats",), f"select {FEATS} from block_feats")
q("coerce_numeric", ("spans",), """select doc_id, line_no, span_no, coalesce(case when isnan(v) then 0.0 else v end, 0.0) as value
 from (select doc_id, line_no, span_no, try_cast(trim(text) as double) as v from spans)""")
q("running_headers", ("running_headers",), "select * from running_headers")
q("drop_running_headers", ("block_feats", "running_headers"), """select doc_id, page_num, block_no from block_feats f
 where not exists (select 1 from running_headers r where r.doc_id = f.doc_id and r.text = f.text)""")
q("heading_rules", ("block_feats",), f"select doc_id, page_num, block_no, text from block_feats where {RULES}")
q("score_blocks", ("fixed_scored",), """select doc_id, page_num, block_no, round(score, 9) as score,
 case when score > 0 then 1 else 0 end as is_heading from fixed_scored""")
q("order_headings", ("ordered_headings",), "select doc_id, seq, page_num, block_no from ordered_headings")
q("outline_levels", ("leveled_headings",), "select doc_id, seq, level from leveled_headings")
q("detect_title", ("leveled_headings", "titles"), """select d.doc_id, coalesce(t.title, '') as title
 from (select distinct doc_id from leveled_headings) d left join titles t using (doc_id)""")
q("build_outline", ("outline_flat",), """select doc_id, any_value(title) as title, cast(count(seq) as int) as n_entries,
 coalesce(string_agg(level || '|' || text || '|' || cast(page as string), chr(10) order by seq), '') as outline_text
 from outline_flat group by doc_id""")
q("find_blocks", ("block_feats",), f"""select doc_id, block_no, page_num, font_size, relative_font_size, numbering_depth,
 percent_punct, is_all_caps, is_centered from block_feats where {strip('text')} = 'Document version'""")
q("block_profile", ("block_feats",), """select doc_id, count(*) as n_blocks, count(distinct text) as n_texts
 from block_feats group by doc_id""")

# ---------------------------------------------------------------- labelling
def pyround1(x: str) -> str:
    n = f"cast(abs({x}) * 144115188075855872.0 as hugeint)"
    q_ = f"(({n}) * 10 // 144115188075855872)"
    r_ = f"(({n}) * 10 % 144115188075855872)"
    up = f"(case when {r_} > 72057594037927936 or ({r_} = 72057594037927936 and {q_} % 2 = 1) then 1 else 0 end)"
    return (f"(case when {x} is null then null when isnan({x}) or isinf({x}) then {x} "
            f"when abs({x}) < 0.03125 then 0.0 "
            f"when abs({x}) < 64 then sign({x}) * cast({q_} + {up} as double) / 10.0 "
            f"else round_even({x}, 1) end)")


cte("pages_cells", ("images", "cells"), """select i.*, c.* exclude (page_key), coalesce(i.coco_width, 1025.0) as page_width,
 coalesce(i.coco_height, 1025.0) as page_height from (
  select *, regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '^(.*[^.].*)\\.[^.]*$', '\\1') as page_key from images) i
 join cells c using (page_key)""")

cte("cell_box_pairs", ("pages_cells", "annotations", "categories"), """select p.*, a.ann_id, g.name, a.x as ax, a.y as ay, a.w as aw, a.h as ah
 from pages_cells p join annotations a on a.image_id = p.image_id
 left join categories g on g.category_id = a.category_id
 where p.x + p.w / 2.0 >= a.x and p.x + p.w / 2.0 <= a.x + a.w and p.y + p.h / 2.0 >= a.y and p.y + p.h / 2.0 <= a.y + a.h""")

cte("labeled_cells", ("cell_box_pairs", "pages_cells"), """select p.*, case l.prio when 3 then 'Title' when 2 then 'Section-header' else 'Text' end as original_category,
 case when l.prio >= 2 then 1 else 0 end as is_heading from (
  select image_id, cell_no, max(case name when 'Title' then 3 when 'Section-header' then 2 when 'Text' then 1 end) as prio
  from cell_box_pairs where name in ('Title', 'Section-header', 'Text') group by image_id, cell_no) l
 join pages_cells p using (image_id, cell_no)""")


def noise_keep(x: str) -> str:
    t = strip(x)
    return (f"(length({t}) >= 3 and not regexp_matches({t}, '^{D}+\\n?\\z') "
            f"and not regexp_matches({t}, '^[^\\p{{L}}\\p{{N}}_{WS}]*\\n?\\z'))")


cte("cell_feats0", ("labeled_cells",), f"""select doc_name, page_no, original_category, is_heading,
 [cast(x as double), cast(y as double), cast(w as double), cast(h as double)] as bbox, t as text, cast(font_size as double) as font_size,
 {font_weight('font_name')} as font_weight, {ieee_div('x', 'page_width')} as norm_x, {ieee_div('y', 'page_height')} as norm_y,
 cast(length(t) as int) as text_length, cast({num_words('t')} as int) as num_words,
 case when {is_upper('t')} and length(t) > 1 then 1 else 0 end as is_all_caps,
 case when abs(x + w / 2.0 - page_width / 2.0) < page_width * 0.15 then 1 else 0 end as is_centered,
 cast({numbering_depth('t')} as int) as numbering_depth, {percent_punct('t')} as percent_punct, image_id, cell_no
 from (select *, {strip('text')} as t from labeled_cells where {noise_keep('text')})""")

cte("body_train", ("cell_feats0",), """select doc_name, font_size as body_font_size from (
 select doc_name, font_size, row_number() over (partition by doc_name order by count(*) desc, font_size) as rn
 from cell_feats0 where is_heading = 0 and num_words > 5 group by doc_name, font_size) where rn = 1""")

cte("cell_dataset", ("cell_feats0", "body_train"), f"""select f.* exclude (image_id, cell_no), coalesce(b.body_font_size, 10.0) as body_font_size,
 {ieee_div('f.font_size', 'coalesce(b.body_font_size, 10.0)')} as relative_font_size
 from cell_feats0 f left join body_train b using (doc_name)""")

cte("regions0", ("cell_box_pairs",), f"""select image_id, ann_id, any_value(name) as category, any_value(doc_name) as doc_name,
 any_value(page_no) as page_no, any_value(page_width) as page_width, any_value(page_height) as page_height,
 any_value(ax) as x, any_value(ay) as y, any_value(aw) as w, any_value(ah) as h, avg(font_size) as font_size,
 {strip(f"string_agg({strip('text')}, ' ' order by x, cell_no)")} as text, first(font_name order by x, cell_no) as first_font
 from cell_box_pairs where name in ('Title', 'Section-header') group by image_id, ann_id""")

cte("regions", ("regions0",), f"""select doc_name, page_no, category, image_id, ann_id, [x, y, w, h] as bbox, text,
 cast(font_size as double) as font_size, {font_weight('first_font')} as font_weight,
 {ieee_div('x', 'page_width')} as norm_x, {ieee_div('y', 'page_height')} as norm_y,
 cast(length(text) as int) as text_length, cast({num_words('text')} as int) as num_words,
 case when {is_upper('text')} and length(text) > 1 then 1 else 0 end as is_all_caps,
 case when abs(x + w / 2.0 - page_width / 2.0) < page_width * 0.15 then 1 else 0 end as is_centered,
 cast({numbering_depth('text')} as int) as numbering_depth, {percent_punct('text')} as percent_punct
 from regions0 where length(text) > 0""")

cte("body_heading", ("regions",), """select doc_name, font_size as body_font_size from (
 select doc_name, font_size, row_number() over (partition by doc_name order by count(*) desc, font_size) as rn
 from regions where num_words > 5 group by doc_name, font_size) where rn = 1""")

cte("heading_rel", ("regions", "body_heading"), f"""select r.*, coalesce(b.body_font_size, 10.0) as body_font_size,
 {ieee_div('r.font_size', 'coalesce(b.body_font_size, 10.0)')} as relative_font_size
 from regions r left join body_heading b using (doc_name)""")

cte("heading_levels", ("heading_rel",), f"""select *, case when category = 'Title' then 'H1'
  when lvl <= 6 then 'H' || cast(lvl as string) else 'Other-Heading' end as heading_level from (
 select *, cast(sum(chg) over (partition by doc_name order by relative_font_size desc, font_weight desc, norm_y asc, page_no, ann_id
   rows between unbounded preceding and current row) + 1 as int) as lvl from (
  select *, case when lag(font_weight) over w is null then 0
    when sr is not distinct from lag(sr) over w and font_weight = lag(font_weight) over w then 0 else 1 end as chg
  from (select *, {pyround1('relative_font_size')} as sr from heading_rel)
  window w as (partition by doc_name order by relative_font_size desc, font_weight desc, norm_y asc, page_no, ann_id)))""")

q("join_pages_cells", ("pages_cells",), "select image_id, page_key, cell_no, doc_name, page_no from pages_cells")
q("center_inside_join", ("cell_box_pairs",), "select image_id, cell_no, ann_id from cell_box_pairs")
q("label_cells", ("labeled_cells",), "select image_id, cell_no, original_category, is_heading from labeled_cells")
q("drop_noise_cells", ("cells",), f"select page_key, cell_no from cells where {noise_keep('text')}")
q("build_cell_dataset", ("cell_dataset",), "select * from cell_dataset")
q("body_font_size_train", ("body_train",), "select * from body_train")
q("class_stats", ("cell_dataset",), """select is_heading, n, cast(n as double) * 100.0 / cast(sum(n) over () as double) as pct from (
 select is_heading, count(*) as n from cell_dataset group by is_heading)""")
q("region_text", ("regions",), """select image_id, ann_id, category, text, round(font_size, 9) as font_size, font_weight,
 norm_x, norm_y, num_words from regions""")
q("body_font_size_heading", ("body_heading",), "select * from body_heading")
q("assign_heading_levels", ("heading_levels",), "select doc_name, image_id, ann_id, heading_level from heading_levels")
q("build_heading_dataset", ("heading_levels",), """select doc_name, page_no, category, text, round(font_size, 9) as font_size,
 font_weight, norm_x, norm_y, text_length, num_words, is_all_caps, is_centered, numbering_depth, percent_punct,
 round(body_font_size, 9) as body_font_size, round(relative_font_size, 9) as relative_font_size, heading_level from heading_levels""")

# --------------------------------------------------------------- evaluation
from pagewise.operators.metrics import sweep_thresholds  # noqa: E402

cte("probs", ("scored",), """select *, cast(score_milli as double) / 1000.0 as probability,
 case when cast(score_milli as double) / 1000.0 > 0.5 then 1 else 0 end as prediction from scored""")

cte("conf", ("probs",), """select count(*) filter (where label = 0 and prediction = 0) as tn,
 count(*) filter (where label = 0 and prediction = 1) as fp, count(*) filter (where label = 1 and prediction = 0) as fn,
 count(*) filter (where label = 1 and prediction = 1) as tp from probs""")

cte("ranked_scored", ("probs",), """select *, row_number() over (partition by label order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1 as class_rank,
 count(*) over (partition by label) as class_n from probs""")

cte("split_scored", ("ranked_scored",), """select *, case when class_rank < ceil(class_n * 0.2) then 'test'
 when class_rank < ceil(class_n * 0.2) + ceil((class_n - ceil(class_n * 0.2)) * 0.2) then 'val' else 'train' end as split,
 cast(ceil(class_n * 0.2) as bigint) as n_test from ranked_scored""")

cte("folds_scored", ("split_scored",), """select *, cast((class_rank - n_test) % 5 as int) as fold from split_scored where split <> 'test'""")

_TS = ", ".join(f"({i}, cast({t!r} as double))" for i, t in enumerate(sweep_thresholds()))
cte("thresholds", (), f"select * from (values {_TS}) v(i, threshold)")

cte("sweep", ("thresholds", "probs"), """select i, threshold, tp, fp, fn,
 case when 2 * tp + fp + fn > 0 then cast(2 * tp as double) / cast(2 * tp + fp + fn as double) else 0.0 end as f1 from (
 select t.i, t.threshold, count(*) filter (where p.label = 1 and p.probability > t.threshold) as tp,
  count(*) filter (where p.label = 0 and p.probability > t.threshold) as fp,
  count(*) filter (where p.label = 1 and not (p.probability > t.threshold)) as fn
 from thresholds t cross join probs p group by t.i, t.threshold)""")

q("apply_threshold", ("probs",), "select doc_id, label, prediction from probs")
q("confusion_matrix", ("conf",), """select 0 as label, 0 as prediction, tn as n from conf union all select 0, 1, fp from conf
 union all select 1, 0, fn from conf union all select 1, 1, tp from conf""")
q("binary_metrics", ("conf",), """select tp + fp + fn + tn as n,
 case when tp + fp + fn + tn > 0 then cast(tp + tn as double) / (tp + fp + fn + tn) else 0.0 end as accuracy,
 pr as precision, rc as recall, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end as f1 from (
 select *, case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0 end as pr,
  case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0 end as rc from conf)""")
q("classification_report", ("conf",), """with c as (select *, tp + fp + fn + tn as n,
  case when tn + fn > 0 then cast(tn as double) / (tn + fn) else 0.0 end as p0, case when tn + fp > 0 then cast(tn as double) / (tn + fp) else 0.0 end as r0,
  case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0 end as p1, case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0 end as r1,
  tn + fp as s0, tp + fn as s1 from conf),
 d as (select *, case when p0 + r0 > 0 then 2 * p0 * r0 / (p0 + r0) else 0.0 end as f0,
  case when p1 + r1 > 0 then 2 * p1 * r1 / (p1 + r1) else 0.0 end as f1 from c)
 select '0' as name, p0 as precision, r0 as recall, f0 as f1, s0 as support from d
 union all select '1', p1, r1, f1, s1 from d
 union all select 'accuracy', null, null, case when n > 0 then cast(tp + tn as double) / n else 0.0 end, n from d
 union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from d
 union all select 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n from d""")
q("roc_auc", ("probs",), """select round(case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (nb + 0.5 * neg)) / (cast(sum(pos) as double) * sum(neg)) end, 12) as auc from (
 select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as nb from (
  select probability as score, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg from probs group by probability))""")
q("threshold_sweep", ("sweep",), "select * from sweep")
q("best_threshold", ("sweep",), """select case when f1 > 0 then threshold else 0.5 end as threshold, greatest(f1, 0.0) as f1 from (
 select * from sweep order by f1 desc, i limit 1)""")
q("stratified_split", ("split_scored",), "select doc_id, label, split from split_scored")
q("stratified_folds", ("folds_scored",), "select doc_id, label, fold from folds_scored")
q("random_oversample", ("ranked_scored",), """with sizes as (select label, count(*) as n_c from scored group by label),
 maj as (select label from sizes order by n_c desc, label desc limit 1),
 need as (select label as c, n_c from sizes where label <> (select label from maj)),
 draws as (select n.c as label, r.class_rank - n.n_c as draw, n.n_c from ranked_scored r join need n
   on r.label = (select label from maj) and r.class_rank >= n.n_c),
 picked as (select label, draw, cast('0x' || substr(md5('42:' || cast(label as varchar) || ':' || cast(draw as varchar)), 1, 15) as bigint) % n_c as class_rank from draws)
 select doc_id, label, score_milli, cast(null as bigint) as draw from scored
 union all select r.doc_id, r.label, r.score_milli, p.draw from picked p join ranked_scored r using (label, class_rank)""")
q("balanced_weights", ("scored",), """select s.doc_id, s.label, round(w.weight, 12) as weight from scored s join (
 select label, sum(count(*)) over () / (count(*) over () * count(*)) as weight from scored group by label) w using (label)""")
q("cv_summary", ("folds_scored",), """select round(avg(auc), 12) as mean, round(stddev_pop(auc), 12) as std, round(2 * stddev_pop(auc), 12) as two_std,
 count(auc) as folds from (
 select fold, case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (nb + 0.5 * neg)) / (cast(sum(pos) as double) * sum(neg)) end as auc from (
  select *, coalesce(sum(neg) over (partition by fold order by score rows between unbounded preceding and 1 preceding), 0) as nb from (
   select fold, probability as score, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg
   from folds_scored group by fold, probability)) group by fold)""")

_CT = strip("coalesce(text, '')")
cte("exp_o", ("expected_outline",), f"select distinct doc_id, coalesce(level, '') as level, {_CT} as text from expected_outline")
cte("act_o", ("actual_outline",), f"select distinct doc_id, coalesce(level, '') as level, {_CT} as text from actual_outline")
cte("outline_per_doc", ("exp_o", "act_o"), """select d.doc_id,
 coalesce(pe.n, 0) as p_exp, coalesce(pa.n, 0) as p_act, coalesce(pm.n, 0) as p_match,
 coalesce(te.n, 0) as t_exp, coalesce(ta.n, 0) as t_act, coalesce(tm.n, 0) as t_match
 from (select doc_id from documents where doc_id % 17 <> 3) d
 left join (select doc_id, count(*) n from exp_o group by doc_id) pe using (doc_id)
 left join (select doc_id, count(*) n from act_o group by doc_id) pa using (doc_id)
 left join (select doc_id, count(*) n from (select * from exp_o intersect select * from act_o) group by doc_id) pm using (doc_id)
 left join (select doc_id, count(distinct text) n from exp_o group by doc_id) te using (doc_id)
 left join (select doc_id, count(distinct text) n from act_o group by doc_id) ta using (doc_id)
 left join (select doc_id, count(*) n from (select doc_id, text from exp_o intersect select doc_id, text from act_o) group by doc_id) tm using (doc_id)""")
cte("outline_metrics", ("outline_per_doc",), """select doc_id, p_exp as n_exp_pairs, p_act as n_act_pairs, t_match as text_matches,
 tr as text_recall, tp as text_precision, p_match as pair_matches, pr as pair_recall, pp as pair_precision,
 case when tr + tp > 0 then 2 * tp * tr / (tp + tr) else 0.0 end as text_f1,
 case when pr + pp > 0 then 2 * pp * pr / (pp + pr) else 0.0 end as pair_f1 from (
 select *, case when t_exp > 0 then cast(t_match as double) / t_exp else 1.0 end as tr,
  case when t_act > 0 then cast(t_match as double) / t_act else 1.0 end as tp,
  case when p_exp > 0 then cast(p_match as double) / p_exp else 1.0 end as pr,
  case when p_act > 0 then cast(p_match as double) / p_act else 1.0 end as pp from outline_per_doc)""")

q("outline_metrics", ("outline_metrics",), "select * from outline_metrics")
q("outline_metrics_avg", ("outline_metrics",), """select count(*) as n_docs, round(avg(text_recall), 12) as avg_text_recall,
 round(avg(text_precision), 12) as avg_text_precision, round(avg(text_f1), 12) as avg_text_f1,
 round(avg(pair_recall), 12) as avg_pair_recall, round(avg(pair_precision), 12) as avg_pair_precision,
 round(avg(pair_f1), 12) as avg_pair_f1 from outline_metrics""")
q("outline_intersect", ("exp_o", "act_o"), "select * from exp_o intersect select * from act_o")
q("outline_missing", (), "select doc_id from documents where doc_id % 17 = 3")

# ----------------------------------------------------------------- language
def _grams_sql(src: str, key: str) -> str:
    return f"""select {key}, gram, sum(cnt) as cnt from (
  select {key}, cnt, unnest(list_concat(
    list_transform(range(1, length(word) + 1), lambda i: substring(word, i, 1)),
    case when length(word) + 2 >= 2 then list_transform(range(1, length(word) + 2), lambda i: substring(' ' || word || ' ', i, 2)) else [] end,
    case when length(word) + 2 >= 3 then list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3)) else [] end)) as gram
  from (select {key}, word, count(*) as cnt from (
    select {key}, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' ')) as word from {src})
   where length(word) > 0 group by {key}, word)) group by {key}, gram"""


cte("lang_profiles", (), f"""select lang, gram, rank from (
 select lang, gram, row_number() over (partition by lang order by cnt desc, gram) as rank from (
  {_grams_sql("(select lang, text from documents where lang is not null)", "lang")})) where rank <= 300""")
cte("doc_profiles", (), f"""select doc_id, gram, rank from (
 select doc_id, gram, row_number() over (partition by doc_id order by cnt desc, gram) as rank from (
  {_grams_sql("documents", "doc_id")})) where rank <= 300""")
cte("lang_best", ("lang_profiles", "doc_profiles"), """select doc_id, lang from (
 select doc_id, lang, row_number() over (partition by doc_id order by score desc, lang) as rn from (
  select d.doc_id, l.lang, sum(300 - abs(d.rank - l.rank)) as score from doc_profiles d join lang_profiles l using (gram)
  group by d.doc_id, l.lang)) where rn = 1""")

q("language_profiles", ("lang_profiles",), "select lang, gram, cast(rank as int) as rank from lang_profiles")
q("detect_language", ("lang_best",), """select d.doc_id, coalesce(b.lang, 'unknown') as language
 from documents d left join lang_best b using (doc_id)""")

# ----------------------------------------------------------- sources/plans
q("clean_cells", ("cells",), """select page_key, no as cell_no, x, y, w, h, t as text, case when cell_no % 17 = 3 then 0.0 else font_size end as font_size,
 case when cell_no % 17 = 3 then '' else font_name end as font_name
 from (select *, cell_no as no, text as t from cells union all select *, cell_no + 2000000, '' from cells where cell_no % 11 = 7) u""")
q("union_splits", ("images",), """select image_id, doc_name, case when (image_id // 1000) % 10 < 7 then 'train'
 when (image_id // 1000) % 10 < 9 then 'val' else 'test' end as split from images""")
q("score_corpus", ("outline_flat",), """select d.doc_id,
 case when d.doc_id % 100 >= 96 then 'error' when o.title is null then 'empty' else 'ok' end as status,
 case d.doc_id % 100 when 99 then 'invalid page size' when 98 then 'invalid box' when 97 then 'missing page number'
  when 96 then 'invalid font size' end as error,
 case when d.doc_id % 100 < 96 then o.title end as title,
 case when d.doc_id % 100 < 96 and o.title is not null then o.n end as n_headings
 from documents d left join (select doc_id, any_value(title) as title, count(seq) as n from outline_flat group by doc_id) o using (doc_id)""")
q("compare_outlines", ("outline_metrics",), """select count(m.text_recall) as n_docs, count(*) filter (where m.text_recall is null) as n_missing,
 round(avg(text_recall), 12) as avg_text_recall, round(avg(text_precision), 12) as avg_text_precision, round(avg(text_f1), 12) as avg_text_f1,
 round(avg(pair_recall), 12) as avg_pair_recall, round(avg(pair_precision), 12) as avg_pair_precision, round(avg(pair_f1), 12) as avg_pair_f1
 from documents d left join outline_metrics m using (doc_id)""")

cte("cell_texts", ("cell_feats0",), """select cast(image_id as varchar) || ':' || cast(cell_no as varchar) as cell_id, image_id, cell_no, text
 from cell_feats0""")
cte("cell_profiles", ("cell_texts",), f"""select cell_id, gram, rank from (
 select cell_id, gram, row_number() over (partition by cell_id order by cnt desc, gram) as rank from (
  {_grams_sql("cell_texts", "cell_id")})) where rank <= 300""")
cte("cell_lang_best", ("lang_profiles", "cell_profiles"), """select cell_id, lang from (
 select cell_id, lang, row_number() over (partition by cell_id order by score desc, lang) as rn from (
  select d.cell_id, l.lang, sum(300 - abs(d.rank - l.rank)) as score from cell_profiles d join lang_profiles l using (gram)
  group by d.cell_id, l.lang)) where rn = 1""")
q("augment_language", ("cell_texts", "cell_lang_best"), """select c.image_id, c.cell_no, c.text,
 coalesce(b.lang, 'unknown') as language
 from cell_texts c left join cell_lang_best b using (cell_id)""")

# ------------------------------------------------------- fixed node table
_FEATS = ("font_size, font_weight, norm_x, norm_y, text_length, num_words, is_all_caps, is_centered, numbering_depth, "
          "relative_font_size, percent_punct")
_X = "list_transform([" + ", ".join(f"cast({c} as double)" for c in _FEATS.split(", ")) + "], lambda v: case when v is null or isnan(v) then 0 else v end)"

cte("forest", (), """select t, i, case when i < 7 then (3*t + 2*i) % 11 else -1 end as f,
 [11.0::double, 0.5, 0.1, 0.5, 40.0, 6.0, 0.5, 0.5, 0.5, 1.1, 0.02][(3*t + 2*i) % 11 + 1] * (8 + t) / 10 as c,
 cast(((5*t + 3*i) % 7 - 3) as double) / 4 as v from range(6) a(t), range(15) b(i)""")


def walk_ctes(src: str, keys: str, name: str) -> None:
    """Every row of ``src`` down every tree: three tests, then a leaf."""
    cte(f"{name}_0", (src,), f"select {keys}, {_X} as x, t, cast(0 as bigint) as i from {src}, range(6) r(t)")
    for k in range(3):
        cte(f"{name}_{k + 1}", (f"{name}_{k}", "forest"), f"""select w.* exclude (i), f.f as f{k}, case when x[f.f + 1] <= f.c then 2*w.i + 1 else 2*w.i + 2 end as i
 from {name}_{k} w join forest f on f.t = w.t and f.i = w.i""")
    cte(name, (f"{name}_3", "forest"), f"select w.*, 0.3::double * f.v as value from {name}_3 w join forest f on f.t = w.t and f.i = w.i")


walk_ctes("block_feats", "doc_id, page_num, block_no", "block_walk")
q("score_blocks_forest", ("block_walk",), """select doc_id, page_num, block_no, round(p, 9) as probability, case when p > 0.5 then 1 else 0 end as prediction
 from (select doc_id, page_num, block_no, 1 / (1 + exp(-2 * sum(value))) as p from block_walk group by doc_id, page_num, block_no)""")

cte("cell_rows", ("cell_dataset",), "select row_number() over () as rid, * from cell_dataset")
walk_ctes("cell_rows", "rid, is_heading", "cell_walk")
q("forest_curve", ("cell_walk",), """select cast(t + 1 as int) as trees, round(avg(2 * ln(1 + exp(-2 * (2 * is_heading - 1) * m))), 9) as loss
 from (select t, is_heading, sum(value) over (partition by rid order by t) as m from cell_walk) group by t""")
q("forest_split_counts", ("cell_walk", "forest"), f"""select n.feature, coalesce(s.splits, 0) as splits, coalesce(p.passed, 0) as passed
 from (select unnest(string_split('{_FEATS}', ', ')) as feature, unnest(range(11)) as at) n
 left join (select f, count(*) as splits from forest where f >= 0 group by f) s on s.f = n.at
 left join (select f, count(*) as passed from (select unnest([f0, f1, f2]) as f from cell_walk) group by f) p on p.f = n.at""")
