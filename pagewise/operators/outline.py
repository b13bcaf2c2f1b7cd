"""Heading scoring, outline levels and titles.

``outline_levels`` is the one order-dependent, non-relational step: a stack
fold over a document's headings in reading order.  It runs as Catalyst
``aggregate`` higher-order functions -- no Python, no UDF -- and only over
rows that survived scoring and the rule filters, never all lines.

``outline_levels_by_page`` (used by the plans) never gathers a document's
headings: each page is folded on its own over an unknown stack below it,
giving every heading a level relative to an *anchor* on its page, and a
document-level fold then runs over the page summaries alone (anchors and
the final local stack).  ``outline_levels`` is the direct one-array form,
kept as the reference implementation for tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.functions.text import py_strip

# Fixed value: relative-size tolerance for "same level" in the outline fold.
LEVEL_TOLERANCE = 0.05
# Fixed value: deepest outline level.
MAX_LEVEL = 6

# The linear scorer used for oracle parity (weights of the
# relative size offset, weight, caps, numbering and words; heading if z > 0).
FIXED_SCORER = {
    "rel_offset": 1.1137, "rel": 4.0, "weight": 1.0, "caps": 0.5, "numbered": 0.3, "words": 0.05,
}


def fixed_score(df: DataFrame) -> DataFrame:
    """Deterministic stand-in for a trained model: adds ``score`` and
    ``is_heading`` (1 when score > 0)."""
    w = FIXED_SCORER
    z = (F.lit(w["rel"]) * (F.col("relative_font_size") - F.lit(w["rel_offset"]))
         + F.col("font_weight") * F.lit(w["weight"])
         + F.col("is_all_caps") * F.lit(w["caps"])
         + F.least(F.col("numbering_depth"), F.lit(1)) * F.lit(w["numbered"])
         - F.col("num_words") * F.lit(w["words"]))
    return df.withColumn("score", z).withColumn("is_heading", F.when(F.col("score") > 0, 1).otherwise(0))


def apply_threshold(df: DataFrame, threshold: float = 0.5, prob_col: str = "probability",
                    out_col: str = "prediction") -> DataFrame:
    """Class 1 when the probability is strictly above the threshold."""
    return df.withColumn(out_col, F.when(F.col(prob_col) > F.lit(threshold), 1).otherwise(0))


def _fold_sql(arr: str, tol: float, max_level: int) -> str:
    """SQL text of the stack fold.  State: stack of (level, size) and the
    levels emitted so far.  For heading size c the topmost stack entry k with
    |c - s_k| <= tol (sibling) or c < s_k - tol (child) is found; the top of
    the stack tests child first, deeper entries sibling first.  Sibling: keep
    level, cut above k and replace its size by c; child: level + 1 (capped),
    cut above k and push; no entry: level 1, fresh stack."""
    t = repr(float(tol))

    def ok(c, s):
        return f"(NOT isnan({c}) AND NOT isnan({s}))"

    def sib(c, s):
        return f"({ok(c, s)} AND abs({c} - {s}) <= {t})"

    def child(c, s):
        return f"({ok(c, s)} AND {c} < {s} - {t})"

    k_expr = (f"aggregate(sequence(1, greatest(size(st_.stack), 1)), 0, "
              f"(m_, i_) -> IF(i_ <= size(st_.stack) AND "
              f"({sib('h_.rel', 'element_at(st_.stack, i_).s')} OR {child('h_.rel', 'element_at(st_.stack, i_).s')}), i_, m_))")
    e = "element_at(st_.stack, k_)"
    use_child = f"IF(k_ = size(st_.stack), {child('h_.rel', e + '.s')}, NOT {sib('h_.rel', e + '.s')})"
    lvl_expr = f"IF(k_ = 0, 1, IF({use_child}, least({e}.l + 1, {max_level}), {e}.l))"
    entry = "array(named_struct('l', lv_, 's', h_.rel))"
    stack_expr = (f"IF(k_ = 0, {entry}, IF({use_child}, concat(slice(st_.stack, 1, k_), {entry}), "
                  f"concat(slice(st_.stack, 1, k_ - 1), {entry})))")
    init = ("named_struct('stack', cast(array() as array<struct<l:int,s:double>>), "
            "'out', cast(array() as array<int>))")
    step = (f"aggregate(array({k_expr}), st_, (st2_, k_) -> "
            f"aggregate(array({lvl_expr}), st2_, (st3_, lv_) -> "
            f"named_struct('stack', {stack_expr}, 'out', concat(st_.out, array(lv_)))))")
    return f"aggregate({arr}, {init}, (st_, h_) -> {step}, st_ -> st_.out)"


def outline_levels(headings: DataFrame, key: str = "doc_id", rel_col: str = "relative_font_size",
                   order_cols=("page_num", "norm_y", "block_no"), carry=(),
                   tol: float = LEVEL_TOLERANCE, max_level: int = MAX_LEVEL) -> DataFrame:
    """Level per heading (``level_num`` int and ``level`` 'H1'..'H6') and its
    1-based position ``seq`` in reading order within the document.

    One aggregation per document over the headings only; the array is
    sorted on the order key (``collect_list`` order is not deterministic
    after a shuffle)."""
    fields = [F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)]
    payload = [F.col(rel_col).cast("double").alias("rel")] + [F.col(c) for c in carry]
    hs = headings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields, *payload))).alias("hs"))
    hs = hs.withColumn("lv", F.expr(_fold_sql("hs", tol, max_level)))
    zipped = hs.select(key, F.posexplode(F.arrays_zip(F.col("hs").alias("h"), F.col("lv").alias("l"))).alias("pos", "z"))
    out = zipped.select(
        key, (F.col("pos") + 1).cast("int").alias("seq"),
        *[F.col("z.h")[f"o{i}"].alias(c) for i, c in enumerate(order_cols)],
        F.col("z.h.rel").alias(rel_col),
        *[F.col("z.h")[c].alias(c) for c in carry],
        F.col("z.l").alias("level_num"),
    )
    return out.withColumn("level", F.concat(F.lit("H"), F.col("level_num").cast("string")))


def _match_sql(stack: str, c: str, tol: str, size_field: str = "s") -> dict:
    """SQL pieces for the stack search: k = topmost matching index (0 if
    none), and the sibling / child tests against entry k."""
    def ok(x, y):
        return f"(NOT isnan({x}) AND NOT isnan({y}))"

    def sib(x, y):
        return f"({ok(x, y)} AND abs({x} - {y}) <= {tol})"

    def child(x, y):
        return f"({ok(x, y)} AND {x} < {y} - {tol})"

    ei = f"element_at({stack}, i_).{size_field}"
    k = (f"aggregate(sequence(1, greatest(size({stack}), 1)), 0, (m_, i_) -> "
         f"IF(i_ <= size({stack}) AND ({sib(c, ei)} OR {child(c, ei)}), i_, m_))")
    return {"k": k, "sib": sib, "child": child}


def _page_fold_sql(arr: str, tol: float, max_level: int) -> str:
    """Fold of one page's headings over an unknown stack below the page.

    Local stack entries are (a, d, s): level = min(L(a) + d, max) where
    L(a) is the level of the page's a-th heading, an *anchor* -- a heading
    that matched nothing on the local stack and so depends on the stack
    below the page.  Returns per heading (a, d), the anchors (p, c) in
    order, and the final local stack."""
    t = repr(float(tol))
    m = _match_sql("st_.stack", "h_.rel", t)
    e = "element_at(st_.stack, k_)"
    uc = f"IF(k_ = size(st_.stack), {m['child']('h_.rel', e + '.s')}, NOT {m['sib']('h_.rel', e + '.s')})"
    init = ("named_struct('stack', cast(array() as array<struct<a:int,d:int,s:double>>), "
            "'out', cast(array() as array<struct<a:int,d:int>>), "
            "'unr', cast(array() as array<struct<p:int,c:double>>), 'n', 0)")
    anchor = ("named_struct('stack', array(named_struct('a', st_.n + 1, 'd', 0, 's', h_.rel)), "
              "'out', concat(st_.out, array(named_struct('a', st_.n + 1, 'd', 0))), "
              "'unr', concat(st_.unr, array(named_struct('p', st_.n + 1, 'c', h_.rel))), 'n', st_.n + 1)")
    matched = (f"aggregate(array({uc}), st2_, (st3_, uc_) -> named_struct("
               f"'stack', IF(uc_, concat(slice(st_.stack, 1, k_), array(named_struct('a', {e}.a, 'd', {e}.d + 1, 's', h_.rel))), "
               f"concat(slice(st_.stack, 1, k_ - 1), array(named_struct('a', {e}.a, 'd', {e}.d, 's', h_.rel)))), "
               f"'out', concat(st_.out, array(named_struct('a', {e}.a, 'd', IF(uc_, {e}.d + 1, {e}.d)))), "
               f"'unr', st_.unr, 'n', st_.n + 1))")
    step = f"aggregate(array({m['k']}), st_, (st2_, k_) -> IF(k_ = 0, {anchor}, {matched}))"
    return f"aggregate({arr}, {init}, (st_, h_) -> {step}, st_ -> st_)"


def _doc_fold_sql(arr: str, tol: float, max_level: int) -> str:
    """Sequential fold over one document's page summaries (in page order):
    resolves each page's anchors against the real stack ``R`` of entries
    below the page, then pushes the page's final local stack onto ``R``.
    Only the first anchor of a page sees the real top (it is the page's
    first heading); later anchors test sibling first."""
    t = repr(float(tol))
    m = _match_sql("s2_.R", "u_.c", t)
    e = "element_at(s2_.R, k_)"
    uc = f"IF(s2_.first AND k_ = size(s2_.R), {m['child']('u_.c', e + '.s')}, NOT {m['sib']('u_.c', e + '.s')})"
    empty_r = "cast(array() as array<struct<l:int,s:double>>)"
    none = (f"named_struct('R', {empty_r}, 'la', concat(s2_.la, array(named_struct('p', u_.p, 'l', 1))), "
            f"'first', false)")
    hit = (f"aggregate(array({uc}), s3_, (s4_, uc_) -> named_struct("
           f"'R', IF(uc_, slice(s2_.R, 1, k_), slice(s2_.R, 1, k_ - 1)), "
           f"'la', concat(s2_.la, array(named_struct('p', u_.p, 'l', IF(uc_, least({e}.l + 1, {max_level}), {e}.l)))), "
           f"'first', false))")
    resolve = (f"aggregate(ch_.unr, named_struct('R', st_.R, 'la', cast(array() as array<struct<p:int,l:int>>), "
               f"'first', true), (s2_, u_) -> aggregate(array({m['k']}), s2_, (s3_, k_) -> IF(k_ = 0, {none}, {hit})))")
    push = (f"transform(ch_.fstack, e_ -> named_struct('l', least(element_at(filter(r_.la, x_ -> x_.p = e_.a), 1).l "
            f"+ e_.d, {max_level}), 's', e_.s))")
    init = (f"named_struct('R', {empty_r}, 'L', cast(array() as array<struct<pg:int,p:int,l:int>>), "
            f"'off', cast(array() as array<struct<pg:int,o:int>>), 'cnt', 0)")
    step = (f"aggregate(array({resolve}), st_, (st2_, r_) -> named_struct("
            f"'R', concat(r_.R, {push}), "
            f"'L', concat(st_.L, transform(r_.la, x_ -> named_struct('pg', ch_.pg, 'p', x_.p, 'l', x_.l))), "
            f"'off', concat(st_.off, array(named_struct('pg', ch_.pg, 'o', st_.cnt))), "
            f"'cnt', st_.cnt + ch_.n))")
    return f"aggregate({arr}, {init}, (st_, ch_) -> {step}, st_ -> st_)"


def _block_fold_sql(arr: str, tol: float) -> str:
    """Fold of a run of page summaries (a page block) over an unknown stack
    below the block.  Each page anchor is resolved against the block's
    symbolic stack (entries (a, d, s) relative to *block* anchors, whose
    ids are block-relative heading positions) or becomes a block anchor;
    then the page's final stack is pushed, re-expressed relative to block
    anchors.  The result has the shape of a page summary (``unr``,
    ``stack``, ``cnt``) plus ``map`` (page anchor -> block anchor, offset)
    and ``off`` (page offsets inside the block)."""
    t = repr(float(tol))
    m = _match_sql("s2_.S", "u_.c", t)
    e = "element_at(s2_.S, k_)"
    uc = f"IF(s2_.first AND k_ = size(s2_.S), {m['child']('u_.c', e + '.s')}, NOT {m['sib']('u_.c', e + '.s')})"
    empty_s = "cast(array() as array<struct<a:int,d:int,s:double>>)"
    becomes_anchor = (f"named_struct('S', {empty_s}, "
                      f"'mp', concat(s2_.mp, array(named_struct('p', u_.p, 'a', st_.cnt + u_.p, 'd', 0))), "
                      f"'un', concat(s2_.un, array(named_struct('p', st_.cnt + u_.p, 'c', u_.c))), 'first', false)")
    resolved = (f"aggregate(array({uc}), s3_, (s4_, uc_) -> named_struct("
                f"'S', IF(uc_, slice(s2_.S, 1, k_), slice(s2_.S, 1, k_ - 1)), "
                f"'mp', concat(s2_.mp, array(named_struct('p', u_.p, 'a', {e}.a, 'd', {e}.d + IF(uc_, 1, 0)))), "
                f"'un', s2_.un, 'first', false))")
    resolve = (f"aggregate(ch_.unr, named_struct('S', st_.stack, 'mp', cast(array() as array<struct<p:int,a:int,d:int>>), "
               f"'un', cast(array() as array<struct<p:int,c:double>>), 'first', true), "
               f"(s2_, u_) -> aggregate(array({m['k']}), s2_, (s3_, k_) -> IF(k_ = 0, {becomes_anchor}, {resolved})))")
    look = "element_at(filter(r_.mp, x_ -> x_.p = e_.a), 1)"
    push = f"transform(ch_.fstack, e_ -> named_struct('a', {look}.a, 'd', {look}.d + e_.d, 's', e_.s))"
    init = (f"named_struct('stack', {empty_s}, "
            f"'map', cast(array() as array<struct<pg:int,p:int,a:int,d:int>>), "
            f"'unr', cast(array() as array<struct<p:int,c:double>>), "
            f"'off', cast(array() as array<struct<pg:int,o:int>>), 'cnt', 0)")
    step = (f"aggregate(array({resolve}), st_, (st2_, r_) -> named_struct("
            f"'stack', concat(r_.S, {push}), "
            f"'map', concat(st_.map, transform(r_.mp, x_ -> named_struct('pg', ch_.pg, 'p', x_.p, 'a', x_.a, 'd', x_.d))), "
            f"'unr', concat(st_.unr, r_.un), "
            f"'off', concat(st_.off, array(named_struct('pg', ch_.pg, 'o', st_.cnt))), "
            f"'cnt', st_.cnt + ch_.n))")
    return f"aggregate({arr}, {init}, (st_, ch_) -> {step}, st_ -> st_)"


# Pages per block in the two-level outline fold.
PAGES_PER_BLOCK = 1024


def outline_levels_by_page(headings: DataFrame, key: str = "doc_id", rel_col: str = "relative_font_size",
                           page_col: str = "page_num", order_cols=("norm_y", "block_no"), carry=(),
                           tol: float = LEVEL_TOLERANCE, max_level: int = MAX_LEVEL,
                           pages_per_block: int = PAGES_PER_BLOCK, materialize_pages: str | None = None) -> DataFrame:
    """Same result as ``outline_levels`` (reading order = page, then
    ``order_cols``), computed without gathering a document's headings:

    1. per (doc, page): the page's headings are folded over an unknown
       stack below the page -> per heading an (anchor, offset) pair, plus a
       page summary (anchors with their sizes, final local stack, whose
       depth is bounded by the spread of relative sizes over the tolerance);
    2. per (doc, page block of ``pages_per_block`` pages): the page
       summaries are folded the same way into a block summary and a map
       page anchor -> (block anchor, offset);
    3. per doc: a sequential fold over the *block* summaries only;
    4. level = min(level(block anchor) + block offset + page offset, max),
       seq = block offset + page offset + rank on the page.
    """
    fields = [F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)]
    payload = [F.col(rel_col).cast("double").alias("rel")] + [F.col(c) for c in carry]
    pages = headings.groupBy(key, F.col(page_col).cast("int").alias("pg")).agg(
        F.array_sort(F.collect_list(F.struct(*fields, *payload))).alias("hs"))
    pages = pages.withColumn("pf", F.expr(_page_fold_sql("hs", tol, max_level)))
    if materialize_pages:
        from pagewise.session import materialize
        pages = materialize(pages, materialize_pages)
    per_heading = pages.select(key, "pg", F.posexplode(F.arrays_zip(F.col("hs").alias("h"),
                                                                    F.col("pf.out").alias("r"))).alias("pos", "z"))
    blk = F.floor(F.col("pg") / pages_per_block).cast("int")
    blocks = pages.groupBy(key, blk.alias("bk")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("pg"), F.size("hs").alias("n"), F.col("pf.unr").alias("unr"), F.col("pf.stack").alias("fstack"))))
        .alias("pages"))
    blocks = blocks.withColumn("bf", F.expr(_block_fold_sql("pages", tol)))
    page_map = blocks.select(key, "bk", "bf.off", F.explode("bf.map").alias("x")).select(
        key, F.col("x.pg").alias("pg"), F.col("x.p").alias("a"), F.col("x.a").alias("ba"), F.col("x.d").alias("bd"),
        F.element_at(F.filter("off", lambda o: o["pg"] == F.col("x.pg")), 1)["o"].alias("poff"))
    summaries = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("bk").alias("pg"), F.col("bf.cnt").alias("n"), F.col("bf.unr").alias("unr"),
        F.col("bf.stack").alias("fstack")))).alias("chunks"))
    docs = summaries.select(key, F.expr(_doc_fold_sql("chunks", tol, max_level)).alias("df"))
    anchors = docs.select(key, "df.off", F.explode("df.L").alias("x")).select(
        key, F.col("x.pg").alias("bk"), F.col("x.p").alias("ba"), F.col("x.l").alias("la"),
        F.element_at(F.filter("off", lambda o: o["pg"] == F.col("x.pg")), 1)["o"].alias("boff"))
    rows = per_heading.select(key, "pg", blk.alias("bk"), (F.col("pos") + 1).alias("p"), F.col("z.h").alias("h"),
                              F.col("z.r.a").alias("a"), F.col("z.r.d").alias("d"))
    rows = rows.join(page_map, [key, "pg", "a"]).join(anchors, [key, "bk", "ba"])
    lvl = F.least(F.col("la") + F.col("bd") + F.col("d"), F.lit(max_level)).cast("int")
    out = rows.select(
        key, (F.col("boff") + F.col("poff") + F.col("p")).cast("int").alias("seq"), F.col("pg").alias(page_col),
        *[F.col("h")[f"o{i}"].alias(c) for i, c in enumerate(order_cols)],
        F.col("h.rel").alias(rel_col), *[F.col("h")[c].alias(c) for c in carry], lvl.alias("level_num"))
    return out.withColumn("level", F.concat(F.lit("H"), F.col("level_num").cast("string")))


def detect_title(leveled: DataFrame, key: str = "doc_id", all_docs: bool = True) -> DataFrame:
    """Title per document: among page-1 headings, H1 rows if any, else all;
    the highest ``relative_font_size - norm_y``, first in reading order on
    ties; stripped.  Documents without page-1 headings get '' (only
    documents with a page-1 heading are returned when ``all_docs`` is
    false).

    One ``max_by`` aggregate over a struct (has H1, score, -seq): partial
    aggregation, no window over the document."""
    score = F.col("relative_font_size") - F.col("norm_y")
    score = F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(score)
    p1 = leveled.where(F.col("page_num") == 1)
    rank = F.struct((F.col("level_num") == 1).cast("int").alias("h1"), score.alias("score"),
                    (-F.col("seq")).alias("neg_seq"))
    titles = p1.groupBy(key).agg(F.max_by(py_strip("text"), rank).alias("title"))
    if not all_docs:
        return titles
    docs = leveled.select(key).distinct()
    return docs.join(titles, key, "left").select(key, F.coalesce("title", F.lit("")).alias("title"))
