"""Inference plans: lines -> blocks -> features -> headings -> outline.

``extract_outlines`` is one Spark plan over all documents.  Shuffles, in
order: the page window (doc, page), the per-document body size (partial
``mode``), the running-header aggregation, the join of body sizes and the
anti join of running headers (AQE splits skewed keys), and the per-document
fold over *surviving headings only*, chunked by page (a per-page fold,
then a per-document fold over bounded page summaries).  The block table feeds four branches
(body size, join back, running headers, document list), so it is
materialised once (``pagewise.materialize``: checkpoint by default) instead
of re-running the scan and the page window per branch.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.functions.text import py_strip
from pagewise.operators import blocks as B
from pagewise.operators import features as FE
from pagewise.operators import outline as O
from pagewise.operators import rules as R
from pagewise.session import materialize


def block_features(lines: DataFrame, key: str = "doc_id", materialize_blocks: str | None = None) -> DataFrame:
    """Blocks with the eleven features plus ``body_font_size``.

    The per-page block table is read twice (body-size aggregate and the
    join back); ``materialize_blocks`` ('checkpoint' / 'persist' / 'none')
    materialises it once so the scan and the page window run once."""
    blocks = FE.block_text_features(B.merge_lines(lines, key))
    if materialize_blocks != "none":
        blocks = materialize(blocks, materialize_blocks, columnar=True)
    body = FE.body_font_size(blocks, key=key, min_words=FE.INFER_BODY_MIN_WORDS)
    return FE.with_relative_font_size(blocks, body, key=key)


def heading_candidates(feats: DataFrame, scorer: Callable[[DataFrame], DataFrame] = O.fixed_score,
                       key: str = "doc_id", headers: DataFrame | None = None) -> DataFrame:
    """Scored blocks predicted as headings, minus running headers, minus the
    rule-based false positives."""
    scored = scorer(feats)
    cands = scored.where(F.col("is_heading") == 1)
    if headers is None:
        headers = R.running_headers(feats, key=key)
    cands = R.drop_running_headers(cands, headers, key=key)
    return R.apply_heading_rules(cands)


def outline_entries(cands: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leveled headings in reading order (page, norm_y, block): the
    page-chunked fold, so no task gathers a whole document's headings."""
    return O.outline_levels_by_page(cands, key=key, carry=("text",))


def extract_outlines(lines: DataFrame, scorer: Callable[[DataFrame], DataFrame] = O.fixed_score,
                     key: str = "doc_id", materialize_blocks: str | None = None) -> DataFrame:
    """Flat outline: one row per heading (doc_id, title, seq, level, text,
    page); a document with blocks but no heading keeps one row with a null
    entry and title ''.

    The block table (features before the relative size) is materialised
    once; the body sizes, the running headers and the document list are all
    aggregates of it, and only the scored candidates need the body-size
    join."""
    blocks = FE.block_text_features(B.merge_lines(lines, key))
    if materialize_blocks != "none":
        blocks = materialize(blocks, materialize_blocks, columnar=True)
    body = FE.body_font_size(blocks, key=key, min_words=FE.INFER_BODY_MIN_WORDS)
    feats = FE.with_relative_font_size(blocks, body, key=key)
    headers = R.running_headers(blocks, key=key)
    cands = heading_candidates(feats, scorer, key, headers)
    if materialize_blocks != "none":
        # headings only: the fold and the title read them in several branches
        cands = materialize(cands, materialize_blocks)
    leveled = outline_entries(cands, key)
    if materialize_blocks != "none":
        # the levelled headings feed both the titles and the entries
        leveled = materialize(leveled, materialize_blocks)
    return flat_outline(blocks.select(key).distinct(), leveled, key)


def flat_outline(docs: DataFrame, leveled: DataFrame, key: str = "doc_id") -> DataFrame:
    titles = O.detect_title(leveled, key=key, all_docs=False)
    docs_titles = docs.join(titles, key, "left").select(key, F.coalesce("title", F.lit("")).alias("title"))
    entries = leveled.select(key, "seq", "level", py_strip("text").alias("text"),
                             F.col("page_num").cast("int").alias("page"))
    return docs_titles.join(entries, key, "left")


def nested_outline(flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: ``title`` and ``outline`` array of
    (level, text, page) in order -- the JSON document shape."""
    entry = F.when(F.col("seq").isNotNull(), F.struct("seq", "level", "text", "page"))
    nested = flat.groupBy(key).agg(F.first("title").alias("title"),
                                   F.array_sort(F.collect_list(entry)).alias("o"))
    return nested.select(key, "title", F.transform("o", lambda e: F.struct(
        e["level"].alias("level"), e["text"].alias("text"), e["page"].alias("page"))).alias("outline"))


def _finite(*cols: str):
    """True if all of them are numbers: not null, NaN or infinite."""
    ok = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        ok = ok & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return ok


# Why a document cannot be processed, the first that holds for a line of it.
LINE_ERRORS = {
    "unreadable record": lambda: F.col("_corrupt_record").isNotNull(),
    "invalid page size": lambda: ~_finite("page_width", "page_height") | (F.col("page_width") <= 0) | (F.col("page_height") <= 0),
    "missing page number": lambda: F.col("page_num").isNull(),
    "invalid box": lambda: ~_finite("x0", "y0", "x1", "y1"),
    "invalid font size": lambda: ~_finite("size"),
}


def line_errors(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, error): one row per document with a line that cannot be processed.
    Unreadable records are known by the column ``_corrupt_record`` of Spark's
    readers, if the lines have it.  Lines without a document are no error."""
    reasons = [(why, holds) for why, holds in LINE_ERRORS.items() if why != "unreadable record" or "_corrupt_record" in lines.columns]
    found = F.coalesce(*[F.when(holds(), F.lit(i)) for i, (_, holds) in enumerate(reasons)])
    names = F.array(*[F.lit(why) for why, _ in reasons])
    bad = lines.where(F.col(key).isNotNull()).select(key, found.alias("_why")).where(F.col("_why").isNotNull())
    return bad.groupBy(key).agg(F.get(names, F.min("_why")).alias("error"))


def corpus_outlines(docs: DataFrame, lines: DataFrame, scorer: Callable[[DataFrame], DataFrame] = O.fixed_score,
                    key: str = "doc_id", materialize_blocks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(status per document, flat outline of the processable documents).

    Status: 'ok' (title, number of headings), 'empty' (no text block) or
    'error' (the first of ``LINE_ERRORS`` that a line of it has).  A bad
    document never stops the others: it is excluded from the plan and
    reported, all in one distributed job."""
    bad_docs = line_errors(lines, key)
    good_lines = lines.join(bad_docs, key, "left_anti")
    flat = extract_outlines(good_lines, scorer, key, materialize_blocks)
    per_doc = flat.groupBy(key).agg(F.first("title").alias("title"), F.count("seq").alias("n_headings"))
    out = docs.select(key).join(per_doc, key, "left").join(bad_docs, key, "left")
    bad = F.col("error").isNotNull()
    status = F.when(bad, "error").when(F.col("title").isNull(), "empty").otherwise("ok")
    return out.select(key, status.alias("status"), "error",
                      F.when(~bad, F.col("title")).alias("title"),
                      F.when(F.col("title").isNotNull() & ~bad, F.col("n_headings")).alias("n_headings")), flat


def score_corpus(docs: DataFrame, lines: DataFrame, scorer: Callable[[DataFrame], DataFrame] = O.fixed_score,
                 key: str = "doc_id") -> DataFrame:
    """One result row per input document (see ``corpus_outlines``)."""
    return corpus_outlines(docs, lines, scorer, key)[0]
