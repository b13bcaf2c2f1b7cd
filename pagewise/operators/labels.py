"""Labelling annotated pages: cells x annotation boxes.

``center_inside_join`` is a theta join restricted to one page.  Instead of a
nested loop over all cells x boxes of a page, boxes lie in horizontal bands
whose height fits theirs: level k has bands of ``BAND * GROWTH ** k``, a box
goes to the lowest level with bands as high as itself, so it lies in two bands
whatever its height (three if rounding moves an edge).  A cell centre looks up
one band on each level that boxes of its page use, then the exact inclusive
containment test is applied.  A box is on one level and a centre in one band
of it, so there are no duplicates, and a page with very many cells is split
across (page, level, band) keys.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.functions import geometry as G
from pagewise.functions import rounding as RD
from pagewise.functions import text as T

# Category names and their label priority (higher wins).
CATEGORY_PRIORITY = {"Title": 3, "Section-header": 2, "Text": 1}
HEADING_CATEGORIES = ("Title", "Section-header")
# Fixed value: page size used when an image record has none.
DEFAULT_PAGE_SIZE = 1025.0
# Fixed value: minimum stripped text length of a kept cell.
MIN_CELL_CHARS = 3
# Fixed value: deepest numbered heading level before "Other-Heading".
MAX_HEADING_LEVEL = 6
OTHER_HEADING = "Other-Heading"

# Band height (page units) of the lowest level of the containment join, the
# growth from level to level, and the level without bands, for boxes higher
# than all others' bands (2.7e11 units, or infinite).
BAND = 64.0
GROWTH = 4
TOP_LEVEL = 16


def with_page_key(images: DataFrame) -> DataFrame:
    """Images with ``page_key`` = stem of the file name, page size defaults."""
    return images.select(
        "*", T.file_stem("file_name").alias("page_key"),
        F.coalesce("coco_width", F.lit(DEFAULT_PAGE_SIZE)).alias("page_width"),
        F.coalesce("coco_height", F.lit(DEFAULT_PAGE_SIZE)).alias("page_height"))


def join_pages_cells(images: DataFrame, cells: DataFrame) -> DataFrame:
    """Inner equi join of pages and their text cells on the file stem."""
    return with_page_key(images).join(cells, on="page_key", how="inner")


def annotated_boxes(annotations: DataFrame, categories: DataFrame, keep=tuple(CATEGORY_PRIORITY)) -> DataFrame:
    """Annotations with their category name, restricted to ``keep``.  Of the
    category table only the rows with these names are joined; Spark broadcasts
    them if their measured size allows it."""
    kept = categories.where(F.col("name").isin(*keep)).select("category_id", "name")
    return annotations.join(kept, "category_id")


def _level(height, band: float) -> Column:
    """The lowest level whose bands are at least as high."""
    return reduce(operator.add, [(height > band * GROWTH ** k).cast("int") for k in range(TOP_LEVEL)])


def _band(y, level, band: float) -> Column:
    # floor() saturates at the ends of a long and keeps the order
    return F.when(level == TOP_LEVEL, F.lit(0).cast("bigint")).otherwise(F.floor(y / (band * F.pow(F.lit(float(GROWTH)), level))))


def _placed(outer: DataFrame, band: float, oy: str, oh: str, *others: str) -> DataFrame:
    """The boxes that a centre can lie in, with their ``_level``."""
    end = F.col(oy) + F.col(oh)
    ok = (F.col(oh) >= 0) & ~F.isnan(F.col(oh)) & ~F.isnan(end)
    for c in others:
        ok = ok & F.col(c).isNotNull()
    return outer.where(ok).withColumn("_level", _level(F.col(oh), band))


def box_levels(outer: DataFrame, page, outer_box=("ax", "ay", "aw", "ah"), band: float = BAND) -> DataFrame:
    """Per page the levels that its boxes use (``_levels``: at most
    ``TOP_LEVEL + 1`` numbers); pages without boxes are left out."""
    ox, oy, ow, oh = outer_box
    keys = [page] if isinstance(page, str) else list(page)
    return _placed(outer, band, oy, oh, ox, ow).groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))


def center_inside_join(inner: DataFrame, outer: DataFrame, page="image_id",
                       inner_box=("x", "y", "w", "h"), outer_box=("ax", "ay", "aw", "ah"), band: float = BAND) -> DataFrame:
    """Pairs (inner row, outer row) of the same page where the inner box's
    centre lies in the outer box, edges inclusive.  Boxes are [x, y, w, h]
    columns; rows with a null coordinate never match.  ``page`` is the page
    key: a column name or a list of them.  ``inner`` may bring the column
    ``_levels`` of ``box_levels`` with the same ``band`` (height of the lowest
    level's bands); without it, it is joined here."""
    ix, iy, iw, ih = inner_box
    ox, oy, ow, oh = outer_box
    keys = [page] if isinstance(page, str) else list(page)
    if "_levels" not in inner.columns:
        inner = inner.join(box_levels(outer, keys, outer_box, band), keys)
    cy = F.col(iy) + F.col(ih) / 2.0
    probes = inner.where(F.col(ix).isNotNull() & F.col(iw).isNotNull() & cy.isNotNull() & ~F.isnan(cy)) \
        .withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_band", _band(cy, F.col("_level"), band))
    level = F.col("_level")
    boxes = _placed(outer, band, oy, oh, ox, ow).withColumn(
        "_band", F.explode(F.sequence(_band(F.col(oy), level, band), _band(F.col(oy) + F.col(oh), level, band))))
    joined = probes.join(boxes, on=[*keys, "_level", "_band"], how="inner")
    return joined.where(G.center_inside(ix, iy, iw, ih, ox, oy, ow, oh)).drop("_level", "_band")


def page_key_columns(split_key: bool) -> list[str]:
    """Join key between pages and annotations: ``image_id`` alone
    (annotations of equal ids in two splits apply to both, as a lookup keyed
    by id does), or (split, image_id)."""
    return ["split", "image_id"] if split_key else ["image_id"]


def _record_key(pc: DataFrame) -> list[str]:
    """Identity of one page record: its id, its split when known, and its
    file stem -- two records sharing an id are still two pages."""
    return ["image_id"] + (["split"] if "split" in pc.columns else []) + ["page_key"]


def _boxes(annotations: DataFrame, categories: DataFrame, page: list[str], keep, extra=()) -> DataFrame:
    """Annotation boxes renamed for the containment join; an annotation's
    own split is kept as ``ann_split`` when it is not part of the key."""
    named = annotated_boxes(annotations, categories, keep=keep)
    cols = [*page, *extra, F.col("name"), F.col("x").alias("ax"), F.col("y").alias("ay"),
            F.col("w").alias("aw"), F.col("h").alias("ah")]
    if "split" in annotations.columns and "split" not in page:
        cols.append(F.col("split").alias("ann_split"))
    return named.select(*cols)


def _annotated_cells(images: DataFrame, cells: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Cells of the pages that have boxes, with the pages' ``_levels``: pages
    without are dropped before their cells are shuffled."""
    return join_pages_cells(images.join(box_levels(boxes, page), page), cells)


def label_cells(images: DataFrame, cells: DataFrame, annotations: DataFrame, categories: DataFrame,
                split_key: bool = False) -> DataFrame:
    """Per cell the highest category among the boxes containing its centre
    (Title > Section-header > Text); cells in no box are dropped.  One hash
    aggregate per cell with map-side combine."""
    page = page_key_columns(split_key)
    boxes = _boxes(annotations, categories, page, tuple(CATEGORY_PRIORITY))
    pc = _annotated_cells(images, cells, boxes, page)
    prio = F.create_map(*[x for k, v in CATEGORY_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    pairs = center_inside_join(pc, boxes, page=page).withColumn("prio", prio[F.col("name")])
    keys = [*_record_key(pc), "cell_no"]
    carry = [c for c in pc.columns if c not in keys and c != "_levels"]
    best = pairs.groupBy(*keys).agg(F.max("prio").alias("prio"), *[F.first(c).alias(c) for c in carry])
    inv = F.create_map(*[x for k, v in CATEGORY_PRIORITY.items() for x in (F.lit(v), F.lit(k))])
    return best.withColumn("original_category", inv[F.col("prio")]).withColumn(
        "is_heading", F.when(F.col("original_category").isin(*HEADING_CATEGORIES), 1).otherwise(0)).drop("prio")


def noise_mask(text_col: str = "text"):
    """True for text to keep: stripped length >= 3, not digits only, and at
    least one letter, number, underscore or whitespace character."""
    t = T.py_strip(text_col)
    digits_only = t.rlike(rf"^{T.DIGIT}+\n?\z")
    no_word = t.rlike(rf"^[^\p{{L}}\p{{N}}_{T.WS}]*\n?\z")
    return (F.length(t) >= MIN_CELL_CHARS) & ~digits_only & ~no_word


def drop_noise_cells(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(noise_mask(text_col))


def _text_features(t: Column) -> list[Column]:
    """Training-mode features of a stripped text and its font."""
    return [
        t.alias("text"),
        F.col("font_size").cast("double").alias("font_size"),
        T.font_weight("font_name").alias("font_weight"),
        T.text_length(t).alias("text_length"),
        T.num_words(t).alias("num_words"),
        T.is_all_caps(t).alias("is_all_caps"),
        T.numbering_depth(t).alias("numbering_depth"),
        T.percent_punct(t).alias("percent_punct"),
    ]


def _place_features() -> list[Column]:
    return [
        F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.col("w").cast("double"),
                F.col("h").cast("double")).alias("bbox"),
        G.ieee_divide("x", "page_width").alias("norm_x"),
        G.ieee_divide("y", "page_height").alias("norm_y"),
        G.is_centered("x", "w", "page_width").alias("is_centered"),
    ]


FEATURE_COLUMNS = ["doc_name", "page_no", "original_category", "is_heading", "bbox", "text", "font_size", "font_weight",
                   "norm_x", "norm_y", "text_length", "num_words", "is_all_caps", "is_centered", "numbering_depth",
                   "percent_punct", "image_id", "cell_no"]


def cell_features(labeled: DataFrame) -> DataFrame:
    """Training-mode features of labelled cells: all text features on the
    stripped text, positions from the [x,y,w,h] box."""
    return labeled.select("doc_name", "page_no", "original_category", "is_heading", "image_id", "cell_no",
                          *_place_features(), *_text_features(T.py_strip("text"))).select(FEATURE_COLUMNS)


def labelled_features(images: DataFrame, cells: DataFrame, annotations: DataFrame, categories: DataFrame,
                      split_key: bool = False) -> DataFrame:
    """``cell_features`` of the labelled cells that are no noise.  Labels need
    boxes alone, so texts are left out of the containment join and the choice
    of a label: their features are computed where the cells lie, and meet the
    labels by one join.  A text moves once, and not at all if no later step
    reads it."""
    key = ["page_key", "cell_no"]
    texts = drop_noise_cells(cells).select(*key, *_text_features(T.py_strip("text"))).dropDuplicates(key)
    labeled = label_cells(images, cells.select(*key, "x", "y", "w", "h"), annotations, categories, split_key=split_key)
    placed = labeled.select("doc_name", "page_no", "original_category", "is_heading", "image_id", *key, *_place_features())
    return placed.join(texts, key).select(FEATURE_COLUMNS)


def region_text(images: DataFrame, cells: DataFrame, annotations: DataFrame, categories: DataFrame,
                split_key: bool = False) -> DataFrame:
    """One row per heading annotation: the contained cells sorted by x only
    (ties in cell order), stripped and joined by a space; mean cell size;
    weight of the leftmost cell; the annotation's own box.  Annotations
    containing no cell or only blank text are dropped."""
    page = page_key_columns(split_key)
    boxes = _boxes(annotations, categories, page, HEADING_CATEGORIES, extra=("ann_id",)) \
        .withColumnRenamed("name", "category")
    pc = _annotated_cells(images, cells, boxes, page)
    pairs = center_inside_join(pc, boxes, page=page)
    region_key = [*_record_key(pc), *(["ann_split"] if "ann_split" in boxes.columns else []), "ann_id"]
    parts = F.array_sort(F.collect_list(F.struct(F.col("x").alias("k1"), F.col("cell_no").alias("k2"),
                                                 T.py_strip("text").alias("t"), F.col("font_name").alias("f"))))
    agg = pairs.groupBy(*region_key).agg(
        parts.alias("parts"), F.avg("font_size").alias("font_size"),
        F.first("category").alias("category"), F.first("doc_name").alias("doc_name"),
        F.first("page_no").alias("page_no"), F.first("page_width").alias("page_width"),
        F.first("page_height").alias("page_height"),
        F.first("ax").alias("x"), F.first("ay").alias("y"), F.first("aw").alias("w"), F.first("ah").alias("h"))
    joined = T.py_strip(F.array_join(F.transform("parts", lambda p: p["t"]), " "))
    out = agg.select("*", joined.alias("text"), F.col("parts")[0]["f"].alias("first_font")).where(F.length("text") > 0)
    t = F.col("text")
    return out.select(
        "doc_name", "page_no", "category", "image_id", "ann_id",
        F.array("x", "y", "w", "h").alias("bbox"), "text",
        F.col("font_size").cast("double").alias("font_size"),
        T.font_weight("first_font").alias("font_weight"),
        G.ieee_divide("x", "page_width").alias("norm_x"),
        G.ieee_divide("y", "page_height").alias("norm_y"),
        T.text_length(t).alias("text_length"), T.num_words(t).alias("num_words"),
        T.is_all_caps(t).alias("is_all_caps"), G.is_centered("x", "w", "page_width").alias("is_centered"),
        T.numbering_depth(t).alias("numbering_depth"), T.percent_punct(t).alias("percent_punct"))


def assign_heading_levels(headings: DataFrame, key: str = "doc_name") -> DataFrame:
    """Per document, rows sorted by relative size desc, weight desc, norm_y
    asc; the level starts at 1 and rises by one each time the style
    (Python-rounded relative size to 0.1, weight) differs from the previous
    row; beyond H6 -> Other-Heading; Title rows are H1 whatever their rank.

    Rows with equal (relative size, weight) are contiguous in that order and
    share one style, so the level only changes between such groups: the
    running count runs over the document's distinct (size, weight) pairs --
    a table bounded by the document's distinct font sizes, not its rows --
    and is joined back.  No window ever spans a document's rows.  (NaN
    sizes form one group here; Python would count a change between every
    two NaN rows.)"""
    groups = headings.groupBy(key, "relative_font_size", "font_weight").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy(F.col("relative_font_size").desc(), F.col("font_weight").desc())
    style_r = RD.py_round1("relative_font_size")
    prev_r, prev_w = F.lag(style_r).over(w), F.lag("font_weight").over(w)
    same = style_r.eqNullSafe(prev_r) & (F.col("font_weight") == prev_w)
    changed = F.when(prev_w.isNull(), 0).when(same, 0).otherwise(1)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = groups.withColumn("_chg", changed).withColumn("_lvl", (F.sum("_chg").over(run) + 1).cast("int")) \
        .select(key, "relative_font_size", "font_weight", "_lvl")
    out = headings.join(levels, [key, "relative_font_size", "font_weight"], "left")
    lvl = F.col("_lvl")
    label = F.when(lvl <= MAX_HEADING_LEVEL, F.concat(F.lit("H"), lvl.cast("string"))).otherwise(F.lit(OTHER_HEADING))
    return out.withColumn("heading_level", F.when(F.col("category") == "Title", "H1").otherwise(label)).drop("_lvl")


def class_stats(df: DataFrame, label: str = "is_heading") -> DataFrame:
    """Count and percent per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    return counts.select(label, "n", (F.col("n") * 100.0 / F.sum("n").over(total)).alias("pct"))
