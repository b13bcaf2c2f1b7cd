"""Training-set builders over annotated pages.

``build_cell_dataset``: page/cell equi join, bucketed containment join with
the annotation boxes, label priority per cell, noise filter, features, body
size per document and the relative size.  ``build_heading_dataset``: one
row per heading annotation with its region text, relative size and an H1..H6
level from the document's style ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.operators import features as FE
from pagewise.operators import labels as L
from pagewise.session import materialize

CELL_COLUMNS = ["doc_name", "page_no", "original_category", "is_heading", "bbox", "text", "font_size",
                "font_weight", "norm_x", "norm_y", "text_length", "num_words", "is_all_caps", "is_centered",
                "numbering_depth", "percent_punct", "body_font_size", "relative_font_size"]


def build_cell_dataset(images: DataFrame, annotations: DataFrame, categories: DataFrame,
                       cells: DataFrame, keep_ids: bool = False, materialize_cells: str | None = None,
                       split_key: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """The labelled cell features are read twice (body-size aggregate and
    the join back), so they are materialised once (``pagewise.materialize``
    unless ``materialize_cells`` says otherwise).  ``only`` these columns are
    stored and joined if given: training needs neither texts nor boxes."""
    feats = L.labelled_features(images, cells, annotations, categories, split_key=split_key)
    if only is not None:
        needed = {*only, "doc_name", "is_heading", "font_size", "num_words"}
        feats = feats.select(*[c for c in feats.columns if c in needed])
    if materialize_cells != "none":
        feats = materialize(feats, materialize_cells, columnar=True)
    body = FE.body_font_size(feats, key="doc_name", min_words=FE.TRAIN_BODY_MIN_WORDS,
                             candidates=F.col("is_heading") == 0)
    out = FE.with_relative_font_size(feats, body, key="doc_name")
    cols = CELL_COLUMNS + (["image_id", "cell_no"] if keep_ids else [])
    return out.select(*(cols if only is None else only))


def build_heading_dataset(images: DataFrame, annotations: DataFrame, categories: DataFrame,
                          cells: DataFrame, materialize_regions: str | None = None,
                          split_key: bool = False) -> DataFrame:
    regions = L.region_text(images, cells, annotations, categories, split_key=split_key)
    if materialize_regions != "none":
        regions = materialize(regions, materialize_regions, columnar=True)
    body = FE.body_font_size(regions, key="doc_name", min_words=FE.TRAIN_BODY_MIN_WORDS)
    rel = FE.with_relative_font_size(regions, body, key="doc_name")
    return L.assign_heading_levels(rel)
