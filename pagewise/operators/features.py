"""Typographic and textual features of blocks and cells.

All features are Column expressions (no UDF).  The only shuffle is the
per-document body size: a partial ``mode`` aggregate (map-side combine), then
a join back on ``doc_id`` whose skew AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.functions import geometry as G
from pagewise.functions import text as T

# The eleven model features, in model order.
FEATURES = [
    "font_size", "font_weight", "norm_x", "norm_y", "text_length",
    "num_words", "is_all_caps", "is_centered", "numbering_depth",
    "relative_font_size", "percent_punct",
]

# Fixed value: body size when a document has no long text.
DEFAULT_BODY_SIZE = 10.0
# Fixed values: "long text" word counts for the body size (strictly more than).
INFER_BODY_MIN_WORDS = 6
TRAIN_BODY_MIN_WORDS = 5


def block_text_features(blocks: DataFrame) -> DataFrame:
    """Inference-mode features of blocks with (x0,y0,x1,y1) boxes: length,
    words and caps on the raw text, numbering on the stripped text."""
    t = F.col("text")
    return blocks.select(
        "*",
        T.font_weight("font_name").alias("font_weight"),
        F.col("x0").alias("x"), F.col("y0").alias("y"),
        (F.col("x1") - F.col("x0")).alias("w"),
        G.ieee_divide("x0", "page_width").alias("norm_x"),
        G.ieee_divide("y0", "page_height").alias("norm_y"),
        T.text_length(t).alias("text_length"),
        T.num_words(t).alias("num_words"),
        T.is_all_caps(t, length_of=T.py_strip(t)).alias("is_all_caps"),
        G.is_centered(F.col("x0"), F.col("x1") - F.col("x0"), F.col("page_width")).alias("is_centered"),
        T.numbering_depth(T.py_strip(t)).alias("numbering_depth"),
        T.percent_punct(t).alias("percent_punct"),
    )


def body_font_size(df: DataFrame, key: str = "doc_id", size_col: str = "font_size",
                   min_words: int = INFER_BODY_MIN_WORDS, candidates=None) -> DataFrame:
    """Modal font size per document over rows with more than ``min_words``
    words (and ``candidates`` if given); the smallest size on ties.
    Documents without such rows are absent (callers default to 10.0)."""
    rows = df.where(F.col("num_words") > min_words)
    if candidates is not None:
        rows = rows.where(candidates)
    return rows.groupBy(key).agg(F.mode(size_col, True).alias("body_font_size"))


def with_relative_font_size(df: DataFrame, body: DataFrame, key: str = "doc_id",
                            size_col: str = "font_size") -> DataFrame:
    """Attach ``body_font_size`` (default 10.0) and ``relative_font_size``."""
    out = df.join(body, on=key, how="left").withColumn(
        "body_font_size", F.coalesce(F.col("body_font_size"), F.lit(DEFAULT_BODY_SIZE)))
    return out.withColumn("relative_font_size", G.ieee_divide(size_col, "body_font_size"))


def select_features(df: DataFrame, keep=()) -> DataFrame:
    """The eleven model columns in model order (plus ``keep`` key columns)."""
    return df.select(*keep, *FEATURES)


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    """Non-numeric values and NaN become 0 (numeric strings are parsed)."""
    out = df
    for c in cols:
        v = T.to_number(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
        out = out.withColumn(c, F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return out


def block_profile(feats: DataFrame, key: str = "doc_id") -> DataFrame:
    """Row count and distinct text count per document."""
    return feats.groupBy(key).agg(F.count(F.lit(1)).alias("n_blocks"),
                                  F.countDistinct("text").alias("n_texts"))


# The inspection columns of find_blocks.
INSPECT_COLUMNS = ["page_num", "font_size", "relative_font_size", "numbering_depth",
                   "percent_punct", "is_all_caps", "is_centered"]


def find_blocks(feats: DataFrame, text, key: str = "doc_id") -> DataFrame:
    """Rows whose stripped text equals ``text`` (a literal or a Column)."""
    value = text if not isinstance(text, str) else F.lit(text)
    return feats.where(T.py_strip("text") == value).select(key, "block_no", *INSPECT_COLUMNS)
