"""Spans -> lines -> blocks.

Physical plan: ``spans_to_lines`` aggregates on (doc, page, line) with a
partial (map-side) aggregate; ``group_lines`` is a gaps-and-islands window
keyed by the *page* (doc_id, page_num), never by the document, so one huge
document spreads over as many tasks as it has pages; ``lines_to_blocks``
groups by (doc, page, block) and reuses the window's hash partitioning (no
extra exchange).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.functions.text import font_weight, is_blank, py_strip

# Fixed values of the line-merging rule: a line continues the block when the
# vertical gap is below half the previous line's size, the sizes differ by
# less than one point and the font weights are equal.
GAP_SHARE = 0.5
SIZE_DIFF = 1.0


def text_spans(spans: DataFrame) -> DataFrame:
    """Drop spans of non-text blocks (``block_type != 0``)."""
    if "block_type" in spans.columns:
        return spans.where(F.col("block_type") == 0)
    return spans


def spans_to_lines(spans: DataFrame, line_key=("doc_id", "page_num", "line_no")) -> DataFrame:
    """Line text = stripped non-blank span texts joined by a space, in span
    order; size = mean over all spans (blank ones too); font = most frequent
    span font, the smallest name on ties; box = union of span boxes.
    Lines whose text is blank are dropped."""
    s = text_spans(spans)
    parts = F.array_sort(F.collect_list(
        F.when(~is_blank("text"), F.struct(F.col("span_no"), py_strip("text").alias("t")))))
    agg = s.groupBy(*line_key).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.avg("size").alias("size"),
        F.mode("font", True).alias("font"),
        F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"),
    )
    return agg.where(F.length("text") > 0)


def group_lines(lines: DataFrame, order_tiebreak: str = "line_no", key: str = "doc_id") -> DataFrame:
    """Assign ``block_no`` (1-based within the page): lines sorted by y0
    (ties in original line order) start a new block unless they continue the
    directly previous line."""
    w = Window.partitionBy(key, "page_num").orderBy("y0", order_tiebreak)
    wt = font_weight("font")
    prev_y1, prev_size, prev_wt = F.lag("y1").over(w), F.lag("size").over(w), F.lag(wt).over(w)
    size = F.col("size")
    continues = (
        ~F.isnan(size) & ~F.isnan(prev_size) & ~F.isnan(F.col("y0")) & ~F.isnan(prev_y1)
        & ((F.col("y0") - prev_y1) < prev_size * GAP_SHARE)
        & (F.abs(size - prev_size) < SIZE_DIFF)
        & (wt == prev_wt)
    )
    starts = F.when(prev_size.isNull() & prev_y1.isNull(), 1).when(continues, 0).otherwise(1)
    flagged = lines.withColumn("_start", starts)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("block_no", F.sum("_start").over(running).cast("int")).drop("_start")


def lines_to_blocks(grouped: DataFrame, order_tiebreak: str = "line_no", key: str = "doc_id") -> DataFrame:
    """One row per block: text of its lines joined in order, the union box,
    and the first line's size and font."""
    order = F.struct(F.col("y0"), F.col(order_tiebreak))
    parts = F.array_sort(F.collect_list(F.struct(F.col("y0").alias("k1"), F.col(order_tiebreak).alias("k2"),
                                                 F.col("text").alias("t"))))
    return grouped.groupBy(key, "page_num", "block_no").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min_by("size", order).alias("font_size"),
        F.min_by("font", order).alias("font_name"),
        F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"),
        F.count(F.lit(1)).cast("int").alias("n_lines"),
    )


def merge_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``group_lines`` followed by ``lines_to_blocks``."""
    return lines_to_blocks(group_lines(lines, key=key), key=key)
