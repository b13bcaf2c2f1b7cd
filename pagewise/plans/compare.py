"""Compare predicted with expected outlines (set precision/recall/F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.operators import metrics as M


def compare_outlines(expected: DataFrame, actual: DataFrame, exp_docs: DataFrame, act_docs: DataFrame,
                     key: str = "doc_id") -> dict[str, DataFrame]:
    """Per-document metrics, their macro averages and the skipped documents."""
    per_doc = M.outline_metrics(expected, actual, exp_docs, act_docs, key)
    return {"per_doc": per_doc, "average": M.outline_metrics_avg(per_doc),
            "missing": M.outline_missing(exp_docs, act_docs, key)}


def compare_summary(expected: DataFrame, actual: DataFrame, exp_docs: DataFrame, act_docs: DataFrame,
                    key: str = "doc_id") -> DataFrame:
    """One row: documents compared, documents skipped (no actual outline)
    and the six macro averages -- a single aggregation over the expected
    documents' counts."""
    counts = M.outline_counts(expected, actual, exp_docs, act_docs, key).where("in_exp")
    ratios = M.outline_ratios(counts, key, "in_act")
    cols = ["text_recall", "text_precision", "text_f1", "pair_recall", "pair_precision", "pair_f1"]
    return ratios.agg(F.count_if("in_act").alias("n_docs"), F.count_if(~F.col("in_act")).alias("n_missing"),
                      *[F.avg(F.when(F.col("in_act"), F.col(c))).alias(f"avg_{c}") for c in cols])
