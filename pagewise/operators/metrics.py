"""Classification and outline metrics as aggregations.

Every metric is a single pass of conditional sums (partial aggregation),
except the two that need an order over scores:

* ``roc_auc`` first aggregates to one row per distinct score, then takes a
  prefix sum over scores in two levels (monotone buckets -> bucket offsets
  -> running sum inside a bucket), so no window ever sees all rows.
* ``threshold_sweep`` maps each row to the number of thresholds below its
  probability (81 comparisons, JVM-side), counts per (bin, label) -- at most
  82 x 2 rows -- and takes suffix sums over that tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The probability thresholds swept, 0.1 to 0.9 in 81 steps
# (numpy linspace rule: start + i * step, last value exactly the stop).
SWEEP_START, SWEEP_STOP, SWEEP_NUM = 0.1, 0.9, 81
DEFAULT_THRESHOLD = 0.5
AUC_BUCKETS = 65536   # monotone score buckets of the two-level prefix sum


def sweep_thresholds(start: float = SWEEP_START, stop: float = SWEEP_STOP, num: int = SWEEP_NUM) -> list[float]:
    step = (stop - start) / (num - 1)
    return [i * step + start for i in range(num - 1)] + [stop]


def _safe_ratio(num, den, empty):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(empty))


def _f1(p, r):
    return F.when((p + r) > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """The full 2 x 2 grid (label, prediction, n), zeros included."""
    c = confusion_counts(df, label, pred)
    return c.select(F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (label, prediction, n)"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy and precision/recall/F1 of the positive class (0 when
    undefined, as the usual zero-division convention)."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    n = tp + fp + fn + tn
    prec = _safe_ratio(tp, tp + fp, 0.0)
    rec = _safe_ratio(tp, tp + fn, 0.0)
    return c.select(n.alias("n"), _safe_ratio(tp + tn, n, 0.0).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _f1(prec, rec).alias("f1"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' with
    precision, recall, f1 and support (accuracy sits in f1)."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    n = tp + fp + fn + tn
    p1, r1 = _safe_ratio(tp, tp + fp, 0.0), _safe_ratio(tp, tp + fn, 0.0)
    p0, r0 = _safe_ratio(tn, tn + fn, 0.0), _safe_ratio(tn, tn + fp, 0.0)
    s1, s0 = tp + fn, tn + fp
    per = c.select(p0.alias("p0"), r0.alias("r0"), _f1(p0, r0).alias("f0"), s0.alias("s0"),
                   p1.alias("p1"), r1.alias("r1"), _f1(p1, r1).alias("f1"), s1.alias("s1"),
                   _safe_ratio(tp + tn, n, 0.0).alias("acc"), n.alias("n"))
    return per.select(F.expr("""stack(5,
        '0', p0, r0, f0, s0,
        '1', p1, r1, f1, s1,
        'accuracy', cast(null as double), cast(null as double), acc, n,
        'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n,
        'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n)
        as (name, precision, recall, f1, support)"""))


def _monotone_bucket(score, buckets: int):
    """Order-preserving bucket of any real score (atan maps R onto (-pi/2, pi/2))."""
    u = F.atan(score) / F.lit(3.141592653589793) + 0.5
    return F.least(F.greatest(F.floor(u * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")


def score_histogram(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """Positives and negatives per distinct score (map-side combined)."""
    y = F.col(label)
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg"))


def negatives_below(hist: DataFrame, buckets: int = AUC_BUCKETS) -> DataFrame:
    """Add ``neg_below``: negatives with a strictly smaller score, by a
    two-level prefix sum (bucket offsets + running sum inside the bucket)."""
    h = hist.withColumn("_b", _monotone_bucket(F.col("score"), buckets))
    per_b = h.groupBy("_b").agg(F.sum("neg").alias("_nb"))
    offs = per_b.select("_b", F.coalesce(F.sum("_nb").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # At most ``buckets`` rows: bounded, broadcast.
    h = h.join(F.broadcast(offs), "_b")
    run = Window.partitionBy("_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("neg_below", F.col("_off") + F.coalesce(F.sum("neg").over(run), F.lit(0))).drop("_b", "_off")


def roc_auc(df: DataFrame, label: str = "label", score: str = "probability", buckets: int = AUC_BUCKETS) -> DataFrame:
    """Area under the ROC curve with ties counted one half (Mann-Whitney);
    null when a class is absent."""
    h = negatives_below(score_histogram(df, label, score), buckets)
    s = h.agg(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_u"),
              F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return s.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                           F.col("_u") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc"))


def threshold_sweep(df: DataFrame, label: str = "label", prob: str = "probability",
                    thresholds: list[float] | None = None) -> DataFrame:
    """F1 of the positive class for each threshold (prediction p > t)."""
    ts = thresholds or sweep_thresholds()
    arr = F.array(*[F.lit(float(t)) for t in ts])
    binned = df.select(F.size(F.filter(arr, lambda t: F.col(prob) > t)).alias("bin"), F.col(label).alias("y"))
    counts = binned.groupBy("bin").agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"),
                                       F.count(F.when(F.col("y") == 0, 1)).alias("neg"))
    # Dense table of the bins 0..len(ts) (equi join), then suffix sums over
    # it: threshold i predicts positive exactly for the rows with bin > i.
    # Both windows run over len(ts) + 1 rows, a fixed bound.
    spark = df.sparkSession
    dense = spark.range(len(ts) + 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    everyone = Window.partitionBy()
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.select(
        F.col("bin").alias("i"), F.try_element_at(arr, F.col("bin") + 1).alias("threshold"),
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
        F.sum("pos").over(everyone).alias("P"))
    res = dense.where(F.col("i") < len(ts))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("P") - F.col("tp")
    f1 = F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return res.select("i", "threshold", "tp", "fp", fn.alias("fn"), f1.alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold with the highest F1; the default 0.5 when no
    threshold beats F1 = 0."""
    best = sweep.agg(F.max_by(F.struct("i", "threshold"), F.struct(F.col("f1"), -F.col("i"))).alias("b"),
                     F.max("f1").alias("best_f1"))
    return best.select(F.when(F.col("best_f1") > 0, F.col("b.threshold")).otherwise(F.lit(DEFAULT_THRESHOLD))
                       .alias("threshold"), F.greatest(F.col("best_f1"), F.lit(0.0)).alias("f1"))


def cv_summary(fold_scores: DataFrame, col: str = "auc") -> DataFrame:
    """Mean, population std and twice the std of per-fold scores."""
    return fold_scores.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                           (2 * F.stddev_pop(col)).alias("two_std"), F.count(col).alias("folds"))


def fold_auc(df: DataFrame, fold: str = "fold", label: str = "label", score: str = "probability",
             buckets: int = AUC_BUCKETS) -> DataFrame:
    """AUC per fold: one histogram per (fold, score), prefix sums per fold."""
    y = F.col(label)
    hist = df.groupBy(fold, F.col(score).alias("score")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg"))
    h = hist.withColumn("_b", _monotone_bucket(F.col("score"), buckets))
    per_b = h.groupBy(fold, "_b").agg(F.sum("neg").alias("_nb"))
    offs = per_b.select(fold, "_b", F.coalesce(F.sum("_nb").over(
        Window.partitionBy(fold).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    h = h.join(offs, [fold, "_b"])
    run = Window.partitionBy(fold, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("neg_below", F.col("_off") + F.coalesce(F.sum("neg").over(run), F.lit(0)))
    s = h.groupBy(fold).agg(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_u"),
                            F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return s.select(fold, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                 F.col("_u") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc"))


# ------------------------------------------------------------------ outlines
def _texts(outline: DataFrame, key: str) -> DataFrame:
    from pagewise.functions.text import py_strip
    return outline.select(key, F.coalesce(F.col("level"), F.lit("")).alias("level"),
                          py_strip(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


# Side bits of an outline entry or of a document.
_EXP, _ACT, _EXP_DOC, _ACT_DOC = 1, 2, 4, 8


def _side_bits(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(doc, level, text, bits): distinct entries and the sides that have them."""
    both = _texts(expected, key).withColumn("bits", F.lit(_EXP)).unionByName(_texts(actual, key).withColumn("bits", F.lit(_ACT)))
    return both.groupBy(key, "level", "text").agg(F.bit_or("bits").alias("bits"))


def outline_intersect(expected: DataFrame, actual: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct (doc, level, stripped text) present on both sides."""
    return _side_bits(expected, actual, key).where(F.col("bits") == _EXP | _ACT).drop("bits")


def outline_counts(expected: DataFrame, actual: DataFrame, exp_docs: DataFrame, act_docs: DataFrame,
                   key: str = "doc_id") -> DataFrame:
    """Per document of any table the sizes and matches of its distinct (level,
    text) pairs (``p_*``) and texts (``t_*``), ``in_exp`` and ``in_act``.

    One scan a table and three aggregates, each with map-side combine: pairs
    with the bits of the sides that have them, texts with the pairs' bits,
    documents with the texts' counts.  Documents come in as rows without a
    text, so no join is needed.  A null document is none."""
    def docs(df, bit):
        return df.select(key, F.lit(None).cast("string").alias("text"), F.lit(bit).alias("bits"),
                         *[F.lit(0).cast("long").alias(c) for c in ("p_exp", "p_act", "p_match")])

    def has(bits, side):
        return F.col(bits).bitwiseAND(side) == side

    pairs = _side_bits(expected, actual, key).select(
        key, "text", "bits", has("bits", _EXP).cast("long").alias("p_exp"), has("bits", _ACT).cast("long").alias("p_act"),
        has("bits", _EXP | _ACT).cast("long").alias("p_match"))
    every = pairs.unionByName(docs(exp_docs, _EXP_DOC)).unionByName(docs(act_docs, _ACT_DOC)).where(F.col(key).isNotNull())
    texts = every.groupBy(key, "text").agg(F.bit_or("bits").alias("bits"), *[F.sum(c).alias(c) for c in ("p_exp", "p_act", "p_match")])
    return texts.groupBy(key).agg(
        F.max(has("bits", _EXP_DOC)).alias("in_exp"), F.max(has("bits", _ACT_DOC)).alias("in_act"),
        F.count_if(has("bits", _EXP)).alias("t_exp"), F.count_if(has("bits", _ACT)).alias("t_act"),
        F.count_if(has("bits", _EXP | _ACT)).alias("t_match"), *[F.sum(c).alias(c) for c in ("p_exp", "p_act", "p_match")])


def outline_ratios(counts: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    """Recall, precision and F1 of ``outline_counts`` rows.  Empty expected ->
    recall 1, empty actual -> precision 1, both zero -> F1 0."""
    out = counts.select(
        key, *keep, F.col("p_exp").alias("n_exp_pairs"), F.col("p_act").alias("n_act_pairs"),
        F.col("t_match").alias("text_matches"),
        _safe_ratio(F.col("t_match"), F.col("t_exp"), 1.0).alias("text_recall"),
        _safe_ratio(F.col("t_match"), F.col("t_act"), 1.0).alias("text_precision"),
        F.col("p_match").alias("pair_matches"),
        _safe_ratio(F.col("p_match"), F.col("p_exp"), 1.0).alias("pair_recall"),
        _safe_ratio(F.col("p_match"), F.col("p_act"), 1.0).alias("pair_precision"))
    return out.withColumn("text_f1", _f1(F.col("text_precision"), F.col("text_recall"))).withColumn(
        "pair_f1", _f1(F.col("pair_precision"), F.col("pair_recall")))


def outline_metrics(expected: DataFrame, actual: DataFrame, exp_docs: DataFrame, act_docs: DataFrame,
                    key: str = "doc_id") -> DataFrame:
    """Per document with both an expected and an actual outline: set sizes,
    matches, recall, precision and F1 over distinct stripped texts and over
    distinct (level, text) pairs (``outline_ratios``)."""
    counts = outline_counts(expected, actual, exp_docs, act_docs, key)
    return outline_ratios(counts.where(F.col("in_exp") & F.col("in_act")), key)


def outline_metrics_avg(per_doc: DataFrame) -> DataFrame:
    """Unweighted mean of the six ratios over documents."""
    cols = ["text_recall", "text_precision", "text_f1", "pair_recall", "pair_precision", "pair_f1"]
    return per_doc.agg(F.count(F.lit(1)).alias("n_docs"), *[F.avg(c).alias(f"avg_{c}") for c in cols])


def outline_missing(exp_docs: DataFrame, act_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Expected documents without an actual outline (skipped by the compare)."""
    return exp_docs.select(key).distinct().join(act_docs.select(key), key, "left_anti")

