"""Train and evaluate the heading classifier (distributed end to end).

Stages: coerce features -> stratified 64/16/20 split -> oversample the
minority class in the training part -> grid search with early stopping on
the validation part -> final fit with more trees -> threshold sweep on the
validation part -> validation and test metrics at the tuned threshold ->
confusion matrix, classification report, AUC -> importances -> 5-fold CV
AUC (fixed parameters, balanced weights, no oversampling) -> save.

The labelled table, the split and the training frame are checkpointed to
the shared checkpoint folder (``spark.checkpoint.dir``): 15 fits reuse them,
and a lost executor does not send the fits back to the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.operators import metrics as M
from pagewise.operators import ml as ML
from pagewise.operators import sampling as S
from pagewise.operators.features import FEATURES
from pagewise.session import cut_lineage


def split_and_balance(df: DataFrame, id_cols, seed: int = S.SEED) -> DataFrame:
    """Prepared rows with ``split`` and, for train/val rows, the oversampled
    training rows plus the ``is_val`` flag and balanced ``weight``.  Only the
    ids, the features and the label go through the shuffles and stored tables."""
    prepared = ML.prepare(df).select(*id_cols, *FEATURES, "label")
    split = S.stratified_split(prepared, "label", id_cols, seed=seed)
    return split


def training_frame(split: DataFrame, id_cols) -> DataFrame:
    """Oversampled training rows + validation rows (flag ``is_val``), with
    balanced class weights computed on the oversampled training part."""
    train = split.where(F.col("split") == "train").drop("class_rank", "class_n", "n_test")
    val = split.where(F.col("split") == "val").drop("class_rank", "class_n", "n_test")
    over = S.random_oversample(train, "label", id_cols).drop("draw")
    over = S.balanced_weights(over, "label")
    val = val.withColumn("weight", F.lit(1.0))
    return over.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))


def cross_validate(split: DataFrame, id_cols, cfg: ML.TrainConfig, k: int = 5, leaves: int = 31,
                   rate: float = 0.05, max_iter: int | None = None) -> DataFrame:
    """AUC per fold on the 80 % part with fixed parameters and balanced
    weights (no oversampling, no early stopping).  The k fits are
    independent, share the binned rows and run side by side; the fold table
    is checkpointed once for all of them."""
    from concurrent.futures import ThreadPoolExecutor
    base = split.where(F.col("split") != "test").drop("class_rank", "class_n", "n_test", "split")
    folds = S.stratified_folds(base, "label", id_cols, k=k, test_size=0.0)
    folds = cut_lineage(S.balanced_weights(folds, "label"))
    fits = ML.fit_folds(folds, k, ML.LEAVES_TO_DEPTH[leaves], rate, max_iter or cfg.max_iter, cfg)

    def run(f):
        return ML.score(fits[f](), folds.where(F.col("fold") == f)).select("fold", "label", "probability")

    with ThreadPoolExecutor(max_workers=max(1, cfg.parallelism)) as pool:
        parts = list(pool.map(run, range(k)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return M.fold_auc(scored)


def train_and_evaluate(df: DataFrame, id_cols, cfg: ML.TrainConfig | None = None, model_path: str | None = None,
                       cv_folds: int = 5) -> dict:
    """Run the whole training programme; returns a dict of small result
    DataFrames and scalars."""
    cfg = cfg or ML.TrainConfig()
    split = cut_lineage(split_and_balance(cut_lineage(df), id_cols, cfg.seed))
    tv = cut_lineage(training_frame(split, id_cols))
    grid = ML.grid_search(tv, cfg)
    best = ML.pick_best(grid)
    final = ML.fit_early(tv, best["max_depth"], best["learning_rate"], cfg.final_max_iter, cfg.final_patience, cfg)
    model = final.model
    val = split.where(F.col("split") == "val")
    test = split.where(F.col("split") == "test")
    val_scored = ML.score(model, val)
    sweep = M.threshold_sweep(val_scored)
    thr_row = M.best_threshold(sweep).first()
    threshold = float(thr_row["threshold"])
    val_t = ML.score(model, val, threshold)
    test_t = ML.score(model, test, threshold)
    importance = ML.feature_importance(model)
    cv = cross_validate(split, id_cols, cfg, k=cv_folds)
    cv_sum = M.cv_summary(cv)
    if model_path:
        ML.save_model(model, model_path, threshold)
    return {
        "grid": grid, "best": best, "model": model, "trees": final.trees, "trees_fitted": final.fitted,
        "loss_curve": final.curve, "threshold": threshold, "sweep": sweep,
        "val_metrics": M.binary_metrics(val_t), "val_auc": M.roc_auc(val_t),
        "val_report": M.classification_report(val_t),
        "test_metrics": M.binary_metrics(test_t), "test_auc": M.roc_auc(test_t),
        "test_report": M.classification_report(test_t), "confusion": M.confusion_matrix(test_t),
        "importance": importance, "cv": cv, "cv_summary": cv_sum,
        "counts": split.groupBy("split", "label").count(),
    }
