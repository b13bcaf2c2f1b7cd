"""Registered queries: one callable (spark, sf_dir) -> DataFrame per
operator of the inventory, each over the whole driver tables (or data Spark
derives from them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.operators import blocks as B
from pagewise.operators import features as FE
from pagewise.operators import labels as L
from pagewise.operators import language as LG
from pagewise.operators import metrics as M
from pagewise.operators import ml as ML
from pagewise.operators import outline as O
from pagewise.operators import rules as R
from pagewise.operators import sampling as S
from pagewise.operators import trees as TR
from pagewise.plans import compare as PC
from pagewise.plans import datasets as PD
from pagewise.plans import outlines as PO
from pagewise.plans import training as PT
from pagewise.session import cut_lineage, stage
from pagewise.sources import coco as CO
from pagewise.sources import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
#: A split is 128 MB at most: 8 MB of documents, some 2.5 million words, a task.
SPREAD = 16


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.read_table(spark, sf_dir, "documents")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` by doc_id in SPREAD times as many partitions: a document gives a
    row per word, and a task with the words of a whole split sorts them on disk.
    Lines of a document then need no shuffle of their own."""
    return docs.repartition(SPREAD * docs.rdd.getNumPartitions(), "doc_id")


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.layout_lines(documents(spark, sf_dir))


@register("extract_outlines")
def q_extract_outlines(spark, sf_dir):
    return PO.extract_outlines(layout_lines(spark, sf_dir))


# ------------------------------------------------------------------ blocks


def block_feats(spark, sf_dir):
    return PO.block_features(layout_lines(spark, sf_dir))


def leveled(spark, sf_dir):
    feats = block_feats(spark, sf_dir)
    return PO.outline_entries(PO.heading_candidates(feats))


@register("spans_to_lines")
def q_spans_to_lines(spark, sf_dir):
    lines = B.spans_to_lines(FX.spans(spread(documents(spark, sf_dir))))
    return lines.withColumn("size", F.round("size", 9))


@register("group_lines")
def q_group_lines(spark, sf_dir):
    return B.group_lines(layout_lines(spark, sf_dir)).select("doc_id", "page_num", "line_no", "block_no")


@register("lines_to_blocks")
def q_lines_to_blocks(spark, sf_dir):
    return B.merge_lines(layout_lines(spark, sf_dir))


@register("text_features")
def q_text_features(spark, sf_dir):
    blocks = FE.block_text_features(B.merge_lines(layout_lines(spark, sf_dir)))
    return blocks.select("doc_id", "page_num", "block_no", "font_weight", "norm_x", "norm_y", "text_length",
                         "num_words", "is_all_caps", "is_centered", "numbering_depth", "percent_punct")


@register("body_font_size_infer")
def q_body_font_size_infer(spark, sf_dir):
    feats = FE.block_text_features(B.merge_lines(layout_lines(spark, sf_dir)))
    return FE.body_font_size(feats, min_words=FE.INFER_BODY_MIN_WORDS)


@register("relative_font_size")
def q_relative_font_size(spark, sf_dir):
    return block_feats(spark, sf_dir).select("doc_id", "page_num", "block_no", "body_font_size",
                                            "relative_font_size")


@register("block_features")
def q_block_features(spark, sf_dir):
    return FE.select_features(block_feats(spark, sf_dir), keep=("doc_id", "page_num", "block_no", "text"))


@register("select_features")
def q_select_features(spark, sf_dir):
    return FE.select_features(block_feats(spark, sf_dir))


@register("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    words = FX.spans(documents(spark, sf_dir)).select("doc_id", "line_no", "span_no",
                                                       F.col("text").alias("value"))
    return FE.coerce_numeric(words, ["value"])


@register("running_headers")
def q_running_headers(spark, sf_dir):
    return R.running_headers(block_feats(spark, sf_dir))


@register("drop_running_headers")
def q_drop_running_headers(spark, sf_dir):
    feats = block_feats(spark, sf_dir)
    kept = R.drop_running_headers(feats, R.running_headers(feats))
    return kept.select("doc_id", "page_num", "block_no")


@register("heading_rules")
def q_heading_rules(spark, sf_dir):
    return R.apply_heading_rules(block_feats(spark, sf_dir)).select("doc_id", "page_num", "block_no", "text")


@register("score_blocks")
def q_score_blocks(spark, sf_dir):
    scored = O.fixed_score(block_feats(spark, sf_dir))
    return scored.select("doc_id", "page_num", "block_no", F.round("score", 9).alias("score"), "is_heading")


@register("order_headings")
def q_order_headings(spark, sf_dir):
    return leveled(spark, sf_dir).select("doc_id", "seq", "page_num", "block_no")


@register("outline_levels")
def q_outline_levels(spark, sf_dir):
    return leveled(spark, sf_dir).select("doc_id", "seq", "level")


@register("detect_title")
def q_detect_title(spark, sf_dir):
    return O.detect_title(leveled(spark, sf_dir))


@register("build_outline")
def q_build_outline(spark, sf_dir):
    nested = PO.nested_outline(PO.extract_outlines(layout_lines(spark, sf_dir)))
    lines = F.transform("outline", lambda e: F.concat_ws("|", e["level"], e["text"], e["page"].cast("string")))
    return nested.select("doc_id", "title", F.size("outline").alias("n_entries"),
                         F.array_join(lines, "\n").alias("outline_text"))


@register("find_blocks")
def q_find_blocks(spark, sf_dir):
    return FE.find_blocks(block_feats(spark, sf_dir), "Document version")


@register("block_profile")
def q_block_profile(spark, sf_dir):
    return FE.block_profile(block_feats(spark, sf_dir))


# ---------------------------------------------------------------- labelling


def coco(spark, sf_dir):
    return FX.coco_tables(spark, documents(spark, sf_dir))


@register("join_pages_cells")
def q_join_pages_cells(spark, sf_dir):
    images, _, _, cells = coco(spark, sf_dir)
    return L.join_pages_cells(images, cells).select("image_id", "page_key", "cell_no", "doc_name", "page_no")


@register("center_inside_join")
def q_center_inside_join(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    pc = L.join_pages_cells(images, cells)
    boxes = anns.select("image_id", "ann_id", F.col("x").alias("ax"), F.col("y").alias("ay"),
                        F.col("w").alias("aw"), F.col("h").alias("ah"))
    return L.center_inside_join(pc, boxes).select("image_id", "cell_no", "ann_id")


@register("label_cells")
def q_label_cells(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    return L.label_cells(images, cells, anns, cats).select("image_id", "cell_no", "original_category", "is_heading")


@register("drop_noise_cells")
def q_drop_noise_cells(spark, sf_dir):
    _, _, _, cells = coco(spark, sf_dir)
    return L.drop_noise_cells(cells).select("page_key", "cell_no")


@register("build_cell_dataset")
def q_build_cell_dataset(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    return PD.build_cell_dataset(images, anns, cats, cells)


@register("body_font_size_train")
def q_body_font_size_train(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    feats = L.cell_features(L.drop_noise_cells(L.label_cells(images, cells, anns, cats)))
    return FE.body_font_size(feats, key="doc_name", min_words=FE.TRAIN_BODY_MIN_WORDS,
                             candidates=F.col("is_heading") == 0)


@register("class_stats")
def q_class_stats(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    return L.class_stats(PD.build_cell_dataset(images, anns, cats, cells))


@register("region_text")
def q_region_text(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    r = L.region_text(images, cells, anns, cats)
    return r.select("image_id", "ann_id", "category", "text", F.round("font_size", 9).alias("font_size"),
                    "font_weight", "norm_x", "norm_y", "num_words")


@register("body_font_size_heading")
def q_body_font_size_heading(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    return FE.body_font_size(L.region_text(images, cells, anns, cats), key="doc_name",
                             min_words=FE.TRAIN_BODY_MIN_WORDS)


@register("assign_heading_levels")
def q_assign_heading_levels(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    return PD.build_heading_dataset(images, anns, cats, cells).select("doc_name", "image_id", "ann_id",
                                                                     "heading_level")


@register("build_heading_dataset")
def q_build_heading_dataset(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    out = PD.build_heading_dataset(images, anns, cats, cells)
    return out.select("doc_name", "page_no", "category", "text", F.round("font_size", 9).alias("font_size"),
                      "font_weight", "norm_x", "norm_y", "text_length", "num_words", "is_all_caps", "is_centered",
                      "numbering_depth", "percent_punct", F.round("body_font_size", 9).alias("body_font_size"),
                      F.round("relative_font_size", 9).alias("relative_font_size"), "heading_level")


# --------------------------------------------------------------- evaluation


def scored_probs(spark, sf_dir):
    """The scored fixture with ``probability`` in [0, 1] and the class at 0.5."""
    s = FX.scored(FX.read_table(spark, sf_dir, "labels"))
    s = s.withColumn("probability", F.col("score_milli") / 1000.0)
    return O.apply_threshold(s, M.DEFAULT_THRESHOLD)


@register("apply_threshold")
def q_apply_threshold(spark, sf_dir):
    return scored_probs(spark, sf_dir).select("doc_id", "label", "prediction")


@register("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(scored_probs(spark, sf_dir))


@register("binary_metrics")
def q_binary_metrics(spark, sf_dir):
    return M.binary_metrics(scored_probs(spark, sf_dir))


@register("classification_report")
def q_classification_report(spark, sf_dir):
    return M.classification_report(scored_probs(spark, sf_dir))


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(scored_probs(spark, sf_dir)).select(F.round("auc", 12).alias("auc"))


@register("threshold_sweep")
def q_threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(scored_probs(spark, sf_dir))


@register("best_threshold")
def q_best_threshold(spark, sf_dir):
    return M.best_threshold(M.threshold_sweep(scored_probs(spark, sf_dir)))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    return S.stratified_split(scored_probs(spark, sf_dir), "label", ["doc_id"]).select("doc_id", "label", "split")


@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    return S.stratified_folds(scored_probs(spark, sf_dir), "label", ["doc_id"]).select("doc_id", "label", "fold")


@register("random_oversample")
def q_random_oversample(spark, sf_dir):
    s = FX.scored(FX.read_table(spark, sf_dir, "labels"))
    return S.random_oversample(s, "label", ["doc_id"]).select("doc_id", "label", "score_milli", "draw")


@register("balanced_weights")
def q_balanced_weights(spark, sf_dir):
    s = FX.scored(FX.read_table(spark, sf_dir, "labels"))
    return S.balanced_weights(s, "label").select("doc_id", "label", F.round("weight", 12).alias("weight"))


@register("cv_summary")
def q_cv_summary(spark, sf_dir):
    folds = S.stratified_folds(scored_probs(spark, sf_dir), "label", ["doc_id"])
    return M.cv_summary(M.fold_auc(folds)).select(
        F.round("mean", 12).alias("mean"), F.round("std", 12).alias("std"), F.round("two_std", 12).alias("two_std"),
        "folds")


def outlines_pair(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return (FX.expected_outline(docs), FX.actual_outline(docs), FX.expected_docs(docs), FX.actual_docs(docs))


@register("outline_metrics")
def q_outline_metrics(spark, sf_dir):
    return M.outline_metrics(*outlines_pair(spark, sf_dir))


@register("outline_metrics_avg")
def q_outline_metrics_avg(spark, sf_dir):
    avg = M.outline_metrics_avg(M.outline_metrics(*outlines_pair(spark, sf_dir)))
    return avg.select("n_docs", *[F.round(c, 12).alias(c) for c in avg.columns if c != "n_docs"])


@register("outline_intersect")
def q_outline_intersect(spark, sf_dir):
    e, a, _, _ = outlines_pair(spark, sf_dir)
    return M.outline_intersect(e, a)


@register("outline_missing")
def q_outline_missing(spark, sf_dir):
    _, _, ed, ad = outlines_pair(spark, sf_dir)
    return M.outline_missing(ed, ad)


# ----------------------------------------------------------------- language


@register("language_profiles")
def q_language_profiles(spark, sf_dir):
    return LG.language_profiles(documents(spark, sf_dir))


@register("detect_language")
def q_detect_language(spark, sf_dir):
    return LG.profile_and_detect(documents(spark, sf_dir))[1]


# ----------------------------------------------------------- sources/plans


@register("clean_cells")
def q_clean_cells(spark, sf_dir):
    return CO.clean_cells(FX.raw_cells(documents(spark, sf_dir)))


@register("union_splits")
def q_union_splits(spark, sf_dir):
    return CO.union_splits(FX.image_splits(documents(spark, sf_dir))).select("image_id", "doc_name", "split")


@register("score_corpus")
def q_score_corpus(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lines = FX.layout_lines(docs)
    # documents whose id ends in 96 to 99 carry broken values: reported, not fatal
    end = F.col("doc_id") % 100
    broken = {"page_width": (99, 0.0), "x1": (98, float("inf")), "page_num": (97, None), "size": (96, float("nan"))}
    lines = lines.withColumns({c: F.when(end == at, F.lit(v)).otherwise(F.col(c)) for c, (at, v) in broken.items()})
    return PO.score_corpus(docs, lines)


@register("compare_outlines")
def q_compare_outlines(spark, sf_dir):
    s = PC.compare_summary(*outlines_pair(spark, sf_dir))
    return s.select("n_docs", "n_missing", *[F.round(c, 12).alias(c) for c in s.columns if c.startswith("avg_")])


# ----------------------------------------------------------- ML (rows only)

# The whole training: 500 trees a search fit and a fold, 1000 in the final fit, patience 20 and 50.
TRAIN = ML.TrainConfig(parallelism=4)
CELL_IDS = ["image_id", "cell_no"]


def cell_dataset(spark, sf_dir):
    images, anns, cats, cells = coco(spark, sf_dir)
    return PD.build_cell_dataset(images, anns, cats, cells, keep_ids=True)


def training_cells(spark, sf_dir):
    """The labelled cells' ids, features and label, without texts and boxes."""
    images, anns, cats, cells = coco(spark, sf_dir)
    return PD.build_cell_dataset(images, anns, cats, cells, only=(*CELL_IDS, *FE.FEATURES, "is_heading"))


def training_split(spark, sf_dir):
    return stage(PT.split_and_balance(stage(training_cells(spark, sf_dir)), CELL_IDS))


def trained(spark, sf_dir, cfg=TRAIN, leaves=31, rate=0.05):
    split = training_split(spark, sf_dir)
    tv = cut_lineage(PT.training_frame(split, CELL_IDS))
    return split, ML.fit_early(tv, ML.LEAVES_TO_DEPTH[leaves], rate, cfg.final_max_iter, cfg.final_patience, cfg).model


@register("train_heading_classifier")
def q_train_heading_classifier(spark, sf_dir):
    split, model = trained(spark, sf_dir)
    test = split.where(F.col("split") == "test")
    return ML.score(model, test).select(*CELL_IDS, "label", "probability", "prediction")


@register("grid_search")
def q_grid_search(spark, sf_dir):
    split = training_split(spark, sf_dir)
    res = ML.grid_search(cut_lineage(PT.training_frame(split, CELL_IDS)), TRAIN)
    return spark.createDataFrame(res)


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    split = training_split(spark, sf_dir)
    return PT.cross_validate(split, CELL_IDS, TRAIN)


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    _, model = trained(spark, sf_dir)
    return ML.feature_importance(model)


@register("top_features")
def q_top_features(spark, sf_dir):
    return q_feature_importance(spark, sf_dir).orderBy(F.col("importance").desc(), "feature").limit(10)


@register("score_blocks_model")
def q_score_blocks_model(spark, sf_dir):
    _, model = trained(spark, sf_dir)
    return ML.score(model, ML.prepare(block_feats(spark, sf_dir).withColumn("is_heading", F.lit(0)))).select(
        "doc_id", "page_num", "block_no", "probability", "prediction")


@register("score_blocks_forest")
def q_score_blocks_forest(spark, sf_dir):
    """The blocks scored by a fixed node table."""
    feats = ML.prepare(block_feats(spark, sf_dir).withColumn("is_heading", F.lit(0)))
    return TR.forest_score(feats, FX.forest()).select(
        "doc_id", "page_num", "block_no", F.round("probability", 9).alias("probability"), "prediction")


@register("forest_curve")
def q_forest_curve(spark, sf_dir):
    """Loss of the fixed node table by number of trees, on the labelled cells."""
    cells = ML.prepare(training_cells(spark, sf_dir))
    return TR.validation_curve(cells, FX.forest()).select("trees", F.round("loss", 9).alias("loss"))


@register("forest_split_counts")
def q_forest_split_counts(spark, sf_dir):
    """Labelled cells whose path passes each feature, and the splits that test it."""
    counts = TR.split_counts(spark.createDataFrame(FX.forest(), TR.NODE_SCHEMA))
    cells = ML.prepare(training_cells(spark, sf_dir)).select(*FE.FEATURES)
    passed = cells.select(F.explode(TR.passed_features(FX.forest())).alias("feature")).groupBy("feature").agg(F.count("*").alias("passed"))
    return counts.join(passed, "feature", "left").select("feature", "splits", F.coalesce("passed", F.lit(0)).alias("passed"))


@register("extract_outlines_model")
def q_extract_outlines_model(spark, sf_dir):
    _, model = trained(spark, sf_dir)

    def scorer(feats):
        s = ML.score(model, ML.prepare(feats.withColumn("is_heading", F.lit(0))).drop("label"))
        return s.withColumn("is_heading", F.col("prediction"))
    return PO.extract_outlines(layout_lines(spark, sf_dir), scorer)


@register("train_and_evaluate")
def q_train_and_evaluate(spark, sf_dir):
    res = PT.train_and_evaluate(training_cells(spark, sf_dir), CELL_IDS, TRAIN)
    tm, vm = res["test_metrics"].first(), res["val_metrics"].first()
    rows = [("best_num_leaves", float(res["best"]["num_leaves"])), ("best_learning_rate", res["best"]["learning_rate"]),
            ("best_val_f1", res["best"]["val_f1"]), ("threshold", res["threshold"]),
            ("trees", float(res["trees"])), ("trees_fitted", float(res["trees_fitted"])),
            ("val_accuracy", vm["accuracy"]), ("val_f1", vm["f1"]), ("val_auc", res["val_auc"].first()["auc"]),
            ("test_accuracy", tm["accuracy"]), ("test_f1", tm["f1"]), ("test_auc", res["test_auc"].first()["auc"])]
    cv = res["cv_summary"].first()
    rows += [("cv_auc_mean", cv["mean"]), ("cv_auc_std", cv["std"])]
    return spark.createDataFrame(rows, "metric string, value double")


@register("augment_language")
def q_augment_language(spark, sf_dir):
    """The labelled cell dataset with a detected ``language`` per cell text
    (profiles learned from the labelled documents)."""
    cells_ds = cell_dataset(spark, sf_dir).withColumn(
        "cell_id", F.concat_ws(":", F.col("image_id").cast("string"), F.col("cell_no").cast("string")))
    profiles = LG.language_profiles(documents(spark, sf_dir))
    out = LG.augment_language(cells_ds, profiles, key="cell_id")
    return out.select("image_id", "cell_no", "text", "language")
