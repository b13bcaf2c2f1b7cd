"""Command line: one sub-command per pipeline, each a single Spark job graph.

    python -m pagewise.cli build-cells    --coco DIR --cells DIR --out PATH
    python -m pagewise.cli build-headings --coco DIR --cells DIR --out PATH
    python -m pagewise.cli train          --data PATH --model PATH [--report PATH]
    python -m pagewise.cli infer          --spans PATH --out PATH [--model PATH] [--status PATH]
    python -m pagewise.cli compare        --expected DIR --actual DIR [--out PATH]
    python -m pagewise.cli language       --data PATH --corpus PATH --out PATH
    python -m pagewise.cli profile        --spans PATH --doc ID [--text TEXT] [--csv PATH]

Paths may be on any file system Spark can read.  The session comes from
``SparkSession.builder.getOrCreate()`` (spark-submit settings apply); only a
missing checkpoint folder is filled in, for local runs.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewise.operators import features as FE
from pagewise.operators import language as LG
from pagewise.operators import ml as ML
from pagewise.plans import compare as PC
from pagewise.plans import datasets as PD
from pagewise.plans import outlines as PO
from pagewise.plans import training as PT
from pagewise.session import ensure_checkpoint_dir, materialize
from pagewise.sources import coco as CO
from pagewise.sources import datasets as DS
from pagewise.sources import outlines as OL
from pagewise.sources.layout import read_layout


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("pagewise").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _coco_inputs(spark, args):
    images, anns, cats = CO.read_coco(spark, args.coco)
    cells = CO.clean_cells(CO.read_cells(spark, args.cells))
    return images, anns, cats, cells


def cmd_build_cells(spark, args):
    images, anns, cats, cells = _coco_inputs(spark, args)
    ds = PD.build_cell_dataset(images, anns, cats, cells, keep_ids=True)
    DS.save_dataset(ds, args.out)
    stats = ds.groupBy("is_heading").count().collect()
    print(json.dumps({"rows": {str(r["is_heading"]): r["count"] for r in stats}}))


def cmd_build_headings(spark, args):
    images, anns, cats, cells = _coco_inputs(spark, args)
    DS.save_dataset(PD.build_heading_dataset(images, anns, cats, cells), args.out)


def cmd_train(spark, args):
    data = DS.load_dataset(spark, args.data)
    ids = [c for c in ("image_id", "cell_no") if c in data.columns] or ["doc_name", "page_no", "text"]
    res = PT.train_and_evaluate(data, ids, ML.TrainConfig(), model_path=args.model)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  small results
    summary = {
        "grid": res["grid"], "best": res["best"], "trees": res["trees"], "trees_fitted": res["trees_fitted"], "threshold": res["threshold"],
        "validation": res["val_metrics"].first().asDict(), "validation_auc": res["val_auc"].first()["auc"],
        "validation_report": rows(res["val_report"]),
        "test": res["test_metrics"].first().asDict(), "test_auc": res["test_auc"].first()["auc"],
        "test_report": rows(res["test_report"]), "confusion": rows(res["confusion"]),
        "cv": res["cv_summary"].first().asDict(), "counts": rows(res["counts"]),
        "importance": rows(res["importance"].orderBy(F.desc("importance"), "feature").limit(10)),
    }
    print(json.dumps(summary, default=float))
    if args.report:
        spark.createDataFrame([(json.dumps(summary, default=float),)], "report string").coalesce(1) \
            .write.mode("overwrite").text(args.report)


def _model_scorer(path):
    model, threshold = ML.load_model(path)

    def scorer(feats):
        s = ML.score(model, ML.prepare(feats.withColumn("is_heading", F.lit(0))).drop("label"), threshold)
        return s.withColumn("is_heading", F.col("prediction"))
    return scorer


def cmd_infer(spark, args):
    from pagewise.operators.blocks import spans_to_lines
    from pagewise.operators.outline import fixed_score
    spans = read_layout(spark, args.spans)
    lines = spans_to_lines(spans)
    scorer = _model_scorer(args.model) if args.model else fixed_score
    status, flat = PO.corpus_outlines(spans.select("doc_id").distinct(), lines, scorer)
    OL.write_outlines(PO.nested_outline(flat), args.out)
    if args.status:
        status.write.mode("overwrite").json(args.status)


def cmd_compare(spark, args):
    exp = OL.read_outlines(spark, args.expected, glob="*_expected.json", suffix="_expected")
    act = OL.read_outlines(spark, args.actual)
    ed = OL.outline_files(spark, args.expected, glob="*_expected.json", suffix="_expected")
    ad = OL.outline_files(spark, args.actual)
    ren = {"doc": "doc_id"}
    res = PC.compare_outlines(exp.where("seq is not null").withColumnsRenamed(ren),
                              act.where("seq is not null").withColumnsRenamed(ren),
                              ed.withColumnsRenamed(ren), ad.withColumnsRenamed(ren))
    res["per_doc"].orderBy("doc_id").show(truncate=False)
    res["average"].show(truncate=False)
    n_missing = res["missing"].count()
    if n_missing:
        print(f"skipped {n_missing} documents without actual output, e.g.:")
        res["missing"].show(20, truncate=False)
    if args.out:
        res["per_doc"].write.mode("overwrite").json(args.out)


def cmd_language(spark, args):
    data = DS.load_dataset(spark, args.data)
    profiles = LG.language_profiles(spark.read.parquet(args.corpus))
    # a row key, materialised once so both sides of the join agree on it
    keyed = materialize(data.withColumn("_row", F.monotonically_increasing_id()))
    DS.write_augmented(LG.augment_language(keyed, profiles, key="_row").drop("_row"), args.out)


def cmd_profile(spark, args):
    from pagewise.operators.blocks import spans_to_lines
    spans = read_layout(spark, args.spans).where(F.col("doc_id") == args.doc)
    feats = PO.block_features(spans_to_lines(spans))
    FE.block_profile(feats).show()
    if args.text:
        FE.find_blocks(feats, args.text).show(truncate=False)
    if args.csv:
        DS.write_features_csv(feats, args.csv)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="pagewise")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("build-cells", "build-headings"):
        s = sub.add_parser(name)
        s.add_argument("--coco", required=True)
        s.add_argument("--cells", required=True)
        s.add_argument("--out", required=True)
    s = sub.add_parser("train")
    s.add_argument("--data", required=True)
    s.add_argument("--model", required=True)
    s.add_argument("--report")
    s = sub.add_parser("infer")
    s.add_argument("--spans", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--model")
    s.add_argument("--status")
    s = sub.add_parser("compare")
    s.add_argument("--expected", required=True)
    s.add_argument("--actual", required=True)
    s.add_argument("--out")
    s = sub.add_parser("language")
    s.add_argument("--data", required=True)
    s.add_argument("--corpus", required=True)
    s.add_argument("--out", required=True)
    s = sub.add_parser("profile")
    s.add_argument("--spans", required=True)
    s.add_argument("--doc", type=int, required=True)
    s.add_argument("--text")
    s.add_argument("--csv")
    args = p.parse_args(argv)
    spark = _session()
    {"build-cells": cmd_build_cells, "build-headings": cmd_build_headings, "train": cmd_train,
     "infer": cmd_infer, "compare": cmd_compare, "language": cmd_language, "profile": cmd_profile}[args.cmd](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
