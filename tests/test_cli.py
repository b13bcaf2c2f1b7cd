"""Command-line pipelines on small inputs."""
import json
import os
import tempfile

import pytest

from pagewise import cli
from pagewise.sources import fixtures as FX

from conftest import SF001



def write_json(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(obj, fh)


def test_infer_profile_and_language(spark):
    base = tempfile.mkdtemp(prefix="pagewise-cli-", dir="/tmp")
    docs = FX.read_table(spark, SF001, "documents")
    FX.spans(docs).write.parquet(f"{base}/spans")
    assert cli.main(["infer", "--spans", f"{base}/spans", "--out", f"{base}/out", "--status", f"{base}/status"]) == 0
    out = spark.read.json(f"{base}/out")
    assert out.count() == docs.count()
    assert {r["status"] for r in spark.read.json(f"{base}/status").collect()} <= {"ok", "empty"}
    assert cli.main(["profile", "--spans", f"{base}/spans", "--doc", "3", "--csv", f"{base}/csv"]) == 0
    assert spark.read.option("header", True).csv(f"{base}/csv").count() > 0
    docs.select("doc_id", "text").write.parquet(f"{base}/data")
    docs.write.parquet(f"{base}/corpus")
    assert cli.main(["language", "--data", f"{base}/data", "--corpus", f"{base}/corpus", "--out", f"{base}/lang"]) == 0
    langs = spark.read.parquet(f"{base}/lang")
    assert langs.count() == docs.count() and "language" in langs.columns


def test_build_cells_from_files(spark):
    base = tempfile.mkdtemp(prefix="pagewise-cli-", dir="/tmp")
    for i, s in enumerate(("train", "val", "test")):
        write_json(f"{base}/COCO/{s}.json", {
            "images": [{"id": i + 1, "file_name": f"PNG/p{i}.png", "doc_name": "d", "page_no": i + 1}],
            "annotations": [{"id": 1, "image_id": i + 1, "category_id": 1, "bbox": [0, 0, 100, 100]},
                            {"id": 2, "image_id": i + 1, "category_id": 2, "bbox": [0, 200, 300, 100]}],
            "categories": [{"id": 1, "name": "Title"}, {"id": 2, "name": "Text"}]})
        write_json(f"{base}/JSON/p{i}.json", {"cells": [
            {"bbox": [10, 10, 50, 20], "text": "A Title Here", "font": {"size": 20, "name": "Arial-Bold"}},
            {"bbox": [10, 210, 200, 20], "text": "body text of the page with many words", "font": {"size": 10, "name": "Times"}}]})
    assert cli.main(["build-cells", "--coco", f"{base}/COCO", "--cells", f"{base}/JSON", "--out", f"{base}/ds"]) == 0
    ds = spark.read.parquet(f"{base}/ds")
    assert ds.count() == 6 and ds.where("is_heading = 1").count() == 3
    assert ds.where("is_heading = 1").first()["relative_font_size"] == 2.0
    assert cli.main(["build-headings", "--coco", f"{base}/COCO", "--cells", f"{base}/JSON", "--out", f"{base}/hd"]) == 0
    assert {r["heading_level"] for r in spark.read.parquet(f"{base}/hd").collect()} == {"H1"}


def test_compare_golden(spark, capsys, tmp_path):
    from test_metrics import write_golden
    write_golden(tmp_path)
    base = str(tmp_path)
    assert cli.main(["compare", "--expected", f"{base}/expected", "--actual", f"{base}/actual",
                     "--out", f"{base}/cmp"]) == 0
    assert spark.read.json(f"{base}/cmp").count() == 5
