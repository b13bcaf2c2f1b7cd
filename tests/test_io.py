"""Sources and sinks on tiny files written to a scratch folder."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pagewise.sources import coco as CO
from pagewise.sources import datasets as DS
from pagewise.sources import outlines as OL


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="pagewise-io-", dir="/tmp")


def write_json(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(obj, fh, ensure_ascii=False)


def test_read_coco_splits_and_first_categories(spark, scratch):
    for i, s in enumerate(("train", "val", "test")):
        write_json(f"{scratch}/COCO/{s}.json", {
            "images": [{"id": 10 + i, "file_name": f"PNG/p{i}.png", "doc_name": "d", "page_no": i + 1,
                        "coco_width": 600.0}],
            "annotations": [{"id": 1, "image_id": 10 + i, "category_id": 8, "bbox": [1, 2, 3, 4]}],
            "categories": [{"id": 8, "name": "Section-header" if i == 0 else "Other"}]})
    images, anns, cats = CO.read_coco(spark, f"{scratch}/COCO")
    assert images.count() == 3 and anns.count() == 3
    assert [tuple(r) for r in cats.collect()] == [(8, "Section-header")]
    assert {r["split"] for r in images.collect()} == {"train", "val", "test"}
    assert anns.where("split = 'val'").first()["w"] == 3.0


def test_read_and_clean_cells(spark, scratch):
    write_json(f"{scratch}/JSON/p1_1.json", {"cells": [
        {"bbox": [1, 2, 3, 4], "text": "Hello", "font": {"size": 12, "name": "Arial-Bold"}},
        {"bbox": [1, 2, 3], "text": "three numbers"},
        {"bbox": ["5", "6", "7", "8"]},
    ]})
    write_json(f"{scratch}/JSON/notes.txt", {"cells": []})
    raw = CO.read_cells(spark, f"{scratch}/JSON")
    assert {r["page_key"] for r in raw.collect()} == {"p1_1"}
    clean = {r["cell_no"]: r for r in CO.clean_cells(raw).collect()}
    assert set(clean) == {0, 2}
    assert (clean[0]["x"], clean[0]["h"], clean[0]["font_size"], clean[0]["font_name"]) == (1.0, 4.0, 12.0, "Arial-Bold")
    assert (clean[2]["text"], clean[2]["font_size"], clean[2]["font_name"], clean[2]["w"]) == ("", 0.0, "", 7.0)


def test_outline_roundtrip(spark, scratch):
    from pagewise.plans.outlines import nested_outline
    flat = spark.createDataFrame([(1, "Titre é", 1, "H1", "Intro", 1), (1, "Titre é", 2, "H2", "Détails", 2),
                                  (2, "", None, None, None, None)],
                                 "doc_id long, title string, seq int, level string, text string, page int")
    nested = nested_outline(flat)
    OL.write_outlines(nested, f"{scratch}/out")
    back = spark.read.json(f"{scratch}/out")
    got = {r["doc_id"]: r for r in back.collect()}
    assert got[1]["title"] == "Titre é" and [e["text"] for e in got[1]["outline"]] == ["Intro", "Détails"]
    assert got[2]["outline"] == []
    text = open([os.path.join(f"{scratch}/out", f) for f in os.listdir(f"{scratch}/out") if f.endswith(".json")][0],
                encoding="utf-8").read()
    assert "Titre" in text or '"outline":[]' in text


def test_read_outlines_defaults(spark, scratch):
    write_json(f"{scratch}/exp/a_expected.json", {"title": "T", "outline": [{"level": "H1", "text": " X ", "page": 0},
                                                                         {"text": "Y"}]})
    write_json(f"{scratch}/exp/b_expected.json", {"title": ""})
    rows = OL.read_outlines(spark, f"{scratch}/exp", glob="*_expected.json", suffix="_expected").collect()
    got = sorted((r["doc"], r["level"], r["text"]) for r in rows if r["seq"] is not None)
    assert got == [("a", "", "Y"), ("a", "H1", "X")]
    files = {r["doc"] for r in OL.outline_files(spark, f"{scratch}/exp", glob="*_expected.json", suffix="_expected").collect()}
    assert files == {"a", "b"}


def test_dataset_and_csv(spark, scratch):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], "t", "en")], "id long, bbox array<double>, text string, language string")
    DS.save_dataset(df, f"{scratch}/ds")
    DS.save_dataset(df, f"{scratch}/ds")          # overwrite replaces
    assert DS.load_dataset(spark, f"{scratch}/ds").count() == 1
    DS.write_augmented(df, f"{scratch}/aug")
    with pytest.raises(ValueError):
        DS.write_augmented(df.drop("language"), f"{scratch}/aug2")
    DS.write_features_csv(df, f"{scratch}/csv")
    back = spark.read.option("header", True).csv(f"{scratch}/csv").first()
    assert back["bbox"] == "[1.0,2.0,3.0,4.0]"


def test_layout_reader_drops_non_text(spark, scratch):
    from pagewise.sources.layout import SPANS_SCHEMA, read_layout
    rows = [(1, 1, 0, 0, "a", 10.0, "F", 0.0, 0.0, 1.0, 1.0, 612.0, 792.0, 0),
            (1, 1, 0, 1, "img", 10.0, "F", 0.0, 0.0, 1.0, 1.0, 612.0, 792.0, 1)]
    spark.createDataFrame(rows, SPANS_SCHEMA).write.mode("overwrite").parquet(f"{scratch}/spans")
    assert [r["text"] for r in read_layout(spark, f"{scratch}/spans").collect()] == ["a"]


def test_model_roundtrip(spark, scratch):
    from pagewise.operators import ml as ML
    from pagewise.operators.features import FEATURES
    rows = [tuple([float(i % 7), float(i % 2)] + [float((i * k) % 5) for k in range(len(FEATURES) - 2)]) + (i % 2,)
            for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + ", is_heading int")
    prepared = ML.prepare(df).withColumn("weight", F.lit(1.0))
    model = ML.fit(prepared, 3, 0.1, 3, ML.TrainConfig(max_iter=3), "weight")
    ML.save_model(model, f"{scratch}/model", threshold=0.42)
    loaded, thr = ML.load_model(f"{scratch}/model")
    assert thr == 0.42
    a = [r["probability"] for r in ML.score(model, prepared).collect()]
    b = [r["probability"] for r in ML.score(loaded, prepared).collect()]
    assert a == pytest.approx(b)


def test_split_collisions_option(spark, scratch):
    from pagewise.operators import labels as L
    # the same image id in two splits, with different annotations
    write_json(f"{scratch}/COCO/train.json", {
        "images": [{"id": 1, "file_name": "PNG/a.png", "doc_name": "d", "page_no": 1}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 100, 100]}],
        "categories": [{"id": 1, "name": "Title"}, {"id": 2, "name": "Text"}]})
    write_json(f"{scratch}/COCO/val.json", {
        "images": [{"id": 1, "file_name": "PNG/b.png", "doc_name": "e", "page_no": 1}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [0, 0, 100, 100]}],
        "categories": []})
    write_json(f"{scratch}/COCO/test.json", {"images": [], "annotations": [], "categories": []})
    for stem in ("a", "b"):
        write_json(f"{scratch}/JSON/{stem}.json", {"cells": [{"bbox": [10, 10, 20, 20], "text": "Some words",
                                                              "font": {"size": 10, "name": "Times"}}]})
    images, anns, cats = CO.read_coco(spark, f"{scratch}/COCO")
    cells = CO.clean_cells(CO.read_cells(spark, f"{scratch}/JSON"))
    mixed = {r["doc_name"]: r["original_category"] for r in L.label_cells(images, cells, anns, cats).collect()}
    apart = {r["doc_name"]: r["original_category"] for r in L.label_cells(images, cells, anns, cats, split_key=True).collect()}
    assert mixed == {"d": "Title", "e": "Title"}
    assert apart == {"d": "Title", "e": "Text"}
