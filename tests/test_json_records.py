"""Large JSON files over many tasks: equal to json.loads whatever the splits."""
import json
import random

import pytest

from pagewise.sources import coco as CO
from pagewise.sources.json_records import section_records


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def nasty(rng):
    return "".join(rng.choice(['a', 'é', '{', '}', '[', ']', '"', '\\', ',', ':', ' ', '\n', '"}, {"', 'images": [{']) for _ in range(rng.randint(0, 12)))


def coco(rng, n, base):
    return {
        "info": {"note": nasty(rng), "by": {"name": "x}"}}, "remark": 'a "quoted" }{ text ', "empty": [],
        "images": [{"id": base + i, "file_name": f"PNG/p{base + i}.png", "doc_name": nasty(rng), "page_no": i, "coco_width": 600.5,
                    **({"extra": {"deep": [{"x": nasty(rng)}, {}]}} if i % 3 == 0 else {})} for i in range(n)],
        "version": 3,
        "annotations": [{"id": i, "image_id": base + i % 7, "category_id": 8, "bbox": [1, 2.5, 3, 4][:rng.choice([4, 4, 3])],
                         "segmentation": rng.choice([[[1, 2]], {"counts": [1], "size": [2]}])} for i in range(2 * n)],
        "categories": [{"id": 8, "name": "Section-header"}, {}],
        "tail": nasty(rng)}


@pytest.mark.parametrize("indent", [None, 1])
def test_section_records(spark, small_splits, tmp_path, indent):
    rng = random.Random(3 if indent else 4)
    data = coco(rng, 40, 100)
    path = tmp_path / "train.json"
    path.write_text(json.dumps(data, ensure_ascii=False, indent=indent), encoding="utf-8")
    tasks = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
    assert tasks > 10
    got = sorted((r["section"], json.dumps(json.loads(r["json"]), sort_keys=True)) for r in section_records(spark, [str(path)]).collect())
    exp = sorted((k, json.dumps(o, sort_keys=True)) for k, v in data.items() for o in (v if isinstance(v, list) else [v]) if isinstance(o, dict))
    assert got == exp


def test_read_coco_equals_plain_json(spark, small_splits, tmp_path):
    rng = random.Random(9)
    data = {s: coco(rng, 15, 1000 * k) for k, s in enumerate(CO.SPLITS)}
    for s, d in data.items():
        (tmp_path / f"{s}.json").write_text(json.dumps(d, ensure_ascii=False, indent=rng.choice([None, 2])) + "\n", encoding="utf-8")
    images, anns, cats = CO.read_coco(spark, str(tmp_path))
    key = repr
    assert sorted(map(tuple, images.collect()), key=key) == sorted(
        ((i["id"], i["file_name"], i["doc_name"], i["page_no"], 600.5, None, s) for s, d in data.items() for i in d["images"]), key=key)
    assert sorted(map(tuple, anns.collect()), key=key) == sorted(
        ((a["id"], a["image_id"], 8, *[float(x) for x in (a["bbox"] + [])], *[None] * (4 - len(a["bbox"])), s)
         for s, d in data.items() for a in d["annotations"]), key=key)
    assert sorted(map(tuple, cats.collect()), key=key) == sorted([(8, "Section-header"), (None, None)], key=key)


@pytest.mark.parametrize("text", ["", " \n", "[]", '{"images": [{"id": 1}, ', '{"images": [{"id": 1}]', '{"images": [{"id": 1}, {"id": 2', '{"images": [{"id": 1}', '{"images": [{"id": 1, "n": "}'])
def test_cut_off_files_raise(spark, tmp_path, text):
    path = tmp_path / "train.json"
    path.write_text(text)
    with pytest.raises(ValueError, match="no whole JSON object"):
        section_records(spark, [str(path)])


def test_files_without_records(spark, tmp_path):
    for i, text in enumerate(["{}", ' {"images": []} ', '{"version": 1, "s": "{"}']):
        (tmp_path / f"{i}.json").write_text(text)
    assert section_records(spark, [str(tmp_path / f"{i}.json") for i in range(3)]).count() == 0
