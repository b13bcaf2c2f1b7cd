"""Metrics vs brute force, edge cases, and the golden outline pairs."""
import json
import os
import random

import pytest

from pagewise.operators import metrics as M


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_auc_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.35, 0.5, 0.7, 0.9, rng.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, probability double")
    assert M.roc_auc(df, buckets=16).first()["auc"] == pytest.approx(brute_auc(rows), abs=1e-12)
    one_class = spark.createDataFrame([(1, 0.3), (1, 0.6)], "label int, probability double")
    assert M.roc_auc(one_class).first()["auc"] is None


def test_threshold_sweep_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, probability double")
    got = {r["i"]: r["f1"] for r in M.threshold_sweep(df).collect()}
    for i, t in enumerate(M.sweep_thresholds()):
        tp = sum(1 for y, p in rows if y == 1 and p > t)
        fp = sum(1 for y, p in rows if y == 0 and p > t)
        fn = sum(1 for y, p in rows if y == 1 and not p > t)
        exp = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        assert got[i] == pytest.approx(exp)
    best = M.best_threshold(M.threshold_sweep(df)).first()
    f1s = [got[i] for i in range(81)]
    assert best["threshold"] == M.sweep_thresholds()[f1s.index(max(f1s))]
    none = spark.createDataFrame([(0, 0.95), (0, 0.99)], "label int, probability double")
    assert M.best_threshold(M.threshold_sweep(none)).first()["threshold"] == 0.5


def test_binary_metrics_and_report(spark):
    rows = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = M.binary_metrics(df).first()
    assert m["accuracy"] == pytest.approx(9 / 12) and m["precision"] == pytest.approx(5 / 6)
    assert m["recall"] == pytest.approx(5 / 7) and m["f1"] == pytest.approx(2 * 5 / (2 * 5 + 1 + 2))
    rep = {r["name"]: r for r in M.classification_report(df).collect()}
    assert rep["0"]["support"] == 5 and rep["1"]["support"] == 7
    assert rep["macro avg"]["precision"] == pytest.approx((4 / 6 + 5 / 6) / 2)
    cm = {(r["label"], r["prediction"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 5}


def test_outline_metric_edge_cases(spark):
    e = spark.createDataFrame([(1, "H1", "A "), (1, "H2", "B"), (3, "H1", "X")], "doc_id long, level string, text string")
    a = spark.createDataFrame([(1, "H1", "A"), (1, "H1", "B"), (2, "H1", "Z")], "doc_id long, level string, text string")
    docs_e = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    docs_a = spark.createDataFrame([(1,), (2,), (4,)], "doc_id long")
    got = {r["doc_id"]: r for r in M.outline_metrics(e, a, docs_e, docs_a).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["text_matches"] == 2 and got[1]["pair_matches"] == 1 and got[1]["pair_f1"] == pytest.approx(0.5)
    assert got[2]["text_recall"] == 1.0 and got[2]["text_precision"] == 0.0 and got[2]["text_f1"] == 0.0
    assert got[4]["text_recall"] == 1.0 and got[4]["text_precision"] == 1.0 and got[4]["text_f1"] == 1.0
    assert [r[0] for r in M.outline_missing(docs_e, docs_a).collect()] == [3]


# Expected and produced outlines of five documents, (level, text) in order.
GOLDEN = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "golden_outlines.json")


def write_golden(base):
    """The pairs as outline files: <name>_expected.json and <name>.json."""
    with open(GOLDEN, encoding="utf-8") as f:
        pairs = json.load(f)
    for name, pair in pairs.items():
        for side, path in (("expected", f"{base}/expected/{name}_expected.json"), ("actual", f"{base}/actual/{name}.json")):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                json.dump({"title": "", "outline": [{"level": level, "text": text, "page": 1} for level, text in pair[side]]}, f)


# The per-file set metrics of the checked-in golden/produced
GOLDEN_METRICS = {
    "file01": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0),
    "file02": (0.9412, 0.7273, 0.8205, 0.0, 0.0, 0.0),
    "file03": (0.9487, 0.7400, 0.8315, 0.1538, 0.1200, 0.1348),
    "file04": (1.0, 0.2, 0.3333, 0.0, 0.0, 0.0),
    "file05": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}


def test_golden_outline_pairs(spark, tmp_path):
    from pagewise.sources.outlines import outline_files, read_outlines
    write_golden(tmp_path)
    exp_dir, act_dir = str(tmp_path / "expected"), str(tmp_path / "actual")
    e = read_outlines(spark, exp_dir, glob="*_expected.json", suffix="_expected").withColumnRenamed("doc", "doc_id")
    a = read_outlines(spark, act_dir).withColumnRenamed("doc", "doc_id")
    ed = outline_files(spark, exp_dir, glob="*_expected.json", suffix="_expected").withColumnRenamed("doc", "doc_id")
    ad = outline_files(spark, act_dir).withColumnRenamed("doc", "doc_id")
    got = {r["doc_id"]: r for r in M.outline_metrics(e.where("seq is not null"), a.where("seq is not null"), ed, ad).collect()}
    assert set(got) == set(GOLDEN_METRICS)
    for f, exp in GOLDEN_METRICS.items():
        r = got[f]
        vals = (r["text_recall"], r["text_precision"], r["text_f1"], r["pair_recall"], r["pair_precision"], r["pair_f1"])
        assert vals == pytest.approx(exp, abs=1e-4), f


def test_outline_counts_against_sets(spark):
    """Counts and ratios equal plain sets: null and blank texts, repeated
    entries, documents on one side only, a null document, empty tables."""
    from pagewise.plans import compare as PC
    rng = random.Random(8)
    texts, levels = [None, "", " ", "A", " A ", "B", "Cé"], [None, "", "H1", "H2"]
    schema = "doc_id long, level string, text string"
    sides = [[(rng.choice([1, 2, 3, 4, None]), rng.choice(levels), rng.choice(texts)) for _ in range(30)] for _ in range(2)]
    e_docs, a_docs = [1, 2, 3, 5, 5, None], [2, 3, 4, 5, None]
    e, a = (spark.createDataFrame(rows, schema) for rows in sides)
    ed, ad = (spark.createDataFrame([(d,) for d in ds], "doc_id long") for ds in (e_docs, a_docs))

    def sets(rows, d):
        pairs = {(lv or "", (t or "").strip()) for k, lv, t in rows if k == d}
        return pairs, {t for _, t in pairs}

    got = {r["doc_id"]: r for r in M.outline_metrics(e, a, ed, ad).collect()}
    assert set(got) == {2, 3, 5}
    for d, r in got.items():
        (ep, et), (ap, at) = sets(sides[0], d), sets(sides[1], d)
        assert (r["n_exp_pairs"], r["n_act_pairs"], r["pair_matches"], r["text_matches"]) == (len(ep), len(ap), len(ep & ap), len(et & at))
        assert r["text_recall"] == (len(et & at) / len(et) if et else 1.0)
        assert r["pair_precision"] == (len(ep & ap) / len(ap) if ap else 1.0)
    assert M.outline_intersect(e, a).where("doc_id is not null").count() == sum(
        len(sets(sides[0], d)[0] & sets(sides[1], d)[0]) for d in (1, 2, 3, 4))
    s = PC.compare_summary(e, a, ed, ad).first()
    assert (s["n_docs"], s["n_missing"]) == (3, 1)
    assert s["avg_text_f1"] == pytest.approx(sum(r["text_f1"] for r in got.values()) / 3)
    assert M.outline_metrics(e.limit(0), a.limit(0), ed.limit(0), ad.limit(0)).count() == 0


def test_outline_counts_plan(spark, tmp_path):
    """One scan a table, three exchanges, no join."""
    paths = []
    for i, schema in enumerate(["doc_id long, level string, text string"] * 2 + ["doc_id long"] * 2):
        paths.append(str(tmp_path / str(i)))
        spark.createDataFrame([], schema).write.parquet(paths[-1])
    e, a, ed, ad = map(spark.read.parquet, paths)
    plan = M.outline_metrics(e, a, ed, ad)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
