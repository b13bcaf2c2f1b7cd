"""Composed plans: corpus scoring status, language fallbacks."""
from pyspark.sql import functions as F

from pagewise.operators import language as LG
from pagewise.plans import outlines as PO
from pagewise.sources import fixtures as FX

from conftest import SF001


def test_score_corpus_reports_bad_documents(spark):
    docs = FX.read_table(spark, SF001, "documents").where("doc_id < 8")
    lines = FX.layout_lines(docs).withColumn(
        "page_width", F.when(F.col("doc_id") == 3, F.lit(0.0)).otherwise(F.col("page_width")))
    empty = spark.createDataFrame([(1000,)], "doc_id long")
    res = {r["doc_id"]: r for r in PO.score_corpus(docs.select("doc_id").unionByName(empty), lines).collect()}
    assert res[3]["status"] == "error" and res[3]["error"] == "invalid page size" and res[3]["title"] is None
    assert res[1000]["status"] == "empty"
    assert all(res[d]["status"] == "ok" for d in (0, 1, 2, 4, 5, 6, 7))


def test_every_line_error_is_one_row(spark):
    """One bad line fails its document alone, by the first reason that holds;
    the others' outlines are those of a corpus without the bad ones."""
    docs = FX.read_table(spark, SF001, "documents").where("doc_id < 12")
    lines = FX.layout_lines(docs).withColumn("_corrupt_record", F.lit(None).cast("string"))
    inf, nan = float("inf"), float("nan")
    bad = {0: ("page_width", inf, "invalid page size"), 1: ("page_height", None, "invalid page size"), 2: ("page_num", None, "missing page number"),
           3: ("x0", nan, "invalid box"), 4: ("y1", -inf, "invalid box"), 5: ("size", None, "invalid font size"),
           6: ("_corrupt_record", "{", "unreadable record"), 7: ("y0", 1e300, None)}
    first = lines.groupBy("doc_id").agg(F.min("line_no").alias("first_line"))
    broken = lines.join(first, "doc_id")
    for d, (c, v, _) in bad.items():
        broken = broken.withColumn(c, F.when((F.col("doc_id") == d) & (F.col("line_no") == F.col("first_line")), F.lit(v)).otherwise(F.col(c)))
    # more than one reason: the first of them
    broken = broken.withColumn("size", F.when(F.col("doc_id") == 3, F.lit(nan)).otherwise(F.col("size")))
    status, flat = PO.corpus_outlines(docs, broken.drop("first_line"))
    got = {r["doc_id"]: r for r in status.collect()}
    assert {d: r["error"] for d, r in got.items()} == {d: bad[d][2] if d in bad else None for d in range(12)}
    alone = PO.extract_outlines(lines.where("doc_id > 7"))
    assert sorted(map(str, flat.where("doc_id > 7").collect())) == sorted(map(str, alone.collect()))


def test_key_of_another_name(spark):
    """The document key is an argument of the whole plan."""
    docs = FX.read_table(spark, SF001, "documents").where("doc_id < 6")
    lines = FX.layout_lines(docs)
    renamed = PO.extract_outlines(lines.withColumnRenamed("doc_id", "file"), key="file")
    assert renamed.columns[0] == "file"
    assert sorted(map(tuple, renamed.collect()), key=str) == sorted(map(tuple, PO.extract_outlines(lines).collect()), key=str)


def test_unreadable_cell_files(spark, tmp_path):
    from pagewise.sources import coco as CO
    for name, text in {"a.json": '{"cells": [{"text": "x"}]}', "b.json": '{"cells": [', "c.json": "no json", "d.json": '{"cells": []}', "e.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    errors = CO.cell_file_errors(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, errors)) == [("b", "unreadable record"), ("c", "unreadable record")]
    assert [r["page_key"] for r in CO.read_cells(spark, str(tmp_path)).collect()] == ["a"]


def test_language_fallbacks(spark):
    corpus = spark.createDataFrame([(1, "en", "the cat and the dog are here"), (2, "de", "der hund und die katze sind hier"),
                                    (3, None, "1234 !!! 5678"), (4, None, "the dogs and cats"), (5, None, None),
                                    (6, None, "Это русский текст"), (7, None, "这是中文")],
                                   "doc_id long, lang string, text string")
    profiles, det = LG.profile_and_detect(corpus)
    got = {r["doc_id"]: r["language"] for r in det.collect()}
    assert got[6] == got[7] == "unknown"
    assert got[3] == "unknown" and got[5] == "unknown" and got[4] == "en"
    assert got[1] == "en" and got[2] == "de"
    alone = {r["doc_id"]: r["language"] for r in LG.detect_language(corpus, profiles).collect()}
    assert alone == got


def test_huge_texts_are_counted_by_many_tasks(spark):
    """Profiles do not depend on which texts count as huge, and a huge text's
    n-grams are counted by (text, gram)."""
    rows = [(1, " ".join(f"{a}{b}{a}" for a in "abcdefghij" for b in "klmnopqrst")), (2, "the cat and the dog"), (3, ""), (4, None), (5, "Ärger über Öl")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    plain, huge, every = (LG.text_profiles(texts, top=20, huge_words=n) for n in (1000, 50, 0))
    expected = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, huge.collect())) == sorted(map(tuple, every.collect())) == expected
    assert {r[0] for r in expected} == {1, 2, 5}
    plan = huge._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Exchange hashpartitioning(doc_id" in plan and ", gram" in plan
    assert LG.text_profiles(texts.limit(0)).count() == 0


def test_language_where_the_row_lies(spark):
    """Rows are scored without a shuffle, as the relational path scores them;
    long texts, repeated keys and null keys too."""
    import random
    rng = random.Random(3)
    letters = ["abcdeé", "abxyz", "ßüöä 12", "ыфж", "𐐀𐐁a", "中文字"]
    rows = [(i, None if i % 17 == 5 else "".join(rng.choice(rng.choice(letters) + "  -") for _ in range(rng.choice([0, 1, 5, 40, 900]))))
            for i in range(300)]
    texts = spark.createDataFrame(rows + [(7, "again xyz"), (None, "abc")], "doc_id long, text string")
    corpus = spark.createDataFrame([(x, t) for x, t in zip("zyxwvu", letters)] + [("a", "abcdeé")], "lang string, text string")
    profiles = LG.language_profiles(corpus)
    found = LG.with_language(texts.where("doc_id <> 7"), profiles)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    best = {r["doc_id"]: r["best"] for r in LG._best_by_key(texts, profiles, True, "doc_id", "text", 300, 3).collect()}
    want = sorted((k, best.get(k) or "unknown") if k is not None else (-1, "unknown") for k in [r[0] for r in rows] + [7, None])
    for long_text in (LG.LONG_TEXT, 30, 0):
        got = LG.detect_language(texts, profiles, long_text=long_text).collect()
        assert sorted((-1 if r[0] is None else r[0], r[1]) for r in got) == want, long_text
    assert len({x for _, x in want}) > 3
    twice = LG.augment_language(texts.where("doc_id in (7, 8)"), profiles, "doc_id")
    assert twice.count() == 3 and twice.columns == ["doc_id", "text", "language"]
    few = LG.language_profiles(corpus.where("lang in ('z', 'y')"), top=5)
    best = {r["doc_id"]: r["best"] for r in LG._best_by_key(texts, few, True, "doc_id", "text", 3, 3).collect()}
    got = LG.detect_language(texts.where("doc_id <> 7"), few, top=3).collect()
    assert all(r["language"] == (best.get(r["doc_id"]) or "unknown") for r in got)


def test_training_tables_hold_ids_features_and_label_only(spark):
    from pagewise import queries as Q
    from pagewise.operators import ml as ML
    from pagewise.operators.features import FEATURES
    cols = [*Q.CELL_IDS, *FEATURES, "label"]
    narrow = ML.prepare(Q.training_cells(spark, SF001)).select(*cols)
    wide = ML.prepare(Q.cell_dataset(spark, SF001)).select(*cols)
    assert narrow.count() == wide.count() > 0 and narrow.exceptAll(wide).count() == 0
    split = Q.training_split(spark, SF001)
    assert not {"text", "bbox", "doc_name"} & set(split.columns) and set(cols) < set(split.columns)
