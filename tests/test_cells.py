"""The labelled cells' features: texts move once, stored tables are columnar."""
import re

from pyspark.sql import functions as F

from pagewise import queries as Q
from pagewise.operators import labels as L
from pagewise.plans import datasets as PD
from pagewise.session import materialize

from conftest import SF001


def rows(df):
    return sorted(map(repr, df.collect()))


def test_labelled_features_are_those_of_the_steps(spark):
    images, anns, cats, cells = Q.coco(spark, SF001)
    broken = cells.withColumn("x", F.when(F.col("cell_no") % 9 == 4, F.lit(None)).otherwise(F.col("x")))
    for c in (cells, broken):
        got = L.labelled_features(images, c, anns, cats)
        want = L.cell_features(L.drop_noise_cells(L.label_cells(images, c, anns, cats)))
        assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 500
    same = cells.unionByName(cells.where("cell_no % 5 = 0"))  # a cell that is there twice is one cell
    assert rows(L.labelled_features(images, same, anns, cats)) == rows(L.labelled_features(images, cells, anns, cats))


def shuffled_with_text(df):
    """Exchanges whose rows have a text (a column of that name)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [x for x in re.findall(r"Exchange hashpartitioning[^\n]*\n[^\n]*", plan) if re.search(r"\btext#", x)]


def test_texts_move_once_and_in_training_not_at_all(spark):
    tables = Q.coco(spark, SF001)
    _, moved = shuffled_with_text(L.labelled_features(*order(tables)))
    assert len(moved) == 1
    narrow = L.labelled_features(*order(tables)).select(*Q.CELL_IDS, *Q.FE.FEATURES[:5], "is_heading")
    plan, moved = shuffled_with_text(narrow)
    assert not moved and "Exchange" in plan


def order(tables):
    images, anns, cats, cells = tables
    return images, cells, anns, cats


def test_stored_tables_are_columnar(spark):
    wide = spark.range(1000).selectExpr("id", "repeat('a text ', 50) as text")
    kept = materialize(wide, columnar=True)
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "text" not in plan.split("ReadSchema")[1]
    assert rows(kept) == rows(wide)
    images, anns, cats, cells = Q.coco(spark, SF001)
    assert "FileScan parquet" in cells._jdf.queryExecution().executedPlan().toString()
    assert PD.build_cell_dataset(images, anns, cats, cells).count() > 500
