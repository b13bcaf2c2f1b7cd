"""A hot document: thousands of pages in one document still folds correctly
through page summaries and page blocks (default block size)."""
import random

from pagewise.operators import outline as O

from test_order_operators import py_levels


def test_hot_document_outline(spark):
    rng = random.Random(2024)
    sizes, rows, size = [], [], 1.5
    for page in range(1, 3001):
        for k in range(rng.choice([0, 1, 1, 2])):
            size = min(3.0, max(0.8, size + rng.choice([-0.3, -0.04, 0.0, 0.04, 0.3])))
            sizes.append(size)
            rows.append((7, page, float(k), len(rows), size))
    df = spark.createDataFrame(rows, "doc_id long, page_num int, norm_y double, block_no int, relative_font_size double")
    got = [r["level_num"] for r in O.outline_levels_by_page(df).orderBy("seq").collect()]
    assert got == py_levels(sizes)
    assert len(got) == len(rows) > 2000
