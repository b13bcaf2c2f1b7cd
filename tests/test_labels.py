"""Containment join, label priority and heading levels vs brute force."""
import random

from pagewise.operators import labels as L


def inside(c, a):
    cx, cy = c[0] + c[2] / 2, c[1] + c[3] / 2
    return a[0] <= cx <= a[0] + a[2] and a[1] <= cy <= a[1] + a[3]


def test_center_inside_join_matches_brute_force(spark):
    rng = random.Random(11)
    cells, anns = [], []
    for page in range(20):
        for c in range(rng.randint(0, 12)):
            cells.append((page, c, float(rng.randint(0, 500)), float(rng.randint(0, 700)),
                          float(rng.randint(0, 100)), float(rng.randint(0, 150))))
        for a in range(rng.randint(0, 6)):
            anns.append((page, a, float(rng.randint(0, 500)), float(rng.randint(0, 700)),
                         float(rng.randint(0, 300)), float(rng.randint(0, 400))))
    # edge cases: centre exactly on every edge, zero-size box
    cells += [(99, 0, 0.0, 0.0, 10.0, 10.0), (99, 1, 10.0, 10.0, 0.0, 0.0)]
    anns += [(99, 0, 5.0, 5.0, 0.0, 0.0), (99, 1, 0.0, 0.0, 10.0, 10.0), (99, 2, 5.0, 5.0, 5.0, 5.0)]
    cdf = spark.createDataFrame(cells, "image_id long, cell_no int, x double, y double, w double, h double")
    adf = spark.createDataFrame(anns, "image_id long, ann_id int, ax double, ay double, aw double, ah double")
    got = {(r[0], r[1], r[2]) for r in L.center_inside_join(cdf, adf, band=64.0).select("image_id", "cell_no", "ann_id").collect()}
    exp = {(c[0], c[1], a[1]) for c in cells for a in anns if c[0] == a[0] and inside(c[2:], a[2:])}
    assert got == exp


def test_center_inside_join_boxes_of_any_height(spark):
    """From zero to infinite height: equal to brute force, at most three rows a box."""
    inf, nan = float("inf"), float("nan")
    rng = random.Random(5)
    heights = [0.0, 1e-20, 63.9, 64.0, 64.1, 256.0, 1e4, 1e9, 1e12, 1e300, inf]
    anns = [(1, i, 0.0, rng.choice([-1e-20, 0.0, -64.0, 100.5, -1e300, 1e17, -inf]), 10.0, rng.choice(heights)) for i in range(300)]
    anns += [(1, 900, 0.0, 0.0, 10.0, -1.0), (1, 901, 0.0, nan, 10.0, 5.0), (1, 902, 0.0, 0.0, 10.0, nan),
             (1, 903, 0.0, 0.0, 10.0, None), (2, 904, 0.0, -inf, 10.0, inf), (None, 905, 0.0, 0.0, 10.0, 10.0)]
    cells = [(1, i, 0.0, y, 4.0, h) for i, (y, h) in enumerate(
        [(0.0, 0.0), (-64.0, 0.0), (64.0, 0.0), (-1e-20, 0.0), (100.5, 3.0), (1e17, 2.0), (1e300, 0.0), (-1e300, 0.0),
         (inf, 0.0), (-inf, 0.0), (nan, 0.0), (5e8, 1e9)])]
    cells += [(1, 90, 0.0, None, 4.0, 1.0), (None, 91, 0.0, 1.0, 4.0, 1.0), (3, 92, 0.0, 1.0, 4.0, 1.0)]
    cdf = spark.createDataFrame(cells, "image_id long, cell_no int, x double, y double, w double, h double")
    adf = spark.createDataFrame(anns, "image_id long, ann_id int, ax double, ay double, aw double, ah double")
    got = sorted(tuple(r) for r in L.center_inside_join(cdf, adf).select("image_id", "cell_no", "ann_id").collect())
    exp = sorted((c[0], c[1], a[1]) for c in cells for a in anns
                 if c[0] == a[0] and c[0] is not None and None not in c + a and inside(c[2:], a[2:]))
    assert got == exp and len(got) > 300
    assert L.box_levels(adf.where("ann_id < 900"), "image_id").selectExpr("size(_levels) n").first()["n"] <= L.TOP_LEVEL + 1
    assert L.center_inside_join(cdf.limit(0), adf).count() == L.center_inside_join(cdf, adf.limit(0)).count() == 0


def test_label_priority_and_noise(spark):
    images = spark.createDataFrame([(1, "PNG/p1.png", "d", 1, None, None)],
                                   "image_id long, file_name string, doc_name string, page_no int, coco_width double, coco_height double")
    cells = spark.createDataFrame([("p1", 0, " Heading ", 10.0, 10.0, 10.0, 10.0, 14.0, "Bold"),
                                   ("p1", 1, "body text here", 100.0, 100.0, 10.0, 10.0, 10.0, "Times"),
                                   ("p1", 2, "123", 300.0, 300.0, 10.0, 10.0, 10.0, "Times"),
                                   ("p1", 3, "--!", 300.0, 300.0, 10.0, 10.0, 10.0, "Times"),
                                   ("p1", 4, "outside", 900.0, 900.0, 10.0, 10.0, 10.0, "Times")],
                                  "page_key string, cell_no int, text string, x double, y double, w double, h double, font_size double, font_name string")
    anns = spark.createDataFrame([(1, 0, 10, 0.0, 0.0, 50.0, 50.0), (1, 1, 8, 0.0, 0.0, 50.0, 50.0),
                                  (1, 2, 11, 0.0, 0.0, 30.0, 30.0), (1, 3, 10, 0.0, 0.0, 600.0, 600.0)],
                                 "image_id long, ann_id int, category_id int, x double, y double, w double, h double")
    cats = spark.createDataFrame([(8, "Section-header"), (10, "Text"), (11, "Title")], "category_id int, name string")
    lab = {r["cell_no"]: r["original_category"] for r in L.label_cells(images, cells, anns, cats).collect()}
    assert lab == {0: "Title", 1: "Text", 2: "Text", 3: "Text"}
    kept = {r["cell_no"] for r in L.drop_noise_cells(L.label_cells(images, cells, anns, cats)).collect()}
    assert kept == {0, 1}


def test_assign_heading_levels_by_hand(spark):
    """Larger before smaller, bolder before lighter; every new style is one
    level deeper, the seventh and later ones are Other-Heading, titles are H1."""
    judged = [(2.5, 2, "Section-header", "H1"), (2.5, 2, "Section-header", "H1"), (2.5, 0, "Section-header", "H2"),
              (2.0, 1, "Section-header", "H3"), (1.8, 1, "Title", "H1"), (1.6, 2, "Section-header", "H5"),
              (1.6, 1, "Section-header", "H6"), (1.4, 0, "Section-header", "Other-Heading"),
              (1.2, 0, "Title", "H1"), (1.2, 0, "Section-header", "Other-Heading")]
    df = spark.createDataFrame([("d", 1, i, size, weight, 0.1 * i, kind) for i, (size, weight, kind, _) in enumerate(judged)],
                               "doc_name string, page_no int, ann_id int, relative_font_size double, font_weight int, norm_y double, category string")
    got = {r["ann_id"]: r["heading_level"] for r in L.assign_heading_levels(df).collect()}
    assert got == {i: level for i, (*_, level) in enumerate(judged)}
