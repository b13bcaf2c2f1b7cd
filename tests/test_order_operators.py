"""Order-dependent operators against plain-Python loops on random input."""
import random

from pyspark.sql import functions as F

from pagewise.operators import blocks as B
from pagewise.operators import outline as O


def py_levels(sizes, tol=0.05, cap=6):
    """Stack rule: topmost entry k with |c-s| <= tol (sibling) or c < s-tol
    (child); the top tests child first, deeper entries sibling first."""
    stack, out = [], []
    for c in sizes:
        k = None
        for i in range(len(stack) - 1, -1, -1):
            s = stack[i][1]
            sib = abs(c - s) <= tol
            child = c < s - tol
            if sib or child:
                k, use_child = i, (child if i == len(stack) - 1 else not sib)
                break
        if k is None:
            lvl, stack = 1, [(1, c)]
        elif use_child:
            lvl = min(stack[k][0] + 1, cap)
            stack = stack[:k + 1] + [(lvl, c)]
        else:
            lvl = stack[k][0]
            stack = stack[:k] + [(lvl, c)]
        out.append(lvl)
    return out


def sequences(rng):
    seqs = [[1.5] * 5, [2.0 - 0.04 * i for i in range(12)], [3.0 - 0.2 * i for i in range(10)],
            [1.2, 1.8, 2.5, 1.0, 3.0, 1.2], [1.5, float("nan"), 1.4, 1.5], [2.0, 1.5, 1.0, 1.5, 2.0, 1.0]]
    for _ in range(40):
        n = rng.randint(1, 25)
        seqs.append([round(rng.choice([0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0]) + rng.uniform(-0.06, 0.06), 3)
                     for _ in range(n)])
    return seqs


def test_outline_fold_matches_python(spark):
    rng = random.Random(7)
    seqs = sequences(rng)
    rows = []
    for d, seq in enumerate(seqs):
        per = rng.choice([1, 2, 3, 5, 100])          # headings per page
        rows += [(d, 1 + i // per, float(i % per), i, s, f"t{i}") for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, norm_y double, block_no int, "
                                     "relative_font_size double, text string")
    for impl in (lambda x: O.outline_levels(x, carry=("text",)),
                 lambda x: O.outline_levels_by_page(x, carry=("text",)),
                 lambda x: O.outline_levels_by_page(x, carry=("text",), pages_per_block=2)):
        got = {}
        for r in impl(df).collect():
            got.setdefault(r["doc_id"], {})[r["seq"]] = (r["level_num"], r["text"])
        for d, seq in enumerate(seqs):
            exp = py_levels(seq)
            assert [got[d][i + 1][0] for i in range(len(seq))] == exp, seq
            assert [got[d][i + 1][1] for i in range(len(seq))] == [f"t{i}" for i in range(len(seq))]


def py_blocks(lines):
    """lines: (line_no, y0, y1, size, font) of one page -> block per line."""
    def wt(f):
        n = (f or "").lower()
        return 2 if ("black" in n or "heavy" in n) else (1 if "bold" in n else 0)
    order = sorted(lines, key=lambda l: (l[1], l[0]))
    out, blk, prev = {}, 0, None
    for ln in order:
        if prev is None or not (ln[1] - prev[2] < prev[3] * 0.5 and abs(ln[3] - prev[3]) < 1 and wt(ln[4]) == wt(prev[4])):
            blk += 1
        out[ln[0]] = blk
        prev = ln
    return out


def test_group_lines_matches_python(spark):
    rng = random.Random(3)
    rows, pages = [], {}
    for page in range(30):
        y = 10.0
        for ln in range(rng.randint(1, 15)):
            y += rng.choice([0, 5, 10, 14, 30])
            size = rng.choice([10.0, 10.5, 11.2, 14.0])
            font = rng.choice(["Times", "Times-Bold", "Arial-Black"])
            h = rng.choice([8.0, 12.0])
            rows.append((1, page, ln, "x", 0.0, y, 10.0, y + h, size, font, 600.0, 800.0))
            pages.setdefault(page, []).append((ln, y, y + h, size, font))
    df = spark.createDataFrame(rows, "doc_id long, page_num int, line_no int, text string, x0 double, y0 double, "
                                     "x1 double, y1 double, size double, font string, page_width double, page_height double")
    got = {(r["page_num"], r["line_no"]): r["block_no"] for r in B.group_lines(df).collect()}
    for page, lines in pages.items():
        for ln, b in py_blocks(lines).items():
            assert got[(page, ln)] == b


def test_lines_to_blocks_first_line_and_union(spark):
    rows = [(1, 1, 0, "Title", 50.0, 10.0, 300.0, 30.0, 18.0, "Arial-Black", 612.0, 792.0),
            (1, 1, 1, "continues", 40.0, 31.0, 310.0, 50.0, 18.2, "Arial-Black", 612.0, 792.0),
            (1, 1, 2, "Body text", 50.0, 200.0, 500.0, 212.0, 10.0, "Times", 612.0, 792.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, line_no int, text string, x0 double, y0 double, "
                                     "x1 double, y1 double, size double, font string, page_width double, page_height double")
    blocks = {r["block_no"]: r for r in B.merge_lines(df).collect()}
    assert blocks[1]["text"] == "Title continues" and blocks[1]["n_lines"] == 2
    assert (blocks[1]["x0"], blocks[1]["y0"], blocks[1]["x1"], blocks[1]["y1"]) == (40.0, 10.0, 310.0, 50.0)
    assert blocks[1]["font_size"] == 18.0 and blocks[2]["text"] == "Body text"


def test_detect_title_rules(spark):
    rows = [(1, 1, 1, 0.1, 1.5, "  Small  "), (1, 2, 2, 0.2, 1.0, "Second"),    # doc 1: H1 on page 1
            (2, 1, 2, 0.5, 1.2, "Sub"), (2, 2, 1, 0.1, 2.0, "Later")]          # doc 2: no H1 on page 1
    df = spark.createDataFrame(rows, "doc_id long, seq int, level_num int, norm_y double, relative_font_size double, "
                                     "text string").withColumn("page_num", F.when(F.col("seq") == 1, 1).otherwise(
                                         F.when(F.col("doc_id") == 1, 1).otherwise(2)))
    got = {r["doc_id"]: r["title"] for r in O.detect_title(df).collect()}
    assert got == {1: "Small", 2: "Sub"}
