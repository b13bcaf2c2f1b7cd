"""Scalar features against Python's own string semantics."""
import re
import string

import pytest

from pagewise.functions import text as T
from pagewise.functions.rounding import py_round1

EDGE = ["", "   ", " x ", "平成３１年", "１２", "---", "ß", "2.", "2.1 x", "1.2.3abc", "😀",
        "ABC", "Abc", "A", "AB1", "ǅx", "  HEAD 　", "x\x1cy", "a  b\tc", "1.2. Intro"]


def py_features(t):
    s = t.strip()
    m = re.match(r"^\d+(\.\d+)*", s)
    return {
        "strip": s,
        "words": len(t.split()),
        "length": len(t),
        "upper": t.isupper(),
        "depth": len(m.group(0).split(".")) if m else 0,
        "punct": (sum(1 for c in t if c in string.punctuation) / len(t)) if t else 0.0,
    }


def test_text_features_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "i int, t string")
    rows = df.select("i", T.py_strip("t").alias("strip"), T.num_words("t").alias("words"),
                     T.text_length("t").alias("length"), T.is_upper("t").alias("upper"),
                     T.numbering_depth(T.py_strip("t")).alias("depth"), T.percent_punct("t").alias("punct")).collect()
    for r in rows:
        exp = py_features(EDGE[r["i"]])
        assert r["strip"] == exp["strip"], EDGE[r["i"]]
        assert r["words"] == exp["words"], EDGE[r["i"]]
        assert r["length"] == exp["length"], EDGE[r["i"]]
        assert bool(r["upper"]) == exp["upper"], EDGE[r["i"]]
        assert r["depth"] == exp["depth"], EDGE[r["i"]]
        assert r["punct"] == pytest.approx(exp["punct"]), EDGE[r["i"]]


def test_font_weight(spark):
    names = [None, "", "Arial-BoldMT", "Arial-Black", "Helvetica-HEAVY", "Times-Roman", "boldface"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(T.font_weight("n")).collect()]
    assert got == [0, 0, 1, 2, 2, 0, 1]


def test_file_stem(spark):
    paths = ["PNG/p1_2.png", "a/b/c.tar.gz", ".bashrc", "dir/..x", "a..b", "noext"]
    import os
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(T.file_stem("p")).collect()]
    assert got == [os.path.splitext(os.path.basename(p))[0] for p in paths]


def test_python_round_one_decimal(spark):
    vals = [0.35, 0.65, 1.25, 0.05, 0.15, 0.25, 2.675, 1.05, 1.15, 0.45, 0.55, 0.95, 3.45, 12.35, 63.95,
            0.04, 0.031, 0.03, 1e-9, 0.0, -0.35, -1.25, 70.25, 1234.56, float("nan"), float("inf")]
    vals += [i / 40 for i in range(0, 400)] + [1 + i * 0.0125 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(py_round1("x")).collect()]
    for v, g in zip(vals, got):
        if v != v:
            assert g != g
        else:
            assert g == round(v, 1), v


def test_coerce_numeric(spark):
    from pagewise.operators.features import coerce_numeric
    df = spark.createDataFrame([("12.5",), ("abc",), ("",), (None,), ("7",), ("NaN",)], "v string")
    assert [r[0] for r in coerce_numeric(df, ["v"]).collect()] == [12.5, 0.0, 0.0, 0.0, 7.0, 0.0]


def test_coerce_numeric_doubles(spark):
    from pagewise.operators.features import coerce_numeric
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,), (float("inf"),)], "v double")
    assert [r[0] for r in coerce_numeric(df, ["v"]).collect()] == [1.5, 0.0, 0.0, float("inf")]


def test_no_java_suffixes(spark):
    from pagewise.operators.features import FEATURES, coerce_numeric
    from pagewise.operators.ml import prepare
    df = spark.createDataFrame([("1d",), ("2f",), (" 3.5 ",), ("1e2",), ("x",)], "v string")
    assert [r[0] for r in coerce_numeric(df, ["v"]).collect()] == [0.0, 0.0, 3.5, 100.0, 0.0]
    feats = df.selectExpr(*[f"v as {c}" for c in FEATURES], "1 as is_heading")
    assert [r[0] for r in prepare(feats).select(FEATURES[0]).collect()] == [0.0, 0.0, 3.5, 100.0, 0.0]


def test_words_are_counted_without_a_match_each(spark):
    from pyspark.sql import functions as F
    assert "regexp" not in str(T.num_words(F.col("t")))
    texts = ["", " ", "a", " a  b ", "a\x01b \x02 \x01\x02", "\x02\x01", "x\x1cy　z  w", "\x01 \x01", "é 𐐀   ü" * 3, "\n\t a\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r[0] for r in df.select(T.num_words("t")).collect()]
    assert got == [len(t.split()) for t in texts] + [0]


def test_only_likely_numbers_are_cast(spark):
    from pyspark.sql import functions as F
    good = {"1": 1.0, " 2.5 ": 2.5, "\t3": 3.0, "+4": 4.0, "-.5": -0.5, "1e3": 1000.0, "0x1p3": 8.0, "inf": float("inf"), "Infinity": float("inf"),
            "-INF": float("-inf"), "iNF": float("inf"), "+infinity": float("inf"), "0x1.8p1": 3.0}
    bad = ["", " ", "word", "information", "nano", "1d", "2.f", "d", "f", "-", "+d", "٣", "in", "1,5", "1 2"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, "NaN", "nan"]] + [(None,)], "t string")
    cast = F.col("t").try_cast("double")
    rows = df.select("t", T.to_number(F.col("t")).alias("v"), cast.alias("c")).collect()
    assert {r["t"]: r["v"] for r in rows if r["t"] in good} == good
    assert [r["v"] for r in rows if r["t"] in bad or r["t"] is None] == [None] * (len(bad) + 1)
    assert all(r["v"] != r["v"] for r in rows if r["t"] in ("NaN", "nan"))
    assert all(str(r["v"]) == str(r["c"]) for r in rows if r["t"] not in ("1d", "2.f"))
    many = spark.createDataFrame([(chr(i) + x,) for i in range(1, 0x250) for x in ("1", "", "nf", "an")], "t string")
    old = F.when(~F.trim("t").rlike(r"[0-9.][dDfF]\z"), F.trim("t").try_cast("double"))
    assert all(str(r[0]) == str(r[1]) for r in many.select(T.to_number(F.col("t")), old).collect())
