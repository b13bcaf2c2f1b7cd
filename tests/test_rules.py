"""Heading rules on texts judged by hand."""
from pyspark.sql import functions as F

from pagewise.operators import rules as R

#: (text, kept, why)
CASES = [
    ("12/05/2024 release", False, "starts with a date"), ("March 5, 2024 report", False, "starts with a date"),
    ("mar 12 2020", False, "starts with a date"), ("Sept 5, 2024", False, "starts with a date"),
    ("Page 3", False, "page number"), ("page12", False, "page number"), ("10 20 30 40", False, "numbers only"),
    ("10  20  30 40", False, "numbers only"), ("1 2", False, "numbers only"), ("１２ ３４", False, "numbers only"),
    ("VERSION 2.1", False, "version line"), ("Document version", True, "version is not in front"),
    ("Copyright 2020", False, "copyright line"), ("- bullet", False, "bullet"), ("• item", False, "bullet"),
    ("-nobullet", True, "no space after the dash"), ("ab", False, "two letters"), ("A", False, "one letter"),
    ("abc", True, "three letters"), ("Item  10  20  30", False, "table row with three numbers"),
    ("Q1  Q2  Q3 1 2 3", False, "table row"), ("Intro", True, "plain"), ("第１章　概要", True, "plain"),
    ("42", True, "a single number"),
]


def test_rules_on_judged_texts(spark):
    df = (spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, text string")
          .withColumn("percent_punct", F.lit(0.0)).withColumn("num_words", F.lit(1)))
    got = {r["i"]: r["k"] for r in df.select("i", R.heading_rule_mask().alias("k")).collect()}
    for i, (text, kept, why) in enumerate(CASES):
        assert got[i] == kept, (text, why)
