"""Outline JSON sink and source.

``write_outlines`` writes one JSON object per document (title and ordered
outline entries, non-ASCII kept) as JSON lines with a ``doc_id`` field --
one distributed write, one line per document.  ``read_outlines`` reads
outline files (one JSON object per file, e.g. ``*_expected.json``) into
flat (doc, level, stripped text) rows keyed by the file stem; missing keys
become '' / an empty outline and ``page`` is kept but not compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.functions.text import file_stem, py_strip

OUTLINE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("outline", T.ArrayType(T.StructType([
        T.StructField("level", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("page", T.LongType())]))),
])


def write_outlines(nested: DataFrame, path: str, key: str = "doc_id") -> None:
    """``nested``: (key, title, outline array) as built by
    ``plans.outlines.nested_outline``."""
    nested.select(key, "title", "outline").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_outlines(spark: SparkSession, path: str, glob: str = "*.json", suffix: str = "") -> DataFrame:
    """(doc, seq, level, text, page): one row per outline entry of every
    matching file; ``doc`` is the file stem without ``suffix``."""
    raw = (spark.read.schema(OUTLINE_SCHEMA).option("multiLine", True).option("pathGlobFilter", glob)
           .json(path).select(F.col("_metadata.file_name").alias("file_name"), "title", "outline"))
    stem = file_stem("file_name")
    if suffix:
        stem = F.regexp_replace(stem, re.escape(suffix) + "$", "")
    rows = raw.select(stem.alias("doc"), F.posexplode_outer("outline").alias("seq", "e"))
    return rows.select("doc", "seq", F.coalesce(F.col("e.level"), F.lit("")).alias("level"),
                       py_strip(F.coalesce(F.col("e.text"), F.lit(""))).alias("text"), F.col("e.page").alias("page"))


def outline_files(spark: SparkSession, path: str, glob: str = "*.json", suffix: str = "") -> DataFrame:
    """The documents that have a file (even with an empty outline)."""
    raw = (spark.read.schema(OUTLINE_SCHEMA).option("multiLine", True).option("pathGlobFilter", glob)
           .json(path).select(F.col("_metadata.file_name").alias("file_name")))
    stem = file_stem("file_name")
    if suffix:
        stem = F.regexp_replace(stem, re.escape(suffix) + "$", "")
    return raw.select(stem.alias("doc"))
