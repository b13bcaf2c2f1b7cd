"""Parsed page layout input (spans).

Parsing PDF bytes is a per-file, single-library step done upstream; the
library starts from a spans table with the schema below (one row per text
span), stored as parquet and partitioned however the producer likes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagewise.operators.blocks import text_spans

SPANS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("page_num", T.IntegerType()),
    T.StructField("line_no", T.IntegerType()), T.StructField("span_no", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType()),
    T.StructField("font", T.StringType()),
    T.StructField("x0", T.DoubleType()), T.StructField("y0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()),
    T.StructField("page_width", T.DoubleType()), T.StructField("page_height", T.DoubleType()),
    T.StructField("block_type", T.IntegerType()),
])


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Text spans (non-text blocks dropped); the reader's schema is fixed so
    the scan prunes columns and pushes filters into parquet."""
    return text_spans(spark.read.schema(SPANS_SCHEMA).parquet(path))
