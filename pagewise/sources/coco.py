"""COCO annotation files and page-cell files.

``read_coco`` and ``read_cells`` read JSON with explicit schemas (no
inference); ``clean_cells`` applies the cell rules.  An annotation file holds
a whole split, so it is read by many tasks (``json_records``).  A cell file is
one page, read as one document (``multiLine``): many files, one task each or
several small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.functions.text import file_stem, to_number
from pagewise.session import stage
from pagewise.sources.json_records import section_records

COCO_SCHEMA = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()),
        T.StructField("doc_name", T.StringType()), T.StructField("page_no", T.IntegerType()),
        T.StructField("coco_width", T.DoubleType()), T.StructField("coco_height", T.DoubleType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()),
        T.StructField("category_id", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]))),
    T.StructField("categories", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))),
])

CELLS_SCHEMA = T.StructType([
    T.StructField("cells", T.ArrayType(T.StructType([
        T.StructField("bbox", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
        T.StructField("font", T.StructType([T.StructField("size", T.StringType()),
                                            T.StructField("name", T.StringType())]))]))),
])

SPLITS = ("train", "val", "test")


def read_coco(spark: SparkSession, coco_dir: str, splits=SPLITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories).  Images and annotations of all
    splits are concatenated with a ``split`` column; categories come from the
    first split only.

    All files are read in one pass by as many tasks as their size asks for
    (``section_records``), and the records are stored once for the three
    tables.  A file that is cut off raises ``ValueError``."""
    paths = {s: f"{coco_dir.rstrip('/')}/{s}.json" for s in splits}
    stem = F.regexp_extract("file", r"([^/]*)\.json$", 1)
    wanted = section_records(spark, list(paths.values())).where(F.col("section").isin(*COCO_SCHEMA.names))
    records = stage(wanted.select(stem.alias("split"), "section", "json"))

    def section(name):
        schema = COCO_SCHEMA[name].dataType.elementType
        return records.where(F.col("section") == name).select("split", F.from_json("json", schema).alias("r"))

    images = section("images").select(
        F.col("r.id").alias("image_id"), "r.file_name", "r.doc_name", "r.page_no", "r.coco_width", "r.coco_height", "split")
    anns = section("annotations").select(
        F.col("r.id").alias("ann_id"), "r.image_id", "r.category_id", *[F.get("r.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")], "split")
    cats = section("categories").where(F.col("split") == splits[0]).select(F.col("r.id").alias("category_id"), F.col("r.name").alias("name"))
    return images, anns, cats


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Concatenate per-split tables, tagging each row with its split."""
    out = None
    for name, df in parts.items():
        t = df.withColumn("split", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def read_cells(spark: SparkSession, json_dir: str) -> DataFrame:
    """Raw cells of every ``*.json`` page file: page_key (file stem),
    cell_no, bbox (strings), text, font."""
    raw = (spark.read.schema(CELLS_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json")
           .json(json_dir).select(F.col("_metadata.file_name").alias("file_name"), "cells"))
    return raw.select(file_stem("file_name").alias("page_key"), F.posexplode("cells").alias("cell_no", "c")).select(
        "page_key", "cell_no", F.col("c.bbox").alias("bbox"), F.col("c.text").alias("text"), F.col("c.font").alias("font"))


def cell_file_errors(spark: SparkSession, json_dir: str) -> DataFrame:
    """(page_key, error): the ``*.json`` page files that are no JSON object;
    ``read_cells`` has no rows of them."""
    schema = T.StructType([*CELLS_SCHEMA, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(json_dir)
    bad = raw.select(F.col("_metadata.file_name").alias("file_name"), "cells", "_corrupt_record").where("_corrupt_record is not null and cells is null")
    return bad.select(file_stem("file_name").alias("page_key"), F.lit("unreadable record").alias("error")).distinct()


def clean_cells(raw: DataFrame, require_box: bool = True) -> DataFrame:
    """Numeric bbox (x, y, w, h); cells whose box does not have exactly four
    numbers are dropped (``require_box``) or kept with null coordinates;
    missing text -> '', size -> 0, font name -> ''."""
    nums = F.transform(F.coalesce(F.col("bbox").cast("array<string>"), F.array().cast("array<string>")),
                       to_number)
    d = raw.withColumn("_b", nums)
    valid = (F.size("_b") == 4) & F.forall("_b", lambda v: v.isNotNull())
    if require_box:
        d = d.where(valid)
    box = [F.when(valid, F.col("_b")[i]).alias(n) for i, n in enumerate(("x", "y", "w", "h"))]
    size = F.coalesce(to_number(F.col("font.size").cast("string")), F.lit(0.0))
    return d.select("page_key", "cell_no", *box, F.coalesce("text", F.lit("")).alias("text"),
                    size.alias("font_size"), F.coalesce(F.col("font.name"), F.lit("")).alias("font_name"))
