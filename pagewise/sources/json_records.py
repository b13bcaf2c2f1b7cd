"""Records of large JSON files, read by many tasks.

A file is one JSON object whose fields are arrays of objects.  Read as one
document it is one task's work; ``section_records`` reads it as text that ends
at every ``}``, so that Spark splits it like any text file, and then finds out
for each piece where it stands:

* whether it starts inside a string: the parity of the quotes before it;
* at which depth it starts: the braces outside strings before it.

Both are sums over all earlier pieces of the file, taken in two levels: inside
a split of the file (a window over its pieces) and over the splits (a window
over one row a split).  A record is what lies between the brace that opens
depth 2 and the one that closes it: one piece if nothing is nested in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewise.session import stage

# A string, and the text before the brace that opens a record: on the first
# piece of a file the brace of the whole object comes first.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_HEAD = rf'(?s)^((?:[^"{{]++|{_STRING})*+)\{{'
_FIRST_HEAD = rf'(?s)^[^{{]*+\{{((?:[^"{{]++|{_STRING})*+)\{{'
_FIELD = r'(?s)"((?:[^"\\]|\\.)*)"\s*:\s*\[?\s*$'


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what)))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, size, block, seq, value, bytes, quotes, opened, opened_in): the pieces with
    their unescaped quotes and the braces outside strings, if the piece starts
    outside (``opened``) or inside a string (``opened_in``)."""
    raw = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")
    clean = F.regexp_replace("value", r"(?s)\\.", "")

    def outside(text):
        return F.regexp_replace(text, r'"[^"]*+("|$)', "")

    return raw.select("*", F.octet_length("value").alias("bytes"), _count(clean, '"').alias("quotes"), _count(outside(clean), "{").alias("opened"),
                      _count(outside(F.concat(F.lit('"'), clean)), "{").alias("opened_in"))


def _up_to(keys: list[str], order: str, last: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def _sum_before(pieces: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``col`` over all earlier pieces of the file."""
    blocks = pieces.groupBy("file", "block").agg(F.sum(col).alias("_sum"))  # one row a split of a file
    before = blocks.select("file", "block", F.coalesce(F.sum("_sum").over(_up_to(["file"], "block", -1)), F.lit(0)).alias("_before"))
    return pieces.join(before, ["file", "block"]).withColumn(
        out, F.col("_before") + F.coalesce(F.sum(col).over(_up_to(["file", "block"], "seq", -1)), F.lit(0))).drop("_before")


def _last_before(pieces: DataFrame, col: str, at: Column) -> DataFrame:
    """Fill ``col`` with its last value that is not null, over the whole file."""
    blocks = pieces.groupBy("file", "block").agg(F.max_by(col, F.when(F.col(col).isNotNull(), at)).alias("_last"))
    before = blocks.select("file", "block", F.last("_last", ignorenulls=True).over(_up_to(["file"], "block", -1)).alias("_before"))
    here = _up_to(["file", "block"], "seq", 0)
    return pieces.join(before, ["file", "block"]).withColumn(
        col, F.coalesce(F.last(col, ignorenulls=True).over(here), "_before")).drop("_before")


def section_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, section, json): every object that a field of a file's one object
    holds, alone or in an array, with the name of the field.

    Braces and quotes in strings, escapes, nested objects and white space
    anywhere are read as JSON reads them; empty arrays and empty objects give
    no row or one.  A file that ends before its object does (cut off), or that
    holds no object, raises ``ValueError``, as its rows would be incomplete."""
    pieces = stage(_pieces(spark, paths))
    placed = _sum_before(pieces, "quotes", "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    ends_outside = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    placed = placed.withColumn("opens", F.when(inside, F.col("opened_in")).otherwise(F.col("opened"))).withColumn(
        "change", F.col("opens") - ends_outside.cast("int"))
    placed = _sum_before(stage(placed), "change", "depth")
    starts = (F.col("depth") <= 1) & (F.col("depth") + F.col("opens") >= 2)
    text = F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), F.col("value"))
    head = F.when(F.col("depth") == 0, F.regexp_extract(text, _FIRST_HEAD, 1)).otherwise(F.regexp_extract(text, _HEAD, 1))
    from_brace = F.when(F.col("depth") == 0, F.regexp_replace(text, _FIRST_HEAD, "{")).otherwise(F.regexp_replace(text, _HEAD, "{"))
    ends = F.col("depth") + F.col("change")
    found = placed.select(
        "file", "block", "seq", starts.alias("starts"), (starts & (ends == 1)).alias("whole"), "depth", ends.alias("ends"), "opens",
        F.when(starts, F.struct("block", "seq")).alias("record"),
        # after a comma the field stays
        F.when(starts & (F.btrim(head, F.lit(" \t\r\n")) != ","), F.regexp_extract(head, _FIELD, 1)).alias("section"),
        F.concat(F.when(starts, from_brace).otherwise(F.col("value")), F.lit("}")).alias("json"))
    found = stage(found.where("depth + opens >= 1"))
    _require_whole(found, pieces, len(paths))
    here = F.struct("block", "seq")
    named = _last_before(found.where("starts or depth >= 2"), "section", here)
    whole = named.where("whole").select("file", "section", "json")
    parts = _last_before(named.where("not whole"), "record", here)
    nested = parts.groupBy("file", "record").agg(
        F.max_by("section", F.col("starts")).alias("section"), F.array_sort(F.collect_list(F.struct("block", "seq", "json"))).alias("parts"))
    joined = nested.select("file", "section", F.array_join(F.transform("parts", lambda p: p["json"]), "").alias("json"))
    return whole.unionByName(joined)


def _require_whole(found: DataFrame, pieces: DataFrame, files: int) -> None:
    """Each of the files has a piece that closes its object, with the brace in
    the file: the last piece has none if pieces and braces are longer than the file."""
    ends = pieces.groupBy("file").agg(F.max(F.struct("block", "seq")).alias("last"), (F.sum(F.col("bytes") + 1) > F.max("size")).alias("open_end"))
    closing = found.where("ends = 0").groupBy("file").agg(F.min(F.struct("block", "seq")).alias("at"))
    whole = ends.join(closing, "file").where("at < last or not open_end").count()
    if whole < files:
        raise ValueError(f"no whole JSON object in {files - whole} of {files} files")
