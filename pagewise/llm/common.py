"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewise.session import BATCH_BYTES, bounded_batches, stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body(value)``."""
    return F.transform(F.array(value), body).getItem(0)


def unit_interval(*keys: Column) -> Column:
    """A uniform double in [0, 1) decided by the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0 ** -53)


def steps(first: Column, last: Column) -> Column:
    """first, first + 1, ..., last; empty when last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else.  ``lower`` is much the faster, and
    equal on texts without other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def successors(ids: DataFrame, column: str, rows_per_part: int = 20_000) -> DataFrame:
    """(column, next_id) for distinct ids in ascending order; the last id's
    successor is the first.

    Range partitions hold bounded runs of ids; the only order over the whole
    table is that of one row per partition.
    """
    ids = ids.select(column).where(F.col(column).isNotNull()).distinct()
    parts = max(1, -(-ids.count() // rows_per_part))
    ranged = stage(ids.repartitionByRange(parts, column).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(column)
    heads = ranged.groupBy("part").agg(F.min(column).alias("head"))
    over_parts = Window.orderBy("part")
    heads = heads.select(
        "part",
        F.coalesce(F.lead("head").over(over_parts),
                   F.first("head").over(over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .alias("next_head"))
    return (ranged.withColumn("next_id", F.lead(column).over(inside)).join(heads, "part")
            .select(column, F.coalesce("next_id", "next_head").alias("next_id")))
