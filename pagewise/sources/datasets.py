"""Dataset persistence: parquet tables and the feature CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_dataset(df: DataFrame, path: str, partition_by=None) -> None:
    """Replace the whole output (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_augmented(df: DataFrame, path: str) -> None:
    """Parquet with the detected ``language`` column."""
    if "language" not in df.columns:
        raise ValueError("expected a 'language' column")
    save_dataset(df, path)


def write_features_csv(df: DataFrame, path: str) -> None:
    """Full feature table as CSV with a header; array/struct columns (the
    box) are written as JSON text."""
    cols = []
    for name, dtype in df.dtypes:
        if dtype.startswith(("array", "struct", "map")):
            cols.append(F.to_json(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
