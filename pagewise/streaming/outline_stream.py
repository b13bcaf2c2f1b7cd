"""Incremental outline extraction over a folder of span files.

The batch entry point (``plans.outlines.score_corpus``) processes a whole
folder at once.  This is its Structured Streaming form: a file source
watches a folder where a producer drops parsed span files (one or more
whole documents per file), and every micro-batch runs the same batch plan
through ``foreachBatch``:

* outlines are written per batch to ``<out>/batch_id=<n>`` with overwrite,
  so a replayed batch (after a driver or executor failure) rewrites the
  same folder -- idempotent output;
* the file source and the checkpoint location record which files were
  processed, so a restart continues where it stopped.

A document's spans must arrive in one file (the outline of a document is
computed from all of its pages).  No state is kept across batches: every
operator of the outline plan is per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.operators import blocks as B
from pagewise.plans import outlines as PO
from pagewise.sources.layout import SPANS_SCHEMA


def outline_batch(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """Run the outline plan on one micro-batch of spans and write the
    nested outlines (one JSON line per document)."""
    lines = B.spans_to_lines(batch)
    docs = batch.select("doc_id").distinct()
    status, flat = PO.corpus_outlines(docs, lines)
    outlines = PO.nested_outline(flat)
    status = status.select("doc_id", "status", "error", "n_headings")
    (outlines.join(status, "doc_id", "right").withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").json(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))


def start_outline_stream(spark: SparkSession, spans_dir: str, out_dir: str, checkpoint_dir: str,
                         max_files_per_trigger: int | None = None, available_now: bool = False):
    """Start the stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(SPANS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    spans = reader.parquet(spans_dir)
    writer = (spans.writeStream.foreachBatch(lambda df, bid: outline_batch(df, bid, out_dir))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
