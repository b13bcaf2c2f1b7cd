"""The streaming form of outline extraction processes new span files."""
import tempfile

from pagewise.sources import fixtures as FX
from pagewise.streaming.outline_stream import start_outline_stream

from conftest import SF001


def test_stream_processes_each_file(spark):
    base = tempfile.mkdtemp(prefix="pagewise-stream-", dir="/tmp")
    docs = FX.read_table(spark, SF001, "documents").where("doc_id < 6")
    spans = FX.spans(docs)
    spans.where("doc_id < 3").coalesce(1).write.parquet(f"{base}/in/part1")
    spans.where("doc_id >= 3").coalesce(1).write.parquet(f"{base}/in/part2")
    q = start_outline_stream(spark, f"{base}/in/*", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1,
                             available_now=True)
    q.awaitTermination(300)
    out = spark.read.json(f"{base}/out")
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5]
    assert out.select("batch_id").distinct().count() == 2
    assert {r["status"] for r in out.collect()} <= {"ok", "empty"}
