"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words.  From every stretch of
``span`` words winnowing keeps the smallest hash of the k-grams inside it, so
two texts that share a stretch of that length share a fingerprint: none is
missed.  Fingerprints of documents and items are joined, and only around the
places of joined fingerprints are the word windows themselves compared.  Items
shorter than ``span`` are windows of their own length and have their own
fingerprints.  Only native expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import let, lower_ascii, stage, steps

#: Words of a window, and of a k-gram at most.
SPAN, GRAM = 10, 5
#: Broadcast a table of at most so many rows (of some 100 bytes each); join by shuffle beyond.
SMALL_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for a null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram_hashes(ws: Column, span: int) -> Column:
    """Hashes of all k-grams that serve windows of ``span`` words; the span is
    part of the hash, so fingerprints of different spans never meet."""
    k = min(GRAM, span)

    def grams(h):
        return F.transform(steps(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(
            F.lit(span), *[F.get(h, i.cast("int") + j) for j in range(k)]))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), grams)


def fingerprints(ws: Column, span: int) -> Column:
    """The winnowed k-gram hashes of a word array, each once."""
    width = span - min(GRAM, span) + 1
    if width == 1:
        return F.array_distinct(gram_hashes(ws, span))
    return F.array_distinct(let(gram_hashes(ws, span), lambda g: F.transform(
        steps(F.lit(1), F.size(g) - width + 1), lambda i: F.array_min(F.slice(g, i.cast("int"), width)))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _windows(ws: Column, starts: Column, span: int) -> Column:
    return F.transform(starts, lambda i: F.struct(
        i.cast("int").alias("start"), F.array_join(F.slice(ws, i.cast("int") + 1, span), " ").alias("window")))


def _starts_near(ws: Column, fps: Column, span: int) -> Column:
    """Starts of all windows of ``span`` words that hold a k-gram of ``fps``."""
    back = span - min(GRAM, span)

    def starts(g):
        matched = F.filter(steps(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(fps, F.get(g, i.cast("int"))))
        return F.array_distinct(F.flatten(F.transform(matched, lambda i: steps(
            F.greatest(F.lit(0).cast("long"), i - back), F.least(i, (F.size(ws) - span).cast("long"))))))

    return let(gram_hashes(ws, span), starts)


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item, words, span): items without words or without an id give none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    return (items.where(F.col("item").isNotNull() & (F.size("words") > 0))
            .withColumn("span", F.least(F.size("words"), F.lit(span))))


def text_key(text: Column) -> Column:
    """MD5 of a text (null: of the empty one)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit (words
    inside any occurrence of an item's window), n_items, items_sha256 (the ids
    sorted as strings, comma-joined) and contaminated."""
    return keyed_contamination(docs, benchmark, span).drop("key")


def clean_documents(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` without a hit, unchanged."""
    hit = stage(keyed_contamination(docs, benchmark, span).where("contaminated").select("key").distinct())
    return docs.join(_small(hit), text_key(docs["text"]) == hit["key"], "left_anti")


def keyed_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """``contamination`` with the text's key.

    Equal texts are compared once.  Null texts have no words; repeated rows
    are kept; an empty benchmark leaves every document clean.
    """
    items = stage(benchmark_windows(benchmark, span))
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())  # at most ``span`` numbers
    empty = F.array().cast("array<bigint>")
    sheet = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("words"))
    sheet = stage(sheet.select("doc_id", "key", F.size("words").cast("long").alias("n_words"),
                               (F.concat(*[fingerprints(F.col("words"), s) for s in spans]) if spans else empty)
                               .alias("fps")))

    marks = items.select(F.explode(
        F.concat(*[F.when(F.col("span") == s, fingerprints(F.col("words"), s)).otherwise(empty) for s in spans])
        if spans else empty).alias("fp")).distinct()
    found = stage(sheet.select("key", F.explode("fps").alias("fp")).join(_small(marks), "fp")
                  .groupBy("key").agg(F.collect_set("fp").alias("fps")))

    # texts with a joined fingerprint, each once, extended around its places
    texts = (docs.select(text_key(F.col("text")).alias("key"), "text").join(_small(found.select("key")), "key", "left_semi")
             .groupBy("key").agg(F.first("text").alias("text")).join(found, "key")
             .select("key", "fps", words(F.col("text")).alias("words")))
    texts = stage(texts)  # else the optimizer would cut a text into words anew for every window
    near = []
    for s in spans:
        starts = _starts_near(F.col("words"), F.col("fps"), s)
        near.append(texts.select("key", F.lit(s).alias("span"), F.explode(_windows(F.col("words"), starts, s)).alias("w"))
                    .select("key", "span", "w.*"))
        known = items.where(F.col("span") == s).select("item", F.explode(_windows(
            F.col("words"), steps(F.lit(0), F.size("words") - s), s)).alias("w")).select("item", "w.window")
        known = known.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
        near[-1] = near[-1].join(_small(stage(known)), "window").drop("window")
    if not near:
        return sheet.select("doc_id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                            F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    hits = near[0]
    for more in near[1:]:
        hits = hits.unionByName(more)
    hits = stage(hits)
    n_hit = (hits.select("key", F.explode(F.sequence("start", F.col("start") + F.col("span") - 1)).alias("at")).distinct()
             .groupBy("key").agg(F.count("*").alias("n_hit")))
    per_text = (hits.select("key", F.explode("items").alias("item")).distinct().groupBy("key")
                .agg(F.sort_array(F.collect_list("item")).alias("items")).join(n_hit, "key"))
    return (sheet.drop("fps").join(per_text, "key", "left")
            .select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated")))
