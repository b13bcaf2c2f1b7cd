"""Layout tables derived from the driver's ``documents`` and ``labels``.

The reference consumes parsed PDF spans and COCO-annotated pages, neither of
which ships with it.  These functions derive equivalent tables from the
driver tables with deterministic arithmetic, so every query's work grows with
``documents``.  Each function is a narrow transformation (explode/project);
nothing here shuffles except ``images`` (a distinct over pages).

Derivation (fixed values of the fixture, shared with the SQL oracle): each
text line gets a ``kind`` = (7 doc_id + 13 line_no) mod 10, where 0-2 are
headings (0 title-like, 1 numbered, 2 plain), 3 a decoy that the rule
filters should remove, 4-9 body text.  Every 12th line is a running header.

The modulo expressions here are *structure rules* of the synthetic layout
(which line is a heading, which page lacks a size, which document has no
produced outline, ...).  Every word of every document is in the layout: a
heading's line is followed by a body line with the words that the heading does
not take, and decoys and running headers stand before the whole line.  Blank
and non-text spans, unmatched pages and cells and broken cells are extra rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lines(documents: DataFrame) -> DataFrame:
    """One row per ``\\n``-separated line: doc_id, line_no (0-based), raw."""
    return documents.select(
        "doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "raw"))


# Decoy texts of kind 3, by doc_id mod 12 (0 is a bullet built
# from the line itself).
DECOYS = {
    1: "12/05/2024 release",
    3: "10  20  30 40",
    4: "第１章　概要",
    5: "***---!!!",
    6: "42",
    7: "ab",
    8: "March 5, 2024 report",
    9: "Item  10  20  30",
    10: "VERSION 2.1",
    11: "Document version",
}


def _first_words(raw, n_extra: int):
    return F.regexp_extract(raw, r"^([^ ]+ ){0,%d}[^ ]+" % n_extra, 0)


def _other_words(raw, n_extra: int):
    return F.regexp_replace(raw, r"^([^ ]+ ){0,%d}[^ ]+ ?" % n_extra, "")


def layout(documents: DataFrame) -> DataFrame:
    """One text line with its box, font size and font name per row.  ``src`` is
    the document's line; ``line_no`` is twice that, one more for the body line
    with the words that a heading, decoy or running header leaves."""
    ln = lines(documents).withColumnRenamed("line_no", "src").withColumn(
        "kind", ((F.col("doc_id") * 7 + F.col("src") * 13) % 10).cast("int"))
    src, doc_id, kind, raw = F.col("src"), F.col("doc_id"), F.col("kind"), F.col("raw")
    page_num = (F.floor(src / 12) + 1).cast("int")
    decoy = F.when(doc_id % 12 == 0, F.concat(F.lit("- "), _first_words(raw, 2)))
    decoy = decoy.when(doc_id % 12 == 2, F.concat(F.lit("Page "), src.cast("string")))
    for k, v in DECOYS.items():
        decoy = decoy.when(doc_id % 12 == k, F.lit(v))
    text = (
        F.when(src % 12 == 0, F.concat(F.lit("Running Header "), doc_id.cast("string")))
        .when(kind == 0, F.upper(F.regexp_replace(_first_words(raw, 2), "ß", "s")))
        .when(kind == 1, F.concat(page_num.cast("string"), F.lit("."), (src % 12).cast("string"),
                                  F.lit(" "), _first_words(raw, 3)))
        .when((kind == 2) & (src % 3 == 0), _first_words(raw, 8))
        .when(kind == 2, _first_words(raw, 4))
        .when(kind == 3, decoy)
        .otherwise(raw)
    )
    rest = (
        F.when(src % 12 == 0, raw)
        .when(kind == 0, _other_words(raw, 2))
        .when(kind == 1, _other_words(raw, 3))
        .when((kind == 2) & (src % 3 == 0), _other_words(raw, 8))
        .when(kind == 2, _other_words(raw, 4))
        .when((kind == 3) & (doc_id % 12 == 0), _other_words(raw, 2))
        .when(kind == 3, raw)
        .otherwise("")
    )
    size = (
        F.when(kind == 0, 18.0)
        .when(kind == 1, 14.0 + (src % 4) * 0.8)
        .when(kind == 2, 12.0 + (src % 7) * 0.4)
        .when(kind == 3, 12.0)
        .when(kind == 9, 11.5)
        .otherwise(10.0 + (doc_id % 3) * 0.5)
    )
    font = (
        F.when(src % 12 == 0, "Helvetica")
        .when(kind == 0, "Arial-Black")
        .when(kind.isin(1, 3), "Arial-BoldMT")
        .otherwise("Times-Roman")
    )
    y0 = F.when(src % 12 == 0, 20).otherwise(40 + (src % 12) * 60)
    head = F.struct(
        F.lit(0).alias("k"), text.alias("text"),
        (50.0 + F.when(kind == 0, 150).otherwise((src % 3) * 5)).cast("double").alias("x0"), y0.cast("double").alias("y0"),
        F.when(kind.isin(0, 1, 2, 3), 250).otherwise(500).cast("double").alias("width"),
        F.when(kind.isin(4, 5), 58).otherwise(20).cast("double").alias("height"),
        size.cast("double").alias("size"), font.alias("font"), kind.alias("kind"))
    body = F.struct(
        F.lit(1).alias("k"), rest.alias("text"), (50.0 + (src % 3) * 5).cast("double").alias("x0"),
        F.when(src % 12 == 0, 85).otherwise(y0 + 25).cast("double").alias("y0"), F.lit(500.0).alias("width"),
        F.when(src % 12 == 0, 12).otherwise(20).cast("double").alias("height"),
        (10.0 + (doc_id % 3) * 0.5).cast("double").alias("size"), F.lit("Times-Roman").alias("font"), F.lit(6).alias("kind"))
    both = ln.select("doc_id", "src", page_num.alias("page_num"), F.explode(F.array(head, body)).alias("l"))
    return both.where("l.k = 0 or l.text <> ''").select(
        "doc_id", "page_num", (src * 2 + F.col("l.k")).cast("int").alias("line_no"), "l.text", "l.x0", "l.y0", "l.width", "l.height",
        "l.size", "l.font", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), "l.kind", "src")


def layout_lines(documents: DataFrame) -> DataFrame:
    """The layout as inference input: (x0,y0,x1,y1) boxes."""
    lay = layout(documents)
    return lay.select(
        "doc_id", "page_num", "line_no", "text", "x0", "y0",
        (F.col("x0") + F.col("width")).alias("x1"), (F.col("y0") + F.col("height")).alias("y1"),
        "size", "font", "page_width", "page_height")


def images(documents: DataFrame) -> DataFrame:
    """COCO image records; every fifth page has no size (default applies), and
    every seventh has a second record that no cell page matches."""
    return images_from(layout(documents))


def images_from(lay: DataFrame) -> DataFrame:
    no_size = F.col("page_num") % 5 == 0
    found = lay.select(
        (F.col("doc_id") * 1000 + F.col("page_num")).alias("image_id"),
        F.concat(F.lit("PNG/p"), F.col("doc_id").cast("string"), F.lit("_"),
                 F.col("page_num").cast("string"), F.lit(".png")).alias("file_name"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_name"),
        F.col("page_num").alias("page_no"),
        F.when(no_size, F.lit(None)).otherwise(F.col("page_width")).cast("double").alias("coco_width"),
        F.when(no_size, F.lit(None)).otherwise(F.col("page_height")).cast("double").alias("coco_height"),
    ).distinct()
    doubled = F.when(F.col("page_no") % 7 == 0, F.array(F.lit(0), F.lit(500))).otherwise(F.array(F.lit(0)))
    more = found.withColumn("more", F.explode(doubled))
    return more.select(
        (F.col("image_id") + F.col("more")).alias("image_id"),
        F.when(F.col("more") > 0, F.regexp_replace("file_name", "PNG/p", "PNG/n")).otherwise(F.col("file_name")).alias("file_name"),
        "doc_name", (F.col("page_no") + F.col("more")).alias("page_no"), "coco_width", "coco_height")


def cells(documents: DataFrame) -> DataFrame:
    """Page text cells keyed by file stem; those of every seventh page are also
    there under a stem that no image has."""
    return cells_from(layout(documents))


def cells_from(lay: DataFrame) -> DataFrame:
    stems = F.when(F.col("page_num") % 7 == 0, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p")))
    return lay.withColumn("stem", F.explode(stems)).select(
        F.concat(F.col("stem"), F.col("doc_id").cast("string"), F.lit("_"),
                 F.col("page_num").cast("string")).alias("page_key"),
        F.col("line_no").alias("cell_no"),
        F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("text"),
        F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("width").alias("w"),
        F.col("height").alias("h"), F.col("size").alias("font_size"), F.col("font").alias("font_name"),
    )


def annotations(documents: DataFrame) -> DataFrame:
    """Annotation boxes (one per line, plus an overlapping Text box over
    some numbered headings; some body boxes miss their line)."""
    return annotations_from(layout(documents))


def annotations_from(lay: DataFrame) -> DataFrame:
    kind = F.col("kind")
    image_id = F.col("doc_id") * 1000 + F.col("page_num")
    main = lay.select(
        image_id.alias("image_id"), "line_no", F.lit(0).alias("k"),
        F.when(kind == 0, 11).when(kind.isin(1, 2), 8)
         .when((kind == 3) & (F.col("doc_id") % 24 < 12), 9).otherwise(10).alias("category_id"),
        (F.col("x0") - 5 + F.when((kind == 9) & (F.col("src") % 2 == 0), 700).otherwise(0)).alias("x"),
        (F.col("y0") - 5).alias("y"), (F.col("width") + 10).alias("w"), (F.col("height") + 10).alias("h"))
    extra = lay.where((kind == 1) & (F.col("src") % 2 == 0)).select(
        image_id.alias("image_id"), "line_no", F.lit(1).alias("k"), F.lit(10).alias("category_id"),
        (F.col("x0") - 5).alias("x"), (F.col("y0") - 5).alias("y"),
        (F.col("width") + 10).alias("w"), (F.col("height") + 10).alias("h"))
    return main.unionByName(extra).select(
        "image_id", (F.col("line_no") * 2 + F.col("k")).alias("ann_id"), "category_id",
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
        F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))


# The COCO categories of the annotated-page fixture.
CATEGORIES = [(8, "Section-header"), (9, "Table"), (10, "Text"), (11, "Title")]


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category_id int, name string")


def scored(labels: DataFrame) -> DataFrame:
    """Binary label with an integer score in thousandths."""
    return labels.select(
        "doc_id", F.col("quality").alias("label"),
        F.least(F.lit(999), F.col("quality") * 250 + (F.col("doc_id") * 7919) % 700).cast("int").alias("score_milli"))


def expected_outline(documents: DataFrame) -> DataFrame:
    """Golden outline entries: 0-based pages, trailing space, every tenth
    document empty."""
    lay = layout(documents)
    return lay.where(F.col("kind").isin(0, 1, 2) & (F.col("src") % 12 != 0) & (F.col("doc_id") % 10 != 0)).select(
        "doc_id", F.col("line_no").alias("seq"),
        F.concat(F.lit("H"), (F.col("kind") + 1).cast("string")).alias("level"),
        F.concat(F.col("text"), F.lit(" ")).alias("text"), (F.col("page_num") - 1).alias("page"))


def actual_outline(documents: DataFrame) -> DataFrame:
    """Produced outline entries with misses, decoys and wrong levels;
    documents with doc_id mod 17 = 3 are missing."""
    lay = layout(documents)
    cond = (F.col("kind").isin(0, 1, 2, 3) & (F.col("src") % 12 != 0) & (F.col("src") % 5 != 0)
            & (F.col("doc_id") % 17 != 3))
    lvl = F.when(F.col("src") % 3 == 0, 4).otherwise(F.col("kind") + 1)
    return lay.where(cond).select(
        "doc_id", F.col("line_no").alias("seq"), F.concat(F.lit("H"), lvl.cast("string")).alias("level"),
        "text", F.col("page_num").alias("page"))


def spans(documents: DataFrame) -> DataFrame:
    """Parsed-PDF-like spans: each layout line split into words, a span each,
    with mixed fonts and sizes, a blank span after every sixth word, and in
    some documents a span of a non-text block (block_type 1) beside every
    fourth line."""
    lay = layout(documents)
    words = lay.select("*", F.posexplode(F.split(F.col("text"), " ", -1)).alias("sn", "word"))
    sn = F.col("sn")
    word = F.struct((sn * 2).alias("span_no"), F.concat(F.col("word"), F.lit(" ")).alias("text"), F.lit(0).alias("block_type"))
    blank = F.struct((sn * 2 + 1).alias("span_no"), F.lit(" ").alias("text"), F.lit(0).alias("block_type"))
    image = F.struct(F.lit(-1).alias("span_no"), F.lit("[image]").alias("text"), F.lit(1).alias("block_type"))
    beside = (F.col("doc_id") % 50 == 49) & (F.col("src") % 4 == 3) & (sn == 0)
    found = (F.when(beside, F.array(image, word)).when(sn % 6 == 5, F.array(word, blank)).otherwise(F.array(word)))
    return words.withColumn("s", F.explode(found)).select(
        "doc_id", "page_num", "line_no", F.col("s.span_no").cast("int").alias("span_no"), "s.text",
        (F.col("size") + F.when(sn % 2 == 1, 0.2).otherwise(0.0)).cast("double").alias("size"),
        F.when(sn % 5 == 4, F.lit("Times-Bold")).otherwise(F.col("font")).alias("font"),
        "x0", "y0", (F.col("x0") + F.col("width")).alias("x1"), (F.col("y0") + F.col("height")).alias("y1"),
        "page_width", "page_height", "s.block_type")


def expected_docs(documents: DataFrame) -> DataFrame:
    """Documents that have a golden outline file (all of them; some empty)."""
    return documents.select("doc_id")


def actual_docs(documents: DataFrame) -> DataFrame:
    """Documents that have a produced outline file (doc_id mod 17 = 3 missing)."""
    return documents.select("doc_id").where(F.col("doc_id") % 17 != 3)


def raw_cells(documents: DataFrame) -> DataFrame:
    """Page text cells in the nested shape of a parsed page file: a bbox array
    and font fields that some lack; beside some cells stands a broken one (a
    box of three numbers) or one without text."""
    c = cells(documents)
    n = F.col("cell_no")
    whole = F.array("x", "y", "w", "h")
    font = F.when(n % 17 == 3, F.lit(None)).otherwise(F.struct(F.col("font_size").alias("size"),
                                                                 F.col("font_name").alias("name")))
    rows = lambda df, no, bbox, text: df.select("page_key", no.alias("cell_no"), bbox.alias("bbox"), text.alias("text"), font.alias("font"))
    return (rows(c, n, whole, F.col("text"))
            .unionByName(rows(c.where(n % 13 == 5), n + 1_000_000, F.array("x", "y", "w"), F.col("text")))
            .unionByName(rows(c.where(n % 11 == 7), n + 2_000_000, whole, F.lit(None).cast("string"))))


def image_splits(documents: DataFrame) -> dict[str, DataFrame]:
    """The image records divided into the three COCO splits by document."""
    imgs = images(documents)
    part = F.expr("image_id div 1000") % 10
    return {"train": imgs.where(part < 7), "val": imgs.where((part >= 7) & (part < 9)), "test": imgs.where(part >= 9)}


def coco_tables(spark: SparkSession, documents: DataFrame, materialize_layout: str | None = None):
    """(images, annotations, categories, cells) derived from one
    materialised layout table (the three page tables share it)."""
    from pagewise.session import materialize
    lay = layout(documents)
    if materialize_layout != "none":
        lay = materialize(lay, materialize_layout, columnar=True)
    return (images_from(lay), annotations_from(lay), categories(spark), cells_from(lay))


# Middle cuts of the eleven features in model order, the trees'
# weight, and the number of complete trees of depth 3.
CUTS = (11.0, 0.5, 0.1, 0.5, 40.0, 6.0, 0.5, 0.5, 0.5, 1.1, 0.02)
FOREST_TREES, FOREST_WEIGHT = 6, 0.3


def forest():
    """A fixed node table for parity checks: nodes 0 to 6 test features, 7 to
    14 are leaves, children of i are 2 i + 1 and 2 i + 2."""
    from pagewise.operators.trees import Node
    out = []
    for t in range(FOREST_TREES):
        for i in range(15):
            if i < 7:
                f = (3 * t + 2 * i) % 11
                out.append(Node(t, FOREST_WEIGHT, i, f, CUTS[f] * (8 + t) / 10, 2 * i + 1, 2 * i + 2, 0.0, None))
            else:
                out.append(Node(t, FOREST_WEIGHT, i, -1, None, None, None, ((5 * t + 3 * i) % 7 - 3) / 4, None))
    return out
