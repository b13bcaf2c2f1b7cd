"""Uniform shuffle into shards of exact sizes by a communication matrix.

1. The rows are cut into source blocks of at most ``block_rows`` rows.
2. The matrix of block-to-shard counts is drawn from its exact law (fixed row
   and column sums): the blocks are halved again and again, and each half's
   share of every shard is a hypergeometric draw.
3. Each block is permuted locally and dealt out by its matrix row.
4. Each shard is permuted again: random buckets, random order in a bucket.

A block is a stretch of one input partition, so its size depends on no key:
hot sources and copies are spread like all other rows.  Only native
expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import let, stage, steps, unit_interval

#: Standard deviations around the mode that a draw covers; the rest of the
#: mass is far below the resolution of a double.
SPREAD = 10.0


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` fall among ``good`` ones:
    inversion of the exact probabilities, walked outwards from the mode
    (weights relative to the mode never overflow)."""

    def walk(p, count, target, up):
        def ratio(k):
            gain = (p["g"] - k) * (p["d"] - k)
            loss = (k + 1) * (p["t"] - p["g"] - p["d"] + k + 1)
            return gain / loss if up else loss / gain

        def merge(acc, i):
            k = p["mode"] + i if up else p["mode"] - i
            # going up, acc.w belongs to k; going down it belongs to k + 1
            here = acc["w"] if up else acc["w"] * ratio(k)
            after = here * ratio(k) if up else here
            found = F.when(acc["pick"].isNull() & (target < acc["cum"] + here), k).otherwise(acc["pick"])
            return F.struct(after.alias("w"), (acc["cum"] + here).alias("cum"), found.alias("pick"))

        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("pick"))
        first = F.lit(0) if up else F.lit(1)
        return F.aggregate(steps(first.cast("long"), count.cast("long")), zero, merge)

    never = F.lit(float("inf"))
    high = lambda p: p["last"] - p["mode"]
    low = lambda p: p["mode"] - p["first"]

    def pick(p):
        down = walk(p, low(p), p["u"] * (p["up_w"] + p["down_w"]) - p["up_w"], up=False)
        up = walk(p, high(p), p["u"] * (p["up_w"] + p["down_w"]), up=True)
        return F.when(p["u"] * (p["up_w"] + p["down_w"]) < p["up_w"], F.coalesce(up["pick"], p["last"])
                      ).otherwise(F.coalesce(down["pick"], p["first"]))

    def weigh(p):
        return let(F.struct(*[p[c].alias(c) for c in ("t", "g", "d", "u", "mode", "first", "last")],
                            walk(p, high(p), -never, up=True)["cum"].alias("up_w"),
                            walk(p, low(p), -never, up=False)["cum"].alias("down_w")), pick)

    def bound(p):
        least, most = F.greatest(F.lit(0.0), p["d"] - (p["t"] - p["g"])), F.least(p["d"], p["g"])
        mode = F.greatest(least, F.least(most, F.floor((p["d"] + 1) * (p["g"] + 1) / (p["t"] + 2)).cast("double")))
        share = p["g"] / F.greatest(p["t"], F.lit(1.0))
        reach = F.ceil(SPREAD * F.sqrt(p["d"] * share * (1 - share) * (p["t"] - p["d"])
                                       / F.greatest(p["t"] - 1, F.lit(1.0)))) + 30
        return let(F.struct(*[p[c].alias(c) for c in ("t", "g", "d", "u")], mode.alias("mode"),
                            F.greatest(least, mode - reach).alias("first"),
                            F.least(most, mode + reach).alias("last")), weigh)

    return let(F.struct(total.alias("t"), good.alias("g"), drawn.alias("d"), u.alias("u")), bound)


def _share_of_left(counts: Column, left: Column, total: Column, seed: int, node: Column) -> Column:
    """The left half's rows of every shard: one draw a shard, each from what
    the earlier ones left over."""

    def merge(acc, good):
        u = unit_interval(F.lit(seed), F.lit("matrix"), node, acc["i"])
        return let(hypergeometric(acc["t"], good, acc["d"], u), lambda x: F.struct(
            (acc["t"] - good).alias("t"), (acc["d"] - x).alias("d"), (acc["i"] + 1).alias("i"),
            F.concat(acc["xs"], F.array(x)).alias("xs")))

    zero = F.struct(total.alias("t"), left.alias("d"), F.lit(0).alias("i"),
                    F.array().cast("array<double>").alias("xs"))
    return F.aggregate(counts, zero, merge)["xs"]


def communication_matrix(blocks: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(block, cuts): ``cuts`` holds the block's running counts over the
    shards, 0 first.  ``blocks`` has (block, n), one row a block; shard sizes
    differ by one row at most."""
    added = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n_blocks = blocks.count()
    # one row that holds a number for each block (a few MB for billions of rows)
    nodes = blocks.agg(F.sort_array(F.collect_list(F.struct("block", F.col("n").cast("double").alias("n")))).alias("bs"))
    total = added(F.transform("bs", lambda b: b["n"]))
    base, more = F.floor(total / n_shards).cast("double"), total % n_shards
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), "bs", F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: base + F.when(s < more, 1.0).otherwise(0.0)).alias("counts"))
    for depth in range(max(0, n_blocks - 1).bit_length()):
        if depth and depth % 6 == 0:
            nodes = nodes.repartition("node")
        half = F.ceil(F.size("bs") / 2).cast("int")
        left = F.slice("bs", 1, half)
        in_left = added(F.transform(left, lambda b: b["n"]))
        split = nodes.withColumn("xs", F.when(F.size("bs") > 1, _share_of_left(
            F.col("counts"), in_left, added(F.col("counts")), seed, F.col("node"))))
        first = F.struct((F.col("node") * 2).alias("node"), left.alias("bs"), F.col("xs").alias("counts"))
        second = F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("bs", half + 1, F.size("bs")).alias("bs"),
                          F.zip_with("counts", "xs", lambda a, x: a - x).alias("counts"))
        whole = F.struct((F.col("node") * 2).alias("node"), F.col("bs"), F.col("counts"))
        nodes = split.select(F.explode(F.when(F.size("bs") > 1, F.array(first, second)).otherwise(F.array(whole)))
                             .alias("x")).select("x.*")
    cuts = F.aggregate("counts", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return nodes.where(F.size("bs") == 1).select(F.col("bs")[0]["block"].alias("block"), cuts.cast("array<bigint>").alias("cuts"))


def shuffle_into_shards(df: DataFrame, n_shards: int = 16, seed: int = 17, block_rows: int = 65_536,
                        bucket_rows: int = 8_192) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 .. n_shards - 1) and ``slot`` (0,
    1, ... inside the shard): a uniform random permutation whose shard sizes
    differ by one row at most.

    Rows stay whole: repeated rows and null keys are dealt like any others,
    as no column takes part in the draw; an empty table gives no rows.
    Columns named ``shard`` or ``slot`` are replaced.  For one seed the result
    depends on how the input is cut into partitions.  Select only what the
    shuffle has to carry (a key and sizes, say) before calling this.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    bits = block_rows.bit_length() - 1
    # the position is written down with the row, so a retry cannot deal it anew
    rows = stage(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                           F.monotonically_increasing_id().alias("at"))
                 ).withColumn("block", F.shiftright("at", bits))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"))
    n = rows.count()
    matrix = communication_matrix(blocks, n_shards, seed)
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "at"), "at")
    dealt = (rows.withColumn("rank", F.row_number().over(local) - 1).join(matrix, "block")
             .withColumn("shard", (F.size(F.filter("cuts", lambda c: c <= F.col("rank"))) - 1).cast("int")))
    # second permutation: the hash's top bits choose the bucket, the hash the order
    deep = max(0, (n // n_shards // bucket_rows)).bit_length()
    draw = F.xxhash64(F.lit(seed), F.lit("slot"), "at")
    bucket = F.shiftrightunsigned(draw, 64 - deep) if deep else F.lit(0).cast("long")
    dealt = stage(dealt.select("row", "at", "shard", bucket.alias("bucket"), draw.alias("draw")))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("draw", "at")
    return (dealt.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "bucket"])
            .select("row.*", "shard", (F.col("offset") + F.col("rank")).alias("slot")))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffle and write: one folder a shard, rows in slot order."""
    out = shuffle_into_shards(df, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """The documents' shard sheet under the law ``rows``.  ``size`` is the
    text's UTF-8 bytes plus 1 and ``text_crc32`` its CRC; a null text counts
    as empty.  Copies are dealt one by one: shards of exact size leave no room
    for keeping groups together, so ``grown_shard`` is null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sheet = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(sheet, n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
