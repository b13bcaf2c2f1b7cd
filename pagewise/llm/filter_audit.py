"""Filter interaction audit by decision diagrams.

Every document has a failure mask, one bit a filter.  Per part (language) the
masks' counts become a decision diagram: level d tests the d-th filter of the
present order, a path ends in the counts of its mask, equal subdiagrams are one
node and carry their sums.  A swap of two neighbouring levels rewrites the
nodes of those levels only, so a walk through all orders by neighbour swaps
visits every order; in each, the all-pass path from the root has at every
level what the filter of that level removes and what it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import stage

FILTERS = "ABCDE"
#: Per mask: documents, those of good quality, toxic ones.
Counts = tuple[int, int, int]
ZERO: Counts = (0, 0, 0)
STEP = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")


class Diagram:
    """Count-weighted decision diagram over failure masks (bit i: filter i fails)."""

    def __init__(self, filters: str, counts: dict[int, Counts]):
        self.order = list(filters)
        #: Of each level the nodes (pass child, fail child) by their id; the last level's are counts.
        self.nodes: list[dict] = [{} for _ in range(len(filters) + 1)]
        self.ids: list[dict] = [{} for _ in range(len(filters) + 1)]
        self.sums: dict[int, Counts] = {}
        self.root = self._build(0, counts)

    def _build(self, level: int, counts: dict[int, Counts]) -> int:
        if level == len(self.order):
            return self._node(level, counts.get(0, ZERO))
        passed = {m >> 1: c for m, c in counts.items() if not m & 1}
        failed = {m >> 1: c for m, c in counts.items() if m & 1}
        return self._node(level, (self._build(level + 1, passed), self._build(level + 1, failed)))

    def _node(self, level: int, content: tuple) -> int:
        node = self.ids[level].get(content)
        if node is None:
            node = len(self.sums)
            self.ids[level][content], self.nodes[level][node] = node, content
            self.sums[node] = content if level == len(self.order) else tuple(map(sum, zip(*(self.sums[x] for x in content))))
        return node

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next level."""
        upper, below = self.nodes[level], self.nodes[level + 1]
        self.nodes[level + 1], self.ids[level + 1], self.ids[level] = {}, {}, {}
        for node, (passed, failed) in upper.items():
            children = tuple(self._node(level + 1, pair) for pair in zip(below[passed], below[failed]))
            upper[node], self.ids[level][children] = children, node
        self.order[level:level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Counts, Counts]]:
        """(filter, removed, kept) along the all-pass path."""
        node = self.root
        for level, name in enumerate(self.order):
            node, failed = self.nodes[level][node]
            yield name, self.sums[failed], self.sums[node]


def neighbour_swaps(n: int) -> Iterator[int]:
    """Positions of neighbour swaps that lead through all n! orders (each
    element moves through all the orders of those before it, and back)."""
    if n < 2:
        return
    inner, down = neighbour_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        move = next(inner, None)
        if move is None:
            return
        yield move + (1 if down else 0)  # the moving element stands first or last
        down = not down


def audit_counts(filters: str, counts: dict[int, Counts]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of every order and step."""
    diagram, walked = Diagram(filters, counts), []
    for swap in (None, *neighbour_swaps(len(filters))):
        if swap is not None:
            diagram.swap(swap)
        walked.append(("".join(diagram.order), list(diagram.steps())))
    fails, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for _, path in walked:
        fails[path[0][0]], alone[path[-1][0]] = path[0][1][0], path[-1][1][0]
        for name, removed, _ in path:
            shapley[name] += removed[0]
    for order, path in walked:
        for step, (name, removed, kept) in enumerate(path, 1):
            yield (order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``masks`` (part, mask, n, good, toxic), one row a mask and part, at most
    2 ** len(filters) a part -> one row a part, order and step."""
    def one_part(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows}
        columns = list(zip(*audit_counts(filters, counts)))
        names = [c.split()[0] for c in STEP.split(", ")]
        types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.table([pa.array([rows[0]["part"]] * len(columns[0]), pa.string()), *map(pa.array, columns, types)], names=names)

    return masks.groupBy("part").applyInArrow(one_part, STEP)


def _bits(*conditions: Column) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of the five filters: A short, B repetitive,
    C upper case, D symbols, E copy of a smaller doc_id's text.

    Null texts are empty, null languages the empty part.  Rows with a null
    doc_id are no copies and make none; of rows that repeat a doc_id and its
    text none is the other's copy.  A document is good (toxic) if any of its
    rows in ``labels`` says so; others are neither.
    """
    space = r"[\x20\x09-\x0D]+"
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"),
                       F.array_remove(F.split(text, space), "").alias("words"))
    n_words, length, distinct = (c.cast("long") for c in (F.size("words"), F.length("text"), F.size(F.array_distinct("words"))))
    upper = length - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    rows = stage(rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        _bits(n_words < 100, distinct * 100 < n_words * 80, upper * 100 > length * 10, F.col("text").rlike("[#$%&*|]")).alias("mask")))
    copied = (rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
              .where("first < last").select("digest", "first"))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = rows.join(copied, "digest", "left").join(known, "doc_id", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (rows.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
            .agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
                 F.sum(F.coalesce("bad", F.lit(0))).alias("toxic")))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters; no rows without documents."""
    return audit(failure_masks(docs, labels))
