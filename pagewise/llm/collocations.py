"""Phrase collocations by prefix-free parsing.

Every text is parsed into chunks: a chunk starts at a trigger, a window of
OVERLAP words whose hash is small, and ends with the next trigger's window, so
neighbouring chunks overlap by that window and equal passages give equal chunks
wherever they stand.  The distinct chunks with their frequencies are the
dictionary.  N-grams are counted inside distinct chunks only, weighted; a chunk
owns the n-grams that start before its closing window, so overlaps count once.

Counting goes by order: hashes of 1- and 2-grams, then of 3- and 4-grams whose
2-grams are frequent, are summed in ranges of hashes, and each part of the
dictionary learns which of its hashes are frequent.  Hashes only select: the
strings of what is left are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm import words
from pagewise.llm.common import stage

LONGEST, OVERLAP = 4, 3
#: One window in so many is a trigger.
EVERY = 24
#: Chunks of a part, and bytes of the dictionary for each range of hashes.
PART_ROWS_BITS, RANGE_BYTES = 14, 1 << 23
#: Bytes of text or chunks that are worked on at once.
PIECE = 1 << 21

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_SEPARATOR
_WORD[[9, 32]] = False
#: In chunks a space stands between words and a line feed between pieces.
_IN_CHUNK = np.ones(256, dtype=bool)
_IN_CHUNK[[10, 32]] = False


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``data`` one after the other, and where each begins."""
    begins = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - begins, lengths) + np.arange(int(lengths.sum()))], begins


def _strings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    lengths = stops - starts
    flat, begins = _gather(data, starts, lengths)
    at = np.append(begins, len(flat)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(flat)).cast(pa.string())


def _window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of every run of n words, by the words' hashes; shorter at the end."""
    total = np.zeros(len(h), dtype=np.uint64)
    for j in range(min(n, len(h))):
        total[:len(h) - j] += words.mix(h[j:] + np.uint64(j + 1)) * np.uint64(2 * j + 1)
    return words.mix(total + np.uint64(n))


def _chunks(batches, every: int):
    """lang, text -> lang, chunk, closing (ends its text), owned (words before the
    closing window), n."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for row, text, offsets in words.pieces(batch.column("text"), PIECE):
            text = words.LOWER[text]
            starts, stops, counts = words.word_spans(text, offsets, _WORD)
            if not len(starts):
                continue
            h, of = words.span_hashes(text, starts, stops), np.repeat(np.arange(len(counts)), counts)
            at = np.concatenate([[0], np.cumsum(_SEPARATOR[text])])
            ends = np.append(of[1:] != of[:-1], True)  # last word of its text
            split = ends | np.append(at[starts[1:]] != at[stops[:-1]], True)
            # canonical text: each word and one byte after it
            lengths = stops - starts
            canon, begins = _gather(np.append(text, np.uint8(0)), starts, lengths + 1)
            after = begins + lengths
            canon[after] = np.where(split, np.uint8(10), np.uint8(32))

            heads = np.append(True, ends[:-1])
            last = np.flatnonzero(ends)[np.cumsum(heads) - 1]  # of each word's text
            room = last - np.arange(len(h)) >= OVERLAP - 1
            breaks = split.astype(np.uint64) << np.uint64(63)
            trigger = room & (_window_hashes(h ^ breaks, OVERLAP) <= np.uint64((2 ** 64 - 1) // every))
            first = np.flatnonzero(heads | trigger)
            closing = np.append(heads[first[1:]], True)
            owned = np.diff(first, append=len(h))
            until = first + owned + np.where(closing, 0, OVERLAP)
            a, b = begins[first], after[until - 1]
            code = codes[row:row + len(counts)][of[first]]
            key = words.mix(words.span_hashes(canon, a, b) + (code.astype(np.uint64) * np.uint64(2) + closing))
            _, one, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(code[one])).cast(pa.string()), _strings(canon, a[one], b[one]), pa.array(closing[one]),
                 pa.array(owned[one], pa.int32()), pa.array(n, pa.int64())], names=["lang", "chunk", "closing", "owned", "n"])


def dictionary(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(lang, chunk, closing, owned, n, part): the distinct chunks of ``docs``
    (lang, text) and how often each occurs; a part is a bounded run of them."""
    found = (docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
             .mapInArrow(lambda b: _chunks(b, every), "lang string, chunk string, closing boolean, owned int, n long"))
    return stage(found.groupBy("lang", "chunk", "closing", "owned").agg(F.sum("n").alias("n"))
                 .withColumn("part", F.shiftright(F.monotonically_increasing_id(), PART_ROWS_BITS)))


class Sheet(NamedTuple):
    """The words of some chunks."""

    text: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray  # of word and language
    piece: np.ndarray  # number of the word's piece
    owned: np.ndarray
    row: np.ndarray

    def inside(self, n: int) -> np.ndarray:
        """Starts of n-grams that lie in one piece."""
        if len(self.starts) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.piece[n - 1:] == self.piece[:len(self.piece) - n + 1])

    def here(self, n: int) -> np.ndarray:
        """Those that the chunk owns."""
        at = self.inside(n)
        return at[self.owned[at]]

    def grams(self, n: int) -> np.ndarray:
        return _window_hashes(self.hashes, n)


def _sheets(table) -> Iterator[tuple[int, Sheet]]:
    langs = table.column("lang")
    langs = (langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
    names = langs.dictionary.cast(pa.large_string())
    salt = np.concatenate([words.span_hashes(t, o[:-1], o[1:]) for _, t, o in words.pieces(names)]) if len(names) else np.zeros(0, np.uint64)
    salt = salt[langs.indices.to_numpy(zero_copy_only=False)]
    owned = table.column("owned").to_numpy()
    for row, text, offsets in words.pieces(table.column("chunk"), PIECE):
        starts, stops, counts = words.word_spans(text, offsets, _IN_CHUNK)
        of = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        lines = np.concatenate([[0], np.cumsum(text == 10)])[starts] + of
        h = words.mix(words.span_hashes(text, starts, stops) + salt[row + of])
        yield row, Sheet(text, starts, stops, h, lines, nth < owned[row + of], row + of)


_PARTIAL = "part long, range int, grams array<int>, counts array<long>"


def _partial_counts(part: int, grams: np.ndarray, weights: np.ndarray, ranges: int):
    """Summed weights of gram hashes, by ranges of their upper half; the lower
    half is kept."""
    if not len(grams):
        return
    hashes, inverse = np.unique(grams, return_inverse=True)
    sums = np.bincount(inverse, weights, len(hashes)).astype(np.int64) if weights.max(initial=0) < 1 << 20 else _exact(inverse, weights, len(hashes))
    where = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(where, np.arange(ranges + 1))
    some = np.flatnonzero(np.diff(ends))
    cut = pa.array(np.append(ends[some], ends[-1]), pa.int32())
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(some), part)), pa.array(some, pa.int32()), pa.ListArray.from_arrays(cut, pa.array(low)),
         pa.ListArray.from_arrays(cut, pa.array(sums))], names=["part", "range", "grams", "counts"])


def _exact(inverse: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, inverse, weights)
    return out


def _short_grams(batches, ranges: int):
    """Counts of 1- and 2-grams, a part at a time.  2-grams of closing windows
    count nothing and yet get to know if they are frequent: 3- and 4-grams that
    start before may end in them."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        parts = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(parts))):
            run = table.slice(a, b - a)
            yield from _counted(int(parts[a]), run, ranges, lambda s: [(1, s.here(1)), (2, s.inside(2))])


def _counted(part: int, table: pa.Table, ranges: int, pick):
    n, grams, weights = table.column("n").to_numpy(), [], []
    for _, sheet in _sheets(table):
        for order, at in pick(sheet):
            grams.append(sheet.grams(order)[at])
            weights.append(n[sheet.row[at]] * sheet.owned[at])
    if grams:
        yield from _partial_counts(part, np.concatenate(grams), np.concatenate(weights), ranges)


def _frequent(table: pa.Table, least: int) -> pa.Table:
    """One range's partial counts -> for each part its grams that are frequent in all."""
    lists = table.column("grams").combine_chunks()
    grams, counts = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy()
    distinct, inverse = np.unique(grams, return_inverse=True)
    often = (_exact(inverse, counts, len(distinct)) >= least)[inverse]
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    kept = np.bincount(of[often], minlength=len(lists))
    return pa.table({"part": table.column("part"), "range": table.column("range"),
                     "grams": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), pa.int32()), pa.array(grams[often]))})


class _Known:
    """Membership in one part's lists of frequent grams."""

    def __init__(self, lists: pa.Table, ranges: int):
        grams = lists.column("grams").combine_chunks()
        low = grams.flatten().to_numpy().view(np.uint32).astype(np.uint64)
        where = np.repeat(lists.column("range").to_numpy(), np.diff(grams.offsets.to_numpy())).astype(np.uint64)
        self.ranges, self.keys = ranges, np.unique(where << np.uint64(32) | low)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=bool)
        upper = (hashes >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)
        keys = upper << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys


def _long_starts(sheet: Sheet, known: _Known):
    """Starts of 3- and 4-grams all of whose 2-grams are frequent."""
    pair = np.zeros(len(sheet.starts) + LONGEST, dtype=bool)
    pair[:len(sheet.starts)] = known(sheet.grams(2))
    for n in range(3, LONGEST + 1):
        at = sheet.here(n)
        yield n, at[np.logical_and.reduce([pair[at + j] for j in range(n - 1)])]


def _long_grams(chunks: pa.Table, lists: pa.Table, ranges: int) -> pa.Table:
    """A part's counts of 3- and 4-grams."""
    out = []
    if chunks.num_rows and lists.num_rows:
        known = _Known(lists, ranges)
        out = list(_counted(chunks.column("part")[0].as_py(), chunks, ranges, lambda s: _long_starts(s, known)))
    schema = pa.schema([("part", pa.int64()), ("range", pa.int32()), ("grams", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    return pa.Table.from_batches([b.cast(schema) for b in out], schema)


def _phrases(chunks: pa.Table, lists: pa.Table, ranges: int) -> pa.Table:
    """A part's frequent n-grams as strings; equality is that of the words, not of hashes."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])
    out = []
    if chunks.num_rows and lists.num_rows:
        known, n = _Known(lists, ranges), chunks.column("n").to_numpy()
        langs = chunks.column("lang").combine_chunks().dictionary_encode()
        for _, s in _sheets(chunks):
            if not len(s.starts):
                continue
            ids = _strings(s.text, s.starts, s.stops).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            most = int(ids.max()) + 1
            codes = langs.indices.to_numpy(zero_copy_only=False)[s.row].astype(np.int64)
            for order in range(1, LONGEST + 1):
                at = s.here(order)
                at = at[known(s.grams(order)[at])]
                if not len(at):
                    continue
                same = codes[at]
                for j in range(order):  # numbers of prefixes stay below the rows
                    same = np.unique(same * most + ids[at + j], return_inverse=True)[1]
                _, one, which = np.unique(same, return_index=True, return_inverse=True)
                first = at[one]
                out.append(pa.table([langs.dictionary.take(pa.array(codes[first])).cast(pa.string()), _strings(s.text, s.starts[first], s.stops[first + order - 1]),
                                     pa.array(np.full(len(first), order), pa.int32()), pa.array(_exact(which, n[s.row[at]], len(first)))], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def phrase_counts(chunks: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a) of all n-grams up to four words with ``least`` or
    more occurrences, from the dictionary."""
    total = chunks.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    ranges = 1 + total // RANGE_BYTES
    columns = chunks.select("lang", "chunk", "owned", "n", "part")
    often = lambda partial: stage(partial.groupBy("range").applyInArrow(
        lambda t: _frequent(t, least), "part long, range int, grams array<int>").where(F.size("grams") > 0))
    # a staged table is read without a shuffle; parts meet their lists by theirs
    short = often(columns.mapInArrow(lambda b: _short_grams(b, ranges), _PARTIAL))
    by_part = columns.groupBy("part")
    long = often(by_part.cogroup(short.groupBy("part")).applyInArrow(lambda c, k: _long_grams(c, k, ranges), _PARTIAL))
    found = by_part.cogroup(short.union(long).groupBy("part")).applyInArrow(
        lambda c, k: _phrases(c, k, ranges), "lang string, phrase string, words int, a long")
    return stage(found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def _span(first, n):
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, every: int = EVERY) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to 4 words: lang, rank, phrase,
    a, l, r, n, score.

    Null texts are empty, a null lang is ``und``; other columns are not used;
    rows that repeat count again; no words, no rows.  Equal scores and counts
    go by the phrase's bytes.
    """
    chunks = dictionary(docs, every)
    counts = phrase_counts(chunks, least)
    words_in = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("owned")).alias("n"))
    phrases = counts.where("words >= 2")
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(f"{name}_part"), F.col("a").alias(n))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left_part", _span(F.lit(1), F.col("cut"))).withColumn("right_part", _span(F.col("cut") + 1, F.col("words") - F.col("cut")))
    cuts = cuts.join(part("left", "l"), ["lang", "left_part"]).join(part("right", "r"), ["lang", "right_part"])
    score = F.expr("cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + r)")
    scored = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
              .select("lang", "phrase", "a", "low.l", "low.r", "low.score"))

    longer = counts.where("words >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    longer = longer.groupBy("lang", _span(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    inside = F.expr("coalesce(cast(most as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * 80, false)")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~inside).drop("most")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(words_in, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
