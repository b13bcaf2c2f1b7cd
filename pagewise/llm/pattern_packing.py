"""Best-fit packing of token sequences by non-negative least squares.

Documents become token ids and are cut, only where longer than a sequence, into
pieces.  The histogram of piece lengths (never more bins than a sequence has
tokens) is all the plan needs: patterns of up to three lengths that fill a
sequence exactly are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded, and what is left over is packed by best
fit, counts at a time.  Pieces then take the places of their length by rank, so
the assignment is a join on (part, length) and no piece passes the driver.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewise.llm import words
from pagewise.llm.common import stage

SIZE = 2048
#: Rounds of the fit.
ROUNDS = 400
#: Id after every document.
END = 0
#: Bytes of text that are encoded at once, and words whose ids a worker keeps.
PIECE, KEPT_WORDS = 1 << 23, 1 << 20
#: Words of Latin letters alone, and how many of them are encoded as one text.
_PLAIN, TOGETHER = re.compile("[a-zA-Z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+").fullmatch, 1000

_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ends_word(path: str) -> np.ndarray:
    """Of every id, whether it ends a word."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    out[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return out


def _parted(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with a space between a word and the punctuation
    mark after it, where neither alters ids: A-Z before ASCII or U+00C0 to U+00FF
    (no mark that would compose with it), and marks after ASCII letters and
    digits or letters from U+00C0 to U+00FF."""
    if len(text) < 2:
        return text, offsets
    after = np.append(text[1:], np.uint8(0))
    low = np.where((text >= 65) & (text <= 90) & ((after < 128) | (after == 0xC3)), text + np.uint8(32), text)
    letter = _ALNUM[text]
    letter[1:] |= (text[:-1] == 0xC3) & (text[1:] != 0x97) & (text[1:] != 0xB7)
    cut = np.flatnonzero(_MARK[text[1:]] & letter[:-1]) + 1
    return np.insert(low, cut, np.uint8(32)), offsets + np.searchsorted(cut, offsets, side="right")


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never
    merges across it or from letters to marks: every distinct word is encoded once."""

    def __init__(self, path: str):
        self.path = path
        self._forget()

    def _forget(self):
        #: Every known word's number; number k has ids[bounds[k]:bounds[k + 1]], number 0 is END.
        self.known, self.ids, self.bounds = {}, np.array([END], np.uint32), np.array([0, 1])

    def _coded(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and each word's number of ids.
        Plain words go together, as one text: each ends with its first id that
        ends a word."""
        tokenizer, ids, sizes = _tokenizer(self.path), [], []
        runs = [plain[a:a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
        for run, e in zip(runs, tokenizer.encode_batch_fast([" ".join(run) for run in runs], add_special_tokens=False), strict=True):
            got = np.array(e.ids, dtype=np.uint32)
            last = np.flatnonzero(_ends_word(self.path)[got])
            if len(last) != len(run) or last[-1] != len(got) - 1:
                raise ValueError("the tokenizer does not mark the ends of words")
            ids.append(got)
            sizes.append(np.diff(last, prepend=-1))
        each = [e.ids for e in tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        ids.append(np.array([i for x in each for i in x], np.uint32))
        sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _numbers(self, found: list[str]) -> np.ndarray:
        new = [w for w in found if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self._forget()
            new = found
        if new:
            plain, others = [], []
            for w in new:
                (plain if _PLAIN(w) else others).append(w)
            ids, sizes = self._coded(plain, others)
            at = len(self.bounds) - 1
            self.known.update(zip(plain + others, range(at, at + len(new)), strict=True))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        known = self.known
        return np.array([known[w] for w in found], dtype=np.int64)

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, END after each, and the texts' bounds in them."""
        text, offsets = _parted(text, offsets)
        column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
        lists = pc.ascii_split_whitespace(column)
        n_words = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        number = np.insert(number, np.cumsum(n_words), 0)
        first = self.bounds[number]
        each = self.bounds[number + 1] - first
        ends = np.cumsum(each)
        flat = self.ids[np.repeat(first - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends[np.cumsum(n_words + 1) - 1]])


_encoder = lru_cache(maxsize=1)(WordIds)  # a worker's tasks share the known words


def _pieces(batches, path: str, size: int):
    """doc_id, text -> the pieces of every row, numbered within (part, length)."""
    encoder, seen, part = _encoder(path), np.zeros(size + 1, dtype=np.int64), TaskContext.get().partitionId()
    for batch in batches:
        ids = batch.column("doc_id")
        for row, text, offsets in words.pieces(batch.column("text"), PIECE):
            flat, bounds = encoder.encode(text, offsets)
            total = np.diff(bounds)
            n = -(-total // size)
            doc = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(size, total[doc] - start)
            order = np.argsort(length, kind="stable")
            sizes = length[order]
            rank = np.empty(len(doc), dtype=np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(sizes, sizes) + seen[sizes]
            seen += np.bincount(length, minlength=size + 1)
            data = flat.astype("<u4").tobytes()
            at = (bounds[doc] + start) * 4
            crc = [crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row + doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


@lru_cache(maxsize=2)
def exact_patterns(size: int) -> np.ndarray:
    """All a >= b >= c with a + b + c = size and b, c possibly 0: some size**2 / 12 rows."""
    a, b = np.meshgrid(np.arange(1, size + 1), np.arange(size + 1), indexing="ij")
    c = size - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit_repeats(histogram: np.ndarray, patterns: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error of the histogram,
    by accelerated projected gradient.  Errors count by the square of their
    length, as short pieces left over find room easily."""
    size = len(histogram) - 1
    weight = (np.arange(size + 1) / size) ** 2
    weight[0] = 0
    scale = max(float(histogram.max()), 1.0)
    target = histogram / scale

    def product(x):  # lengths that x patterns use
        return np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=size + 1)

    # no step may exceed 1 / the largest eigenvalue, found by power iteration
    v = np.ones(len(patterns))
    for _ in range(12):
        v = (weight * product(v))[patterns].sum(axis=1)
        top = float(np.linalg.norm(v))
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - (weight * (product(y) - target))[patterns].sum(axis=1) / (1.05 * top))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x * scale


class Pattern(NamedTuple):
    """Lengths that share a sequence, in their order there, and the number of such sequences."""

    lengths: tuple[int, ...]
    repeats: int


def best_fit(left: np.ndarray, size: int) -> list[Pattern]:
    """Pack a histogram, longest pieces first, each into the fullest sequence
    that has room; sequences of equal content are handled as one count."""
    open_at: list[dict[tuple, int]] = [{} for _ in range(size + 1)]  # by room left
    for length in np.flatnonzero(left)[::-1].tolist():
        count, room = int(left[length]), length
        while count and room <= size:
            groups = open_at[room]
            if not groups:
                room += 1
                continue
            content, n = groups.popitem()
            most = max(1, min(room // length, count // n)) if n <= count else 1
            used = n if n <= count else count
            if used < n:
                groups[content] = n - used
            count -= used * most
            more = content + (length,) * most
            rest = open_at[room - length * most]
            rest[more] = rest.get(more, 0) + used
        if count:
            each = size // length
            for fits, n in ((each, count // each), (count % each, 1)):
                if fits and n:
                    rest = open_at[size - length * fits]
                    content = (length,) * fits
                    rest[content] = rest.get(content, 0) + n
    return [Pattern(c, n) for groups in open_at for c, n in groups.items()]


def _rounded(left: np.ndarray, patterns: np.ndarray, x: np.ndarray) -> list[Pattern]:
    """Patterns with the whole repeat counts x, most frequent first and as far
    as pieces reach, and the best fit of what they leave."""
    left, out = left.copy(), []
    for k in np.argsort(-x, kind="stable")[:int((x > 0).sum())]:
        lengths = [v for v in patterns[k].tolist() if v]
        n = min(int(x[k]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append(Pattern(tuple(lengths), n))
    return out + best_fit(left, len(left) - 1)


def plan(histogram: np.ndarray, size: int, rounds: int = ROUNDS) -> list[Pattern]:
    """Patterns that use every piece of the histogram once.  The fit is rounded
    down (better where short pieces fill every gap) and to the nearest (better
    where they are few); the plan with fewer sequences is taken."""
    left = histogram.astype(np.int64).copy()
    whole = [Pattern((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    known = left > 0
    if not known.any():
        return whole
    known[0] = True
    patterns = exact_patterns(size)
    patterns = patterns[known[patterns].all(axis=1)]
    x = fit_repeats(left, patterns, rounds) if len(patterns) else np.zeros(0)
    return whole + min((_rounded(left, patterns, to(x)) for to in (np.floor, np.rint)), key=lambda p: sum(c.repeats for c in p))


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, copies a
    sequence, offset of the first copy): a piece of the length with a rank
    between has its place there.  One row a pattern and length, whatever the counts."""
    taken, sequence, out = {}, 0, []
    for lengths, repeats in patterns:
        at = 0
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            first = taken.get(length, 0)
            taken[length] = first + copies * repeats
            out.append((length, first, taken[length], sequence, copies, at))
            at += copies * length
        sequence += repeats
    return out


def _assign(batches, table: np.ndarray):
    """length, rank -> sequence_id, offset; table: places sorted by (length, first rank)."""
    first_row = np.searchsorted(table[:, 0], np.arange(int(table[-1, 0]) + 2)) if len(table) else None
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        row = np.empty(len(length), dtype=np.int64)
        for v in np.unique(length).tolist():  # some thousand lengths at most
            rows = slice(first_row[v], first_row[v + 1])
            at = length == v
            row[at] = first_row[v] + np.searchsorted(table[rows, 1], rank[at], side="right") - 1
        nth = rank - table[row, 1]
        copies = table[row, 4]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(table[row, 3] + nth // copies),
             pa.array(table[row, 5] + nth % copies * length)], names=[*names, "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and its offset there.

    A null or empty text is the one id END; a null doc_id stays null; rows that
    repeat a doc_id are documents of their own; an empty table gives no rows.
    Columns beside doc_id and text are not used.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = stage(docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(b, path, size), f"{schema}, part int, nth long"))
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    table = np.array(sorted(places(plan(histogram, size))), dtype=np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    held = spark.sparkContext.broadcast(table)  # at most a few rows for each of size**2 / 12 patterns
    return (pieces.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
            .mapInArrow(lambda b: _assign(b, held.value), f"{schema}, sequence_id long, offset long"))
