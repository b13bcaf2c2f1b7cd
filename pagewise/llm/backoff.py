"""Stupid-backoff language-model scores over a whole corpus.

The count tables of words and word pairs are partitioned by hash.  Each chunk
of documents sends its distinct n-grams with their numbers to the partitions
(so a frequent n-gram is one entry a chunk, not one an occurrence), a partition
adds them up and sends the totals back, and the chunk joins them to its
n-grams and sums the scores per document.  A document's own occurrences are
taken off the counts that score it; else every pair would be known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm import words
from pagewise.llm.common import stage

ALPHA = 0.4
#: Rows of a chunk (a power of two), and characters of text behind a count partition.
CHUNK_ROWS, PARTITION_CHARS = 1024, 8_000_000
PAIR = np.uint64(0x5851F42D4C957F2D)


def _grams(column: pa.Array):
    """Of a text column: word hashes, hashes of the pairs that end at each word
    (0 at a row's first word) and each word's row."""
    one, two, row_of = [], [], []
    for row, text, offsets in words.pieces(column):
        text = words.LOWER[text]
        starts, stops, counts = words.word_spans(text, offsets, words.NOT_SPACE)
        h = words.span_hashes(text, starts, stops)
        pair = np.zeros(len(h), np.uint64)
        pair[1:] = words.mix(h[:-1] * PAIR + words.mix(h[1:]))
        first = (np.cumsum(counts) - counts)[counts > 0]
        pair[first] = 0
        one.append(h)
        two.append(pair)
        row_of.append(row + np.repeat(np.arange(len(counts)), counts))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return join(one, np.uint64), join(two, np.uint64), join(row_of, np.int64)


def _chunks(batches):
    """(chunk, texts) of consecutive rows, whole chunks."""
    held, now = [], None
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and chunk[a] != now:
                yield now, pa.concat_arrays(held)
                held = []
            now = int(chunk[a])
            held.append(batch.column("text").slice(a, b - a).cast(pa.large_string()))
    if held:
        yield now, pa.concat_arrays(held)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of the differences of sorted numbers: the high ones are
    mostly zero and vanish when the shuffle compresses them."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _requests(bits: int):
    def requests(batches):
        for chunk, texts in _chunks(batches):
            one, two, _ = _grams(texts)
            grams, n = np.unique(np.concatenate([one, two[two != 0]]), return_counts=True)
            cut = np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(grams)])
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk), pa.int64()),
                 pa.array([_planes(grams[cut[i]:cut[i + 1]]) for i in full], pa.binary()),
                 pa.array([n[cut[i]:cut[i + 1]].astype(np.uint32).tobytes() for i in full], pa.binary())],
                names=["bucket", "chunk", "grams", "n"])
    return requests


def _totals(table: pa.Table) -> pa.Table:
    """One partition of the count table: every chunk's numbers to totals."""
    grams = [_from_planes(x) for x in table.column("grams").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("n").to_pylist()])
    _, which = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(which, weights=n).astype(np.uint32)[which]
    ends = np.cumsum([len(g) for g in grams])
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"),
                     "n": pa.array([total[b - len(g):b].tobytes() for g, b in zip(grams, ends, strict=True)], pa.binary())})


def _scores(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """One chunk: documents with the totals of the chunk's n-grams."""
    rows = docs.num_rows
    one, two, row = _grams(docs.column("text").combine_chunks())
    grams, which = np.unique(np.concatenate([one, two]), return_inverse=True)
    which, pair = which[:len(one)], which[len(one):]
    got = sorted(zip(counts.column("bucket").to_pylist(), counts.column("n").to_pylist(), strict=True))
    total = np.frombuffer(b"".join(x for _, x in got), np.uint32).astype(np.int64)
    if len(total) != len(grams) - int((grams[:1] == 0).sum()):
        raise RuntimeError("the documents changed between two reads")
    if len(grams) and grams[0] == 0:
        total = np.concatenate([np.zeros(1, np.int64), total])
    # less the document's own
    _, place, own = np.unique(np.concatenate([row, row]) * np.int64(len(grams) + 1) + np.concatenate([which, pair]),
                              return_inverse=True, return_counts=True) if len(one) else (None, np.zeros(0, int), np.zeros(0, int))
    left = total[np.concatenate([which, pair])] - own[place]
    of_word, of_pair = left[:len(one)], left[len(one):]
    before = np.concatenate([[1], of_word[:-1]]) if len(one) else of_word
    known = (two != 0) & (of_pair > 0)
    backed = (two != 0) & ~known
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(known, np.log(of_pair) - np.log(before),
                         np.where(of_word > 0, np.log(of_word), np.log(ALPHA)) + backed * np.log(ALPHA))
    add = lambda w: np.bincount(row, weights=w, minlength=rows)
    return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": np.bincount(row, minlength=rows),
                     "n_backed": add(backed).astype(np.int64), "n_single": add(~known).astype(np.int64), "part": add(score)})


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, n_backed (pairs
    that back off to their second word), log_score and mean_log (per token).

    S(w | v) = c(v w) / c(v), or ALPHA * S(w) for an unknown pair; S(w) = c(w) /
    N, or ALPHA / N for an unknown word; a text's first word has S(w).  Words are
    split at ASCII white space, A-Z lower-cased; a text without words scores 0.
    Equal texts in other rows count as other documents.  ``docs`` is read
    twice and has to keep its rows and their order in between, as files do.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, chars // PARTITION_CHARS).bit_length()
    shift = CHUNK_ROWS.bit_length() - 1
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.shiftright(F.monotonically_increasing_id(), shift).alias("chunk"))
    asked = base.select("chunk", "text").mapInArrow(_requests(bits), "bucket int, chunk long, grams binary, n binary")
    totals = asked.groupBy("bucket").applyInArrow(_totals, "bucket int, chunk long, n binary")
    parts = base.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        _scores, "doc_id long, n_tokens long, n_backed long, n_single long, part double")
    parts = stage(parts)
    n = parts.agg(F.sum("n_tokens")).first()[0] or 0
    # single words are divided by the corpus less the document
    score = F.col("part") - F.when(F.col("n_single") > 0, F.col("n_single") * F.log(F.greatest(F.lit(n) - F.col("n_tokens"), F.lit(1)))).otherwise(0.0)
    return parts.select("doc_id", "n_tokens", "n_backed", F.round(score, 4).alias("log_score"),
                        F.when(F.col("n_tokens") > 0, F.round(score / F.col("n_tokens"), 6)).otherwise(0.0).alias("mean_log"))
