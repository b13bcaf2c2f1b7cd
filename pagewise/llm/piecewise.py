"""Context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a chunk wherever its low bits
are all ones, so boundaries move with the text around them.  Each chunk gives
one character; a fingerprint is ``size:signature:signature`` for the block
size and its double.  Likeness is the edit distance (insert, delete) of
signatures at a common block size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm import words
from pagewise.llm.common import bounded_batches

WINDOW = 7
SMALLEST, WANTED = 4, 64
#: Signatures without a common run of so many characters are unlike: edit
#: distance alone finds likeness in random strings.
RUN = 4
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_BYTES = words.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
#: Ranges of ids that neighbours are looked up in.
PARTS, PART_ROWS = 512, 500


def _signature(rolled: np.ndarray, sums: np.ndarray, size: int) -> str:
    ends = np.flatnonzero((rolled & np.uint32(size - 1)) == size - 1) + 1
    if not len(ends) or ends[-1] < len(rolled):
        ends = np.append(ends, len(rolled))
    chunks = np.diff(sums[ends], prepend=np.uint64(0))
    return LETTERS[(words.mix(chunks) >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(text: str) -> str:
    """The whole text's fingerprint; equal texts have equal ones."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return f"{SMALLEST}::"
    x = _BYTES[data]
    rolled = x.copy()
    for j in range(1, min(WINDOW, len(x))):
        rolled[j:] += x[:-j] * np.uint32((0x01000193 ** j) & 0xFFFFFFFF)
    rolled ^= rolled >> np.uint32(15)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(rolled.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), out=sums[1:])
    size = SMALLEST
    while size * WANTED < len(data):
        size *= 2
    while True:
        first = _signature(rolled, sums, size)
        if size == SMALLEST or len(first) >= WANTED // 2:
            return f"{size}:{first}:{_signature(rolled, sums, size * 2)}"
        size //= 2


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of ``a`` at once in the
    bits of an integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every
    for c in b:
        met = free & at.get(c, 0)
        free = (free + met | free - met) & every
    return len(a) - free.bit_count()


def _like(a: str, b: str) -> float:
    run = min(RUN, len(a), len(b))
    runs = {a[i:i + run] for i in range(len(a) - run + 1)}
    if not run or not any(b[i:i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 (unlike, or no common block size) to 1."""
    if a == b:
        return 1.0
    (p, p1, p2), (q, q1, q2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_like(p1, q1), _like(p2, q2))
    if p == 2 * q:
        return _like(p1, q2)
    return _like(p2, q1) if q == 2 * p else 0.0


def _walk(batches):
    """Rows of a part in ascending id order, its lower neighbour in front:
    every row with the first row of the id below."""
    part = before = now = None
    for batch in batches:
        out = []
        for p, lead, doc_id, text in zip(*(batch.column(c) for c in ("part", "lead", "id", "text")), strict=True):  # one text at a time
            p, lead, doc_id, text = p.as_py(), lead.as_py(), doc_id.as_py(), text.as_py() or ""
            if p != part:
                part, before, now = p, None, None
            if now is None or doc_id != now[0]:
                before, now = now, (doc_id, text, fingerprint(text))
            if lead:  # the first one stands for its id
                continue
            if before is None:  # the only id is its own next one
                before = now
            mark = now[2] if text == now[1] else fingerprint(text)
            _, other, next_mark = before
            half = len(text) // 2
            edited = text[:len(text) - half] + other[:half]
            edited_mark = fingerprint(edited)
            out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark,
                        likeness(mark, edited_mark), likeness(mark, next_mark)))
        kept = batch.filter(pc.invert(batch.column("lead")))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [kept.column("doc_id"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:4]),
             *(pa.array(c, pa.float64()) for c in columns[4:])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how near they and
    the next document's are.  The next document is the one with the next
    smaller doc_id, after the smallest the largest; a single document is its
    own.  Rows that share a doc_id share their next one, for which the row
    with the smallest text hash stands; null ids come below all others.  Null
    texts count as empty.

    The texts move once: by ranges of ids, each with the one document below it.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"), "text")
    n = rows.count()
    parts = max(1, min(PARTS, n // PART_ROWS))
    cuts = [] if parts == 1 else rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))  # PARTS numbers at most
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    tops = sorted((r["part"], r["top"]) for r in rows.groupBy(part.alias("part")).agg(F.max("id").alias("top")).collect())
    if not tops:
        tops = [(0, 0)]
    below = [(tops[i][0], tops[i - 1][1]) for i in range(len(tops))]  # the first part's is the last part's top
    leads = F.broadcast(docs.sparkSession.createDataFrame(below, "part int, id long"))
    own = rows.select(part.cast("int").alias("part"), F.lit(False).alias("lead"), "doc_id", "id", "text")
    lead = rows.join(leads, "id").select("part", F.lit(True).alias("lead"), "doc_id", "id", "text")
    dealt = (own.union(lead).repartition(len(tops), "part")
             .sortWithinPartitions("part", F.col("lead").desc(), "id", F.xxhash64("text")))
    return bounded_batches(dealt).mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")
