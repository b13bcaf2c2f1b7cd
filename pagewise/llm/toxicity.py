"""Toxicity scores by a small convolutional text classifier.

A word's vector is the mean of hashed embeddings of the word and its prefixes.
Filters of several widths run over the words of the whole text, each filter
keeps its maximum, and a logistic layer turns the maxima into a probability.
The gradient flows only through the maxima.  A first model is learned from few
rows; from there every labelled row is learned from in its task, in rounds over
disjoint rows: each task moves its own copy, and Spark averages the copies by
the number of steps that moved a parameter.  On all rows kept apart a threshold
is calibrated for every language; the language is told from the text's function
words, so the text is the only input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm import words
from pagewise.llm.common import bounded_batches, stage

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
#: Every FOLDS-th crc32 class of doc_id is never learned from.
FOLDS = 5
#: Rows of each label that the first model is learned from; the rounds go on with all rows.
FIRST_TOXIC, FIRST_CLEAN = 2500, 4500
EPOCHS, STEPS, BATCH, RATE = 6, 1000, 32, 0.01
#: Rounds over all rows and their first rate.  Sums of changes are whole numbers
#: of 1 / UNIT, so that they do not depend on their order.
ROUNDS, ROUND_RATE, UNIT = 2, 0.003, 1 << 30
#: Bitmaps of doc_id hashes, 32,768 bits each: 4 MB in all.
BIT_BUCKETS = 1024
#: Scores are counted by logit in steps of 1 / GRAIN to calibrate thresholds.
GRAIN = 64
#: (EPOCHS or as many as make STEPS steps.)  Function words by language; a text speaks the language most of its words are of.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be at by this from or an",
    "fr": "le la les des du une est pour que qui dans sur au avec pas par un et elle il ce ne se plus",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "el los las del que y en un una por con no para su al lo como más se de la",
}
#: Toxic rows of a language for which it gets a threshold of its own.
ENOUGH = 8
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _features(column: pa.Array):
    """(first row, bucket matrix words x features, words of each row, language of each row)."""
    names = list(FUNCTION_WORDS)
    lists = [[w.encode() for w in FUNCTION_WORDS[x].split()] for x in names]
    flat = [w for ws in lists for w in ws]
    ends = np.cumsum([len(w) for w in flat])
    marks = words.span_hashes(np.frombuffer(b"".join(flat), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    speak = np.repeat(np.arange(len(names)), [len(ws) for ws in lists])
    order = np.argsort(marks, kind="stable")
    marks, speak = marks[order], speak[order]
    for row, text, offsets in words.pieces(column):
        text = words.LOWER[text]
        starts, stops, counts = words.word_spans(text, offsets, _WORD)
        whole = words.span_hashes(text, starts, stops)
        cols = [words.mix(whole)]
        for k in PREFIXES:
            cols.append(words.mix(words.span_hashes(text, starts, np.minimum(starts + k, stops)) + np.uint64(k)))
        ids = (np.stack(cols, axis=1) >> np.uint64(64 - 15)).astype(np.int32)
        votes = np.zeros((len(counts), len(names)), dtype=np.int64)
        row_of = np.repeat(np.arange(len(counts)), counts)
        lo, hi = np.searchsorted(marks, whole), np.searchsorted(marks, whole, side="right")
        for nth in range(int((hi - lo).max()) if len(whole) else 0):  # a word may belong to several languages
            some = np.flatnonzero(lo + nth < hi)
            np.add.at(votes, (row_of[some], speak[lo[some] + nth]), 1)
        yield row, ids, counts, np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), len(names))


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    #: Threshold of each language, and of texts of none.
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(FUNCTION_WORDS) + 1, 0.5))

    def table(self) -> np.ndarray:
        """All parameters but the thresholds as rows of DIM numbers, the embeddings first."""
        rest = np.concatenate([*[f.ravel() for f in self.filters], self.bias, self.out, [self.out_bias]]).astype(np.float32)
        return np.concatenate([self.embed, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    @staticmethod
    def of(rows: np.ndarray) -> Model:
        """The model of a ``table``."""
        sizes = [w * DIM * FILTERS for w in WIDTHS] + [FILTERS * len(WIDTHS)] * 2 + [1]
        *filters, bias, out, out_bias, _ = np.split(rows[BUCKETS:].ravel(), np.cumsum(sizes))
        return Model(rows[:BUCKETS].copy(), [f.reshape(w, DIM, FILTERS).copy() for f, w in zip(filters, WIDTHS)],
                     bias.copy(), out.copy(), float(out_bias[0]))

    def maxima(self, ids: np.ndarray, counts: np.ndarray):
        """Every row's filter maxima, the words that gave them and all word vectors."""
        counts = np.maximum(counts, 0)
        vectors = self.embed[ids].mean(axis=1) if len(ids) else np.zeros((0, DIM), np.float32)
        vectors = np.concatenate([vectors, np.zeros((max(WIDTHS), DIM), np.float32)])
        begin = np.cumsum(counts) - counts
        top = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        at = np.full((len(counts), FILTERS * len(WIDTHS)), -1)
        full = np.flatnonzero(counts)
        if not len(full):
            return top, at, vectors
        ends = np.repeat(begin + counts, counts)
        place = np.arange(len(ids))
        for k, width in enumerate(WIDTHS):
            total = np.zeros((len(ids), FILTERS), np.float32)
            for j in range(width):
                shifted = vectors[j:j + len(ids)] * (place + j < ends)[:, None]
                total += shifted @ self.filters[k][j]
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            best = np.maximum.reduceat(total, begin[full], axis=0)
            top[full, own] = best
            hit = total == np.repeat(best, counts[full], axis=0)
            first = np.where(hit, place[:, None], len(ids))
            at[full, own] = np.minimum.reduceat(first, begin[full], axis=0)
        return top, at, vectors

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        top, _, _ = self.maxima(ids, counts)
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def scores(self, ids: np.ndarray, counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Probabilities moved so that the language's threshold lies at one half."""
        t = self.thresholds[language]
        return 1 / (1 + np.exp(-np.clip(self.logits(ids, counts) - np.log(t / (1 - t)), -30, 30)))


class Learner:
    """Adam steps that move a model."""

    def __init__(self, model: Model, rng: np.random.Generator):
        self.model, self.rng, self.state, self.steps = model, rng, {}, 0

    def _adam(self, name, value, grad, rate: float, rows=None):
        """One Adam step; of a few rows of a table if ``rows`` is given."""
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad ** 2
        value[at] -= rate * (m[at] / (1 - 0.9 ** self.steps)) / (np.sqrt(v[at] / (1 - 0.999 ** self.steps)) + 1e-8)

    def step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> np.ndarray:
        """Learn from one batch; the embeddings that it moved."""
        model = self.model
        self.steps += 1
        counts = np.array([len(d) for d in docs])
        ids = np.concatenate(docs)
        top, at, vectors = model.maxima(ids, counts)
        hidden = np.maximum(top + model.bias, 0)
        keep = (self.rng.random(hidden.shape) < 0.8) / np.float32(0.8)
        p = 1 / (1 + np.exp(-np.clip((hidden * keep) @ model.out + model.out_bias, -30, 30)))
        d = ((p - y) * weight / len(docs)).astype(np.float32)
        dh = d[:, None] * model.out * keep * (hidden > 0)
        ends = np.repeat(np.cumsum(counts)[:, None], top.shape[1], axis=1)
        rows, grads = [], []
        for k, width in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            df = np.zeros_like(model.filters[k])
            for j in range(width):
                there = (at[:, own] >= 0) & (at[:, own] + j < ends[:, own])
                r, f = np.nonzero(there)
                w = at[:, own][there] + j
                g = dh[:, own][r, f]
                np.add.at(df[j].T, f, g[:, None] * vectors[w])
                rows.append(ids[w].ravel())
                grads.append(np.repeat(g[:, None] * model.filters[k][j][:, f].T / ids.shape[1], ids.shape[1], axis=0))
            self._adam(("f", k), model.filters[k], df + 1e-5 * model.filters[k], rate)
        hit, which = np.unique(np.concatenate(rows), return_inverse=True)
        de = np.zeros((len(hit), DIM), np.float32)
        np.add.at(de, which, np.concatenate(grads))
        self._adam("e", model.embed, de, rate, hit)
        self._adam("b", model.bias, dh.sum(axis=0), rate)
        self._adam("o", model.out, (hidden * keep).T @ d + 1e-5 * model.out, rate)
        model.out_bias -= rate * float(d.sum())
        return hit


def train(texts: list[str], toxic: list[int], seed: int = 5, calibrated: bool = True) -> Model:
    """Fit on labelled texts; every fifth one only calibrates the thresholds.
    Without ``calibrated`` all are learned from and the thresholds stay one half."""
    rng = np.random.default_rng(seed)
    if not texts or not 0 < sum(toxic) < len(toxic):
        model = Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                      np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), -5.0)
        model.out_bias = 5.0 if toxic and all(toxic) else -5.0  # one label only
        return model
    docs, language = [], []
    for _, ids, counts, spoken in _features(pa.array(texts, pa.large_string())):
        docs += np.split(ids, np.cumsum(counts)[:-1])
        language += spoken.tolist()
    y, language = np.array(toxic, np.float32), np.array(language)
    apart = (np.arange(len(y)) % FOLDS == FOLDS - 1) & calibrated
    learn = np.flatnonzero(~apart)
    model = Model(rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32),
                  [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    weight = np.where(y > 0, 0.5 / max(y[learn].mean(), 1e-6), 0.5 / max(1 - y[learn].mean(), 1e-6)).astype(np.float32)
    learner = Learner(model, rng)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(learn))))
    for epoch in range(epochs):
        order = rng.permutation(learn)
        for a in range(0, len(order), BATCH):
            some = order[a:a + BATCH]
            learner.step([docs[i] for i in some], y[some], weight[some], RATE * (1 - epoch / epochs))
    kept = np.flatnonzero(apart)
    p = np.concatenate([1 / (1 + np.exp(-np.clip(model.logits(docs[i], np.array([len(docs[i])])), -30, 30))) for i in kept]) \
        if len(kept) else np.zeros(0)
    model.thresholds = language_thresholds(language[kept], p, y[kept], np.ones(len(kept)))
    return model


def language_thresholds(language: np.ndarray, p: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Every language's best threshold, the general one where it has too few
    toxic rows; ``y`` of ``n`` rows with a score are toxic."""
    general = best_threshold(p, y, n)
    of = [language == x for x in range(len(FUNCTION_WORDS) + 1)]
    return np.array([best_threshold(p[own], y[own], n[own]) if y[own].sum() >= ENOUGH else general for own in of])


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold of the highest F1, in the middle of the gap it lies in,
    drawn towards one half when few rows decide it; one half without both
    labels, or if nothing is better than all rows.  ``y`` of ``n`` rows (one, if
    not given) with a score are toxic."""
    n = np.ones(len(y)) if n is None else n
    if not 0 < y.sum() < n.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + y.sum())
    ends = np.append(np.diff(p[order]) != 0, True)  # equal scores fall together
    best = int(np.argmax(np.where(ends, f1, -1)))
    if best + 1 == len(p):
        return 0.5
    t = np.clip((p[order][best] + p[order][best + 1]) / 2, 0.02, 0.98)
    pull = np.log(t / (1 - t)) * y.sum() / (y.sum() + ENOUGH)  # few rows move it little
    return float(1 / (1 + np.exp(-pull)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learned_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labels that may be learned from.  A doc_id with
    several labels is toxic if one says so."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def id_bits(rows: DataFrame) -> DataFrame:
    """(bucket, bits): which hashes of doc_id ``rows`` have, BIT_BUCKETS bitmaps
    of 4 kB at most, however many rows there are."""
    bucket, place = _bit(F.col("doc_id"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def _bit(doc_id: Column) -> tuple[Column, Column]:
    """Bucket of a doc_id and place in its bitmap."""
    digest = F.xxhash64(F.lit("bit"), doc_id.cast("long"))
    return F.pmod(digest, F.lit(BIT_BUCKETS)), F.pmod(F.shiftright(digest, 24), F.lit(8 * 4096))


def with_bit(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` but those whose doc_id surely has no bit, found where they lie."""
    bucket, place = _bit(F.col("doc_id"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    there = rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket")
    return there.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("bucket", "bits")


def join_labels(docs: DataFrame, known: DataFrame, bits: DataFrame, value: Column) -> DataFrame:
    """(doc_id, ``value`` of the row of ``docs``, toxic, part): rows that ``known``
    has a label for; of rows that repeat a doc_id each counts.  ``part``, by hash,
    is the round that learns from a row, or ROUNDS for the rows kept apart, one in
    FOLDS.  Only rows that may have a label, with their value alone, are shuffled,
    and by one plan at every size of the tables."""
    draw = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(ROUNDS * FOLDS))
    part = F.when(draw % FOLDS == FOLDS - 1, ROUNDS).otherwise(F.floor(draw / FOLDS)).cast("int")
    rows = docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", value)
    return with_bit(rows.withColumn("part", part), bits).join(known.hint("merge"), "doc_id").select(*rows.columns, "toxic", "part")


def learned_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, part): all labelled rows that may be learned from."""
    known = stage(learned_labels(labels))
    return join_labels(docs, known, stage(id_bits(known)), F.col("text"))


def first_rows(rows: DataFrame) -> DataFrame:
    """The few of ``rows`` (doc_id, digest, toxic) that the first model is learned
    from, by hash."""
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id"), F.col("digest")]
    return rows.where("toxic = 1").orderBy(*order).limit(FIRST_TOXIC).union(rows.where("toxic = 0").orderBy(*order).limit(FIRST_CLEAN))


def learn_round(rows: DataFrame, model: Model, weights: tuple[float, float], rate: float) -> Model:
    """``model`` moved by all of ``rows``: every task moves a copy by its own
    rows, and a parameter moves by the mean over the steps that moved it.  Only
    these means, one row for each DIM parameters, come to the driver."""
    start = model.table()
    names = [f"d{i}" for i in range(DIM)]

    def learn(batches):
        learner = Learner(Model.of(start), np.random.default_rng(7))
        visits = np.zeros(len(start), np.int64)
        docs, y = [], np.zeros(0, np.float32)

        def take(n):
            for a in range(0, n, BATCH):
                own = y[a:a + BATCH]
                hit = learner.step(docs[a:a + BATCH], own, np.where(own > 0, weights[1], weights[0]).astype(np.float32), rate)
                visits[hit] += 1
                visits[BUCKETS:] += 1

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.float32)
            for row, ids, counts, _ in _features(batch.column("text")):
                found = np.split(ids, np.cumsum(counts)[:-1])
                order = learner.rng.permutation(len(found))
                docs += [found[i] for i in order]
                y = np.concatenate([y, toxic[row:row + len(found)][order]])
                whole = len(docs) // BATCH * BATCH
                take(whole)
                docs, y = docs[whole:], y[whole:]
        take(len(docs))
        keys = np.flatnonzero(visits)
        moved = np.rint((learner.model.table()[keys].astype(np.float64) - start[keys]) * visits[keys, None] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(visits[keys]), *[pa.array(c) for c in moved.T.copy()]],
                                         names=["key", "visits", *names])

    moves = bounded_batches(rows).select("text", "toxic").mapInArrow(learn, "key int, visits long, " + ", ".join(f"{c} long" for c in names))
    sums = moves.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("visits", *names)]).toArrow()
    table = start.copy()
    change = np.stack([sums.column(c).to_numpy() for c in names], axis=1) / UNIT / sums.column("visits").to_numpy()[:, None]
    table[sums.column("key").to_numpy()] += change.astype(np.float32)
    return Model.of(table)


def calibrate(rows: DataFrame, model: Model) -> np.ndarray:
    """Thresholds from all of ``rows``: toxic and all rows are counted by
    language and logit in steps of 1 / GRAIN."""

    def count(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, ids, counts, language in _features(batch.column("text")):
                at = np.rint(np.clip(model.logits(ids, counts), -30, 30) * GRAIN).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(at), pa.array(toxic[row:row + len(at)])],
                                                 names=["language", "at", "toxic"])

    found = bounded_batches(rows).select("text", "toxic").mapInArrow(count, "language int, at int, toxic long")
    found = found.groupBy("language", "at").agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).toArrow()
    language, at, y, n = [found.column(c).to_numpy() for c in ("language", "at", "y", "n")]
    return language_thresholds(language, 1 / (1 + np.exp(-at / GRAIN)), y, n)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learned from all labelled rows of ``docs`` that may be learned
    from, its thresholds from all of those kept apart."""
    known = stage(learned_labels(labels))
    bits = stage(id_bits(known))
    digest = F.xxhash64("text").alias("digest")
    learn = stage(join_labels(docs, known, bits, digest)).where(F.col("part") < ROUNDS)  # without texts
    first = stage(first_rows(learn).select("doc_id", "digest", "toxic"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", digest)
    texts = texts.join(F.broadcast(first.select("doc_id", "digest").distinct()), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    found = first.join(texts, ["doc_id", "digest"]).collect()
    found.sort(key=lambda r: (hash((r["doc_id"] * 2654435761) & 0xFFFFFFFF), r["text"]))
    model = train([r["text"] for r in found], [int(r["toxic"]) for r in found], calibrated=False)
    n = {int(r["toxic"]): r["count"] for r in learn.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return model
    weights = (0.5 * sum(n.values()) / n[0], 0.5 * sum(n.values()) / n[1])
    rows = join_labels(docs, known, bits, F.col("text"))
    for at in range(ROUNDS):
        model = learn_round(rows.where(F.col("part") == at), model, weights, ROUND_RATE * (1 - at / ROUNDS))
    model.thresholds = calibrate(rows.where(F.col("part") == ROUNDS), model)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from one half up) of
    every row of ``docs`` (doc_id, text), repeated ones too; a null text counts as
    empty.  Without labels of both kinds all scores are alike."""

    def score(batches):
        for batch in batches:
            for row, ids, counts, language in _features(batch.column("text")):
                p = model.scores(ids, counts, language)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(p)), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    out = bounded_batches(docs).select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""

    def clean(batches):
        for batch in batches:
            keep = [model.scores(ids, counts, language) < 0.5 for _, ids, counts, language in _features(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return bounded_batches(docs).mapInArrow(clean, docs.schema)
