"""Language identification as a corpus job (n-gram rank profiles).

Profiles: for each language of a labelled corpus, the ``top`` most frequent
character n-grams (n = 1..3, words padded with one space on each side) and
their ranks.  Detection: the same profile for each text; the language with
the smallest out-of-place distance (Cavnar & Trenkle, 1994) wins:

    distance(doc, lang) = sum over the doc's n-grams of |rank_doc - rank_lang|,
                          ``top`` when the n-gram is not in the language profile
                        = top * |doc profile| - sum over shared n-grams of
                          (top - |rank_doc - rank_lang|)

so the argmin is the argmax of the shared-n-gram score and only the equi
join on n-gram is needed.  Ties go to the smallest language name; texts that
share no n-gram with any profile (no letters, another script) are 'unknown'.

Scale: detection is a narrow step.  A text's n-grams, their ranks and its
scores need that text and the profiles alone, so they are computed where the
row lies, numpy over the code points of a whole Arrow batch (n-grams packed
into 64-bit keys, one sort for the counts and one for the ranks); nothing is
shuffled but the texts, once, and one (key, count) row per text.  Texts of more than ``LONG_TEXT``
characters and rows that share a key take the relational path: words are
counted first (map-side partial aggregation), n-grams are generated once per
distinct (text, word), windows run over one text's *distinct n-grams*, and a
text with a huge vocabulary is counted by many tasks (``_rank_texts``).
Language profiles are always relational, over words counted by language.
Profiles are checkpointed once (a few hundred rows per language) and sent to
the tasks behind a check of the number of languages.  Whole texts are used
-- no prefix or sampling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.session import bounded_batches, cut_lineage, materialize

PROFILE_SIZE = 300
MAX_N = 3
UNKNOWN = "unknown"
# Profiles of at most this many languages are broadcast (<= 300 rows each).
BROADCAST_MAX_LANGUAGES = 1000
# A text of more distinct words than this is counted by many tasks; the keys
# of at most so many such texts are broadcast.
HUGE_WORDS = 200_000
BROADCAST_MAX_TEXTS = 10_000
# Longer texts (in characters) are ranked by the relational path.
LONG_TEXT = 1 << 20
# Characters, and cells of the (row, language) score matrix, worked on at once.
PIECE, CELLS = 1 << 16, 1 << 20


def _letters(text_col: str) -> Column:
    return F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}]+", " ")


def _word_counts(df: DataFrame, key: str, text_col: str, *keep: str) -> DataFrame:
    """(key, *keep, word, cnt): lower-cased words, every run of non-letters is
    a break.  Map-side partial aggregation collapses repeated words."""
    words = df.select(key, *keep, F.explode(F.split(_letters(text_col), " ")).alias("word")).where(F.length("word") > 0)
    return words.groupBy(key, *keep, "word").agg(F.count(F.lit(1)).alias("cnt"))


def _gram_counts(word_counts: DataFrame, key: str, max_n: int) -> DataFrame:
    """(key, gram, cnt) over the space-padded words: letters (n = 1), and
    every n-gram of " word " for n = 2..max_n.  Overlapping n-grams come
    from a lookahead in a code-generated ``regexp_extract_all`` (no per-row
    lambdas); the dot behind it steps over a whole code point."""
    pad = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    parts = [F.regexp_extract_all(F.col("word"), F.lit("(.)"), 1)]
    parts += [F.regexp_extract_all(pad, F.lit("(?=(%s))." % ("." * n)), 1) for n in range(2, max_n + 1)]
    exploded = word_counts.select(key, "cnt", F.explode(F.concat(*parts)).alias("gram"))
    return exploded.groupBy(key, "gram").agg(F.sum("cnt").alias("cnt"))


def _top_ranked(gram_counts: DataFrame, key: str, top: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("cnt").desc(), F.col("gram"))
    return gram_counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("cnt")


def language_profiles(corpus: DataFrame, lang_col: str = "lang", text_col: str = "text",
                      top: int = PROFILE_SIZE, max_n: int = MAX_N) -> DataFrame:
    """(lang, gram, rank) for the ``top`` n-grams of each language."""
    src = corpus.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_col)
    return _top_ranked(_gram_counts(_word_counts(src, "lang", text_col), "lang", max_n), "lang", top)


def _rank_texts(word_counts: DataFrame, key: str, top: int, max_n: int, huge_words: int) -> DataFrame:
    """(key, gram, rank) from materialised (key, word, cnt) rows.

    A text's distinct words meet in one task (hash-partitioned by the key
    once; the n-gram aggregation, the ranking window and the later scoring
    aggregate reuse that partitioning).  Texts of more than ``huge_words``
    distinct words are counted in two phases instead: partial counts where
    the word rows lie, then by (text, gram), so one text uses many tasks; the
    ranking window gets at most ``top`` rows a text from each of them."""
    word_counts = word_counts.select(key, "word", "cnt")
    huge = cut_lineage(word_counts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > huge_words).select(key))
    n_huge = huge.count()
    if n_huge == 0:
        return _top_ranked(_gram_counts(word_counts.repartition(key), key, max_n), key, top)
    if n_huge <= BROADCAST_MAX_TEXTS:
        huge = F.broadcast(huge)
    usual = _gram_counts(word_counts.join(huge, key, "left_anti").repartition(key), key, max_n)
    spread = _gram_counts(word_counts.join(huge, key, "left_semi"), key, max_n)
    return _top_ranked(usual, key, top).unionByName(_top_ranked(spread, key, top))


def text_profiles(texts: DataFrame, key: str = "doc_id", text_col: str = "text",
                  top: int = PROFILE_SIZE, max_n: int = MAX_N, huge_words: int = HUGE_WORDS) -> DataFrame:
    """(key, gram, rank): each text's top n-grams.  The distinct (text,
    word) counts -- bounded per text by its vocabulary, not its length --
    are materialised once."""
    return _rank_texts(materialize(_word_counts(texts, key, text_col)), key, top, max_n, huge_words)


class _Marks:
    """Profiles as arrays: distinct n-grams as code points (0: none) in ascending
    order, and each one's (language, rank) entries one after the other."""

    def __init__(self, rows, top: int):
        self.top = top
        self.langs = sorted({lang for lang, _, _ in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        grams = sorted({gram for _, gram, _ in rows})
        place = {gram: i for i, gram in enumerate(grams)}
        self.points = np.array([[*map(ord, g), 0, 0][:MAX_N] for g in grams], np.int64).reshape(-1, MAX_N)
        entries = sorted((place[gram], number[lang], rank) for lang, gram, rank in rows)
        at, self.lang, self.rank = np.array(entries, np.int64).reshape(-1, 3).T
        self.begin = np.searchsorted(at, np.arange(len(grams) + 1))

    def best(self, texts: list[str]) -> list[str]:
        """The language of each text (words of letters, a space between them)."""
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        used = np.zeros(0x110000, bool)
        used[points] = True
        used[[0, 10, 32]] = False
        alphabet = np.concatenate([[0, 32], np.flatnonzero(used)])  # ascending, as strings are
        base = len(alphabet)
        if len(texts) > 1 and len(texts) * base ** 3 >= 1 << 62:
            half = len(texts) // 2
            return self.best(texts[:half]) + self.best(texts[half:])
        dense = np.ones(0x110000, np.int32)
        dense[alphabet[2:]] = np.arange(2, base)
        a, row = dense[points].astype(np.int64), np.cumsum(points == 10) - 1
        letter = a > 1
        one = np.flatnonzero(letter)
        two = np.flatnonzero(letter[:-1] | letter[1:])
        two_row = np.where(letter[two], row[two], row[two + 1])
        space = base ** 3
        keys = np.concatenate([row[one] * space + a[one] * base ** 2,
                               two_row * space + a[two] * base ** 2 + a[two + 1] * base,
                               row[one] * space + a[one - 1] * base ** 2 + a[one] * base + a[one + 1]])
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        count = np.diff(first, append=len(keys))
        keys = keys[first]
        n, most = len(keys), int(count.max(initial=0))
        order = keys // space * (most + 1) + most - count  # by text, then the most frequent, then the n-gram
        order = order * n + np.arange(n)
        order.sort()
        order = order % max(n, 1)
        of, code = np.divmod(keys[order], space)
        rank = np.arange(n) - np.searchsorted(of, np.arange(len(texts)))[of] + 1
        known = np.searchsorted(alphabet, self.points)
        known = np.where(alphabet[np.minimum(known, base - 1)] == self.points, known, -1)
        there = np.flatnonzero((known >= 0).all(axis=1))  # of the letters seen here; still ascending
        marks = known[there] @ np.array([base ** 2, base, 1])
        if not len(marks):
            return [UNKNOWN] * len(texts)
        at = np.minimum(np.searchsorted(marks, code), len(marks) - 1)
        hit = np.flatnonzero((marks[at] == code) & (rank <= self.top))
        gram = there[at[hit]]
        times = self.begin[gram + 1] - self.begin[gram]
        entry = np.repeat(self.begin[gram] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        cell = np.repeat(of[hit], times) * len(self.langs) + self.lang[entry]
        score = self.top - np.abs(np.repeat(rank[hit], times) - self.rank[entry])
        cells = len(texts) * len(self.langs)
        total = np.bincount(cell, weights=score, minlength=cells)
        total[np.bincount(cell, minlength=cells) == 0] = -np.inf
        total = total.reshape(len(texts), -1)
        return [self.langs[i] if x > -np.inf else UNKNOWN for i, x in zip(total.argmax(axis=1).tolist(), total.max(axis=1).tolist(), strict=True)]

    def column(self, letters: pa.Array) -> pa.Array:
        """The languages of a column of texts, some at a time."""
        texts, out = letters.to_pylist(), []
        some, size = [], 0
        for text in texts:
            text = text or ""
            if some and (size + len(text) > PIECE or (len(some) + 1) * len(self.langs) > CELLS):
                out += self.best(some)
                some, size = [], 0
            some.append(text)
            size += len(text) + 1
        return pa.array(out + (self.best(some) if some else []), pa.string())


def _few_languages(profiles: DataFrame) -> bool:
    return profiles.select("lang").distinct().count() <= BROADCAST_MAX_LANGUAGES


def _best_by_key(texts: DataFrame, profiles: DataFrame, few: bool, key: str, text_col: str, top: int, max_n: int) -> DataFrame:
    """(key, best) by the relational path: texts of any length, many tasks a text;
    rows that share a key are one text."""
    prof = profiles.select("lang", "gram", F.col("rank").alias("lrank"))
    doc = text_profiles(texts, key, text_col, top, max_n)
    scores = doc.join(F.broadcast(prof) if few else prof, "gram").groupBy(key, "lang").agg(
        F.sum(F.lit(top) - F.abs(F.col("rank") - F.col("lrank"))).alias("score"))
    return scores.groupBy(key).agg(F.min_by("lang", F.struct((-F.col("score")).alias("s"), F.col("lang"))).alias("best"))


def with_language(texts: DataFrame, profiles: DataFrame, key: str = "doc_id", text_col: str = "text", out: str = "language",
                  top: int = PROFILE_SIZE, max_n: int = MAX_N, long_text: int = LONG_TEXT) -> DataFrame:
    """``texts`` with a column ``out``: the language of all text under a row's
    key.  ``texts`` is read twice (keys, then rows)."""
    profiles = cut_lineage(profiles)
    few = _few_languages(profiles)
    if max_n != MAX_N or not few:
        best = _best_by_key(texts, profiles, few, key, text_col, top, max_n)
        return texts.join(best, key, "left").withColumn(out, F.coalesce("best", F.lit(UNKNOWN))).drop("best")
    marks = _Marks([(r["lang"], r["gram"], r["rank"]) for r in profiles.where("lang is not null").collect()], top)
    is_long = F.coalesce(F.length(text_col) > long_text, F.lit(False))
    apart = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(is_long).alias("_long"))
    apart = cut_lineage(apart.where("_n > 1 or _long").select(key))
    n_apart = apart.count()
    kept = texts.columns
    schema = texts.withColumn(out, F.lit("")).schema

    def detect(batches):
        for batch in batches:
            found = marks.column(batch.column("_letters"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=[*kept, out])

    alone = F.col(key).isNotNull() & ~is_long  # a null key has no text of its own
    found = bounded_batches(texts).withColumn("_letters", F.when(alone, _letters(text_col))).mapInArrow(detect, schema)
    if n_apart == 0:
        return found
    apart = F.broadcast(apart) if n_apart <= BROADCAST_MAX_TEXTS else apart
    best = _best_by_key(texts.select(key, text_col).join(apart, key, "left_semi"), profiles, few, key, text_col, top, max_n)
    best = apart.join(best, key, "left").select(key, F.coalesce("best", F.lit(UNKNOWN)).alias("_best"))
    return found.join(best, key, "left").withColumn(out, F.coalesce("_best", out)).drop("_best").select(*kept, out)


def detect_language(texts: DataFrame, profiles: DataFrame, key: str = "doc_id", text_col: str = "text",
                    top: int = PROFILE_SIZE, max_n: int = MAX_N, long_text: int = LONG_TEXT) -> DataFrame:
    """(key, language) for every row of ``texts``.  The texts move once, so that
    few large files keep all tasks busy."""
    return with_language(texts.select(key, text_col).repartition(key), profiles, key, text_col, "language", top, max_n, long_text).select(key, "language")


def profile_and_detect(corpus: DataFrame, key: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
                       top: int = PROFILE_SIZE, max_n: int = MAX_N, long_text: int = LONG_TEXT) -> tuple[DataFrame, DataFrame]:
    """Learn profiles from the labelled rows of ``corpus`` and detect the
    language of every row."""
    profiles = cut_lineage(language_profiles(corpus, lang_col, text_col, top, max_n))
    return profiles, detect_language(corpus, profiles, key, text_col, top, max_n, long_text)


def augment_language(df: DataFrame, profiles: DataFrame, key: str, text_col: str = "text",
                     out: str = "language") -> DataFrame:
    """Add a detected-language column to any table with a text column."""
    return with_language(materialize(df, columnar=True), profiles, key, text_col, out)
