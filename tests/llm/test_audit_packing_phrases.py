"""Filter audit, pattern packing and collocations against brute force, and on difficult rows."""

import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewise.llm import collocations, filter_audit, pattern_packing, words
from pagewise.llm.oracle import ORACLES
from pagewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, "The quick Fox, of a kind. The quick Fox!", "en"), (2, None, "en"), (3, "", None), (4, LONG, "de"), (4, LONG, "de"), (5, LONG, ""),
        (6, "AB CD", "en"), (None, "AB CD", "en"), (7, "AB CD", None), (8, "a|b\tc\n\n日本 É x", "fr"), (6, "other", "fr"), (9, "", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in ("part", "mask", "piece", "start", "length", "n", "phrase", "words", "digest", "good", "rank"):  # clashing names
        df = df.withColumn(c, F.lit("other"))
    return df


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_masks(table, labels):
    first = {}
    for i, t, _ in table:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = {}
    for i, t, lang in table:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        mine = [x for x in labels if x[0] == i and i is not None]
        key = sum(b << k for k, b in enumerate(fails))
        n = out.setdefault(lang or "", {}).setdefault(key, [0, 0, 0])
        for k, x in enumerate((1, any(q == 1 for _, q, _ in mine), any(x == 1 for *_, x in mine))):
            n[k] += x
    return out


def brute_audit(counts):
    walked, shapley = {}, Counter()
    for order in permutations(range(5)):
        left = dict(counts)
        for step, f in enumerate(order, 1):
            gone = {m: c for m, c in left.items() if m >> f & 1}
            left = {m: c for m, c in left.items() if not m >> f & 1}
            removed = sum(c[0] for c in gone.values())
            shapley[f] += removed
            walked["".join("ABCDE"[x] for x in order), step] = (
                sum(c[0] for c in left.values()), removed, sum(c[0] for m, c in counts.items() if m >> f & 1) - removed,
                counts.get(1 << f, (0,))[0], sum(c[1] for c in gone.values()), sum(c[2] for c in gone.values()), f)
    return {k: (*v[:-1], shapley[v[-1]]) for k, v in walked.items()}


def test_diagrams_walk_all_orders():
    random.seed(1)
    for n in range(6):
        order = list(range(n))
        seen = {tuple(order)}
        for p in filter_audit.neighbour_swaps(n):
            order[p], order[p + 1] = order[p + 1], order[p]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))
    for share in (0, 0.1, 0.7, 1):
        counts = {m: tuple(random.randint(0, 9) for _ in range(3)) for m in range(32) if random.random() < share}
        assert {(o, s): tuple(r) for o, s, *r in filter_audit.audit_counts("ABCDE", counts)} == brute_audit(counts)


def test_equal_subdiagrams_are_one_node():
    diagram = filter_audit.Diagram("ABCDE", dict.fromkeys(range(32), (1, 0, 0)))
    assert [len(level) for level in diagram.nodes] == [1] * 6
    for swap in filter_audit.neighbour_swaps(5):
        diagram.swap(swap)
        assert [len(level) for level in diagram.nodes] == [1] * 6


def test_filter_audit(spark, docs):
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, 1), (8, 1, None), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    want = {(part, *k): v for part, counts in brute_masks(ROWS, labels).items() for k, v in brute_audit(counts).items()}
    got = {r[:3]: r[3:] for r in rows(filter_audit.audit_documents(docs, table))}
    assert got == want and len(got) == 600 * 4
    assert rows(filter_audit.audit_documents(docs.where("false"), table)) == []
    assert len(rows(filter_audit.audit_documents(docs, table.where("false")))) == 2400


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_ids_are_the_tokenizers(tokenizer, monkeypatch):
    random.seed(3)
    marks = [chr(i) for i in range(0x180)] + list("̸̱̀́̌̇  　\x85ẞİΣσ日本…—“”’sStT'.,;:!?<|>AJHTWY") * 3
    marks += ["<|endoftext|>", "'s", "'ll", "J̌", "T̈", "\U0001F600", "ﬁ", "\x1c"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 40))) for _ in range(8000)] + [t or "" for _, t, _ in ROWS]
    for kept in (1 << 20, 300):
        monkeypatch.setattr(pattern_packing, "KEPT_WORDS", kept)
        encoder = pattern_packing.WordIds(PATH)
        for row, data, offsets in words.pieces(pa.array(texts), 1 << 12):
            flat, bounds = encoder.encode(data, offsets)
            for k, t in enumerate(texts[row:row + len(offsets) - 1]):
                assert flat[bounds[k]:bounds[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t


def check_packing(got, table, tokenizer, size):
    want = []
    for i, t, *_ in table:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a:a + size]), crc32(ids[a:a + size].tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for *_, length, _, sequence, offset in got:
        sequences.setdefault(sequence, []).append((offset, length))
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_packing(spark, docs, tokenizer):
    n = check_packing(rows(pattern_packing.pack(spark, docs.repartition(3), PATH)), ROWS, tokenizer, 2048)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    assert n <= -(-total // 2048) + 1
    assert pattern_packing.pack(spark, docs.where("false"), PATH).count() == 0
    check_packing(rows(pattern_packing.pack(spark, docs, PATH, size=7)), ROWS, tokenizer, 7)


def test_packing_query(spark, tokenizer):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows(QUERIES["op12_pattern_packing"](spark, SF))
    n = check_packing(got, table, tokenizer, 2048)
    full = sum(length == 2048 for *_, length, _, _, _ in got)
    short = sum(length for *_, length, _, _, _ in got if length < 2048)
    assert n <= full + -(-short // 2048) + 1


def test_plans_use_every_piece_once_and_fill_sequences():
    rng = np.random.default_rng(0)
    for lengths in (np.clip(rng.normal(683, 120, 100_000).astype(int), 300, 2000), rng.integers(1, 2048, 50_000),
                    np.full(1000, 700), np.full(999, 1), rng.integers(1, 40, 30), np.array([2048, 1])):
        histogram = np.bincount(lengths, minlength=2049)
        patterns = pattern_packing.plan(histogram, 2048)
        used = np.zeros(2049, int)
        for content, repeats in patterns:
            assert sum(content) <= 2048 and repeats > 0
            np.add.at(used, list(content), repeats)
        assert (used == histogram).all()
        alone = pattern_packing.best_fit(np.append(histogram[:2048], 0), 2048)
        assert sum(p.repeats for p in patterns) <= histogram[2048] + 1.001 * sum(p.repeats for p in alone)
    # where few lengths fit together, the fit beats best fit alone
    hard = np.bincount(np.clip(rng.normal(683, 120, 100_000).astype(int), 300, 2000), minlength=2049)
    alone = sum(p.repeats for p in pattern_packing.best_fit(hard, 2048))
    assert sum(p.repeats for p in pattern_packing.plan(hard, 2048)) < 0.97 * alone


def test_fit_is_non_negative_least_squares():
    """At the optimum no used pattern has a slope and no unused one a falling slope."""
    patterns = pattern_packing.exact_patterns(24)
    histogram = np.random.default_rng(2).integers(0, 90, 25)
    histogram[[0, 24]] = 0
    x = pattern_packing.fit_repeats(histogram, patterns, 20_000)
    weight = (np.arange(25) / 24) ** 2
    weight[0] = 0
    residual = np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=25) - histogram
    slope = (weight * residual)[patterns].sum(axis=1)
    assert (x >= 0).all() and slope.min() > -1e-3 and np.abs(slope[x > 1e-3]).max() < 1e-3


def brute_phrases(table, least, top):
    n, f = Counter(), Counter()
    for _, t, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = []
    for lang in n:
        found = []
        for key, a in f.items():
            p = key[1:]
            if key[0] != lang or len(p) < 2:
                continue
            if any(k[0] == lang and len(k) > len(key) and 100 * b >= 80 * a and any(k[1 + i:1 + i + len(p)] == p for i in range(len(k) - len(p)))
                   for k, b in f.items()):
                continue
            cuts = [(2000000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("every, bits", [(24, 14), (2, 3), (1, 1)])
def test_collocations(spark, docs, monkeypatch, every, bits):
    monkeypatch.setattr(collocations, "PART_ROWS_BITS", bits)
    rng = random.Random(7)
    vocabulary = ["a", "B", "cc", "Dé", "日", "e.f", "g,", "x\ty", "the"]
    table = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for i in range(120)]
    table += table[:10] + [r for r in ROWS if r[1] != LONG] + [(500, "a " * 3000, "en"), (501, "the cc\n" * 50, "de")]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3).withColumn("part", F.lit("x"))
    for least, top in ((30, 2000), (3, 5)):
        assert sorted(rows(collocations.collocations(df, least, top, every))) == brute_phrases(table, least, top)
    assert rows(collocations.collocations(docs.where("false"))) == []


def test_chunks_own_every_word_once():
    rng = random.Random(3)
    for every in (1, 3, 24):
        texts = [" ".join(rng.choice(["a", "b.", "c", "\n", "dd"]) for _ in range(rng.randint(0, 50))) for _ in range(200)]
        batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 200, "text": texts})
        found = [r for b in collocations._chunks([batch], every) for r in b.to_pylist()]
        assert sum(r["n"] * r["owned"] for r in found) == sum(len(re.findall(r"[^\s.]+", t)) for t in texts)
        for r in found:
            assert len(re.split("[ \n]", r["chunk"])) == r["owned"] + (0 if r["closing"] else collocations.OVERLAP)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_collocations"])
def test_new_oracles(spark, name):
    from checks.compare import compare, duck
    assert compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])["ok"]
