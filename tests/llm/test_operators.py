"""Every operator against a brute-force version, and on difficult rows."""

import hashlib
import re
import zlib
from math import comb

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewise.llm import (backoff, jaccard_trie, main_text, pieces, piecewise, preference, sharding, toxicity,
                          url_templates, winnowing, words)
from pagewise.llm.oracle import ORACLES
from pagewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(3_000))  # the SQL comparisons copy it once a word
ROWS = [(1, "One two three four five six seven eight nine ten eleven", "x"), (2, None, None), (3, "", "x"),
        (4, "one two three four five six seven eight nine ten eleven", "y"), (4, "one two three four five six seven eight nine ten eleven", "y"),
        (5, "two", "z"), (6, "one two three four five six seven eight nine ten CHANGED", None), (7, LONG, "x"), (8, LONG + " end", "x"),
        (9, "Éa ▁ b\t\n  日本 \x00c", "x"), (None, "one two three", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for c in ("shard", "slot", "key", "n", "block", "ids", "n_tokens", "cluster", "row", "part"):  # clashing names
        df = df.withColumn(c, F.lit("other"))
    return df


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hypergeometric_law(spark):
    draws = spark.range(5000).select(sharding.hypergeometric(
        F.lit(50.0), F.lit(20.0), F.lit(15.0), (F.col("id") + 0.5) / 5000).cast("int").alias("x")).toPandas().x
    law = [comb(20, k) * comb(30, 15 - k) / comb(50, 15) for k in range(16)]
    assert np.abs(np.bincount(draws, minlength=16) / 5000 - law).max() < 5e-4


def test_shards(spark, docs, nothing):
    many = spark.range(1000).repartition(5)
    out = sharding.shuffle_into_shards(many, 7, block_rows=32, bucket_rows=16).toPandas()
    assert sorted(out.id) == list(range(1000))
    sizes = out.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all()
    assert (sizes["nunique"] == sizes["count"]).all()
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == len(ROWS) and set(got["size"]) >= {1, 4}
    assert sharding.shard_documents(nothing).count() == 0
    assert sharding.shuffle_into_shards(docs, 3).columns.count("shard") == 1


def test_preferences(spark):
    turns = [(1, 0, "user", "q", 0), (1, 1, "assistant", "a1", 0), (1, 2, "assistant", "a2", 0), (2, 0, "user", "q", 0),
             (2, 1, "assistant", "a3", 0), (3, 0, "user", None, 0), (None, 0, "user", "lost", 0), (1, 0, "user", "q", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, prompt int")
    got = {r["conv_id"]: r for r in preference.preference_rows(df).collect()}
    assert set(got) == {1, 2}
    first = got[1]
    assert first["n_shared"] == 3 and first["prompt"].count("<|user|>") == 2 and first["chosen"] == "<|assistant|>\na2<|end|>\n"
    assert first["rejected"] == "<|assistant|>\na3<|end|>\n" and first["trainable"]
    s = first["chosen_spans"][0]
    assert first["chosen"][s["start"]:s["stop"]] == "a2<|end|>\n"
    assert preference.preference_rows(df.where("false")).count() == 0
    same = spark.createDataFrame([(1, [("user", "a")], [("user", "a")])],
                                 f"pair_id long, chosen_turns {preference.TURN}, rejected_turns {preference.TURN}")
    r = preference.format_preferences(same).first()
    assert (r["n_shared"], r["chosen"], r["trainable"]) == (1, "", False)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(pairs):
    sets = [(i, shingles(t)) for i, t in pairs if i is not None]
    low = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        before = dict(low)
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
        if before == low:
            return low
    return low


def near_copies():
    rng = np.random.default_rng(4)
    out = []
    for i in range(36):
        w = [f"v{k}" for k in range(120)]
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, 120)] = f"x{rng.integers(0, 9999)}"
        out.append((100 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(jaccard_trie, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_trie, "HUB_BLOCKS", 2 if block == 3 else 128)
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near_copies(), "doc_id long, text string"))
    pairs = rows(table)
    want = brute_components(pairs)
    got = rows(jaccard_trie.jaccard_classes(table))
    assert len(got) == len(pairs)
    assert all(c == want.get(i) for i, _, c in got)
    assert sorted((i or 0, n) for i, n, _ in got) == sorted((i or 0, len(shingles(t))) for i, t in pairs)
    if block == 3:
        assert jaccard_trie.jaccard_classes(nothing).count() == 0
        kept = jaccard_trie.one_of_each(docs)
        assert kept.columns == docs.columns and sorted(r[0] or 0 for r in rows(kept)) == [0, 1, 2, 3, 5, 6, 7, 9]


def near_dup_rows():
    """Copies between the bounds: a changed block of 8% of the shingles, scattered edits, and unlike texts."""
    rng = np.random.default_rng(9)
    out = []
    for i in range(6):
        w = [f"u{i}_{k}" for k in range(200)]
        block, several = list(w), list(w)
        block[100:100 + int(rng.integers(4, 12))] = ["new"] * 3
        several[20], several[120] = "x", "y"
        out += [(300 + 10 * i, " ".join(w)), (301 + 10 * i, " ".join(block)), (302 + 10 * i, " ".join(several[:190]))]
    return out + [(400, "a b c d"), (401, "a b c d"), (402, "a b c e"), (403, "a b c d e f"), (404, None)]


def stage_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def stage_components(pairs):
    """Of five-word shingles with a Jaccard of 0.8 or more, the pipeline stage's bound."""
    sets = [(i, stage_shingles(t)) for i, t in pairs]
    low = {i: i for i, _ in sets}
    links = [(i, j) for i, a in sets for j, b in sets if a and b and 10 * len(a & b) >= 8 * len(a | b)]
    for _ in sets:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark, monkeypatch, block):
    import corpus_pipeline
    monkeypatch.setattr(jaccard_trie, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_trie, "HUB_BLOCKS", 2 if block == 3 else 128)
    pairs = near_dup_rows() + near_copies()
    low = stage_components(pairs)
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, table, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in low if low[i] == i)
    assert low != brute_components(pairs)  # pairs that lie between the two bounds


@pytest.mark.parametrize("parts", [1, 8])
def test_repeated_ids_with_other_texts(spark, parts):
    text = lambda k: " ".join(f"t{k}_{i}" for i in range(60))
    pairs = [(3, text(0)), (7, text(0)), (7, text(1)), (8, text(1)), (7, text(0) + " end"), (7, None), (7, " "), (None, text(0))]
    pairs += [(9, text(100 + i)) for i in range(20)] + [(9, text(100)), (9, None), (2, text(119)), (5, text(200)), (5, text(200))]
    table = spark.createDataFrame([(*p, "x") for p in pairs], "doc_id long, text string, _hash string").repartition(parts)
    kept = jaccard_trie.one_of_each(table)
    want = [(3, text(0)), (7, text(1)), (7, None), (7, " "), (None, text(0)), (9, None), (2, text(119)), (5, text(200))]
    want += [(9, text(100 + i)) for i in range(19)]
    assert kept.columns == table.columns and order([r[:2] for r in rows(kept)]) == order(want)
    got = rows(jaccard_trie.jaccard_classes(table))
    assert order([(i, c) for i, _, c in got]) == order(
        [(3, 3), (7, 3), (7, 7), (8, 7), (7, 3), (7, 7), (7, 7), (None, None), (9, 9), (9, 9), (2, 2), (9, 2), (5, 5), (5, 5)] + [(9, 9)] * 19)


@pytest.mark.parametrize("bound", [jaccard_trie.JOIN, jaccard_trie.CORPUS, jaccard_trie.Bound(4, 1, 2)])
def test_linked_sets_share_a_rare_key(spark, bound):
    """Families of sets of all levels, all with some n-grams of a common pool."""
    rng = np.random.default_rng(3)
    pool = words.mix(rng.integers(0, 1 << 62, 60))
    sets = []
    for _ in range(60):
        size = int(rng.choice([1, 2, 5, 20, 90, 130, 400, 600, 1500]))
        base = np.concatenate([words.mix(rng.integers(0, 1 << 62, size)), rng.permutation(pool)[:size // 4]])
        for _ in range(4):
            far = len(base) * (bound.den - bound.num) // bound.den
            lost = int(rng.integers(0, far // 2 + 2))
            new = words.mix(rng.integers(0, 1 << 62, int(rng.integers(0, far // 3 + 2))))
            sets.append(np.unique(np.concatenate([rng.permutation(base)[lost:], new])))
    sets = [x for x in sets if len(x)]
    keys, sizes = [], []
    for i, x in enumerate(sets):
        levels = jaccard_trie.sample_keys(x, bound)
        keys += [(int(k), i) for k in np.concatenate(levels).view(np.int64)]
        sizes.append((i, len(x), [len(k) for k in levels]))
    found = jaccard_trie.rare_keys(spark.createDataFrame(keys + keys[:999], "key long, rep long").repartition(3),
                                   spark.createDataFrame(sizes, "rep long, n long, sampled array<int>"), bound)
    own = {}
    for k, i in rows(found):
        own.setdefault(i, set()).add(k)
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            over = len(np.intersect1d(a, sets[j]))
            if over and bound.den * over >= bound.num * (len(a) + len(sets[j]) - over):
                linked += 1
                assert own.get(i, set()) & own.get(j, set())
    assert linked > 40
    assert sum(map(len, own.values())) < len(keys) / 2


@pytest.mark.parametrize("long", [1 << 17, 4])
def test_counted_runs(monkeypatch, long):
    monkeypatch.setattr(jaccard_trie, "LONG_RUN", long)
    rng = np.random.default_rng(5)
    for _ in range(300):
        pairs = sorted((int(k), int(r)) for k, r in zip(rng.integers(0, rng.integers(1, 9), 40), rng.integers(0, 30, 40)))
        cuts = sorted(rng.integers(0, 41, 4).tolist())
        batches = [pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in pairs[a:b]], pa.int64()), "rep": pa.array([r for _, r in pairs[a:b]], pa.int64())})
                   for a, b in zip([0, *cuts], [*cuts, 40])]
        got = [tuple(r.values()) for b in jaccard_trie._counted_runs(iter(batches)) for r in b.to_pylist()]
        distinct = sorted(set(pairs))
        held = {k: sum(x == k for x, _ in distinct) for k, _ in distinct}
        ends = {distinct[0][0], distinct[-1][0]}
        assert sorted((k, r) for k, r, _, _ in got) == [(k, r) for k, r in distinct if k in ends or held[k] > 1]
        for k in held:
            seen = {(n, cut) for x, _, n, cut in got if x == k}
            assert seen <= {(held[k], False)} if k not in ends and held[k] <= long else seen in ({(0, True)}, {(held[k], False)})


def test_samples_suffice():
    for bound in (jaccard_trie.JOIN, jaccard_trie.CORPUS):
        for (share, low), (_, up) in zip(jaccard_trie.sample_levels(bound)[1:], [*jaccard_trie.sample_levels(bound)[2:], (0, 9999)]):
            n = np.arange(low * bound.num // bound.den, up)
            sure = n * share - 7.5 * np.sqrt(n * share * (1 - share))
            assert (sure > [jaccard_trie.may_differ(int(x), bound) for x in n]).all()


def test_keys_cut_by_ranges(spark):
    hot = [(7, i) for i in range(100, 700)]
    rare = [(k, 1000 + k // 2) for k in range(20, 60)] + [(k, 2000 + k) for k in range(20, 60, 3)] + [(3, 5), (3, 5)]
    keys = spark.createDataFrame(hot + rare, "key long, rep long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the hot key spans ranges
    try:
        found, shared = map(rows, jaccard_trie.sharing(keys))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nodes = {r for _, r in hot + rare}
    groups = {}
    for k, r in hot + rare:
        groups.setdefault(k, []).append(r)

    def merged(edges):
        low = {n: n for n in nodes}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                if low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
        return low
    assert all(a != b for a, b in found) and len(found) == len(set(found))
    assert merged(found) == merged([(g[0], r) for g in groups.values() for r in g])
    assert {(k, r) for k, g in groups.items() if len(set(g)) > 1 for r in g} <= set(shared) <= set(hot + rare)
    assert [rows(x) for x in jaccard_trie.sharing(keys.where("false"))] == [[], []]


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, pa.Table.from_pandas(df))
    return [tuple(r) for r in con.execute(sql).fetchall()]


def order(xs):
    return sorted(xs, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_backoff_scores(docs, nothing):
    table = docs.select("doc_id", "text")
    got, want = rows(backoff.score_documents(table)), duck(ORACLES["op4_backoff_scores"], documents=table.toPandas().astype({"doc_id": "Int64"}))
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=2e-4)
    assert backoff.score_documents(nothing).count() == 0


def test_main_text(spark):
    page = ("<html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>"
            "<div class='cookie-notice'>We use cookies on this site, as you know.</div><div class=ad>Buy now, cheap things for all.</div>"
            "<article><h1>Head &amp; line</h1><p><b>First   paragraph<br>goes on &lt;here&gt; with words.<p>Short.</p><script>var x='<p>';</script>"
            "<aside>Side matter</aside><p>Last paragraph of the article, long enough to count.</p><section id=comments><p>A reader says so.</p></section>"
            "</article><form><p>Name</p></form><footer>&copy; us</footer>")
    want = "Head & line\n\nFirst paragraph goes on <here> with words.\n\nShort.\n\nLast paragraph of the article, long enough to count."
    assert main_text.main_text(page) == want
    assert main_text.main_text("<div class=ad>x<article><p>All the text of it.</p></article>") == "All the text of it."
    plain = "<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><p>" + "Long text. " * 30 + "</p><p>Ok.</p><p>" + "More text. " * 30 + "</p>"
    assert main_text.main_text(plain).split("\n\n")[1] == "Ok." and "One" not in main_text.main_text(plain)
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page)], "page_id long, url string, html string")
    assert [len(r[2]) for r in rows(main_text.extract_pages(df))] == [len(want), 0, 0, len(want)]
    assert main_text.extract_pages(df.where("false")).count() == 0


def test_main_text_keeps_whole_articles():
    text = "A long paragraph of the article with many words in it, more than the rest."
    body = f"<p>{text}</p><p>{text}</p>"
    want = f"{text}\n\n{text}"
    for wrapper in ("article class='post tag-social-media'", "article class='category-search'", "main id=search", "div class='content has-sidebar'",
                    "div class='no-sidebar'", "div class=widget", "div id=sidebar"):
        assert main_text.main_text(f"<body><{wrapper}>{body}</{wrapper.split()[0]}>") == want
    for header in ("div class=entry-header", "div class='article-header'", "div class=header"):
        assert main_text.main_text(f"<article><{header}><h1>Head</h1></div>{body}</article>") == f"Head\n\n{want}"
    for start in ("<head><title>x</title><body>", "<head><title>x</title>", "<head><meta charset=x><script>var y</script>"):
        assert main_text.main_text(start + body) == want
    assert main_text.main_text("<head><title>x</title>" + text) == text
    comments = "<section id=comments><article class=comment>" + "<p>Said by a reader, at great length.</p>" * 20 + "</article></section>"
    assert main_text.main_text(f"<article>{body}{comments}</article>") == want
    assert main_text.main_text(f"<div class=ad>Buy now.</div>{body}<div class='share'>Share</div>") == want


def test_main_text_of_malformed_and_deep_pages():
    text = "A long paragraph of the article with many words in it, more than the rest."
    for odd in ("<![foo[bar]]>", "<![ x>", "<![CDATA[ x ]]>", "<!>", "<!x y>", "<!DOCTYPE html>", "<?php x ?>", "</>", "<!--x-->", "<!-- >"):
        assert text in main_text.main_text(f"{odd}<article><p>{text}</p>{'' if odd == '<!-- >' else odd}<p>{text}</p></article>") or odd == "<!-- >"
    assert main_text.main_text(f"<article><p>{text}</p><![ x").startswith(text)
    for cut in range(60):
        main_text.main_text(f"<!DOCTYPE html><![x[<article class='a'><p>{text}</p>"[:cut])
    deep = "<div class=ad>" * 20_000 + f"<p>{text}</p>" + "</div>" * 20_000
    assert main_text.main_text(deep) == text
    assert len(main_text.main_text("<article>" + f"<p>{text}</p>" * 20_000)) == 20_000 * (len(text) + 2) - 2


def test_main_text_keeps_titles_and_paragraphs_by_name():
    text = "A long paragraph of the article with many words in it, more than the rest."
    for name in ("id=related-work", "id=search", "id=share-price class=title"):
        assert main_text.main_text(f"<article><p>{text}</p><h2 {name}>Title</h2><p>{text}</p></article>") == f"{text}\n\nTitle\n\n{text}"
    assert main_text.main_text(f"<article><p>{text}</p><section id=related-work><p>{text}</p></section></article>") == f"{text}\n\n{text}"
    assert main_text.main_text(f"<article><p class='share-price'>{text}</p></article>") == text
    for gone in ("section id=related-posts", "div id=comments", "p class=disclaimer", "div class='share-box'", "section id=comments-2"):
        assert main_text.main_text(f"<article><p>{text}</p><{gone}>{text}</{gone.split()[0]}></article>") == text
    other = text.replace("article", "second")
    assert main_text.main_text(f"<article><p>{text}</p></article><article><p>{other}</p></article>") == f"{text}\n\n{other}"
    teaser = "<article><h3><a href=x>Read this other story as well</a></h3></article>"
    assert main_text.main_text(f"<article>{f'<p>{text}</p>' * 5}</article>{teaser}") == "\n\n".join([text] * 5)
    page = f"<body><ul><li><a href=x>Home</a></li></ul><h1>Head</h1><p><a href=y>By someone</a></p><p>{text}</p><p>{text}</p></body>"
    assert main_text.main_text(page) == f"Head\n\nBy someone\n\n{text}\n\n{text}"


def test_contamination(spark, docs, nothing):
    items = [(1, "two three four five six seven eight nine ten eleven"), (10, "TWO three"), (2, None), (None, "one"), (3, "日本"), (4, "?!"), (1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs.select("doc_id", "text")
    got = rows(winnowing.contamination(table, bench))
    frame = table.toPandas().astype({"doc_id": "Int64"})
    frame["text"] = frame["text"].map(lambda t: t if t is None else t.replace("\x00", " "))
    want = duck(ORACLES["op6_decontaminate"], documents=frame, benchmark=bench.toPandas().astype({"item_id": "Int64"}))
    assert order(got) == order(want)
    assert not any(r[5] for r in rows(winnowing.contamination(table, bench.where("false"))))
    assert winnowing.contamination(nothing, bench).count() == 0
    left = winnowing.clean_documents(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in got)


def test_toxicity_held_out(spark):
    base = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(base, labels)
    got = toxicity.score_documents(base, model).join(labels, "doc_id").where("held_out").toPandas()
    caught = got.predicted[got.toxic == 1].mean()
    wrong = got.predicted[got.toxic == 0].mean()
    assert caught > 0.8 and wrong < 0.03
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_learns_from_all_rows(spark):
    base = spark.range(12000).selectExpr("id AS doc_id", "concat('word', id % 50) AS text")
    labels = base.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    got = toxicity.learned_rows(base, labels).select("doc_id", "part").collect()
    assert sorted(r[0] for r in got) == [i for i in range(12000) if zlib.crc32(str(i).encode()) % 5]
    assert {r[1] for r in got} == set(range(toxicity.ROUNDS + 1))
    start = toxicity.train(["bad word", "good word"] * 20, [1, 0] * 20, calibrated=False)
    assert (toxicity.Model.of(start.table()).table() == start.table()).all()
    marked = spark.createDataFrame([("foul thing", 1), ("nice thing", 0), ("", 0)] * 300, "text string, toxic int").repartition(4)
    model = toxicity.learn_round(marked, start, (1.0, 1.0), 0.01)  # words that the first rows do not have
    texts = spark.createDataFrame([(1, "foul thing"), (2, "nice thing")], "doc_id long, text string")
    foul, nice = [r["score"] for r in toxicity.score_documents(texts, model).orderBy("doc_id").collect()]
    assert foul > 0.8 and nice < 0.2
    half = model.logits(*next(toxicity._features(pa.array(["foul thing", "nice thing", ""])))[1:3])
    p = 1 / (1 + np.exp(-np.rint(half.astype(float) * toxicity.GRAIN) / toxicity.GRAIN))
    assert np.allclose(toxicity.calibrate(marked, model), toxicity.best_threshold(p, np.array([300, 0, 0]), np.array([300] * 3)))


def test_toxicity_moves_labelled_texts_only(spark):
    base = spark.range(20000).selectExpr("id AS doc_id", "concat('word', id % 50) AS text").union(
        spark.createDataFrame([(7, "again"), (7, "again"), (7, None), (None, "no id")], "doc_id long, text string"))
    labels = spark.range(0, 20000, 100).selectExpr("cast(id + 7 AS int) AS doc_id", "1 AS toxic")
    known = toxicity.learned_labels(labels)
    bits = toxicity.id_bits(known)
    there = toxicity.with_bit(base, bits)
    labelled = [i for i in range(7, 20000, 100) if zlib.crc32(str(i).encode()) % 5]
    assert bits.count() <= toxicity.BIT_BUCKETS and there.columns == base.columns
    assert set(labelled) <= {r["doc_id"] for r in there.collect()} and there.count() < len(labelled) + 20
    rows = toxicity.learned_rows(base, labels)
    again = 3 if 7 in labelled else 0
    assert sorted(r["doc_id"] for r in rows.collect()) == sorted(labelled + [7] * (again - 1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id" in plan and "BroadcastHashJoin [bucket" in plan  # as on large tables
    first = toxicity.first_rows(rows.select("doc_id", F.xxhash64("text").alias("digest"), "toxic"))
    assert first.where("doc_id = 7").count() == again and first.count() == rows.count()


def test_toxicity_difficult_rows(docs, nothing):
    model = toxicity.train(["bad word here", "good word there"] * 20, [1, 0] * 20)
    assert len(rows(toxicity.score_documents(docs, model))) == len(ROWS)
    assert toxicity.score_documents(nothing, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert (toxicity.train([], []).out_bias, toxicity.train(["x"], [1]).out_bias) == (-5.0, 5.0)
    assert toxicity.best_threshold(np.array([0.9, 0.9]), np.array([1, 0])) == 0.5


def test_piecewise(docs, nothing):
    got = sorted(rows(piecewise.neighbour_fingerprints(docs)), key=lambda r: (r[0] or 0, r[1]))
    assert len(got) == len(ROWS)
    texts = {i: t or "" for i, t, _ in ROWS}
    down = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for r in got:
        nxt = texts[down[(down.index(r[0]) + 1) % len(down)]]
        t = texts[r[0]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert r[1:5] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), piecewise.fingerprint(t), piecewise.fingerprint(edited))
        assert r[5] == piecewise.likeness(r[3], r[4]) and 0 <= r[6] <= 1
    assert piecewise.neighbour_fingerprints(nothing).count() == 0
    assert piecewise.likeness(piecewise.fingerprint(LONG), piecewise.fingerprint(LONG + " end")) > 0.9

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in [("abcabd", "bcad"), ("", "x"), ("aaaa", "aa"), ("xyz" * 30, "zyx" * 30)]:
        assert piecewise.common_subsequence(a, b) == plain(a, b)


@pytest.mark.parametrize("part_rows", [1, 500])
def test_piecewise_repeated_and_single_ids(spark, monkeypatch, part_rows):
    monkeypatch.setattr(piecewise, "PART_ROWS", part_rows)
    texts = [f"{w} text of its own, {w * 9}" for w in ("red", "green", "blue", "grey")]
    many = [(i, t + str(i)) for i in range(1, 5) for t in texts]
    for pairs in ([(1, texts[0])], [(1, t) for t in texts], [(None, t) for t in texts[:2]], [(5, None)], many):
        df = spark.createDataFrame(pairs, "doc_id long, text string")
        hashed = [(r["doc_id"], r["text"] or "") for r in df.orderBy(F.xxhash64("text")).collect()]
        ids = sorted({i or 0 for i, _ in pairs})
        first = {i: next(t for j, t in hashed if (j or 0) == i) for i in ids}  # the smallest text hash
        want = []
        for i, t in hashed:
            other, half = first[ids[ids.index(i or 0) - 1]], len(t) // 2
            edited = t[:len(t) - half] + other[:half]
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), piecewise.fingerprint(t),
                         piecewise.likeness(piecewise.fingerprint(t), piecewise.fingerprint(other))))
        got = [(*r[:4], r[6]) for r in rows(piecewise.neighbour_fingerprints(df))]
        assert order(got) == order(want)


def test_pieces(docs, nothing):
    v = pieces.Vocabulary()
    value = dict(zip(v.ids.tolist(), v.scores.tolist(), strict=True))
    table = {v.bytes_of[i]: s for i, s in value.items()}
    for text in ["Hello  wörld\n▁ x   ", "a", "   ", "thorreou of 日本 \x00é" * 3]:
        raw = text.encode()
        ids, _ = v.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        word, best = b" " + raw, [0.0]
        for j in range(1, len(word) + 1):
            best.append(max(best[i] + table.get(word[i:j], v.byte_score if j - i == 1 else -1e9) for i in range(max(0, j - v.longest), j)))
        assert sum(value.get(i, v.byte_score) for i in ids.tolist()) == pytest.approx(best[-1])
    got = rows(pieces.round_trips(docs))
    assert len(got) == len(ROWS) and all(r[4] for r in got)
    coded = pieces.encode_documents(docs)
    back = pieces.decode_documents(coded)
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in ROWS)
    assert pieces.round_trips(nothing).count() == 0


def test_urls(spark):
    urls = ["https://A.org/x", "http://b.example.org/es/1", "http://example.org/en/12?q", "http://x.com/fr/1", "http://x.com/de/2#f", None, "no", "http://y.net"]
    urls += [f"http://bad.com/de/{i}" for i in range(30)] + ["http://bad.com/de.html", "http://fine.com/en/1"] + [f"http://fine.com/fr/{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_templates.url_verdicts(df).collect()}
    assert [got[i]["rule"] for i in range(8)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None]
    assert [got[i]["verdict"] for i in range(8)] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow"]
    assert (got[5]["host"], got[5]["path"], got[0]["host"], got[7]["path"]) == ("", "", "a.org", "")
    assert got[39]["verdict"] == "allow"
    assert url_templates.url_verdicts(df.where("false")).count() == 0


@pytest.mark.parametrize("sections", [20, 60])
def test_url_branches_whatever_the_siblings(spark, sections):
    urls = [f"http://x.com/{lang}/{i}" for lang, n in (("fr", 20), ("de", 30)) for i in range(n)]
    urls += [f"http://x.com/s{i}/1" for i in range(sections)]
    got = {r["page_id"]: r for r in url_templates.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len({got[i]["template"] for i in (0, 20, 50)}) == 3
    assert got[0]["purity"] < 0.2 and got[20]["purity"] > 0.9
    assert {got[i]["verdict"] for i in range(50, len(urls))} == {"allow"}


def test_url_tree_as_deep_as_the_paths(spark):
    rules = (("com", "/a/b/c/d/e/", "block"), ("com", "/a/b/c/d/e/about", "allow"))
    urls = [f"http://x.com/a/b/c/d/e/{i}" for i in range(30)] + [f"http://x.com/a/b/c/d/e/about/{i}" for i in range(30)] + ["http://x.com/a/b"]
    got = {r["page_id"]: r for r in url_templates.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert {got[i]["template"].split("/")[6] for i in range(30)} == {"{n}"}
    assert {got[i]["template"].split("/")[6] for i in range(30, 60)} == {"about"}
    assert got[0]["purity"] > 0.9 and got[30]["purity"] < 0.2 and got[60]["verdict"] == "allow"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    from checks import compare
    assert compare.compare(spark, compare.duck(SF), SF, name, QUERIES[name], ORACLES[name])["ok"]


def test_pipeline(spark):
    import corpus_pipeline
    base = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    model = toxicity.fit(base, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score_documents(base, model).where("predicted = 1").collect()}
    left = [(r["doc_id"], r["text"]) for r in base.collect() if r["doc_id"] not in toxic]
    low = stage_components(left)
    left = [(i, t) for i, t in left if low[i] == i]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    bench = [cut(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k:k + 10]) for w in bench for k in range(len(w) - 9)}
    assert min(map(len, bench)) >= 10
    clean = lambda w: not any(tuple(w[k:k + 10]) in grams for k in range(len(w) - 9))
    assert {r["doc_id"] for r in out.collect()} == {i for i, t in left if clean(cut(t))}
    assert set(out.columns) == {*base.columns, "n_tokens", "ids"}


def test_piecewise_batches_are_bounded_by_bytes(spark, monkeypatch):
    """A batch that Python gets holds megabytes, however many long texts a task has."""
    from pagewise.llm.common import BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int64()), pa.array([batch.nbytes] * n, pa.int64()), *[pa.array([""] * n)] * 3, *[pa.array([0.0] * n)] * 2],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    monkeypatch.setattr(piecewise, "_walk", sizes)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('x', 300000) as text")
    top = piecewise.neighbour_fingerprints(docs).agg({"n_chars": "max"}).first()[0]
    assert top < 2 * BATCH_BYTES


def test_words_of_a_long_run_are_segmented_once():
    """The distinct words of a megabyte of rows go through the lattice together."""
    from pagewise.llm import words
    text = pa.array([" ".join(f"w{i}" for i in range(3000))] * 40)  # 700 kB
    vocabulary = pieces.Vocabulary()
    seen, segment = [], vocabulary.segment
    vocabulary.segment = lambda w: seen.append(len(w)) or segment(w)
    for _, data, offsets in words.pieces(text, pieces.PIECE):
        vocabulary.encode(data, offsets)
    assert sum(seen) == 3000
