"""The training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import os
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marquee.llm import (bit_sliced, bpe, exact_dedup, graph, kneser_ney, ngram_join, packing, quality, queries,
                         site_style, suffix_dedup, url_filter, words)
from tests.oracle import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
WHITE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=SCHEMA):
    """Rows of (doc_id, text), the other columns filled."""
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in texts], schema)


def word_soup(n, seed, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(50)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def small_texts():
    """Null, empty, white space, one word, exact and near copies, a repeated row, a text that repeats itself and a very long one."""
    base = word_soup(300, 1)
    near = base.split()
    near[150] = "changed"
    return [(1, base), (2, base.replace(" ", "\n")), (3, " ".join(near)), (4, None), (5, ""), (6, "  \t\n "), (7, "one"), (8, "One"),
            (9, "again and again " * 200), (10, word_soup(300, 2)), (10, word_soup(300, 2)), (None, base), (12, "é" * 700),
            (13, "x" * 300_000), (14, word_soup(60, 3) + " " + word_soup(90, 4)), (15, word_soup(70, 5) + " " + word_soup(90, 4))]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    out = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert compare(out, connect(FOLDER).sql(queries.ORACLE[name]).df()) is None


# exact dedup

def test_exact_groups_by_hand(spark, small_texts):
    rows = exact_dedup.exact_groups(docs_of(spark, small_texts)).collect()
    assert len(rows) == len(small_texts)
    groups = defaultdict(list)
    for i, t in small_texts:
        groups[WHITE.sub(" ", t or "")].append(i)
    keys = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in rows:
        if r.group_size > 1:
            ids = keys[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
    assert sum(r.kept for r in rows) == len(groups)


def test_drop_exact_copies_keeps_one_of_each(spark, small_texts):
    kept = exact_dedup.drop_exact_copies(docs_of(spark, small_texts)).collect()
    assert sorted(WHITE.sub(" ", r.text or "") for r in kept) == sorted({WHITE.sub(" ", t or "") for _, t in small_texts})
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


# packing

def test_packing_pieces_and_windows(spark, small_texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs_of(spark, small_texts), path=path, group_tokens=30_000).collect()
    ids = {i: array("I", own.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in small_texts}
    covered = Counter()
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start: r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
    assert covered == Counter({i: len(ids[i]) * sum(j == i for j, _ in small_texts) for i, _ in small_texts})
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_best_fit_decreasing_takes_the_tightest_window():
    r = random.Random(4)
    for _ in range(50):
        lengths = [r.randint(1, 64) for _ in range(r.randint(0, 60))]
        number, offset = packing.best_fit_decreasing(lengths, 64)
        room: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [x for x in room if x >= lengths[i]]
            if not fits:
                room.append(64)
                fits = [64]
            assert 64 - offset[i] == min(fits)
            room[room.index(min(fits))] -= lengths[i]
        assert len(set(number.tolist())) == len(room)


ODD = [chr(x) for x in (9, 10, 13, 28, 31, 32, 32, 39, 65, 97, 48, 0x85, 0xA0, 0x2003, 0x3000, 0x200B, 0x301, 0xE9, 0x3A3, 0x3C3, 0x130,
                        0x4E2D, 0x1F600, 0, 0xFEFF, 0xB2, 0x2160, 0x1E9E, 0x212B, 0xFB01)]


def odd_texts(n, *more):
    r = random.Random(9)
    return ["".join(r.choice([*ODD, "'S", "'ll", *more]) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_word_tokenizer_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), packing.tokenizer(path)
    sample = odd_texts(3000, "<|endoftext|>", "<|StartOfText|>")
    for text, raw in zip(sample, own.encode_bytes(sample)):
        assert array("I", lib.encode(text, add_special_tokens=False).ids).tobytes() == raw, repr(text)


# byte-pair encoding

def test_bpe_equals_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.codec(path)
    for text in [*list(texts.values())[:60], *odd_texts(3000, "<|endoftext|>"), "a" * 5000, "abc " * 500, "", "thth" * 40]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False), repr(text[:50])


def test_bpe_column(spark, small_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs_of(spark, small_texts).withColumn("n_tokens", F.lit("clash"))
    rows = bpe.digests(docs, path=path).collect()
    assert len(rows) == len(small_texts) and all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)
    back = bpe.decode_ids(bpe.encode_texts(docs, path=path), path=path, out="again").collect()
    assert all(r.again == (r.text or "") for r in back)


# quality

def test_quality_learns_and_is_total(spark, small_texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels, usable=quality.fold(F.col("doc_id"), 5) != 0)
    scored = model.score(docs).join(labels, "doc_id").select("quality", "score").toPandas()
    good, bad = scored[scored.quality == 1].score, scored[scored.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.9
    rows = model.score(docs_of(spark, small_texts)).collect()
    assert len(rows) == len(small_texts) and all(0 <= r.score <= 1 for r in rows)
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in nothing.score(docs.limit(3)).collect()} == {0.5}


# pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>site</p></header><nav><ul><li>one<li>two</ul></nav><div class="cookie-notice">cookies</div>
<article><h1>Head &amp; more</h1><p>First <b>bo</b>ld
 text<br>line<p>Second&nbsp;&lt;x&gt; <a href="#">link</a></p><form><p>form</p></form><section class="comments"><p>reader</p></section></article>
<aside><p>side</p></aside><footer>&copy; f</footer></body></html>"""


def test_main_text_of_hand_written_pages():
    assert site_style.main_text(PAGE, set()) == "Head & more First bold text line Second\xa0<x> link"
    assert site_style.main_text(None, set()) == "" == site_style.main_text("", set())
    assert site_style.main_text("<p>a<p>b<div>c</div> d", set()) == "a b c d"
    assert site_style.main_text("<div><!-- x --><p>1 &lt; 2 < 3</p></div><script>p</script>", set()) == "1 < 2 < 3"


def test_articles_in_odd_places_are_kept():
    article = "<article><h1>Head</h1><p>The whole story told here.</p></article>"
    body = "Head The whole story told here."
    for page in (f"<form id=f action=x><div><main>{article}</main></div></form>", f"<form id=f>{article}</form>",
                 f"<div class='has-sidebar'><main>{article}</main><aside>side</aside></div>", f"<div class='page no-sidebar'>{article}</div>",
                 f"<div class='search-results'><main>{article}</main></div>", f"<div><svg width=1>{article}</div>", f"<p>x<video src=y></p>{article}"):
        assert site_style.main_text(page, set()).endswith(body), page
    assert site_style.main_text(f"<nav><main>{article}</main></nav><div class='related'>{article}</div><p>left</p>", set()) == "left"
    long = " ".join(["A post of many words."] * 20)
    assert site_style.main_text(f"<div class='post-body'><p>{long}</p></div><article class='card'><p>Read on</p></article>", set()) == f"{long} Read on"
    assert site_style.main_text("<article><p>sum <math><mi>x</mi></math></p></article>", set()) == "sum x"


def test_site_tree_removes_what_is_the_same_everywhere(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><p>Same words on every page</p></div><section><p>Own {i} words {i * i}</p></section></body>")
             for i in range(30)] + [(100, None, None), (101, "http://other.example/", "<p>alone</p>"), (101, "http://other.example/", "<p>alone</p>")]
    rows = site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(rows) == 33
    by = {r.page_id: r.text for r in rows}
    assert all(by[i] == f"Own {i} words {i * i}" for i in range(30)) and by[100] == "" and by[101] == "alone"
    counts = site_style.node_counts(spark.createDataFrame(pages, "page_id long, url string, html string").select(F.lit("h").alias("h"), "html"))
    found = {round(r.importance, 6) for r in site_style.node_importance(counts).filter("pages = 30").collect()}
    assert site_style.importance_of(2, [2], [2]) == 0.5 and site_style.importance_of(30, [30], [30]) == 2 / 32  # few pages say little
    assert found == {round(site_style.importance_of(30, [30], [30]), 6), round(site_style.importance_of(30, [30], [1] * 30), 6)}


# top k

def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    data = [(i, (r.integers(-4, 5, 8) / 16).tolist()) for i in range(300)] + [(7, [0.5] * 8), (400, None), (420, [1.0, None] * 4),
            (440, [float("nan")] * 8), (460, [float("inf")] * 8), (500, [1.0, 2.0]), (520, [3.0, -1.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = bit_sliced.top_k(frame, k=5, query=F.col("vec_id") % 20 == 0, block_rows=64, block_queries=7).collect()
    valid = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in data if v is not None and None not in v and np.isfinite(v).all()]
    expected = set()
    for q, x in valid:
        if q % 20 == 0:
            scores = sorted((-int(x @ y), i) for i, y in valid if i != q and len(y) == len(x))[:5]
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {tuple(row) for row in out} == expected and len(out) == len(expected)
    assert bit_sliced.top_k(frame.limit(0), query=F.lit(True)).count() == 0


# repeated passages

def repeats_by_hand(texts, length, keep_first):
    seen = defaultdict(list)
    raw = [(t or "").encode() for _, t in texts]
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))  # of equal rows any may be first
    for k in order:
        for p in range(len(raw[k]) - length + 1):
            seen[raw[k][p: p + length]].append((k, p))
    out = []
    for k, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            places = seen[b[p: p + length]]
            if len(places) > 1 and not (keep_first and places[0] == (k, p)):
                gone[p: p + length] = True
        out.append((texts[k][0], len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most,part", [(256, 1_000_000), (2, 200)])
def test_repeats_equal_brute_force(spark, small_texts, keep_first, most, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    sample = [x for x in small_texts if x[0] != 13] + [(20 + k, word_soup(30, k) + " " + word_soup(40, 77) + " " + word_soup(k, 99)) for k in range(12)]
    out = suffix_dedup.remove_repeats(docs_of(spark, sample), length=100, keep_first=keep_first).collect()
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.kept_sha256) for r in out)
    assert found == sorted((i or -1, n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in repeats_by_hand(sample, 100, keep_first))
    assert "lang" in out[0].asDict() and suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_repeats_of_the_tables(spark, texts):
    seen, raw = Counter(), {i: (t or "").encode() for i, t in texts.items()}
    for b in raw.values():
        seen.update(b[p: p + 400] for p in range(len(b) - 399))
    for r in queries.op6(spark, FOLDER).collect():
        b = raw[r.doc_id]
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 399):
            if seen[b[p: p + 400]] > 1:
                gone[p: p + 400] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_long_text_positions():
    text = ("ab" * 300 + word_soup(200, 8)).encode()
    data = np.frombuffer(text, np.uint8)
    found = suffix_dedup.blocks_of(data, np.array([0, len(data)]), 100)
    covered = sorted(p for lo, hi in zip(found["low"], found["high"]) for p in range(lo, hi + 1))
    assert covered == list(range(len(text) - 99))


# near duplicates

def sets_by_hand(texts):
    out = {}
    for i, t in texts.items():
        w = [x for x in WHITE.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def components_by_hand(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(sets)
    for n, a in enumerate(names):
        for b in names[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in names}


def test_near_duplicates_of_the_tables(spark, texts):
    sets = sets_by_hand(texts)
    expected = components_by_hand(sets)
    rows = queries.op7(spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), expected[i]) for i in sets}


@pytest.mark.parametrize("hot", [2, 16])
def test_near_duplicates_in_hot_groups(spark, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    r = random.Random(5)
    base, other = word_soup(120, 50).split(), word_soup(100, 51).split()
    texts = {0: None, 1: "", 2: "one two", 3: "ONE  two", 4: "one two three"}
    for i in range(5, 60):  # a large group, two that touch it, and a chain
        own = list(base if i < 45 else other)
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = f"z{r.randrange(10**6)}"
        texts[i] = " ".join(own)
    texts |= {60 + k: " ".join(base[3 * k:] + other[: 3 * k]) for k in range(30)}
    rows = ngram_join.near_duplicates(docs_of(spark, list(texts.items()))).collect()
    sets = sets_by_hand(texts)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == {i: (len(sets[i]), g) for i, g in components_by_hand(sets).items()}


def test_near_duplicates_edge_cases(spark, small_texts):
    rows = ngram_join.near_duplicates(docs_of(spark, small_texts)).collect()
    assert len(rows) == len(small_texts)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == by[3] == by[None] == 1 and by[4] == 4 and by[8] == 7 and by[10] == 10
    assert ngram_join.near_duplicates(docs_of(spark, [])).count() == 0
    kept = {r.doc_id for r in ngram_join.keep_one_of_each(docs_of(spark, small_texts)).collect()}
    assert {1, 4, 5, 6, 7}.issubset(kept) and not kept & {2, 3, 8}


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(5, 5), (70, 71)]
    found = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 100 for k in range(100, 141)} | {k: 1 for k in range(1, 60)} | {70: 70, 71: 70}


# language model

def test_scores_by_hand(spark, texts):
    rows = {r.doc_id: r for r in queries.op8(spark, FOLDER).collect()}
    tokens = {i: [w for w in WHITE.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = rows[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    # the bigram model by its formula, over all bigrams
    pairs = Counter(p for i, ws in tokens.items() if not held[i] for p in zip(["<", *ws], ws))
    before = Counter(w for _, w in pairs)
    total = Counter()
    for (a, _), c in pairs.items():
        total[a] += c
    d = kneser_ney.discounts([sum(c == k for c in pairs.values()) for k in range(1, 5)])
    e = kneser_ney.discounts([sum(c == k for c in before.values()) for k in range(1, 5)])
    off = lambda c, x: 0 if c == 0 else x[min(c, 3) - 1]
    unknown = sum(off(c, e) for c in before.values()) / len(pairs)
    lower = lambda w: (before[w] - off(before[w], e)) / len(pairs) + unknown / (v + 1)
    given = defaultdict(float)  # what each context leaves to the lower order
    for (a, _), c in pairs.items():
        given[a] += off(c, d)
    for i, ws in list(tokens.items())[:80]:
        score = 0.0
        for a, b in zip(["<", *ws], ws):
            seen = (pairs[a, b] - off(pairs[a, b], d)) / total[a] if pairs[a, b] else 0.0
            score += math.log10(seen + (given[a] / total[a] if total[a] else 1.0) * lower(b))
        assert rows[i].score == pytest.approx(score, rel=1e-9)


def test_model_edge_cases(spark, small_texts):
    docs = docs_of(spark, small_texts).withColumn("score", F.lit("clash"))
    rows = kneser_ney.score(docs, kneser_ney.train(docs)).collect()
    assert len(rows) == len(small_texts) and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows)
    empty = kneser_ney.train(docs.limit(0))
    assert all(r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in kneser_ney.score(docs, empty).collect())


# urls

def test_url_rules(spark):
    urls = [(1, "http://A.Net/x"), (2, "https://b.example.net/en/1?q#f"), (3, "https://b.example.net/fr/1"), (4, "http://example.com/de/"),
            (5, "http://xexample.com/de/"), (6, None), (7, "no scheme"), (8, "http://"), (9, "http://net"), (10, "http://net?x=/y"), (11, "u://org/fr/"),
            (12, "http://a..net/p"), (1, "http://A.Net/x")]
    frame = spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit(0)).withColumn("key", F.lit("k"))
    rules = url_filter.rules_table(spark, queries.URL_RULES)
    rows = url_filter.judge_urls(frame, rules).collect()
    assert len(rows) == len(urls)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert by == {1: ("a.net", "/x", "net/", "block"), 2: ("b.example.net", "/en/1", "example.net/en/", "allow"), 3: ("b.example.net", "/fr/1", "net/", "block"),
                  4: ("example.com", "/de/", "example.com/de/", "block"), 5: ("xexample.com", "/de/", None, "allow"), 6: ("", "", None, "allow"),
                  7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("net", "", None, "allow"), 10: ("net", "", None, "allow"),
                  11: ("org", "/fr/", "org/fr/", "allow"), 12: ("a..net", "/p", "net/", "block")}
    assert {r.verdict for r in url_filter.judge_urls(frame, rules.limit(0)).collect()} == {"allow"}


# words and pipeline

def test_words_never_cross_texts():
    for first, data, offsets in words.chunks(["ab cd", "", None, "cd", " ab"]):
        hashes, doc = words.word_hashes(data, offsets)
        assert doc.tolist() == [0, 0, 3, 4] and hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[0] != hashes[1]


def test_pipeline_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).toPandas()
        assert list(after.columns) == names and len(after) <= before.count() and after.doc_id.is_unique
        if name == "exact_dedup":
            assert not after.text.map(lambda t: WHITE.sub(" ", t or "")).duplicated().any()
        if name == "near_duplicates":
            sets = {i: s for i, s in sets_by_hand(dict(zip(after.doc_id, after.text))).items() if s}
            assert components_by_hand(sets) == {i: i for i in sets}
        if name == "repeated_passages":
            strings = Counter(b[p: p + corpus_pipeline.REPEAT_BYTES] for b in (t.encode() for t in after.text)
                              for p in range(len(b) - corpus_pipeline.REPEAT_BYTES + 1))
            old = dict(zip(*before.select("doc_id", "text").toPandas()[["doc_id", "text"]].to_numpy().T))
            changed = [i for i, t in zip(after.doc_id, after.text) if t != old[i]]
            assert len(changed) < len(after) and sum(c > 1 for c in strings.values()) < 400
        before = spark.createDataFrame(after, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after.doc_id)


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0


def test_top_k_ships_an_index_block_once_for_many_query_blocks(spark):
    """A block of the index was copied for each block of queries, in 64-bit numbers."""
    index = spark.range(3).select(F.col("id").cast("int").alias("block"))
    queries = spark.range(40).select(F.col("id").cast("int").alias("part"))
    left, right = bit_sliced.sectioned(index, queries, 3, 40)
    assert left.count() == 3 * -(-40 // bit_sliced.SECTION) and right.count() == 3 * 40
    met = left.join(right, ["block", "section"]).groupBy("block", "part").count()
    assert met.count() == 120 and met.filter("count > 1").isEmpty()
    for values, width in (([-128, 127], 1), ([-129, 0], 2), ([40_000, 0], 4), ([1 << 40, -5], 8)):
        data, found = bit_sliced.narrow(np.array([values]))
        assert found == width and bit_sliced.widened(data, found, 2, 1).tolist() == [values]
