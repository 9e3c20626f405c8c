"""Language identification: features and posteriors against plain loops, held-out accuracy, edge cases."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import language_id, queries
from marquee.llm import words as W

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def brute_counts(text, bits):
    """Bucket -> count of one text, character by character."""
    spaced = ""
    for c in (text or "").lower():
        if c.isalpha():
            spaced += c
        elif spaced and spaced[-1] != " ":
            spaced += " "
    spaced, out = f" {spaced.strip(' ')} ", Counter()
    if not spaced.strip():
        return out
    for n in language_id.ORDERS:
        for i in range(len(spaced) - n + 1):
            if spaced[i: i + n] != " ":
                h = n
                for c in spaced[i: i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                out[int(W.mix(np.array([h], np.uint64))[0]) >> (64 - bits)] += 1
    return out


def test_features_of_neighbouring_texts_do_not_mix():
    r = random.Random(1)
    for _ in range(200):
        texts = ["".join(r.choice("aB é.!1 ßñ\nİ") for _ in range(r.choice([0, 0, 1, 2, 5, 12]))) if r.random() < .95 else None for _ in range(r.randint(1, 8))]
        for part in language_id.chunks(texts):
            doc, bucket, count, has = language_id.sparse_counts(part, 16)
            for k, t in enumerate(part):
                assert dict(zip(bucket[doc == k].tolist(), count[doc == k].tolist())) == brute_counts(t, 16)
                assert has[k] == any(c.isalpha() for c in t)


def test_posteriors_against_the_formula(spark, monkeypatch):
    monkeypatch.setattr(language_id, "OPEN_LANGUAGES", 2)  # tasks hand their counts on in between
    r = random.Random(2)
    rows = [(i, "".join(r.choice(letters) for _ in range(30)), lang) for i, (lang, letters) in
            enumerate([("aa", "abc d"), ("bb", "bcde "), ("cc", "xyzé "), ("dd", "éab x")] * 12)]
    rows += [(100, None, "aa"), (101, "12 34 !", "bb"), (102, "abc", None), (None, "bcd", "bb"), (0, rows[0][1], rows[0][2]), (103, "İIıß ﬁ", "cc")]
    docs = spark.createDataFrame([(*x, 1.0, "t") for x in rows], "doc_id long, text string, lang string, score double, guess string").repartition(3)
    got = {(x.doc_id, x.text): x for x in language_id.train(docs).predict(docs).collect()}
    counts, texts = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if lang is not None and text is not None:
            counts[lang].update(brute_counts(text, 16))
            texts[lang] += 1
    for i, text, _ in rows:
        row, own = got[(i, text)], brute_counts(text, 16)
        assert row.guess == "t"
        if not own:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        logs = {lang: math.log(texts[lang] / sum(texts.values())) + sum(
            n * math.log((counts[lang][b] + .1) / (counts[lang].total() + .1 * 2**16)) for b, n in own.items()) for lang in counts}
        best = max(logs.values())
        assert logs[row.lang_pred] == pytest.approx(best, abs=1e-2)
        assert row.score == pytest.approx(1 / sum(math.exp(x - best) for x in logs.values()), abs=1e-2)


def test_nothing_to_learn_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert language_id.train(empty).predict(empty).count() == 0
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], schema)
    assert {(r.lang_pred, r.score) for r in language_id.train(docs).predict(docs).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(1, "x" * 300_000 + " y", "en"), (2, "", "en")], schema)
    assert [(r.lang_pred, r.score) for r in language_id.train(one).predict(one).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0)]


def test_many_languages_take_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_CELLS", 1 << 12)
    docs = spark.createDataFrame([(i, chr(97 + i) * 20, f"l{i:02d}") for i in range(16)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.matrix.shape == (256, 16) and [r.lang_pred for r in model.predict(docs).orderBy("doc_id").collect()] == [f"l{i:02d}" for i in range(16)]
    with pytest.raises(ValueError):
        language_id.train(docs.unionByName(docs.withColumn("lang", F.lit("another"))))


def test_query_on_the_held_out_fold(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op13_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
