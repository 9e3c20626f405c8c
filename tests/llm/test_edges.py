"""Rows that share ids, names that clash and the pipeline as registered."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import exact_dedup, kneser_ney, language_id, ngram_join, packing, quality, queries, staging, suffix_dedup
from tests.llm.test_llm import FOLDER, docs_of, word_soup

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_query_on_shared_and_null_ids(spark, folder):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "a "), (None, "x y"), (None, "x\ny"), (None, None), (None, ""), (3, "alone"), (None, "only null")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES["op1_exact_dedup"](spark, folder).collect()
    texts = [(i, WHITE.sub(" ", t or "")) for i, t in rows]
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for _, t in texts}
    want = sorted((repr(i), min((j for j, o in texts if o == t and j is not None), default=None), sum(o == t for _, o in texts), digest[t]) for i, t in texts)
    key = lambda r: (r[0], r[3])
    assert sorted(((repr(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(digest)


CLASHES = ("gone", "_gone", "many", "own_text", "scored", "_scored", "guess", "cut", "_cut", "row", "copy", "ranges", "times", "text_hash", "kept_text")


@pytest.fixture(scope="module")
def clashing(spark):
    base = word_soup(120, 3)
    rows = [(1, base), (1, base), (2, base + " more"), (3, None), (None, "short"), (4, "gone")]
    docs = docs_of(spark, rows)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


def test_columns_with_clashing_names_stay(spark, clashing):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    outs = {
        "exact": (exact_dedup.drop_exact_copies(clashing), 5),
        "near": (ngram_join.keep_one_of_each(clashing), 5),
        "language": (language_id.train(clashing).predict(clashing), 6),
        "model": (kneser_ney.score(clashing, kneser_ney.train(clashing)), 6),
        "quality": (quality.fit(clashing, labels).score(clashing, out="new"), 6),
        "repeats": (suffix_dedup.remove_repeats(clashing, length=100, keep_first=True), 6),
    }
    for name, (out, rows) in outs.items():
        found = out.collect()
        assert len(found) == rows, name
        for column in CLASHES:
            if (name, column) != ("repeats", "kept_text"):  # that one is the operator's own result
                assert {r[column] for r in found} == {f"own {column}"}, (name, column)
    assert len(packing.pack_documents(clashing, path=public_tokenizers.path("word_bpe_49k.json")).collect()) == 6


def test_of_rows_that_repeat_id_and_text_one_keeps_its_passages(spark, clashing):
    out = [r for r in suffix_dedup.remove_repeats(clashing, length=100, keep_first=True).collect() if r.doc_id in (1, 2)]
    size = len(word_soup(120, 3))
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in out) == [(1, 0, 0), (1, size, 1), (2, size, 1)]
    both = [r for r in suffix_dedup.remove_repeats(clashing, length=100).collect() if r.doc_id == 1]
    assert [r.n_removed for r in both] == [size, size]


def test_texts_with_null_ids_keep_apart(spark):
    texts = [word_soup(80, 100 + k) for k in range(40)]
    docs = docs_of(spark, [(None, t) for t in texts] + [(None, texts[0])])
    rows = suffix_dedup.remove_repeats(docs, length=100).collect()
    assert sorted(len(r.kept_text) for r in rows if r.n_removed) == [0, 0]
    assert sorted(r.kept_text for r in rows if not r.n_removed) == sorted(texts[1:])


def test_packing_deals_rows_without_ids(spark):
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).repartition(8)
    rows = packing.pack_documents(docs, path=public_tokenizers.path("word_bpe_49k.json"), group_tokens=1000).collect()
    groups = [r.sequence_id >> 32 for r in rows]
    assert len(rows) == 6000 and max(map(groups.count, set(groups))) < 3000
    assert len({(r.sequence_id, r.offset) for r in rows}) == 6000


def test_pipeline_run_is_its_stages_one_after_the_other(spark):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staging.staged(stage(spark, docs, FOLDER), name)
    want = docs.toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert len(got) and got[key].sort_values(key).reset_index(drop=True).equals(want[key].sort_values(key).reset_index(drop=True))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(corpus_pipeline.BATCH_ROWS)
