"""Tokenizer alignment against the libraries and a loop over all token pairs."""

import hashlib
import os
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marquee.llm import alignment, queries
from marquee.llm.bpe import byte_letters

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [(1, "Hello  world, naïve café!\n\ttwo"), (1, "Hello  world, naïve café!\n\ttwo"), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "<|endoftext|> <s> </s> <unk>"),
        (7, "日本語 🙂🙂 ‍ ﬁ ½"), (None, "the the the"), (9, "x" * 50_000), (10, "the " * 20_000), (11, "\x00\x01�"), (12, "   lead and trail   "),
        (13, "É" * 300 + " é"), (14, "1234567890 3.14159 ---- ....")]


def brute(texts):
    """One row per text by comparing every token of A with every token of B in reach."""
    one, two, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    one.encode_special_tokens = True
    done, linked = [], Counter()
    for i, text in texts:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        raw_a = [bytes(letters[c] for c in one.id_to_token(t)) for t in a]
        raw_b = [bytes([int(two.id_to_piece(t)[3:5], 16)]) if two.is_byte(t) else two.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            done.append((i, [], [], [], ""))
            continue
        span_a, span_b = [], []
        for raw, span in ((raw_a, span_a), (raw_b, span_b)):
            at = 0
            for r in raw:
                span.append((at, at + len(r)))
                at += len(r)
        links, k = [], 0
        for x, (s, e) in enumerate(span_a):
            while span_b[k][1] <= s:
                k += 1
            y = k
            while y < len(span_b) and span_b[y][0] < e:
                links.append((a[x], b[y]))
                y += 1
        common = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, x, y = [], 0, 0
        for end in common:
            left, right = [], []
            while x < len(a) and span_a[x][1] <= end:
                left.append(str(a[x]))
                x += 1
            while y < len(b) and span_b[y][1] <= end:
                right.append(str(b[y]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        linked.update(links)
        done.append((i, a, b, links, ";".join(groups)))
    highest = defaultdict(int)
    for (x, y), n in linked.items():
        highest[y] = max(highest[y], n)
    return sorted((repr(i), len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(linked[p] == highest[p[1]] for p in links),
                   sum(linked[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, links, g in done)


def rows_of(frame):
    return sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 3, 0])  # all pairs sent along, some, none
def test_hard_texts(spark, frequent):
    docs = spark.createDataFrame([(*t, 1, "x") for t in HARD], "doc_id long, text string, row int, pairs string").repartition(3)
    assert rows_of(alignment.alignments(docs, path_a=A, path_b=B, frequent=frequent)) == brute(HARD)


def test_tasks_hand_on_what_they_have_summed(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 10)
    docs = spark.createDataFrame([(i, f"word {i % 7} again and {'more ' * (i % 3)}") for i in range(60)], "doc_id long, text string")
    want = brute([(i, f"word {i % 7} again and {'more ' * (i % 3)}") for i in range(60)])
    found = alignment.aligned(docs, path_a=A, path_b=B)
    assert {r.pair: r.n for r in alignment.pair_counts(found).collect()} and rows_of(alignment.alignments(docs, path_a=A, path_b=B)) == want


def test_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), path_a=A, path_b=B).count() == 0


def test_a_vocabulary_that_is_not_in_order_of_its_ids_uses_the_other_library(tmp_path):
    import json

    with open(A, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    one, two = (("".join(m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"][:2])
    vocab[one], vocab[two] = vocab[two], vocab[one]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    texts = ["the time in there", "", " a <|endoftext|> b"]
    own = Tokenizer.from_file(str(path))
    own.encode_special_tokens = True
    assert [list(x) for x in alignment.ByteLevel(str(path)).encode(texts)] == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_query_against_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op11_alignment"](spark, FOLDER)) == brute(texts)
