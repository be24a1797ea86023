import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from retroscope.llm import suffix_dedup as S


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def some_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(3)] + [prose(90)]
    texts = [prose(rng.randint(1, 300)) for _ in range(25)]
    texts += [prose(30) + rng.choice(shared) + prose(rng.randint(0, 40)) for _ in range(20)]
    base = prose(200)
    for _ in range(15):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "xyz"
        texts.append(" ".join(words))
    texts += [base, base, "a" * 900, "ab" * 700, "abc " * 300, "", None, shared[0], "é" * 450]
    return texts


@pytest.mark.parametrize("seed, hot, split, block, length", [(1, 20_000, 300, 64, 400), (2, 20_000, 300, 64, 400), (3, 4, 2, 64, 400), (4, 20_000, 1, 64, 400), (5, 20_000, 1, 7, 400), (6, 20_000, 300, 64, 200), (7, 5, 1, 300, 200)])
def test_equals_brute_force(spark, docs_of, monkeypatch, seed, hot, split, block, length):
    for name, value in (("HOT", hot), ("SPLIT", split), ("BLOCK", block)):
        monkeypatch.setattr(S, name, value)
    texts = some_texts(seed)
    got = {r.doc_id: r for r in S.cut_repeats(docs_of(list(enumerate(texts))).repartition(5), length).collect()}
    want = brute([(t or "").encode() for t in texts], length)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, i
        assert hashlib.sha256(r.kept).hexdigest() == w[3]


def covered(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(int(gone.sum()))
    return out


@pytest.mark.parametrize("seed, hot, split, piece", [(11, 20_000, 300, 1 << 20), (12, 4, 2, 1 << 20), (13, 20_000, 1, 1 << 20), (14, 20_000, 300, 1500)])
def test_two_lengths(spark, docs_of, monkeypatch, seed, hot, split, piece):
    for name, value in (("HOT", hot), ("SPLIT", split), ("PIECE", piece)):
        monkeypatch.setattr(S, name, value)
    texts = some_texts(seed)
    got = {r.doc_id: r for r in S.cut_repeats(docs_of(list(enumerate(texts))).repartition(5), 400, passage=200).collect()}
    plain = [(t or "").encode() for t in texts]
    for i, (w, n) in enumerate(zip(brute(plain, 400), covered(plain, 200), strict=True)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes) == (*w, n), i


def test_pieces_of_long_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1500)
    texts = some_texts(4)
    texts += ["".join(texts[k] or "" for k in range(20))]
    runs = list(S._pieces(S.bytes_of(__import__("pyarrow").array(texts)), 400))
    seen = Counter((row, at + i) for data, held in runs for row, at, s, e in held for i in range(e - s - 399))
    assert seen == Counter((row, i) for row, t in enumerate(texts) for i in range(len((t or "").encode()) - 399))


def test_nulls_repeated_rows_and_empty(spark):
    schema = "doc_id bigint, text string, start string, _tile int"
    long = "word " * 5 + "".join(chr(97 + i % 26) + str(i) for i in range(200))
    rows = [(1, long, None, 1), (1, long, "x", None), (None, "short", None, None), (2, None, None, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in S.cut_repeats(spark.createDataFrame(rows, schema)).collect())
    n = len(long)
    assert got == [(0, 5, 0, 0), (1, n, n, 1), (1, n, n, 1), (2, 0, 0, 0)]
    assert S.cut_repeats(spark.createDataFrame([], schema)).count() == 0
