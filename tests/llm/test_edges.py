"""Awkward rows through each operator, and parts of operators against their definitions."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from retroscope.llm import chat, chunk_dedup, classifier
from retroscope.llm.decontamination import contaminated
from retroscope.llm.packing import pack
from retroscope.llm.quality_rules import LEAST, quality_rules
from retroscope.llm.suffix_dedup import cut_repeats
from retroscope.llm.tokens import count_tokens

CLASH = "doc_id bigint, text string, lang string, source string, start int, end int, n bigint, part int, score double, component string, digest bigint, n_words int"


def clashing(rows):
    return [(*r, "en", "s", 1, 2, 3, 4, 0.5, "c", 6, 7) for r in rows]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


AWKWARD = [(None, "a text without an id, of more than five words"), (3, None), (4, ""), (5, " \n\t "), (6, "twice the same row here"), (6, "twice the same row here"), (7, "é" * 50)]

OPERATORS = {
    "packing": lambda d, s: pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "tokens": lambda d, s: count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "suffixes": lambda d, s: cut_repeats(d, keep=None, passage=200),
    "rules": lambda d, s: quality_rules(d),
    "classifier": lambda d, s: classifier.score(d, classifier.train([b"good words here", b"bad bad bad"], [1, 0])),
    "decontamination": lambda d, s: contaminated(d, s.createDataFrame([(1, "one of the items that nobody has copied so far"), (None, None), (2, "")], "item_id bigint, text string")),
    "chunks": lambda d, s: chunk_dedup.copied_spans(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(spark, name):
    docs = spark.createDataFrame(clashing(AWKWARD), CLASH)
    rows = OPERATORS[name](docs, spark).collect()
    if name in ("tokens", "suffixes", "rules", "classifier"):
        assert sorted((r.doc_id or 0) for r in rows) == [0, 3, 4, 5, 6, 6, 7]
    if name == "packing":
        assert sum(r.length for r in rows if r.doc_id == 3) == 1 and len({r.doc_id for r in rows}) == 6
    if name in ("decontamination", "chunks"):
        assert {r.doc_id for r in rows} <= {6}
    assert OPERATORS[name](docs.limit(0), spark).count() == 0


@pytest.mark.parametrize("spaced", [True, False])
def test_very_long_texts(spark, spaced):
    rng = random.Random(3)
    long = prose(rng, 250_000) if spaced else "".join(rng.choice("abcdef") for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long[:5000]), (3, None)], "doc_id bigint, text string").repartition(2)
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut_repeats(docs, keep=None).collect()}
    n = len(long)
    assert cut[1] == (n, 5000, 1, hashlib.sha256(long[5000:].encode()).hexdigest()) and cut[2][:3] == (5000, 5000, 1)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {1: (n, len(model.encode(long, add_special_tokens=False).ids)), 2: (5000, len(model.encode(long[:5000], add_special_tokens=False).ids)), 3: (0, 0)}
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = sorted((r.doc_id, r.start, r.length) for r in pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect())
    assert sum(m for d, _, m in pieces if d == 1) == len(words.encode(long, add_special_tokens=False).ids) + 1


def test_chunk_borders_by_definition():
    gear = [int(x) for x in chunk_dedup._GEAR]
    rng = random.Random(4)
    for n in (0, 1, 15, 40, 3000):
        text = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        h = [sum(gear[text[i - j]] << j for j in range(min(chunk_dedup.BITS, i + 1))) % 65536 for i in range(n)]
        w = chunk_dedup.REACH
        peaks = [i + 1 for i in range(n) if h[i] > max(h[max(0, i - w) : i], default=0) and h[i] >= max(h[i + 1 : i + 1 + w], default=0)]
        want = sorted({e for e in [*peaks, n] if e >= min(n, w) and e})
        assert chunk_dedup.borders(text).tolist() == want


def test_roles_are_those_of_the_best_of_all_paths():
    rng = np.random.default_rng(6)
    model = chat.Model(rng.integers(0, 50, 4), rng.integers(0, 50, (4, 4)), np.full(4, 40), np.full(4, 120), rng.integers(1, 50, (4, 6)))
    block = pa.table({"turn": [0, 1], "role": ["user", ""], "text": ["User: x\ny?\nBot: z", "- a\nb"]})
    turns = chat.Turns(block, 0, 2)
    found = chat._best(turns.steps(model, True), -1, -1)
    emission = model.emission(turns.seen)
    moves = [model.start, model.within, model.within, model.between, model.within]

    def score(path):
        total = moves[0][path[0]] + emission[0][path[0]]
        for i in range(1, 5):
            total += moves[i][path[i - 1], path[i]] + emission[i][path[i]]
        return total

    best = max(itertools.product(range(chat.S), repeat=5), key=score)
    assert abs(score(found) - score(best)) < 1e-9


def test_small_and_large_groups_are_judged_together(spark):
    """A group below LEAST is judged by its language, and what stands out in either goes."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 120), "en", "large") for i in range(LEAST * 4)] + [(1000 + i, prose(rng, 120), "en", "small") for i in range(5)]
    odd = " ".join(["####$$$$%%%%"] * 60 + [prose(rng, 60)])
    rows += [(2000, odd, "en", "large"), (2001, odd, "en", "small"), (2002, odd, "xx", None), (2003, "too short", "en", "large")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[2000][1] and not got[2001][1] and got[2003] == (True, False)
    clean = [i for i in got if i < 2000]
    assert sum(got[i][1] for i in clean) >= 0.99 * len(clean)


def test_edited_benchmark_copies(spark):
    """Recall on copies of which a tenth or a fifth of the words were changed: nine tenths and more."""
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(20, 60))) for i in range(40)]
    docs, n = [], 0
    for i, text in items:
        for share in (0.0, 0.1, 0.2):
            words = text.split()
            for at in rng.sample(range(len(words)), int(len(words) * share)):
                words[at] = prose(rng, 1)
            docs.append((n, f"{prose(rng, 80)} {' '.join(words)} {prose(rng, 80)}"))
            n += 1
    docs += [(n + i, prose(rng, 200)) for i in range(40)]
    found = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for k in range(3):
        assert sum((3 * i + k, i) in found for i, _ in items) >= 36, k
    assert not any(d >= n for d, _ in found)
