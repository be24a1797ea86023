"""The n-gram join against all pairs, its trie against all pairs of random sets, and awkward rows."""

import random

import numpy as np
import pytest

from retroscope.llm import _common, ngram_join
from retroscope.llm.ngram_join import explore, parity_bits, similar_sets, spare


def grams(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def classes(ids, sets, percent):
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {ids[i]: (len(s), ids[find(i)]) for i, s in enumerate(sets)}


def corpus(seed):
    """Chains, stars around one text, texts at the very edge of the bound, short texts, copies and passages in many texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    chain = [[word() for _ in range(100)]]
    for _ in range(30):
        chain.append([*chain[-1][2:], *(word() for _ in range(2))])
    base = [word() for _ in range(120)]
    star = []
    for _ in range(30):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        star.append(copy)
    edge = []
    for n in range(8, 40):  # one word fewer, one more, one changed at the end
        t = [word() for _ in range(n)]
        edge += [t, t[:-1], [*t, word()], [*t[:-1], word()]]
    passage = [word() for _ in range(60)]
    shared = [[*passage, *(word() for _ in range(rng.randint(1, 60)))] for _ in range(30)]
    texts = [" ".join(t) for t in [*chain, *star, *edge, *shared]]
    texts += [texts[0].upper(), texts[40], texts[40], "", None, "one two", "One  TWO", "one two three", "one", "  \t\n "]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, words, percent, block, whole", [(1, 3, 90, 2048, 1000), (2, 3, 90, 5, 3), (3, 2, 75, 2048, 1), (4, 3, 60, 6, 1000)])
def test_equals_all_pairs(spark, docs_of, monkeypatch, seed, words, percent, block, whole):
    """Also with blocks so small that most groups are cut, and with nearly every n-gram a hot one."""
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(_common, "WHOLE", whole)
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_sets(docs_of(list(enumerate(texts))).repartition(3), words, percent).collect()}
    assert got == classes(list(range(len(texts))), [grams(t, words) for t in texts], percent)


@pytest.mark.parametrize("seed", range(12))
def test_trie_finds_all_classes(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(200), rng.randint(1, 60)) for _ in range(6)]
    sets = []
    for _ in range(80):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s ^= {rng.randrange(200)}
        sets.append(s or {1})
    sets += sets[:5]  # equal sets
    percent = rng.choice([60, 75, 90, 95])
    top = {i: i for i in range(len(sets))}
    for member, first in explore([np.array(sorted(s), np.uint64) for s in sets], percent):
        top[member] = first
    want = classes(list(range(len(sets))), sets, percent)
    same = lambda f: {frozenset(i for i in range(len(sets)) if f(i) == f(j)) for j in range(len(sets))}
    assert same(lambda i: top[i]) == same(lambda i: want[i][1])


def test_trie_leaves_subtrees_by_bound():
    """A look-up reads few of the labels below the root when all but one set are far away."""
    rng = random.Random(5)
    sets = [np.array(sorted(rng.sample(range(10**6), 300)), np.uint64) for _ in range(50)]
    near = sets[0].copy()
    near[0] += np.uint64(1) if near[0] + 1 != near[1] else np.uint64(0)
    trie = ngram_join.Trie([*sets, near])
    assert trie.linked(0, 90, np.array([i != trie.place[0] for i in range(51)])).tolist() == [50]
    shared = (trie.hi - trie.lo) > 1
    assert (trie.stop - trie.begin)[shared].max() >= 250  # what the near sets share is one path


@pytest.mark.parametrize("seed", range(5))
def test_bitmaps_differ_in_no_more_bits_than_sets_in_elements(seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[40:], rng.integers(0, 2**63, 30, dtype=np.uint64))))
    x, y = (np.frombuffer(parity_bits(s), np.uint8) for s in (a, b))
    assert x.size == y.size and np.bitwise_count(x ^ y).sum() <= np.setxor1d(a, b).size
    folded = np.frombuffer(parity_bits(a[:900]), np.uint8)
    half = np.bitwise_xor.reduce(np.frombuffer(parity_bits(a[:900]), np.uint8).reshape(-1, folded.size))
    assert (half == folded).all()


def test_spare_is_what_a_linked_set_may_lack():
    for n in range(1, 200):
        least = min(o for o in range(n + 1) if 100 * o >= 90 * n)
        assert spare(n) == n - least


def test_nulls_repeated_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "x", 1), (3, "quite another text of more than five words", "y", 2), (None, text, "z", 3), (7, text + " end", None, None), (9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component string, token int")
    got = sorted(((r.doc_id, r.component_id) for r in similar_sets(docs).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, None), (7, 3), (9, 9)], key=str)
    assert similar_sets(docs.limit(0)).count() == 0


def test_repeated_ids_with_texts_of_any_length(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b = [word() for _ in range(80)], [word() for _ in range(300)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, "short"), (2, " ".join([*a[1:], word()])), (3, " ".join([*b[3:], word()])), (4, " ".join(a[:40]))]
    got = {r.doc_id: r.component_id for r in similar_sets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = [str(rng.randrange(10**6)) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-2000])), (3, " ".join(long[:50_000])), (4, "x" * 500_000)]
    got = {r.doc_id: r.component_id for r in similar_sets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
