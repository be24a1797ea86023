import random

import pytest

from retroscope.llm import _common, minhash_dedup
from retroscope.llm.minhash_dedup import near_duplicates


def sets_of(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    return out


def brute(ids, texts):
    """Smallest id reachable over links of similarity 0.75 or more, of all pairs."""
    sets, top = sets_of(texts), list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {ids[i]: (len(sets[i]), ids[find(i)], find(i) == i) for i in range(len(texts))}


def corpus(seed):
    """Chains whose ends are not linked, stars of near copies, exact copies, and texts that stand alone."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    chain = [[word() for _ in range(60)]]
    for _ in range(40):
        chain.append([*chain[-1][3:], *(word() for _ in range(3))])
    base = [word() for _ in range(80)]
    star = []
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        star.append(copy)
    alone = [[word() for _ in range(rng.randint(1, 30))] for _ in range(30)]
    texts = [" ".join(t) for t in [*chain, *star, *alone]]
    texts += [texts[0].upper(), texts[50], texts[50], "", None, "one two", "One  TWO", "  \t\n "]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, block, whole", [(1, 2048, 1000), (2, 7, 3), (3, 3, 1)])
def test_equals_all_pairs(spark, docs_of, monkeypatch, seed, block, whole):
    """Also with blocks so small that chains are cut in many, and with nearly every node a hub."""
    monkeypatch.setattr(minhash_dedup, "LINK_BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", block)
    monkeypatch.setattr(_common, "WHOLE", whole)
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_of(list(enumerate(texts))).repartition(3)).collect()}
    assert got == brute(list(range(len(texts))), texts)


def test_nulls_repeated_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "x", 1), (3, "quite another text of more than five words", "y", 2), (None, text, "z", 3), (7, text + " end", None, None), (9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component string, _tile int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (None, None, True), (7, 3, False), (9, 9, True)], key=str)


def test_components_of_hubs(spark):
    edges = [(100, i) for i in range(1, 40)] + [(200, i) for i in range(201, 230)] + [(229, 100), (300, 301), (302, 301)]
    got = dict(_common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {n: 1 for n in [*range(1, 40), 100, *range(200, 230)]} | {300: 300, 301: 300, 302: 300}
