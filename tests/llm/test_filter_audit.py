"""The audit against playing every order through, document by document."""

import random
import re
from itertools import permutations

import pytest

from retroscope.llm.filter_audit import audit, mask_counts, masked, parity_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, mask int, part string, digest string"


def failed(docs):
    out = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        out.append((i, lang or "", {k for k, v in f.items() if v}))
    return out


def played(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[c] == 1} for c in (0, 1))
    rows, out, shapley = failed(docs), {}, {}
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                past = [r for r in own if letter in r[1] and r[1] & set(order[: step - 1])]
                left = [r for r in left if letter not in r[1]]
                out[part, order, step] = [len(left), len(gone), len(past), sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    for i in range(120):
        n = rng.choice([0, 3, 150, 199, 200, 201, 260])
        pool = ["word%d" % rng.randrange(9999) for _ in range(n)] if rng.random() < 0.6 else ["the", "same", "Few", "WORDS"] * (n // 4)
        text = " ".join(pool) + rng.choice(["", " # ", "|", " ÄÖÜ", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, " wide"])
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(200 + k, docs[rng.randrange(120)][1], rng.choice(["en", "fr"])) for k in range(60)]
    docs += [(5, docs[5][1], docs[5][2]), (None, docs[6][1], "en"), (None, None, None), (300, None, "xx"), (301, "", "xx"), (302, "one " * 30_000, "en")]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 302, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_orders_played(spark, seed):
    docs, labels = corpus(seed)
    a = spark.createDataFrame([(*d, 1, "p", "q") for d in docs], SCHEMA).repartition(4)
    b = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = audit(a, b).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(got) and got == played(docs, labels)


def test_parity_sums_turn_back_into_counts(spark):
    docs, labels = corpus(3)
    masks = masked(spark.createDataFrame([(*d, 1, "p", "q") for d in docs], SCHEMA))
    cells = mask_counts(parity_sums(masks, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    got = {(r.part, m): n for r in cells.where("label = 'all'").collect() for m, n in enumerate(r.cells) if n}
    want = {}
    for _, part, f in failed(docs):
        key = part, sum(1 << "ABCDE".index(x) for x in f)
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = audit(spark.createDataFrame([(1, "A", None)], "doc_id bigint, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120
