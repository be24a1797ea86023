"""Plain replicas of what no SQL says: the classifier's features and its descent, and the verdict of the quality rules."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from retroscope.llm import classifier, quality_rules
from retroscope.llm._common import GOLD, MIX1, MIX2

ONES = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * int(MIX1)) & ONES
    x = ((x ^ (x >> 27)) * int(MIX2)) & ONES
    return x ^ (x >> 31)


def plain_features(text):
    """Bucket and weight: every word has a share of 1, dealt to its n-grams of 3 to 5 bytes with a blank at either end, and to the word."""
    words = text.split()
    seen, copied = set(), 0
    for line in text.split(b"\n"):
        copied += len(line.split()) if line in seen else 0
        seen.add(line)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    total = max(len(words) + same + copied, 1)
    out = defaultdict(float)
    place = lambda h: mixed(h) % (classifier.BUCKETS - 2) + 2
    for w in words:
        ids, padded = [], b" " + w + b" "
        for g in classifier.GRAMS:
            for i in range(len(padded) - g + 1):
                h = g
                for c in padded[i : i + g]:
                    h = (h * int(classifier._BASE) + c + 1) & ONES
                ids.append(place(h))
        ids.append(place(sum(mixed((c + 1 + (k + 1) * int(GOLD)) & ONES) for k, c in enumerate(w)) & ONES))
        for i in ids:
            out[i] += 1 / len(ids) / total
    if same:
        out[classifier.SAME] += same / total
    if copied and words:
        out[classifier.COPY] += copied / total
    return out


def texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    out = []
    for _ in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))]
        lines += rng.choices(lines, k=rng.randint(0, 2))
        out.append("\n".join(lines) + rng.choice(["", " the the", "\t x\n\n"]))
    return [t.encode() for t in [*out, "", " \n ", "a", "a a a\na a a"]]


def test_features_equal_plain_ones():
    some = texts(1)
    got = [defaultdict(float) for _ in some]
    for t, b, w in zip(*classifier.features(some), strict=True):
        got[t][int(b)] += w
    for have, text in zip(got, some, strict=True):
        want = plain_features(text)
        assert have.keys() == want.keys() and all(np.isclose(have[k], want[k]) for k in want)


@pytest.mark.parametrize("epochs", [1, 3])
def test_descent_equals_plain_loops(epochs):
    """Vectors, layer and bias step by step, in plain loops over the same draws."""
    some = texts(2)
    labels = [len(t) % 2 for t in some]
    model = classifier.train(some, labels, epochs, 2.0, 5)
    rows = [plain_features(t) for t in some]
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1.0 / classifier.DIMS, 1.0 / classifier.DIMS, (classifier.BUCKETS, classifier.DIMS))
    layer, bias = np.zeros((2, classifier.DIMS)), np.zeros(2)
    steps, done = epochs * -(-len(rows) // classifier.BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), classifier.BATCH):
            rate, done = 2.0 * (1 - done / steps), done + 1
            pick = order[at : at + classifier.BATCH]
            moved, of_layer, of_bias = {}, np.zeros_like(layer), np.zeros(2)
            for i in pick:
                one = sum((w * vectors[b] for b, w in rows[i].items()), np.zeros(classifier.DIMS))
                p = np.exp(layer @ one + bias)
                g = (p / p.sum() - np.eye(2)[labels[i]]) / len(pick)
                moved[i] = g @ layer
                of_layer += np.outer(g, one)
                of_bias += g
            layer -= rate * of_layer
            bias -= rate * 0.1 * of_bias
            for i, back in moved.items():
                for b, w in rows[i].items():
                    vectors[b] -= rate * w * back
    for text, score in zip(some, model.scores(some), strict=True):
        z = sum(w * (vectors[b] @ (layer[1] - layer[0])) for b, w in plain_features(text).items()) + bias[1] - bias[0]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(grams)
    repeats = len({i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    n, c = max(len(words), 1), max(chars, 1)
    upper = sum(x.isupper() and x.isalpha() for x in text)
    vector = (chars / n, (len(re.findall("[#*$%&|<>]", text)) / c) ** 0.5, ((len(lines) - len(set(lines))) / max(len(lines), 1)) ** 0.5, (repeats / n) ** 0.5, (upper / c) ** 0.5)
    return failed, np.floor(np.array(vector) * quality_rules.UNIT + 0.5)


FLOOR = np.array([quality_rules.FLOORS[k] * quality_rules.UNIT for k in quality_rules.KEYS])


def bin_of(d2):
    return np.minimum(np.floor(np.log2(1 + d2 * 1024) * quality_rules.PER_OCTAVE), quality_rules.BINS - 1).astype(int)


def limit_of(bins, share):
    counts = Counter(bins.tolist())
    so_far = 0
    for b in sorted(counts):
        so_far += counts[b]
        if so_far >= bins.size * share:
            return b


def estimate(x):
    return x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(FLOOR**2)


def away(x, est):
    d = x - est[0]
    return (d * np.linalg.solve(est[1], d.T).T).sum(axis=1)


def low_median(x):
    return np.sort(x, axis=0)[-(-len(x) // 2) - 1]


def settled(groups):
    """Estimates of all groups: steps from two starts until no determinant of any group moves much; the smaller determinant of a group wins."""
    now = {}
    for g, x in groups.items():
        m = low_median(x)
        now[g, 0], now[g, 1] = (m, np.diag((low_median(np.abs(x - m)) * 1.4826) ** 2 + FLOOR**2)), estimate(x)
    log = lambda e: np.linalg.slogdet(e[1])[1] / 2
    for _ in range(quality_rules.STEPS):
        last = now
        now = {}
        for (g, s), est in last.items():
            bins = bin_of(away(groups[g], est))
            now[g, s] = estimate(groups[g][bins <= limit_of(bins, quality_rules.SHARE)])
        if max(abs(log(now[k]) - log(last[k])) for k in now) < quality_rules.SETTLED:
            break
    return {g: min((now[g, s] for s in (0, 1)), key=log) for g in groups}


def test_verdict_equals_numpy_estimates(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(max(1, n)))
    docs = []
    for i in range(420):
        lang, source = ("en", "a") if i % 3 == 0 else ("en", "b") if i % 3 == 1 else rng.choice([("de", "a"), ("de", "c"), ("fr", "z"), (None, None)])
        size = 14 if i % 41 == 0 else 5
        words = [word(int(rng.gauss(size, 2))) for _ in range(rng.randint(30, 200))]
        if i % 23 == 0:
            words = [w + rng.choice(["#", "$$", "%"]) for w in words]
        if i % 29 == 0:
            words = [w.upper() for w in words]
        text = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        text += ("\n" + text.split("\n")[0]) * (i % 5 == 0) * rng.randint(1, 6)
        docs.append((i, text, lang, source))
    found = {i: statistics(t) for i, t, *_ in docs}
    passed = [(i, lang or "", source or "") for i, _, lang, source in docs if not found[i][0]]
    sizes, langs = Counter(p[1:] for p in passed), Counter(p[1] for p in passed)
    group = {(a, b): (a, b) if n >= quality_rules.LEAST else a if langs[a] >= quality_rules.LEAST else "all" for (a, b), n in sizes.items()}
    assert len({type(g) for g in group.values()} | {g == "all" for g in group.values()}) == 4  # each width is used
    samples = {g: np.array([found[i][1] for i, a, b in passed if g in ((a, b), a, "all")]) for g in set(group.values())}
    best = settled(samples)
    scale = {g: max((2 ** ((limit_of(bin_of(away(x, best[g])), 0.5) + 1) / quality_rules.PER_OCTAVE) - 1) / 1024 / quality_rules.MEDIAN, 1.0) for g, x in samples.items()}
    want = {i: away(found[i][1][None], best[group[a, b]])[0] / scale[group[a, b]] for i, a, b in passed}
    rows = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()
    kept = 0
    for r in rows:
        assert r.base_failed == found[r.doc_id][0]
        if r.base_failed:
            assert not r.kept and r.distance is None
        else:
            assert np.isclose(r.distance**2, want[r.doc_id], rtol=1e-6) and r.kept == (want[r.doc_id] <= quality_rules.CUTOFF)
            kept += r.kept
    assert 0.5 * len(rows) < kept < len(want)  # some are outliers
