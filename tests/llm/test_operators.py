"""The text operators against brute force, on small inputs with the awkward cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from retroscope.llm import chat, chunk_dedup, classifier, decontamination, html_text
from retroscope.llm.minhash_dedup import near_duplicates
from retroscope.llm.quality_rules import quality_rules

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnorstuü") for _ in range(rng.randint(2, 8))) for _ in range(n))


# near duplicates


def shingles(text):
    words = SPACE.findall((text or "").encode().lower())
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark, docs_of):
    rng = random.Random(1)
    texts = [None, "", " \n", "One two", "one  TWO", "one two three"]
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz"
            texts.append(rng.choice([" ", "\n"]).join(w).upper().replace("Ü", "ü"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_of(list(enumerate(texts))).repartition(4)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(groups(texts))}


def test_near_duplicates_without_rows(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


# quality rules


def test_word_statistics(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c a b c a b", "x y z\nx y z\n\n x\nx y z", "#$ |<a>", prose(rng, 70), (prose(rng, 30) + "\n") * 3, "é ü 😀 a\x0bb"]
    texts += [prose(rng, 60) + "\n" + "w1 w2 w3 " * 30 for _ in range(3)]
    rows = [(i, t, rng.choice(["en", None]), "s", "clash") for i, t in enumerate(texts)]
    for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words string")).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(80, 120)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join("#$%&" * 3 + w for w in prose(rng, 90).split()), "en", "s") for i in range(3)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(3))
    assert sum(got[i] for i in range(300)) == 300


# quality classifier


def test_classifier_on_held_out_rows(spark, docs_of):
    rng = random.Random(4)
    good = lambda: prose(rng, 60)
    bad = lambda: " ".join(rng.choice(["click", "buy", "now!!", "win"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(None, None), (401, ""), (402, None)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(400)] + [(402, None, 1)], "doc_id bigint, quality int, toxic int")
    model = classifier.fit(docs, labels)
    got = classifier.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert classifier.score(docs_of([]), classifier.fit(docs_of([]), labels.limit(0))).count() == 0


# decontamination


def slow_score(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (1 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_contaminated_equals_full_alignment(spark, docs_of):
    rng = random.Random(5)
    items = [prose(rng, rng.randint(12, 40)) for _ in range(8)] + ["a b", "", None]
    texts = [None, "", "a b"]
    for _ in range(40):
        t = prose(rng, rng.randint(0, 80)).split()
        copy = rng.choice(items[:8]).split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            copy[rng.randrange(len(copy))] = rng.choice(["edited", "a", "bb cc"])
        texts.append(" ".join(t + copy[: rng.choice([6, 99])] + prose(rng, 20).split()).title())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = docs_of(list(enumerate(texts)))
    W = decontamination.words_of
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = W((x or "").encode()), W((t or "").encode())
            runs = {tuple(a[k : k + 6]) for k in range(max(1, len(a) - 5))}
            if a and (s := slow_score(a, b)) >= 0.5 * len(a) and any(tuple(b[k : k + len(r)]) == r for r in runs for k in range(len(b))):
                want[d, i] = s
    for words in (10_000, 60):
        got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench, block_words=words).collect()}
        assert {k: got.get(k) for k in want} == want
        assert all(slow_score(W((items[i] or "").encode()), W((texts[d] or "").encode())) >= 0.5 * len(W(items[i].encode())) for d, i in got)
    assert decontamination.contaminated(docs_of([]), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_edited_copies_are_all_found(spark, docs_of):
    rng = random.Random(15)
    items = [prose(rng, n) for n in (4, 5, 7, 12, 17, 17, 27, 48, 59)]
    texts = []
    for item in items:
        for every in (2, 3, 4, 5, 6):  # each such word replaced, left out or with one more before it
            for edit in (["zz"], [], None):
                words = item.split()
                copy = [y for k, x in enumerate(words) for y in ([x] if k % every != every - 1 else ["zz", x] if edit is None else edit)]
                texts.append(" ".join([prose(rng, rng.randint(0, 70)), *copy, prose(rng, 30)]))
        for _ in range(10):
            words = item.split()
            for k in rng.sample(range(len(words)), len(words) // 4):
                words[k] = rng.choice(words)
            texts.append(" ".join([prose(rng, 9), *words, prose(rng, 9)]))
    W = decontamination.words_of
    cut = [W(x.encode()) for x in items]
    want = {(d, i): s for d, t in enumerate(texts) for i, a in enumerate(cut) if (s := slow_score(a, W(t.encode()))) >= 0.5 * len(a)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs_of(list(enumerate(texts))), bench).collect()}
    assert len(want) > 90 and got == want


# chunk dedup


def test_borders_follow_content():
    rng = random.Random(6)
    text = prose(rng, 4000).encode()
    a, b = set(chunk_dedup.borders(text)), chunk_dedup.borders(b"inserted words " + text)
    moved = {int(x) - 15 for x in b}
    assert len(a ^ moved) <= 6
    assert chunk_dedup.borders(b"").size == 0
    assert np.diff(chunk_dedup.borders(b"a" * 20_000), prepend=0).max() <= chunk_dedup.LONGEST


def test_long_texts_have_the_borders_of_one_piece(monkeypatch):
    text = prose(random.Random(7), 3000).encode()
    whole = chunk_dedup.borders(text).tolist()
    monkeypatch.setattr(chunk_dedup, "PIECE", 777)
    assert chunk_dedup.borders(text).tolist() == whole


def test_copied_spans_equal_brute_force(spark, docs_of):
    rng = random.Random(8)
    shared = [prose(rng, 55) for _ in range(4)]
    texts = [None, "", "short"] + [prose(rng, 40) + " " + rng.choice(shared) + " " + prose(rng, 30) for _ in range(30)] + [prose(rng, 90) for _ in range(10)]
    texts += [texts[5], shared[0] + " " + shared[0]]
    first, want = {}, defaultdict(list)
    for i, t in enumerate(texts):
        raw, at = (t or "").encode(), 0
        for end in chunk_dedup.borders(raw).tolist():
            piece = raw[at:end]
            if piece in first:
                if want[i] and want[i][-1][1] == at:
                    want[i][-1][1] = end
                else:
                    want[i].append([at, end])
            first.setdefault(piece, i)
            at = end
    want = {(i, a, b) for i, runs in want.items() for a, b in runs if b - a >= chunk_dedup.LEAST}
    docs = docs_of(list(enumerate(texts))).repartition(3)
    assert {(r.doc_id, r.start, r.end) for r in chunk_dedup.copied_spans(docs).collect()} == want
    cut = {r.doc_id: r for r in chunk_dedup.cut_copies(docs).collect()}
    assert {i: r.n_removed for i, r in cut.items()} == {i: sum(b - a for k, a, b in want if k == i) for i in range(len(texts))}
    holders = {i for i, t in enumerate(texts) if t and any(s in t for s in shared)}
    assert len({i for i, *_ in want} & holders) >= len(holders) - 4
    assert not {i for i, *_ in want} - holders - {len(texts) - 2}


def test_copies_of_short_texts_go(docs_of):
    rng = random.Random(16)
    short, two, long = "a short text", prose(rng, 9), prose(rng, 60)
    assert chunk_dedup.borders(two.encode()).size > 1
    texts = [short, two, long, short, two, long, short + " of its own", two + " " + prose(rng, 60)]
    docs = docs_of(list(enumerate(texts))).repartition(3)
    whole = {(i, 0, len(texts[i].encode())) for i in (3, 4, 5)}
    assert {(r.doc_id, r.start, r.end) for r in chunk_dedup.copied_spans(docs).collect()} == whole
    assert {r.doc_id: r.n_removed for r in chunk_dedup.cut_copies(docs).collect() if r.n_removed} == {i: end for i, _, end in whole}


# HTML


PAGES = [
    ("<p>One<p>two <b>bo</b>ld<br>line", "One\n\ntwo bold\nline"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol></ul>end", "- a\n- b\n  1. x\n  2. y\n\nend"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"),
    ("<head><title>t</title></head><script>if (a<b) '</p>'</script>A &amp; B<!-- c --><span hidden>x</span><i style='display:none'>y</i>", "A & B"),
    ("<pre>  a\n   b</pre>", "  a\n   b"),
    ("a < b <", "a < b <"),
    ("", ""),
    ("<div>x</div><div>y</div></section></b>z", "x\ny\nz"),
    ("<select><option>1<option>2</select>", "1\n2"),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_visible_text(source, text):
    assert html_text.visible_text(source) == text


def test_deep_and_broken_pages(spark):
    assert html_text.visible_text("<div>" * 3000 + "x" + "<table><tr><td>" * 2000 + "y").replace("\n", " ").split() == ["x", "y"]
    rows = [(1, None, None, "x"), (None, "u", "", None), (2, "v", "<p>a", "y"), (2, "v", "<p>a", "y")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, None), (None, ""), (2, "a"), (2, "a")]


@pytest.mark.parametrize(
    "source, text",
    [
        ("<table><thead><th>Name<th>Age</thead><tbody><tr><td>Bo<td>7</table>", "Name  Age\nBo    7"),
        ("<table><tbody><td>x</td></tbody></table>", "x"),
        ("<table><tbody>loose<p>text</p><tr><td>a<td>b</table>", "loose\n\ntext\n\na  b"),
        ("<table><tbody><form><tr><td>a<td>b</tr><tr><td>c<td>d</tr></form></tbody></table>", "a  b\nc  d"),
        ("<table><form><td>a<td>b</form><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tbody><div>above<tr><td>a<td>b</table>", "above\na  b"),
        ("<table><tbody><template><tr><td>no</td></tr></template><tr><td>y</table>", "y"),
    ],
)
def test_all_text_of_tables_is_shown(source, text):
    assert html_text.visible_text(source) == text


# chat


def conversation(rng, n):
    roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * n
    return [(r, prose(rng, rng.randint(5, 30)) + ("?" if r == "user" else ".\n" + prose(rng, 9))) for r in roles[:n]]


def test_recorded_roles_come_back_and_lost_ones_are_found(spark):
    rng, rows = random.Random(9), []
    for c in range(40):
        for t, (role, text) in enumerate(conversation(rng, 8)):
            rows.append((c, t, None if c % 4 == 0 and t > 1 else {"user": "Human"}.get(role, role), text, role))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part string")
    got = {(r.conv_id, r.turn): r for r in chat.parse_transcripts(df).collect()}
    assert len(got) == len(rows)
    assert all(got[c, t].role == truth and got[c, t].text == text for c, t, _, text, truth in rows)
    long = {(r.conv_id, r.turn): r.role for r in chat.parse_transcripts(df, segment=2).collect()}  # decoded in segments
    assert long == {k: r.role for k, r in got.items()}


def test_segments_give_a_best_path():
    """Of several best paths, segments may give another one than a single pass: their scores are equal."""
    rng = np.random.default_rng(10)
    n = chat.S
    model = chat.Model(rng.integers(0, 50, 4), rng.integers(0, 50, (4, 4)), np.full(4, 40), np.full(4, 120), rng.integers(1, 50, (4, 6)))
    rows = [(t, rng.choice(["user", "bot", ""]), "User: x\ny?\nAssistant: z" if t % 5 == 0 else "some\nlines") for t in range(90)]
    block = pa.table({"turn": [r[0] for r in rows], "role": [str(r[1]) for r in rows], "text": [r[2] for r in rows]})
    cuts = list(range(0, 91, 7)) + [90]
    parts = [chat.Turns(block, a, b).steps(model, a == 0) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    steps = [s for part in parts for s in part]

    def score(path):
        before, total = 0, 0.0
        for step, state in zip(steps, path, strict=True):
            total, before = total + step[before, state], state
        return total

    totals = []
    for part in parts:
        total = part[0]
        for step in part[1:]:
            total = chat._product(total, step)
        totals.append(total)
    borders = chat._best(totals, -1, -1)
    handed = [x for part, a, b in zip(parts, [-1, *borders[:-1]], borders, strict=True) for x in chat._best(part, a, b)]
    assert len(handed) == len(steps) and max(handed) < n
    assert abs(score(handed) - score(chat._best(steps, -1, -1))) < 1e-9


def test_transcripts_in_one_row(spark):
    text = "System: be brief\nUser: what is it?\nmore\n### Assistant: this\n- a\n<|im_start|>user\nthanks<|im_end|>"
    known = [(9, t, r, x) for t, (r, x) in enumerate([("user", "a?"), ("assistant", "b.")] * 3)]
    rows = [(1, 0, None, text), (2, None, "user", None), (None, 0, "user", "x"), (2, None, "user", None), *known]
    got = chat.canonical(chat.parse_transcripts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).where("conv_id < 9").orderBy("conv_id", "turn", "part").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "system", "be brief"), (1, "user", "what is it?\nmore"), (1, "assistant", "this\n- a"), (1, "user", "thanks"), (2, "user", "")]
    assert got[0].rendered == "<|system|>\nbe brief\n<|end|>\n"
    assert chat.parse_transcripts(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
