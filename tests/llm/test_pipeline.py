"""The stages of the pipeline on a small folder, each against what its own input says."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from retroscope.llm import classifier
from retroscope.llm._common import table
from tests.llm.test_near_duplicates import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The documents of the smallest folder, with planted near copies, shared passages and benchmark passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    good = [d for d in docs if d[1] and len(d[1].split()) > 100][:30]
    passage, planted = prose(55), []
    for i in range(6):
        planted.append(f"{prose(120)} {passage} {prose(80)}")
    planted += [f"{good[i][1]} {items[i]}" for i in range(4)]
    planted += [good[9][1] + " more", good[9][1].replace(".", ";", 1), "", None]
    rows = docs + [(10_000 + i, t, "en", None if i % 3 else "web", len(t or "")) for i, t in enumerate(planted)]
    out = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What goes into each stage and comes out of it: lists of rows by the stage's name."""
    docs, out = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect(), after.columns
        docs = after
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    assert all(stages[name][2] == COLUMNS for name, _ in corpus_pipeline.STAGES[:-1])


def test_rejected_documents_go(spark, folder, stages):
    before, after, _ = stages["quality_classifier"]
    docs = table(spark, folder, "documents")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, folder, "labels")))
    good = Counter(r.doc_id for r in scored.collect() if r.score >= 0.5)
    assert Counter(r.doc_id for r in after) == good
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_duplicates"]
    before = sorted(before, key=lambda r: r.doc_id)
    ids, texts = [r.doc_id for r in before], [r.text for r in before]
    kept = {i for i, (_, _, stays) in components(ids, texts).items() if stays}
    assert sorted(r.doc_id for r in after) == sorted(kept)


def test_repeated_passages_go(stages):
    before, after, _ = stages["suffix_dedup"]
    n = corpus_pipeline.PASSAGE
    texts = {r.doc_id: (r.text or "").encode() for r in before}
    times = Counter(hash(t[i : i + n]) for t in texts.values() for i in range(len(t) - n + 1))
    want = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if times[hash(t[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        if left or not any(gone):
            want[k] = left.decode(errors="ignore"), any(gone)
    assert {r.doc_id: r.text or "" for r in after} == {k: t for k, (t, _) in want.items()}
    assert any(cut for _, cut in want.values())
    assert all(r.n_chars == len(r.text) for r in after if want[r.doc_id][1])


def test_no_benchmark_passage_stays(spark, folder, stages):
    before, after, _ = stages["decontamination"]
    squeeze = lambda t: " ".join((t or "").lower().split())
    items = [squeeze(r.text) for r in table(spark, folder, "benchmark").collect() if len((r.text or "").split()) >= 8]
    holds = lambda r: any(i in squeeze(r.text) for i in items)
    assert any(map(holds, before)) and not any(map(holds, after))
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone) < len(before) / 4 and {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_pieces_are_the_documents(stages):
    before, after, _ = stages["packing"]
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in after:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for r in before:
        n = len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
        spans = sorted(pieces[r.doc_id])
        assert [s for s, _ in spans] == [0, *(s + m for s, m in spans[:-1])] and sum(m for _, m in spans) == n


def test_run_gives_the_last_stage(spark, folder, stages):
    want = Counter((r.doc_id, r.start, r.length) for r in stages["packing"][1])
    assert Counter((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "length").collect()) == want


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    table(spark, folder, "labels").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    empty = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
