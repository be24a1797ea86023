import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retroscope.llm.packing import pack, sequences
from retroscope.llm.tokens import count_tokens

ODD = ["", None, " ", "\n\n", "a", "  two  spaces ", "tab\tand\x0bvt\x0c \x85 \xa0x", "it's we'll 'S I'M", "?\x1c!\x1d ?", "12345 3.14", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "é ́x Å İ ΣΑΣ ς", "日本語のテキスト" * 30, "x" * 5000, "!?" * 3000, " em　wide​zw", "emoji 👩‍👩‍👧 done", "a\n \nb", "a \n b", "a\r\nb  \n\n  c"]


def texts():
    rng = random.Random(5)
    parts = [o for o in ODD if o] + ["the", "The", "re's", " ", "\n", "tion", " ", "."]
    return ODD + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(docs_of, name):
    path, rows = public_tokenizers.path(name), texts()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [model.encode(t or "") for t in rows]
    else:
        model = Tokenizer.from_file(path)
        ids = [model.encode(t or "", add_special_tokens=False).ids for t in rows]
    got = {r.doc_id: r for r in count_tokens(docs_of(list(enumerate(rows))).repartition(3), path).collect()}
    for i, (t, x) in enumerate(zip(rows, ids, strict=True)):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(x), len(x) > 512), repr(t)


@pytest.mark.parametrize("window", [7, 2048])
def test_packing_round_trip(docs_of, window):
    path, rows = public_tokenizers.path("word_bpe_49k.json"), texts()
    model = Tokenizer.from_file(path)
    want = {i: model.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(rows)}
    pieces = pack(docs_of(list(enumerate(rows))).repartition(4), path, window)
    got = pieces.collect()
    for i, ids in want.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == ids
        assert own[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
        assert all(r.doc_tokens == len(ids) and zlib.crc32(r.ids) >= 0 for r in own)
    total = sum(map(len, want.values()))
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(fill) == list(range(-(-total // window))) and all(v == window for k, v in fill.items() if k + 1 < len(fill))
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(pieces, window).collect()}
    joined = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        joined.setdefault(r.sequence_id, []).extend(np.frombuffer(r.ids, "<u4"))
    assert {k: list(v) for k, v in whole.items()} == joined


def test_nulls_clashes_and_empty(spark):
    schema = "doc_id bigint, text string, ids int, part string, n string"
    rows = [(None, "a b", 1, None, "x"), (1, None, None, "p", None), (1, None, None, "p", None)]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sorted((r.doc_id or 0, r.length) for r in pack(spark.createDataFrame(rows, schema), path).collect()) == [(0, 3), (1, 1), (1, 1)]
    assert pack(spark.createDataFrame([], schema), path).count() == 0
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(spark.createDataFrame(rows, schema), path).collect()) == [(0, 2), (1, 0), (1, 0)]
    assert count_tokens(spark.createDataFrame([], schema), path).count() == 0
