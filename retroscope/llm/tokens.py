"""Token ids and counts by the public tokenizer files, in batches of about equal bytes.

A text is cut where white space follows something else. No token or rule of the tokenizers used here
reaches over such a place, so the pieces' tokens in a row are the text's tokens; a piece that a worker has
met before is not encoded again. New pieces of a batch are encoded in one call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import bytes_of

#: Unicode's White_Space, which is the \s of the tokenizers' patterns (and not quite that of Python's).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Text bytes of a batch; pieces and their length that a worker remembers; new pieces encoded as one text.
BATCH_BYTES, REMEMBERED, SHORT, TOGETHER = 1 << 20, 1_000_000, 64, 256

#: Characters that Python's split() takes for white space and the tokenizers don't.
_NO_SPACE = re.compile("[\x1c-\x1f]")

_MODELS: dict[str, tuple] = {}


def _model(path: str) -> tuple[Callable[[list[str]], list], dict, bool, Callable | None]:
    """A tokenizer file's encoder, the worker's memory of pieces, whether white space has no tokens, and the
    encoder with places."""
    if path not in _MODELS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _MODELS[path] = (lambda texts: model.encode(texts, num_threads=1)), {}, False, None
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            alone, spaced, blank, blanks = encode(["a", "\n \ta", " ", "\u2003\x85"])
            _MODELS[path] = encode, {}, alone == spaced and not blank and not blanks, lambda texts: model.encode_batch(texts, add_special_tokens=False)
    return _MODELS[path]


def _apart(pieces: list[str], path: str) -> Iterator[list[int]]:
    """The ids of each piece, where white space has no tokens: encoded together, told apart by their places."""
    lines = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
    for line, found in zip(lines, _MODELS[path][3]([" ".join(x) for x in lines]), strict=True):
        starts = np.cumsum([0, *(len(p) + 1 for p in line)])
        at = np.searchsorted([a for a, _ in found.offsets], starts).tolist()
        ids = found.ids
        yield from (ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def encoded(texts: list[str], path: str, kind: Callable[[list[int]], object]) -> list[list]:
    """For each text the encoded pieces in a row, each as kind(ids)."""
    encode, memory, bare, _ = _model(path)
    memory = memory.setdefault(kind, {})
    if path.endswith(".model"):  # sentencepiece joins words over white space, so its texts stay whole
        parts = [[t] for t in texts]
    elif bare:
        parts = [t.split() if not _NO_SPACE.search(t) else _PIECE.findall(t) for t in texts]
    else:
        parts = [_PIECE.findall(t) for t in texts]
    found = [list(map(memory.get, part)) for part in parts]
    open_texts = [i for i, ids in enumerate(found) if None in ids]
    if open_texts:
        new = list({p for i in open_texts for p, ids in zip(parts[i], found[i], strict=True) if ids is None})
        own = dict(zip(new, map(kind, _apart(new, path) if bare else encode(new)), strict=True))
        for i in open_texts:
            found[i] = [own[p] if ids is None else ids for p, ids in zip(parts[i], found[i], strict=True)]
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
        memory.update((p, v) for p, v in own.items() if len(p) <= SHORT)
    return found


def by_bytes(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows that hold about `most` bytes of text, null as empty."""
    texts = batch.column(column)
    ends = np.cumsum(pc.binary_length(bytes_of(texts)).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def _counts(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in by_bytes(batch, "text"):
                tokens = [sum(x) for x in encoded(texts, path, len)]
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    return of


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text).

    path: a tokenizer file (.json: tokenizers, .model: sentencepiece), the same on every machine. Null and
    empty texts have no tokens; repeated rows are counted each; a null doc_id stays null; other columns are
    ignored; an empty table gives an empty table. Nothing is shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(path), COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
