"""Concatenate and cut: token ids of all documents in a row, cut into windows of one length.

Pass 1 encodes each partition and stores its ids, with the place of each document in its partition. The
sums of the partitions (one number each) give, as prefix sums, every partition's place in the whole. Pass 2
cuts each document at the windows' borders; only the last window of all is not full. No row is shuffled.
`sequences` puts windows together where they lie and moves nothing but the parts of windows that cross a
border between partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import store
from retroscope.llm.tokens import by_bytes, encoded

WINDOW, END_ID = 2048, 1

ENCODED = "doc_id bigint, ids binary, n bigint, part int, at bigint"


def _small(ids: list[int]) -> bytes:
    return np.asarray(ids, np.uint16).tobytes()


def _encode(path: str, end_id: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        end = _small([end_id])
        for batch in batches:
            for first, texts in by_bytes(batch, "text"):
                ids = [b"".join(x) + end for x in encoded(texts, path, _small)]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                places = at + np.concatenate(([0], np.cumsum(n)[:-1]))
                at += int(n.sum())
                columns = [batch.column("doc_id").slice(first, len(texts)), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(n.size, part, np.int32)), pa.array(places)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n", "part", "at"])

    return of


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _cut(base: dict[int, int], window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("ids"), 0
            docs, n = batch.column("doc_id"), batch.column("n").to_numpy()
            place = batch.column("at").to_numpy() + np.array([base[p] for p in batch.column("part").to_pylist()], np.int64)
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 400_000, side="right")) + at)
                p, m = place[at:end], n[at:end]
                count = (p + m - 1) // window - p // window + 1
                row = np.repeat(np.arange(end - at), count)
                k = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
                sequence = p[row] // window + k
                start = np.maximum(sequence * window - p[row], 0)
                stop = np.minimum((sequence + 1) * window - p[row], m[row])
                wide = [np.frombuffer(ids[at + i].as_py(), np.uint16).astype("<u4") for i in range(end - at)]
                bodies = [wide[i][a:b].tobytes() for i, a, b in zip(row, start, stop, strict=True)]
                columns = [docs.take(pa.array(at + row)), pa.array(start), pa.array(stop - start), pa.array(bodies, pa.binary()), pa.array(m[row]), pa.array(sequence), pa.array(p[row] + start - sequence * window)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                at = end

    return of


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of `window` tokens: one row for each piece of a document.

    doc_id, start (the document's tokens before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens (with the end id), sequence_id, offset. Each text ends with end_id; null and empty texts are
    that id alone; repeated rows are packed each; a null doc_id stays null; other columns are ignored; an
    empty table gives an empty table. The tokenizer's ids must be below 65,536.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = store(docs.mapInArrow(_encode(path, end_id), ENCODED), "tokens")
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base = dict(zip((p for p, _ in totals), np.concatenate(([0], np.cumsum([n for _, n in totals])[:-1])).astype(int).tolist() if totals else [], strict=True))
    return rows.mapInArrow(_cut(base, window), PIECES)


SEQUENCES = "sequence_id bigint, offset bigint, ids binary"


def _together(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        sequence, offset = None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([sequence], pa.int64()), pa.array([offset], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["sequence_id", "offset", "ids"])

        for batch in batches:
            for s, o, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "ids")), strict=True):
                if s != sequence or o != offset + sum(map(len, held)) // 4:
                    if held:
                        yield row()
                    held, sequence, offset = [], s, o
                held.append(ids)
        if held:
            yield row()

    return of


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, ids: the windows of `pack` as whole sequences (the last one may be shorter)."""
    parts = store(pieces.mapInArrow(_together(window), SEQUENCES), "windows")
    whole = F.length("ids") == 4 * window
    crossing = parts.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = crossing.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return parts.where(whole).select("sequence_id", "ids").unionByName(joined)
