"""Substring dedup by content-defined chunks: a gear rolling hash finds borders, digests find copies.

A border lies where the gear hash is larger than at all places within REACH before it and not smaller than
within REACH after it. Whether a place is a border depends on the bytes around it alone, so after an
insertion the borders are the old ones again within a few bytes, and equal passages have equal chunks but
for their ends. Chunks of one digest are copies of the first one, by document id and place. Copies are cut
where neighbouring ones add up to LEAST bytes, or are all of a text: other ones are phrases that any two
texts may share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import bytes_of, mix, store

#: Bytes that the gear hash looks back, that a border dominates on either side, and of the longest chunk.
BITS, REACH, LONGEST = 16, 16, 4096
LEAST = 96
PIECE = 1 << 20
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32) >> np.uint32(16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 h + gear[byte] modulo 2^16, which the last BITS bytes decide."""
    h = _GEAR[data].astype(np.uint16)
    # doubling steps: h over 2 w bytes is h over w bytes, and that of the w bytes before, shifted
    for w in (1, 2, 4, 8):
        h[w:] += h[:-w].copy() << np.uint16(w) if h.size > w else 0
    return h


def _ahead(x: np.ndarray, w: int) -> np.ndarray:
    """Maximum of x[i:i + w] for each i; places behind the end count as 0."""
    out, width = x, 1
    while width < w:
        step = min(width, w - width)
        shifted = np.zeros_like(out)
        shifted[: max(0, out.size - step)] = out[step:]
        out, width = np.maximum(out, shifted), width + step
    return out


def borders(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text. No chunk is longer than LONGEST bytes."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    data, found = np.frombuffer(text, np.uint8), []
    for lo in range(0, n, PIECE):
        a, b = max(0, lo - REACH - BITS), min(n, lo + PIECE + REACH)
        h = gear_hashes(data[a:b])
        after = np.zeros_like(h)
        after[:-1] = _ahead(h, REACH)[1:]
        before = np.zeros_like(h)
        before[1:] = _ahead(h[::-1], REACH)[::-1][:-1]
        at = np.flatnonzero((h > before) & (h >= after)) + a + 1
        found.append(at[(at > lo) & (at <= min(n, lo + PIECE))])
    ends = np.unique(np.append(np.concatenate(found), n))
    ends = ends[ends >= min(n, REACH)]
    size = np.diff(ends, prepend=0)
    if size.max() > LONGEST:
        ends = np.unique(np.concatenate([ends, *(np.arange(e - s + LONGEST, e, LONGEST) for e, s in zip(ends[size > LONGEST], size[size > LONGEST], strict=True))]))
    return ends


CHUNKS = "doc_id bigint, _k bigint, start int, end int, digest bigint, last boolean"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        docs, keys = batch.column("doc_id").to_numpy(), batch.column("_k").to_numpy()
        parts, held = [], 0
        for i, text in enumerate(bytes_of(batch.column("text"))):
            text = text.as_py()
            ends = borders(text).astype(np.int32)
            starts = np.concatenate((np.zeros(1, np.int32), ends))[:-1]
            view = memoryview(text)
            digests = np.fromiter(map(digest, map(view.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, ends.size)
            parts.append((np.full(ends.size, docs[i]), np.full(ends.size, keys[i]), starts, ends, digests.view(np.int64), ends == len(text)))
            held += ends.size
            if held > 50_000 or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=_names(CHUNKS))
                parts, held = [], 0


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


RUNS = "doc_id bigint, _k bigint, start int, end int, sources array<bigint>"


def _runs(least: int):
    """Runs of neighbouring copies of `least` bytes or of all of a text, from the repeated chunks sorted by document and place."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        doc_now, seen, last = None, set(), None

        def counts(run: list) -> bool:
            return run[3] - run[2] >= least or run[2] == 0 and run[5]

        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_names(RUNS))

        for batch in batches:
            rows = []
            for doc, k, start, end, digest, source, final in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_k", "start", "end", "digest", "source", "last")), strict=True):
                if (doc, k, start) == last:  # a row repeated as a whole
                    continue
                last = doc, k, start
                if doc != doc_now:
                    doc_now, seen = doc, set()
                if source == doc and digest not in seen:
                    seen.add(digest)
                    continue
                if held is not None and held[0] == doc and held[1] == k and held[3] == start:
                    held[3] = end
                    held[4].add(source)
                    held[5] = final
                    continue
                if held is not None and counts(held):
                    rows.append((*held[:4], sorted(held[4])))
                held = [doc, k, start, end, {source}, final]
            yield out(rows)
        if held is not None and counts(held):
            yield out([(*held[:4], sorted(held[4]))])

    return of


def copied_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Byte ranges of docs (doc_id, text) that copy chunks of other texts, or of earlier places of the text.

    Ranges below `least` bytes count only where they are all of their text; with `least` 1 every repeated chunk
    counts. doc_id, start, end, sources (the ids that hold the first copies, in order). The first copy is that of the
    smallest doc_id, in it that of the first place. Null and empty texts have no chunks; rows repeated with
    the same doc_id and text are one document, and rows with one doc_id but other texts follow each other in
    an order by hash; a null doc_id is left out; other columns are ignored; an empty table gives an empty one.
    """
    return _spans(_rows(docs), least).drop("_k")


def _rows(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("_k", F.xxhash64("text"))


def _spans(rows: DataFrame, least: int) -> DataFrame:
    chunks = store(rows.where("doc_id is not null").mapInArrow(_chunks, CHUNKS), "chunks")
    repeated = chunks.groupBy("digest").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = chunks.join(repeated, "digest").repartition("doc_id").sortWithinPartitions("doc_id", "_k", "start")
    return copies.mapInArrow(_runs(least), RUNS)


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part, rows = batch.slice(first, 500), []
            for doc, text, spans in zip(part.column("doc_id").to_pylist(), bytes_of(part.column("text")), part.column("spans").to_pylist(), strict=True):
                text = text.as_py()
                spans = sorted((s["start"], s["end"]) for s in spans or [])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_names(CUT))


def cut_copies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text) without the spans of `copied_spans`: one row per row.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay, which may break a UTF-8
    character). Null and empty texts stay empty; a row with a null doc_id is left whole.
    """
    rows = _rows(docs)
    spans = _spans(rows, least).groupBy(F.col("doc_id").alias("_doc"), F.col("_k").alias("_key")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return rows.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("_k") == F.col("_key")), "left").select("doc_id", "text", "spans").mapInArrow(_cut, CUT)
