"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Each text becomes a set of word shingles (64-bit hashes), a SuperMinHash signature, band keys and a
   sketch of one byte per signature value. Texts with equal sets collapse to their smallest id.
2. Rows that share a band key meet; inside a bucket only rows whose sketches agree in half of their
   values stay together. Each cluster gives a star of candidate edges, never all pairs.
3. The components of these edges are small neighbourhoods that hold every link. Their texts meet in one
   task, which explores the exact links breadth first. A large one is cut into blocks that share a few
   representatives; only where that leaves it in several parts do all pairs of its blocks meet. Large
   buckets are cut in the same way.
4. Connected components of the exact links give the groups.

With 24 bands of 3 values, a pair at similarity 0.75 fails to share a bucket with probability 2e-6, and
fails the sketch test with about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import GOLD, bytes_of, connected_components, group_bounds, join_groups, linked_in_blocks, mix, representatives, store, whole_groups

BANDS, ROWS, WORDS, PERCENT = 24, 3, 5, 75
SIZE = BANDS * ROWS
#: Rows of a bucket, and members and shingles of a neighbourhood, that one task holds at once (two blocks).
BUCKET_BLOCK, LINK_BLOCK, LINK_SHINGLES = 8192, 2048, 2_000_000
WORD_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lower-cased, words cut at ASCII white space."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\0short " + b" ".join(tokens))], np.uint64)
    n = len(tokens) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix(out * WORD_STEP + h[k : k + n] + GOLD)
    return np.unique(out)


def superminhash(elements: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures of the sets elements[bounds[i]:bounds[i + 1]], none of them empty.

    In round j each element puts j plus a uniform fraction at the j-th place of its own permutation; a
    set whose values are all below j + 1 is finished, as later rounds can only bring larger values.
    """
    n = bounds.size - 1
    sig = np.full(n * size, np.uint64(size) << np.uint64(32), np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    perm = None
    for j in range(size):
        r = mix(elements + np.uint64((j + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((r >> shift) * np.uint64(size - j)) >> shift)).astype(np.int64)
        if perm is None:
            place = k
        else:
            rows = np.arange(elements.size)
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(sig, doc * size + place, (np.uint64(j) << shift) | (r & low))
        open_docs = sig.reshape(n, size).max(axis=1) >= (np.uint64(j + 1) << shift)
        keep = open_docs[doc]
        if not keep.any():
            break
        if perm is None:
            perm = np.tile(np.arange(size, dtype=np.uint16), (int(keep.sum()), 1))
            rows = np.arange(perm.shape[0])
            perm[rows, k[keep]] = 0
            perm[:, 0] = k[keep]
        elif not keep.all():
            perm = perm[keep]
        elements, doc = elements[keep], doc[keep]
    return sig.reshape(n, size)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((sig.shape[0], bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * WORD_STEP + sig[:, r::rows][:, :bands] + np.arange(bands, dtype=np.uint64) * GOLD)
    return keys.view(np.int64)


SIGNED = "doc_id bigint, n_shingles bigint, digest bigint, digest2 bigint, bands array<bigint>, sketch binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.int64()), ("digest2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = bytes_of(batch.column("text")), batch.column("doc_id")
        sets, first, held = [], 0, 0
        for i in range(batch.num_rows):
            sets.append(shingle_hashes(texts[i].as_py()))
            held += sets[-1].size
            if held >= 200_000 or i + 1 == batch.num_rows:
                yield _signed(ids.slice(first, len(sets)), sets)
                sets, first, held = [], i + 1, 0


def _signed(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([s.size for s in sets])
    bands: list = [None] * len(sets)
    sketch: list = [None] * len(sets)
    digests = np.zeros((len(sets), 2), np.int64)
    full = np.flatnonzero(sizes)
    if full.size:
        own = [sets[i] for i in full]
        sig = superminhash(np.concatenate(own), np.concatenate(([0], np.cumsum(sizes[full]))))
        keys, marks = band_keys(sig), (mix(sig) >> np.uint64(56)).astype(np.uint8)
        for i, k, s, elements in zip(full, keys, marks, own, strict=True):
            bands[i], sketch[i] = k, s.tobytes()
            d = xxhash.xxh3_128_digest(elements.tobytes())
            digests[i] = np.frombuffer(d, np.int64)
    columns = [ids, pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_SIGNED)


EDGES = "a bigint, b bigint"


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sketch_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in whole_groups(batches, "_tile"):
        ids = block.column("doc_id").to_numpy()
        marks = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE)
        bounds = group_bounds(block.column("_tile").to_numpy())
        a: list[int] = []
        b: list[int] = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            left = np.arange(lo, hi)
            while left.size > 1:
                todo, left = [left[0]], left[1:]
                top = int(ids[todo[0]])
                while todo and left.size:
                    near = (marks[left] == marks[todo.pop()]).sum(axis=1) * 2 >= SIZE
                    if near.any():
                        todo.extend(left[near])
                        a.extend(ids[left[near]].tolist())
                        b.extend([top] * int(near.sum()))
                        left = left[~near]
        yield _edges(a, b)


def explore(sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """(member, first member of its component) for the links of similarity of at least percent / 100.

    Breadth first: a reached set is compared with those not yet reached only, all at once.
    """
    sizes = np.array([s.size for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(int(flat.max()) + 1, bool)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    left = np.arange(len(sets))
    packed, start = left, np.concatenate(([0], np.cumsum(sizes)[:-1]))
    while left.size > 1:
        top, left = left[0], left[1:]
        todo = [top]
        while todo and left.size:
            if left.size < 0.75 * packed.size:
                packed, flat = left, np.concatenate([own[i] for i in left])
                start = np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
            i = todo.pop()
            flag[own[i]] = True
            common = np.add.reduceat(flag[flat].astype(np.int32), start)
            flag[own[i]] = False
            hit = packed[(100 * common >= percent * (sizes[i] + sizes[packed] - common)) & np.isin(packed, left, assume_unique=True)]
            for k in hit:
                yield int(k), int(top)
            todo.extend(hit)
            left = left[~np.isin(left, hit, assume_unique=True)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in whole_groups(batches, "_tile"):
        ids, texts = block.column("doc_id").to_pylist(), block.column("text").combine_chunks()
        texts = bytes_of(texts)
        bounds = group_bounds(block.column("_tile").to_numpy())
        a: list[int] = []
        b: list[int] = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            sets = [shingle_hashes(texts[int(i)].as_py()) for i in range(lo, hi)]
            for member, top in explore(sets):
                a.append(ids[lo + member])
                b.append(ids[lo + top])
        yield _edges(a, b)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of near duplicates in docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    One row per row of docs. Null and empty texts, and texts without words, have no shingles and are
    linked with nothing. Rows that repeat a doc_id are one document of several texts: they share its
    component. A row with a null doc_id is linked with nothing: its component_id is null and it is kept.
    Other columns of docs are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store(docs.mapInArrow(_sign, SIGNED), "signed")
    named = signed.where("doc_id is not null and n_shingles > 0")
    equal = ["digest", "digest2"]
    reps = named.groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    reps = store(reps, "reps")
    copied = reps.where("copies > 1").select(*equal, F.col("doc_id").alias("b"))
    same = named.select("doc_id", *equal).join(copied, equal).select(F.col("doc_id").alias("a"), "b")
    n_reps = reps.count()
    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n"), representatives("doc_id").alias("_reps")).where("n > 1")
    met = join_groups(rows, shared, "band", "n", n_reps * BANDS).withColumn("_blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("bigint"))
    met = met.join(reps.select("doc_id", "sketch"), "doc_id").select("band", "doc_id", "_blocks", "_reps", "sketch")
    near = store(connected_components(linked_in_blocks(met, "band", ["sketch"], _sketch_clusters, EDGES, "near"), "near"), "near")
    sized = near.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), representatives("node").alias("_reps"))
    blocks = F.greatest(F.ceil(F.col("n") / LINK_BLOCK), F.ceil(F.col("s") / LINK_SHINGLES)).cast("bigint")
    members = join_groups(near, sized, "component", "n", near.count()).withColumn("_blocks", blocks).withColumnRenamed("node", "doc_id").join(docs, "doc_id")
    links = linked_in_blocks(members.select("component", "doc_id", "_blocks", "_reps", "text"), "component", ["text"], _links, EDGES, "links")
    groups = connected_components(links.unionByName(same), "groups")
    out = signed.select("doc_id", "n_shingles").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    top = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", top.alias("component_id"), F.coalesce(top == F.col("doc_id"), F.lit(True)).alias("kept"))
