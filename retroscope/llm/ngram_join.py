"""Similarity join of word n-gram sets with prefix trees.

1. Each text becomes a set of n-gram hashes. Texts with equal sets collapse to their smallest id.
2. Sets meet by prefix filter, without loss. Sets linked at PERCENT share their common n-grams but for a
   few. With s(n) = n - ceil(n * PERCENT / 100), the smallest 2 s(n) + 1 hashes of two linked sets have
   at least L = s(least partner size) + 1 in common, so the rarest common one is left when the L - 1 most
   frequent ones are put aside. Only these are sent, with a class of the set's size, and of them only those
   that two sets hold. Rows that meet are told apart by parity bitmaps: these differ in no more bits
   than the sets differ in elements. What stays connected is a neighbourhood.
3. The whole sets of a neighbourhood meet in one task and are stored in a trie, ordered by falling frequency
   there, ties by hash, so that similar sets share long paths. A set is looked up by walking down from the root:
   the overlap with a path is counted once for all sets below it, and a subtree is left when the overlap so
   far and what remains of either side cannot reach the bound for any size below it.
4. Connected components of the links give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import bytes_of, connected_components, group_bounds, join_groups, linked_in_blocks, release, representatives, store, whole_groups
from retroscope.llm.minhash_dedup import shingle_hashes

WORDS, PERCENT = 3, 90
#: Rows that meet by one n-gram, and members and n-grams of a neighbourhood, that one task holds at once (two blocks).
BUCKET_BLOCK, LINK_BLOCK, LINK_GRAMS = 8192, 2048, 2_000_000
#: Bits of the parity bitmap of a small set.
BITS = 512


def spare(n, percent: int = PERCENT):
    """How many of n elements may be missing in a linked set. Of numbers, or of a column of them."""
    return (n * (100 - percent) / 100).cast("bigint") if isinstance(n, Column) else n * (100 - percent) // 100


def parity_bits(elements: np.ndarray) -> bytes:
    """Bit k is the parity of the number of elements that are k modulo the number of bits, a power of two of at least half the elements."""
    width = BITS
    while 2 * width < elements.size:
        width *= 2
    return np.packbits(np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & np.uint8(1)).tobytes()


SIGNED = "doc_id bigint, n_shingles bigint, digest bigint, digest2 bigint, tokens array<bigint>, bits binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.int64()), ("digest2", pa.int64()), ("tokens", pa.list_(pa.int64())), ("bits", pa.binary())])


def _sign(words: int, percent: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = bytes_of(batch.column("text")), batch.column("doc_id")
            rows, first, held = [], 0, 0
            for i in range(batch.num_rows):
                s = shingle_hashes(texts[i].as_py(), words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                alone = spare(s.size, percent) == 0 and 100 * s.size // percent == s.size  # only an equal set is linked
                tokens = s[: 0 if alone else 2 * spare(s.size, percent) + 1]
                rows.append((s.size, digest[0], digest[1], tokens.view(np.int64), None if alone else parity_bits(s)))
                held += s.size
                if held >= 500_000 or i + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SIGNED.types[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *columns], schema=_SIGNED)
                    rows, first, held = [], i + 1, 0

    return of


EDGES = "a bigint, b bigint"


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bitmap_clusters(percent: int) -> Callable:
    """Stars over the rows of a tile whose bitmaps are as near as those of linked sets must be."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "_tile"):
            ids, sizes = block.column("doc_id").to_numpy(), block.column("n_shingles").to_numpy()
            maps = block.column("bits").to_pylist()
            bounds = group_bounds(block.column("_tile").to_numpy())
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                width = min(map(len, maps[lo:hi]))  # wider bitmaps are folded
                bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width)) for m in maps[lo:hi]]).view(np.uint64)
                own, left = sizes[lo:hi], np.arange(hi - lo)
                while left.size > 1:
                    todo, left = [left[0]], left[1:]
                    top = int(ids[lo + todo[0]])
                    while todo and left.size:
                        i = todo.pop()
                        apart = np.bitwise_count(bits[left] ^ bits[i]).sum(axis=1, dtype=np.int64)
                        near = apart * (100 + percent) <= (own[left] + own[i]) * (100 - percent)
                        if near.any():
                            todo.extend(left[near])
                            a.extend(ids[lo + left[near]].tolist())
                            b.extend([top] * int(near.sum()))
                            left = left[~near]
            yield _edges(a, b)

    return of


class Trie:
    """A radix tree over sets of which each is a path; nodes are arrays, and the sets below a node are a range of `order`.

    Elements are ranks by falling frequency in the tree. Each path ends in a symbol of its own, so each set
    has a leaf; it counts as no element.
    """

    def __init__(self, sets: list[np.ndarray]):
        """sets: sorted distinct uint64 each, none of them empty."""
        self.sizes = np.array([s.size for s in sets])
        values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(values.size, np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(values.size)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.sort(owner * values.size + rank[where]) - owner * values.size
        self.paths = np.split(flat, np.cumsum(self.sizes)[:-1])
        self.flag = np.zeros(values.size + len(sets), bool)
        ended = [np.append(p, values.size + i) for i, p in enumerate(self.paths)]
        self.order = np.array(sorted(range(len(sets)), key=lambda i: ended[i].astype(">u4").tobytes()))
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(self.order.size)
        ended = [ended[i] for i in self.order]
        self.labels = np.concatenate(ended)
        offsets = np.concatenate(([0], np.cumsum([e.size for e in ended])))
        self._nodes(ended, offsets)

    def _nodes(self, ended: list[np.ndarray], offsets: np.ndarray) -> None:
        shared = [0]
        for x, y in zip(ended, ended[1:], strict=False):
            n = min(x.size, y.size)
            shared.append(int((x[:n] != y[:n]).argmax()))
        start, end, first, after, parent = [0], [0], [0], [len(ended)], [-1]

        def node(depth: int, lo: int) -> int:
            for values, v in ((start, 0), (end, depth), (first, lo), (after, -1), (parent, -1)):
                values.append(v)
            return len(start) - 1

        def close(child: int, above: int, hi: int) -> None:
            parent[child], start[child], after[child] = above, end[above], hi

        stack = [0]
        for i, path in enumerate([*ended, None]):
            depth = shared[i] if path is not None and i else 0
            while end[stack[-1]] > depth:
                child = stack.pop()
                if end[stack[-1]] < depth:
                    stack.append(node(depth, first[child]))
                close(child, stack[-1], i)
            if path is not None:
                stack.append(node(path.size, i))
        start, end, self.lo, self.hi, parent = (np.array(x) for x in (start, end, first, after, parent))
        at = offsets[self.lo]
        self.begin, self.stop = at + start, at + end
        small = self.sizes[self.order]
        cuts = np.empty(2 * self.lo.size, np.int64)
        cuts[::2], cuts[1::2] = self.lo, self.hi
        small = np.append(small, small[-1])
        self.least, self.most = np.minimum.reduceat(small, cuts)[::2], np.maximum.reduceat(small, cuts)[::2]
        self.depth = np.minimum(end, self.most)  # without the last symbol of a leaf
        self.last = self.labels[np.maximum(self.stop - 1, 0)]
        kids = np.argsort(parent, kind="stable")[1:]
        self.kids, self.kid = kids, np.searchsorted(parent[kids], np.arange(parent.size + 1))

    def linked(self, i: int, percent: int, alive: np.ndarray) -> np.ndarray:
        """Members among alive (by place in `order`) whose sets have a similarity to set i of at least percent / 100."""
        own, n = self.paths[i], self.sizes[i]
        living = np.concatenate(([0], np.cumsum(alive)))
        self.flag[own] = True
        nodes, common, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while nodes.size:
            many = self.kid[nodes + 1] - self.kid[nodes]
            common = np.repeat(common, many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.kid[nodes], many)
            nodes = self.kids[at]
            some = living[self.hi[nodes]] > living[self.lo[nodes]]
            nodes, common = nodes[some], common[some]
            if not nodes.size:
                break
            size = self.stop[nodes] - self.begin[nodes]
            edge = np.cumsum(size) - size
            at = np.arange(size.sum()) - np.repeat(edge, size) + np.repeat(self.begin[nodes], size)
            common = common + np.add.reduceat(self.flag[self.labels[at]].astype(np.int64), edge)
            depth, rest = self.depth[nodes], n - np.searchsorted(own, self.last[nodes], side="right")
            best = np.clip(depth + rest, self.least[nodes], self.most[nodes])  # the size below that comes nearest to its bound
            reach = (100 + percent) * (common + np.minimum(rest, best - depth)) >= percent * (n + best)
            nodes, common = nodes[reach], common[reach]
            leaf = self.kid[nodes + 1] == self.kid[nodes]
            found.append(self.lo[nodes[leaf]])
            nodes, common = nodes[~leaf], common[~leaf]
        self.flag[own] = False
        return self.order[np.concatenate(found)] if found else np.empty(0, np.int64)


def explore(sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """(member, first member of its component) for the components of links among sets, none of them empty.

    Breadth first: a reached set leaves the tree, so it is found once.
    """
    if len(sets) < 2:
        return
    trie = Trie(sets)
    alive = np.ones(len(sets), bool)
    for top in range(len(sets)):
        if not alive[trie.place[top]]:
            continue
        alive[trie.place[top]] = False
        todo = [top]
        while todo:
            hit = trie.linked(todo.pop(), percent, alive)
            alive[trie.place[hit]] = False
            for k in hit.tolist():
                yield k, top
            todo.extend(hit.tolist())


def _trie_links(words: int, percent: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "_tile"):
            ids, texts = block.column("doc_id").to_pylist(), bytes_of(block.column("text").combine_chunks())
            bounds = group_bounds(block.column("_tile").to_numpy())
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                sets = [shingle_hashes(texts[int(i)].as_py(), words) for i in range(lo, hi)]
                some = [i for i, s in enumerate(sets) if s.size]
                for member, top in explore([sets[i] for i in some], percent):
                    a.append(ids[lo + some[member]])
                    b.append(ids[lo + some[top]])
            yield _edges(a, b)

    return of


def _meetings(reps: DataFrame, percent: int) -> DataFrame:
    """(meet, doc_id): reps that meet by a rare n-gram and a class of sizes; any two linked ones meet at least once."""
    set_of = ["doc_id", "digest"]  # a repeated doc_id has several sets
    rows = reps.select(*set_of, F.explode("tokens").alias("token"))
    total = reps.agg(F.sum(F.size("tokens"))).first()[0] or 0
    shared = store(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "tokens")
    found = join_groups(rows, shared, "token", "n", total).groupBy(*set_of).agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("found"))
    found = found.join(reps.select(*set_of, "n_shingles"), set_of)
    n = F.col("n_shingles")
    take = F.greatest(F.lit(0), F.size("found") - spare(n - spare(n, percent), percent).cast("int"))
    # a step is a little wider than the largest ratio of linked sizes, so these are at most one class apart
    level = F.floor(F.log(n.cast("double")) / (math.log(100 / percent) * 1.000001))
    chosen = found.select("doc_id", level.alias("level"), F.explode(F.slice("found", F.lit(1), take)).alias("one"))
    out = store(chosen.select("doc_id", F.explode(F.array(*(F.xxhash64("one.token", F.col("level") + i) for i in (0, 1)))).alias("meet")), "meetings")
    release(shared)
    return out


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of docs (doc_id, text) by links between sets of word n-grams: doc_id, n_shingles, component_id.

    A set holds the distinct n-grams of `words` words (A-Z lower-cased, cut at ASCII white space); a text of fewer
    words has all of them as its one element. Two rows link when their sets have `percent` of their union
    in common (percent from 51 to 99). One row per row of docs. Null and empty texts, and texts without
    words, have empty sets and link with nothing. Rows that repeat a doc_id are one document of several
    texts: they share its component. A row with a null doc_id links with nothing: its component_id is null. Other
    columns of docs are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store(docs.mapInArrow(_sign(words, percent), SIGNED), "sets")
    named = signed.where("doc_id is not null and n_shingles > 0")
    equal = ["digest", "digest2"]
    reps = named.groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "tokens", "bits")))
    reps = store(reps, "set_reps")
    copied = reps.where("copies > 1").select(*equal, F.col("doc_id").alias("b"))
    same = named.select("doc_id", *equal).join(copied, equal).select(F.col("doc_id").alias("a"), "b")
    meetings = _meetings(reps, percent)
    groups = meetings.groupBy("meet").agg(F.count("*").alias("n"), representatives("doc_id").alias("_reps")).where("n > 1")
    met = join_groups(meetings, groups, "meet", "n", meetings.count()).withColumn("_blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("bigint"))
    met = met.join(reps.where("bits is not null").select("doc_id", "n_shingles", "bits"), "doc_id").select("meet", "doc_id", "_blocks", "_reps", "n_shingles", "bits")
    near = store(connected_components(linked_in_blocks(met, "meet", ["n_shingles", "bits"], _bitmap_clusters(percent), EDGES, "set_near"), "set_near"), "set_near")
    sized = near.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), representatives("node").alias("_reps"))
    blocks = F.greatest(F.ceil(F.col("n") / LINK_BLOCK), F.ceil(F.col("s") / LINK_GRAMS)).cast("bigint")
    members = join_groups(near, sized, "component", "n", near.count()).withColumn("_blocks", blocks).withColumnRenamed("node", "doc_id").join(docs, "doc_id")
    links = linked_in_blocks(members.select("component", "doc_id", "_blocks", "_reps", "text"), "component", ["text"], _trie_links(words, percent), EDGES, "set_links")
    classes = store(connected_components(links.unionByName(same), "set_classes"), "set_classes")
    release(meetings, near, reps)
    out = signed.select("doc_id", "n_shingles").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
