"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

An alignment scores 1 for a word that agrees and -1 for one that differs or is skipped. With m words that
agree, e errors and so at most e + 1 runs of agreeing words, m - e - 1 pairs of neighbouring words agree at
least: the least score less 1. This decides what is aligned, and no alignment that counts is lost by it.

1. One pass over the documents looks up the word pairs of the benchmark (a broadcast table of checked size;
   a larger benchmark goes through in blocks). Of an item's pairs those that most items share are left out,
   half as many as must agree, so the rest of these pairs must be found among the rarer ones, the seeds.
2. Where so many seeds of an item lie within the words that an alignment can span, the passage and the item
   are aligned. The best alignment's score over the item's words is the share by which it counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import GOLD, bytes_of, mix

#: Items of fewer words are looked for as a whole.
WHOLE = 4
SHARE = 0.5
#: Words of benchmark items that one pass looks for at once.
BLOCK_WORDS = 2_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (ASCII letters), cut at everything in ASCII that is neither letter nor digit."""
    return text.lower().translate(_BLANKS).split()


def gram_hashes(numbers: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of `gram` numbers; 0 where one of them is 0 (a word that the benchmark lacks)."""
    n = numbers.size - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = numbers.astype(np.uint64)
    out, known = np.full(n, gram, np.uint64), np.ones(n, bool)
    for k in range(gram):
        out = mix(out * _STEP + wide[k : k + n] + GOLD)
        known &= numbers[k : k + n] > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


class Block:
    """Some benchmark items: their words' numbers, and the sorted hashes of their seeds with the items that hold them."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = SHARE):
        self.number: dict[bytes, int] = {}
        self.share, self.ids, self.items = share, [], []
        for item, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item)
                self.items.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32))
        sizes = np.array([x.size for x in self.items], np.int64)
        least = np.ceil(share * sizes).astype(np.int64)
        # where one word is enough for the score, single words are the seeds
        gram = np.where(sizes < WHOLE, sizes, np.where(least > 1, 2, 1))
        agree = np.where(sizes < WHOLE, 1, np.maximum(least - 1, 1))
        #: Seeds that a copy of each item holds at least, and places over which they spread at most.
        self.need = agree - agree // 2
        self.reach = np.floor((2 - share) * sizes).astype(np.int64) + 1
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in set(gram.tolist()):
            mine = np.flatnonzero(gram == g)
            own = [gram_hashes(self.items[i], g) for i in mine]
            shared, held = np.unique(np.concatenate([np.unique(h) for h in own]), return_counts=True)
            rare = []
            for i, h in zip(mine, own, strict=True):
                by = np.argsort(held[np.searchsorted(shared, h)], kind="stable")
                rare.append(np.unique(h[by[: h.size - agree[i] // 2]]))
            of, h = np.repeat(mine, [x.size for x in rare]), np.concatenate(rare)
            by = np.argsort(h, kind="stable")
            known, first = np.unique(h[by], return_index=True)
            self.seeds[g] = known, np.append(first, h.size), of[by]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment (match 1, mismatch -1, gap -1): score, words that agree, first word, end.

    One row per word of the item; gaps in the passage are running maxima, so a row is a few array steps.
    Score, start and matches are packed in one number: of equal scores the first end wins, then the latest start.
    """
    n = words.size
    span = np.int64(n + 1)
    place = np.arange(n, dtype=np.int64)
    unit = span * np.int64(item.size + 1)  # of one point of score
    fresh = place * np.int64(item.size + 1)  # an alignment that begins here: score 0, its start, no match
    before = np.append(fresh, n * np.int64(item.size + 1))  # state in front of each word
    best, where = np.int64(-1), 0
    for x in item:
        same = words == x
        state = np.empty(n + 1, np.int64)
        state[0] = 0
        state[1:] = np.where(same, before[:-1] + unit + 1, before[:-1] - unit)
        state = np.maximum(state, before - unit)
        steps = np.arange(n + 1, dtype=np.int64) * unit
        state = np.maximum.accumulate(state + steps) - steps
        state = np.maximum(state, np.append(fresh, n * np.int64(item.size + 1)))
        scores = state // unit
        top = int(scores.argmax())
        if best < 0 or scores[top] > best // unit or (scores[top] == best // unit and top < where):
            best, where = state[top], top
        before = state
    score, rest = divmod(int(best), int(unit))
    start, matches = divmod(rest, item.size + 1)
    return score, matches, start, where


MATCHES = "doc_id bigint, item_id bigint, score bigint, n_item_words bigint, n_matched bigint, start_word bigint, end_word bigint"


def _align(block: Block):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.number.get
        seen: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                words = np.array([number(w, 0) for w in words_of(text.as_py())], np.int32)
                for i, lo, hi in _near(block, words):
                    key = i, words[lo:hi].tobytes()
                    if key not in seen:
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[key] = align(block.items[i], words[lo:hi])
                    score, n, start, end = seen[key]
                    if score >= block.share * block.items[i].size:
                        rows.append((doc, block.ids[i], score, block.items[i].size, n, lo + start, lo + end))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in MATCHES.split(", ")])

    return of


def _near(block: Block, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Items and the stretches of words (first, end) in which their alignments that count lie."""
    for g, (known, first, of) in block.seeds.items():
        h = gram_hashes(words, g)
        at = np.flatnonzero(h)
        k = np.minimum(np.searchsorted(known, h[at]), known.size - 1)
        at, k = at[known[k] == h[at]], k[known[k] == h[at]]
        if not at.size:
            continue
        # a row for each place and item
        n = first[k + 1] - first[k]
        place = np.repeat(at, n)
        item = of[np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(place.size)]
        by = np.lexsort((place, item))
        place, item = place[by], item[by]
        last = np.minimum(np.arange(item.size) + block.need[item] - 1, item.size - 1)
        enough = (np.arange(item.size) + block.need[item] <= item.size) & (item[last] == item) & (place[last] - place < block.reach[item])
        item, begin, end = item[enough], place[enough], place[last[enough]]
        if not item.size:
            continue
        apart = (item[1:] != item[:-1]) | (begin[1:] - end[:-1] > block.reach[item[1:]])
        for part in np.split(np.arange(item.size), np.flatnonzero(apart) + 1):
            i = int(item[part[0]])
            around = int(block.reach[i])
            yield i, max(0, int(begin[part[0]]) - around), int(end[part[-1]]) + g + around


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of a document of docs (doc_id, text) and an item of benchmark (item_id, text) that it contains.

    doc_id, item_id, score, n_item_words, n_matched, start_word, end_word: one row per pair, with the best
    alignment (then the earliest), if its score is at least `share` of the item's words. Null and empty
    texts, and texts without words, match nothing; items below WHOLE words are looked for as a whole; rows
    repeated with one id count as one document or item with several texts; null ids are left out; other
    columns are ignored; empty tables give an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = F.size(F.split("text", r"[^\p{L}\p{N}]+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_words) or 1
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        found = _one_block(docs, Block([(r["item_id"], r["text"].encode()) for r in part.collect()], share))  # of about block_words words
        out = found if out is None else out.unionByName(found)
    top = F.max_by(F.struct("score", "n_item_words", "n_matched", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word"), "n_matched"))
    return out.groupBy("doc_id", "item_id").agg(top.alias("m")).select("doc_id", "item_id", "m.*")


def _one_block(docs: DataFrame, block: Block) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    return docs.mapInArrow(lambda x: _align(sent.value)(x), MATCHES)
