"""Removal of repeated byte strings by column-wise Burrows-Wheeler and common-prefix updates.

A column-wise construction inserts one symbol of every text per round, so over whole texts it has as many
rounds as the longest text has bytes, each over all that was inserted. Here the collection is cut first, in
a way that loses no repeat: every window of `length` bytes names the smallest hash of the 64-byte strings
inside it (its anchor). Equal windows have equal anchors at the same place, so

1. anchors that occur once end their windows' search: most text is never moved again;
2. runs of windows with one repeated anchor become short texts, aligned at the anchor, and texts of one
   anchor meet in one task;
3. there, from the last column to the first, one symbol of each text is inserted per round: the order of
   the suffixes is refined by a stable sort on the new symbol, and the common prefixes of neighbours are
   updated by range minima. Columns are read one after the other and only the last one is kept. A window
   whose suffix shares `length` bytes with a neighbour is repeated.

Runs are first known by hashes of their texts: equal ones are repeated as a whole, and bytes are moved only where
one anchor has different texts, once for each of them. Groups are kept small in two steps that lose nothing. An anchor of more than SPLIT documents has its runs cut into blocks of
BLOCK successive places of the anchor; all windows of a block share the bytes in the middle (the core), so
equal windows have equal cores, and texts are dealt out by anchor, block and core. Documents that share only
a line then fall apart. An anchor of more than HOT documents has its windows compared by 128-bit hashes,
dealt out by hash.

Two lengths can be asked for at once: windows, anchors and groups are those of the shorter one, texts go on to
the end of their windows of the longer one, and a common prefix of that many bytes repeats the longer window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import GOLD, bytes_of, grouped, mix, store, whole_groups

LENGTH, GRAM, SPLIT, BLOCK, HOT, PIECE = 400, 64, 300, 64, 20_000, 1 << 18
_BITS = 22
_LOW = np.uint64((1 << _BITS) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


class _Rolling:
    """Polynomial hashes modulo 2^64 of all strings of one length in a buffer."""

    def __init__(self, seed: int, size: int):
        base = (int(mix(np.array([seed], np.uint64))[0]) | 1) & 0xFFFFFFFFFFFFFFFF
        self.table = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1))
        self.up, self.down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        total = np.cumsum(self.table[data] * self.up[: data.size])
        part = total[length - 1 :].copy()
        part[1:] -= total[: part.size - 1]
        return mix(part * self.down[: part.size])


_ROLLING: dict[int, _Rolling] = {}


def _rolling(seed: int) -> _Rolling:
    if seed not in _ROLLING:
        _ROLLING[seed] = _Rolling(seed, PIECE * 3)
    return _ROLLING[seed]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values: prefix minima of blocks against suffix minima."""
    n = x.size - w + 1
    blocks = -(-x.size // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: x.size] = x
    padded = padded.reshape(blocks, w)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def _pieces(texts: pa.Array, length: int, far: int | None = None) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of about PIECE bytes with the (row, offset in the row's text, start, end) that they hold.

    Longer texts are cut so that each window begins in exactly one piece, which goes on for `far` bytes of it.
    """
    far = far or length
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    parts, held, size = [], [], 0
    for row in np.flatnonzero(np.diff(ends) >= length):
        lo, hi = int(ends[row]), int(ends[row + 1])
        for at in range(lo, hi - length + 1, PIECE):
            part = data[at : min(hi, at + PIECE + far - 1)]
            held.append((int(row), at - lo, size, size + part.size))
            parts.append(part)
            size += part.size
            if size >= PIECE - length:
                yield np.concatenate(parts), held
                parts, held, size = [], [], 0
    if parts:
        yield np.concatenate(parts), held


def _runs(data: np.ndarray, held: list, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: number of the text in held, first window, windows, anchor's place, anchor."""
    h = _rolling(1)(data, GRAM)
    packed = (h & ~_LOW) | np.arange(h.size, dtype=np.uint64)
    at = (sliding_min(packed, length - GRAM + 1) & _LOW).astype(np.int64)
    windows = [np.arange(s, min(s + PIECE, e - length + 1)) for _, _, s, e in held]
    pos = np.concatenate(windows)
    own = np.repeat(np.arange(len(held)), [w.size for w in windows])
    q = at[pos]
    first = np.concatenate(([0], np.flatnonzero((q[1:] != q[:-1]) | (own[1:] != own[:-1])) + 1))
    n = np.diff(np.append(first, q.size))
    return own[first], pos[first], n, q[first], h[q[first]].view(np.int64)


ANCHORS = "_k bigint, anchor bigint, n bigint"


def _anchors(length: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_k")
            for data, held in _pieces(bytes_of(batch.column("text")), length):
                own, _, _, q, anchor = _runs(data, held, length)
                new = np.concatenate(([True], q[1:] != q[:-1]))
                rows = np.array([row for row, *_ in held])[own[new]]
                order = np.lexsort((anchor[new], rows))
                r, a = rows[order], anchor[new][order]
                top = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (a[1:] != a[:-1]))))
                n = np.diff(np.append(top, r.size))
                take = pa.array(r[top])
                yield pa.RecordBatch.from_arrays([keys.take(take), pa.array(a[top]), pa.array(n)], names=["_k", "anchor", "n"])

    return of


SEGMENTS = "doc_id bigint, _k bigint, start bigint, windows bigint, far bigint, place bigint, known boolean, _key bigint, h1 bigint, h2 bigint"
_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("_k", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("far", pa.int64()), ("place", pa.int64()), ("known", pa.bool_()), ("_key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
#: Texts and windows that a task remembers in order to know copies without moving them.
REMEMBERED = 200_000


def _member(rows: np.ndarray, values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value lies in the list of its row; in lists of int, whether its low half does."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if pa.types.is_int32(lists.type.value_type):
        values = values.astype(np.int32)  # the low half
    key = lambda r, v: mix(v.astype(np.int64).view(np.uint64) + (r.astype(np.uint64) + np.uint64(1)) * GOLD)
    return np.isin(key(rows, values), key(np.repeat(np.arange(len(lists)), sizes), flat))


class _Out:
    """Rows of SEGMENTS. The third time that a task meets a text it is a known copy.

    Known copies that follow each other in a text are one row.
    """

    def __init__(self):
        self.rows: list[tuple] = []
        self.times: dict[bytes, int] = {}
        self.run: list | None = None

    def met(self, mark: bytes) -> int:
        seen = self.times.get(mark, 0)
        if len(self.times) > REMEMBERED:
            self.times.clear()
        self.times[mark] = seen + 1
        return seen

    def add(self, name: tuple, start: int, windows: int, far: int, place: int | None, mark: bytes, key: int | None) -> None:
        """One text, in the order of texts and starts: so many windows and longer windows from start on.

        name: number of its document in the batch, doc_id, _k. place: null for a window that its hashes stand for.
        key: None for that of the mark.
        """
        seen = self.met(mark)
        if seen > 1:
            run = self.run
            if run and run[0] == name and run[1] + max(run[2], run[3]) == start and (windows > 0) == (run[2] > 0) and (far > 0) <= (run[3] > 0):
                run[2], run[3] = run[2] + windows, run[3] + far
            else:
                self.end_run()
                self.run = [name, start, windows, far]
            return
        h1, h2 = int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True)
        self.rows.append((*name[1:], start, windows, far, place, False, h1 if key is None else key, h1, h2))

    def end_run(self) -> None:
        if self.run:
            name, start, windows, far = self.run
            self.rows.append((*name[1:], start, windows, far, None, True, start ^ (name[2] or 0), 0, 0))
            self.run = None

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(_SEGMENTS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENTS, strict=True)], schema=_SEGMENTS)


def _blocks(run: tuple[int, int, int], data: np.ndarray, length: int, block: int, anchor: int) -> Iterator[tuple[int, int, int]]:
    """First window, number of windows and key of the parts of a run in which the anchor's place lies in one block."""
    first, n, q = run
    at = first
    while at < first + n:
        number = (q - at) // block
        end = min(first + n, q - number * block + 1)
        core = data[q - number * block : q - (number + 1) * block + 1 + length]
        yield at, end - at, xxhash.xxh3_64_intdigest(core.tobytes(), seed=(anchor ^ number) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        at = end


def _segments(length: int, far: int, block: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("_k").to_pylist()
            for data, held in _pieces(bytes_of(batch.column("text")), length, far):
                own, first, n, q, anchor = _runs(data, held, length)
                rows = np.array([row for row, *_ in held])[own]
                use = np.flatnonzero(_member(rows, anchor, batch.column("anchors")))
                hot = _member(rows[use], anchor[use], batch.column("hot"))
                split = _member(rows[use], anchor[use], batch.column("split"))
                sizes = [length] if far == length else [length, far]
                hashes = [np.stack([_rolling(2)(data, size), _rolling(3)(data, size)], axis=1) for size in sizes] if hot.any() else []
                for i, is_hot, is_split in zip(use.tolist(), hot.tolist(), split.tolist(), strict=True):
                    row, offset, start, end = held[own[i]]
                    name = row, ids[row], keys[row]
                    run, gram, move = (int(first[i]), int(n[i]), int(q[i])), int(anchor[i]), offset - start
                    longer = lambda at, many: max(0, min(many, end - far + 1 - at)) if far > length else 0  # noqa: B023, E731
                    if is_hot:
                        for k, both in enumerate(hashes):
                            for at in range(run[0], run[0] + (longer(*run[:2]) if k else run[1])):
                                out.add(name, at + move, 1 - k, k, None, both[at].tobytes(), None)
                    else:
                        for at, many, key in _blocks(run, data, length, block, gram) if is_split else ((run[0], run[1], gram),):
                            body, place = data[at : min(end, at + many - 1 + far)].tobytes(), at - run[2]
                            out.add(name, at + move, many, longer(at, many), place, xxhash.xxh3_128_digest(body, seed=place + length), key)
                    if len(out.rows) >= 5000:
                        yield out.flush()
            out.end_run()
            yield out.flush()

    return of


PARTS = "doc_id bigint, _k bigint, start bigint, windows bigint, far bigint, place bigint, known boolean, ask boolean, _key bigint"
_NAMES = [c.split()[0] for c in PARTS.split(", ")]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """known: the run's text is there twice. ask: the bytes are needed, as the anchor has different texts; once for each."""
    for block in whole_groups(batches, "_key"):
        block = block.combine_chunks()
        key, h1, h2 = (block.column(c).to_numpy() for c in ("_key", "h1", "h2"))
        known, plain = block.column("known").to_numpy().copy(), block.column("place").is_valid().to_numpy()
        fresh = np.flatnonzero(~known)
        ask = np.zeros(known.size, bool)
        if fresh.size:
            order = fresh[np.lexsort((h2[fresh], h1[fresh], key[fresh]))]
            new_key = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            new = new_key | np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
            times = np.diff(np.append(np.flatnonzero(new), order.size))
            known[order] = np.repeat(times > 1, times)
            texts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))  # different ones of each key
            several = np.repeat(texts > 1, np.diff(np.append(np.flatnonzero(new_key), order.size)))
            ask[order[new & several]] = True
            ask &= plain
        rows = np.flatnonzero(known | ask)
        out = block.take(pa.array(rows)).select(["doc_id", "_k", "start", "windows", "far", "place"])
        columns = [*(c.combine_chunks() for c in out.columns), pa.array(known[rows]), pa.array(ask[rows]), pa.array(key[rows])]
        yield from pa.Table.from_arrays(columns, names=_NAMES).to_batches(max_chunksize=20_000)


BODIES = "doc_id bigint, _k bigint, start bigint, windows bigint, far bigint, place bigint, known boolean, _key bigint, body binary"
_BODIES = pa.schema([("doc_id", pa.int64()), ("_k", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("far", pa.int64()), ("place", pa.int64()), ("known", pa.bool_()), ("_key", pa.int64()), ("body", pa.binary())])


def _fetch(longest: int):
    """The parts of each text, with their bytes where they were asked for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BODIES, strict=True)], schema=_BODIES)
        for batch in batches:
            for doc, k, text, parts in zip(batch.column("doc_id").to_pylist(), batch.column("_k").to_pylist(), bytes_of(batch.column("text")), batch.column("parts"), strict=True):
                text, own = text.as_py(), {}
                for p in parts.as_py():  # those of rows that repeat this one are met again there
                    if p["doc_id"] == doc:
                        at = p["start"], p["windows"], p["far"], p["_key"]
                        own[at] = p if at not in own or p["ask"] else own[at]
                for p in own.values():
                    body = text[p["start"] : p["start"] + p["windows"] - 1 + longest] if p["ask"] else None
                    key = p["_key"] if p["ask"] else p["_key"] ^ p["start"] ^ k
                    rows.append((doc, k, p["start"], p["windows"], p["far"], p["place"], p["known"], key, body))
                if len(rows) >= 5000:
                    yield flush()
                    rows.clear()
        if rows:
            yield flush()

    return of


def repeated_windows(group: np.ndarray, place: np.ndarray, windows: np.ndarray, bodies: list[bytes], lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, for all windows of the texts, text by text: whether another text of the group has it at the same place.

    place: column of a text's first byte. One symbol of each text is inserted per column, from the last.
    """
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark_at = np.concatenate(([0], np.cumsum(windows)))
    out = [np.zeros(int(mark_at[-1]), bool) for _ in lengths]
    last, group = place + sizes - 1, np.unique(group, return_inverse=True)[1]
    enter: dict[int, np.ndarray] = {}
    by_last = np.argsort(last, kind="stable")
    for part in np.split(by_last, np.flatnonzero(np.diff(last[by_last])) + 1):
        enter[int(last[part[0]])] = part
    order, common = np.empty(0, np.int64), np.empty(0, np.int64)
    for column in range(int(last.max()), int(place.min()) - 1, -1):
        alive = place[order] <= column
        if not alive.all():  # those left to the right of their first byte have been reported
            keep = np.flatnonzero(alive)
            if keep.size:
                common = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
            order = order[keep]
            common = common[: order.size]
        if (new := enter.get(column)) is not None:
            joined = np.concatenate((new, order))
            joined_common = np.concatenate((np.zeros(new.size, np.int64), common))
            by = np.argsort(group[joined], kind="stable")
            order, common = joined[by], joined_common[by]
        if not order.size:
            continue
        key = group[order] * 256 + data[base[order] + column - place[order]]
        by = np.argsort(key, kind="stable")
        key, order = key[by], order[by]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        fresh = np.zeros(order.size, np.int64)
        if same.size:
            before, here = by[same - 1], by[same]
            value = common[here]
            far = np.flatnonzero(here - before > 1)
            if far.size:
                span = np.stack((before[far] + 1, here[far] + 1), axis=1).ravel()
                value[far] = np.minimum.reduceat(np.append(common, 0), span)[::2]
            fresh[same] = value + 1
        common = fresh
        for length, found_at in zip(lengths, out, strict=True):
            twin = common >= length
            twin[:-1] |= twin[1:]
            if twin.any():
                found = order[twin]
                inside = column - place[found]
                ok = inside < windows[found]
                found_at[mark_at[found[ok]] + inside[ok]] = True
    return out


def _stretches(found: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Stretches of found windows: number of the text, first and last window but one. ends: of the texts' windows."""
    step = np.diff(np.concatenate(([0], found.astype(np.int8), [0])))
    cut = np.zeros(found.size + 1, bool)
    cut[ends[:-1]] = True
    inner = np.flatnonzero(cut[:-1] & found & np.concatenate(([False], found[:-1])))
    lo = np.sort(np.concatenate((np.flatnonzero(step == 1), inner)))
    hi = np.sort(np.concatenate((np.flatnonzero(step == -1), inner)))
    return zip(np.searchsorted(ends, lo, side="right").tolist(), lo.tolist(), hi.tolist(), strict=True)


RUNS = "doc_id bigint, _k bigint, start bigint, windows bigint, longer boolean"


def _repeats(length: int, far: int):
    lengths = (length,) if far == length else (length, far)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "_key"):
            doc, k, body = (block.column(c).to_pylist() for c in ("doc_id", "_k", "body"))
            start, windows, more, key = (block.column(c).to_numpy() for c in ("start", "windows", "far", "_key"))
            place, known = block.column("place").to_pylist(), block.column("known").to_numpy()
            runs: list[tuple[int, int, int, bool]] = []
            texts = np.array([i for i, b in enumerate(body) if b is not None], np.int64)
            if texts.size:
                ends = np.cumsum(windows[texts])
                for longer, found in enumerate(repeated_windows(key[texts], np.array([place[i] for i in texts]), windows[texts], [body[i] for i in texts], lengths)):
                    for t, x, y in _stretches(found, ends):
                        i = int(texts[t])
                        if not known[i]:
                            runs.append((i, int(start[i]) + x - int(ends[t] - windows[i]), y - x, bool(longer)))
            for i in np.flatnonzero(known).tolist():
                runs += [(i, int(start[i]), int(w), longer) for longer, w in ((False, windows[i]), (True, more[i])) if w]
            yield pa.RecordBatch.from_arrays([pa.array([doc[i] for i, *_ in runs], pa.int64()), pa.array([k[i] for i, *_ in runs], pa.int64()), pa.array([s for _, s, _, _ in runs], pa.int64()), pa.array([n for _, _, n, _ in runs], pa.int64()), pa.array([f for *_, f in runs], pa.bool_())], names=["doc_id", "_k", "start", "windows", "longer"])

    return of


KINDS = {"bytes": ("kept", pa.binary()), "text": ("text", pa.string())}


def spans_of(starts: np.ndarray, windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of the byte ranges that runs of windows cover, as maximal ranges."""
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], np.maximum.accumulate((starts + windows - 1 + length)[order])
    top = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return list(zip(lo[top].tolist(), hi[np.append(top[1:] - 1, lo.size - 1)].tolist(), strict=True))


def _cut(length: int, passage: int, keep: str | None, carry: tuple[str, ...]):
    short = passage < length
    kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("n_passage_bytes", pa.int64())] if short else []), *([KINDS[keep]] if keep else [])]

    def covered(runs: list, longer: bool, size: int) -> list[tuple[int, int]]:
        own = [r for r in runs if r["longer"] == longer]
        return spans_of(np.array([r["start"] for r in own]), np.array([r["windows"] for r in own]), size) if own else []

    def one(doc: int | None, text: bytes, runs: list | None) -> tuple:
        runs = [r for r in runs or [] if r["doc_id"] == doc]
        kept, spans = text, covered(runs, short, length)
        if spans:
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out = len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()
        if short:
            out += (sum(b - a for a, b in covered(runs, False, passage)),)
        return (*out, kept.decode(errors="ignore") if keep == "text" else kept) if keep else out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [one(d.as_py(), t.as_py(), r.as_py()) for d, t, r in zip(part.column("doc_id"), bytes_of(part.column("text")), part.column("runs"), strict=True)]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, *map(part.column, carry)], names=["doc_id", *(n for n, _ in kinds), *carry])

    return of


def repeated_runs(docs: DataFrame, length: int = LENGTH, longer: int | None = None) -> DataFrame:
    """(doc_id, _k, start, windows, longer): runs of windows of docs (doc_id, _k, text) whose bytes also start elsewhere.

    longer: a second length; its runs are the rows with longer = true.
    """
    far = longer or length
    found = store(docs.mapInArrow(_anchors(length), ANCHORS), "anchors")
    repeated = found.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("texts")).where("total > 1")
    half = F.shiftright(F.shiftleft("anchor", 32), 32).cast("int")  # two anchors of a text with one half only send more
    pick = lambda c: F.collect_list(F.when(c, F.col("anchor")))
    lists = F.collect_list(half).alias("anchors"), pick((F.col("texts") > SPLIT) & (F.col("texts") <= HOT)).alias("split"), pick(F.col("texts") > HOT).alias("hot")
    asked = found.join(repeated, "anchor").groupBy("_k").agg(*lists)
    runs = grouped(docs.join(asked, "_k").mapInArrow(_segments(length, far, min(BLOCK, length - GRAM)), SEGMENTS), "_key").mapInArrow(_decide, PARTS)
    parts = runs.groupBy("_k").agg(F.collect_list(F.struct(*(c for c in _NAMES if c != "_k"))).alias("parts"))
    return grouped(docs.join(parts, "_k").mapInArrow(_fetch(far), BODIES), "_key").mapInArrow(_repeats(length, far), RUNS)


def cut_repeats(docs: DataFrame, length: int = LENGTH, keep: str | None = "bytes", carry: tuple[str, ...] = (), passage: int | None = None) -> DataFrame:
    """docs (doc_id, text) without the bytes that a repeated string of `length` bytes covers.

    One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, then what stays: with keep "bytes" the
    column kept (which may break a UTF-8 character), with "text" the column text (without the rest of broken
    characters), with None neither; then the columns of docs named in carry. Matches never cross texts;
    overlaps count; strings are judged on the input. Null texts count as empty; texts of fewer than `length`
    bytes are left alone. Rows repeated with the same doc_id and text are texts of their own, so they repeat
    each other. With passage, a shorter length, the column n_passage_bytes (after kept_sha256) says how many
    bytes repeated strings of that length cover; they stay. A null doc_id is an id like others. Other columns are ignored; an empty table gives an empty
    table.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    docs = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    found = repeated_runs(docs.select("doc_id", "text", "_k"), passage or length, length)
    runs = found.groupBy("_k").agg(F.collect_list(F.struct("doc_id", "start", "windows", "longer")).alias("runs"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", n_passage_bytes bigint" if passage else "") + {"bytes": ", kept binary", "text": ", text string", None: ""}[keep]
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.join(runs, "_k", "left").select("doc_id", "text", "runs", *carry).mapInArrow(_cut(length, passage or length, keep, carry), schema)
