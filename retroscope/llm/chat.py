"""Chat transcripts: roles recovered by a hidden Markov model, then turns rendered in one form.

A hidden state is a role and whether the line begins a turn or goes on with it. What is seen of a line is a
speaker marker (`User:`, `### Assistant`, `<|im_start|>system`, ...), its kind (question, list, code, ...)
and, at the first line of a stored turn, the role that is recorded there. How roles follow each other, how
many lines turns have and which kinds of lines a role writes is counted over all stored turns.

Viterbi's steps are max-plus products, which are associative: conversations of more than SEGMENT turn
numbers are decoded in segments. Each segment gives one matrix; segments of segments are combined level
by level, and states at the borders are handed down again, so that no task holds a whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import release, store, whole_groups

ROLES = ("system", "user", "assistant", "tool")
# Names by which transcripts call the roles.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "prompter", "customer", "client", "question", "prompt", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "chatgpt", "agent", "answer", "response", "a"),
    "tool": ("tool", "function", "observation", "tool result", "function result"),
}
ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
KINDS = ("blank", "question", "list", "code", "long", "text")
#: Turn numbers of a segment, and segments that are combined at once.
SEGMENT, FAN = 64, 64
#: Chances that a turn inside a stored one begins with its own marker, that a stored one does, that it has
#: another role's marker, that a marker lies inside a turn, and that a recorded role is wrong.
MARKED, STORED_MARKED, MISMARKED, INSIDE, MISRECORDED = 0.97, 0.3, 0.02, 0.005, 0.02
S = 2 * len(ROLES)  # state: 2 * role, + 1 inside a turn

_NAME = "|".join(sorted((re.escape(n) for names in NAMES.values() for n in names), key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|im_start\|>\s*({_NAME})\s*$|<\|({_NAME})\|>\s*:?|#{{1,6}}\s*({_NAME})\s*(?::|$)|\*\*\s*({_NAME})\s*(?::\s*\*\*|\*\*\s*:?)|\[\s*({_NAME})\s*\]\s*:?|({_NAME})\s*:(?!//))[ \t]*", re.I)
_INST = re.compile(r"\s*(\[INST\]|\[/INST\])[ \t]*")
_END = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>|</s>)\s*$")
_LIST = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s")
_CODE = re.compile(r"\s*(?:```|\t| {4}\S)|.*[{};]\s*$")


def marker(line: str) -> tuple[int, str]:
    """(role, rest of the line) of a line with a speaker marker; role -1 without one."""
    if m := _INST.match(line):
        return (1 if m[1] == "[INST]" else 2), line[m.end() :]
    if m := _MARKER.match(line):
        return ROLE_OF[next(g for g in m.groups() if g).lower()], line[m.end() :]
    return -1, line


def kind(line: str) -> int:
    bare = line.strip()
    if not bare:
        return 0
    if bare[-1] in "?？":
        return 1
    if _LIST.match(line):
        return 2
    if _CODE.match(line):
        return 3
    return 4 if len(bare) >= 200 else 5


def recorded(role: str | None) -> int:
    """The role that a stored name means, -1 if none."""
    return ROLE_OF.get(role.strip().lower(), -1) if role else -1


class Model:
    """Logarithms of the model's chances, from counts (each one more than counted)."""

    def __init__(self, begin: np.ndarray, follow: np.ndarray, ends: np.ndarray, lines: np.ndarray, kinds: np.ndarray):
        n = len(ROLES)
        first = (begin + 1) / (begin.sum() + n)
        after = (follow + 1) / (follow.sum(axis=1, keepdims=True) + n)
        stop = (ends + 1) / (lines + 2)
        self.start = np.log(np.repeat(first, 2)) + np.tile([0.0, -np.inf], n)
        self.within = np.full((S, S), -np.inf)  # between lines of a stored turn
        self.between = np.full((S, S), -np.inf)  # from a stored turn to the next one
        for r in range(n):
            for b in (0, 1):
                self.between[2 * r + b, ::2] = np.log(after[r])
                self.within[2 * r + b, ::2] = np.log(stop[r]) + np.log(after[r])
                self.within[2 * r + b, 2 * r + 1] = np.log(1 - stop[r])
        self.kinds = np.repeat(np.log((kinds + 1) / (kinds.sum(axis=1, keepdims=True) + len(KINDS))), 2, axis=0).T
        self.mark = np.empty((2, n + 1, S))  # by whether the line is a stored turn's first, and marker (the last is none)
        for mark, own in zip(self.mark, (MARKED, STORED_MARKED), strict=True):
            mark[n, ::2], mark[n, 1::2] = np.log(1 - own - MISMARKED), np.log(1 - INSIDE)
            mark[:n, ::2], mark[:n, 1::2] = np.log(MISMARKED / (n - 1)), np.log(INSIDE / n)
            for r in range(n):
                mark[r, 2 * r] = np.log(own)
        self.recorded = np.zeros((n + 1, S))
        self.recorded[:n] = np.log(MISRECORDED / (n - 1))
        for r in range(n):
            self.recorded[r, 2 * r : 2 * r + 2] = np.log(1 - MISRECORDED)

    def emission(self, lines: list[tuple[int, int, int, int]]) -> np.ndarray:
        """lines: (1 for a stored turn's first line, marker, kind, recorded role if it is the first)."""
        first, m, k, r = (np.array(x) for x in zip(*lines, strict=True))
        return self.mark[first, m] + self.kinds[k] + self.recorded[r]


def _best(steps: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States after each of the steps (matrices S x S) on the best path from entry to leave.

    entry: the state before the first step, -1 if it begins a conversation (its matrix has equal rows);
    leave: the last state, -1 for the best one. Ties go to the smaller state.
    """
    score = steps[0][max(entry, 0)]
    back = []
    for step in steps[1:]:
        way = score[:, None] + step
        back.append(way.argmax(axis=0))
        score = way.max(axis=0)
    path = [int(score.argmax()) if leave < 0 else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1)


class Turns:
    """Stored turns of one segment in order, as lines with what is seen of them."""

    def __init__(self, block: pa.Table, lo: int, hi: int):
        self.turn = block.column("turn")[lo:hi].to_pylist()
        self.role = block.column("role")[lo:hi].to_pylist()
        self.text = [(t or "").replace("\r\n", "\n").split("\n") for t in block.column("text")[lo:hi].to_pylist()]
        self.marks = [[marker(x) for x in lines] for lines in self.text]
        self.seen = [(int(i == 0), m, kind(rest), recorded(role) if i == 0 else -1) for role, marks in zip(self.role, self.marks, strict=True) for i, (m, rest) in enumerate(marks)]

    def steps(self, model: Model, first: bool) -> list[np.ndarray]:
        """Step matrices of the lines; the first line of a conversation has the starting chances in all rows."""
        out, at = [], 0
        emission = model.emission(self.seen)
        for lines in self.text:
            for i in range(len(lines)):
                move = model.start[None].repeat(S, axis=0) if first and not at else model.within if i else model.between
                out.append(move + emission[at])
                at += 1
        return out

    def rendered(self, path: list[int]) -> Iterator[tuple]:
        """(turn, part, role, recovered, text) of the turns that a path of states gives."""
        at = 0
        for turn, role, lines, marks in zip(self.turn, self.role, self.text, self.marks, strict=True):
            parts: list[tuple[int, bool, list[str]]] = []
            for line, (m, rest) in zip(lines, marks, strict=True):
                state, at = path[at], at + 1
                if state % 2 == 0:
                    parts.append((state // 2, m == state // 2, []))
                    line = rest if parts[-1][1] else line
                parts[-1][2].append(_END.sub("", line))
            # empty lines before the first marker are no turn
            shown = [x for x in parts if x[1] or any(y.strip() for y in x[2])] or parts[:1]
            for part, (now, _, body) in enumerate(shown):
                yield turn, part, ROLES[now], recorded(role) != now, "\n".join(body).strip("\n")


def _groups(block: pa.Table, *keys: str) -> Iterator[tuple[int, int]]:
    columns = [block.column(k).to_numpy() for k in keys]
    new = np.zeros(block.num_rows, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    bounds = np.append(np.flatnonzero(new), block.num_rows)
    yield from zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


PARTS = "conv_id bigint, seg bigint, matrix array<double>"


def _matrices(model: Model) -> Callable:
    """One matrix for each segment, from its turns."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "_g"):
            rows = []
            for lo, hi in _groups(block, "conv_id", "seg"):
                total = None
                for step in Turns(block, lo, hi).steps(model, block.column("rank")[lo].as_py() == 0):
                    total = step if total is None else _product(total, step)
                rows.append((block.column("conv_id")[lo].as_py(), block.column("rank")[lo].as_py(), total.ravel()))
            yield _batch(rows, PARTS)

    return of


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the matrices of FAN neighbours."""
    for block in whole_groups(batches, "_g"):
        rows = []
        for lo, hi in _groups(block, "conv_id", "above"):
            total = None
            for k in range(lo, hi):
                step = np.array(block.column("matrix")[k].as_py()).reshape(S, S)
                total = step if total is None else _product(total, step)
            rows.append((block.column("conv_id")[lo].as_py(), block.column("above")[lo].as_py(), total.ravel()))
        yield _batch(rows, PARTS)


STATES = "conv_id bigint, seg bigint, entry int, leave int"


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each of FAN neighbours, from those before and after all of them."""
    for block in whole_groups(batches, "_g"):
        rows = []
        for lo, hi in _groups(block, "conv_id", "above"):
            steps = [np.array(x).reshape(S, S) for x in block.column("matrix")[lo:hi].to_pylist()]
            entry, leave = block.column("entry")[lo].as_py(), block.column("leave")[lo].as_py()
            path = _best(steps, entry, leave)
            for k, (a, b) in enumerate(zip([entry, *path[:-1]], path, strict=True)):
                rows.append((block.column("conv_id")[lo].as_py(), block.column("seg")[lo + k].as_py(), a, b))
        yield _batch(rows, STATES)


TURNS = "conv_id bigint, turn bigint, part int, role string, recovered boolean, text string"


def _decoded(model: Model) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "_g"):
            rows = []
            for lo, hi in _groups(block, "conv_id", "seg"):
                turns = Turns(block, lo, hi)
                entry, leave = block.column("entry")[lo].as_py(), block.column("leave")[lo].as_py()
                path = _best(turns.steps(model, entry < 0), entry, leave)
                conv = block.column("conv_id")[lo].as_py()
                rows.extend((conv, *x) for x in turns.rendered(path))
            yield _batch(rows, TURNS)

    return of


def _sorted_groups(df: DataFrame, *keys: str) -> DataFrame:
    order = [c for c in ("turn", "role", "text") if c in df.columns] or ["seg"]
    return df.withColumn("_g", F.xxhash64(*keys)).repartition("_g").sortWithinPartitions("_g", *keys, *order)


COUNTED = "role int, kind int, lines bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(ROLES), len(KINDS) + 1), np.int64)  # the last column counts turns
    for batch in batches:
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (r := recorded(role)) >= 0:
                counts[r, -1] += 1
                for line in (text or "").split("\n"):
                    counts[r, kind(marker(line)[1])] += 1
    yield _batch([(r, k, int(n)) for (r, k), n in np.ndenumerate(counts) if n], COUNTED)


def fit(rows: DataFrame) -> Model:
    """The model's counts over all stored turns whose recorded role is known; only sums reach the driver."""
    n = len(ROLES)
    kinds, ends = np.zeros((n, len(KINDS))), np.zeros(n)
    for r in rows.select("role", "text").mapInArrow(_count, COUNTED).groupBy("role", "kind").agg(F.sum("lines").alias("n")).collect():
        if r["kind"] < len(KINDS):
            kinds[r["role"], r["kind"]] = r["n"]
        else:
            ends[r["role"]] = r["n"]
    names = F.create_map(*(F.lit(x) for pair in ROLE_OF.items() for x in pair))
    known = rows.select("conv_id", "turn", F.get(F.array(*(F.lit(k) for k in range(n))), F.element_at(names, F.lower(F.trim("role")))).alias("r")).where("r is not null").distinct()
    after = known.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("before"))
    follow, begin = np.zeros((n, n)), np.zeros(n)
    for x in known.join(after, ["conv_id", "turn"]).groupBy("before", "r").count().collect():
        follow[x["before"], x["r"]] = x["count"]
    for x in known.groupBy("conv_id").agg(F.min(F.struct("turn", "r")).alias("x")).groupBy("x.r").count().collect():
        begin[x["r"]] = x["count"]
    return Model(begin, follow, ends, kinds.sum(axis=1), kinds)


def canonical(turns: DataFrame) -> DataFrame:
    """turns with `rendered`: a line with the role, the text, and an end mark."""
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def parse_transcripts(conversations: DataFrame, model: Model | None = None, segment: int = SEGMENT) -> DataFrame:
    """Turns recovered from conversations (conv_id, turn, role, text): roles are names, aliases or null.

    A stored turn always begins a turn; speaker markers inside it may begin more of them (a whole transcript
    can be one row). conv_id, turn, part (its number in the stored turn), role, recovered (the role was not
    recorded, or another one), text (without the marker). Equal rows count once; different rows of one turn
    number follow each other by role and text; a null or empty text is a turn with empty text; a null turn
    comes first, as turn number -1; a null conv_id is left out; other columns are ignored; an empty table
    gives an empty table.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null").distinct()
    rows = store(rows.withColumn("seg", F.floor(F.col("turn") / segment)), "turns")
    model = model or fit(rows)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    # segments are numbered within their conversation; most conversations have one
    segs = rows.select("conv_id", "seg").distinct()
    several = segs.groupBy("conv_id").agg(F.min("seg").alias("first"), F.max("seg").alias("last")).where("first < last")
    several = store(several.withColumn("span", F.col("last") - F.col("first")), "several")
    one = rows.join(several, "conv_id", "left_anti").withColumns({"entry": F.lit(-1), "leave": F.lit(-1)})
    out = _sorted_groups(one, "conv_id", "seg").mapInArrow(lambda b: _decoded(sent.value)(b), TURNS)
    widest = several.agg(F.max("span")).first()[0]
    if widest is None:
        return out
    long = rows.join(several.select("conv_id", "first"), "conv_id").withColumn("rank", F.col("seg") - F.col("first"))
    levels = [store(_sorted_groups(long, "conv_id", "seg").mapInArrow(lambda b: _matrices(sent.value)(b), PARTS), "level0")]
    while (widest := widest // FAN) > 0:
        above = levels[-1].withColumn("above", F.floor(F.col("seg") / FAN))
        levels.append(store(_sorted_groups(above, "conv_id", "above").mapInArrow(_combine, PARTS), f"level{len(levels)}"))
    top = levels[-1].withColumns({"above": F.lit(0).cast("bigint"), "entry": F.lit(-1), "leave": F.lit(-1)})
    states = store(_sorted_groups(top, "conv_id", "above").mapInArrow(_handed_down, STATES), "states")
    for level in reversed(levels[:-1]):
        known = states.select("conv_id", F.col("seg").alias("above"), "entry", "leave")
        down = level.withColumn("above", F.floor(F.col("seg") / FAN)).join(known, ["conv_id", "above"])
        last, states = states, store(_sorted_groups(down, "conv_id", "above").mapInArrow(_handed_down, STATES), "states")
        release(last)
    release(*levels)
    ready = long.join(states.withColumnRenamed("seg", "rank"), ["conv_id", "rank"]).drop("first", "rank")
    return out.unionByName(_sorted_groups(ready, "conv_id", "seg").mapInArrow(lambda b: _decoded(sent.value)(b), TURNS))
