"""Audit of how filters interact: which removes what in every order of them.

Each document has a mask of the filters that it fails. Signed parity sums (the Walsh-Hadamard transform of the counts
by mask) are added up per part and label: sum S is the number of documents that fail an even number of
the filters of S, less those that fail an odd number. They are plain sums, so parts of any size are added up where
the rows are. The transform is its own inverse but for a factor of 32, so the counts come back exactly, and every
order of the filters follows from the counts of 32 masks. A document that fails k filters is removed once in each
of the 120 orders, by each of the k in 120 / k of them; that gives the Shapley sums in closed form.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LABELS = ("all", "good", "toxic")


def _failures(text: Column) -> list[Column]:
    """What filters A to D find in a text that is not null, each as one bit of a long."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    found = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]"))
    return [F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(found)]


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for each row of docs: bit i of mask is set where the row fails filter i.

    A: fewer than 200 words. B: less than half of the words are distinct. C: more than 3 % of the code points are A-Z.
    D: holds one of #$%&*|. E: a smaller doc_id has the same text (by SHA-256); a null doc_id fails no E and
    is smaller than none, and rows that repeat a doc_id do not count against each other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = _failures(text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), (bits[0] + bits[1] + bits[2] + bits[3]).alias("mask"))
    # the id is in the key too, so the copies of one text are dealt to all tasks
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def parity_sums(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, sums): the 32 signed sums of masks (doc_id, part, mask), for all rows, good ones and toxic ones."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks.join(marks, "doc_id", "left")
    which = F.array_compact(F.array(F.lit(LABELS[0]), *(F.when(F.col(m), F.lit(m)) for m in LABELS[1:])))
    rows = rows.select("part", "mask", F.explode(which).alias("label"))
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    return rows.groupBy("part", "label").agg(F.array(*(F.sum(sign(s)) for s in range(MASKS))).alias("sums"))


def mask_counts(sums: DataFrame) -> DataFrame:
    """(part, label, cells): how many rows have each of the 32 masks, from their parity sums."""

    def count(m: Column) -> Column:
        signed = F.transform("sums", lambda w, s: w * (1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2)))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, b: a + b), 5)

    return sums.select("part", "label", F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), count).alias("cells"))


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))


def _total(cells: str, counts, value=lambda n, m: n) -> Column:
    """The sum over the masks that counts(mask) accepts."""
    taken = F.transform(cells, lambda n, m: F.when(counts(m), value(n, m)).otherwise(0))
    return F.aggregate(taken, F.lit(0).cast("bigint"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, of docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    part is lang, null as empty. Null texts are empty: they fail A. Of several labels of a doc_id one that says 1 is
    enough; null labels say nothing. An empty table gives no rows; other columns are ignored.
    """
    cells = mask_counts(parity_sums(masked(docs), labels))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), MASKS)
    wide = cells.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), zeros).alias(x) for x in LABELS))
    steps = wide.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.when(i < F.col("step"), _bit(F.substring("filter_order", i, F.lit(1)))).otherwise(0))
    steps = steps.withColumns({"_own": _bit(F.substring("filter_order", F.col("step"), F.lit(1))), "_before": F.aggregate(letters, F.lit(0), lambda a, b: a + b)})
    own, before = F.col("_own"), F.col("_before")
    hits = lambda m, bits: m.bitwiseAND(bits) != 0
    here = lambda m: hits(m, own) & ~hits(m, before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total("all", lambda m: ~hits(m, own.bitwiseOR(before))).alias("kept"),
        _total("all", here).alias("removed"),
        _total("all", lambda m: hits(m, own) & hits(m, before)).alias("redundant"),
        _total("all", lambda m: m == own).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        _total("all", lambda m: hits(m, own), lambda n, m: n * (len(ORDERS) / F.bit_count(m)).cast("bigint")).alias("shapley"),
    )
