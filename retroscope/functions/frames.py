"""Row frames over whole columns of one security, for operators whose frames are wide.

A window of the engine adds up a frame anew for each row. Here a security's rows, which a calendar bounds, come as one
table, and numpy works on all frames of a column at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def per_security(rows: DataFrame, of: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], read: list[str], added: str, key: str = "security", order: str = "session") -> DataFrame:
    """rows with the columns of `added` (DDL), which `of` makes from the columns of read, sorted, as arrays; NaN is null."""
    names = [f.name for f in StructType.fromDDL(added)]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).combine_chunks()
        made = of({c: table[c].to_numpy() for c in read})
        for name in names:
            x = made[name]
            table = table.append_column(name, pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" else pa.array(x))
        return table

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(added).fields])
    return rows.groupBy(key).applyInArrow(one, schema)


def before(x: np.ndarray, k: int = 1) -> np.ndarray:
    """x as of k rows before, NaN in the first ones."""
    return np.concatenate((np.full(min(k, x.size), np.nan), x[: max(0, x.size - k)]))


def change(x: np.ndarray, k: int = 1) -> np.ndarray:
    """x over its value k rows before, less 1; NaN where that is 0 or missing."""
    last = before(x, k)
    return np.divide(x, last, out=np.full(x.size, np.nan), where=last != 0) - 1


def full(x: np.ndarray, rows: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f of each frame of that many rows (one frame a line), NaN before the first full one."""
    out = np.full(x.size, np.nan)
    if x.size >= rows:
        out[rows - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, rows))
    return out


def mean(x: np.ndarray, rows: int) -> np.ndarray:
    return full(x, rows, lambda v: v.mean(axis=1))


def deviation(x: np.ndarray, rows: int) -> np.ndarray:
    return full(x, rows, lambda v: v.std(axis=1, ddof=1))


def highest(x: np.ndarray, rows: int) -> np.ndarray:
    """Maxima of the last rows, fewer of them at the begin."""
    return full(np.concatenate((np.full(rows - 1, -np.inf), x)), rows, lambda v: v.max(axis=1))[rows - 1 :]


def total(x: np.ndarray, rows: int, least: int) -> np.ndarray:
    """Sums of whole numbers over the last rows, at least `least` of them."""
    sums = np.concatenate(([0.0], np.cumsum(x)))
    at = np.arange(1, x.size + 1)
    out = sums[at] - sums[np.maximum(at - rows, 0)]
    return np.where(at >= least, out, np.nan)


def ahead(x: np.ndarray, rows: int) -> np.ndarray:
    """A line for each row: the values of the next rows, NaN after the last."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((x[1:], np.full(rows, np.nan))), rows)[: x.size]
