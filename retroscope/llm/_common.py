"""Shared pieces of the text operators: shared-storage tables, grouped Arrow streams, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1, MIX2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)


_OWN: dict[str, str] = {}


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='retroscope-')}")


def store(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table to the shared folder and read from there.

    The table survives the loss of executors and cuts the lineage; `release` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _register(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_STORED: dict[str, SparkSession] = {}


def _register(spark: SparkSession, path: str) -> None:
    if not _STORED:
        atexit.register(lambda: [_delete(s, p) for p, s in list(_STORED.items())])
    _STORED[path] = spark


def _delete(spark: SparkSession, path: str) -> None:
    _STORED.pop(path, None)
    try:
        jvm = spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be over; the folder is scratch space
        pass


def release(*stored: DataFrame) -> None:
    """Delete tables made by `store` that no later step reads."""
    for df in stored:
        _delete(df.sparkSession, df._stored_at)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> pa.Array:
    """A string column as bytes, null as empty."""
    return column.cast(pa.large_binary()).fill_null(b"")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a long key by which the stream is sorted."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if pending and pending[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(pending)
            pending = []
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if other.size else 0
        if cut:
            yield pa.Table.from_batches([*pending, batch.slice(0, cut)])
            pending = []
        pending.append(batch.slice(cut))
    if pending:
        yield pa.Table.from_batches(pending)


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [keys.size]))


def grouped(df: DataFrame, key: str) -> DataFrame:
    """df dealt out and sorted by key, for `whole_groups`."""
    return df.repartition(key).sortWithinPartitions(key)


def tiles(df: DataFrame, key: str, member: Column, blocks: Column) -> DataFrame:
    """Split the groups of key into tiles, so that each pair of members meets in at least one tile.

    A group with `blocks` above 1 is cut by a hash of the member into so many blocks; a tile joins two
    blocks (or holds one), so no task gets more than two of them. Adds the long column `_tile`.
    """
    b = F.pmod(F.xxhash64(member, F.lit(7)), blocks)
    other = F.explode(F.when(blocks <= 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint"))))
    df = df.withColumn("_b", b.cast("bigint")).withColumn("_o", other)
    many = F.xxhash64(F.col(key), F.least("_b", "_o"), F.greatest("_b", "_o"))
    return df.withColumn("_tile", F.xxhash64(F.col(key), F.when(blocks <= 1, F.lit(0).cast("bigint")).otherwise(many))).drop("_b", "_o")


#: Rows of a group up to which it is shuffled as a whole, and the number of larger groups that are broadcast at most.
WHOLE, BROADCAST = 1000, 50_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of groups, which has a row for each value of key, and how many of the rows have it (size).

    The rows of a large group are not shuffled: what belongs to it is broadcast. Of total rows no more than
    BROADCAST groups can be that large.
    """
    bound = max(WHOLE, total // BROADCAST)
    large = F.broadcast(groups.where(F.col(size) > bound))
    rest = rows.join(F.broadcast(groups.where(F.col(size) > bound).select(key)), key, "left_anti").join(groups.where(F.col(size) <= bound), key)
    return rows.join(large, key).unionByName(rest)


def _led(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with the m of their a. Both are joined by a turned key, so the minima, a row per node, are shuffled once more
    and the edges of one node need not lie in one task."""
    turned = lambda df: df.withColumn("_k", F.col("a").bitwiseXOR(F.lit(1)))
    return turned(edges).join(turned(low).drop("a"), "_k").drop("_k")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are a table in shared storage, and
    what is compared on the driver between rounds is a count and a checksum. Smallest neighbours come from
    partial minima; adaptive execution can split the edges of a hub that are joined with them (`_led`).
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _sum_of(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _led(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _led(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = store(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        release(now)
        now, last, seen = after, seen, _sum_of(after)
        if seen == last:
            break
    roots = now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


SEEDS = range(4)


def representatives(member: str) -> Column:
    """An aggregate: the smallest hash of a group's members under each of four seeds, which names up to four of them."""
    return F.array(*(F.min(F.xxhash64(member, F.lit(s))) for s in SEEDS))


def _represents(member: str, reps: str) -> Column:
    tests = [F.xxhash64(member, F.lit(s)) == F.get(reps, s) for s in SEEDS]
    return tests[0] | tests[1] | tests[2] | tests[3]


def linked_in_blocks(rows: DataFrame, key: str, columns: list[str], links: Callable, schema: str, name: str) -> DataFrame:
    """Edges that `links` finds between the rows of each group of key, so that every group falls into the same
    components as if all its rows had met.

    rows: key, doc_id, `_blocks`, `_reps` (`representatives` of the group), and columns. A group with one block meets as a
    whole. Others are cut by a hash of the member, and the representatives are in each block; where that leaves
    a group in several components, all pairs of its blocks meet (`tiles`).
    """
    at = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("_blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)
    place = F.when(F.col("_blocks") <= 1, F.array(F.lit(0).cast("bigint"))).when(_represents("doc_id", "_reps"), every).otherwise(F.array(at.cast("bigint")))
    first = rows.withColumn("_at", F.explode(place)).withColumn("_tile", F.xxhash64(key, "_at")).select("_tile", "doc_id", *columns)
    found = store(grouped(first, "_tile").mapInArrow(links, schema), name)
    cut = rows.where("_blocks > 1").select(key, "doc_id")
    if cut.isEmpty():
        return found
    cut = store(cut, name)
    parts = connected_components(found.join(cut.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi"), name)
    apart = cut.join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("_c")), "doc_id", "left").withColumn("_c", F.coalesce("_c", "doc_id"))
    apart = store(apart.groupBy(key).agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).where("_a <> _b").select(key), name)
    if apart.isEmpty():
        return found
    again = tiles(rows.join(apart, key, "left_semi"), key, F.col("doc_id"), F.col("_blocks")).select("_tile", "doc_id", *columns)
    return found.unionByName(grouped(again, "_tile").mapInArrow(links, schema))


def _sum_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
