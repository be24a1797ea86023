"""File sources and sinks: per-security files, tagged panels, vectors, checked tables with their digests, bundles."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its ending: .csv with a header, .json with a row per line, else Parquet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.json(path) if path.endswith(".json") else reader.parquet(path)


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    if path.endswith(".csv"):
        writer.csv(path, header=True)
    elif path.endswith(".json"):
        writer.json(path)
    else:
        writer.parquet(path)


def per_security(spark: SparkSession, pattern: str, order: str, schema: str | None = None) -> DataFrame:
    """All files that match, a security each: its name is the file's without the ending. Of rows with one security and
    value of order the one of the file whose path is last stays."""
    rows = read(spark, pattern, schema).withColumn("_path", F.col("_metadata.file_path"))
    name = F.regexp_extract("_path", r"([^/]+?)(\.[A-Za-z0-9]+)*$", 1)
    last = F.row_number().over(Window.partitionBy("security", order).orderBy(F.col("_path").desc()))
    return rows.withColumn("security", name).withColumn("_place", last).where("_place = 1").drop("_path", "_place")


def tagged(spark: SparkSession, sources: dict[str, str], order: str, required: list[str], without_years: tuple[int, ...] = ()) -> DataFrame:
    """The files of several markets as one table with the column market; rows of the years left out, and rows without
    a required value, are not in it. A pattern that is given twice is read once."""
    seen: set[str] = set()
    out = None
    for market, pattern in sources.items():
        if pattern in seen:
            continue
        seen.add(pattern)
        part = per_security(spark, pattern, order).withColumn("market", F.lit(market))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    out = out.dropna(subset=required)
    return out.where(~F.year(order).isin(*without_years)) if without_years else out


def to_vector(df: DataFrame, prefix: str, column: str = "vector") -> DataFrame:
    """Columns prefix0, prefix1, ... as one array."""
    names = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.withColumn(column, F.array(*(F.col(c).cast("double") for c in names))).drop(*names)


def to_columns(df: DataFrame, prefix: str, size: int, column: str = "vector") -> DataFrame:
    """An array as columns; where it is shorter, the last ones are null."""
    return df.withColumns({f"{prefix}{i}": F.get(column, i) for i in range(size)}).drop(column)


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a number that all rows fix whatever their order: the sum of their hashes. Map columns are not allowed."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], str(row["s"])


def write_checked(df: DataFrame, path: str) -> dict:
    """A Parquet table with a companion table path.meta (columns, rows, digest), written after it; returns the companion."""
    df.write.parquet(path)
    n, total = digest(df.sparkSession.read.parquet(path))
    meta = {"columns": ",".join(f"{k}:{v}" for k, v in df.dtypes), "rows": n, "digest": total}
    df.sparkSession.createDataFrame([meta], "columns string, rows bigint, digest string").coalesce(1).write.json(f"{path}.meta")
    return meta


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """A table of write_checked; fails where it is not the one that was written."""
    df = spark.read.parquet(path)
    meta = spark.read.schema("columns string, rows bigint, digest string").json(f"{path}.meta").first()
    if meta is None or (meta["rows"], meta["digest"]) != digest(df) or meta["columns"] != ",".join(f"{k}:{v}" for k, v in df.dtypes):
        raise ValueError(f"{path} is not the table that was written")
    return df


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Several checked tables in one folder."""
    for name, df in tables.items():
        write_checked(df, f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: read_checked(spark, f"{path}/{name}") for name in names}


def json_lines(df: DataFrame) -> DataFrame:
    """A column json with the row, keys in order of name; a number that is no number fails the job."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    bad = F.lit(False)
    for c in floats:
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a value is not finite"))).otherwise(text).alias("json"))


ALIASES = {"us": "AMERICA", "usa": "AMERICA", "america": "AMERICA", "eu": "EUROPE", "europe": "EUROPE", "asia": "ASIA", "africa": "AFRICA", "middle east": "MIDDLE EAST", "me": "MIDDLE EAST"}


def sessions(spark: SparkSession, folder: str, market: str, strict: bool = True) -> DataFrame:
    """market, session from folder/<market>.csv, where the market may go by another name; without a file it fails, or,
    not strict, gives no sessions."""
    name = ALIASES.get(market.strip().lower())
    if name is None:
        raise ValueError(f"unknown market {market!r}")
    path = f"{folder}/{name.lower().replace(' ', '_')}.csv"
    empty = spark.createDataFrame([], "market string, session date")
    try:
        rows = read(spark, path, "session date")
    except Exception as e:
        if strict or "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    return rows.select(F.lit(name).alias("market"), "session").distinct()


def listed(path: str) -> list[str]:
    """Names of a JSON file of lists, nested as they may be, each once and in order."""
    with open(os.path.expanduser(path)) as f:
        found: dict[str, None] = {}
        todo = [json.load(f)]
        while todo:
            x = todo.pop(0)
            if isinstance(x, dict):
                todo[:0] = x.values()
            elif isinstance(x, list):
                todo[:0] = x
            elif x is not None:
                found[str(x).strip()] = None
    return list(found)
