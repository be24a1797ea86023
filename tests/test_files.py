import json

import pytest
from pyspark.sql import functions as F

from retroscope.operators import cleaning
from retroscope.sources import files


@pytest.mark.parametrize("ending", ["", ".csv", ".json"])
def test_round_trip(spark, tmp_path, ending):
    rows = [(1, "a", 1.5), (2, None, None)]
    df = spark.createDataFrame(rows, "id bigint, name string, x double")
    files.write(df, f"{tmp_path}/t{ending}")
    assert sorted(map(tuple, files.read(spark, f"{tmp_path}/t{ending}", "id bigint, name string, x double").collect())) == rows


def test_security_from_the_file_and_markets(spark, tmp_path):
    for market, name, days in (("x", "AAA", [1, 2]), ("x", "B-B", [1]), ("y", "AAA", [2, 3])):
        folder = tmp_path / market
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.csv").write_text("session,close\n" + "".join(f"200{d}-01-05,{d}.5\n" for d in days) + "2001-02-01,\n")
    one = files.per_security(spark, f"{tmp_path}/x/*.csv", "session")
    assert sorted((r.security, str(r.session), r.close) for r in one.collect()) == [("AAA", "2001-01-05", 1.5), ("AAA", "2001-02-01", None), ("AAA", "2002-01-05", 2.5), ("B-B", "2001-01-05", 1.5), ("B-B", "2001-02-01", None)]
    both = files.tagged(spark, {"X": f"{tmp_path}/x/*.csv", "again": f"{tmp_path}/x/*.csv", "Y": f"{tmp_path}/y/*.csv"}, "session", ["close"], (2003,))
    assert sorted((r.market, r.security, r.close) for r in both.collect()) == [("X", "AAA", 1.5), ("X", "AAA", 2.5), ("X", "B-B", 1.5), ("Y", "AAA", 2.5)]


def test_vectors(spark):
    wide = spark.createDataFrame([(1, 0.5, 1.5, 9.0)], "id bigint, v0 double, v1 double, v10 double")
    folded = files.to_vector(wide, "v")
    assert folded.first()["vector"] == [0.5, 1.5, 9.0]
    assert tuple(files.to_columns(folded, "w", 4).first()) == (1, 0.5, 1.5, 9.0, None)


def test_checked_tables(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    files.write_bundle({"a": df, "b": df.limit(0)}, f"{tmp_path}/bundle")
    got = files.read_bundle(spark, f"{tmp_path}/bundle", ["a", "b"])
    assert got["a"].count() == 10 and got["b"].count() == 0
    assert files.digest(df) == files.digest(df.repartition(3).orderBy(F.desc("id")))
    df.limit(9).write.mode("overwrite").parquet(f"{tmp_path}/bundle/a")
    with pytest.raises(ValueError):
        files.read_checked(spark, f"{tmp_path}/bundle/a")


def test_json_lines(spark):
    df = spark.createDataFrame([(2.5, "x", None)], "b double, a string, c bigint")
    assert files.json_lines(df).first()["json"] == '{"a":"x","b":2.5,"c":null}'
    with pytest.raises(Exception, match="not finite"):
        files.json_lines(spark.createDataFrame([(float("nan"),)], "b double")).collect()


def test_sessions_and_lists(spark, tmp_path):
    (tmp_path / "america.csv").write_text("session\n2001-01-02\n2001-01-02\n2001-01-03\n")
    assert files.sessions(spark, str(tmp_path), "USA").count() == 2
    assert files.sessions(spark, str(tmp_path), "asia", strict=False).count() == 0
    with pytest.raises(ValueError):
        files.sessions(spark, str(tmp_path), "atlantis")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.sessions(spark, str(tmp_path), "asia")
    (tmp_path / "names.json").write_text(json.dumps({"a": ["X", {"b": ["Y", "X"]}], "c": "Z"}))
    assert files.listed(f"{tmp_path}/names.json") == ["X", "Y", "Z"]


def test_guards(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, w double")
    assert cleaning.checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeats"):
        cleaning.checked_join(right, left, ["k"]).collect()
    with pytest.raises(Exception, match="repeats"):
        cleaning.checked_join(left, right, ["k"], one_left=True).collect()
    cleaning.require_disjoint(["momentum"], ["future_return_21"])
    with pytest.raises(ValueError):
        cleaning.require_disjoint(["momentum", "future_x"], ["y"])
    assert cleaning.known_columns(["a", "b"], ["b", "c"]) == ["b"]
    with pytest.raises(ValueError):
        cleaning.known_columns(["a"], ["b"])
