"""Files, layouts and errors in series files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foreloom.functions.scalars import freq_to_interval
from foreloom.operators import timeseries as T
from foreloom.sources import files as S
from foreloom.sources import tsf

HEADER = ["# text", "@attribute series_name string", "@attribute start_timestamp date", "@frequency 10_minutes",
          "@horizon 4", "@missing true", "@equallength false", "@data"]


def write(tmp_path, lines):
    path = tmp_path / "x.tsf"
    path.write_bytes("\n".join(lines).encode("cp1252"))
    return str(path)


def test_series_file(spark, tmp_path):
    path = write(tmp_path, [*HEADER, "T1:2020-01-01 00-00-00:1.5,?,3", "T€:2020-01-01 00-00-00:4,5", "T3:2021-01-01 00-00-00:6"])
    meta = tsf.read_tsf_meta(spark, path)
    assert meta["frequency"] == "10_minutes" and meta["horizon"] == 4
    assert meta["missing"] and not meta["equallength"]
    series = tsf.read_tsf_series(spark, path).orderBy("place").collect()
    assert [r["series_name"] for r in series] == ["T1", "T€", "T3"]
    assert series[0]["series"] == [1.5, None, 3.0]
    values = tsf.read_tsf_values(spark, path, missing=0.0).orderBy("global_index").collect()
    assert [(r["time_index"], r["value"]) for r in values] == [(0, 1.5), (1, 0.0), (2, 3.0), (0, 4.0), (1, 5.0), (0, 6.0)]
    wide = tsf.read_tsf_aligned(spark, path).orderBy("index").collect()
    assert len(wide) == 2 and wide[1]["timestamp"] == dt.datetime(2020, 1, 1, 0, 1) and wide[0]["T€"] == 4.0


@pytest.mark.parametrize(
    "lines, message",
    [
        ([*HEADER, "T1:1,2"], "more or fewer fields"),
        (HEADER[:1] + HEADER[3:], "declares its attributes"),
        (HEADER[:-1], "opens the data section"),
    ],
)
def test_bad_series_files(spark, tmp_path, lines, message):
    with pytest.raises(Exception, match=message):
        tsf.read_tsf_series(spark, write(tmp_path, lines)).collect()


def test_series_of_missing_values_only(spark, tmp_path):
    path = write(tmp_path, [*HEADER, "T1:2020-01-01 00-00-00:?,?"])
    with pytest.raises(Exception, match="without any value"):
        tsf.read_tsf_series(spark, path, strict=True).collect()


def test_frequencies():
    assert freq_to_interval("10_minutes") == "10 minutes"
    assert freq_to_interval("half_hourly") == "1800 seconds"
    assert freq_to_interval("weekly") == "7 days"
    for bad in ("a_b_c", "x_days", "fortnightly"):
        with pytest.raises(ValueError):
            freq_to_interval(bad)


def test_layout_prunes_chunks(spark, folder, tmp_path):
    path = str(tmp_path / "layout")
    S.table_layout(spark.read.parquet(f"{folder}/lineitem.parquet"), path, "l_shipdate", ["l_partkey"])
    plan = spark.read.parquet(path).where("chunk = '1995-01-01'").select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan


def test_filters_reach_the_scan(spark, folder):
    from foreloom.functions import expressions as E

    df = spark.read.parquet(f"{folder}/part.parquet").where(E.above("p_size", 10)).select("p_partkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,10)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_integrate_needs_all_initial_values(spark):
    diffs = spark.createDataFrame([("a", 2, 1.0)], "k string, pos long, diff double")
    start = spark.createDataFrame([("a", 0, 1.0)], "k string, pos long, value double")
    with pytest.raises(Exception, match="as many first levels"):
        T.integrate(diffs, start, ["k"], 2).collect()


def test_gaps_are_carried_over(spark):
    rows = [("a", 1, "NULL"), ("a", 2, "3.5"), ("a", 3, "Infinity"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, ts int, v string")
    out = T.fill_gaps(df, ["k"], "ts", ["v"]).orderBy("k", "ts").collect()
    assert [r["v"] for r in out] == [0.0, 3.5, 3.5, 0.0]


def test_insert_ignore_keeps_the_stored_row(spark):
    old = spark.createDataFrame([(1, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "a"), (2, "b")], "id int, v string")
    out = S.insert_ignore(new, old, ["id"]).collect()
    assert [r["id"] for r in out] == [2]


def test_random_walk_is_repeatable(spark):
    a = S.generate_series_table(spark, 50, "random_walk").agg(F.sum("value")).first()[0]
    b = S.generate_series_table(spark, 50, "random_walk").agg(F.sum("value")).first()[0]
    assert a == b
