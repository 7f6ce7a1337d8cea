"""Readers on small files and odd inputs."""

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import parse
from tidepanel.sources import readers as rd, sinks


@pytest.mark.parametrize(
    "text, want",
    [
        ('"timestamp";"target"\n2024-01-01 00:00:00;1\n2024-01-01 01:00:00;2\n', [1.0, 2.0]),
        ("﻿ timestamp , target\n2024-01-01,1.5\n2024-01-02,2.5\n", [1.5, 2.5]),
        ("Source,x\nUpdated\n\ndate,series,value\n2024-01-01,a,7\n2024-01-02,a,8\n", [7.0, 8.0]),
        ("ts2\tdate\tclose\nx\t2024-01-01\t3\n", [3.0]),
    ],
)
def test_csv(spark, tmp_path, text, want):
    f = tmp_path / "x.csv"
    f.write_text(text, encoding="utf-8")
    p = rd.to_panel(rd.read_csv(spark, str(f)))
    assert [r.y for r in p.orderBy("ts").collect()] == want


def test_csv_keeps_quotes_breaks_and_ragged_rows(spark, tmp_path):
    preamble = "".join(f"note line {i}\n" for i in range(30))
    for top in ("", preamble):
        f = tmp_path / f"q{len(top)}.csv"
        f.write_text(top + 'id,date,value,text\na,2024-01-01,1,"q ""x, y"" z"\nb,2024-01-02,2,"one\ntwo"\nc,2024-01-03,3\nd,2024-01-04,4,t,extra,more\n')
        rows = sorted(tuple(r) for r in rd.read_csv(spark, str(f)).collect())
        assert rows == [("a", "2024-01-01", "1", 'q "x, y" z'), ("b", "2024-01-02", "2", "one\ntwo"), ("c", "2024-01-03", "3", None), ("d", "2024-01-04", "4", "t")]
        assert [r.record.strip() for r in rd.csv_rejects(spark, str(f)).collect()] == ["d,2024-01-04,4,t,extra,more"]


def test_csv_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,date,value\nx,2024-01-01,1\n")
    (tmp_path / "b.csv").write_text("date;value;id;note\n2024-01-02;2;y;n\n")
    rows = {(r.id, r.date, r.value, r.note) for r in rd.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {("x", "2024-01-01", "1", None), ("y", "2024-01-02", "2", "n")}


def test_directory_with_columns_in_any_order(spark, tmp_path):
    (tmp_path / "one.csv").write_text("date,value\n2024-01-01,1\n2024-01-02,2\n")
    (tmp_path / "two.csv").write_text("value,date\n5,2024-01-01\n6,2024-01-02\n")
    p = rd.read_csv_directory(spark, str(tmp_path))
    assert sorted((r.series_id, r.y) for r in p.collect()) == [("one", 1.0), ("one", 2.0), ("two", 5.0), ("two", 6.0)]


def test_indicator_matrix(spark, tmp_path):
    f = tmp_path / "wb.csv"
    f.write_text(
        'Data Source,World\nLast Updated,2024\n"Country Name","Country Code","Indicator Name","Indicator Code","1960","1961","1962"\n'
        'Aruba,ABW,Pop,SP,1,2,3\nAfghanistan,AFG,Pop,SP,,5,6\nNowhere,NWH,Pop,SP,,,\n'
    )
    long = rd.unpivot_indicators(rd.read_csv(spark, str(f)))
    got = {(r.series, r.timestamp): r.target for r in long.where("target is not null").collect()}
    assert got == {("ABW", "1960-01-01"): 1, ("ABW", "1961-01-01"): 2, ("ABW", "1962-01-01"): 3, ("AFG", "1961-01-01"): 5, ("AFG", "1962-01-01"): 6}
    assert long.where("series = 'NWH'").count() == 0


def test_named_files(spark, tmp_path):
    for name, v in (("North", 1), ("south", 5)):
        (tmp_path / f"{name}.csv").write_text("Datetime,MW\n" + "".join(f"2024-01-0{d},{v + d}\n" for d in range(1, 5)))
    p = rd.read_csv_directory(spark, str(tmp_path), keep=2)
    assert sorted((r.series_id, r.y) for r in p.collect()) == [("north", 4.0), ("north", 5.0), ("south", 8.0), ("south", 9.0)]


def test_roles(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, 2.0)], "Date string, foo double, bar double")
    with pytest.raises(rd.RoleError):
        rd.resolve_roles(df)
    assert rd.resolve_roles(df.drop("bar"))["target"] == "foo"
    assert rd.resolve_roles(df.withColumnRenamed("bar", "VALUE"))["target"] == "VALUE"


@pytest.mark.parametrize(
    "text, want",
    [
        ("1704067200", "2024-01-01 00:00:00"), ("1704067200000", "2024-01-01 00:00:00"), ("2024-01-01T05:06:07Z", "2024-01-01 05:06:07"),
        ("2024-01-01T05:06:07+09:00", "2024-01-01 05:06:07"), ("2024/2/3", "2024-02-03 00:00:00"), ("25/12/2023", "2023-12-25 00:00:00"),
        ("12/25/2023 10:30", "2023-12-25 10:30:00"), ("2024-13-01", None), ("", None), ("tomorrow", None),
    ],
)
def test_timestamps(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(F.date_format(parse.timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("x")).first()
    assert r.x == want


def test_identifiers_are_checked(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        rd.select_series(df, "a; drop table x", "b", "c")


def test_weights_keep_other_fingerprints(spark, tmp_path):
    path = str(tmp_path / "w")
    w = spark.createDataFrame([("a", 0.7)], "model string, weight double")
    sinks.save_weights(w, "f1", path)
    sinks.save_weights(w.withColumn("weight", F.lit(0.2)), "f2", path)
    assert sinks.load_weights(spark, path, "f1").first().weight == 0.7
    assert sinks.load_weights(spark, path, "nope").count() == 0
