"""Calendar and resampling on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridspark.functions import noleap as nl
from gridspark.operators import time_axis as ta


def col(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_calendar_is_365_days(spark):
    c = ta.noleap_calendar(spark, 1901, 1904)
    assert c.count() == 4 * 365
    r = c.filter("t = 1154").first()  # 1904-03-01: no 29 February
    assert (r.year, r.month, r.doy, r.days_in_month) == (1904, 3, 60, 31)
    assert c.groupBy("month").count().filter("month = 2").first()["count"] == 4 * 28


def test_anchors(spark):
    ends = ta.noleap_calendar(spark, 1901, 1901, "month", "end")
    assert col(ends, "t", "t")[:3] == [30, 58, 89]
    assert col(ta.noleap_calendar(spark, 1902, 1903, "year", "start"), "t", "t") == [365, 730]


@pytest.mark.parametrize("leap_day,expected", [("feb28", [1153, 1153, 1154]), ("clamp28", [1153, 1153, 1154])])
def test_leap_day_joins_the_28th(spark, leap_day, expected):
    days = [datetime.datetime(1904, 2, 28), datetime.datetime(1904, 2, 29), datetime.datetime(1904, 3, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    assert col(df.select(nl.date_to_day("d", leap_day).alias("t")), "t") == expected


def test_date_strings_round_trip(spark):
    df = spark.createDataFrame([("1901-01-01",), ("1999-12-31",), ("2023-03-01",)], "s string")
    d = df.withColumn("t", nl.date_string_to_day("s")).withColumn("back", nl.day_to_date_string("t"))
    assert [(r.s == r.back, r.t == nl.day_literal(r.s)) for r in d.collect()] == [(True, True)] * 3


def test_trim_half_open(spark):
    df = spark.createDataFrame([("a", t) for t in range(10)], "k string, t int")
    assert col(ta.trim(df, ["k"], 2, 5), "t", "t") == [2, 3, 4]
    assert col(ta.trim(df, ["k"], -3, None), "t", "t") == [7, 8, 9]
    assert col(ta.trim(df, ["k"], 0, -8), "t", "t") == [0, 1]


def test_replace_axis_needs_equal_length(spark):
    df = spark.createDataFrame([("a", t, 1.0 * t) for t in range(3)], "k string, t int, value double")
    axis = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "pos int, t int")
    assert col(ta.replace_axis(df, ["k"], axis, axis_len=3), "t", "t") == [100, 200, 300]
    with pytest.raises(Exception, match="series has 3 steps"):
        ta.replace_axis(df, ["k"], axis, axis_len=4).collect()


def test_cadence(spark):
    rows = [("y", 365 * i) for i in range(4)] + [("d", i) for i in range(4)] + [("m", t) for t in (0, 31, 59)] + [("s", 1)]
    d = ta.infer_cadence(spark.createDataFrame(rows, "k string, t int"), ["k"])
    assert {r.k: r.cadence for r in d.collect()} == {"y": "annual", "d": "daily", "m": "monthly", "s": "monthly"}


def test_repeat_last_continues_the_step(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 2.0), ("b", 5, 3.0)], "k string, t int, value double")
    d = ta.repeat_last(df, ["k"], 2)
    assert [(r.k, r.t, r.value) for r in d.orderBy("k", "t").collect()] == [
        ("a", 0, 1.0), ("a", 10, 2.0), ("a", 20, 2.0), ("a", 30, 2.0), ("b", 5, 3.0), ("b", 6, 3.0), ("b", 7, 3.0)]


def test_cycle_first(spark):
    df = spark.createDataFrame([(1901 + i, float(i)) for i in range(5)], "year int, value double")
    d = ta.cycle_first(df, 2, 1901, 1907)
    assert [r.value for r in d.orderBy("year").collect()] == [0, 1, 0, 1, 0, 1, 0]


def test_population_index(spark):
    years = spark.range(1901, 2024).withColumnRenamed("id", "year")
    i = {r.year: r.i for r in years.withColumn("i", ta.population_index(F.col("year"))).collect()}
    assert [i[y] for y in (1901, 1908, 1909, 1918, 1919, 1948, 1949, 2023)] == [0, 0, 1, 1, 2, 4, 5, 79]


def test_hold_to_daily_and_back(spark):
    m = spark.createDataFrame([(1901, k, float(k)) for k in range(1, 13)], "year int, month int, value double")
    d = ta.monthly_to_daily(m)
    assert d.count() == 365
    back = ta.day_to_month(d, [])
    assert {r.month: r.value for r in back.collect()} == {k: float(k) for k in range(1, 13)}
