"""Displayed dates: parsing, zones, and the two display parsers."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from zbior.functions import dates
from zbior.operators import zones

WARSAW = ZoneInfo("Europe/Warsaw")
FETCHED = datetime(2021, 3, 28, 22, 30, 5)  # 2021-03-29 00:30:05 in Warsaw


def local(*x):
    return int(datetime(*x, tzinfo=WARSAW).timestamp())


CASES = [
    ("14 lis 2006, 15:55", local(2006, 11, 14, 15, 55)), ("2 czerwca 2017, 13:21", local(2017, 6, 2, 13, 21)), ("Śr mar 16, 2005 11:07 pm", local(2005, 3, 16, 23, 7)),
    ("N sty 20, 2019 12:05 am", local(2019, 1, 20, 0, 5)), ("2014-03-16, 20:49", local(2014, 3, 16, 20, 49)), ("2014-07-24T23:38:33+02:00", 1406237913),
    ("Fri, 06 Apr 2012 00:06:19 +0200", 1333663579), ("1251148257645", 1251148257), ("1614272087", 1614272087), ("20140208T002809Z", 1391819289), ("20130619", local(2013, 6, 19)),
    ("2004-10-31 02:02:56 CEST", 1099180976), ("31/03/2023 06:09", local(2023, 3, 31, 6, 9)), ("25.07.05 02:11", local(2005, 7, 25, 2, 11)), ("14.04.2018, 06:16 GMT+3", 1523675760),
    ("11 listopada 2007 r., godz. 12.39", local(2007, 11, 11, 12, 39)), ("26 kwi 2010", local(2010, 4, 26)), ("2013-10-01 17:32:48 -0500", 1380666768), ("\xa012 sty 2022, 23:36\n", local(2022, 1, 12, 23, 36)),
    ("2021-03-21 20:59:49.774", local(2021, 3, 21, 20, 59, 49)), ("dzisiaj, 8:12", local(2021, 3, 29, 8, 12)), ("Wczoraj, 17:30", local(2021, 3, 28, 17, 30)), ("21 min. temu", 1616970605 - 21 * 60), ("4 godz. temu", 1616970605 - 4 * 3600),
    ("wczoraj, 2:30", local(2021, 3, 28, 3, 30)), ("30.10.2011 02:59", int(datetime(2011, 10, 30, 0, 59, tzinfo=timezone.utc).timestamp())), ("29.03.2020 02:55", int(datetime(2020, 3, 29, 1, 55, tzinfo=timezone.utc).timestamp())),
    ("2019-01-05 25:99", local(2019, 1, 5)),
]
NO_DATES = ["", "  ", "Nigdy", "maj", "2013", "-", "n/d", "0000-00-00 00:00:00", "30.02.2016 12:15", "31 lut 2011, 10:00", "2015-13-40 08:00", "Śr", "dawno temu", "12345678901"]


def test_instants(spark):
    rows = [(t, FETCHED, e) for t, e in CASES] + [(t, FETCHED, None) for t in NO_DATES] + [(None, FETCHED, None), ("dzisiaj", None, None)]
    df = spark.createDataFrame(rows, "raw string, at timestamp_ntz, epoch_s long").withColumnRenamed("epoch_s", "wanted").withColumn("date_state", F.lit("x"))
    out = zones.to_instants(df, "raw", "at").collect()
    assert [(r.raw, r.epoch_s) for r in out if r.epoch_s != r.wanted] == []
    states = {r.raw: r.date_state for r in out}
    assert states["30.10.2011 02:59"] == "ambiguous" and states["29.03.2020 02:55"] == "nonexistent"
    assert states[None] == "missing" and states["maj"] == "no_date" and states["21 min. temu"] == "relative"


def test_every_hour_of_transitions_agrees_with_the_library(spark):
    walls = [datetime(y, m, d) + timedelta(minutes=20 * i) for y in (1950, 1977, 1995, 2016, 2030) for m, d in ((3, 25), (9, 24), (10, 24)) for i in range(72 * 8)]
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M:%S"), FETCHED) for w in walls], "raw string, at timestamp_ntz")
    got = {r.raw: r.epoch_s for r in zones.to_instants(df, "raw", "at").collect()}
    for w in walls:
        want = int(w.replace(tzinfo=WARSAW, fold=0).timestamp())
        assert got[w.strftime("%Y-%m-%d %H:%M:%S")] == want


def test_no_shuffle_and_empty_table(spark):
    df = spark.createDataFrame([], "raw string, at timestamp_ntz")
    out = zones.to_instants(df, "raw", "at")
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize(
    ("text", "board", "stored"),
    [
        ("Śr mar 16, 2005 11:07 pm", "2005-03-16 23:07:00", None), ("27 lip 2025, 16:46", "2025-07-27 16:46:00", "2025-07-27 16:46:00"), ("21 maja 2022, 17:58", "2022-05-21 17:58:00", "2022-05-21 17:58:00"),
        ("dzisiaj, 8:12", "2025-01-02 08:12:05", "2025-01-02 08:12:05"), ("wczoraj, 17:30", "2025-01-01 17:30:05", "2025-01-01 17:30:05"), ("So lip 20, 2024 20:57", None, "2024-07-20 20:57:00"),
        ("2022-07-11, 09:07", None, "2022-07-11 09:07:00"), ("3 stycznia 2020, 10:00", None, None), ("31 lut 2020, 10:00", None, None), ("", None, None), (None, None, None),
    ],
)
def test_display_parsers(spark, text, board, stored):
    df = spark.createDataFrame([(text, datetime(2025, 1, 2, 3, 4, 5))], "t string, at timestamp_ntz")
    assert tuple(df.select(dates.board_date(F.col("t"), F.col("at")), dates.stored_date(F.col("t"), F.col("at"))).first()) == (board, stored)
