"""Wall time to instants by an as-of join with the zone's offset intervals.

A zone is a list of intervals, each with one offset, bounded both in UTC and in wall time. The list is
exploded to the calendar months it touches; a record joins the row of its month (an equi-join with a
few thousand rows, whose number depends only on ``YEARS``) and looks up the intervals that hold its wall
time: two mean it is ambiguous, none that it was skipped, one gives the offset directly. No record is
shuffled.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zbior.functions import dates

#: Years whose offset changes are known; before and after, the first and the last offset hold.
YEARS = (1900, 2100)
_FAR = 1 << 46


@lru_cache(maxsize=8)
def intervals(zone: str, years: tuple[int, int] = YEARS) -> list[tuple[int, int, int]]:
    """(first UTC second, UTC second after the last, offset) of each stretch with one offset."""
    z = ZoneInfo(zone)

    def offset(t: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())

    t, end = (int((datetime(y, 1, 1) - datetime(1970, 1, 1)).total_seconds()) for y in years)
    out, start, now = [], -_FAR, offset(t)
    while t < end:
        if offset(t + 86400) != now:
            low, high = t, t + 86400
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == now else (low, middle)
            out.append((start, high, now))
            start, now = high, offset(high)
        t += 86400
    return [*out, (start, _FAR, now)]


def _month(seconds: int) -> int:
    d = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return d.year * 12 + d.month - 1


def interval_months(spark: SparkSession, zone: str, years: tuple[int, int] = YEARS) -> DataFrame:
    """The intervals exploded to months: ``month``, ``spans`` (array of us, ue, ls, le, off), a day's margin around each."""
    low, high = years[0] * 12, years[1] * 12 - 1
    first = (datetime(years[0], 1, 1) - datetime(1970, 1, 1)).total_seconds()
    last = (datetime(years[1], 1, 1) - datetime(1970, 1, 1)).total_seconds() - 1
    by: dict[int, list] = {m: [] for m in range(low, high + 1)}
    for us, ue, off in intervals(zone, years):
        for m in range(_month(int(max(us - 2 * 86400, first))), _month(int(min(ue + 2 * 86400, last))) + 1):
            by[m].append((us, ue, us + off, ue + off, off))
    return spark.createDataFrame(list(by.items()), "month int, spans array<struct<us:long,ue:long,ls:long,le:long,off:int>>")


def month_of(seconds: Column, years: tuple[int, int] = YEARS) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.least(F.greatest(F.floor(seconds / 86400), F.lit(-40000)), F.lit(60000)).cast("int"))
    return F.least(F.greatest(F.year(day) * 12 + F.month(day) - 1, F.lit(years[0] * 12)), F.lit(years[1] * 12 - 1))


def join_zone(df: DataFrame, zone: str, seconds: Column, name: str, years: tuple[int, int] = YEARS) -> DataFrame:
    """``df`` with the array of intervals near ``seconds`` (wall or UTC) as column ``name``; null ``seconds`` get null."""
    spans = interval_months(df.sparkSession, zone, years).select(F.col("month").alias(f"__{name}"), F.col("spans").alias(name))
    return df.withColumn(f"__{name}", month_of(seconds, years)).join(F.broadcast(spans), f"__{name}", "left").drop(f"__{name}")


def utc_offset(spans: Column, utc: Column) -> Column:
    """The offset in force at a UTC second."""
    return F.element_at(F.filter(spans, lambda x: (x["us"] <= utc) & (utc < x["ue"])), 1)["off"]


def wall_to_utc(spans: Column, wall: Column) -> Column:
    """Struct of ``epoch`` and ``state`` (ok, ambiguous, nonexistent) of a wall-time second.

    Wall time that occurs twice means the first; wall time that is skipped moves forward by the gap.
    """
    hits = F.filter(spans, lambda x: (x["ls"] <= wall) & (wall < x["le"]))
    before = F.aggregate(F.filter(spans, lambda x: x["le"] <= wall), F.struct(F.lit(-_FAR).alias("le"), F.lit(0).alias("off")), lambda a, x: F.when(x["le"] > a["le"], F.struct(x["le"].alias("le"), x["off"].alias("off"))).otherwise(a))["off"]
    offset = F.when(F.size(hits) > 0, F.array_max(F.transform(hits, lambda x: x["off"]))).otherwise(before)
    state = F.when(F.size(hits) == 1, "ok").when(F.size(hits) > 1, "ambiguous").otherwise("nonexistent")
    return F.when(wall.isNotNull(), F.struct((wall - offset).alias("epoch"), state.alias("state")))


def to_instants(df: DataFrame, text: str, fetched: str, zone: str = "Europe/Warsaw") -> DataFrame:
    """``df`` with ``epoch_s`` (long) and ``date_state`` of the displayed date in column ``text``.

    ``fetched`` is the UTC timestamp at which the row was fetched; dates relative to the present refer to
    it: days to its date in ``zone``, spans of hours or less to its very second. ``date_state`` is ``ok``,
    ``ambiguous``, ``nonexistent``, ``explicit`` (an offset or epoch was given), ``relative``, ``no_date``
    or ``missing`` (null text). A relative date without ``fetched`` is ``no_date``. Columns named
    ``epoch_s`` or ``date_state`` in ``df`` are replaced; any others are kept.
    """
    fetched_s = dates.wall_seconds(F.col(fetched))
    df = df.withColumn("__d", dates.parse(F.col(text)))
    d = F.col("__d")
    df = join_zone(df, zone, F.when(d["kind"] == "ago", fetched_s), "__near")
    fetch_day = F.floor((fetched_s + utc_offset(F.col("__near"), fetched_s)) / 86400)
    wall = F.when((d["kind"] == "day") & d["offset"].isNull(), d["days"].cast("long") * 86400 + d["secs"]).when(d["kind"] == "ago", (fetch_day - d["days"]) * 86400 + d["secs"])
    df = join_zone(df.withColumn("__wall", wall), zone, F.col("__wall"), "__spans")
    at = wall_to_utc(F.col("__spans"), F.col("__wall"))
    exact = F.when(d["kind"] == "epoch", d["secs"]).when(d["kind"] == "span", fetched_s - d["secs"]).when((d["kind"] == "day") & d["offset"].isNotNull(), d["days"].cast("long") * 86400 + d["secs"] - d["offset"])
    df = df.withColumn("__at", at).withColumn("epoch_s", F.coalesce(exact, F.col("__at")["epoch"]).cast("long"))
    state = F.when(F.col(text).isNull(), "missing").when(F.col("epoch_s").isNull(), "no_date").when(d["kind"].isin("ago", "span"), "relative").when(exact.isNotNull(), "explicit").otherwise(F.col("__at")["state"])
    return df.withColumn("date_state", state).drop("__d", "__near", "__wall", "__spans", "__at")
