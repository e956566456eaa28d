"""Dates as forum software displays them: from typed text to wall time, all as column expressions.

``parse`` turns a text into a struct that still stands in local time (or carries its own offset);
``zbior.operators.zones`` turns wall time into instants.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, by the first letters that tell them apart in Polish and English.
MONTHS = {
    "sty": 1, "stycznia": 1, "styczeń": 1, "jan": 1, "january": 1,
    "lut": 2, "lutego": 2, "luty": 2, "feb": 2, "february": 2,
    "mar": 3, "marca": 3, "marzec": 3, "march": 3,
    "kwi": 4, "kwie": 4, "kwietnia": 4, "kwiecień": 4, "apr": 4, "april": 4,
    "maj": 5, "maja": 5, "may": 5,
    "cze": 6, "czerwca": 6, "czerwiec": 6, "jun": 6, "june": 6,
    "lip": 7, "lipca": 7, "lipiec": 7, "lipa": 7, "jul": 7, "july": 7,
    "sie": 8, "sierpnia": 8, "sierpień": 8, "aug": 8, "august": 8,
    "wrz": 9, "września": 9, "wrzesień": 9, "sep": 9, "sept": 9, "september": 9,
    "paź": 10, "paz": 10, "października": 10, "październik": 10, "oct": 10, "october": 10,
    "lis": 11, "listopada": 11, "listopad": 11, "nov": 11, "november": 11,
    "gru": 12, "grudnia": 12, "grudzień": 12, "dec": 12, "december": 12,
}

# Names and abbreviations of the days of the week.
WEEKDAYS = (
    "pn pon poniedziałek wt wto wtorek śr sr śro środa cz czw czwartek pt pią piątek so sob sobota n nd ndz nie niedz niedziela "
    "mon monday tue tues tuesday wed wednesday thu thur thursday fri friday sat saturday sun sunday"
).split()

#: White space of every kind, as Python's ``str.isspace`` sees it (Java's \s knows only ASCII).
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"

_month = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_weekday = r"(?:(?:" + "|".join(sorted(WEEKDAYS, key=len, reverse=True)) + r")\.?,? )?"
_time = r"(?:,? ?(?:godz\.? ?|o )?(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)?)?"
_zone = r"(?: ?(z|utc|gmt|cet|cest|(?:utc|gmt)? ?[+-]\d{1,2}(?::?\d{2})?))?"

#: Each pattern with the replacement that writes it as kind|year|month|day|hour|minute|second|half|zone.
_FORMS = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[t ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?)?" + _zone + "$", "day|$1|$2|$3|$4|$5|$6||$7"),
    (_weekday.join(["^", r"(\d{1,2})\.? "]) + _month + r"\.?,? (\d{4})(?: ?r\.?)?" + _time + r"(?: ?(am|pm))?" + _zone + "$", "day|$3|$2|$1|$4|$5|$6|$7|$8"),
    (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?: ?r\.?)?" + _time + _zone + "$", "day|$3|$2|$1|$4|$5|$6||$7"),
    ("^" + _weekday + _month + r"\.? (\d{1,2}),? (\d{4})" + _time + r"(?: ?(am|pm))?" + _zone + "$", "day|$3|$1|$2|$4|$5|$6|$7|$8"),
    (r"^(dzisiaj|dziś|dzis|today|wczoraj|yesterday|przedwczoraj)" + _time + "$", "ago|$1|||$2|$3|$4||"),
    (r"^(\d{10}|\d{13})$", "epoch|$1|||||||"),
    (r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?)?" + _zone + "$", "day|$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{1,6}) ?(min|minut|minuta|minuty|minutę|godz|godzin|godziny|godzina|godzinę|h|sek|sekund|sekundy|s|dni|dzień|tyg|tygodni|tygodnie|tydzień)\.? temu$", "span|$1|$2||||||"),
    (r"^(minutę|godzinę|tydzień|dzień) temu$", "span|1|$1||||||"),
]

# Seconds of the spans named in relative dates.
SPANS = {
    "s": 1, "sek": 1, "sekund": 1, "sekundy": 1,
    "min": 60, "minut": 60, "minuta": 60, "minuty": 60, "minutę": 60,
    "h": 3600, "godz": 3600, "godzin": 3600, "godziny": 3600, "godzina": 3600, "godzinę": 3600,
    "dni": 86400, "dzień": 86400, "tyg": 604800, "tydzień": 604800, "tygodnie": 604800, "tygodni": 604800,
}


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def squeeze(text: Column) -> Column:
    """Lower case, one space between words, none at the ends; every kind of white space counts."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE + "+", " "))


def parse(text: Column) -> Column:
    """A struct of what a displayed date says, or null if it is no date.

    ``kind``: ``day`` (``days`` since 1970 and ``secs`` of the day are wall time, or UTC-shifted by
    ``offset`` where a zone is given), ``ago`` (``days`` before the fetch's date, ``secs`` of the day),
    ``span`` (``secs`` before the fetch's second), ``epoch`` (``secs`` since 1970 UTC). An impossible
    calendar day is no date; an impossible time of day leaves the day, at midnight. Numeric dates that
    do not begin with the year have the day first; two-digit years are 20xx; fractions are cut off.
    """
    s = squeeze(text)
    form = None
    for pattern, out in _FORMS:
        hit, value = s.rlike(pattern), F.regexp_replace(s, pattern, out)
        form = F.when(hit, value) if form is None else form.when(hit, value)
    return F.transform(F.array(F.split(form, r"\|", -1)), _fields)[0]


def _fields(p: Column) -> Column:
    kind = p[0]
    year = p[1].try_cast("int")
    month = F.coalesce(_lookup(MONTHS, p[2]), p[2].try_cast("int"))
    date = F.format_string("%04d-%02d-%02d", F.when(F.length(p[1]) == 2, year + 2000).otherwise(year), month, p[3].try_cast("int")).try_cast("date")
    hour, minute, second = (F.coalesce(p[i].try_cast("int"), F.lit(0)) for i in (4, 5, 6))
    hour = F.when(p[7] == "pm", F.when(hour < 12, hour + 12).otherwise(hour)).when(p[7] == "am", F.when(hour == 12, 0).otherwise(hour)).otherwise(hour)
    clock = F.when((hour < 24) & (minute < 60) & (second < 60) | (hour == 24) & (minute + second == 0), hour * 3600 + minute * 60 + second).otherwise(0)
    zone = F.regexp_replace(p[8], "^(?:utc|gmt) ?(?=[+-])", "")
    hours = F.regexp_extract(zone, r"^[+-](\d{1,2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zone, r"^[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    offset = F.when(zone.isin("z", "utc", "gmt"), 0).when(zone == "cet", 3600).when(zone == "cest", 7200).when(hours.isNotNull(), (hours * 3600 + minutes * 60) * F.when(zone.startswith("-"), -1).otherwise(1))
    number = p[1].try_cast("long")
    unit = _lookup(SPANS, p[2])
    back = F.when(p[1].isin("wczoraj", "yesterday"), 1).when(p[1] == "przedwczoraj", 2).otherwise(0)
    whole_days = (kind == "span") & (unit >= 86400)
    return F.when(
        (kind != "day") | date.isNotNull(),
        F.struct(
            F.when(whole_days, "ago").otherwise(kind).alias("kind"),
            F.when(kind == "day", F.datediff(date, F.lit("1970-01-01").cast("date"))).when(kind == "ago", back).when(whole_days, (number * unit / 86400).cast("int")).alias("days"),
            F.when(whole_days, F.lit(0).cast("long")).when(kind == "span", number * unit).when(kind == "epoch", F.when(F.length(p[1]) == 13, F.floor(number / 1000)).otherwise(number)).otherwise(clock.cast("long")).alias("secs"),
            offset.cast("int").alias("offset"),
        ),
    )


def wall_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp's displayed wall clock, whatever its type and the session's zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


# The months that the two display parsers know; other names make a date unreadable for them.
_BOARD_MONTHS = {"sty": 1, "lut": 2, "mar": 3, "kwi": 4, "kwie": 4, "maj": 5, "maja": 5, "cze": 6, "lip": 7, "sie": 8, "wrz": 9, "paź": 10, "lis": 11, "gru": 12}
_STORE_MONTHS = {**_BOARD_MONTHS, "lipa": 7, "sierpnia": 8, "września": 9, "października": 10, "listopada": 11, "grudnia": 12}


def _display(text: Column, as_of: Column, forms: list[tuple[str, str]], months: dict[str, int]) -> Column:
    s = F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), r"^(?:Śr|Pt|Pn|So|N|Cz|Wt)\s+(?=\S+ \d{1,2}, \d{4} \d{1,2}:\d{2} [ap]m)", "")

    def fixed(p: Column) -> Column:
        hour, minute = p[3].try_cast("int"), p[4].try_cast("int")
        hour = F.when(p[5] == "pm", F.when(hour != 12, hour + 12).otherwise(hour)).when(p[5] == "am", F.when(hour == 12, 0).otherwise(hour)).otherwise(hour)
        month = F.coalesce(_lookup(months, F.lower(p[1])), p[1].try_cast("int"))
        date = F.format_string("%04d-%02d-%02d", p[0].try_cast("int"), month, p[2].try_cast("int")).try_cast("date")
        return F.when(date.isNotNull() & month.isNotNull() & (hour < 24) & (minute < 60), F.format_string("%s %02d:%02d:00", date.cast("string"), hour, minute))

    def read(s: Column) -> Column:
        low, clock = F.lower(s), r"(\d{1,2}):(\d{2})"
        day = F.when(low.contains("dzisiaj"), F.to_date(as_of)).when(low.contains("wczoraj"), F.date_sub(F.to_date(as_of), 1))
        hour, minute = F.coalesce(F.regexp_extract(s, clock, 1).try_cast("int"), F.hour(as_of)), F.coalesce(F.regexp_extract(s, clock, 2).try_cast("int"), F.minute(as_of))
        out = F.when(day.isNotNull(), F.when((hour < 24) & (minute < 60), F.format_string("%s %02d:%02d:%02d", day.cast("string"), hour, minute, F.second(as_of).cast("int"))))
        for pattern, fields in forms:
            parts = F.split(F.regexp_replace(s, pattern + ("" if pattern.endswith("$") else ".*"), fields), r"\|", -1)
            out = out.when(s.rlike(pattern), F.transform(F.array(parts), fixed)[0])
        return out

    return F.transform(F.array(s), read)[0]  # so that each step is computed once


def board_date(text: Column, as_of: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` from what boards show: today and yesterday (with the seconds of ``as_of``), 12-hour
    ``mar 16, 2005 11:07 pm`` after a weekday, ``27 lip 2025, 16:46``; null for anything else."""
    forms = [
        (r"^([\p{L}\p{N}_]+)\s+(\d{1,2}),\s+(\d{4})\s+(\d{1,2}):(\d{2})\s+(am|pm)", "$3|$1|$2|$4|$5|$6"),
        (r"^(\d{1,2})\s+([\p{L}\p{N}_]+)\s+(\d{4}),\s+(\d{1,2}):(\d{2})", "$3|$2|$1|$4|$5|"),
    ]
    return _display(text, as_of, forms, _BOARD_MONTHS)


def author_line_date(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` from the ISO date within a post's author line, null if there is none."""
    date, clock = (F.regexp_extract(text, rf"(\d{{4}}-\d{{2}}-\d{{2}})[T,]?{SPACE}*(\d{{1,2}}:\d{{2}})", i) for i in (1, 2))
    return F.when(date != "", F.concat_ws(" ", date, F.lpad(clock, 5, "0")))


def stored_date(text: Column, as_of: Column) -> Column:
    """As ``board_date``, with more month names, 24-hour dates after a weekday and ISO dates, without am and pm."""
    forms = [
        (r"^(\d{1,2})\s+([\p{L}\p{N}_]+)\s+(\d{4}),\s+(\d{1,2}):(\d{2})", "$3|$2|$1|$4|$5|"),
        (r"^[^\s]+\s+([a-ząćęłńóśźż]+)\s+(\d{1,2}),\s+(\d{4})\s+(\d{1,2}):(\d{2})$", "$3|$1|$2|$4|$5|"),
        (r"^(\d{4})-(\d{2})-(\d{2}),?\s+(\d{1,2}):(\d{2})", "$1|$2|$3|$4|$5|"),
    ]
    return _display(text, as_of, forms, _STORE_MONTHS)
