"""Spans of days that a text names, as column functions: "25th to 27th September", "22nd Sept - 7th Oct", "until 3 October 2026"."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)? )?"
DAY, YEAR = "([0-9]{1,2})(?:st|nd|rd|th)?", "(?: (20[0-9]{2}))?"
TO = " ?(?:-|to|until|till|through|and|&) ?"
#: Patterns over lower-cased text with single blanks, in order of precedence, and the groups of d1, m1, y1, d2, m2, y2 (0: none).
RANGES = (
    (rf"\b{WEEKDAY}{DAY}(?: (?:of )?{MONTHS}\b)?{YEAR}{TO}{WEEKDAY}{DAY} (?:of )?{MONTHS}\b{YEAR}", (1, 2, 3, 4, 5, 6)),
    (rf"\b{MONTHS} {DAY}{YEAR}{TO}(?:{MONTHS} )?{DAY}\b{YEAR}", (2, 1, 3, 5, 4, 6)),
)
#: One day, with the word before it that makes it a first or a last day.
SINGLES = (
    (rf"(?:\b(until|till|ends|ending|by|from|starts|starting|since) )?\b{WEEKDAY}{DAY} (?:of )?{MONTHS}\b{YEAR}", (1, 2, 3, 4)),
    (rf"(?:\b(until|till|ends|ending|by|from|starts|starting|since) )?\b{MONTHS} {DAY}\b{YEAR}", (1, 3, 2, 4)),
)
LAST_WORDS, FIRST_WORDS = ("until", "till", "ends", "ending", "by"), ("from", "starts", "starting", "since")
HALF_YEAR = 183


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, null if there is no such day."""
    number = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(month, 1, 3)) + 2) / 3
    text = F.concat_ws("-", year.cast("string"), F.lpad(number.cast("int").cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when((day != "") & (month != ""), F.try_to_date(text, "yyyy-MM-dd"))


def _near(month: Column, day: Column, near: Column) -> Column:
    """The day of the year that brings it nearest to a date."""
    same = _day(F.year(near), month, day)
    away = F.datediff(same, near)
    return F.when(away > HALF_YEAR, _day(F.year(near) - 1, month, day)).when(away < -HALF_YEAR, _day(F.year(near) + 1, month, day)).otherwise(same)


def _found(text: Column, pattern: str, groups: tuple[int, ...], build) -> Column:
    """What build makes of the groups, each taken once, of the first match; null if there is none."""
    parts = F.struct(*(F.regexp_extract(text, pattern, g).alias(f"g{i}") for i, g in enumerate(groups)))
    return F.when(text.rlike(pattern), F.transform(F.array(parts), lambda p: build(*(p[f"g{i}"] for i in range(len(groups)))))[0])


def _range(posted: Column, d1: Column, m1: Column, y1: Column, d2: Column, m2: Column, y2: Column) -> Column:
    m1, m2 = F.when(m1 == "", m2).otherwise(m1), F.when(m2 == "", m1).otherwise(m2)
    year = F.when(y1 != "", y1).when(y2 != "", y2)
    start = F.when(year.isNotNull(), _day(year, m1, d1)).otherwise(_near(m1, d1, posted))
    end = _day(F.when(y2 != "", y2).otherwise(F.year(start).cast("string")), m2, d2)
    turn = end < start  # over the turn of the year
    start, end = F.when(turn & (y1 == "") & (y2 != ""), F.add_months(start, -12)).otherwise(start), F.when(turn & (y2 == ""), F.add_months(end, 12)).otherwise(end)
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start_date"), end.alias("end_date")))


def _single(posted: Column, word: Column, d: Column, m: Column, y: Column) -> Column:
    on = F.when(y != "", _day(y, m, d)).otherwise(_near(m, d, posted))
    start, end = F.when(~word.isin(*LAST_WORDS), on), F.when(~word.isin(*FIRST_WORDS), on)
    return F.when(on.isNotNull(), F.struct(start.alias("start_date"), end.alias("end_date")))


def date_span(text: Column, posted: Column) -> Column:
    """struct(start_date, end_date) of the first range that the text names, else of the first single day; null if there is none, or if that
    is no day of the calendar.

    A year that is not named is the one nearest to the posting date; a range may cross the turn of the year. One day is
    first and last day, after "until" and the like only the last, after "from" and the like only the first."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "–—", "--"), "[^a-z0-9&-]", " "), " +", " "))
    spans = lambda t: F.coalesce(*(_found(t, p, g, partial(make, posted)) for make, forms in ((_range, RANGES), (_single, SINGLES)) for p, g in forms))
    return F.transform(F.array(low), spans)[0]
