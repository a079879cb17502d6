"""Typed values out of text, and small scalar helpers."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
TRUE_WORDS = ["true", "yes", "1", "да"]
FALSE_WORDS = ["false", "no", "0", "нет"]


def inferred_kind(text: Column) -> Column:
    """string, integer, number or boolean, as free text is read."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^[+-]?\d+$") & t.try_cast("long").isNotNull(), "integer")
        .when(t.rlike(NUMBER), "number")
        .when(t.isin("true", "false"), "boolean")
        .otherwise("string")
    )


def delimited_kind(text: Column) -> Column:
    """Kind of a field of a delimited file; codes with leading zeros stay text."""
    t = F.trim(text)
    return (
        F.when(t == "", "empty")
        .when(F.lower(t).isin("true", "false", "истина", "ложь"), "boolean")
        .when(t.rlike(r"^0\d"), "text")
        .when(t.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull(), "date")
        .otherwise("text")
    )


def as_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def as_date_text(text: Column) -> Column:
    """ISO 8601 text of a date or date-time of at least eight characters, else null."""
    t = F.trim(text)
    return F.when(F.length(t) >= 8, F.date_format(F.try_to_timestamp(t), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def epoch(text: Column) -> Column:
    """Seconds of a date's text: the twin that range filters use."""
    return F.unix_timestamp(F.try_to_timestamp(F.trim(text)))


def month_key(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}"), F.substring(text, 1, 7))


def parsed(text: Column, kind: str) -> Column:
    """``text`` as a declared type, as text again; null if it doesn't fit."""
    t = F.trim(text)
    return {
        "string": t,
        "integer": F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long").cast("string")),
        "number": F.when(t.rlike(NUMBER), t.try_cast("double").cast("string")),
        "boolean": as_boolean(t).cast("string"),
        "date": as_date_text(t),
    }[kind]


def accepts(kind: Column, declared: Column) -> Column:
    """Whether an observed kind fits a declared one: integers are numbers."""
    return (kind == declared) | ((declared == "number") & (kind == "integer")) | ((declared == "date") & (kind == "string"))


def percentile_at(values: Column, p: float) -> Column:
    """The value at the nearest index ``round(p * (n - 1))`` of the sorted array."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.round(F.lit(p) * (F.size(values) - 1)).cast("int") + 1))


def version_key(version: Column) -> Column:
    """Comparable parts of a dotted version."""
    plain = F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1)
    return F.when(plain != "", F.transform(F.split(plain, r"\."), lambda x: x.cast("int")))


def excel_date(serial: Column, epoch_1904: bool = False) -> Column:
    """Date-time of a spreadsheet serial; 60 in the 1900 system is no day."""
    if epoch_1904:
        return F.timestamp_seconds((serial * 86400 + F.unix_timestamp(F.lit("1904-01-01 00:00:00"))).cast("long"))
    days = F.when(serial < 60, serial + 1).when(serial >= 61, serial)
    return F.timestamp_seconds((days * 86400 + F.unix_timestamp(F.lit("1899-12-30 00:00:00"))).cast("long"))


def natural_key(name: Column) -> Column:
    """A key under which names with numbers sort as people expect."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def column_letters(index: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def fnv1a(text: str) -> str:
    """64-bit FNV-1a as 16 hex digits."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def next_run(after: datetime.datetime, every: str, hour: int = 0, minute: int = 0, weekday: int = 0) -> datetime.datetime:
    """The next fire of an hourly, daily or weekly schedule, later than ``after``."""
    if every == "hourly":
        at = after.replace(minute=minute, second=0, microsecond=0)
        return at if at > after else at + datetime.timedelta(hours=1)
    at = after.replace(hour=hour, minute=minute, second=0, microsecond=0)
    if every == "weekly":
        at += datetime.timedelta(days=(weekday - at.weekday()) % 7)
        return at if at > after else at + datetime.timedelta(days=7)
    return at if at > after else at + datetime.timedelta(days=1)


def next_fire(after: Column, every: Column, hour: Column, minute: Column, weekday: Column) -> Column:
    """As ``next_run`` for columns: the next hourly, daily or weekly (0 for Monday) time later than ``after``; null for any other schedule."""
    at_minute = F.date_trunc("hour", after) + F.make_dt_interval(mins=minute)
    at_hour = F.date_trunc("day", after) + F.make_dt_interval(hours=hour, mins=minute)
    on_day = at_hour + F.make_dt_interval(days=F.pmod(weekday - F.weekday(after), F.lit(7)))

    def later(at, step):
        return F.when(at > after, at).otherwise(at + step)

    return (
        F.when(every == "hourly", later(at_minute, F.make_dt_interval(hours=F.lit(1))))
        .when(every == "daily", later(at_hour, F.make_dt_interval(days=F.lit(1))))
        .when(every == "weekly", later(on_day, F.make_dt_interval(days=F.lit(7))))
    )


def identifier(title: str, taken: set[str] = frozenset(), reserved: set[str] = frozenset()) -> str:
    """A key from a title: lower case, letters, digits and underscores, unique among ``taken``."""
    key = re.sub(r"_+", "_", re.sub(r"[^\w]", "_", title.strip().lower())).strip("_") or "column"
    if key in reserved or key.startswith("_") or key[0].isdigit():
        key = f"col_{key}"
    out, n = key, 2
    while out in taken:
        out, n = f"{key}_{n}", n + 1
    return out
