"""Date functions: EXIF text, file names, believable years, and the fallback chain."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_YEAR = 1990
_TRIM = r"(?U)^\s+|\s+$"
_DATE_PARTS = r"(?U)^\s*\+?0*([0-9]{1,9})\s*[:/-]\s*\+?0*([0-9]{1,9})\s*[:/-]\s*\+?0*([0-9]{1,9})\s*$"


def max_year(now_year: int | None = None) -> Column:
    return (F.lit(now_year) if now_year is not None else F.year(F.current_date())) + 1


def sane(stamp: Column, now_year: int | None = None) -> Column:
    """Year from 1990 to next year."""
    return F.year(stamp).between(F.lit(MIN_YEAR), max_year(now_year))


def _unsigned(part: Column) -> Column:
    digits = F.regexp_extract(part, r"(?U)^\s*\+?0*([0-9]{1,9})\s*$", 1)
    return F.when(digits != "", digits.cast("int"))


def exif_timestamp(text: Column, now_year: int | None = None) -> Column:
    """Timestamp of an EXIF date text, or null.

    A text that starts with ``0000`` or is blank is absent. The date has three unsigned
    numbers; a time that does not parse is midnight, the date stays. Zone suffixes make a
    time fail to parse. Unbelievable years give null.
    """
    s = F.regexp_replace(text, _TRIM, "")
    day, clock = F.regexp_extract(s, "(?s)^([^ T]*)", 1), F.regexp_extract(s, "(?s)^[^ T]*[ T](.*)$", 1)
    parts = [F.regexp_extract(day, _DATE_PARTS, i) for i in (1, 2, 3)]
    fits = (F.length(parts[0]) <= 4) & (F.length(parts[1]) <= 2) & (F.length(parts[2]) <= 2) & (parts[0] != "")
    iso = F.concat_ws("-", F.lpad(parts[0], 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    date = F.when(fits & ~s.startswith("0000"), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))
    pieces = F.slice(F.split(clock, "[:.-]", -1), 1, 3)
    numbers = [_unsigned(F.get(pieces, F.lit(i))) for i in range(3)]
    second = F.when(F.size(pieces) == 2, F.lit(0)).otherwise(numbers[2])
    good = (numbers[0] < 24) & (numbers[1] < 60) & (second < 60)
    seconds = F.when(good, numbers[0] * 3600 + numbers[1] * 60 + second).otherwise(0)
    stamp = date.cast("timestamp_ntz") + F.make_dt_interval(secs=F.coalesce(seconds, F.lit(0)))
    return F.when(sane(stamp, now_year), stamp)


_STEP = re.compile(rb"(?<![0-9])([0-9]{4})(?:([-_. ])([0-9]{2})\2([0-9]{2})|([0-9]{2})([0-9]{2}))")
_RUN = re.compile(rb"[0-9]+")
_CLOCK = re.compile(rb"[-_. Tat]+([0-9]{2})[-_. ]?([0-9]{2})(?:[-_. ]?([0-9]{2}))?")


def _clock(h: bytes, m: bytes, s: bytes | None) -> dt.time | None:
    try:
        return dt.time(int(h), int(m), int(s or 0))
    except ValueError:
        return None


def filename_date(name: str | None, last_year: int) -> dt.datetime | None:
    """First believable date in a file name, with the time that follows it if any.

    A date never begins inside a run of digits. Compact dates may be followed by more
    digits only if these are a time of six digits or of nine with milliseconds; separated
    dates use one separator twice. An impossible time is midnight.
    """
    b, at = (name or "").encode("utf-8", "surrogatepass"), 0
    while m := _STEP.search(b, at):
        at = m.start() + 1
        compact = m[2] is None
        try:
            day = dt.date(int(m[1]), int(m[5] if compact else m[3]), int(m[6] if compact else m[4]))
        except ValueError:
            continue
        end, clock = m.end(), None
        run = _RUN.match(b, end) if compact else None
        if run:
            if len(run[0]) not in (6, 9):
                continue
            clock, end = _clock(run[0][:2], run[0][2:4], run[0][4:6]), run.end()
        elif t := _CLOCK.match(b, end):
            clock = _clock(t[1], t[2], t[3])
            end = t.end() if clock else end
        if MIN_YEAR <= day.year <= last_year:
            return dt.datetime.combine(day, clock or dt.time())
        at = end
    return None


def filename_timestamp(name: Column, now_year: int | None = None) -> Column:
    """``filename_date`` over a column, Arrow-batched; its backtracking exceeds one pattern."""
    last = (now_year or dt.date.today().year) + 1

    @F.pandas_udf("timestamp_ntz")
    def run(names: pd.Series) -> pd.Series:
        return pd.to_datetime(pd.Series([filename_date(n, last) for n in names]), errors="coerce")

    return run(name)


def local_timestamp(instant: Column, now_year: int | None = None) -> Column:
    """Instant to wall clock of the session zone, or null where its year is unbelievable."""
    stamp = instant.cast("timestamp_ntz")
    return F.when(sane(stamp, now_year), stamp)


def date_chain(original: Column, create: Column, filename: Column, mtime: Column, birth: Column, modify: Column) -> Column:
    """``struct<taken, date_source>`` of the first date present, in order of precedence."""
    from shelf.options import DATE_SOURCES

    given = (original, create, filename, mtime, birth, modify)
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in zip(given, DATE_SOURCES, strict=False)], F.lit("unknown"))
    return F.struct(F.coalesce(*given).alias("taken"), source.alias("date_source"))
