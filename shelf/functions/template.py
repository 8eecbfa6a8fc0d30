"""Path templates: parsed once on the driver, compiled to one Column expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf.functions.names import sanitize_ascii, sanitize_component
from shelf.options import UNKNOWN_CAMERA, UNKNOWN_DATE, UNKNOWN_LOCATION

#: Variables by class; those in NUMERIC may be padded.
DATE = ("year", "month", "month_name", "day", "iso_year", "iso_week")
LOCATION = ("country", "region", "city")
CAMERA = ("camera_make", "camera_model")
NUMERIC = frozenset(DATE) - {"month_name"}
MAX_PAD = 9


class TemplateError(ValueError):
    """A template that cannot be parsed; ``code`` names the fault."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Var:
    name: str
    pad: int = 0


Segment = tuple  # of str literals and Vars


def _variable(body: str) -> Var:
    name, colon, spec = body.partition(":")
    pad = 0
    if colon:
        width = spec[1:].removeprefix("+") if spec.startswith("0") else ""
        if not (width.isascii() and width.isdigit()) or int(width) > MAX_PAD:
            raise TemplateError("bad-padding", spec)
        pad = int(width)
    if name.strip() not in (*DATE, *LOCATION, *CAMERA):
        raise TemplateError("unknown-variable", name.strip())
    if pad and name.strip() not in NUMERIC:
        raise TemplateError("bad-padding", f"{name} is not numeric")
    return Var(name.strip(), pad)


def parse(text: str) -> tuple[Segment, ...]:
    """Segments of a template; slashes of either kind separate them, empty ones vanish."""
    if not text.strip():
        raise TemplateError("empty")
    if text[0] in "/\\" or text.encode()[1:2] == b":":
        raise TemplateError("absolute")
    segments: list[list] = [[]]
    at = 0
    while at < len(text):
        c = text[at]
        if c == "{":
            end = text.find("}", at)
            if end < 0:
                raise TemplateError("unclosed-brace", str(at))
            segments[-1].append(_variable(text[at + 1 : end]))
            at = end
        elif c == "}":
            raise TemplateError("stray-brace", str(at))
        elif c in "/\\":
            segments.append([])
        elif segments[-1] and isinstance(segments[-1][-1], str):
            segments[-1][-1] += c
        else:
            segments[-1].append(c)
        at += 1
    kept = tuple(tuple(s) for s in segments if s)
    if not kept:
        raise TemplateError("empty")
    for segment in kept:
        if "".join(p for p in segment if isinstance(p, str)).strip() == "..":
            raise TemplateError("parent-escape")
    return kept


def uses_location(text: str) -> bool:
    return any(isinstance(p, Var) and p.name in LOCATION for s in parse(text) for p in s)


def date_values(date: Column) -> dict[str, Column]:
    """Text of every date variable, unpadded; ISO year and week come from one calendar."""
    return {
        "year": F.year(date).cast("string"),
        "month": F.month(date).cast("string"),
        "month_name": F.date_format(date, "MMMM"),
        "day": F.day(date).cast("string"),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), date).cast("string"),
        "iso_week": F.weekofyear(date).cast("string"),
    }


def clean(segment: Segment) -> bool:
    """Whether no value can make a segment of dates and ASCII literals need sanitizing.

    Digits, month names, and literals of letters, digits, ``-`` and ``_`` are legal and
    short, and with a sign or without letters of its own a segment is no device name.
    """
    literal = "".join(p for p in segment if isinstance(p, str))
    dated = all(isinstance(p, str) or p.name in DATE for p in segment) and any(isinstance(p, Var) for p in segment)
    legal = all(c.isascii() and (c.isalnum() or c in "-_") for c in literal)
    return dated and legal and ("-" in literal or "_" in literal or not any(map(str.isalpha, literal))) and len(literal) + 12 * len(segment) <= 100


def render(text: str, date: Column, location: Column | None = None, make: Column | None = None, model: Column | None = None) -> Column:
    """Relative directory of a row.

    ``location`` is a struct of country, region and city. A segment with location variables
    only, all of them null, disappears with its literals. A segment with a date variable
    and no date is ``unknown-date``, and such segments collapse while no other segment is
    kept between them. Other missing values become placeholders. Each component is
    sanitized; a path without components is ``unknown-date``.
    """
    missing = F.lit(None).cast("string")
    values = date_values(date)
    values |= {n: missing if location is None else location[n] for n in LOCATION}
    values |= {"camera_make": missing if make is None else make, "camera_model": missing if model is None else model}
    parts: list[Column] = []
    #: Condition under which some kept segment has ended the last run of unknown dates.
    fresh: Column = F.lit(True)
    for segment in parse(text):
        names = [p.name for p in segment if isinstance(p, Var)]
        pieces = []
        for p in segment:
            if isinstance(p, str):
                pieces.append(F.lit(p))
                continue
            value = values[p.name]
            if p.pad:
                value = F.lpad(value, F.greatest(F.length(value), F.lit(p.pad)), F.lit("0"))
            pieces.append(F.coalesce(value, F.lit(UNKNOWN_LOCATION if p.name in LOCATION else UNKNOWN_CAMERA if p.name in CAMERA else UNKNOWN_DATE)))
        plain = all(p.isascii() if isinstance(p, str) else p.name in DATE for p in segment)
        joined = F.concat(*pieces)
        shown = joined if clean(segment) else (sanitize_ascii if plain else sanitize_component)(joined)
        if any(n in DATE for n in names):
            parts.append(F.when(date.isNotNull(), shown).when(fresh, F.lit(UNKNOWN_DATE)))
            fresh = date.isNotNull()
        elif names and all(n in LOCATION for n in names):
            kept = reduce(lambda a, b: a | b, [values[n].isNotNull() for n in names])
            parts.append(F.when(kept, shown))
            fresh = fresh | kept
        else:
            parts.append(shown)
            fresh = F.lit(True)
    path = F.concat_ws("/", *parts)
    return F.when(path == "", F.lit(UNKNOWN_DATE)).otherwise(path)

