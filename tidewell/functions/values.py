"""Typed values from raw text."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, functions as F

from tidewell.functions import text as tx
from tidewell.functions.text import norm_text, present

NUMBER = r"^[+-]?(\d[\d_]*\.?[\d_]*|\.\d[\d_]*)([eE][+-]?\d+)?$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:\d{2})$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?[+-]\d{4}$"
YES, NO = ("true", "yes", "1"), ("false", "no", "0")

#: Spark type of each rubric type.
SPARK_TYPES = {"text": "string", "number": "double", "date": "timestamp", "bool": "boolean", "ordered": "string"}


def number(text: Column) -> Column:
    """A finite decimal number; anything else, hexadecimal included, is null."""
    s = present(text)
    value = F.when(s.rlike(NUMBER) & ~s.contains("_"), s.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def date(text: Column) -> Column:
    """ISO 8601: a day (midnight UTC), or a day and time with a zone."""
    s = present(text)
    return F.when(s.rlike(DAY), F.try_to_timestamp(F.concat(s, F.lit("T00:00:00Z")))).when(s.rlike(INSTANT), F.try_to_timestamp(F.regexp_replace(s, ",", ".")))


def boolean(text: Column, unicode: bool = True) -> Column:
    s = norm_text(text, unicode)
    return F.when(s.isin(*YES), True).when(s.isin(*NO), False)


def typed(text: Column, kind: str, unicode: bool = True) -> Column:
    """Raw text as a rubric type; null where it is empty or does not parse."""
    return {"number": number, "date": date, "bool": lambda t: boolean(t, unicode)}.get(kind, present)(text)


def unparsed(text: Column, kind: str) -> Column:
    """Whether a text that is not empty does not parse as its type."""
    return F.coalesce(present(text).isNotNull() & typed(text, kind, unicode=False).isNull(), F.lit(False))


# --- the same for values written in a rubric ------------------------------------


def parse_number(text: str) -> float:
    if not re.match(NUMBER, text.strip()) or "_" in text:
        raise ValueError(f'"{text}" is not a number')
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(f'"{text}" is not a number')
    return value


def parse_bool(text: str) -> bool:
    s = text.strip().lower()
    if s in YES or s in NO:
        return s in YES
    raise ValueError(f'"{text}" is not true/false/yes/no/1/0')


def parse_date(text: str) -> datetime:
    s = text.strip()
    try:
        if re.match(DAY, s):
            return datetime.fromisoformat(s).replace(tzinfo=UTC)
        if re.match(INSTANT, s):
            return datetime.fromisoformat(s).astimezone(UTC)
    except ValueError:
        pass
    raise ValueError(f'"{text}" is not an ISO 8601 date')


_UNITS = {"d": 86_400.0, "h": 3_600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def duration(text: str) -> timedelta:
    """``14d``, ``1d12h``, ``90m``: whole days first, then hours and smaller units; up to a hundred years."""
    m = re.fullmatch(r"(?:(\d+)d)?((?:\d+(?:\.\d+)?(?:h|ms|us|µs|ns|m|s))*)", text.strip())
    if not m or not text.strip():
        raise ValueError(f'"{text}" is not a duration such as 14d or 90m')
    seconds = float(m[1] or 0) * _UNITS["d"]
    for n, unit in re.findall(r"(\d+(?:\.\d+)?)(h|ms|us|µs|ns|m|s)", m[2]):
        seconds += float(n) * _UNITS[unit]
    if seconds > 100 * 366 * 86_400:
        raise ValueError(f'"{text}" is longer than 100 years')
    return timedelta(seconds=seconds)


# Funding labels and the stages they stand for.
FUNDING_STAGES = {
    "pre-seed": "pre_seed", "pre seed": "pre_seed", "seed": "seed",
    "series a": "series_a", "series b": "series_b", "series c": "series_c",
    "series d": "series_d_plus", "series e": "series_d_plus", "series f": "series_d_plus", "series g": "series_d_plus",
    "series h": "series_d_plus", "series i": "series_d_plus", "series j": "series_d_plus",
}


def funding_stage(label: Column) -> Column:
    """The stage that a funding label stands for, null for any other label."""
    return tx.lookup(FUNDING_STAGES, F.lower(tx.trim(label)))


def funding_date(text: Column) -> Column:
    """A day as YYYY-MM-DD from a day or a time with its zone (in UTC), null from anything else."""
    t = tx.trim(text)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit("T00:00:00Z"))))
    time = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))
    return F.substring(tx.format_time(F.coalesce(day, time)), 1, 10)
