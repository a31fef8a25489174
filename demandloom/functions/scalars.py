"""Column helpers shared by the operators. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "missing" in an uploaded sheet.
MISSING_TEXTS = ["", "nan", "null", "none"]

# Texts that read as a number.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?)\s*$"

# Spellings of a date after its separators are made slashes, month before day.
DATE_SHAPES = [
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/[A-Za-z]{3}/\d{4}$", "d/MMM/y"),
    (r"^\d{1,2}/[A-Za-z]{4,}/\d{4}$", "d/MMMM/y"),
    (r"^[A-Za-z]{3}/\d{1,2}/\d{4}$", "MMM/d/y"),
    (r"^[A-Za-z]{4,}/\d{1,2}/\d{4}$", "MMMM/d/y"),
]

# Calendar unit of each interval; anything else reads as a month.
INTERVAL_UNITS = {
    "DAILY": "DAY",
    "WEEKLY": "WEEK",
    "MONTHLY": "MM",
    "QUARTERLY": "QUARTER",
    "YEARLY": "YEAR",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(c: Column) -> Column:
    """Trim; texts that mean missing become NULL."""
    return F.when(~F.lower(F.trim(c)).isin(MISSING_TEXTS), F.trim(c))


def to_number(c: Column, kind: str = "double") -> Column:
    """Finite number in a text, else NULL. The pattern goes first: a failed cast costs an exception per row."""
    made = F.when(c.rlike(NUMBER), c.try_cast(kind))
    return F.when(F.abs(made) < F.lit(float("inf")), made) if kind == "double" else made


def to_date(c: Column, day_first: bool = False) -> Column:
    """Date in a text, else NULL: ISO, with slashes, dots or dashes, compact, or with an English month; a time is cut off.

    The shape of the text picks the pattern, so a text is parsed once and a bad one costs no exception.
    """
    text = F.initcap(F.lower(F.trim(c)))
    text = F.regexp_replace(text, r"(?<=\d)[t ]+\d{1,2}:\d{2}.*$", "")
    text = F.regexp_replace(text, r"[-./, ]+", "/")

    def parsed(s: Column) -> Column:
        out = F.lit(None).cast("date")
        for shape, pattern in reversed(DATE_SHAPES):
            known = "d/M/y" if day_first and pattern == "M/d/y" else pattern
            out = F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(known)).cast("date")).otherwise(out)
        return out

    return let(text, parsed)


def period_start(d: Column, interval: str = "MONTHLY", legacy: bool = False) -> Column:
    """First day of the calendar period of a date. ``legacy`` reads DAILY as a month."""
    name = (interval or "").upper()
    unit = INTERVAL_UNITS.get(name, "MM")
    if unit == "DAY":
        return F.trunc(d, "MM") if legacy else d.cast("date")
    return F.trunc(d, unit)


def add_periods(d: Column, k: Column, interval: str = "MONTHLY") -> Column:
    name = (interval or "").upper()
    if name == "DAILY":
        return F.date_add(d, k.cast("int"))
    if name == "WEEKLY":
        return F.date_add(d, (k * 7).cast("int"))
    months = {"QUARTERLY": 3, "YEARLY": 12}.get(name, 1)
    return F.add_months(d, (k * months).cast("int"))


def periods_between(start: Column, end: Column, interval: str = "MONTHLY") -> Column:
    """Length of a forecast horizon."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    name = (interval or "").upper()
    if name == "WEEKLY":
        return F.floor(F.datediff(end, start) / 7).cast("int")
    if name == "QUARTERLY":
        return (F.floor(months / 3) + 1).cast("int")
    if name == "YEARLY":
        return (F.year(end) - F.year(start) + 1).cast("int")
    if name == "DAILY":
        return (F.datediff(end, start) + 1).cast("int")
    return (months + 1).cast("int")


def natural_key(cols: Iterable[str]) -> Column:
    """Deterministic surrogate key: hash of the length-prefixed values, NULLs kept apart."""
    parts = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
        for c in cols
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def erp_date(c: Column) -> Column:
    """``/Date(ms)/`` or an ISO prefix to a date, else NULL. Independent of the time zone."""
    stamp = r"Date\((-?[0-9]{1,15})\)"
    ms = F.regexp_extract(c, stamp, 1).cast("bigint")
    epoch = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000).cast("int"))
    return F.when(c.rlike(stamp), epoch).otherwise(iso_date(c))


def erp_moment(c: Column) -> Column:
    """``/Date(ms)/`` or ISO text to a time without zone, else NULL."""
    stamp = r"Date\((-?[0-9]{1,15})\)"
    seconds = F.regexp_extract(c, stamp, 1).try_cast("bigint") / F.lit(1000).cast("decimal(4,0)")
    none = F.lit(0)
    since = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds.cast("decimal(18,6)"))
    return F.when(c.rlike(stamp), since).otherwise(c.try_cast("timestamp_ntz"))


def iso_date(c: Column) -> Column:
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def table_name(c: Column) -> Column:
    """Display name to table name; NULL when nothing usable is left or it is too long."""
    s = F.regexp_replace(F.lower(c), r"[\s\-]+", "_")
    s = F.regexp_replace(s, r"[^a-z0-9_]", "")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(F.length(s).between(1, 63), s)


def steady_round(c: Column, digits: int) -> Column:
    """Round half up with a small tolerance: the order of a float sum cannot flip a tie."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.500001) / scale
