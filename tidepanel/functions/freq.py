"""Frequency aliases: steps, tokens, and aliases from seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Canonical unit of each alias token (fixed values): seconds, or months for calendar steps.
_SECONDS = {"S": 1, "SEC": 1, "T": 60, "MIN": 60, "H": 3600, "D": 86400, "B": 86400, "W": 604800}
_MONTHS = {"M": 1, "Q": 3, "Y": 12}
# Day-based length of calendar units, as used where true calendar steps are not wanted (fixed values).
COMPAT_DAYS = {"M": 30, "Q": 91, "Y": 365}


def token(alias: str) -> str:
    """Class of an alias: S, MIN, H, D, W, M, Q, Y, AUTO, or the upper-cased text."""
    raw = re.sub(r"^\d+", "", alias.strip().upper())
    if raw in ("", "AUTO"):
        return "AUTO"
    if raw in ("T", "MIN", "MINS", "MINUTE", "MINUTES"):
        return "MIN"
    if raw in ("M", "MS", "ME", "MONTH", "MONTHS"):
        return "M"
    for start in ("H", "D", "W", "Q"):
        if raw.startswith(start):
            return start
    if raw[0] in "YA":
        return "Y"
    return raw


def alias_step(alias: str) -> tuple[str, int]:
    """(unit, size): ("second", s) or ("month", m)."""
    found = re.fullmatch(r"\s*(\d+)?\s*([A-Za-z]+)(-[A-Za-z]+)?\s*", alias)
    if not found:
        raise ValueError(f"bad frequency {alias!r}")
    mult, tok = int(found.group(1) or 1), token(found.group(2))
    if tok in _MONTHS:
        return "month", mult * _MONTHS[tok]
    if tok in _SECONDS:
        return "second", mult * _SECONDS[tok]
    raise ValueError(f"bad frequency {alias!r}")


def token_column(alias: Column) -> Column:
    """Column form of `token`."""
    raw = F.regexp_replace(F.upper(F.trim(alias)), r"^\d+", "")
    return (
        F.when(raw.isin("", "AUTO"), "AUTO")
        .when(raw.isin("T", "MIN", "MINS", "MINUTE", "MINUTES"), "MIN")
        .when(raw.isin("M", "MS", "ME", "MONTH", "MONTHS"), "M")
        .when(raw.startswith("H"), "H")
        .when(raw.startswith("D"), "D")
        .when(raw.startswith("W"), "W")
        .when(raw.startswith("Q"), "Q")
        .when(raw.startswith("Y") | raw.startswith("A"), "Y")
        .otherwise(raw)
    )


def compat_seconds(alias: Column) -> Column:
    """Step of an alias column in seconds with 30-day months, 91-day quarters and 365-day years."""
    mult = F.coalesce(F.regexp_extract(F.trim(alias), r"^(\d+)", 1).try_cast("long"), F.lit(1))
    tok = token_column(alias)
    unit = F.when(tok == "S", 1).when(tok == "MIN", 60).when(tok == "H", 3600).when(tok == "D", 86400).when(tok == "W", 604800)
    for t, days in COMPAT_DAYS.items():
        unit = unit.when(tok == t, days * 86400)
    return mult * unit


def alias_of_seconds(seconds: Column) -> Column:
    """D / h / min / s alias with multiple for whole seconds; NULL otherwise."""
    whole = F.round(seconds).cast("long")
    out = F.when((whole <= 0) | (F.abs(seconds - whole) > 1e-6), F.lit(None).cast("string"))
    for unit, size in (("D", 86400), ("h", 3600), ("min", 60), ("s", 1)):
        k = F.floor(whole / size).cast("string")
        out = out.when(whole % size == 0, F.when(whole == size, F.lit(unit)).otherwise(F.concat(k, F.lit(unit))))
    return out


# ---- calendar steps --------------------------------------------------------------------------


def _parts(alias: Column) -> tuple[Column, Column]:
    """(multiple, unit) of an alias column; the unit keeps the start / end mark but not the anchor."""
    text = F.upper(F.trim(alias))
    mult = F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("long"), F.lit(1).cast("long"))
    return mult, F.regexp_extract(text, r"^\d*\s*([A-Z]+)", 1)


# Kinds of units and their patterns, and seconds or months of one unit by its letters (without the B of business units).
_KINDS = (
    ("business_day", r"(B|C)"),
    ("month_business_start", r"B[MQYA]S"),
    ("month_business_end", r"B[MQYA]E?"),
    ("month_end", r"(M|Q|Y|A)E"),
    ("month", r"(M|MS|MONTHS?|Q|QS|QUARTERS?|Y|YS|A|AS|YEARS?)"),
    ("second", r"(S|SEC|SECS|SECONDS?|T|MIN|MINS|MINUTES?|H|HOURS?|D|DAYS?|W|WEEKS?)"),
)
_SIZES = (
    (r"(T|MIN)", 60), (r"B?M", 1), (r"B?Q", 3), (r"B?[YA]", 12), (r"S", 1), (r"H", 3600), (r"D", 86_400), (r"W", 604_800),
)


def _kind(unit: Column) -> Column:
    """The kind of a unit column; NULL for anything else."""
    out = None
    for kind, pattern in _KINDS:
        hit = unit.rlike(f"^{pattern}$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def _unit_size(unit: Column) -> Column:
    """Seconds or months of one unit."""
    out = None
    for pattern, size in _SIZES:
        hit = unit.rlike(f"^{pattern}")
        out = F.when(hit, size) if out is None else out.when(hit, size)
    return out.otherwise(1).cast("long")


def _literal(alias: str) -> tuple[int, str | None, int]:
    """(multiple, kind, size) of an alias that is known when the query is built."""
    found = re.match(r"\s*(\d*)\s*([A-Z]*)", alias.upper())
    unit = found.group(2)
    kind = next((k for k, pattern in _KINDS if re.fullmatch(pattern, unit)), None)
    return int(found.group(1) or 1), kind, next((n for pattern, n in _SIZES if re.match(pattern, unit)), 1)


def _day_shift(ts: Column, days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + days.cast("long") * F.lit(86_400_000_000))


def _weekday(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(ts.cast("date")).cast("long")


def _business_days(ts: Column, k: Column) -> Column:
    """ts moved by k business days; a weekend counts as the Friday before it, or for k <= 0 as the Monday after it."""
    w = _weekday(ts)
    roll = F.when(w < 5, F.lit(0).cast("long")).when(k > 0, 4 - w).otherwise(7 - w)
    start = F.when(w < 5, w).when(k > 0, F.lit(4).cast("long")).otherwise(F.lit(0).cast("long"))
    return _day_shift(ts, roll + k + 2 * F.floor((start + k) / 5))


def steps_from(ts: Column, k: Column, alias: Column | str) -> Column:
    """ts plus k steps of the alias (text or column): fixed lengths, calendar months, month ends (ME, QE, YE), first and last
    business days of months (BMS, BQS, BYS, BME, ...) and business days (B). The time of day stays.

    Month starts and plain months keep the day (or the last one of a shorter month), ends fall on the last day. NULL for an
    alias that is not known.
    """
    if isinstance(alias, str):
        mult, kind, size = _literal(alias)
        return _steps(ts, k.cast("long") * mult, F.lit(size).cast("long"))[kind] if kind else F.lit(None).cast("timestamp")
    mult, unit = _parts(alias)
    kinds, kind, out = _steps(ts, k.cast("long") * mult, _unit_size(unit)), _kind(unit), None
    for name, value in kinds.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def _steps(ts: Column, k: Column, size: Column) -> dict[str, Column]:
    """ts plus k units of each kind; size is in seconds or months."""
    months = ts + F.make_ym_interval(F.lit(0), (k * size).cast("int"))
    first = _day_shift(months, 1 - F.dayofmonth(months))
    last = _day_shift(months, F.datediff(F.last_day(months), months))
    wf, wl = _weekday(first), _weekday(last)
    return {
        "second": F.timestamp_micros(F.unix_micros(ts) + k * size * F.lit(1_000_000)),
        "month": months,
        "month_end": last,
        "month_business_start": _day_shift(first, F.when(wf >= 5, 7 - wf).otherwise(F.lit(0).cast("long"))),
        "month_business_end": _day_shift(last, F.when(wl >= 5, 4 - wl).otherwise(F.lit(0).cast("long"))),
        "business_day": _business_days(ts, k),
    }


def steps_between(lo: Column, hi: Column, alias: Column | str) -> Column:
    """The largest k with steps_from(lo, k, alias) <= hi (hi is not before lo); NULL for an alias that is not known."""
    if isinstance(alias, str):
        mult, kind, size = _literal(alias)
        guess = _guesses(lo, hi, F.lit(mult).cast("long"), F.lit(size).cast("long"))[_shape(kind)] if kind else F.lit(None).cast("long")
    else:
        mult, unit = _parts(alias)
        kind, options = _kind(unit), _guesses(lo, hi, mult, _unit_size(unit))
        guess = F.when(kind == "second", options["second"]).when(kind == "business_day", options["business_day"]).when(kind.isNotNull(), options["month"])
    return guess - (steps_from(lo, guess, alias) > hi).cast("long")


def _shape(kind: str) -> str:
    return kind if kind in ("second", "business_day") else "month"


def _guesses(lo: Column, hi: Column, mult: Column, size: Column) -> dict[str, Column]:
    """Steps from lo to hi, or one more."""

    def business_index(ts: Column) -> Column:
        days = F.datediff(ts.cast("date"), F.lit("1969-12-29").cast("date"))  # a Monday
        return F.floor(days / 7) * 5 + F.least(_weekday(ts), F.lit(5).cast("long"))

    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    return {
        "second": F.floor((F.unix_micros(hi) - F.unix_micros(lo)) / (mult * size * F.lit(1_000_000))).cast("long"),
        "business_day": F.ceil((business_index(hi) - business_index(lo)) / mult).cast("long"),
        "month": F.floor(months / (mult * size)).cast("long"),
    }


_KNOWN = re.compile(
    r"\s*\d*\s*(B|C|B[MQYA][SE]?|[MQYA][SE]?|MONTHS?|QUARTERS?|YEARS?|SEC|SECS|SECONDS?|T|MIN|MINS|MINUTES?|HOURS?|DAYS?|WEEKS?|S|H|D|W)"
    r"(-[A-Z]+)?\s*"
)


def require_known(alias: str) -> str:
    """The alias, or ValueError if steps_from doesn't know it."""
    if not _KNOWN.fullmatch(alias.upper()):
        raise ValueError(f"bad frequency {alias!r}")
    return alias
