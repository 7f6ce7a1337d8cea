"""Lenient parsing of text: timestamps, numbers, identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Accepted layouts besides ISO 8601, in order of preference (fixed values, Spark pattern letters).
LAYOUTS = (
    "y-M-d H:m:s",
    "y-M-d H:m",
    "y-M-d",
    "y/M/d",
    "y/M/d H:m",
    "y/M/d H:m:s",
    "d-M-y",
    "d/M/y",
    "M/d/y H:m",
    "M/d/y H:m:s",
    "M/d/y",
)
NULL_WORDS = ("nan", "na", "null", "none")  # texts that mean "no number" (fixed values)


def timestamp(text: Column) -> Column:
    """Epoch seconds or milliseconds (13 digits or more), ISO 8601, or one of LAYOUTS; offsets are stripped.

    NULL where nothing matches.
    """
    t = F.trim(text)
    digits = t.rlike(r"^\d+$")
    epoch = t.try_cast("long")
    seconds = F.when(F.length(t) >= 13, F.floor(epoch / 1000)).otherwise(epoch)
    in_range = F.abs(seconds) < 253402300800  # year 10000
    local = F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", "")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(
        F.when(local.rlike(r"[T ]\d{2}$"), F.concat(local, F.lit(":00"))).otherwise(local)
    ))
    others = [F.when(t.rlike(_shape(p)), F.try_to_timestamp(t, F.lit(p))) for p in LAYOUTS]
    return F.when(digits & in_range, F.timestamp_seconds(seconds)).otherwise(F.coalesce(iso, *others))


def _shape(pattern: str) -> str:
    """Regular expression with the digit counts of a layout; keeps two-digit years out."""
    out = ""
    for ch in pattern:
        out += r"\d{4}" if ch == "y" else r"\d{1,2}" if ch in "MdHms" else ch
    return f"^{out}$"


def number(text: Column) -> Column:
    """A float with thousands commas removed; NULL for blanks, null words and anything else."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(~F.lower(t).isin("", *NULL_WORDS), t.try_cast("double"))


def sanitize(text: Column, length: int = 48) -> Column:
    """Lower case, other than letters and digits to `_`, trimmed of `_`, at most `length` characters."""
    low = F.lower(F.trim(text))
    clean = F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    return F.when(clean == "", F.lit("series")).otherwise(F.substring(clean, 1, length))


def composite_key(parts: Sequence[Column]) -> Column:
    """Parts joined by `|`, NULL if any part is NULL."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws("|", *[p.cast("string") for p in parts]))
