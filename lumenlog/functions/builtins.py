"""The builtin functions. Null arguments give null; nothing raises under ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = -(2**63), 2**63 - 1


def _flag(c: Column) -> Column:
    return c.cast("bigint")


def _never_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def to_long(c: Column) -> Column:
    """A float as a number, cut towards zero and clamped to 64 bits; NaN is 0."""
    return F.when(F.isnan(c), F.lit(0).cast("bigint")).when(c >= float(MOST), F.lit(MOST)).when(c <= float(LEAST), F.lit(LEAST)).otherwise(c.try_cast("bigint"))


def split_nth(s: Column, sep: Column, n: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.when(sep == "", F.concat(F.array(F.lit("")), F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "")), F.array(F.lit("")))).otherwise(F.split(s, quoted, -1))
    return F.when((n >= 0) & (n < F.size(parts)), F.get(parts, n.cast("int")))


def replace(s: Column, old: Column, new: Column) -> Column:
    between = F.concat(new, F.when(s == "", F.lit("")).otherwise(F.concat_ws("", F.transform(F.split(s, ""), lambda c: F.concat(c, new)))))
    return F.when(old == "", between).otherwise(F.replace(s, old, new))


def before_last(s: Column, sep: Column) -> Column:
    found = F.call_function("instr", s, sep)
    tail = F.call_function("substring_index", s, sep, F.lit(-1))
    return F.when((sep == "") | (found == 0), s).otherwise(F.substring(s, F.lit(1), F.length(s) - F.length(tail) - F.length(sep)))


def after_last(s: Column, sep: Column) -> Column:
    return F.when(sep == "", s).otherwise(F.call_function("substring_index", s, sep, F.lit(-1)))


def extract_number(s: Column) -> Column:
    digits = F.replace(F.regexp_extract(s, "[0-9](?:,?[0-9])*", 0), F.lit(","), F.lit(""))
    return digits.try_cast("bigint")


#: Fixed shape of a moment: a date, or a date, T and a time; a fraction and Z are ignored.
_MOMENT = r"^([0-9]+)-([0-9]+)-([0-9]+)(?:Z*|T([0-9]+):([0-9]+)(?::([0-9]+))?(?:\.[^+]*)?Z*)$"


def date_epoch(s: Column) -> Column:
    part = lambda k: F.regexp_extract(s, _MOMENT, k).try_cast("bigint")
    year, month, day = part(1), part(2), part(3)
    hour, minute, second = (F.coalesce(part(k), F.lit(0)) for k in (4, 5, 6))
    good = month.between(1, 12) & day.between(1, 31) & (year <= 999_999) & (hour <= 23) & (minute <= 59) & (second <= 60)
    days = F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))) + day - 1
    return F.when(good, days.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second)


def rounded(x: Column) -> Column:
    """Half away from zero. A float of 2^52 or more is whole already."""
    whole = to_long(F.abs(x))
    up = F.when(F.abs(x) < float(2**52), F.when(F.abs(x) - whole >= 0.5, whole + 1).otherwise(whole)).otherwise(whole)
    return F.when(F.isnan(x) | (F.abs(x) >= float(MOST)), to_long(x)).when(x < 0, -up).otherwise(up)


def floored(x: Column) -> Column:
    whole = to_long(x)
    return F.when((x < 0) & (F.abs(x) < float(2**52)) & (whole > x), whole - 1).otherwise(whole)


def log(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(_never_nan(F.ln(x)))


def absolute(x: Column, kind: str) -> Column:
    if kind == "float":
        return F.abs(x)
    return F.when(x != LEAST, F.abs(F.nullif(x, F.lit(LEAST))))


def similarity(a: Column, b: Column) -> Column:
    """The Sorensen-Dice coefficient of the character bigrams, as multisets, from 0 to 100."""
    grams = lambda s: F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    one, two = grams(a), grams(b)
    times = lambda list_, g: F.size(F.filter(list_, lambda x: x == g))
    common = F.aggregate(F.array_distinct(one), F.lit(0), lambda n, g: n + F.least(times(one, g), times(two, g)))
    score = F.call_function("div", F.lit(200) * common, F.size(one) + F.size(two))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.length(a) < 2) | (F.length(b) < 2), F.when(a == b, 100).otherwise(0)).otherwise(score).cast("bigint")


BUILTIN_COLUMNS: dict[str, Callable[..., Column]] = {
    "split_nth": split_nth,
    "starts_with": lambda s, p: _flag(F.startswith(s, p)),
    "contains": lambda s, n: _flag(F.contains(s, n)),
    "str_before": lambda a, b: _flag(a < b),
    "replace": replace,
    "before_last": before_last,
    "after_last": after_last,
    "concat": F.concat,
    "extract_number": extract_number,
    "date_epoch": date_epoch,
    "to_float": lambda n: n.cast("double"),
    "round": rounded,
    "floor": floored,
    "to_lower": F.lower,
    "to_upper": F.upper,
    "ln": log,
    "exp": F.exp,
    "sqrt": lambda x: _never_nan(F.sqrt(x)),
    "pow": lambda a, b: _never_nan(F.pow(a, b)),
    "similarity": similarity,
}
