"""The intrinsic functions, by name, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "date'1601-01-01'"


def _dec(x: Column) -> Column:
    return x.cast("double")


def _total(*v: Column) -> Column:
    return reduce(lambda a, b: a + b, v)


def _variance(*v: Column) -> Column:
    mean = _total(*map(_dec, v)) / len(v)
    return _total(*[(_dec(x) - mean) * (_dec(x) - mean) for x in v]) / max(1, len(v) - 1)


def _median(*v: Column) -> Column:
    s, n = F.array_sort(F.array(*map(_dec, v))), len(v)
    return (F.element_at(s, (n + 1) // 2) + F.element_at(s, n // 2 + 1)) / 2


def _present(rate: Column, *v: Column) -> Column:
    return _total(*[_dec(x) / F.pow(1 + _dec(rate), F.lit(i)) for i, x in enumerate(v, 1)])


def _century(yy: Column) -> Column:
    return F.when(yy <= 50, 2000 + yy).otherwise(1900 + yy)


def _codes(x: Column) -> Column:
    return F.transform(F.split(x, ""), lambda c: F.ascii(c))


def _days(d: Column) -> Column:
    return F.datediff(d, F.expr(EPOCH)) + 1


def _date(n: Column) -> Column:
    return F.date_add(F.expr(EPOCH), (n - 1).cast("int"))


def _factorial(n: Column) -> Column:
    one = F.lit(1).cast("decimal(38,0)")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), one, lambda a, i: (a * i).cast("decimal(38,0)"))


_NUMBER = r"^\s*[+-]?\s*(\d+\.?\d*|\.\d+)\s*$"

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "CURRENT-DATE": lambda: F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS"),
    "WHEN-COMPILED": lambda: F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS"),
    "RANDOM": lambda: F.rand(),
    "PI": lambda: F.pi(),
    "E": lambda: F.e(),
    "LENGTH": lambda x: F.length(x.cast("string")),
    "NUMVAL": lambda x: F.trim(x).try_cast("decimal(30,10)"),
    "NUMVAL-C": lambda x: F.trim(F.regexp_replace(x, "[,$]", "")).try_cast("decimal(30,10)"),
    "UPPER-CASE": F.upper,
    "LOWER-CASE": F.lower,
    "REVERSE": F.reverse,
    "TRIM": lambda x: F.trim(x),
    "TRIM-LEADING": lambda x: F.ltrim(x),
    "TRIM-TRAILING": lambda x: F.rtrim(x),
    "INTEGER": lambda x: x.cast("bigint"),
    "INTEGER-STD": lambda x: F.floor(x).cast("bigint"),
    "INTEGER-PART": lambda x: x.cast("bigint"),
    "ORD": F.ascii,
    "CHAR": lambda n: F.char(n.cast("bigint")),
    "ABS": F.abs,
    "SQRT": lambda x: F.sqrt(_dec(x)),
    "LOG": lambda x: F.ln(_dec(x)),
    "LOG10": lambda x: F.log10(_dec(x)),
    "EXP": lambda x: F.exp(_dec(x)),
    "SIN": lambda x: F.sin(_dec(x)),
    "COS": lambda x: F.cos(_dec(x)),
    "TAN": lambda x: F.tan(_dec(x)),
    "ASIN": lambda x: F.asin(_dec(x)),
    "ACOS": lambda x: F.acos(_dec(x)),
    "ATAN": lambda x: F.atan(_dec(x)),
    "FACTORIAL": _factorial,
    "SIGN": lambda x: F.signum(x).cast("int"),
    "ORD-MAX": lambda x: F.array_max(_codes(x)),
    "ORD-MIN": lambda x: F.array_min(_codes(x)),
    "INTEGER-OF-DATE": lambda x: _days(F.to_date(x.cast("string"), "yyyyMMdd")),
    "DATE-OF-INTEGER": lambda n: F.date_format(_date(n), "yyyyMMdd"),
    "INTEGER-OF-DAY": lambda x: _days(F.to_date(x.cast("string"), "yyyyDDD")),
    "DAY-OF-INTEGER": lambda n: F.date_format(_date(n), "yyyyDDD"),
    "YEAR-TO-YYYY": lambda y: _century((y % 100).cast("int")),
    "DAY-TO-YYYYDDD": lambda x: _century(F.floor(x / 1000).cast("int")) * 1000 + (x % 1000).cast("int"),
    "DATE-TO-YYYYMMDD": lambda x: _century(F.floor(x / 10000).cast("int")) * 10000 + (x % 10000).cast("int"),
    "TEST-NUMVAL": lambda x: F.when(x.rlike(_NUMBER), 0).otherwise(1),
    "TEST-NUMVAL-C": lambda x: F.when(F.regexp_replace(x, "[,$]", "").rlike(_NUMBER), 0).otherwise(1),
    "MOD": lambda a, b: a % b,
    "MOD-STD": lambda a, b: F.pmod(a, b),
    "REM": lambda a, b: a % b,
    "ANNUITY": lambda r, n: _dec(r) / (1 - F.pow(1 + _dec(r), -_dec(n))),
    "MAX": lambda *v: F.greatest(*v) if len(v) > 1 else v[0],
    "MIN": lambda *v: F.least(*v) if len(v) > 1 else v[0],
    "SUM": _total,
    "MEAN": lambda *v: _total(*map(_dec, v)) / len(v),
    "MEDIAN": _median,
    "RANGE": lambda *v: F.greatest(*v) - F.least(*v) if len(v) > 1 else F.lit(0),
    "VARIANCE": _variance,
    "STANDARD-DEVIATION": lambda *v: F.sqrt(_variance(*v)),
    "PRESENT-VALUE": _present,
    "CONCATENATE": lambda *v: F.concat(*[x.cast("string") for x in v]),
}


def intrinsic(name: str, *arguments: Column) -> Column:
    """The function of that name; unknown names raise KeyError."""
    return FUNCTIONS[name.upper()](*arguments)
