"""Value rules of COBOL items as Column expressions: everything stays visible to Catalyst."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A value as DECIMAL(38, 18); what isn't a number is 0. Of whole numbers too long for that the lowest 18 digits count."""
    long = x.try_cast("decimal(38,0)") % F.lit(Decimal(10) ** 18)
    return F.coalesce(x.try_cast("decimal(38,18)"), long.cast("decimal(38,18)"), F.lit(Decimal(0)).cast("decimal(38,18)"))


def coerce(x: Column, int_digits: int, decimals: int = 0, signed: bool = False, rounded: bool = False) -> Column:
    """What a numeric item holds after a MOVE: decimals are cut, or rounded half up, then high-order digits are cut; -0 is 0."""
    y = number(x)
    y = y if signed else F.abs(y)
    size = F.round(F.abs(y), decimals) if rounded else F.abs(y)
    kept = F.floor(size % F.lit(Decimal(10) ** int_digits), F.lit(decimals))
    kind = f"decimal({int_digits + decimals + 1},{decimals})"
    return F.when(y < 0, -kept.cast(kind)).otherwise(kept.cast(kind)).cast(kind)


def size_error(x: Column, int_digits: int) -> Column:
    """True where a value doesn't fit the integer digits or isn't a number: the ON SIZE ERROR flag."""
    whole = F.coalesce(F.abs(x.try_cast("decimal(38,18)")) >= F.lit(Decimal(10) ** int_digits), F.abs(x.try_cast("decimal(38,0)")) >= F.lit(Decimal(10) ** int_digits))
    return F.coalesce(whole, F.lit(True))


def divide(a: Column, b: Column, otherwise: Column) -> Column:
    """A quotient of 11 decimals, of operands of up to 18 digits before the point and 9 behind it; a zero divisor leaves the old value."""
    return F.coalesce(F.try_divide(a.try_cast("decimal(27,9)"), b.try_cast("decimal(27,9)")), otherwise.try_cast("decimal(38,11)"))


def pad(x: Column, size: int) -> Column:
    """An alphanumeric item: cut or filled with blanks on the right."""
    return F.rpad(F.coalesce(x.cast("string"), F.lit("")), size, " ")


def justified(x: Column, size: int) -> Column:
    return F.lpad(F.rtrim(F.coalesce(x.cast("string"), F.lit(""))), size, " ")


def equal(a: Column, b: Column) -> Column:
    """Comparison of alphanumerics: the shorter one counts as filled with blanks."""
    return F.rtrim(a) == F.rtrim(b)


def zoned(x: Column, digits: int, decimals: int = 0) -> Column:
    """Digits of a number without sign and point, zeros in front."""
    return F.lpad((F.floor(F.abs(number(x)), F.lit(decimals)) * F.lit(10**decimals)).cast("decimal(38,0)").cast("string"), digits, "0")


#: Last characters that carry a digit and its sign.
OVERPUNCH = "{ABCDEFGHI}JKLMNOPQR"


def from_zoned(text: Column, decimals: int = 0, signed: bool = False) -> Column:
    """The number that digits stand for; blanks are 0. `signed`: the last character may carry the sign with its digit."""
    body = F.trim(text)
    plain = body.try_cast("decimal(24,0)")
    if signed:
        last = F.substring(body, -1, 1)
        digits = F.concat(body.substr(F.lit(1), F.length(body) - 1), F.translate(last, OVERPUNCH, "01234567890123456789")).try_cast("decimal(24,0)")
        plain = F.coalesce(plain, F.when(F.instr(F.lit(OVERPUNCH[10:]), last) > 0, -digits).otherwise(digits))
    return (F.coalesce(plain, F.lit(Decimal(0))) / F.lit(Decimal(10) ** decimals)).cast(f"decimal(30,{decimals})")


def edited(x: Column, picture: str) -> Column:
    """A number by an edited picture: Z and * for leading zeros, 9, insertions (, / B 0), a point, floating or single $ + -, and + - CR DB behind.

    The digit positions of the expanded picture are filled from the right; up to the first digit that counts, Z and
    floating signs leave blanks (* stars), and insertions give way with them.
    """
    text = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), picture.upper())
    tail = next((t for t in ("CR", "DB", "+", "-") if text.endswith(t) and not set(text) <= {t}), "")
    body = text[: len(text) - len(tail)]
    # a sign or currency mark that stands twice or more floats: it takes digit positions but the first
    floating = next((c for c in "$+-" if body.count(c) > 1), "")
    lead = next((c for c in "$+-" if c != floating and body.startswith(c)), "")
    body = body[len(lead) :]
    fill = "*" if "*" in body else " "
    point = body.index(".") if "." in body else body.index("V") if "V" in body else len(body)
    shown = body.replace("V", "")
    places = [i for i, c in enumerate(shown) if c in "9Z*" or c == floating]
    if floating:
        places = places[1:]
    decimals = sum(c in "9Z*" or c == floating for c in body[point:])
    digits = zoned(x, max(1, len(places)), decimals)
    digits = F.substring(digits, -len(places), len(places)) if places else digits
    whole = len(places) - decimals
    forced = next((k for k, i in enumerate(places) if shown[i] == "9"), whole)
    # the first digit that counts: the first that isn't 0, but not behind the first 9 or the point
    first = F.least(F.length(F.regexp_extract(digits, "^(0*)", 1)), F.lit(min(forced, whole)))
    sign = {"+": F.when(x < 0, F.lit("-")).otherwise("+"), "-": F.when(x < 0, F.lit("-")).otherwise(" "), "$": F.lit("$")}
    parts, k = [], 0
    for i, c in enumerate(shown):
        if i in places:
            digit = F.substring(digits, k + 1, 1)
            before = F.lit(fill)
            if floating and shown[i + 1 : i + 2] not in (",", "/", "B", "0"):  # else the sign stands where the insertion would
                before = F.when(first == k + 1, sign[floating]).otherwise(F.lit(" "))
            parts.append(F.when(first > k, before).otherwise(digit))
            k += 1
        elif floating and c == floating:
            parts.append(F.when(first == 0, sign[floating]).otherwise(F.lit(" ")))
        elif c in ",/B0":
            mark = F.lit(" " if c == "B" else c)
            gap = F.when(first == k, sign[floating]).otherwise(F.lit(" ")) if floating else F.lit(fill)
            parts.append(F.when(first >= k, gap).otherwise(mark) if 0 < k <= min(forced, whole) else mark)
        else:
            parts.append(F.lit(c))
    ends = {"CR": F.when(x < 0, F.lit("CR")).otherwise("  "), "DB": F.when(x < 0, F.lit("DB")).otherwise("  "), "": F.lit("")} | sign
    return F.concat(sign[lead] if lead else F.lit(""), *parts, ends[tail])


def is_numeric(x: Column) -> Column:
    return F.regexp_replace(x, "[.-]", "").rlike("^[0-9]+$")


def is_alphabetic(x: Column) -> Column:
    return x.rlike("^[\\p{L} ]+$")
