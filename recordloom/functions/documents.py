"""JSON and XML GENERATE / PARSE, and ACCEPT FROM, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def json_generate(fields: Mapping[str, Column]) -> Column:
    """One object, every value as text; null is empty."""
    return F.to_json(F.struct(*[_text(c).alias(n) for n, c in fields.items()]))


def json_parse(source: Column, names: list[str]) -> dict[str, Column]:
    """The members of that name as text; a missing member or a malformed source gives null."""
    record = F.from_json(source, ", ".join(f"`{n}` string" for n in names))
    return {n: record[n] for n in names}


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_generate(root: str, fields: Mapping[str, Column]) -> Column:
    """One level of elements below the root; an empty one is closed at once."""
    parts = [F.when(F.length(_text(c)) == 0, F.lit(f"<{n} />")).otherwise(F.concat(F.lit(f"<{n}>"), _escaped(_text(c)), F.lit(f"</{n}>"))) for n, c in fields.items()]
    return F.concat(F.lit(f"<{root}>"), *parts, F.lit(f"</{root}>"))


def xml_parse(source: Column, names: list[str]) -> dict[str, Column]:
    """The text of the first element of that name below the root; a missing one gives an empty text."""
    return {n: F.xpath_string(source, F.lit(f"/*/{n}")) for n in names}


#: Forms of ACCEPT … FROM.
FORMS = {"DATE": "yyMMdd", "DATE YYYYMMDD": "yyyyMMdd", "DAY": "yyDDD", "DAY YYYYDDD": "yyyyDDD", "TIME": "HHmmssSS"}


def accept(form: str, now: Column | None = None) -> Column:
    """ACCEPT FROM DATE, DAY, TIME (by FORMS) or DAY-OF-WEEK (Monday is 1), of the query's time or a given one."""
    now, form = F.current_timestamp() if now is None else now, " ".join(form.upper().split())
    if form == "DAY-OF-WEEK":
        return (F.weekday(now) + 1).cast("string")
    if form not in FORMS:
        raise ValueError(f"can't accept from {form}")
    return F.date_format(now, FORMS[form])
