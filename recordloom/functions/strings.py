"""STRING, UNSTRING and INSPECT as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.semantics import pad


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def string(sources: list[tuple[Column, str | None]], size: int, target: Column | None = None, pointer: Column | None = None) -> Column:
    """STRING: sources, each cut at its delimiter (None: by size), one behind the other, in an item of `size`.

    With a pointer the outcome replaces what stands from there on in the target; without, it fills the target.
    """
    joined = F.concat(*[F.substring_index(s, d, 1) if d else s for s, d in sources])
    return pad(joined, size) if pointer is None or target is None else pad(F.overlay(target, joined, pointer), size)


def string_overflow(sources: list[tuple[Column, str | None]], size: int, pointer: Column) -> Column:
    return (pointer < 1) | (pointer - 1 + joined_length(sources) > size)


def joined_length(sources: list[tuple[Column, str | None]]) -> Column:
    """By how much STRING moves its pointer on."""
    total = F.lit(0)
    for s, d in sources:
        total = total + F.length(F.substring_index(s, d, 1) if d else s)
    return total


def consumed(s: Column, delimiters: list[str], fields: int, every: bool = False) -> Column:
    """By how much UNSTRING into that many fields moves its pointer on: their characters and the delimiters behind them."""
    if not delimiters:
        return F.length(s)
    pattern = "|".join(map(_quoted, delimiters))
    ends = f"(?:{pattern})+" if every else f"(?:{pattern})"
    head = F.regexp_extract(s, f"(?s)^((?:(?:(?!{pattern}).)*{ends}){{{fields}}})", 1)
    return F.when(F.size(parts(s, delimiters, every)) > fields, F.length(head)).otherwise(F.length(s))


def parts(s: Column, delimiters: list[str], every: bool = False) -> Column:
    """The fields of UNSTRING as an array; no delimiter: white space. `every`: a run of delimiters counts once (ALL)."""
    if not delimiters:
        return F.split(F.trim(s), "\\s+")
    pattern = "|".join(map(_quoted, delimiters))
    return F.split(s, f"(?:{pattern})+" if every else pattern)


def unstring(s: Column, delimiters: list[str], index: int, size: int, every: bool = False) -> Column:
    """Field `index` (from 1) in an item of `size`; fields beyond the last are blank."""
    return pad(F.coalesce(F.try_element_at(parts(s, delimiters, every), F.lit(index)), F.lit("")), size)


def tally_all(s: Column, what: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))) / len(what)).cast("int")


def tally_leading(s: Column, what: str) -> Column:
    return (F.length(F.regexp_extract(s, f"^((?:{_quoted(what)})*)", 1)) / len(what)).cast("int")


def tally_characters(s: Column) -> Column:
    return F.length(s)


def region(s: Column, before: str | None = None, after: str | None = None) -> tuple[Column, Column, Column]:
    """What stands in front of, in and behind the region of BEFORE / AFTER INITIAL; without a hit it begins or ends with s."""
    start = F.lit(1) if after is None else F.when(F.instr(s, after) > 0, F.instr(s, after) + len(after)).otherwise(1)
    stop = F.length(s) + 1 if before is None else F.when(F.locate(before, s) > 0, F.locate(before, s)).otherwise(F.length(s) + 1)
    stop = F.greatest(stop, start)
    return s.substr(F.lit(1), start - 1), s.substr(start, stop - start), s.substr(stop, F.length(s))


def replace_all(s: Column, a: str, b: str) -> Column:
    return F.replace(s, F.lit(a), F.lit(b))


def replace_first(s: Column, a: str, b: str) -> Column:
    return F.array_join(F.split(s, _quoted(a), 2), b)


def replace_leading(s: Column, a: str, b: str) -> Column:
    head = F.regexp_extract(s, f"^((?:{_quoted(a)})*)", 1)
    return F.concat(F.replace(head, F.lit(a), F.lit(b)), s.substr(F.length(head) + 1, F.length(s)))


def converting(s: Column, a: str, b: str) -> Column:
    if len(a) != len(b):
        raise ValueError("CONVERTING takes strings of equal length")
    return F.translate(s, a, b)


def safe_name(name: str) -> str:
    """Lower case, underscores, and no leading digit."""
    plain = re.sub(r"\W", "_", name.strip().lower())
    return f"f_{plain}" if plain[:1].isdigit() else plain
