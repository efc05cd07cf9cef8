"""SORT and MERGE: keys by direction, offset and collation, stable by an ordinal; the verbs with their files and procedures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from recordloom.functions.strings import safe_name
from recordloom.operators.ordering import numbered

#: Printable ASCII, and where cp037 puts it: a rule of the codec, not a table of ours.
_ASCII = "".join(map(chr, range(32, 127)))
_EBCDIC = _ASCII.encode("cp037").decode("latin-1")


def collated(column: Column, alphabet: str | None = None) -> Column:
    """A sort key: "EBCDIC", or the letters of a custom alphabet in order (others after them), or as it is."""
    if alphabet is None or alphabet in ("NATIVE", "STANDARD-1", "ASCII"):
        return column
    if alphabet == "EBCDIC":
        return F.translate(column, _ASCII, _EBCDIC)
    rest = "".join(c for c in _ASCII if c not in alphabet)
    order = list(dict.fromkeys(alphabet)) + list(rest)
    return F.translate(column, "".join(order), "".join(chr(0xE000 + i) for i in range(len(order))))


def offset_key(raw: Column, offset: int, size: int, numeric: bool = False, decimals: int = 0) -> Column:
    """A key of a record's characters, from offset (0 is the first): its text, or the number it stands for; blanks and junk are 0."""
    text = F.substring(raw, offset + 1, size)
    if not numeric:
        return text
    return F.coalesce(F.trim(text).try_cast("decimal(30,10)"), F.lit(0).cast("decimal(30,10)")) / F.lit(10**decimals)


def sort_keys(keys: list[tuple[Column, bool]], alphabet: str | None = None) -> list[Column]:
    """(column, ascending) pairs as order expressions."""
    return [(collated(k, alphabet) if alphabet else k).asc() if up else (collated(k, alphabet) if alphabet else k).desc() for k, up in keys]


def sort(df: DataFrame, keys: list[tuple[Column, bool]], alphabet: str | None = None, ordinal: str | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(keys, alphabet), *([F.col(ordinal)] if ordinal else []))


def gathered(inputs: list[DataFrame]) -> DataFrame:
    """All inputs' rows, with the number of the input (_input)."""
    return reduce(DataFrame.unionByName, [x.withColumn("_input", F.lit(i)) for i, x in enumerate(inputs)])


def merge(inputs: list[DataFrame], keys: list[tuple[Column, bool]], alphabet: str | None = None, ordinal: str | None = None) -> DataFrame:
    """MERGE: all inputs by the keys; equal keys in order of the inputs."""
    return gathered(inputs).orderBy(*sort_keys(keys, alphabet), "_input", *([F.col(ordinal)] if ordinal else []))


def placed(df: DataFrame, keys: list[tuple[Column, bool]], alphabet: str | None = None, ordinal: str | None = None, name: str = "place") -> DataFrame:
    """The rows of `sort` with their places, from 1, for sinks and consumers that need the order as data."""
    return numbered(df, [*sort_keys(keys, alphabet), *([F.col(ordinal).asc()] if ordinal else [])], name)


@dataclass
class SortStatement:
    """A parsed SORT or MERGE: keys (item, ascending), files or procedures (first, last paragraph) on either side."""

    verb: str
    work: str
    keys: list[tuple[str, bool]] = field(default_factory=list)
    alphabet: str | None = None
    using: list[str] = field(default_factory=list)
    giving: list[str] = field(default_factory=list)
    input_procedure: tuple[str, str] | None = None
    output_procedure: tuple[str, str] | None = None


def parse_sort(text: str) -> SortStatement:
    """SORT w ON ASCENDING KEY a b DESCENDING KEY c … USING f g | INPUT PROCEDURE p [THRU q] GIVING h | OUTPUT PROCEDURE r."""
    words = re.findall(r"[\w-]+", text.upper())
    if len(words) < 2 or words[0] not in ("SORT", "MERGE"):
        raise SyntaxError(f"not a sort: {text[:40]}")
    out, i, mode, up = SortStatement(words[0], words[1]), 2, "", True
    while i < len(words):
        w = words[i]
        if w in ("ASCENDING", "DESCENDING"):
            mode, up = "keys", w == "ASCENDING"
        elif w in ("USING", "GIVING"):
            mode = w.lower()
        elif w in ("INPUT", "OUTPUT") and words[i + 1 : i + 2] == ["PROCEDURE"]:
            i += 2 + (words[i + 2] == "IS")
            last = words[i + 2] if words[i + 1 : i + 2] in (["THRU"], ["THROUGH"]) else words[i]
            setattr(out, f"{w.lower()}_procedure", (words[i], last))
            i, mode = i + (2 if last != words[i] else 0), ""
        elif w in ("COLLATING", "SEQUENCE"):
            mode = "alphabet"
        elif w in ("ON", "KEY", "IS", "WITH", "DUPLICATES", "IN", "ORDER"):
            pass
        elif mode == "keys":
            out.keys.append((w, up))
        elif mode in ("using", "giving"):
            getattr(out, mode).append(w)
        elif mode == "alphabet":
            out.alphabet, mode = w, ""
        else:
            raise SyntaxError(f"unexpected {w} in {text[:60]}")
        i += 1
    if not out.keys or not (out.using or out.input_procedure) or not (out.giving or out.output_procedure):
        raise SyntaxError(f"a sort needs keys, a source and a target: {text[:60]}")
    return out


def release(*parts: DataFrame) -> DataFrame:
    """RELEASE: what an input procedure hands to the sort, one frame for each of its RELEASE statements, in their order."""
    return gathered(list(parts)).withColumn("_came", F.monotonically_increasing_id())


class Returned:
    """What an output procedure gets: the sorted records as a frame, or one RETURN after another; status 10 is AT END."""

    def __init__(self, frame: DataFrame, order: list[Column]):
        self.frame, self.order = frame, order
        self.status, self._rows = "00", None

    def first(self, records: int) -> DataFrame:
        """What that many RETURNs give, without sorting the rest."""
        return self.frame.orderBy(*self.order).limit(records)

    def __iter__(self) -> Iterator[Row]:
        return self.frame.orderBy(*self.order).toLocalIterator(prefetchPartitions=True)

    def next(self) -> Row | None:
        self._rows = iter(self) if self._rows is None else self._rows
        row = next(self._rows, None)
        self.status = "10" if row is None else "00"
        return row


def run_sort(statement: SortStatement | str, files: Mapping[str, DataFrame], alphabets: Mapping[str, str] | None = None, procedures: Mapping[str, Callable] | None = None) -> dict[str, DataFrame]:
    """Run a SORT or MERGE: by name, the frame of every GIVING file, or what the output procedure returns.

    An input procedure is a function that gives the frame it releases; an output procedure takes a `Returned`. Frames
    in `files` keep the order in which they are read as the order of equal keys; USING files follow each other.
    """
    s = parse_sort(statement) if isinstance(statement, str) else statement
    alphabet = (alphabets or {}).get(s.alphabet, s.alphabet) if s.alphabet else None
    if s.input_procedure:
        work = (procedures or {})[s.input_procedure[0]]()
        work = work if "_came" in work.columns else release(work)
    else:
        work = gathered([files[f].withColumn("_came", F.monotonically_increasing_id()) for f in s.using])
    order = [*sort_keys([(F.col(safe_name(k)), up) for k, up in s.keys], alphabet), F.col("_input").asc(), F.col("_came").asc()]
    if s.output_procedure:
        return {s.output_procedure[0]: (procedures or {})[s.output_procedure[0]](Returned(work, order))}
    done = work.orderBy(*order).drop("_input", "_came")
    return dict.fromkeys(s.giving, done)


def write_sorted(frames: Mapping[str, DataFrame], folder: str, line: Column) -> dict[str, str]:
    """GIVING as files: every frame, sorted once, as lines in files whose names sort as their records do."""
    out = {}
    for name, frame in frames.items():
        out[name] = f"{folder.rstrip('/')}/{safe_name(name)}"
        frame.select(line.alias("value")).write.mode("overwrite").text(out[name])
    return out
