"""COPY: sources with their copybooks in place, REPLACING applied, cycles cut."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Endings of copybook files, in order of preference.
ENDINGS = ("", ".cpy", ".cbl", ".cob", ".cobol", ".copy")

_COPY = re.compile(r"(?im)^(?P<lead>(?:.{6} )?[ \t]*)COPY\s+[\"']?(?P<name>[\w.-]+?)[\"']?(?:\s+(?:OF|IN)\s+[\w-]+)?(?P<rest>\s+(?:REPLACING|SUPPRESS)\b(?:==.*?==|[^.=])*?)?\s*\.[ \t]*$", re.S)
#: Text-words: literals, words (hyphens and all), or single marks; white space parts them and doesn't count.
_TEXT_WORD = re.compile(r"\"[^\"]*\"|'[^']*'|[\w-]+|[^\s\w]")


@dataclass(frozen=True)
class Substitution:
    """What a REPLACING phrase asks for: a sequence of text-words gives way to a text; `part` is where in a word it may stand."""

    wanted: tuple[str, ...]
    text: str
    part: str = "whole"  # or its head, or its tail

    def apply(self, words: list[str], at: int) -> tuple[int, str] | None:
        """How many text-words from `at` on it takes, and what stands for them; None where it doesn't match."""
        if self.part == "whole":
            n = len(self.wanted)
            same = [w.upper() for w in words[at : at + n]] == [w.upper() for w in self.wanted]
            return (n, self.text) if n and same else None
        word, piece = words[at], "".join(self.wanted)
        if len(word) <= len(piece) or not piece:
            return None
        if self.part == "head":
            return (1, self.text + word[len(piece) :]) if word.upper().startswith(piece.upper()) else None
        return (1, word[: -len(piece)] + self.text) if word.upper().endswith(piece.upper()) else None


def substitutions(clause: str) -> list[Substitution]:
    """The phrases of a REPLACING clause, read operand by operand: ==pseudo-text==, a literal or a word, BY another."""
    operands = re.findall(r"==(.*?)==|(\"[^\"]*\"|'[^']*'|[\w-]+)", re.sub(r"(?i)^\s*(SUPPRESS\s+)?(REPLACING\b)?", "", clause), re.S)
    out, part, before = [], "whole", None
    waiting = False
    for pseudo, word in operands:
        if before is None and word.upper() in ("LEADING", "TRAILING"):
            part = "head" if word.upper() == "LEADING" else "tail"
        elif before is not None and not waiting and word.upper() == "BY":
            waiting = True
        elif waiting:
            out.append(Substitution(tuple(_TEXT_WORD.findall(before)), " ".join(pseudo.split()) if not word else word, part))
            part, before, waiting = "whole", None, False
        else:
            before = word or pseudo
    return [x for x in out if x.wanted]


def replacing(text: str, changes: list[Substitution]) -> str:
    """The text with its text-words replaced from left to right; at each place the first phrase that matches counts, and what it puts there isn't read again."""
    places = list(_TEXT_WORD.finditer(text))
    words, out, end, i = [m[0] for m in places], [], 0, 0
    while i < len(places):
        hit = next((x for x in (c.apply(words, i) for c in changes) if x), (1, words[i]))
        out += [text[end : places[i].start()], hit[1]]
        i += hit[0]
        end = places[i - 1].end()
    return "".join([*out, text[end:]])


def stem(name: str) -> str:
    """What a COPY name and a file name are matched by."""
    base = name.replace("\\", "/").rsplit("/", 1)[-1].lower()
    return next((base[: -len(e)] for e in ENDINGS[1:] if base.endswith(e)), base)


def expand(text: str, books: Mapping[str, str], inside: frozenset[str] = frozenset()) -> str:
    """The text with its copybooks, inner ones first; for a missing one, or one that would copy itself, a comment line stays."""

    def put(m: re.Match) -> str:
        key = stem(m["name"])
        if key in inside:
            return f"      * left out: copybook {m['name']} copies itself"
        if key not in books:
            return f"      * no copybook {m['name']}"
        return replacing(expand(books[key], books, inside | {key}), substitutions(m["rest"] or "")).rstrip("\n")

    return _COPY.sub(put, text)


def references(files: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys and the stems (`book`) of the copybooks that `text` names."""
    names = F.regexp_extract_all("text", F.lit(r"(?im)^(?:.{6} )?[ \t]*COPY\s+[\"']?([\w.-]+?)(?:\.(?:cpy|cbl|cob|cobol|copy))?[\"']?(?:\s|\.\s*$|\.$)"), 1)
    return files.select(*keys, F.explode(names).alias("book")).withColumn("book", F.lower("book")).distinct()


def expand_files(files: DataFrame, books: DataFrame, depth: int = 64) -> DataFrame:
    """path and expanded text of every file (path, text); books (path, text) are found by stem, preferred by ending.

    Each file is sent only the books it needs, found by joins, one round for each level of nesting: nothing is broadcast.
    Over `depth` levels raise an error. Null texts are empty.
    """
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    ending = F.regexp_extract(base, r"(\.(?:cpy|cbl|cob|cobol|copy))$", 1)
    rank = F.array_position(F.array(*map(F.lit, ENDINGS)), ending)
    shelf = books.select(F.regexp_replace(base, r"\.(?:cpy|cbl|cob|cobol|copy)$", "").alias("book"), F.coalesce("text", F.lit("")).alias("text"), rank.alias("_rank"), "path")
    shelf = shelf.withColumn("_rn", F.row_number().over(Window.partitionBy("book").orderBy("_rank", "path"))).where("_rn = 1").select("book", "text")
    inner = references(shelf.withColumnRenamed("book", "outer"), "outer")
    need = new = references(files, "path")
    for _ in range(depth):
        new = new.withColumnRenamed("book", "outer").join(inner, "outer").select("path", "book").distinct().join(need, ["path", "book"], "left_anti")
        if new.isEmpty():
            break
        need = need.unionByName(new)
    else:
        raise ValueError(f"copybooks are nested over {depth} levels deep")
    sent = need.join(shelf, "book").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("book", "text"))).alias("books"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [expand(t or "", dict(b) if b is not None else {}) for t, b in zip(batch["text"], batch["books"], strict=True)]})

    return files.select("path", "text").join(sent, "path", "left").mapInPandas(run, "path string, text string")
