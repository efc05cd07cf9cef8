"""Tools around whole programs: what can be lowered, tests for it, packages of programs, changes put into a source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.plans import corpus
from recordloom.plans.copybook import parse_records
from recordloom.plans.procedure import _HEADING, Unsupported, _Blocks

_DIVISION = re.compile(r"(?im)^[ \t]*(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)[ \t]+DIVISION\b[^.]*\.")


def divisions(text: str) -> dict[str, str]:
    """The divisions of one program's logical lines, by name."""
    body = "\n".join(corpus.logical_lines(text))
    marks = list(_DIVISION.finditer(body))
    return {("IDENTIFICATION" if m[1] == "ID" else m[1]): body[m.end() : marks[i + 1].start() if i + 1 < len(marks) else len(body)] for i, m in enumerate(marks)}


def programs(text: str) -> list[tuple[str, str]]:
    """(name, text) of every program of a source, nested and following ones, each from its IDENTIFICATION DIVISION on."""
    lines = corpus.logical_lines(text)
    starts = [i for i, x in enumerate(lines) if re.match(r"\s*(IDENTIFICATION|ID)\s+DIVISION", x)]
    out = []
    for i, at in enumerate(starts):
        piece = "\n".join(lines[at : starts[i + 1] if i + 1 < len(starts) else len(lines)])
        name = re.search(r"PROGRAM-ID\s*\.\s*([\w-]+)", piece)
        out.append((name[1] if name else "", re.sub(r"(?m)^\s*END\s+PROGRAM\b.*$", "", piece)))
    return out


def paragraphs(procedure: str) -> dict[str, str]:
    """The paragraphs of a procedure division in order; what stands before the first is MAIN."""
    pieces = _HEADING.split(procedure)
    out = dict(zip(pieces[1::2], pieces[2::2], strict=True))
    return ({"MAIN": pieces[0]} if pieces[0].strip() else {}) | out


def declaratives(procedure: str) -> tuple[list[tuple[str, str, str]], str]:
    """(section, what it is used for, its paragraphs) of the DECLARATIVES, and the procedure division without them."""
    m = re.search(r"(?is)\bDECLARATIVES\s*\.(.*?)\bEND\s+DECLARATIVES\s*\.", procedure)
    if not m:
        return [], procedure
    found = re.findall(r"(?is)([\w-]+)\s+SECTION\s*\.\s*USE\s+(.*?)\.(.*?)(?=[\w-]+\s+SECTION\s*\.\s*USE\b|\Z)", m[1])
    return [(name.upper(), " ".join(use.upper().split()), body.strip()) for name, use, body in found], procedure[: m.start()] + procedure[m.end() :]


def handler(uses: list[tuple[str, str, str]], file: str, mode: str) -> str | None:
    """The section that USE AFTER ERROR names for a file, or for the mode in which it is open: the error policy of a scan."""
    after = [(name, use) for name, use, _ in uses if re.search(r"\b(ERROR|EXCEPTION)\b", use)]
    own = next((name for name, use in after if file.upper() in use.split()), None)
    return own or next((name for name, use in after if mode.upper() in use.split()), None)


def problems(text: str) -> list[str]:
    """What of a source can't be lowered: a line for each data description, paragraph or division that fails."""
    out = []
    for name, body in programs(text) or [("", text)]:
        parts = divisions(body)
        if "PROCEDURE" not in parts:
            out.append(f"{name}: no procedure division")
            continue
        data = re.sub(r"(?im)^\s*(FD|SD)\b[^.]*\.|^\s*[\w-]+\s+SECTION\s*\.", "", parts.get("DATA", ""))
        try:
            parse_records(data)
        except (ValueError, IndexError, KeyError) as error:
            out.append(f"{name}: data: {error}")
        for paragraph, statements in paragraphs(declaratives(parts["PROCEDURE"])[1]).items():
            try:
                _Blocks(statements).paragraph()
            except (Unsupported, SyntaxError, IndexError, ValueError) as error:
                out.append(f"{name}: {paragraph}: {error}")
    return out


def validate(files: DataFrame) -> DataFrame:
    """path, problem: everything that can't be lowered, from program texts (path, text); a file without a row is sound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, x) for p, t in zip(batch["path"], batch["text"], strict=True) for x in problems(t or "")], columns=["path", "problem"])

    return files.select("path", "text").mapInPandas(run, "path string, problem string")


def test_module(name: str, text: str) -> str:
    """A pytest module that lowers a program and runs each of its paragraphs that work on a record over one row."""
    parts = divisions(text)
    names = [p for p, body in paragraphs(parts.get("PROCEDURE", "")).items() if not _fails(body)]
    head = f'"""Runs the paragraphs of {name}."""\n\nimport pytest\n\nfrom recordloom.plans.file_program import FileProgram\n\nTEXT = {text!r}\n\n\n'
    return head + f"@pytest.mark.parametrize('paragraph', {names!r})\ndef test_paragraph(spark, paragraph):\n    rows = FileProgram(TEXT).apply(spark.range(1).toDF('_row'), paragraph)\n    assert rows.count() == 1\n"


def _fails(body: str) -> bool:
    try:
        return any(s.verb in ("READ", "WRITE", "OPEN", "CLOSE", "CALL", "ACCEPT") for x in _Blocks(body).paragraph() for s in x.walk())
    except (Unsupported, IndexError):
        return True


def package(files: DataFrame) -> DataFrame:
    """name, text of a package's files: a module with the text of each program, and the call graph as a list."""
    statements = corpus.facts_of(files)
    edges, entries, missing = corpus.call_graph(statements)
    one = statements.select("path", "program").where("program <> ''").distinct().join(files.select("path", "text"), "path")
    modules = one.select(F.concat(F.lower(F.regexp_replace("program", "-", "_")), F.lit(".cob")).alias("name"), "text")
    lines = edges.select(F.concat("caller", F.lit(" calls "), "callee").alias("line")).unionByName(entries.where("program <> ''").select(F.concat("program", F.lit(" is an entry")).alias("line"))).unionByName(missing.select(F.concat("callee", F.lit(" isn't there")).alias("line")))
    graph = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))  # a line for each edge of the call graph
    return modules.unionByName(graph.select(F.lit("CALL_GRAPH.txt").alias("name"), "text"))


def patch(old: str, new: str) -> tuple[str, list[str]]:
    """The old source with those paragraphs taken from the new one that differ, and their names; a changed structure takes all."""
    a, b = divisions(old), divisions(new)
    mine, theirs = paragraphs(a.get("PROCEDURE", "")), paragraphs(b.get("PROCEDURE", ""))
    if a.get("DATA") != b.get("DATA") or list(mine) != list(theirs):
        return new, sorted({*mine, *theirs})
    changed = [n for n in mine if mine[n].split() != theirs[n].split()]
    text = "\n".join(corpus.logical_lines(old))
    for name in changed:
        text = text.replace(mine[name], theirs[name], 1)
    return text, changed
