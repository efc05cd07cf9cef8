"""Embedded SQL: statements with host variables, run as parameterised Spark SQL over a program's tables.

Frames don't change, so a statement that changes a table gives the table a new frame: UPDATE is a projection, DELETE a
filter, INSERT a union. COMMIT and ROLLBACK keep or drop what the frames' names stand for.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: Statuses of SQLCODE.
DONE, NOT_FOUND, FAILED = 0, 100, -1

#: Literals and comments are left alone; what else matters are host variables and words.
_PIECE = re.compile(r"('(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/)|:([A-Za-z][\w-]*)|([A-Za-z_][\w.]*)|(\s+|.)", re.S)


def _pieces(text: str) -> list[tuple[str, str]]:
    kinds = ("quoted", "host", "word", "other")
    return [(kinds[m.lastindex - 1], m[m.lastindex]) for m in _PIECE.finditer(text)]


def _parameter(name: str) -> str:
    return name.lower().replace("-", "_")


def _bare(text: str) -> str:
    """The statement without its frame and its comments."""
    text = "".join(" " if k == "quoted" and p[:2] in ("--", "/*") else ":" + p if k == "host" else p for k, p in _pieces(text))
    return re.sub(r"^\s*EXEC\s+SQL\b|\bEND-EXEC\b\.?\s*$", "", text.strip(), flags=re.I).strip()


def prepare(text: str) -> tuple[str, list[str], list[str]]:
    """Statement with :names that Spark accepts, the host variables it reads, and those an INTO fills. Quoted text stays as it is."""
    out, names, targets, into = [], [], [], False
    for kind, piece in _pieces(_bare(text)):
        if kind == "word" and piece.upper() == "INTO" and not re.match(r"\s*INSERT\b", "".join(out), re.I):
            into = True
        elif kind == "word" and into and piece.upper() == "FROM":
            into = False
            out.append(piece)
        elif into:
            targets += [piece.upper()] if kind == "host" else []
        elif kind == "host":
            names.append(piece.upper())
            out.append(":" + _parameter(piece))
        else:
            out.append(piece)
    return "".join(out), list(dict.fromkeys(names)), targets


def run(spark: SparkSession, text: str, variables: Mapping[str, object], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a query; SELECT … INTO gives one row at most, its columns named like the host variables.

    `tables` are seen by their names in this statement alone: views of other names stand for them while it is analysed.
    """
    sql, names, targets = prepare(text)
    views = {name.upper(): f"v{uuid.uuid4().hex}" for name in tables or {}}
    out, before = [], ""
    pieces = _pieces(sql)
    for i, (kind, piece) in enumerate(pieces):
        if kind == "word" and piece.upper() in views and before in ("FROM", "JOIN", ","):
            after = next((p.upper() for k, p in pieces[i + 1 :] if p.strip()), "")
            named = re.fullmatch(r"[A-Z_]\w*", after) and after not in _CLAUSES or after == "AS"
            out.append(views[piece.upper()] + ("" if named else f" AS {piece}"))
        else:
            out.append(":" + piece if kind == "host" else piece)
        before = piece.upper() if piece.strip() else before
    for name, frame in (tables or {}).items():
        frame.createOrReplaceTempView(views[name.upper()])
    try:
        found = spark.sql("".join(out), args={_parameter(n): variables[n] for n in names})
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return found.limit(1).toDF(*map(_parameter, targets)) if targets else found


#: Words that may follow a table's name and aren't another name of it.
_CLAUSES = set("WHERE GROUP ORDER HAVING LIMIT JOIN LEFT RIGHT FULL INNER CROSS ON UNION INTERSECT EXCEPT SEMI ANTI USING NATURAL SET VALUES FOR WINDOW".split())


class Cursor:
    """DECLARE / OPEN / FETCH / CLOSE over a lazy frame; sqlcode is 0, or 100 at the end."""

    def __init__(self, spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self.text, self.tables, self.rows, self.sqlcode = spark, re.sub(r"^.*?\bCURSOR\s+FOR\b", "", text, flags=re.I | re.S), tables, None, 0

    def open(self, variables: Mapping[str, object] | None = None) -> None:
        self.rows, self.sqlcode = run(self.spark, self.text, variables or {}, self.tables).toLocalIterator(), DONE

    def fetch(self):
        row = next(self.rows, None) if self.rows is not None else None
        self.sqlcode = NOT_FOUND if row is None else DONE
        return row

    def close(self) -> None:
        self.rows = None


class Database:
    """A program's tables and SQLCA: statements go in as text, in order; `execute` gives the label that WHENEVER sends it to, or None."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {n.upper(): t for n, t in tables.items()}
        self.committed = dict(self.tables)
        self.sqlca: dict[str, object] = {"SQLCODE": DONE, "SQLERRMC": ""}
        self.whenever: dict[str, str | None] = {"SQLERROR": None, "NOT FOUND": None}
        self.cursors: dict[str, Cursor] = {}
        self.result: DataFrame | None = None

    def execute(self, text: str, variables: dict[str, object]) -> str | None:
        """Run one statement. Host variables that it fills are put into `variables`; a query's rows are in `result`."""
        body = _bare(text)
        first = body.split(None, 1)[0].upper() if body else ""
        steps: dict[str, Callable] = {"INCLUDE": self._include, "WHENEVER": self._whenever, "DECLARE": self._declare, "OPEN": self._open, "FETCH": self._fetch, "CLOSE": self._close, "SELECT": self._select, "WITH": self._select, "INSERT": self._change, "UPDATE": self._change, "DELETE": self._change, "COMMIT": self._commit, "ROLLBACK": self._rollback}
        if first not in steps:
            raise ValueError(f"can't run {first} as embedded SQL")
        code, note = DONE, ""
        try:
            code = steps[first](body, variables) or DONE
        except Exception as error:
            if first in ("WHENEVER", "INCLUDE", "DECLARE") or self.whenever["SQLERROR"] is None:
                raise
            code, note = FAILED, str(error).splitlines()[0]
        if first not in ("WHENEVER", "DECLARE"):
            self.sqlca.update(SQLCODE=code, SQLERRMC=note)
        label = self.whenever["SQLERROR"] if code < 0 else self.whenever["NOT FOUND"] if code == NOT_FOUND else None
        return label if label != "CONTINUE" else None

    def _include(self, body: str, variables: dict) -> int:
        return DONE

    def _whenever(self, body: str, variables: dict) -> int:
        m = re.match(r"WHENEVER\s+(SQLERROR|NOT\s+FOUND|SQLWARNING)\s+(CONTINUE|(?:GO\s*TO|PERFORM)\s+:?([\w-]+))", body, re.I)
        if not m:
            raise ValueError(f"can't read {body}")
        self.whenever[" ".join(m[1].upper().split())] = m[3].upper() if m[3] else "CONTINUE"
        return DONE

    def _declare(self, body: str, variables: dict) -> int:
        m = re.match(r"DECLARE\s+([\w-]+)\s+(?:\w+\s+)*?CURSOR\b", body, re.I)
        if m:
            self.cursors[m[1].upper()] = Cursor(self.spark, body, self.tables)
        return DONE

    def _open(self, body: str, variables: dict) -> int:
        self.cursors[body.split()[1].upper()].open(variables)
        return DONE

    def _fetch(self, body: str, variables: dict) -> int:
        m = re.match(r"FETCH\s+(?:NEXT\s+)?(?:FROM\s+)?([\w-]+)\s+INTO\s+(.*)$", body, re.I | re.S)
        cursor = self.cursors[m[1].upper()]
        row = cursor.fetch()
        if row is not None:
            variables.update(zip([x.upper() for x in re.findall(r":([\w-]+)", m[2])], row, strict=False))
        return cursor.sqlcode

    def _close(self, body: str, variables: dict) -> int:
        self.cursors[body.split()[1].upper()].close()
        return DONE

    def _select(self, body: str, variables: dict) -> int:
        targets = prepare(body)[2]
        self.result = run(self.spark, body, variables, self.tables)
        if not targets:
            return DONE
        row = self.result.first()
        if row is None:
            return NOT_FOUND
        variables.update(zip(targets, row, strict=True))
        return DONE

    def _change(self, body: str, variables: dict) -> int:
        name, query = changed(body, {n: t.columns for n, t in self.tables.items()})
        rows = run(self.spark, query, variables, self.tables)
        columns = self.tables[name].columns
        if body.lstrip()[:1].upper() == "I":
            rows = self.tables[name].unionByName(rows.select(*[rows[c].cast(self.tables[name].schema[c].dataType).alias(c) for c in rows.columns]), allowMissingColumns=True)
        self.tables[name] = rows.select(*columns)
        for cursor in self.cursors.values():
            cursor.tables = self.tables
        return DONE

    def _commit(self, body: str, variables: dict) -> int:
        self.committed = dict(self.tables)
        return DONE

    def _rollback(self, body: str, variables: dict) -> int:
        self.tables = dict(self.committed)
        return DONE


def changed(statement: str, columns: Mapping[str, list[str]]) -> tuple[str, str]:
    """The table that an INSERT, UPDATE or DELETE changes, and a query: the rows that are added, or all rows it has afterwards.

    UPDATE: each assigned column by a CASE of the condition; DELETE: rows whose condition isn't true.
    """
    text = _bare(statement)
    if m := re.match(r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*(VALUES\b.*|SELECT\b.*|WITH\b.*)$", text, re.I | re.S):
        name = m[1].upper()
        names = [x.strip() for x in m[2].split(",")] if m[2] else columns[name]
        return name, f"SELECT * FROM ({m[3]}) AS added({', '.join(names)})"
    if m := re.match(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", text, re.I | re.S):
        return m[1].upper(), f"SELECT * FROM {m[1]} WHERE NOT coalesce({m[2] or 'true'}, false)"
    if m := re.match(r"UPDATE\s+(\w+)\s+SET\s+(.*)$", text, re.I | re.S):
        name, sets, depth, where, current = m[1].upper(), [], 0, "", []
        pieces = _pieces(m[2])
        for i, (kind, piece) in enumerate(pieces):
            depth += (piece == "(") - (piece == ")") if kind == "other" else 0
            if kind == "word" and piece.upper() == "WHERE" and not depth:
                where = "".join(":" + p if k == "host" else p for k, p in pieces[i + 1 :])
                break
            if piece == "," and kind == "other" and not depth:
                sets.append("".join(current))
                current = []
            else:
                current.append(":" + piece if kind == "host" else piece)
        sets.append("".join(current))
        values = {k.strip().upper(): v.strip() for k, v in (x.split("=", 1) for x in sets)}
        known = {c.upper() for c in columns[name]}
        if not set(values) <= known:
            raise ValueError(f"{name} has no {', '.join(sorted(set(values) - known))}")
        shown = [f"CASE WHEN {where or 'true'} THEN {values[c.upper()]} ELSE {c} END AS {c}" if c.upper() in values else c for c in columns[name]]
        return name, f"SELECT {', '.join(shown)} FROM {m[1]}"
    raise ValueError(f"can't read {text[:60]}")
