"""Calls of transaction and database middleware, read from program text: hierarchical databases, CICS, screens, queues.

The calls of a hierarchical database are run by `operators.segments`; the others have no counterpart in a batch plan and
are reported as facts, so that nothing of a program is passed over in silence.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import segments

#: Function codes of the call interface and the verbs of EXEC DLI.
CODES = {"GU  ": "GU", "GHU ": "GHU", "GN  ": "GN", "GHN ": "GHN", "GNP ": "GNP", "GHNP": "GHNP", "ISRT": "ISRT", "REPL": "REPL", "DLET": "DLET"}
VERBS = ("GU", "GHU", "GN", "GHN", "GNP", "GHNP", "ISRT", "REPL", "DLET")


@dataclass
class SegmentCall:
    verb: str
    segment: str | None = None
    into: str | None = None
    source: str | None = None
    where: list[tuple[str, str, str]] = field(default_factory=list)  # item, operator, host variable or literal


def parse_dli(text: str) -> SegmentCall:
    """EXEC DLI verb [USING PCB(n)] SEGMENT(s) [INTO(x)] [FROM(x)] [WHERE(a = b AND …)] END-EXEC."""
    body = re.sub(r"^\s*EXEC\s+DLI\b|\bEND-EXEC\b\.?\s*$", "", text.strip(), flags=re.I).strip()
    words = {"GET UNIQUE": "GU", "GET NEXT IN PARENT": "GNP", "GET NEXT": "GN", "INSERT": "ISRT", "REPLACE": "REPL", "DELETE": "DLET"}
    upper = " ".join(body.upper().split())
    verb = next((v for w, v in words.items() if upper.startswith(w)), upper.split("(")[0].split()[0] if upper else "")
    if verb not in VERBS:
        raise SyntaxError(f"no call of a hierarchical database: {text[:60]}")
    part = {k: m[1].strip().upper() if (m := re.search(rf"\b{k}\s*\(([^)]*)\)", body, re.I)) else None for k in ("SEGMENT", "INTO", "FROM", "WHERE")}
    tests = [tuple(m) for m in re.findall(r"([\w-]+)\s*(>=|<=|<>|=|>|<)\s*([\w.'\"-]+)", part["WHERE"] or "")]
    return SegmentCall(verb, part["SEGMENT"], part["INTO"], part["FROM"], tests)


def parse_call(text: str, values: Mapping[str, str] | None = None) -> SegmentCall:
    """CALL 'CBLTDLI' USING function pcb area [ssa …]: the function is a literal or an item with a known value."""
    m = re.match(r"\s*CALL\s+['\"](?:CBLTDLI|AIBTDLI)['\"]\s+USING\s+(.*?)\.?\s*$", text, re.I | re.S)
    if not m:
        raise SyntaxError(f"no call of a hierarchical database: {text[:60]}")
    names = [w for w in re.findall(r"'[^']*'|\"[^\"]*\"|[\w-]+", m[1]) if w.upper() not in ("BY", "REFERENCE", "CONTENT")]
    code = (names[0].strip("\"'") if names[0][0] in "\"'" else (values or {}).get(names[0].upper(), names[0])).upper()
    verb = CODES.get(code.ljust(4), code.strip())
    if verb not in VERBS:
        raise SyntaxError(f"unknown function {code}")
    area = names[2].upper() if len(names) > 2 else None
    get = verb.startswith("G")
    return SegmentCall(verb, names[3].upper() if len(names) > 3 else None, area if get else None, None if get else area)


class SegmentStore:
    """Segments by name, each a frame with the key columns of its path; calls in order, with the position and status that they leave."""

    def __init__(self, frames: Mapping[str, DataFrame], keys: Mapping[str, list[str]]):
        self.frames = {n.upper(): f for n, f in frames.items()}
        self.keys = {n.upper(): k for n, k in keys.items()}
        self.position: dict[str, list] = {}
        self.status = segments.OK

    def run(self, call: SegmentCall | str, variables: Mapping[str, object] | None = None, record: DataFrame | None = None) -> DataFrame | None:
        """The segment that a GET finds (one row or none), or None. Statuses: blank, GE (none), GB (behind the last)."""
        call = parse_dli(call) if isinstance(call, str) else call
        name = call.segment
        frame, keys = self.frames[name], self.keys[name]
        test = self._where(call, variables or {})
        if call.verb in ("ISRT", "REPL", "DLET"):
            if call.verb == "ISRT":
                self.frames[name] = segments.insert(frame, record.select(*frame.columns))
            elif call.verb == "REPL":
                self.frames[name] = segments.replace(frame, record.select(*frame.columns), keys)
            else:
                gone = frame.where(test) if record is None else record
                below = [(n, [k for k in self.keys[n] if k in keys]) for n in self.frames if n != name and set(keys) <= set(self.keys[n])]
                left = segments.delete([(frame, keys), *[(self.frames[n], on) for n, on in below]], gone)
                self.frames.update(zip([name, *[n for n, _ in below]], left, strict=True))
            self.status = segments.OK
            return None
        if call.verb in ("GU", "GHU"):
            found = segments.get_unique(frame, keys, test)
            missing = segments.NOT_FOUND
        else:
            after = self.position.get(name)
            source = frame.where(test) if call.where else frame
            if call.verb in ("GNP", "GHNP"):
                parent = next((p for n, p in self.position.items() if n != name and set(self.keys[n]) < set(keys)), None)
                above = next((self.keys[n] for n in self.position if n != name and set(self.keys[n]) < set(keys)), [])
                for k, v in zip(above, parent or [], strict=True):
                    source = source.where(F.col(k) == F.lit(v))
                after = after if after and parent and after[: len(above)] == list(parent) else None
                missing = segments.NOT_FOUND
            else:
                missing = segments.END
            found = segments.get_next(source, keys, after)
        row = found.first()
        self.status = missing if row is None else segments.OK
        if row is not None:
            self.position[name] = [row[k] for k in keys]
        return found

    @staticmethod
    def _where(call: SegmentCall, variables: Mapping[str, object]) -> Column:
        out = F.lit(True)
        for item, sign, value in call.where:
            x = F.lit(variables[value]) if value in variables else F.lit(value.strip("\"'"))
            c = F.col(item.lower().replace("-", "_"))
            out = out & {"=": c == x, ">": c > x, "<": c < x, ">=": c >= x, "<=": c <= x, "<>": c != x}[sign]
        return out


#: What an EXEC CICS command is about, by its first words.
CICS = {"SEND MAP": "screen", "RECEIVE MAP": "screen", "SEND TEXT": "screen", "SEND": "screen", "RECEIVE": "screen", "LINK": "call", "XCTL": "call", "RETURN": "return", "READNEXT": "file", "READPREV": "file", "READ": "file", "WRITEQ": "queue", "READQ": "queue", "DELETEQ": "queue", "WRITE": "file", "REWRITE": "file", "DELETE": "file", "STARTBR": "file", "ENDBR": "file", "START": "task", "HANDLE": "handler", "ABEND": "abend", "SYNCPOINT": "commit", "ASKTIME": "time", "FORMATTIME": "time", "GETMAIN": "storage", "FREEMAIN": "storage", "ASSIGN": "system"}


def parse_cics(text: str) -> tuple[str, str, dict[str, str]]:
    """(command, what it is about, its options) of an EXEC CICS block."""
    body = " ".join(re.sub(r"^\s*EXEC\s+CICS\b|\bEND-EXEC\b\.?\s*$", "", text.strip(), flags=re.I).split())
    upper = body.upper()
    command = next((c for c in CICS if re.match(rf"{c}\b", upper)), upper.split("(")[0].split(" ")[0])
    options = {m[0].upper(): m[1].strip().strip("\"'") for m in re.findall(r"([\w-]+)\s*\(([^()]*)\)", body)}
    return command, CICS.get(command, "other"), options


def parse_screen(text: str) -> list[dict[str, object]]:
    """Fields of a SCREEN SECTION: name, line, column, picture, value, using, from, to; a field without a line is on the one before."""
    out: list[dict[str, object]] = []
    line = column = 1
    for sentence in re.split(r"\.(?=\s|$)", text):
        m = re.match(r"\s*(\d+)\s+(.*)$", sentence, re.S)
        if not m or int(m[1]) == 1 and not re.search(r"\b(VALUE|PIC|LINE)\b", m[2], re.I):
            continue
        body = m[2]
        at = {k: re.search(rf"\b{k}\s+(?:NUMBER\s+)?(?:IS\s+)?(PLUS\s+)?(\d+)", body, re.I) for k in ("LINE", "COL(?:UMN)?")}
        line = (line + int(at["LINE"][2]) if at["LINE"][1] else int(at["LINE"][2])) if at["LINE"] else line
        column = (column + int(at["COL(?:UMN)?"][2]) if at["COL(?:UMN)?"][1] else int(at["COL(?:UMN)?"][2])) if at["COL(?:UMN)?"] else column
        name = re.match(r"(?!LINE\b|COL|VALUE\b|PIC|BLANK\b)([A-Za-z][\w-]*)", body)
        found = {k.lower(): (x[1].upper() if (x := re.search(rf"\b{k}\s+([\w-]+)", body, re.I)) else None) for k in ("USING", "FROM", "TO")}
        picture = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", body, re.I)
        value = re.search(r"\bVALUE\s+(?:IS\s+)?(\"[^\"]*\"|'[^']*')", body, re.I)
        out.append({"name": name[1].upper() if name else None, "line": line, "column": column, "picture": picture[1] if picture else None, "value": value[1][1:-1] if value else None} | found)
    return out


def screen_text(fields: list[dict[str, object]], values: Mapping[str, Column], width: int = 80) -> list[Column]:
    """DISPLAY of a screen: one Column a line, up to the last line that has a field."""
    from recordloom.operators.reports import line

    last = max((int(f["line"]) for f in fields), default=0)
    out = []
    for n in range(1, last + 1):
        shown = [(int(f["column"]), F.lit(f["value"]) if f["value"] is not None else values[f["using"] or f["from"]].cast("string")) for f in fields if f["line"] == n and (f["value"] is not None or (f["using"] or f["from"]) in values)]
        out.append(line(shown, width) if shown else F.lit(""))
    return out


def stubs(needs: Mapping[str, bool]) -> dict[str, str]:
    """Python modules with the functions that a program's middleware would have to be given, by file name."""
    made = {"db2": ("execute(statement, variables)", "commit()", "rollback()"), "cics": ("send_map(name, fields)", "receive_map(name)", "link(program, commarea)"), "dli": ("call(function, segment, where)",), "mq": ("put(queue, message)", "get(queue)")}
    return {f"{n}_interface.py": "\n\n".join(f"def {x}:\n    raise NotImplementedError({x!r})" for x in made[n]) + "\n" for n, needed in needs.items() if needed}
