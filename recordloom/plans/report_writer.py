"""Report Writer: RD descriptions, and the lines that INITIATE, GENERATE and TERMINATE print, as one ordered frame.

Details are put in order of the controls, then of the given columns. A control group's heading stands before its first
detail and its footing behind its last, for every level, with sums of the group; FINAL is the group of all. Body lines
fill the pages between FIRST DETAIL and LAST DETAIL, and every page has its heading and footing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.semantics import edited, pad, zoned
from recordloom.functions.strings import safe_name
from recordloom.operators.ordering import numbered
from recordloom.operators.reports import line
from recordloom.plans.copybook import parse_picture


@dataclass
class Field:
    column: int
    picture: str = ""
    source: str | None = None
    sum: str | None = None
    value: str | None = None
    indicate: bool = False


@dataclass
class Group:
    kind: str  # REPORT HEADING, PAGE HEADING, CONTROL HEADING, DETAIL, CONTROL FOOTING, PAGE FOOTING, REPORT FOOTING
    name: str = ""
    control: str | None = None
    lines: list[list[Field]] = field(default_factory=list)


@dataclass
class ReportSpec:
    name: str
    controls: list[str] = field(default_factory=list)  # major first, FINAL left out
    limit: int = 0
    heading: int = 1
    first: int = 1
    last: int = 0
    footing: int = 0
    groups: list[Group] = field(default_factory=list)

    def of(self, kind: str, control: str | None = None) -> list[Group]:
        return [g for g in self.groups if g.kind == kind and (control is None or g.control == control)]


#: Types of report groups by their names and abbreviations.
KINDS = {"RH": "REPORT HEADING", "PH": "PAGE HEADING", "CH": "CONTROL HEADING", "DE": "DETAIL", "CF": "CONTROL FOOTING", "PF": "PAGE FOOTING", "RF": "REPORT FOOTING"}
_NAMES = "|".join(sorted([*(k.replace(" ", r"\s+") for k in KINDS.values()), *KINDS], key=len, reverse=True))


def parse_reports(text: str) -> list[ReportSpec]:
    """The RDs of a REPORT SECTION with their groups, lines and fields."""
    out: list[ReportSpec] = []
    for sentence in re.split(r"\.(?=\s|$)", "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("*"))):
        words = sentence.strip()
        if m := re.match(r"RD\s+([\w-]+)(.*)$", words, re.I | re.S):
            out.append(_header(m[1].upper(), m[2].upper()))
        elif (m := re.match(r"(\d+)\s+(.*)$", words, re.S)) and out:
            _entry(out[-1], m[2])
    return out


def _header(name: str, rest: str) -> ReportSpec:
    def number(pattern: str, default: int) -> int:
        m = re.search(pattern + r"\s+(?:IS\s+|ARE\s+)?(\d+)", rest)
        return int(m[1]) if m else default

    controls = re.search(r"\bCONTROLS?\s+(?:IS\s+|ARE\s+)?((?:[\w-]+\s*,?\s*)+?)(?=\bPAGE\b|\bHEADING\b|\bFIRST\b|$)", rest)
    names = [c for c in re.findall(r"[\w-]+", controls[1]) if c != "FINAL"] if controls else []
    limit = number(r"\bPAGE(?:\s+LIMITS?)?", 0)
    first, last = number(r"\bFIRST\s+DETAIL", 1), number(r"\bLAST\s+DETAIL", limit)
    return ReportSpec(name, names, limit, number(r"\bHEADING", 1), first, last, number(r"\bFOOTING", limit))


def _entry(spec: ReportSpec, rest: str) -> None:
    literal = re.search(r"\bVALUE\s+(?:IS\s+)?(\"[^\"]*\"|'[^']*')", rest, re.I)
    upper = re.sub(r"\"[^\"]*\"|'[^']*'", "''", rest).upper()
    if m := re.search(rf"\bTYPE\s+(?:IS\s+)?({_NAMES})\b(?:\s+(?:ON\s+|FOR\s+)?(?!LINE\b|COLUMN\b|NEXT\b)([A-Z][\w-]*))?", upper):
        kind = " ".join(m[1].split())
        kind = KINDS.get(kind, kind)
        name = re.match(r"(?!TYPE\b|LINE\b|COLUMN\b)([A-Z0-9][\w-]*)", upper)
        control = (m[2] or "FINAL") if kind.startswith("CONTROL") else None
        spec.groups.append(Group(kind, name[1] if name else "", control))
    if not spec.groups:
        return
    group = spec.groups[-1]
    if re.search(r"(?<![\w-])LINE(?![\w-])", upper):
        group.lines.append([])
    at = re.search(r"(?<![\w-])COL(?:UMN)?\s+(?:NUMBER\s+)?(?:IS\s+)?(\d+)", upper)
    if not at:
        return
    if not group.lines:
        group.lines.append([])
    found = {k: re.search(rf"\b{k}\s+(?:IS\s+)?([\w-]+)", upper) for k in ("SOURCE", "SUM")}
    picture = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", upper)
    group.lines[-1].append(Field(int(at[1]), picture[1] if picture else "", *(found[k][1] if found[k] else None for k in ("SOURCE", "SUM")), literal[1][1:-1] if literal else None, "GROUP INDICATE" in " ".join(upper.split()) or bool(re.search(r"\bGROUP\b(?!\s+(?:IS\s+)?(?:PLUS|NEXT|\d))", upper))))


def shown(value: Column, picture: str) -> Column:
    """A value as a report's picture prints it."""
    if not picture:
        return value.cast("string")
    p = parse_picture(picture)
    if p.kind == "edited":
        return edited(value, p.text)
    return zoned(value, p.int_digits + p.decimals, p.decimals) if p.kind == "numeric" else pad(value, p.size)


def _texts(group: Group, width: int, indicated: bool = True, sums: bool = False) -> list[Column]:
    out = []
    for fields in group.lines or [[]]:
        parts = []
        for f in fields:
            if f.indicate and not indicated:
                continue
            if f.value is not None:
                parts.append((f.column, F.lit(f.value)))
            elif f.sum is not None:
                parts.append((f.column, shown(F.col(f"_sum_{safe_name(f.sum)}"), f.picture)))
            elif f.source is not None:
                name = {"PAGE-COUNTER": "page", "LINE-COUNTER": "line"}.get(f.source, safe_name(f.source))
                parts.append((f.column, shown(F.col(name), f.picture)))
        out.append(line(parts, width) if parts else F.lit(""))
    return out


def _printed(frame: DataFrame, group: Group, place: Column, sub: int, width: int) -> DataFrame:
    """(_place, _sub, kind, text, plain) of a group's lines for every row; plain leaves out what is GROUP INDICATE."""
    both = zip(_texts(group, width), _texts(group, width, indicated=False), strict=True)
    lines = F.array(*[F.struct(F.lit(j).alias("j"), a.alias("text"), b.alias("plain")) for j, (a, b) in enumerate(both)])
    return frame.select(place.alias("_place"), F.lit(sub).alias("_sub"), F.lit(group.kind).alias("kind"), F.inline(lines))


def report_rows(spec: ReportSpec, details: DataFrame, order: list[str], width: int = 132) -> DataFrame:
    """page, line, kind and text of every line of the report, in no order: sort by page and line to print.

    Nothing gathers all details: places come from ranges of the order, groups from aggregates over the controls, and
    a group's heading and footing stand at the places of its first and last detail. Without details the report has
    its heading and footings alone.
    """
    controls = [safe_name(c) for c in spec.controls]
    placed = numbered(details, [*[F.col(c).asc() for c in controls], *[F.col(c).asc() for c in order]], "_place")
    sums = {safe_name(f.sum) for g in spec.groups for fields in g.lines for f in fields if f.sum}
    totals = [F.coalesce(F.sum(s), F.lit(0)).alias(f"_sum_{s}") for s in sorted(sums)]
    ends = [F.min("_place").alias("_first"), F.max("_place").alias("_last")]
    parts: list[DataFrame] = []
    minor = placed.groupBy(*controls).agg(*ends).select(F.col("_first").alias("_place"), F.lit(True).alias("_new")) if controls else None
    marked = placed.join(minor, "_place", "left").withColumn("_new", F.coalesce("_new", F.lit(False))) if minor is not None else placed.withColumn("_new", F.col("_place") == 1)
    for group in spec.of("DETAIL"):
        fresh = _printed(marked.where("_new"), group, F.col("_place"), 0, width).drop("plain").withColumn("plain", F.col("text"))
        parts += [fresh, _printed(marked.where("NOT _new"), group, F.col("_place"), 0, width)]
    for depth in range(1, len(controls) + 1):
        groups = placed.groupBy(*controls[:depth]).agg(*ends, *totals)
        parts += [_printed(groups, g, F.col("_first"), depth - 100, width) for g in spec.of("CONTROL HEADING", spec.controls[depth - 1])]
        parts += [_printed(groups, g, F.col("_last"), 100 - depth, width) for g in spec.of("CONTROL FOOTING", spec.controls[depth - 1])]
    whole = placed.agg(F.coalesce(F.max("_place"), F.lit(0)).alias("_last"), *totals)
    parts += [_printed(whole, g, F.lit(0).cast("bigint"), -1, width) for g in spec.of("REPORT HEADING")]
    parts += [_printed(whole, g, F.lit(0).cast("bigint"), 1, width) for g in spec.of("CONTROL HEADING", "FINAL")]
    parts += [_printed(whole, g, F.col("_last") + 1, 1, width) for g in spec.of("CONTROL FOOTING", "FINAL")]
    parts += [_printed(whole, g, F.col("_last") + 1, 2, width) for g in spec.of("REPORT FOOTING")]
    if not parts:
        raise ValueError(f"{spec.name} has no body groups")
    body = parts[0]
    for p in parts[1:]:
        body = body.unionByName(p)
    body = numbered(body, [F.col("_place").asc(), F.col("_sub").asc(), F.col("j").asc()], "_k")
    depth = max(1, spec.last - spec.first + 1) if spec.limit else None
    page = F.floor((F.col("_k") - 1) / depth).cast("int") + 1 if depth else F.lit(1)
    at = ((F.col("_k") - 1) % depth).cast("int") + spec.first if depth else F.col("_k").cast("int")
    # what is GROUP INDICATE is also printed on a page's first line
    out = body.select(page.alias("page"), at.alias("line"), "kind", F.when((F.col("kind") != "DETAIL") | (at == spec.first), F.col("text")).otherwise(F.col("plain")).alias("text"))
    pages = out.agg(F.coalesce(F.max("page"), F.lit(1)).alias("_pages")).select(F.explode(F.sequence(F.lit(1), F.col("_pages"))).alias("page"))
    for kind, top in (("PAGE HEADING", spec.heading), ("PAGE FOOTING", spec.footing or spec.limit)):
        for group in spec.of(kind):
            numbered_page = pages.withColumn("line", F.lit(top))
            lines = F.array(*[F.struct((F.lit(top) + j).alias("at"), t.alias("text")) for j, t in enumerate(_texts(group, width))])
            out = out.unionByName(numbered_page.select("page", F.lit(kind).alias("kind"), F.inline(lines)).withColumnRenamed("at", "line"))
    return out


class ReportRun:
    """INITIATE, GENERATE and TERMINATE of one report: details gather as a plan; the lines come at the end."""

    def __init__(self, spec: ReportSpec):
        self.spec, self.details, self.active = spec, [], False

    def initiate(self) -> None:
        self.details, self.active = [], True

    def generate(self, details: DataFrame) -> None:
        if not self.active:
            raise ValueError(f"{self.spec.name} isn't initiated")
        self.details.append(details.withColumn("_batch", F.lit(len(self.details))))

    def terminate(self, order: list[str], width: int = 132) -> DataFrame:
        if not self.details:
            raise ValueError(f"{self.spec.name} has generated nothing")
        rows = self.details[0]
        for more in self.details[1:]:
            rows = rows.unionByName(more)
        self.active = False
        return report_rows(self.spec, rows, ["_batch", *order], width)


def write_report(rows: DataFrame, folder: str, name: str) -> str:
    """The report as text, a line each, in files whose names sort as its pages do: <name>_report.txt is a folder."""
    path = f"{folder.rstrip('/')}/{safe_name(name)}_report.txt"
    rows.orderBy("page", "line").select("text").write.mode("overwrite").text(path)
    return path
