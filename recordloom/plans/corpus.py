"""Programs as data: source files to fact tables, and the analytics over them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name patterns that mark sensitive items, in order of precedence.
SENSITIVE = [
    ("(^|-)SSN(-|$)", "HIGH"), ("(^|-)SOCIAL-SEC", "HIGH"), ("(^|-)TAX-ID(-|$)", "HIGH"), ("(^|-)DOB(-|$)", "HIGH"), ("(^|-)BIRTH(-|$)", "HIGH"), ("PASSWORD", "HIGH"), ("(^|-)PIN(-|$)", "HIGH"),
    ("ACCOUNT", "MEDIUM"), ("BALANCE", "MEDIUM"), ("SALARY", "MEDIUM"), ("(^|-)WAGE(-|$)", "MEDIUM"), ("CREDIT", "MEDIUM"), ("PAYMENT", "MEDIUM"),
    ("^CUST-", "LOW"), ("^EMP-", "LOW"), ("ADDR", "LOW"), ("PHONE", "LOW"), ("EMAIL", "LOW"),
]
#: Names that are never sensitive.
EXCLUDED = ("WS-EOF", "WS-ERROR", "FILLER")
#: Categories of open points and the words that mark them, in order of precedence.
CATEGORIES = {
    "DB2 / SQL": ("SQL", "CURSOR", "FETCH", "SQLCODE", "COMMIT", "ROLLBACK", "DB-API"),
    "CICS": ("CICS", "MAP", "TRANSID", "COMMAREA", "BMS", "FLASK", "EIBTRNID"),
    "DLI / IMS": ("DLI", "IMS", "CBLTDLI", "AIBTDLI", "PCB", "SSA", "SEGMENT"),
    "File I/O": ("READ", "WRITE", "OPEN", "CLOSE", "FILE", "REWRITE", "DELETE", "START"),
    "External CALL": ("CALL", "IMPLEMENT OR IMPORT", "ENTRY"),
    "Control Flow": ("PERFORM", "GO TO", "IF", "EVALUATE", "ALTER", "THRU"),
    "String Ops": ("STRING", "UNSTRING", "INSPECT", "POINTER"),
    "Data / MOVE": ("MOVE", "CORRESPONDING", "GROUP", "REDEFINES"),
    "Arithmetic": ("COMPUTE", "ADD", "SUBTRACT", "DIVIDE", "MULTIPLY", "SIZE ERROR"),
}
_VERBS = "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE DELETE DISABLE DISPLAY DIVIDE ENABLE ENTRY EVALUATE EXEC EXIT GENERATE GO GOBACK IF INITIALIZE INITIATE INSPECT JSON MERGE MOVE MULTIPLY OPEN PERFORM PURGE READ RECEIVE RELEASE RETURN REWRITE SEARCH SEND SET SORT START STOP STRING SUBTRACT TERMINATE UNSTRING WRITE XML".split()
_VERB = re.compile(r"(?<![\w-])(" + "|".join(_VERBS) + r")(?![\w-])")
FACTS = "path string, program string, paragraph string, par_no int, stmt_no int, verb string, target string, text string"


#: What a line among the first SAMPLE tells of the format: free format gains, fixed format gains.
SAMPLE, NOTE, INLINE_NOTE, DIVISION, INDICATOR, NUMBERED = 80, 3, 2, 2, 2, 1
_DIVISION = re.compile(r"\s{0,6}(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION", re.I)


def _leaning(x: str) -> int:
    """Above 0 for a line that looks free, below for one that looks fixed."""
    if x.lstrip().startswith("*>"):
        return NOTE
    free = INLINE_NOTE * (" *>" in x) + DIVISION * bool(_DIVISION.match(x))
    if len(x) < 7:
        return free
    margin, mark = x[:6].strip(), x[6]
    if mark in "*-/Dd" and (not margin or margin.isdigit()):
        return free - INDICATOR
    return free - NUMBERED * (mark == " " and bool(margin))


def is_free(text: str) -> bool:
    """Whether a source is in free format, by the scores of its first lines; where these are even, unless any line has a
    sequence number or something behind column 72. A source without lines is fixed."""
    lines = [x for x in text.splitlines() if x.strip()]
    seen = [x for x in text.splitlines()[:SAMPLE] if x.strip()]
    score = sum(map(_leaning, seen))
    if score or not seen:
        return score > 0
    return not any(x[:6].strip().isdigit() and len(x) >= 6 or x[72:].strip() for x in lines)


def logical_lines(text: str) -> list[str]:
    """Source lines without sequence numbers, comments and what lies behind column 72 of fixed format; continued lines are joined."""
    fixed = not is_free(text)
    lines = text.upper().splitlines()
    out: list[str] = []
    for x in lines:
        if fixed:
            mark, body = x[6:7], x[7:72]
            if mark in ("*", "/") or not body.strip():
                continue
            if mark == "-" and out:
                out[-1] = out[-1].rstrip() + body.strip().lstrip("\"'")
                continue
            out.append(body.rstrip())
        elif x.strip() and not x.lstrip().startswith(("*>", "*")):
            out.append(x.split("*>")[0].rstrip())
    return out


def parse_program(text: str) -> list[tuple]:
    """(program, paragraph, paragraph number, statement number, verb, target, text) of a source text."""
    rows: list[tuple] = []
    program, paragraph, par, stmt, inside, buffer = "", "MAIN", 0, 0, False, ""

    def flush() -> None:
        nonlocal stmt, buffer
        starts = [m.start() for m in _VERB.finditer(re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: "_" * len(m[0]), buffer))]
        for a, b in zip(starts, [*starts[1:], len(buffer)] if starts else [], strict=True):
            piece = " ".join(buffer[a:b].split())
            verb = piece.split()[0]
            m = {"CALL": r"CALL\s+[\"']?([\w-]+)", "PERFORM": r"PERFORM\s+(?!UNTIL|VARYING|\d)([\w-]+)", "GO": r"GO\s+(?:TO\s+)?([\w-]+)", "ALTER": r"TO\s+(?:PROCEED\s+TO\s+)?([\w-]+)"}.get(verb)
            found = re.search(m, piece) if m else None
            rows.append((program, paragraph, par, stmt, verb, found[1] if found else None, piece))
            stmt += 1
        buffer = ""

    lines = logical_lines(text)
    # headings stand where divisions do, or a little to the right; operands on lines of their own stand further in
    margin = 3 + min((len(x) - len(x.lstrip()) for x in lines if re.search(r"\bDIVISION\b", x)), default=0)
    for x in lines:
        if m := re.match(r"\s*PROGRAM-ID\.\s*([\w-]+)", x):
            flush()
            program, paragraph, par, stmt, inside = m[1], "MAIN", 0, 0, False
        elif re.match(r"\s*PROCEDURE\s+DIVISION", x):
            inside = True
        elif inside and (m := re.match(r"(\s*)([A-Z0-9][\w-]*)(?:\s+SECTION)?\s*\.\s*$", x)) and len(m[1]) <= margin and m[2] not in _VERBS and not m[2].startswith("END-"):
            flush()
            paragraph, par = m[2], par + 1
        elif inside:
            buffer += " " + x
            if x.rstrip().endswith("."):
                flush()
    flush()
    return rows


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Statements of all .cob, .cbl and .cobol files below a folder; files are parsed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike("\\.(cob|cbl|cobol)$"))
    return facts_of(files.select("path", F.col("content").cast("string").alias("text")))


def facts_of(files: DataFrame) -> DataFrame:
    """Statements of program texts (path, text); a null text has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch["path"], batch["text"], strict=True) for r in parse_program(t or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])

    return files.select("path", "text").mapInPandas(parse, FACTS)


def load_config(text: str) -> tuple[list[tuple[str, str]], tuple[str, ...], list[str]]:
    """Patterns (regular expression, level) and excluded names of a JSON configuration, and what was wrong with it.

    `sensitive_patterns` holds objects with pattern, level (high, medium or low) and reason, `exclude_names` names;
    what is missing is as it is without a configuration. An entry that can't be used is left out and noted.
    """
    try:
        data = json.loads(text)
    except json.JSONDecodeError as error:
        return SENSITIVE, EXCLUDED, [f"not JSON: {error}"]
    notes, patterns = [], []
    if not isinstance(data, dict):
        return SENSITIVE, EXCLUDED, ["not a JSON object"]
    for i, entry in enumerate(data.get("sensitive_patterns", [])):
        problem = _problem(entry)
        if problem:
            notes.append(f"pattern {i}: {problem}")
        else:
            patterns.append((entry["pattern"], entry["level"].upper()))
    excluded = tuple(n.upper() for n in data["exclude_names"]) if "exclude_names" in data else EXCLUDED
    return (patterns if "sensitive_patterns" in data else SENSITIVE), excluded, notes


def _problem(entry: object) -> str | None:
    if not isinstance(entry, dict) or not {"pattern", "level", "reason"} <= set(entry):
        return "pattern, level and reason are needed"
    if str(entry["level"]).lower() not in ("high", "medium", "low"):
        return f"no such level: {entry['level']}"
    try:
        re.compile(entry["pattern"])
    except (re.error, TypeError) as error:
        return f"no regular expression: {error}"
    return None


def sensitivity(name: Column, patterns: list[tuple[str, str]] | None = None, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Level of the first pattern that a name matches; null for other and for excluded names."""
    upper = F.upper(name)
    out = F.when(upper.isin(*excluded), F.lit(None).cast("string")) if excluded else F.when(F.lit(False), "")
    for pattern, level in SENSITIVE if patterns is None else patterns:
        out = out.when(upper.rlike(f"(?i){pattern}"), level)
    return out


def category(text: Column) -> Column:
    """The first category one of whose words a text contains, or Other."""
    out, upper = F.when(F.lit(False), ""), F.upper(text)
    for name, words in CATEGORIES.items():
        hit = upper.contains(words[0])
        for w in words[1:]:
            hit = hit | upper.contains(w)
        out = out.when(hit, name)
    return out.otherwise("Other")


def triage(points: DataFrame) -> DataFrame:
    """category, n and percent of all, from open points with `text`."""
    counts = points.select(category(F.col("text")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))  # a row for each category


def triage_programs(programs: DataFrame, points: DataFrame) -> DataFrame:
    """Every program with its number of open points, and whether it is clean."""
    counts = points.groupBy("program").agg(F.count("*").alias("n"))
    return programs.select("program").distinct().join(counts, "program", "left").select("program", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("clean"))


def line_counts(sources: DataFrame) -> DataFrame:
    """program and its total, code, comment and blank lines, from (program, line, free): one row a source line, free format or not."""
    blank = F.trim(F.regexp_replace("line", "\\s", " ")) == ""
    comment = ~blank & F.when(F.col("free"), F.ltrim("line").startswith("*>")).otherwise(F.substring("line", 7, 1).isin("*", "/"))
    return sources.groupBy("program").agg(F.count("*").alias("total"), F.count_if(~blank & ~comment).alias("code"), F.count_if(comment).alias("comments"), F.count_if(blank).alias("blanks"))


def warnings(statements: DataFrame, items: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """(program, warning): jumps, altered jumps, unreached paragraphs, copybooks that aren't there (program, book), and highly sensitive items (program, name)."""
    where = F.col("paragraph")
    text = F.when(F.col("verb") == "GO", F.concat(F.lit("GO TO in "), where)).when(F.col("verb") == "ALTER", F.concat(F.lit("ALTER in "), where))
    out = statements.select("program", text.alias("warning")).where("warning is not null")
    out = out.unionByName(flow(statements)[1].select("program", F.concat(F.lit("Unreachable paragraph: "), where).alias("warning")))
    if missing is not None:
        out = out.unionByName(missing.select("program", F.concat(F.lit("Missing copybook: "), F.col("book")).alias("warning")))
    if items is not None:
        high = items.where(sensitivity(F.col("name")) == "HIGH").groupBy("program").agg(F.count("*").alias("n"))
        out = out.unionByName(high.select("program", F.concat(F.col("n").cast("string"), F.lit(" highly sensitive items")).alias("warning")))
    return out


def call_graph(statements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(caller, callee) edges, entry points that no program calls, and targets that aren't there."""
    edges = statements.where("verb = 'CALL' and target is not null").select(F.col("program").alias("caller"), F.col("target").alias("callee")).distinct()
    programs = statements.select("program").distinct()
    entries = programs.join(edges, F.col("program") == F.col("callee"), "left_anti")
    missing = edges.join(programs, F.col("callee") == F.col("program"), "left_anti").select("callee").distinct()
    return edges, entries, missing


def flow(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between paragraphs (SEQUENTIAL, GOTO, PERFORM, ALTER) and the paragraphs, but a program's first, that nothing leads to."""
    kinds = {"GO": "GOTO", "PERFORM": "PERFORM", "ALTER": "ALTER"}
    jumps = statements.where(F.col("verb").isin(list(kinds)) & F.col("target").isNotNull()).select("program", F.col("paragraph").alias("source"), "target", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("verb")].alias("kind"))
    last = F.row_number().over(Window.partitionBy("program", "par_no").orderBy(F.desc("stmt_no")))
    ends = statements.withColumn("_rn", last).where("_rn = 1").select("program", "paragraph", "par_no", "verb", F.min("par_no").over(Window.partitionBy("program")).alias("_first"))
    follow = ends.withColumn("target", F.lead("paragraph").over(Window.partitionBy("program").orderBy("par_no"))).where(F.col("target").isNotNull() & ~F.col("verb").isin("GO", "STOP", "GOBACK")).select("program", F.col("paragraph").alias("source"), "target", F.lit("SEQUENTIAL").alias("kind"))
    edges = jumps.unionByName(follow).distinct()
    unreached = ends.where("par_no > _first").join(edges.select("program", F.col("target").alias("paragraph")).distinct(), ["program", "paragraph"], "left_anti").select("program", "paragraph")
    return edges, unreached


def verb_counts(statements: DataFrame) -> DataFrame:
    return statements.groupBy("program", "verb").count()


def fingerprints(statements: DataFrame) -> DataFrame:
    """A digest of each paragraph's statements in order."""
    texts = statements.groupBy("program", "paragraph").agg(F.array_sort(F.collect_list(F.struct("stmt_no", "verb", "text"))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["verb"], x["text"])), "|")
    return texts.select("program", "paragraph", F.substring(F.sha2(joined, 256), 1, 16).alias("digest"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, modified or unchanged, for every paragraph of two fingerprint tables."""
    keys = ["program", "paragraph"]
    a, b = old.withColumnRenamed("digest", "_old"), new.withColumnRenamed("digest", "_new")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return a.join(b, keys, "full").select(*keys, kind.alias("change"))


def change_summary(found: DataFrame, old: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """Per program: numbers of added, removed, modified and unchanged paragraphs, and whether it must be taken anew as a whole.

    That is so where paragraphs came or went, or where the data (program, digest) of `old` and `new` differ.
    """
    counts = found.groupBy("program").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "unchanged")])
    whole = (F.col("added") > 0) | (F.col("removed") > 0)
    if old is None or new is None:
        return counts.withColumn("structural", whole)
    data = old.withColumnRenamed("digest", "_a").join(new.withColumnRenamed("digest", "_b"), "program", "full").select("program", (~F.col("_a").eqNullSafe(F.col("_b"))).alias("_data"))
    return counts.join(data, "program", "left").select(*counts.columns, (whole | F.coalesce("_data", F.lit(False))).alias("structural"))


def digests(items: DataFrame, order: str = "item_no") -> DataFrame:
    """A digest of each program's data: its items (program, name, picture) in order."""
    texts = items.groupBy("program").agg(F.array_sort(F.collect_list(F.struct(order, F.concat_ws(":", "name", "picture").alias("t")))).alias("s"))
    return texts.select("program", F.substring(F.sha2(F.array_join(F.transform("s", lambda x: x["t"]), "|"), 256), 1, 16).alias("digest"))


#: Categories of a review and the words that mark them, in order of precedence.
REVIEW = {
    "Control Flow": ("PERFORM", "GO TO", "IF", "EVALUATE", "ALTER"), "String Operations": ("STRING", "UNSTRING", "INSPECT", "POINTER"), "Data Movement": ("MOVE", "CORRESPONDING", "GROUP"),
    "Arithmetic": ("COMPUTE", "ADD", "SUBTRACT", "DIVIDE", "MULTIPLY", "SIZE"), "File I/O": ("READ", "WRITE", "OPEN", "CLOSE", "FILE", "CALL"), "CICS/SQL": ("CICS", "SQL", "EXEC", "FLASK"),
}


def review(points: DataFrame) -> DataFrame:
    """Every open point (text, any other columns) with its category in a review."""
    upper, out = F.upper("text"), F.when(F.lit(False), "")
    for name, words in REVIEW.items():
        out = out.when(F.arrays_overlap(F.array(F.lit(True)), F.array(*[upper.contains(w) for w in words])), name)
    return points.withColumn("category", out.otherwise("Other"))


def ranked_programs(counted: DataFrame) -> DataFrame:
    """Programs by their number of open points, most first: a report's order as a column."""
    from recordloom.operators.ordering import numbered

    return numbered(counted, [F.col("n").desc(), F.col("program").asc()], "rank")


def middleware(statements: DataFrame) -> DataFrame:
    """Per program, what it needs besides files: db2, cics, dli, mq."""
    text = F.upper("text")
    hits = {"db2": r"\bEXEC\s+SQL\b", "cics": r"\bEXEC\s+CICS\b|\bDFH\w+", "dli": r"\bEXEC\s+DLI\b|CBLTDLI|AIBTDLI", "mq": r"MQ(PUT|GET|OPEN|CLOSE|CONN|DISC)"}
    return statements.groupBy("program").agg(*[F.bool_or(text.rlike(p)).alias(n) for n, p in hits.items()])


def project_middleware(statements: DataFrame) -> DataFrame:
    """One row: what any program of the project needs."""
    return middleware(statements).agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in ("db2", "cics", "dli", "mq")])


def statistics(statements: DataFrame, lines: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Per program: paragraphs, statements and, where they are given, line counts and data items."""
    out = statements.groupBy("program").agg(F.count_distinct("paragraph").alias("paragraphs"), F.count("*").alias("statements"))
    for more in (line_counts(lines) if lines is not None else None, items.groupBy("program").agg(F.count("*").alias("items")) if items is not None else None):
        out = out if more is None else out.join(more, "program", "left")
    return out


def extract_programs(text: str) -> list[tuple[str, str]]:
    """(file name, source) of the programs that an autotest script writes by AT_DATA([name.cob], [text]).

    Brackets nest; what is quoted by @<:@ and @:>@ stands for a bracket.
    """
    out = []
    for m in re.finditer(r"AT_DATA\(\[([^\]]+\.(?:cob|cbl|cpy|CPY))\],\s*\[", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += (text[at] == "[") - (text[at] == "]")
            at += 1
        out.append((m[1], text[m.end() : at - 1].replace("@<:@", "[").replace("@:>@", "]").strip("\n") + "\n"))
    return out
