"""Programs that read files in loops, run as plans: a scan, a projection for each record's work, and sums over records.

The shape is that of nearly every batch program: something before the loop, `PERFORM … UNTIL` the end of a file, whose
body READs the file, and something behind it. What the loop does to one record becomes a projection. Items to which
the loop only adds are sums over the records; other items must get their value from the record itself, so records can
be worked on in any order and by any number of tasks. What else a loop may do (carry a value from record to record,
leave before the end) raises Unsupported.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.semantics import coerce, pad
from recordloom.functions.strings import safe_name
from recordloom.plans.copybook import Item, column_names, parse_records
from recordloom.plans.corpus import is_free
from recordloom.plans.procedure import SHOWN, Env, Program, Statement, Unsupported
from recordloom.sources.files import AT_END, NO_FILE, OK, parse_file_control, parse_open
from recordloom.sources.fixed_width import encode_struct

_TEXTS = "array<string>"


@dataclass
class Outcome:
    """What a run leaves: lines of the files it wrote (place, line), what it displayed (place, line), its items (one row,
    without those that hold what the last record left in them), its files' statuses."""

    written: dict[str, DataFrame] = field(default_factory=dict)
    shown: DataFrame | None = None
    items: DataFrame | None = None
    statuses: dict[str, str] = field(default_factory=dict)


class FileProgram(Program):
    """A whole program text: FILE-CONTROL, the records of its FDs, WORKING-STORAGE and the PROCEDURE DIVISION."""

    def __init__(self, text: str, **more):
        lines = text.splitlines()
        if is_free(text):
            lines = [x.split("*>")[0] for x in lines if not x.lstrip().startswith("*")]
        else:
            lines = [x[7:72] for x in lines if x[6:7] not in ("*", "/")]
        text = "\n".join(lines)
        upper = text.upper()

        def part(start: str, *stops: str) -> str:
            m = re.search(start, upper)
            if not m:
                return ""
            ends = [x.start() + m.end() for s in stops if (x := re.search(s, upper[m.end() :]))]
            return text[m.end() : min(ends, default=len(text))]

        self.controls = {c.name: c for c in parse_file_control(part(r"FILE-CONTROL\s*\.", r"\bI-O-CONTROL\b", r"\bDATA\s+DIVISION\b"))}
        self.file_records: dict[str, Item] = {}
        files = part(r"\bFILE\s+SECTION\s*\.", r"\b(?:WORKING-STORAGE|LINKAGE|LOCAL-STORAGE|REPORT)\s+SECTION\b", r"\bPROCEDURE\s+DIVISION\b")
        for m in re.finditer(r"\b(?:FD|SD)\s+([\w-]+)(.*?)(?=\b(?:FD|SD)\s+[\w-]|\Z)", files, re.I | re.S):
            found = parse_records(re.sub(r"^[^.]*\.", "", m[2], count=1))
            if found:
                self.file_records[m[1].upper()] = found[0]
        own = parse_records(part(r"\bWORKING-STORAGE\s+SECTION\s*\.", r"\b(?:LINKAGE|LOCAL-STORAGE|REPORT)\s+SECTION\b", r"\bPROCEDURE\s+DIVISION\b"))
        body = part(r"\bPROCEDURE\s+DIVISION\b[^.]*\.")
        self.of_record = {r.name: f for f, r in self.file_records.items()}
        self.input: str | None = None
        super().__init__(body, [*self.file_records.values(), *own], **more)
        self.own = own

    # what a record's work may do to files
    def _file_verb(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        if s.verb == "WRITE":
            return self._write(s, env)
        if s.verb == "READ":
            if s.words[0] != self.input:
                raise Unsupported(f"READ {s.words[0]} within the loop over {self.input}")
            into = s.words[s.words.index("INTO") + 1] if "INTO" in s.words else None
            out = env | {into: pad(self._line(self.file_records[self.input], env), self._item(into).picture.size)} if into else env
            return self._run(s.otherwise, out, stack)
        return env

    def _line(self, record: Item, env: Env) -> Column:
        """A record's characters from its items."""
        if record.elementary:
            return pad(env[record.name], record.size)
        names = {safe_name(n): c for n, c in env.items()}
        parts = F.struct(*[names[n].alias(n) for n, _ in column_names(record) if n in names])
        return encode_struct(record, parts)

    def _write(self, s: Statement, env: Env) -> Env:
        record, words = s.words[0], s.words[1:]
        if record not in self.of_record:
            raise Unsupported(f"WRITE {record}, which is no file's record")
        source = words[words.index("FROM") + 1] if "FROM" in words else record
        item = next((r for r in self.records if r.name == source), None) or self.items.get(source)
        if item is None:
            raise Unsupported(f"WRITE {record} FROM {source}")
        size = self.file_records[self.of_record[record]].size
        text = pad(self._line(item, env) if not item.elementary or source in self.of_record else env[source].cast("string"), size)
        if "ADVANCING" in words or "AFTER" in words or "BEFORE" in words:
            way = "BEFORE" if "BEFORE" in words else "AFTER"
            rest = [w for w in words[words.index(way) + 1 :] if w not in ("ADVANCING", "LINE", "LINES")]
            move = F.lit("\f") if rest[:1] == ["PAGE"] else F.repeat(F.lit("\n"), (env[rest[0]] if rest[0] in env else F.lit(int(rest[0]))).cast("int"))
            text = F.concat(F.rtrim(text), move) if way == "BEFORE" else F.concat(move, F.rtrim(text))
        else:
            text = F.rtrim(text)
        key = f"$OUT {self.of_record[record]}"
        return env | {key: F.concat(env.get(key, F.array().cast(_TEXTS)), F.array(text))}

    # the loop
    def _flat(self, body: list[Statement]) -> list[Statement]:
        """Statements in the order they run, with the paragraphs in place that are performed once."""
        out = []
        for s in body:
            if s.verb == "PERFORM" and len(s.words) in (1, 3) and not s.branches and (len(s.words) == 1 or s.words[1] in ("THRU", "THROUGH")):
                out += self._flat([x for p in self._between(s.words[0], s.words[-1]) for x in self.paragraphs[p]])
            else:
                out.append(s)
        return out

    def _reads(self, body: list[Statement]) -> list[Statement]:
        return [x for s in self._flat(body) for x in s.walk() if x.verb == "READ"]

    def run(self, inputs: Mapping[str, DataFrame], order: Mapping[str, str] | None = None) -> Outcome:
        """Run over the frames of the files it reads (a column for each item of the record, by file name).

        order: by file, the column whose order is that of the records; it numbers what is written and displayed.
        A file that is opened for INPUT and isn't given has status 35.
        """
        out = Outcome(statuses={f: OK for f in self.controls})
        main = self._flat(next(iter(self.paragraphs.values())))
        loops = [i for i, s in enumerate(main) if s.verb == "PERFORM" and "UNTIL" in s.words and self._reads(self._body(s))]
        if len(loops) != 1:
            raise Unsupported(f"{len(loops)} loops over files in one program")
        before, loop, behind = main[: loops[0]], main[loops[0]], main[loops[0] + 1 :]
        for s in [x for y in before for x in y.walk()]:
            for mode, name in parse_open(" ".join(["OPEN", *s.words])) if s.verb == "OPEN" else ():
                if mode == "INPUT" and name not in inputs:
                    out.statuses[name] = NO_FILE
                    raise FileNotFoundError(f"{name}: status {NO_FILE}")
        body = self._body(loop)
        reads = self._reads(body)
        names = {r.words[0] for r in reads}
        if len(names) != 1 or not names <= set(inputs):
            raise Unsupported(f"a loop that reads {', '.join(sorted(names))}")
        self.input = names.pop()
        spark, records = inputs[self.input].sparkSession, inputs[self.input]
        primed = any(x.verb == "READ" for x in before)
        place = F.col(order[self.input]) if order and self.input in order else F.monotonically_increasing_id()
        first = self.apply_own(spark.range(1).select(F.lit(0).alias("_none")), [s for s in before if s.verb not in ("OPEN", "READ", "CLOSE")])
        start = first.drop("_none").first().asDict()

        work = self._flat(body)
        if primed:  # the body's work first, then its READ; NOT AT END is done for every record that was read
            if work[-1].verb != "READ":
                raise Unsupported("a primed loop whose last statement isn't the READ")
            work = [*work[-1].otherwise, *work[:-1]]
        elif work[0].verb != "READ" or any(not self._guarded(s, work[0]) for s in work[1:]):
            raise Unsupported("statements behind the READ that the end of the file doesn't pass by")
        if any(x.verb in ("STOP", "GOBACK") for s in work for x in s.walk()):
            raise Unsupported("a loop that ends the program before the end of the file")
        self.sums = self._added_only(work)
        record = {safe_name(n) for x in [self.file_records[self.input]] for n in [y.name for y in x.leaves()]}
        changed = {x for s in work for y in s.walk() for x in self._changes(y)}
        carried = {n for n in changed - self.sums if safe_name(n) not in record}
        env: Env = {n: F.col(safe_name(n)) for n in self.items if safe_name(n) in records.columns}
        for n, item in self.items.items():
            if safe_name(n) not in records.columns:
                env[n] = F.lit(0).cast("decimal(38,9)") if n in self.sums else F.col(f"carried {n}") if n in carried else F.lit(start.get(safe_name(n))).cast(self._kind(n))
        end = self._run(work, env, ())
        sums, texts, lost = {}, {}, set()
        for n, c in end.items():
            if n in env and c is env[n]:
                continue
            kept = n in self.sums or n == SHOWN or n.startswith("$OUT ")
            if kept and "carried " in str(c):
                raise Unsupported(f"{n} depends on what is carried from record to record")
            if n in self.sums:
                sums[n] = c
            elif kept:
                texts[n] = c
            else:
                lost.add(n)
        self.sums = set()
        # what the last record left in an item isn't known: nothing may read it, unless it gets a value first
        for s in [*self._end_flag(reads[0]), *self._flat(behind)]:
            if gone := lost & {w for x in s.walk() for w in self._used(x)}:
                raise Unsupported(f"{', '.join(sorted(gone))} is read behind the loop")
            lost -= set(self._changes(s))
        rows = records.select(place.alias("_place"), *[c.cast("decimal(38,9)").alias(f"_sum{i}") for i, c in enumerate(sums.values())], *[c.cast(_TEXTS).alias(f"_text{i}") for i, c in enumerate(texts.values())])
        for i, n in enumerate(texts):
            lines = rows.select("_place", F.posexplode(f"_text{i}").alias("_n", "line")).select(F.col("_place").alias("place"), F.col("_n").alias("number"), "line")
            if n == SHOWN:
                out.shown = lines
            else:
                out.written[n[5:]] = lines
        totals = rows.agg(*[F.coalesce(F.sum(f"_sum{i}"), F.lit(0)).alias(f"_sum{i}") for i in range(len(sums))]) if sums else spark.range(1)
        done = first.drop("_none", "display")
        items = totals.select(*[(F.lit(start[safe_name(n)]) + F.col(f"_sum{i}")).alias(f"_sum{i}") for i, n in enumerate(sums)], *[F.lit(start[c]).cast(done.schema[c].dataType).alias(c) for c in done.columns if c not in {safe_name(n) for n in sums}])
        items = items.select(*[self._summed(n, F.col(f"_sum{i}")).alias(safe_name(n)) for i, n in enumerate(sums)], *[c for c in done.columns if c not in {safe_name(n) for n in sums}])
        items = self.apply_own(items, [x for x in self._flat(behind) if x.verb not in ("OPEN", "CLOSE", "STOP", "GOBACK")], self._end_flag(reads[0]))
        if "display" in items.columns:
            early = F.array(*map(F.lit, start.get("display") or [])).cast(_TEXTS)
            ends = items.select(F.lit(None).cast("bigint").alias("place"), F.posexplode(F.concat(early, F.col("display")))).select("place", F.col("pos").alias("number"), F.col("col").alias("line"))
            out.shown = ends if out.shown is None else out.shown.unionByName(ends)
        out.items = items.drop("display", *map(safe_name, lost))
        out.statuses[self.input] = AT_END
        return out

    def apply_own(self, df: DataFrame, body: list[Statement], extra: list[Statement] | None = None) -> DataFrame:
        """Statements over one row of the program's own items."""
        name = "$OWN"
        self.paragraphs[name] = [*(extra or []), *body]
        try:
            return self.apply(df, name)
        finally:
            del self.paragraphs[name]

    def _summed(self, name: str, value: Column) -> Column:
        p = self.items[name].picture
        return coerce(value, p.int_digits, p.decimals, p.signed)

    def _body(self, s: Statement) -> list[Statement]:
        if s.branches:
            return s.branches[0][1]
        words = s.words
        last = words[2] if words[1:2] in (["THRU"], ["THROUGH"]) else words[0]
        return [x for p in self._between(words[0], last) for x in self.paragraphs[p]]

    def _end_flag(self, read: Statement) -> list[Statement]:
        """What AT END does, once, behind the last record."""
        return [x for _, b in read.branches for x in b]

    def _guarded(self, s: Statement, read: Statement) -> bool:
        """Whether a statement behind a READ is passed by at the end of the file: IF NOT <the flag that AT END sets>."""
        flags = {w for x in self._end_flag(read) for w in x.words if x.verb == "SET"} | {x.words[-1] for x in self._end_flag(read) if x.verb == "MOVE"}
        return s.verb == "IF" and s.branches[0][0][0][:1] == ["NOT"] and s.branches[0][0][0][-1] in flags

    @staticmethod
    def _changes(s: Statement) -> list[str]:
        """Items that a statement gives values to, not counting its bodies."""
        w = s.words
        if s.verb in ("MOVE", "SET"):
            return w[w.index("TO") + 1 :] if s.verb == "MOVE" else w[: next((w.index(x) for x in ("TO", "UP", "DOWN") if x in w), 0)]
        if s.verb == "COMPUTE":
            return [x for x in w[: w.index("=")] if x != "ROUNDED"]
        if s.verb in ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"):
            if "GIVING" in w:
                return [x for x in w[w.index("GIVING") + 1 :] if x not in ("ROUNDED", "REMAINDER")]
            link = next((x for x in ("TO", "FROM", "BY", "INTO") if x in w), None)
            return [x for x in w[w.index(link) + 1 :] if x != "ROUNDED"] if link else []
        if s.verb in ("STRING", "UNSTRING"):
            return [x for x in w[w.index("INTO") + 1 :] if x not in ("WITH", "POINTER", "TALLYING", "IN")]
        if s.verb == "INSPECT":
            return [w[0], *([w[w.index("TALLYING") + 1]] if "TALLYING" in w else [])]
        return [w[0]] if s.verb == "ACCEPT" else list(w) if s.verb == "INITIALIZE" else []

    def _added_only(self, work: list[Statement]) -> set[str]:
        """Items of the program that the loop only adds to, with decimals enough for what is added, and never reads."""
        all_of = [x for s in self._deep(work) for x in s.walk()]
        added = {n for s in all_of if s.verb in ("ADD", "SUBTRACT") and "GIVING" not in s.words for n in self._changes(s)}
        other = {n for s in all_of if not (s.verb in ("ADD", "SUBTRACT") and "GIVING" not in s.words) for n in self._changes(s)}
        read = {w for s in all_of for w in self._used(s)}
        in_file = {x.name for x in self.file_records[self.input].leaves()}
        return {n for n in added - other - read - in_file if n in self.items and self.items[n].picture.kind == "numeric"}

    def _deep(self, body: list[Statement]) -> list[Statement]:
        """The statements with all that they perform, however deep."""
        out, seen = [], set()

        def add(statements: list[Statement]) -> None:
            for s in statements:
                out.append(s)
                for x in s.walk():
                    if x.verb == "PERFORM" and x.words and x.words[0] in self.paragraphs and x.words[0] not in seen:
                        seen.add(x.words[0])
                        add(self._body(Statement("PERFORM", x.words)))

        add(body)
        return out

    def _used(self, s: Statement) -> list[str]:
        """Words that a statement reads."""
        w, tests = s.words, [x for t, _ in s.branches for one in t for x in one]
        if s.verb in ("MOVE", "COMPUTE", "SET"):
            mark = next((x for x in (("TO",) if s.verb == "MOVE" else ("=",) if s.verb == "COMPUTE" else ("TO", "BY")) if x in w), None)
            return [*(w[: w.index(mark)] if s.verb == "MOVE" and mark else w[w.index(mark) + 1 :] if mark else w), *tests]
        if s.verb in ("ADD", "SUBTRACT") and "GIVING" not in w:
            link = "TO" if s.verb == "ADD" else "FROM"
            return w[: w.index(link)] if link in w else w
        return [*w, *tests]


def run_text(text: str, inputs: Mapping[str, DataFrame], order: Mapping[str, str] | None = None, **more) -> Outcome:
    return FileProgram(text, **more).run(inputs, order)

