"""Paragraphs that work on one record, lowered to projections: assignments become columns, branches conditional expressions.

Loops that work on a record become folds of a bounded number of passes. Reading and writing files is the work of
`plans.file_program`, which runs these paragraphs once a record; jumps out of a paragraph's order raise Unsupported,
as does what can't be parsed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import strings
from recordloom.functions.documents import accept
from recordloom.functions.semantics import coerce, divide, edited, pad, size_error
from recordloom.functions.strings import safe_name
from recordloom.plans.copybook import Item, Picture
from recordloom.plans.expressions import FIGURATIVE, compute, condition, condition_name
from recordloom.sources import fixed_width

VERBS = set("MOVE COMPUTE ADD SUBTRACT MULTIPLY DIVIDE IF EVALUATE SET PERFORM INITIALIZE CONTINUE EXIT STRING UNSTRING INSPECT DISPLAY ACCEPT CALL STOP GOBACK READ WRITE OPEN CLOSE".split())
ARITHMETIC = {"COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"}
#: Verbs that end a statement but have no place in a record's work.
FOREIGN = set("ALTER CANCEL DELETE ENTRY EXEC GENERATE GO INITIATE MERGE NEXT RELEASE RETURN REWRITE SEARCH SORT START TERMINATE".split())
_TOKEN = re.compile(r"\"[^\"]*\"|'[^']*'|\.(?=\s|$)|(?:[^\s.\"']|\.(?=\S))+")
#: A word alone on its line, with a period, that is neither a verb nor the end of one.
_HEADING = re.compile(rf"(?mi)^[ \t]*(?!(?:END-[\w-]+|ELSE|{'|'.join(sorted(VERBS | FOREIGN))})\s*\.)([A-Z0-9][\w-]*)(?:[ \t]+SECTION)?[ \t]*\.[ \t]*$")
#: Phrases that begin a body of statements within a statement; each may have NOT before it.
_PHRASES = tuple(tuple(x.split()) for x in ("ON SIZE ERROR", "SIZE ERROR", "AT END", "ON OVERFLOW", "OVERFLOW", "INVALID KEY", "ON EXCEPTION"))
#: The last word of phrases that a verb may have.
_OWN = {v: ("ERROR",) for v in ARITHMETIC} | {"READ": ("END", "KEY"), "WRITE": ("KEY",), "STRING": ("OVERFLOW",), "UNSTRING": ("OVERFLOW",), "CALL": ("EXCEPTION", "OVERFLOW")}
Env = dict[str, Column]
#: Names in an environment that aren't items: lines shown, and whether the record's work, or the innermost loop, is over.
SHOWN, DONE, LEFT = "$DISPLAY", "$DONE", "$LEFT"


class Unsupported(NotImplementedError):
    """A construct that can't be lowered to a plan."""


@dataclass
class Statement:
    verb: str
    words: list[str]
    branches: list[tuple[list[list[str]], list[Statement]]] = field(default_factory=list)  # conditions (any of them) and body
    otherwise: list[Statement] = field(default_factory=list)

    def walk(self):
        yield self
        for body in [*(b for _, b in self.branches), self.otherwise]:
            for x in body:
                yield from x.walk()


class _Blocks:
    """Statements of one paragraph; a period closes whatever is open."""

    def __init__(self, text: str, shared: set[str] | frozenset[str] = frozenset()):
        self.tokens: list[str] = []
        for t in _TOKEN.findall(text):
            self.tokens.append(t if t[0] in "\"'" else t.upper())
            # a name that several items have, and its group, are one operand
            if len(self.tokens) > 2 and self.tokens[-2] in ("OF", "IN") and self.tokens[-3] in shared:
                self.tokens[-3:] = [f"{self.tokens[-3]} OF {self.tokens[-1]}"]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, word: str) -> bool:
        if self.peek() != word:
            return False
        self.at += 1
        return True

    def until(self, *stops: str) -> list[str]:
        """Words up to a verb, a period, an end or one of the stops."""
        start = self.at
        while (t := self.peek()) and t != "." and t not in VERBS and t not in FOREIGN and t not in stops and t not in ("ELSE", "WHEN") and not t.startswith("END-") and not self.phrase():
            self.at += 1
        return self.tokens[start : self.at]

    def phrase(self) -> int:
        """Length of a phrase that comes next and begins a body."""
        skip = int(self.peek() == "NOT")
        return next((skip + len(p) for p in _PHRASES if all(self.peek(skip + i) == w for i, w in enumerate(p))), 0)

    def paragraph(self) -> list[Statement]:
        out: list[Statement] = []
        while self.peek():
            out += self.block()
            if self.peek() and not self.take("."):
                raise Unsupported(f"unexpected {self.peek()}")
        return out

    def block(self) -> list[Statement]:
        out: list[Statement] = []
        while self.peek() in VERBS:
            out.append(self.statement())
        if self.peek() in FOREIGN:
            raise Unsupported(f"{self.peek()} isn't part of a record's work")
        return out

    def statement(self) -> Statement:
        verb = self.peek()
        self.at += 1
        if verb == "IF":
            test = self.until("THEN")
            self.take("THEN")
            out = Statement("IF", [], [([test], self.block())], self.block() if self.take("ELSE") else [])
        elif verb == "EVALUATE":
            out = Statement("EVALUATE", self.until())
            while self.take("WHEN"):
                tests = [self.until()]
                while self.take("WHEN"):
                    tests.append(self.until())
                body = self.block()
                if ["OTHER"] in tests:
                    out.otherwise = body
                else:
                    out.branches.append((tests, body))
        elif verb == "EXIT" and self.peek() == "PERFORM":
            self.at += 1
            out = Statement("EXIT", ["PERFORM"])
        elif verb == "PERFORM":
            out = Statement(verb, self.until())
            # a loop's clauses without a paragraph's name, or a number of times: its body follows
            if not out.words or out.words[0] in ("UNTIL", "VARYING", "WITH", "TEST") or out.words[1:] == ["TIMES"]:
                out.branches.append(([], self.block()))
        else:
            out = Statement(verb, self.until())
            while (n := self.phrase()) and self.peek(n - 1) in _OWN.get(verb, ()):
                good = self.peek() == "NOT"
                self.at += n
                body = self.block()
                if good:
                    out.otherwise = body
                else:
                    out.branches.append(([], body))
        self.take(f"END-{verb}")
        return out


def _column(name: str) -> str:
    return {SHOWN: "display", DONE: "_done"}.get(name, safe_name(name))


def _split(words: list[str], at: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        if w == at:
            out.append([])
        else:
            out[-1].append(w)
    return out


class Program:
    """Paragraphs of a PROCEDURE DIVISION over the items of its records; other items start from VALUE, zero or blanks.

    calls: what CALL runs, by program name: a function from the arguments' columns to the columns they leave with.
    inputs: what ACCEPT gives, by item, or by "ENVIRONMENT name" and "COMMAND-LINE". passes: how often a loop's body may
    run for one record; a loop that isn't over by then is an error, not a shorter loop.
    """

    def __init__(self, text: str, records: list[Item], calls: Mapping[str, Callable[..., list[Column]]] | None = None, inputs: Mapping[str, object] | None = None, passes: int = 1000):
        self.records, self.calls, self.inputs, self.passes = records, calls or {}, inputs or {}, passes
        leaves = [(x, g) for r in records for g in r.walk() for x in g.children or ([r] if g is r and r.elementary else []) if x.elementary and x.name != "FILLER"]
        names = Counter(x.name for x, _ in leaves)
        #: Items by name, or by name OF group where several have the name; groups by name.
        self.items = {x.name if names[x.name] == 1 else f"{x.name} OF {g.name}": x for x, g in leaves}
        self.groups = {g.name: g for r in records for g in r.walk() if not g.elementary and g.name != "FILLER"}
        self.keys = {(g.name, x.name): x.name if names[x.name] == 1 else f"{x.name} OF {g.name}" for x, g in leaves}
        shared = {n for n, k in names.items() if k > 1}
        #: Items whose sums are taken over records: what is added to them isn't coerced each time.
        self.sums: set[str] = set()
        self.paragraphs: dict[str, list[Statement]] = {}
        pieces = _HEADING.split(text)
        for name, body in zip(["MAIN", *pieces[1::2]], pieces[::2], strict=True):
            if body.strip() or name != "MAIN":
                self.paragraphs[name.upper()] = _Blocks(body, shared).paragraph()

    def start(self, df: DataFrame) -> DataFrame:
        """The frame with a column for every item that it lacks, as the program starts."""
        first = {safe_name(n): self._store(x.picture, self._initial(x)) for n, x in self.items.items() if safe_name(n) not in df.columns and x.occurs == 1}
        return df.withColumns(first) if first else df

    def _initial(self, item: Item) -> Column:
        if item.value is not None and item.value.upper() not in FIGURATIVE:
            return F.lit(item.value)
        return F.lit(0 if item.picture.kind in ("numeric", "edited") else "")

    def apply(self, df: DataFrame, paragraph: str | None = None) -> DataFrame:
        """The frame after the paragraph (default: the first) ran on every row; a projection for each of its statements.

        Where the program displays anything, `display` holds a record's lines.
        """
        df = self.start(df)
        body = self.paragraphs[(paragraph or next(iter(self.paragraphs))).upper()]
        shows = any(x.verb == "DISPLAY" for p in self.paragraphs.values() for s in p for x in s.walk())
        if shows and "display" not in df.columns:
            df = df.withColumn("display", F.array().cast("array<string>"))
        ends = any(x.verb in ("STOP", "GOBACK") or x.words == ["PROGRAM"] for p in self.paragraphs.values() for s in p for x in s.walk())
        df = df.withColumn("_done", F.lit(False)) if ends else df
        for statement in body:
            before = self.environment(df, shows)
            after = self._run([statement], before, (), ends)
            changed = {_column(n): c for n, c in after.items() if c is not before[n]}
            df = df.withColumns(changed) if changed else df
        return df.drop("_done")

    def environment(self, df: DataFrame, shows: bool = False) -> Env:
        out = {n: F.col(safe_name(n)) for n in self.items if safe_name(n) in df.columns}
        return out | ({SHOWN: F.col("display")} if shows else {}) | ({DONE: F.col("_done")} if "_done" in df.columns else {})

    def _store(self, picture: Picture, value: Column, rounded: bool = False) -> Column:
        if picture.kind == "edited":
            return edited(value, picture.text)
        return coerce(value, picture.int_digits, picture.decimals, picture.signed, rounded) if picture.kind == "numeric" else pad(value, picture.size)

    def _item(self, name: str) -> Item:
        if name not in self.items:
            raise Unsupported(f"unknown item {name}")
        return self.items[name]

    def _value(self, name: str, env: Env) -> Column:
        self._item(name)
        return env[name]

    def _test(self, words: list[str], env: Env) -> Column:
        flags = {n: condition_name(env[key], v, x.picture.kind == "numeric") for key, x in self.items.items() if key in env for n, v in x.conditions.items()}
        return condition(" ".join(words), env, flags)

    def _when(self, subjects: list[list[str]], objects: list[str], env: Env) -> Column:
        out = F.lit(True)
        for subject, want in zip(subjects, _split(objects, "ALSO"), strict=True):
            if want == ["ANY"]:
                continue
            if subject in (["TRUE"], ["FALSE"]):
                test = self._test(want, env)
                out = out & (test if subject == ["TRUE"] else ~test)
                continue
            negative, want = want[:1] == ["NOT"], want[1:] if want[:1] == ["NOT"] else want
            any_of = F.lit(False)
            for one in _split(want, "OR"):
                low, *high = _split(["THRU" if w == "THROUGH" else w for w in one], "THRU")
                any_of = any_of | (self._test([*subject, ">=", *low, "AND", *subject, "<=", *high[0]], env) if high else self._test([*subject, "=", *low], env))
            out = out & (~any_of if negative else any_of)
        return out

    @staticmethod
    def _merge(test: Column, yes: Env, no: Env) -> Env:
        blank = {SHOWN: F.array().cast("array<string>"), DONE: F.lit(False), LEFT: F.lit(False)}
        names = [*no, *[n for n in yes if n not in no]]
        both = [(n, yes.get(n, blank.get(n)), no.get(n, blank.get(n))) for n in names]
        return {n: b if a is b else F.when(test, F.lit([]).cast("array<string>") if a is None else a).otherwise(F.lit([]).cast("array<string>") if b is None else b) for n, a, b in both}

    def _run(self, body: list[Statement], env: Env, stack: tuple[str, ...], ends: bool = False) -> Env:
        ends = ends or any(x.verb in ("STOP", "GOBACK", "EXIT", "PERFORM") for s in body for x in s.walk())
        for s in body:
            out = self._step(s, env, stack)
            # what follows a statement that may end the work, or leave the loop, runs only where it hasn't
            for flag in (DONE, LEFT):
                if flag in env and ends:
                    out = {n: c if n not in env or c is env[n] else F.when(env[flag], env[n]).otherwise(c) for n, c in out.items()}
            env = out
        return env

    def _step(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        if s.verb in ("IF", "EVALUATE"):
            subjects = _split(s.words, "ALSO")
            out = self._run(s.otherwise, env, stack)
            for tests, then in reversed(s.branches):
                hit = F.lit(False)
                for t in tests:
                    hit = hit | (self._test(t, env) if s.verb == "IF" else self._when(subjects, t, env))
                out = self._merge(hit, self._run(then, env, stack), out)
            return out
        if s.verb in ARITHMETIC:
            return self._arithmetic(s, env, stack)
        if s.verb == "INITIALIZE":
            return env | {n: self._store(self._item(n).picture, F.lit(0 if self._item(n).picture.kind in ("numeric", "edited") else "")) for n in s.words}
        if s.verb in ("STOP", "GOBACK") or s.verb == "EXIT" and s.words == ["PROGRAM"]:
            return env | {DONE: F.lit(True)}
        if s.verb == "EXIT" and s.words == ["PERFORM"]:
            if LEFT not in env:
                raise Unsupported("EXIT PERFORM outside a loop")
            return env | {LEFT: F.lit(True)}
        steps = {"PERFORM": self._perform, "STRING": self._string, "UNSTRING": self._unstring, "CALL": self._call}
        if s.verb in steps:
            return steps[s.verb](s, env, stack)
        plain = {"MOVE": self._move, "SET": self._set, "INSPECT": self._inspect, "DISPLAY": self._display, "ACCEPT": self._accept}
        if s.verb in plain:
            return plain[s.verb](s.words, env)
        if s.verb in ("READ", "WRITE", "OPEN", "CLOSE"):
            return self._file_verb(s, env, stack)
        return env

    def _file_verb(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        raise Unsupported(f"{s.verb} isn't part of a record's work")

    def _between(self, first: str, last: str) -> list[str]:
        """Paragraphs from first to last, in order."""
        names = list(self.paragraphs)
        if first not in names or last not in names or names.index(last) < names.index(first):
            raise Unsupported(f"PERFORM {first} THRU {last}")
        return names[names.index(first) : names.index(last) + 1]

    def _perform(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        words, ranged = list(s.words), []
        if s.branches:
            body = s.branches[0][1]
        else:
            first = words.pop(0) if words else ""
            last = words[1] if words[:1] in (["THRU"], ["THROUGH"]) else first
            words = words[2:] if last != first or words[:1] in (["THRU"], ["THROUGH"]) else words
            if first in stack:
                raise Unsupported(f"PERFORM {first} within itself")
            ranged = self._between(first, last)
            body = [x for name in ranged for x in self.paragraphs[name]]
            stack = (*stack, first, *ranged)
        if not words:
            return self._run(body, env, stack)
        if words[-1] == "TIMES":
            if words[0].isdigit() and int(words[0]) <= 16:
                for _ in range(int(words[0])):
                    env = self._run(body, env, stack)
                return env
            return self._times(compute(" ".join(words[:-1]), env), body, env, stack)
        after = "AFTER" in words[: words.index("UNTIL")] and "TEST" in words if "UNTIL" in words else False
        words = [w for i, w in enumerate(words) if not (w in ("WITH", "TEST") or w in ("BEFORE", "AFTER") and words[i - 1] == "TEST")]
        if words[0] == "UNTIL":
            return self._loop(words[1:], body, env, stack, after)
        if words[0] != "VARYING":
            raise Unsupported(f"PERFORM {' '.join(s.words)}")
        levels = []
        for clause in _split(words[1:], "AFTER"):
            if "FROM" not in clause or "UNTIL" not in clause:
                raise Unsupported(f"VARYING {' '.join(clause)}")
            start, until = clause.index("FROM"), clause.index("UNTIL")
            by = clause.index("BY") if "BY" in clause[:until] else until
            levels.append((clause[0], clause[start + 1 : by], clause[by + 1 : until] or ["1"], clause[until + 1 :]))
        # the innermost loop first: an outer one's body sets the inner variable, runs the inner loop and steps on
        run = body
        for k, (name, begin, by, until) in enumerate(reversed(levels)):
            step = Statement("COMPUTE", [name, "=", name, "+", "(", *by, ")"])
            inner = Statement("PERFORM", ["UNTIL", *until] if not after else ["TEST", "AFTER", "UNTIL", *until], [([], [*run, step])])
            if after:  # the variable isn't stepped on behind the last pass
                inner = Statement("PERFORM", ["UNTIL", *until], [([], [step, *run])])
                run = [Statement("MOVE", [*begin, "TO", name]) if len(begin) == 1 else Statement("COMPUTE", [name, "=", *begin]), *run, inner]
                continue
            run = [Statement("MOVE", [*begin, "TO", name]) if len(begin) == 1 else Statement("COMPUTE", [name, "=", *begin]), inner]
        return self._run(run, env, stack)

    def _kind(self, name: str) -> str:
        if name in (DONE, LEFT):
            return "boolean"
        if name == SHOWN or name not in self.items:
            return "array<string>"
        picture = self.items[name].picture
        return f"decimal({picture.int_digits + picture.decimals + 1},{picture.decimals})" if picture.kind == "numeric" else "string"

    def _fold(self, passes: Column, stop: Callable[[Env, Column], Column], body: list[Statement], env: Env, stack: tuple[str, ...]) -> tuple[Env, Column]:
        """Run the body until stop holds, `passes` times at most: a fold whose state is what the body changes. Gives the state and the fold's stop."""
        inside = env | {LEFT: F.lit(False)}
        names = [n for n, c in self._run(body, inside, stack).items() if n not in inside or c is not inside[n]]
        place = {n: f"s{i}" for i, n in enumerate(names)}

        def state(e: Env) -> Column:
            return F.struct(*[e[n].cast(self._kind(n)).alias(place[n]) for n in names])

        def step(now: Column, number: Column) -> Column:
            e = inside | {n: now[place[n]] for n in names}
            over = stop(e, number)
            if LEFT in place:
                over = over | e[LEFT]
            if DONE in e:
                over = over | e[DONE]
            return F.when(over, now).otherwise(state(self._run(body, e, stack)))

        if not names:
            return env, stop(env, F.lit(1))
        end = F.aggregate(F.sequence(F.lit(1), passes), state(inside), step)
        out = env | {n: end[place[n]] for n in names if n != LEFT}
        over = stop(out, F.lit(None).cast("int"))
        return out, over | end[place[LEFT]] if LEFT in place else over

    def _loop(self, until: list[str], body: list[Statement], env: Env, stack: tuple[str, ...], after: bool) -> Env:
        if after:
            env = self._run(body, env, stack)
        out, over = self._fold(F.lit(self.passes), lambda e, _: self._test(until, e), body, env, stack)
        late = F.raise_error(F.lit(f"UNTIL {' '.join(until)}: not over after {self.passes} passes"))
        if DONE in out:
            over = over | out[DONE]
        return {n: c if n in env and c is env[n] else F.when(over, c).otherwise(late.cast(self._kind(n))) for n, c in out.items()}

    def _times(self, count: Column, body: list[Statement], env: Env, stack: tuple[str, ...]) -> Env:
        count = F.coalesce(count.cast("int"), F.lit(0))
        return self._fold(F.greatest(count, F.lit(1)), lambda e, number: F.coalesce(number > count, F.lit(False)), body, env, stack)[0]

    def _text(self, word: str, env: Env) -> Column:
        """A literal's or item's characters; a number as its digits stand."""
        return compute(word, env).cast("string")

    def _string(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        words = [w for w in s.words if w not in ("WITH",)]
        at = words.index("INTO")
        sources, waiting, i = [], [], 0
        while i < at:
            if words[i] == "DELIMITED":
                i += 1 + (words[i + 1] == "BY")
                by = None if words[i] == "SIZE" else FIGURATIVE.get(words[i], words[i].strip("\"'"))
                sources += [(x, by) for x in waiting]
                waiting = []
            else:
                waiting.append(self._text(words[i], env))
            i += 1
        sources += [(x, None) for x in waiting]
        target, pointer = words[at + 1], words[words.index("POINTER") + 1] if "POINTER" in words else None
        size = self._item(target).picture.size
        if pointer is None:
            out = env | {target: strings.string(sources, size)}
            full = strings.string_overflow(sources, size, F.lit(1))
        else:
            full = strings.string_overflow(sources, size, env[pointer])
            valid = env[pointer] >= 1
            moved = F.least(env[pointer] + strings.joined_length(sources), F.lit(size + 1))
            out = env | {target: F.when(valid, strings.string(sources, size, env[target], env[pointer].cast("int"))).otherwise(env[target]), pointer: F.when(valid, self._store(self._item(pointer).picture, moved)).otherwise(env[pointer])}
        return self._merge(full, self._run([x for _, b in s.branches for x in b], out, stack), self._run(s.otherwise, out, stack))

    def _unstring(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        words = [w for w in s.words if w not in ("WITH", ",")]
        source, at = words[0], words.index("INTO")
        by = words[words.index("BY") + 1 : at] if "BY" in words[:at] else []
        every = "ALL" in by
        marks = [str(FIGURATIVE.get(w, w.strip("\"'")))[:1] if w in FIGURATIVE else w.strip("\"'") for w in by if w not in ("ALL", "OR")]
        rest = words[at + 1 :]
        stop = min((rest.index(w) for w in ("POINTER", "TALLYING", "DELIMITER", "COUNT") if w in rest), default=len(rest))
        if "DELIMITER" in rest or "COUNT" in rest:
            raise Unsupported("UNSTRING with DELIMITER IN or COUNT IN")
        targets = rest[:stop]
        pointer = rest[rest.index("POINTER") + 1] if "POINTER" in rest else None
        tally = next((w for w in rest[rest.index("TALLYING") + 1 :] if w != "IN"), None) if "TALLYING" in rest else None
        text = env[source].cast("string")
        begin = env[pointer].cast("int") if pointer else F.lit(1)
        text = text.substr(begin, F.greatest(F.length(text) - begin + 1, F.lit(0))) if pointer else text
        out = dict(env)
        for i, name in enumerate(targets):
            out[name] = self._store(self._item(name).picture, strings.unstring(text, marks, i + 1, 255, every) if self._item(name).picture.kind != "numeric" else F.trim(strings.unstring(text, marks, i + 1, 255, every)))
        found = F.size(strings.parts(text, marks, every))
        if pointer:
            out[pointer] = self._store(self._item(pointer).picture, begin + strings.consumed(text, marks, len(targets), every))
        if tally:
            out[tally] = self._store(self._item(tally).picture, env[tally] + F.least(found, F.lit(len(targets))))
        full = found > len(targets)
        return self._merge(full, self._run([x for _, b in s.branches for x in b], out, stack), self._run(s.otherwise, out, stack))

    def _inspect(self, words: list[str], env: Env) -> Env:
        target, words, out = words[0], words[1:], dict(env)

        def literal(w: str) -> str:
            return str(FIGURATIVE[w]) if w in FIGURATIVE else w.strip("\"'")

        def bounds(clause: list[str]) -> dict[str, str]:
            clause = [w for w in clause if w != "INITIAL"]
            return {k.lower(): literal(clause[clause.index(k) + 1]) for k in ("BEFORE", "AFTER") if k in clause}

        if "CONVERTING" in words:
            at = words.index("CONVERTING")
            left, middle, right = strings.region(out[target], **bounds(words))
            out[target] = pad(F.concat(left, strings.converting(middle, literal(words[at + 1]), literal(words[at + 3])), right), self._item(target).picture.size)
            return out
        part, mode, i = "", "", 0
        counter = ""
        while i < len(words):
            w = words[i]
            if w in ("TALLYING", "REPLACING"):
                part, i = w, i + 1
                if part == "TALLYING":
                    counter, i = words[i], i + 1 + (words[i + 1] == "FOR")
                continue
            if w in ("ALL", "LEADING", "FIRST", "CHARACTERS"):
                mode = w
                size = 1 if mode == "CHARACTERS" else 2
                clause = words[i + size + (2 if part == "REPLACING" else 0) :]
                clause = clause[: next((k for k, x in enumerate(clause) if x in ("ALL", "LEADING", "FIRST", "CHARACTERS", "TALLYING", "REPLACING")), len(clause))]
                left, middle, right = strings.region(out[target], **bounds(clause))
                what = "" if mode == "CHARACTERS" else literal(words[i + 1])
                if part == "TALLYING":
                    found = {"ALL": strings.tally_all, "LEADING": strings.tally_leading, "CHARACTERS": lambda m, _: strings.tally_characters(m)}[mode](middle, what)
                    out[counter] = self._store(self._item(counter).picture, out[counter] + found)
                else:
                    new = literal(words[i + size + 1])
                    done = F.repeat(F.lit(new), F.length(middle)) if mode == "CHARACTERS" else {"ALL": strings.replace_all, "LEADING": strings.replace_leading, "FIRST": strings.replace_first}[mode](middle, what, new)
                    out[target] = F.concat(left, done, right)
                i += size + (2 if part == "REPLACING" else 0) + len(clause)
                continue
            raise Unsupported(f"INSPECT {' '.join(words)}")
        return out

    def _display(self, words: list[str], env: Env) -> Env:
        """A line of the operands' characters; UPON and NO ADVANCING don't change what is kept."""
        words = words[: words.index("UPON")] if "UPON" in words else words
        words = [w for w in words if w not in ("WITH", "NO", "ADVANCING", ",")]
        line = F.concat(*[self._text(w, env) for w in words]) if words else F.lit("")
        return env | {SHOWN: F.concat(env.get(SHOWN, F.array().cast("array<string>")), F.array(line))}

    def _accept(self, words: list[str], env: Env) -> Env:
        name, source = words[0], " ".join(words[2:]).replace('"', "").replace("'", "") if words[1:2] == ["FROM"] else ""
        if source.startswith("ENVIRONMENT") or source == "COMMAND-LINE" or not source:
            key = source or name
            if key not in self.inputs:
                raise Unsupported(f"no input is given for ACCEPT {key}")
            value = self.inputs[key]
            value = value if isinstance(value, Column) else F.lit(value)
        else:
            value = accept(source)
        return env | {name: self._store(self._item(name).picture, value)}

    def _call(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        """CALL by the programs that are given; an unknown one takes the ON EXCEPTION branch, or is refused."""
        name = s.words[0].strip("\"'")
        if name not in self.calls:
            if s.branches:
                return self._run([x for _, b in s.branches for x in b], env, stack)
            raise Unsupported(f"no program {name} to call")
        names = [w for w in s.words[2:] if w not in ("BY", "REFERENCE", "CONTENT", "VALUE", ",")] if s.words[1:2] == ["USING"] else []
        left = self.calls[name](*[env[n] if n in env else compute(n, env) for n in names])
        out = dict(env)
        for n, value in zip(names, left or [], strict=False):
            if n in self.items:
                out[n] = self._store(self.items[n].picture, value)
        return self._run(s.otherwise, out, stack)

    def _move(self, words: list[str], env: Env) -> Env:
        source, targets = _split(words, "TO")
        out = dict(env)
        if source[0] in ("CORRESPONDING", "CORR"):
            for a, b in self._alike(source[1], targets[0]):
                out[b] = self._store(self.items[b].picture, env[a])
            return out
        for name in targets:
            if name in self.groups:
                group = self.groups[name]
                text = pad(F.lit(str(FIGURATIVE[source[0]]) * group.size) if source[0] in FIGURATIVE and source[0] not in env else self._characters(source, env), group.size)
                for leaf in group.leaves():
                    if not leaf.overlay and leaf.occurs == 1 and leaf.name != "FILLER":
                        out[self._key_of(leaf)] = fixed_width.decode_at(text, leaf, leaf.offset - group.offset)
                continue
            if source[0] in self.groups:
                out[name] = self._store(self._item(name).picture, self._characters(source, env))
                continue
            picture = self._item(name).picture
            if source[0] in FIGURATIVE and source[0] not in env and picture.kind != "numeric":
                out[name] = F.lit(str(FIGURATIVE[source[0]]) * picture.size)
            elif source[0] == "ALL":
                fill = source[1].strip("\"'")
                out[name] = self._store(picture, F.lit((fill * picture.size)[: picture.size]))
            else:
                out[name] = self._store(picture, compute(" ".join(source), env))
        return out

    def _key_of(self, leaf: Item) -> str:
        return next(n for n, x in self.items.items() if x is leaf)

    def _alike(self, source: str, target: str) -> list[tuple[str, str]]:
        """Items of two groups that have the same name, in order of their names."""
        for name in (source, target):
            if name not in self.groups:
                raise Unsupported(f"{name} isn't a group")
        return [(self.keys[source, n], self.keys[target, n]) for n in sorted(n for g, n in self.keys if g == source and (target, n) in self.keys)]

    def _characters(self, source: list[str], env: Env) -> Column:
        """A group's characters, from its items; or an operand's."""
        if source[0] not in self.groups:
            return compute(" ".join(source), env).cast("string")
        group = self.groups[source[0]]
        return F.concat(*[F.lit(" " * x.size) if x.name == "FILLER" else fixed_width.encode_at(env[self._key_of(x)], x) for x in group.leaves() if not x.overlay])

    def _set(self, words: list[str], env: Env) -> Env:
        out = dict(env)
        if words[-2:] == ["TO", "FALSE"]:
            raise Unsupported(f"SET {' '.join(words)}: what is false isn't one value")
        if words[-2:] == ["TO", "TRUE"]:
            for flag in words[:-2]:
                item = next((x for x in self.items.values() if flag in x.conditions), None)
                if item is None:
                    raise Unsupported(f"unknown condition name {flag}")
                out[self._key_of(item)] = self._store(item.picture, F.lit(item.conditions[flag][0][0]))
            return out
        for name in words[: next((i for i, w in enumerate(words) if w in ("TO", "UP", "DOWN")), 0)]:
            way, value = ("TO", words[words.index("TO") + 1 :]) if "TO" in words else (words[words.index("BY") - 1], words[words.index("BY") + 1 :])
            x = compute(" ".join(value), env)
            out[name] = self._store(self._item(name).picture, x if way == "TO" else env[name] + x if way == "UP" else env[name] - x)
        return out

    def _arithmetic(self, s: Statement, env: Env, stack: tuple[str, ...]) -> Env:
        """Each target's exact value, then its coercion; with ON SIZE ERROR, what doesn't fit leaves its target as it was."""
        goals: list[tuple[str, Column, bool]] = []
        if s.verb in ("ADD", "SUBTRACT") and s.words[0] in ("CORRESPONDING", "CORR"):
            for a, b in self._alike(s.words[1], s.words[3]):
                if {self.items[a].picture.kind, self.items[b].picture.kind} != {"numeric"}:
                    continue
                env = self._arithmetic(Statement(s.verb, [a, s.words[2], b], s.branches, s.otherwise), env, stack)
            return env

        def targets(words: list[str]) -> list[tuple[str, bool]]:
            return [(w, words[i + 1 : i + 2] == ["ROUNDED"]) for i, w in enumerate(words) if w != "ROUNDED"]

        def value(word: str) -> Column:
            return compute(word, env)

        if s.verb == "COMPUTE":
            left, right = _split(s.words, "=")
            goals = [(n, compute(" ".join(right), env), r) for n, r in targets(left)]
        else:
            words, remainder = s.words, None
            if "REMAINDER" in words:
                words, (remainder,) = words[: words.index("REMAINDER")], words[words.index("REMAINDER") + 1 :]
            main, *giving = _split(words, "GIVING")
            link = next((w for w in ("TO", "FROM", "BY", "INTO") if w in main), None)
            sources, right = _split(main, link) if link else (main, [])
            if s.verb in ("ADD", "SUBTRACT"):
                total = value(sources[0])
                for w in sources[1:]:
                    total = total + value(w)
                if giving:
                    for w in right:
                        total = total + value(w) if s.verb == "ADD" else value(w) - total
                    goals = [(n, total, r) for n, r in targets(giving[0])]
                else:
                    goals = [(n, self._value(n, env) + total if s.verb == "ADD" else self._value(n, env) - total, r) for n, r in targets(right)]
            elif s.verb == "MULTIPLY":
                goals = [(n, value(sources[0]) * value(right[0]), r) for n, r in targets(giving[0])] if giving else [(n, value(sources[0]) * self._value(n, env), r) for n, r in targets(right)]
            else:
                pairs = [(n, r, *((right[0], sources[0]) if link == "INTO" else (sources[0], right[0]))) for n, r in targets(giving[0])] if giving else [(n, r, n, sources[0]) for n, r in targets(right)]
                goals = [(n, F.when(value(b) == 0, F.lit(None)).otherwise(divide(value(a), value(b), F.lit(0))), r) for n, r, a, b in pairs]
                if remainder:
                    a, b = pairs[0][2:]
                    # by the truncated quotient of whole numbers
                    goals.append((remainder, F.try_mod(value(a).cast("bigint"), value(b).cast("bigint")), False))
        out, failed = dict(env), F.lit(False)
        for name, x, rounded in goals:
            picture = self._item(name).picture
            if name in self.sums:
                out[name] = x
                continue
            bad = size_error(x, picture.int_digits)
            failed = failed | bad
            out[name] = F.when(bad if s.branches else x.isNull(), env[name]).otherwise(self._store(picture, x, rounded))
        if not (s.branches or s.otherwise):
            return out
        return self._merge(failed, self._run([x for _, b in s.branches for x in b], out, stack), self._run(s.otherwise, out, stack))
