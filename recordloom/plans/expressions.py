"""Arithmetic and condition text, compiled to Columns. What can't be parsed raises SyntaxError."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.intrinsics import intrinsic
from recordloom.functions.semantics import equal, is_alphabetic, is_numeric

_TOKEN = re.compile(r"\s*(?:(\"[^\"]*\"|'[^']*')|(\d+\.\d+|\.\d+|\d+(?![\w-]))|([A-Za-z0-9][\w-]*)|(\*\*|>=|<=|<>|[-+*/()=<>,:]))")
FIGURATIVE = {"ZERO": 0, "ZEROS": 0, "ZEROES": 0, "SPACE": " ", "SPACES": " ", "HIGH-VALUE": "\xff", "HIGH-VALUES": "\xff", "LOW-VALUE": "\x00", "LOW-VALUES": "\x00", "QUOTE": '"', "QUOTES": '"'}
BITS: dict[str, Callable[[Column, Column], Column]] = {
    "B-AND": lambda a, b: a.bitwiseAND(b), "B-OR": lambda a, b: a.bitwiseOR(b), "B-XOR": lambda a, b: a.bitwiseXOR(b),
    "B-SHIFT-L": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), "B-SHIFT-R": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}


class Parser:
    """Recursive descent over one text. `fields` gives Columns by upper-case name; `conditions` the 88-level names."""

    def __init__(self, text: str, fields: Mapping[str, Column], conditions: Mapping[str, Column] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"can't read {text[at:]!r}")
            kind = "text" if m[1] else "number" if m[2] else "name" if m[3] else "sign"
            self.tokens.append((kind, m[m.lastindex].upper() if kind in ("name", "sign") else m[m.lastindex]))
            at = m.end()
        self.at, self.fields, self.conditions = 0, fields, conditions or {}

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] != "text" else ""

    def take(self, *words: str) -> bool:
        """Pass the given words if they come next."""
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise SyntaxError(f"unexpected {self.tokens[self.at][1]!r}")

    # arithmetic
    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-") or self.peek() in BITS:
            sign = self.peek()
            self.at += 1
            right = self.product()
            left = left + right if sign == "+" else left - right if sign == "-" else BITS[sign](left.cast("bigint"), right.cast("bigint"))
        return left

    def product(self) -> Column:
        left = self.power()
        while self.peek() in ("*", "/"):
            times = self.take("*") or not self.take("/")
            right = self.power()
            left = left * right if times else F.try_divide(left, right)
        return left

    def power(self) -> Column:
        base = self.operand()
        return F.pow(base, self.power()) if self.take("**") else base

    def operand(self) -> Column:
        if self.take("("):
            inner = self.sum()
            if not self.take(")"):
                raise SyntaxError("a bracket isn't closed")
            return inner
        if self.take("-"):
            return -self.power()
        if self.take("+"):
            return self.power()
        if self.take("B-NOT"):
            return F.bitwise_not(self.operand().cast("bigint"))
        if self.at >= len(self.tokens):
            raise SyntaxError("an operand is missing")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return F.lit(word[1:-1])
        if kind == "number":
            return F.lit(Decimal(word)) if "." in word else F.lit(int(word))
        if kind == "name" and word == "FUNCTION":
            return self.function()
        if kind == "name" and word == "LENGTH" and self.take("OF"):
            return F.length(self.operand().cast("string"))
        if kind == "name" and word in FIGURATIVE and word not in self.fields:
            return F.lit(FIGURATIVE[word])
        if kind == "name":
            while self.peek() in ("OF", "IN") and f"{word} OF {self.peek(1)}" in self.fields:
                word = f"{word} OF {self.peek(1)}"
                self.at += 2
            if word not in self.fields:
                raise SyntaxError(f"unknown name {word}")
            return self.subscript(self.fields[word])
        raise SyntaxError(f"unexpected {word!r}")

    def subscript(self, column: Column) -> Column:
        """T(i), T(i j) and F(start:length)."""
        if self.peek() != "(":
            return column
        self.at += 1
        first = self.sum()
        if self.take(":"):
            size = None if self.peek() == ")" else self.sum()
            text = column.cast("string")
            column = text.substr(first.cast("int"), F.length(text) if size is None else size.cast("int"))
        else:
            column = F.element_at(column, first.cast("int"))
            while self.peek() not in (")", ""):
                self.take(",")
                column = F.element_at(column, self.sum().cast("int"))
        if not self.take(")"):
            raise SyntaxError("a bracket isn't closed")
        return column

    def function(self) -> Column:
        name = self.peek()
        self.at += 1
        arguments = []
        if self.take("("):
            while not self.take(")"):
                arguments.append(self.sum())
                self.take(",")
                if self.at >= len(self.tokens):
                    raise SyntaxError("a bracket isn't closed")
        return intrinsic(name, *arguments)

    # conditions
    def either(self) -> Column:
        left = self.both()
        while self.take("OR"):
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.negated()
        while self.peek() == "AND":
            self.at += 1
            left = left & self.negated()
        return left

    def negated(self) -> Column:
        return ~self.negated() if self.take("NOT") else self.relation()

    def relation(self) -> Column:
        if self.peek() in self.conditions:
            self.at += 1
            return self.conditions[self.tokens[self.at - 1][1]]
        if self.peek() == "(":
            start = self.at
            try:  # a condition in brackets, or else arithmetic
                self.at += 1
                inner = self.either()
                if self.take(")") and not self._operator_next():
                    return inner
            except SyntaxError:
                pass
            self.at = start
        subject = self.sum()
        self.take("IS")
        negative = self.take("NOT")
        for word, test in _CLASS.items():
            if self.take(word):
                return ~test(subject) if negative else test(subject)
        compare = self.operator()
        if compare is None:
            raise SyntaxError("a relation is missing")
        out = self._compared(subject, compare, negative)
        # abbreviated relations take the subject, and the operator where none is given
        while self.peek() in ("AND", "OR") and self._abbreviated():
            joint = self.peek()
            self.at += 1
            again, other = self.take("NOT"), self.operator()
            if other is not None:
                compare, negative = other, again
            more = self._compared(subject, compare, negative if other is not None else negative != again)
            out = out & more if joint == "AND" else out | more
        return out

    def _compared(self, subject: Column, compare: Callable, negative: bool) -> Column:
        start = self.at
        literal = self.tokens[start][0] == "text" or self.peek().startswith("SPACE") if start < len(self.tokens) else False
        value = self.sum()
        if literal:
            subject, value = F.rtrim(subject.cast("string")), F.rtrim(value)
        out = compare(subject, value)
        return ~out if negative else out

    def _operator_next(self) -> bool:
        return self.peek() in ("=", ">", "<", ">=", "<=", "<>", "+", "-", "*", "/", "**", "IS", "EQUAL", "GREATER", "LESS")

    def _abbreviated(self) -> bool:
        ahead = 2 if self.peek(1) == "NOT" else 1
        word = self.peek(ahead)
        if word in ("=", ">", "<", ">=", "<=", "<>", "EQUAL", "GREATER", "LESS"):
            return True
        if word in self.conditions or word == "(":
            return False
        # a bare operand: abbreviated if no relation of its own follows
        start = self.at
        try:
            self.at += ahead
            self.sum()
            return not self._operator_next() and self.peek() not in ("NOT", *_CLASS)
        except SyntaxError:
            return False
        finally:
            self.at = start

    def operator(self) -> Callable | None:
        self.take("IS")
        for words, test in _OPERATORS:
            if self.take(*words):
                return test
        return None


_CLASS: dict[str, Callable[[Column], Column]] = {
    "NUMERIC": lambda x: is_numeric(x.cast("string")),
    "ALPHABETIC": is_alphabetic,
    "ALPHABETIC-UPPER": lambda x: is_alphabetic(x) & (F.upper(x) == x),
    "ALPHABETIC-LOWER": lambda x: is_alphabetic(x) & (F.lower(x) == x),
    "POSITIVE": lambda x: x > 0,
    "NEGATIVE": lambda x: x < 0,
    "ZERO": lambda x: x == 0,
    "ZEROS": lambda x: x == 0,
    "ZEROES": lambda x: x == 0,
}
_GE, _LE = (lambda a, b: a >= b), (lambda a, b: a <= b)
_OPERATORS: list[tuple[tuple[str, ...], Callable]] = [
    (("GREATER", "THAN", "OR", "EQUAL", "TO"), _GE), (("GREATER", "THAN", "OR", "EQUAL"), _GE), (("GREATER", "OR", "EQUAL", "TO"), _GE), (("GREATER", "OR", "EQUAL"), _GE),
    (("LESS", "THAN", "OR", "EQUAL", "TO"), _LE), (("LESS", "THAN", "OR", "EQUAL"), _LE), (("LESS", "OR", "EQUAL", "TO"), _LE), (("LESS", "OR", "EQUAL"), _LE),
    (("GREATER", "THAN"), lambda a, b: a > b), (("GREATER",), lambda a, b: a > b), (("LESS", "THAN"), lambda a, b: a < b), (("LESS",), lambda a, b: a < b),
    (("EQUAL", "TO"), lambda a, b: a == b), (("EQUAL",), lambda a, b: a == b), ((">=",), _GE), (("<=",), _LE), (("<>",), lambda a, b: a != b),
    (("=",), lambda a, b: a == b), ((">",), lambda a, b: a > b), (("<",), lambda a, b: a < b),
]


def compute(text: str, fields: Mapping[str, Column]) -> Column:
    parser = Parser(text, fields)
    out = parser.sum()
    parser.done()
    return out


def condition(text: str, fields: Mapping[str, Column], conditions: Mapping[str, Column] | None = None) -> Column:
    parser = Parser(text, fields, conditions)
    out = parser.either()
    parser.done()
    return out


def condition_name(column: Column, values: list[tuple], numeric: bool = False) -> Column:
    """An 88-level name: any of its values or ranges."""
    cast = (lambda v: F.lit(Decimal(str(v)))) if numeric else F.lit
    out = F.lit(False)
    for low, high in values:
        out = out | (column.between(cast(low), cast(high)) if high is not None else (column == cast(low) if numeric else equal(column, cast(low))))
    return out


def evaluate(cases: list[tuple[Column, Column]], other: Column | None = None) -> Column:
    """EVALUATE: the first case that holds."""
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    if out is None:
        return other
    return out if other is None else out.otherwise(other)


def also(*subjects: tuple[Column, object]) -> Column:
    """One WHEN of EVALUATE … ALSO: a value, a (low, high) range, a list of values, or None for ANY, for each subject."""
    out = F.lit(True)
    for column, want in subjects:
        if isinstance(want, tuple):
            out = out & column.between(*want)
        elif isinstance(want, list):
            out = out & column.isin(want)
        elif want is not None:
            out = out & (column == F.lit(want))
    return out
