"""PICTURE clauses and data descriptions, compiled to record layouts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from recordloom.functions.strings import safe_name


@dataclass(frozen=True)
class Picture:
    kind: str  # numeric, alphanumeric, alphabetic or edited
    int_digits: int
    decimals: int
    signed: bool
    size: int
    text: str = ""  # expanded, of edited pictures


def expand(picture: str) -> str:
    """9(3)X -> 999X."""
    return re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), picture.upper())


def parse_picture(picture: str) -> Picture:
    text = expand(picture)
    size = len(re.sub("[SVP]", "", text)) + 0
    if re.search(r"[Z*$,.+\-/B]|CR|DB", text):
        point = text.find(".") if "." in text else text.find("V")
        decimals = len(re.findall("[9Z*]", text[point:])) if point >= 0 else 0
        digits = len(re.findall("[9Z*$+-]", text))
        return Picture("edited", max(0, digits - decimals), decimals, bool(re.search(r"[+\-]|CR|DB", text)), size, text)
    if "X" in text or "A" in text and "9" in text:
        return Picture("alphanumeric", 0, 0, False, size)
    if "A" in text:
        return Picture("alphabetic", 0, 0, False, size)
    decimals = text.split("V")[1].count("9") if "V" in text else 0
    return Picture("numeric", text.count("9") - decimals, decimals, "S" in text, size)


#: Usages by their names: how an item's digits are kept. DISPLAY is text.
USAGES = {"COMP": "binary", "COMPUTATIONAL": "binary", "COMP-4": "binary", "COMP-5": "binary", "BINARY": "binary", "COMP-3": "packed", "COMPUTATIONAL-3": "packed", "PACKED-DECIMAL": "packed", "COMP-1": "float", "COMP-2": "double", "DISPLAY": "display", "INDEX": "binary"}


@dataclass
class Item:
    level: int
    name: str
    picture: Picture | None = None
    occurs: int = 1
    redefines: str | None = None
    value: str | None = None
    conditions: dict[str, list[tuple[str, str | None]]] = field(default_factory=dict)
    children: list[Item] = field(default_factory=list)
    offset: int = 0
    usage: str = "display"
    depending: str | None = None  # the item that counts a table's elements
    sign: str = ""  # leading or trailing, where the sign has a character of its own
    justified: bool = False
    blank_zero: bool = False
    overlay: bool = False  # it, or a group that it is in, redefines or renames others

    @property
    def elementary(self) -> bool:
        return self.picture is not None or self.usage in ("float", "double")

    @property
    def one(self) -> int:
        """Bytes of one occurrence."""
        if not self.elementary:
            return max([sum(c.size for c in self.children if c.redefines is None), *(c.offset - self.offset + c.size for c in self.children)], default=0)
        if self.usage in ("float", "double"):
            return 4 if self.usage == "float" else 8
        digits = self.picture.int_digits + self.picture.decimals
        if self.usage == "binary":
            return 2 if digits < 5 else 4 if digits < 10 else 8
        return digits // 2 + 1 if self.usage == "packed" else self.picture.size + bool(self.sign)

    @property
    def size(self) -> int:
        return self.one * self.occurs

    def leaves(self) -> list[Item]:
        return [self] if self.elementary else [x for c in self.children for x in c.leaves()]

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


_CLAUSE = re.compile(r"^\s*(\d+)\s+([\w-]+)(.*)$", re.S)
_LITERAL = r"\"[^\"]*\"|'[^']*'|[^\s,]+"


def parse_records(text: str) -> list[Item]:
    """Items of a data description by their levels; 88s attach to the item before, overlays take their base's offset.

    66 RENAMES become overlays over the items they name. A usage of a group holds for its items.
    """
    roots: list[Item] = []
    stack: list[Item] = []
    renames: list[tuple[Item, str, str, str]] = []
    for sentence in re.split(r"\.(?=\s|$)", "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("*"))):
        m = _CLAUSE.match(sentence)
        if not m:
            continue
        level, name, rest = int(m[1]), m[2].upper(), m[3]
        if level == 88:
            body = re.sub(r"^\s*VALUES?\s+(ARE|IS)?", "", rest.strip(), flags=re.I)
            pairs = re.findall(rf"({_LITERAL})(?:\s+(?:THRU|THROUGH)\s+({_LITERAL}))?", body, re.I)
            stack[-1].conditions[name] = [(a.strip("\"'"), b.strip("\"'") if b else None) for a, b in pairs]
            continue
        if level == 66:
            span = re.search(r"RENAMES\s+([\w-]+)(?:\s+(?:THRU|THROUGH)\s+([\w-]+))?", rest, re.I)
            if span and roots:
                renames.append((roots[-1], name, span[1].upper(), (span[2] or span[1]).upper()))
            continue
        item = _described(level, name, rest)
        while stack and (stack[-1].level >= level or level == 77):
            stack.pop()
        if stack and item.usage == "display" and stack[-1].usage != "display":
            item.usage = stack[-1].usage
        (stack[-1].children if stack else roots).append(item)
        stack.append(item)
    for root in roots:
        _place(root, 0)
    for root, name, first, last in renames:
        where = {x.name: x for x in root.walk()}
        if first not in where or last not in where:
            raise ValueError(f"{name} renames what isn't there")
        size = where[last].offset + where[last].size - where[first].offset
        root.children.append(Item(66, name, Picture("alphanumeric", 0, 0, False, size), redefines=first, offset=where[first].offset, overlay=True))
    return roots


def _described(level: int, name: str, rest: str) -> Item:
    pic = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", rest, re.I)
    clauses = re.sub(r"\"[^\"]*\"|'[^']*'", " ", rest.replace(pic[0], " ") if pic else rest).upper()
    occurs = re.search(r"\bOCCURS\s+(?:\d+\s+TO\s+)?(\d+)", clauses)
    depending = re.search(r"\bDEPENDING\s+(?:ON\s+)?([\w-]+)", clauses)
    base = re.search(r"\bREDEFINES\s+([\w-]+)", clauses)
    value = re.search(r"\bVALUE\s+(?:IS\s+)?(\"[^\"]*\"|'[^']*'|\S+)", rest, re.I)
    usage = next((USAGES[w] for w in re.findall(r"[\w-]+", clauses) if w in USAGES), "display")
    sign = re.search(r"\b(LEADING|TRAILING)\s+SEPARATE", clauses)
    return Item(
        level, name, parse_picture(pic[1]) if pic else None, int(occurs[1]) if occurs else 1, base[1] if base else None, value[1].strip("\"'") if value else None,
        usage=usage, depending=depending[1] if depending and occurs else None, sign=sign[1].lower() if sign else "", justified=bool(re.search(r"\bJUST(IFIED)?\b", clauses)), blank_zero=bool(re.search(r"\bBLANK\s+(WHEN\s+)?ZERO", clauses)),
    )


def _place(item: Item, at: int, overlay: bool = False) -> None:
    item.offset, item.overlay = at, overlay or item.redefines is not None
    where: dict[str, int] = {}
    for child in item.children:
        if child.redefines is not None and child.redefines not in where:
            raise ValueError(f"{child.name} redefines {child.redefines}, which isn't beside it")
        if child.redefines is not None and any(x.depending for x in item.children if x.name == child.redefines):
            raise ValueError(f"{child.name} redefines a table of variable length")
        start = where[child.redefines] if child.redefines is not None else at
        _place(child, start, item.overlay)
        where[child.name] = start
        if child.redefines is None:
            at += child.size


def column_names(item: Item) -> list[tuple[str, Item]]:
    """A distinct column name for each item that is a column: its own, with its group's where it clashes, or with a number.

    Columns are elementary items and, as arrays, groups that occur more than once.
    """
    out: list[tuple[str, Item]] = []
    taken: dict[str, int] = {}

    def walk(node: Item, group: str) -> None:
        for child in node.children or [node]:
            if not child.elementary and child.occurs == 1:
                walk(child, safe_name(child.name))
                continue
            name = safe_name(child.name)
            if name in taken:
                name = f"{group}_{name}" if f"{group}_{name}" not in taken else f"{name}_{taken[name]}"
            taken[name] = taken.get(name, 0) + 1
            out.append((name, child))

    walk(item, safe_name(item.name))
    return out
