"""A program's files: SELECT clauses, the kinds of file behind them, and OPEN, READ, WRITE and CLOSE with their statuses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import keyed
from recordloom.plans.copybook import Item
from recordloom.sources import fixed_width

#: File statuses.
OK, AT_END, DUPLICATE, MISSING, NO_FILE, BAD_MODE, NOT_OPEN, IS_OPEN, NOT_INPUT, NOT_OUTPUT = "00", "10", "22", "23", "35", "37", "42", "41", "47", "48"


@dataclass
class FileControl:
    """A SELECT: what a file is called, where it lies, how it is organised and read, and by which keys."""

    name: str
    assign: str = ""
    organization: str = "SEQUENTIAL"
    access: str = "SEQUENTIAL"
    key: str | None = None
    alternates: list[str] = field(default_factory=list)
    status: str | None = None
    optional: bool = False

    @property
    def adapter(self) -> str:
        """Which kind of file serves it: lines of text, or records by key."""
        return "keyed" if self.organization in ("INDEXED", "RELATIVE") else "lines"


def parse_file_control(text: str) -> list[FileControl]:
    """The SELECT sentences of a FILE-CONTROL paragraph."""
    out = []
    plain = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("*"))
    for body in re.findall(r"\bSELECT\s+(.*?)\.(?=\s|$)", plain, re.I | re.S):
        words = re.findall(r"\"[^\"]*\"|'[^']*'|[\w.-]+", body)
        upper = [w.upper() for w in words]
        optional = upper[0] == "OPTIONAL"
        control = FileControl(upper[optional], optional=optional)
        joined = " ".join(upper)
        if "ASSIGN" in upper:
            at = upper.index("ASSIGN") + 1
            while upper[at] in ("TO", "DISK", "EXTERNAL", "DYNAMIC"):
                at += 1
            control.assign = words[at].strip("\"'")
        if m := re.search(r"\b(?:ORGANIZATION\s+(?:IS\s+)?)?(LINE SEQUENTIAL|INDEXED|RELATIVE)\b|\bORGANIZATION\s+(?:IS\s+)?(SEQUENTIAL)\b", joined):
            control.organization = m[1] or m[2]
        if m := re.search(r"\bACCESS\s+(?:MODE\s+)?(?:IS\s+)?(SEQUENTIAL|RANDOM|DYNAMIC)\b", joined):
            control.access = m[1]
        control.alternates = re.findall(r"\bALTERNATE\s+(?:RECORD\s+)?(?:KEY\s+)?(?:IS\s+)?([\w-]+)", joined)
        if m := re.search(r"(?<!ALTERNATE )\b(?:RECORD|RELATIVE)\s+KEY\s+(?:IS\s+)?([\w-]+)", re.sub(r"ALTERNATE RECORD KEY( IS)? [\w-]+", "", joined)):
            control.key = m[1]
        if m := re.search(r"\b(?:FILE\s+)?STATUS\s+(?:IS\s+)?([\w-]+)", joined):
            control.status = m[1]
        out.append(control)
    return out


def parse_open(text: str) -> list[tuple[str, str]]:
    """(mode, file) of an OPEN, which may name several modes; a CLOSE's files come with the mode CLOSE."""
    out, mode = [], ""
    for word in re.findall(r"[\w-]+", text.upper()):
        if word in ("INPUT", "OUTPUT", "EXTEND", "I-O", "CLOSE"):
            mode = word
        elif word not in ("OPEN", "WITH", "LOCK", "NO", "REWIND", "REVERSED", "REEL", "UNIT") and mode:
            out.append((mode, word))
    return out


class RecordFile:
    """One file of a program: what it holds is a frame, every verb gives it a status.

    Sequential files lie at a path as lines of text. Keyed files lie at a path as Parquet with the record's columns,
    or are frames handed in. What OUTPUT, EXTEND and I-O change is a plan until CLOSE writes it, to a new folder that
    then takes the old one's place by name: an executor lost meanwhile leaves the old records as they were.
    """

    def __init__(self, spark: SparkSession, control: FileControl, item: Item, path: str | None = None, frame: DataFrame | None = None):
        self.spark, self.control, self.item, self.path = spark, control, item, path
        self.held, self.mode, self.status = frame, None, OK
        self.position: object = None
        self.added: list[DataFrame] = []

    def _there(self) -> bool:
        if self.held is not None:
            return True
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _load(self) -> DataFrame:
        if self.held is not None:
            return self.held
        return self.spark.read.parquet(self.path) if self.control.adapter == "keyed" else fixed_width.scan(self.spark, self.path, self.item)

    def open(self, mode: str) -> str:
        """INPUT and I-O of a missing file: 35, unless it is OPTIONAL; opened already: 41; an unknown mode: 37."""
        if self.mode is not None:
            self.status = IS_OPEN
        elif mode not in ("INPUT", "OUTPUT", "EXTEND", "I-O"):
            self.status = BAD_MODE
        elif mode in ("INPUT", "I-O") and not self._there() and not self.control.optional:
            self.status = NO_FILE
        else:
            self.mode, self.status, self.position, self.added = mode, OK, None, []
            if mode == "OUTPUT" or not self._there():
                self.frame = self._empty()
            else:
                self.frame = self._load()
        return self.status

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([("",)], "value string").select(*fixed_width.decode(F.col("value"), self.item)).where("false")

    def _reads(self) -> bool:
        self.status = OK if self.mode in ("INPUT", "I-O") else NOT_OPEN if self.mode is None else NOT_INPUT
        return self.status == OK

    def read_all(self) -> DataFrame:
        """All records, as the loop of READs up to AT END sees them; the status is 10 behind them."""
        if not self._reads():
            raise ValueError(f"{self.control.name}: status {self.status}")
        self.status = AT_END
        return self.frame

    def read(self, value: Column | None = None, key: str | None = None) -> DataFrame:
        """READ by key, or the next record behind the position; one row at most, none with status 23 or 10."""
        if not self._reads():
            return self.frame.where("false") if self.mode else self._empty()
        column = (key or self.control.key or "").lower().replace("-", "_")
        if value is not None:
            out = self.frame.where(F.col(column) == value).limit(1)
            self.status = MISSING if out.isEmpty() else OK
            return out
        out = keyed.read_next(self.frame, column, None if self.position is None else F.lit(self.position)) if self.control.adapter == "keyed" else self.frame.limit(0)
        row = out.first()
        self.status = AT_END if row is None else OK
        self.position = self.position if row is None else row[column]
        return out

    def start(self, relation: str, value: Column) -> str:
        column = self.control.key.lower().replace("-", "_")
        self.status = keyed.start_status(self.frame, column, relation, value).first()["status"] if self._reads() else self.status
        return self.status

    def write(self, records: DataFrame) -> str:
        """WRITE records; a keyed file takes what it lacks, and is 22 if any was there."""
        if self.mode not in ("OUTPUT", "EXTEND", "I-O"):
            self.status = NOT_OPEN if self.mode is None else NOT_OUTPUT
            return self.status
        if self.control.adapter == "keyed":
            column = self.control.key.lower().replace("-", "_")
            self.frame, status = keyed.write(self.frame, records.select(*self.frame.columns), column)
            self.status = OK if status.where(F.col("status") == DUPLICATE).isEmpty() else DUPLICATE
        else:
            self.added.append(records)
            self.status = OK
        return self.status

    def rewrite(self, records: DataFrame) -> str:
        column = self.control.key.lower().replace("-", "_")
        self.frame, status = keyed.rewrite(self.frame, records.select(*self.frame.columns), column)
        self.status = OK if status.where(F.col("status") == MISSING).isEmpty() else MISSING
        return self.status

    def delete(self, keys: DataFrame) -> str:
        column = self.control.key.lower().replace("-", "_")
        self.frame, status = keyed.delete(self.frame, keys, column)
        self.status = OK if status.where(F.col("status") == MISSING).isEmpty() else MISSING
        return self.status

    def close(self) -> str:
        """Write what was changed; 42 if it isn't open."""
        if self.mode is None:
            self.status = NOT_OPEN
            return self.status
        mode, self.mode, self.status = self.mode, None, OK
        if mode == "INPUT":
            return OK
        if self.control.adapter == "lines" and self.path:
            if mode == "OUTPUT" and not self.added:
                self.added = [self.frame]
            for i, records in enumerate(self.added):
                fixed_width.write(records, self.path, self.item, extend=mode == "EXTEND" or i > 0)
        elif self.path and self.held is None:
            fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
            old, new = fs.Path(self.path), fs.Path(f"{self.path}.new")
            self.frame.write.mode("overwrite").parquet(f"{self.path}.new")
            where = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            where.delete(old, True)
            where.rename(new, old)
        else:
            self.held = self.frame
        return OK
