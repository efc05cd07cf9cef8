"""Fixed-width records: scan and sink, tables as nested arrays, overlays as further columns over the same bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.semantics import OVERPUNCH, from_zoned, justified, pad, zoned
from recordloom.plans.copybook import Item, column_names


def _slice(raw: Column, at: int | Column, size: int) -> Column:
    """`size` characters or bytes from offset `at`."""
    return F.substring(raw, at + 1, size)


def _number(raw: Column, at: int | Column, leaf: Item, binary: bool) -> Column:
    picture = leaf.picture
    kind = f"decimal({picture.int_digits + picture.decimals},{picture.decimals})"
    shift = F.lit(10**picture.decimals).cast("decimal(19,0)")
    if leaf.usage == "packed":  # two digits a byte, the sign in the last half
        nibbles = F.hex(_slice(raw, at, leaf.one))
        digits = F.substring(nibbles, 1, 2 * leaf.one - 1).try_cast("decimal(20,0)")
        value = F.when(F.substring(nibbles, 2 * leaf.one, 1).isin("B", "D"), -digits).otherwise(digits)
        return F.coalesce((value / shift).cast(kind), F.lit(0).cast(kind))
    if leaf.usage == "binary":  # two's complement, highest byte first
        value = F.conv(F.hex(_slice(raw, at, leaf.one)), 16, 10).cast("decimal(20,0)")
        value = F.when(value >= F.lit(1 << (8 * leaf.one - 1)).cast("decimal(20,0)"), value - F.lit(1 << (8 * leaf.one)).cast("decimal(21,0)")).otherwise(value)
        return (value / shift).cast(kind)
    text = _slice(raw, at, leaf.one)
    text = F.decode(text, "ISO-8859-1") if binary else text
    if leaf.sign:
        mark = F.substring(text, 1 if leaf.sign == "leading" else leaf.one, 1)
        size = from_zoned(F.substring(text, 2 if leaf.sign == "leading" else 1, leaf.one - 1), picture.decimals)
        return F.when(mark == "-", -size).otherwise(size).cast(kind)
    return from_zoned(text, picture.decimals, picture.signed).cast(kind)


def _one(raw: Column, item: Item, at: int | Column, root: Item, binary: bool) -> Column:
    """One occurrence of an item: a value, or a struct of a group's items."""
    if not item.elementary:
        return F.struct(*[_whole(raw, c, at + (c.offset - item.offset), root, binary).alias(n) for n, c in _members(item)])
    if item.usage in ("float", "double"):
        raise ValueError(f"{item.name}: floating-point usage can't be read from records")
    if item.usage != "display" and not binary:
        raise ValueError(f"{item.name}: {item.usage} items need binary records, not lines of text")
    if item.picture.kind == "numeric":
        return _number(raw, at, item, binary)
    text = _slice(raw, at, item.one)
    return pad(F.decode(text, "ISO-8859-1") if binary else text, item.one)


def _members(group: Item) -> list[tuple[str, Item]]:
    return column_names(group)


def _whole(raw: Column, item: Item, at: int | Column, root: Item, binary: bool) -> Column:
    """All occurrences: an array where there are several, cut to what its count item says."""
    if item.occurs == 1:
        return _one(raw, item, at, root, binary)
    table = F.transform(F.sequence(F.lit(0), F.lit(item.occurs - 1)), lambda i: _one(raw, item, F.lit(at) + i * item.one if isinstance(at, int) else at + i * item.one, root, binary))
    if item.depending is None:
        return table
    counter = next((x for x in root.walk() if x.name == item.depending), None)
    if counter is None:
        raise ValueError(f"{item.name} depends on {item.depending}, which isn't in its record")
    n = _one(raw, counter, counter.offset, root, binary).cast("int")
    return F.slice(table, F.lit(1), F.least(F.greatest(n, F.lit(0)), F.lit(item.occurs)))


def decode(raw: Column, item: Item, binary: bool = False) -> list[Column]:
    """A column for each elementary item of a record and each table: numbers from their digits, texts as they stand.

    Tables are arrays, of structs where a group occurs, nested as deep as OCCURS is. `binary`: raw holds bytes, and
    packed and binary usages can be read; a line of text that has such an item is refused.
    """
    return [_whole(raw, leaf, leaf.offset, item, binary).alias(name) for name, leaf in column_names(item)]


def _text(value: Column, item: Item) -> Column:
    """One occurrence as characters."""
    if not item.elementary:
        return F.concat(*[_texts(value[n], c) for n, c in _members(item) if c.redefines is None])
    if item.usage != "display":
        raise ValueError(f"{item.name}: {item.usage} items can't be written to lines of text")
    if item.picture.kind != "numeric":
        return justified(value, item.one) if item.justified else pad(value, item.one)
    picture = item.picture
    digits = zoned(value, picture.int_digits + picture.decimals, picture.decimals)
    if item.sign:
        mark = F.when(value < 0, "-").otherwise("+")
        out = F.concat(mark, digits) if item.sign == "leading" else F.concat(digits, mark)
    elif picture.signed:
        last = F.substring(digits, picture.size, 1).cast("int")
        out = F.when(value < 0, F.concat(F.substring(digits, 1, picture.size - 1), F.substring(F.lit(OVERPUNCH), last + 11, F.lit(1)))).otherwise(digits)
    else:
        out = digits
    return F.when(value == 0, F.lit(" " * item.one)).otherwise(out) if item.blank_zero else out


def _texts(value: Column, item: Item) -> Column:
    if item.occurs == 1:
        return _text(value, item)
    return F.rpad(F.array_join(F.transform(F.slice(value, 1, item.occurs), lambda x: _text(x, item)), ""), item.size, " ")


def encode(item: Item) -> Column:
    """One line from the columns of a record; overlays aren't written twice. Missing elements of a table are blank.

    A negative number without a sign of its own carries it in its last character.
    """
    return F.concat(*[_texts(F.col(name), leaf) for name, leaf in column_names(item) if not leaf.overlay])


def encode_struct(item: Item, record: Column) -> Column:
    """The same from a struct that has the columns as fields."""
    return F.concat(*[_texts(record[name], leaf) for name, leaf in column_names(item) if not leaf.overlay])


def decode_at(raw: Column, item: Item, at: int) -> Column:
    """An item's value from the characters of its group, `at` of which stand before it."""
    return _one(raw, item, at, item, False)


def encode_at(value: Column, item: Item) -> Column:
    """An item's characters."""
    return _texts(value, item)


def place(raw: Column, item: Item, value: Column) -> Column:
    """A record's characters with those of one of its items, an overlay too, replaced by a value."""
    return F.overlay(raw, _text(value, item), F.lit(item.offset + 1))


def scan(spark: SparkSession, path: str, item: Item, keep_raw: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return lines.select(*decode(F.col("value"), item), *([F.col("value").alias("_raw")] if keep_raw else []))


def scan_binary(spark: SparkSession, path: str, item: Item) -> DataFrame:
    """Records of a fixed number of bytes without line ends, in splits of whole records: packed and binary usages."""
    records = spark.sparkContext.binaryRecords(path, item.size).map(lambda record: (bytearray(record),))
    return spark.createDataFrame(records, "value binary").select(*decode(F.col("value"), item, binary=True))


def advancing(line: Column, lines: Column | int | None = None, before: bool = False) -> Column:
    """A print line with the control characters of ADVANCING: n line ends in front (AFTER) or behind (BEFORE); None is PAGE."""
    move = F.lit("\f") if lines is None else F.repeat(F.lit("\n"), F.lit(lines) if isinstance(lines, int) else lines.cast("int"))
    return F.concat(line, move) if before else F.concat(move, line)


def write(df: DataFrame, path: str, item: Item, extend: bool = False, before: int = 0, after: int = 0) -> None:
    """OPEN OUTPUT replaces, OPEN EXTEND adds; `before` and `after` are blank lines of ADVANCING."""
    line = F.concat(F.lit("\n" * before), encode(item), F.lit("\n" * after))
    df.select(line.alias("value")).write.mode("append" if extend else "overwrite").text(path)
