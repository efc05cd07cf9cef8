"""Keyed files as joins: every operation returns a frame, with COBOL's status codes where it has outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ordering import numbered

OK, END, DUPLICATE, MISSING, NO_FILE = "00", "10", "22", "23", "35"


def read_keys(probes: DataFrame, file: DataFrame, key: str) -> DataFrame:
    """READ by key for every probe row: the record's columns and status 00, or nulls and 23."""
    hit = file.withColumn("_hit", F.lit(True))
    return probes.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), OK).otherwise(MISSING)).drop("_hit")


def _position(file: DataFrame, key: str, relation: str, value: Column) -> DataFrame:
    """One row: _from, the key that START finds (null: status 23), and how records from there on compare with it."""
    at = F.col(key)
    hit = {"=": at == value, ">": at > value, ">=": at >= value, "<": at < value, "<=": at <= value}[_RELATIONS.get(relation.upper(), relation)]
    return file.where(hit).agg((F.max if relation in ("<", "<=") or _RELATIONS.get(relation.upper()) in ("<", "<=") else F.min)(key).alias("_from"))


#: How START's relations may be written.
_RELATIONS = {"EQUAL": "=", "EQUAL TO": "=", "GREATER": ">", "GREATER THAN": ">", "NOT LESS": ">=", "NOT LESS THAN": ">=", "GREATER OR EQUAL": ">=", "NOT <": ">=", "LESS": "<", "LESS THAN": "<", "NOT GREATER": "<=", "NOT GREATER THAN": "<=", "NOT >": "<="}


def start(file: DataFrame, key: str, relation: str, value: Column) -> DataFrame:
    """START: the records from the position on, in no order, for =, >, >=, <, <= and their words; none where it finds no key.

    < and <= take the last record up to the key, then go forward.
    """
    at = F.col(key)
    return file.join(F.broadcast(_position(file, key, relation, value)), at >= F.col("_from")).drop("_from")


def start_status(file: DataFrame, key: str, relation: str, value: Column) -> DataFrame:
    """One row with the status of START: 00, or 23 where no record has such a key."""
    return _position(file, key, relation, value).select(F.when(F.col("_from").isNull(), MISSING).otherwise(OK).alias("status"))


def start_each(probes: DataFrame, file: DataFrame, key: str, probe: str) -> DataFrame:
    """START >= then READ NEXT for every probe row: the record of the least key not below `probe`, and its status (10: the end).

    Probes and records are sorted together within ranges of the key, so no task sees more than its range; what a
    range lacks comes from the first record of a later one, by a table of one row a range.
    """
    record = F.struct(*file.columns)
    by = int(file.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = probes.select(F.col(probe).alias("_k"), F.lit(0).alias("_of"), F.struct(*probes.columns).alias("_probe"), F.lit(None).cast(file.select(record.alias("r")).schema["r"].dataType).alias("_record"))
    rows = rows.unionByName(file.select(F.col(key).alias("_k"), F.lit(1).alias("_of"), F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("r")).schema["r"].dataType).alias("_probe"), record.alias("_record")))
    ranged = rows.repartitionByRange(by, "_k").withColumn("_range", F.spark_partition_id()).persist()
    ahead = Window.partitionBy("_range").orderBy("_k", "_of").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = ranged.withColumn("_hit", F.first("_record", ignorenulls=True).over(ahead)).where("_of = 0")
    firsts = ranged.where("_of = 1").groupBy("_range").agg(F.min_by("_record", "_k").alias("_first"))
    later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # a row for each range
    every = ranged.select("_range").distinct().join(firsts, "_range", "left").select("_range", F.first("_first", ignorenulls=True).over(later).alias("_next"))
    found = near.join(F.broadcast(every), "_range").withColumn("_hit", F.coalesce("_hit", "_next"))
    return found.select("_probe.*", *[F.col(f"_hit.{c}").alias(f"next_{c}" if c in probes.columns else c) for c in file.columns], F.when(F.col("_hit").isNull(), END).otherwise(OK).alias("status"))


def read_next(file: DataFrame, key: str, after: Column | None = None, records: int = 1) -> DataFrame:
    """READ NEXT: the next records by key behind a position (None: from the first); fewer rows than asked for is status 10."""
    return (file if after is None else file.where(F.col(key) > after)).orderBy(key).limit(records)


def positions(file: DataFrame, key: str) -> DataFrame:
    """Every record with its place in the order of the key, from 1: what an OFFSET cursor counts."""
    return numbered(file, [F.col(key).asc()], "position")


def read_alternate(file: DataFrame, alternate: str, value: Column) -> DataFrame:
    """READ by an alternate key: all records that have it, duplicates too; none is status 23."""
    return file.where(F.col(alternate) == value)


def arrived(rows: DataFrame, arrival: str | None) -> tuple[DataFrame, Column]:
    """Rows with the order in which they came: the named column, or the order in which Spark reads them."""
    return (rows, F.col(arrival)) if arrival else (rows.withColumn("_came", F.monotonically_increasing_id()), F.col("_came"))


def write(file: DataFrame, new: DataFrame, key: str, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """WRITE: the file with what isn't there yet, and every new record's key and status (22: there already, or earlier among the new)."""
    rows, came = arrived(new, arrival)
    firsts = rows.groupBy(key).agg(F.min_by(F.struct(*new.columns), came).alias("_new"), F.min(came).alias("_first"))
    absent = firsts.join(file.select(key), key, "left_anti")
    status = rows.select(key, came.alias("_came")).join(absent.select(key, "_first"), key, "left").select(key, F.when(F.col("_came") == F.col("_first"), OK).otherwise(DUPLICATE).alias("status"))
    return file.unionByName(absent.select("_new.*").select(*file.columns)), status


def rewrite(file: DataFrame, changed: DataFrame, key: str, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """REWRITE: records with the changed ones in place, the last change of a key, and every change's key and status (23: no such record)."""
    rows, came = arrived(changed, arrival)
    put = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in file.columns if c != key]), came).alias("_new"))
    joined = file.join(put, key, "left")
    out = joined.select(*[F.col(c) if c == key else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in file.columns])
    status = changed.select(key).join(file.select(key).withColumn("_old", F.lit(True)), key, "left").select(key, F.when(F.col("_old"), OK).otherwise(MISSING).alias("status"))
    return out, status


def delete(file: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    status = keys.select(key).join(file.select(key).withColumn("_old", F.lit(True)), key, "left").select(key, F.when(F.col("_old"), OK).otherwise(MISSING).alias("status"))
    return file.join(keys.select(key), key, "left_anti"), status
