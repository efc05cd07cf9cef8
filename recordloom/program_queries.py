"""Registered queries of whole programs, files, sorts, reports, embedded SQL and program analytics."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import queries as _others  # noqa: F401  registers its own
from recordloom.functions.intrinsics import intrinsic
from recordloom.functions.semantics import coerce, divide, edited
from recordloom.operators import keyed, ordering, sorting
from recordloom.plans import copying, corpus, exports, middleware, sql_steps
from recordloom.plans.copybook import parse_records
from recordloom.plans.expressions import compute
from recordloom.plans.file_program import FileProgram
from recordloom.plans.procedure import Program
from recordloom.plans.report_writer import parse_reports, report_rows
from recordloom.registry import ORACLES, QUERIES, fields, money, register, table
from recordloom.sources import fixed_width
from recordloom.sources.files import FileControl, RecordFile, parse_file_control
from recordloom.streaming import scan_stream

__all__ = ["ORACLES", "QUERIES"]


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir or the warehouse, which a cluster's executors share; of one machine's session its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="recordloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/recordloom-{uuid.uuid4().hex}"


# layouts and arithmetic

GROUPS = "01 REC.\n 05 T OCCURS 3.\n  10 A PIC X(2).\n  10 B PIC 9(3).\n 05 Z PIC X."


@register("""SELECT p_partkey, i, CASE i WHEN 1 THEN rpad(substr(p_name, 1, 2), 2, ' ') WHEN 2 THEN rpad(substr(p_type, 1, 2), 2, ' ') ELSE 'ZZ' END AS a,
 CASE i WHEN 1 THEN p_size WHEN 2 THEN p_partkey % 1000 ELSE 7 END AS b, '!' AS z FROM part, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS i) s""")
def occurs_group(spark, sf_dir):
    (record,) = parse_records(GROUPS)
    text = F.concat(F.rpad(F.substring("p_name", 1, 2), 2, " "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.rpad(F.substring("p_type", 1, 2), 2, " "), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("ZZ007!"))
    rows = table(spark, sf_dir, "part").select("p_partkey", *fixed_width.decode(text, record))
    return rows.select("p_partkey", "z", F.posexplode("t").alias("i", "e")).select("p_partkey", (F.col("i") + 1).alias("i"), "e.a", F.col("e.b").cast("bigint").alias("b"), "z")


@register("SELECT p_partkey, p_size % 4 AS n, substr('ABCD', 1, CAST(p_size % 4 AS INTEGER)) AS joined FROM part")
def occurs_depending(spark, sf_dir):
    (record,) = parse_records("01 REC.\n 05 N PIC 9.\n 05 V OCCURS 0 TO 4 TIMES DEPENDING ON N PIC X.")
    rows = table(spark, sf_dir, "part").select("p_partkey", *fixed_width.decode(F.concat((F.col("p_size") % 4).cast("string"), F.lit("ABCD")), record))
    return rows.select("p_partkey", F.col("n").cast("int").alias("n"), F.array_join("v", "").alias("joined"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -p_size / 100.0 ELSE p_size / 100.0 END AS packed, CASE WHEN p_partkey % 3 = 0 THEN -p_size ELSE p_size END AS whole FROM part", "packed", "whole")
def packed_and_binary(spark, sf_dir):
    (record,) = parse_records("01 REC.\n 05 PACKED PIC S9(3)V99 COMP-3.\n 05 WHOLE PIC S9(4) COMP.")
    packed = F.concat(F.lpad(F.col("p_size").cast("string"), 5, "0"), F.when(F.col("p_partkey") % 2 == 0, "D").otherwise("C"))
    whole = F.when(F.col("p_partkey") % 3 == 0, 65536 - F.col("p_size")).otherwise(F.col("p_size"))
    raw = F.unhex(F.concat(packed, F.lpad(F.hex(whole.cast("bigint")), 4, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", *fixed_width.decode(raw, record, binary=True))


CUSTOMERS = "01 REC.\n 05 C-CUSTKEY PIC 9(9).\n 05 C-NAME PIC X(20).\n 05 C-ACCTBAL PIC S9(7)V99.\n 05 C-SIGNED PIC S9(5)V99 SIGN TRAILING SEPARATE.\n 05 C-SEGMENT PIC X(12) JUSTIFIED RIGHT."


@register("SELECT c_custkey, rpad(c_name, 20, ' ') AS c_name, CAST(c_acctbal AS DECIMAL(9,2)) AS c_acctbal, CAST(c_acctbal AS DECIMAL(9,2)) AS c_signed, lpad(c_mktsegment, 12, ' ') AS c_segment FROM customer", "c_acctbal", "c_signed")
def fixed_width_round_trip(spark, sf_dir):
    """Records written to lines of text and scanned again."""
    (record,) = parse_records(CUSTOMERS)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", money("c_acctbal").alias("c_acctbal"), money("c_acctbal").alias("c_signed"), F.col("c_mktsegment").alias("c_segment"))
    path = _folder(spark)
    fixed_width.write(rows, path, record)
    return fixed_width.scan(spark, path, record).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@register("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total FROM orders GROUP BY o_orderstatus", "total")
def stream_scan(spark, sf_dir):
    """Record files that arrive in a folder, read as a stream and summed."""
    (record,) = parse_records("01 REC.\n 05 O-ORDERSTATUS PIC X.\n 05 PRICE PIC 9(9)V99.")
    path, name = _folder(spark), f"s{uuid.uuid4().hex}"
    fixed_width.write(table(spark, sf_dir, "orders").select("o_orderstatus", money("o_totalprice").alias("price")), path, record)
    sums = scan_stream(spark, path, record).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    sums.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("o_orderstatus", "n", F.col("total").cast("decimal(25,2)").alias("total"))


@register("""SELECT l_orderkey, l_linenumber, CAST(floor((round(v, 2) % 100) * 100) / 100 AS DECIMAL(5,2)) AS carried, CAST(floor((v % 10) * 1000) / 1000 AS DECIMAL(5,3)) AS cut
 FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(0.0101 AS DECIMAL(5,4)) AS v FROM lineitem)""", "carried", "cut")
def rounded_carry(spark, sf_dir):
    value = money("l_extendedprice") * F.lit(Decimal("0.0101"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", coerce(value, 2, 2, rounded=True).alias("carried"), coerce(value, 1, 3).alias("cut"))


@register("SELECT o_orderkey, CAST((CAST(o_orderkey AS HUGEINT) * 100000000000000 + 50) // 7 AS BIGINT) AS cents FROM orders")
def divide_wide(spark, sf_dir):
    wide = F.col("o_orderkey").cast("decimal(18,1)") * F.lit(Decimal(10**12)) + F.lit(Decimal("0.5"))
    quotient = coerce(divide(wide, F.lit(7), F.lit(0)), 16, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", (quotient * 100).cast("bigint").alias("cents"))


@register("SELECT o_orderkey, ~o_orderkey AS inverted, o_orderkey | 5 AS ored, xor(o_orderkey, 9) AS xored, o_orderkey << 3 AS up, o_orderkey >> 2 AS down FROM orders")
def bit_operators(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    f = fields(df)
    spec = {"inverted": "B-NOT O-ORDERKEY", "ored": "O-ORDERKEY B-OR 5", "xored": "O-ORDERKEY B-XOR 9", "up": "O-ORDERKEY B-SHIFT-L 3", "down": "O-ORDERKEY B-SHIFT-R 2"}
    return df.select("o_orderkey", *[compute(t, f).cast("bigint").alias(k) for k, t in spec.items()])


@register("""SELECT c_custkey, lpad(format('{:,.2f}', abs(c_acctbal)), 9, ' ') || CASE WHEN c_acctbal < 0 THEN '-' ELSE ' ' END AS trailing, lpad('$' || format('{:,.2f}', abs(c_acctbal)), 10, ' ') AS floating,
 lpad(format('{:,.2f}', abs(c_acctbal)), 9, '*') AS stars, lpad(CASE WHEN c_acctbal < 0 THEN '-' ELSE ' ' END || CAST(CAST(floor(abs(CAST(c_acctbal AS DECIMAL(15,2)))) AS INTEGER) AS VARCHAR), 6, ' ') AS signed,
 lpad(CAST(CAST(floor(abs(CAST(c_acctbal AS DECIMAL(15,2)))) AS INTEGER) AS VARCHAR), 5, '0') || CASE WHEN c_acctbal < 0 THEN 'CR' ELSE '  ' END AS credit FROM customer""")
def edited_pictures(spark, sf_dir):
    pictures = {"trailing": "ZZ,ZZ9.99-", "floating": "$$$,$$9.99", "stars": "**,**9.99", "signed": "-----9", "credit": "9(5)CR"}
    return table(spark, sf_dir, "customer").select("c_custkey", *[edited(money("c_acctbal"), p).alias(n) for n, p in pictures.items()])


# files by key

def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("record_key"), F.col("o_orderstatus").alias("record_data"), F.col("o_custkey").alias("owner"))


@register("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS record_key, CASE WHEN o_orderkey % 6 = 0 THEN 'B' WHEN o_orderkey % 3 = 0 THEN 'A' ELSE o_orderstatus END AS record_data FROM orders")
def rewrite_repeated_key(spark, sf_dir):
    """Two changes of some keys: the later one stays, and no record is doubled."""
    file = _orders(spark, sf_dir).drop("owner")
    first = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("record_key"), F.lit("A").alias("record_data"), F.lit(1).alias("came"))
    second = table(spark, sf_dir, "orders").where("o_orderkey % 6 = 0").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("record_key"), F.lit("B").alias("record_data"), F.lit(2).alias("came"))
    return keyed.rewrite(file, first.unionByName(second), "record_key", "came")[0]


@register("SELECT * FROM (VALUES ('=', '23'), ('EQUAL', '00'), ('>', '23'), ('NOT LESS', '00'), ('<', '23'), ('NOT >', '00')) t(relation, status)")
def start_missing_23(spark, sf_dir):
    file = _orders(spark, sf_dir)
    probes = [("=", "x"), ("EQUAL", "000000001"), (">", "999999999"), ("NOT LESS", "000000001"), ("<", "000000000"), ("NOT >", "999999999")]
    parts = [keyed.start_status(file, "record_key", r, F.lit(v)).select(F.lit(r).alias("relation"), "status") for r, v in probes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("""SELECT p_partkey, coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= p_partkey * 9 AND o_orderkey % 5 = 0), -1) AS o_orderkey,
 CASE WHEN p_partkey * 9 <= (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 5 = 0) THEN '00' ELSE '10' END AS status FROM part""")
def start_then_read_next(spark, sf_dir):
    """START KEY NOT LESS and READ NEXT for every probe: the nearest record from there on."""
    file = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", "o_orderstatus")
    probes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 9).alias("from_key"))
    return keyed.start_each(probes, file, "o_orderkey", "from_key").select("p_partkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), "status")


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders")
def read_positions(spark, sf_dir):
    return keyed.positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("position").cast("bigint").alias("position"))


@register("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS record_key, o_custkey AS owner FROM orders WHERE o_custkey = 7")
def read_alternate_key(spark, sf_dir):
    return keyed.read_alternate(_orders(spark, sf_dir), "owner", F.lit(7)).select("record_key", "owner")


@register("SELECT * FROM (VALUES (1, 'read before open', '42'), (2, 'open input of a missing file', '35'), (3, 'open output', '00'), (4, 'write', '00'), (5, 'open twice', '41'), (6, 'close', '00'), (7, 'open input', '00'), (8, 'write to input', '48'), (9, 'read next', '00'), (10, 'read by key', '00'), (11, 'read by a missing key', '23'), (12, 'start', '00'), (13, 'read to the end', '10'), (14, 'close', '00'), (15, 'close twice', '42'), (16, 'open i-o', '00'), (17, 'write a key that is there', '22'), (18, 'delete a missing key', '23'), (19, 'rewrite', '00')) t(step, action, status)")
def file_statuses(spark, sf_dir):
    """One keyed file through all verbs, with the status after each."""
    (record,) = parse_records("01 REC.\n 05 REC-KEY PIC X(9).\n 05 REC-DATA PIC X(25).")
    file = RecordFile(spark, FileControl("F", organization="INDEXED", key="REC-KEY"), record, path=f"{_folder(spark)}/file")
    rows = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 9, "0").alias("rec_key"), F.rpad("n_name", 25, " ").alias("rec_data"))
    steps = [
        ("read before open", lambda: file.read(F.lit("000000001"))), ("open input of a missing file", lambda: file.open("INPUT")), ("open output", lambda: file.open("OUTPUT")), ("write", lambda: file.write(rows)), ("open twice", lambda: file.open("INPUT")), ("close", file.close),
        ("open input", lambda: file.open("INPUT")), ("write to input", lambda: file.write(rows)), ("read next", file.read), ("read by key", lambda: file.read(F.lit("000000003"))), ("read by a missing key", lambda: file.read(F.lit("X"))), ("start", lambda: file.start(">=", F.lit("000000002"))), ("read to the end", file.read_all), ("close", file.close), ("close twice", file.close),
        ("open i-o", lambda: file.open("I-O")), ("write a key that is there", lambda: file.write(rows.limit(1))), ("delete a missing key", lambda: file.delete(spark.createDataFrame([("X",)], "rec_key string"))), ("rewrite", lambda: file.rewrite(rows.limit(2))),
    ]
    out = []
    for i, (name, step) in enumerate(steps, 1):
        step()
        out.append((i, name, file.status))
    return spark.createDataFrame(out, "step int, action string, status string")


SELECTS = """
 SELECT CUSTOMER-FILE ASSIGN TO "CUST.DAT" ORGANIZATION IS LINE SEQUENTIAL FILE STATUS IS WS-CUST.
 SELECT OPTIONAL ACCT-FILE ASSIGN TO DISK ACCTS ORGANIZATION IS INDEXED ACCESS MODE IS DYNAMIC
     RECORD KEY IS ACCT-ID ALTERNATE RECORD KEY IS ACCT-NAME WITH DUPLICATES FILE STATUS WS-ACCT.
 SELECT WORK-FILE ASSIGN TO SORTWK.
"""


@register("""SELECT * FROM (VALUES ('CUSTOMER-FILE', 'CUST.DAT', 'LINE SEQUENTIAL', 'SEQUENTIAL', CAST(NULL AS VARCHAR), '', 'WS-CUST', 'lines', false), ('ACCT-FILE', 'ACCTS', 'INDEXED', 'DYNAMIC', 'ACCT-ID', 'ACCT-NAME', 'WS-ACCT', 'keyed', true),
 ('WORK-FILE', 'SORTWK', 'SEQUENTIAL', 'SEQUENTIAL', NULL, '', NULL, 'lines', false)) t(name, assign, organization, access, key, alternates, status, adapter, optional)""")
def file_control(spark, sf_dir):
    rows = [(c.name, c.assign, c.organization, c.access, c.key, ",".join(c.alternates), c.status, c.adapter, c.optional) for c in parse_file_control(SELECTS)]
    return spark.createDataFrame(rows, "name string, assign string, organization string, access string, key string, alternates string, status string, adapter string, optional boolean")


# programs over files

ORDER_PROGRAM = """
 IDENTIFICATION DIVISION.
 PROGRAM-ID. TOTALS.
 ENVIRONMENT DIVISION.
 INPUT-OUTPUT SECTION.
 FILE-CONTROL.
     SELECT ORDER-FILE ASSIGN TO "ORDERS".
     SELECT BIG-FILE ASSIGN TO "BIG".
 DATA DIVISION.
 FILE SECTION.
 FD ORDER-FILE.
 01 ORDER-REC.
    05 O-ORDERKEY PIC 9(9).
    05 O-STATUS PIC X.
    05 O-PRICE PIC 9(9)V99.
 FD BIG-FILE.
 01 BIG-REC PIC X(30).
 WORKING-STORAGE SECTION.
 01 WS-EOF PIC X VALUE "N".
    88 AT-EOF VALUE "Y".
 01 WS-READ PIC 9(9).
 01 WS-BIG PIC 9(9).
 01 WS-PENDING PIC 9(9).
 01 WS-TOTAL PIC 9(13)V99.
 01 WS-KIND PIC X(4).
 01 WS-SHOWN PIC Z(8)9.99.
 PROCEDURE DIVISION.
 MAIN-LINE.
     OPEN INPUT ORDER-FILE OUTPUT BIG-FILE.
     PERFORM READ-ORDER.
     PERFORM WORK-ORDER UNTIL AT-EOF.
     DISPLAY "READ " WS-READ " BIG " WS-BIG.
     CLOSE ORDER-FILE BIG-FILE.
     STOP RUN.
 READ-ORDER.
     READ ORDER-FILE AT END SET AT-EOF TO TRUE NOT AT END ADD 1 TO WS-READ END-READ.
 WORK-ORDER.
     MOVE "LOW" TO WS-KIND.
     IF O-PRICE > 200000
         MOVE "BIG" TO WS-KIND
         PERFORM BIG-ORDER
     END-IF.
     IF O-STATUS = "P" AND WS-KIND = "LOW" ADD 1 TO WS-PENDING.
     ADD O-PRICE TO WS-TOTAL.
     PERFORM READ-ORDER.
 BIG-ORDER.
     ADD 1 TO WS-BIG.
     MOVE O-PRICE TO WS-SHOWN.
     STRING WS-KIND DELIMITED BY SPACE ":" DELIMITED BY SIZE O-STATUS DELIMITED BY SIZE WS-SHOWN DELIMITED BY SIZE INTO BIG-REC.
     WRITE BIG-REC.
     IF O-STATUS = "P" DISPLAY "PENDING " O-ORDERKEY.
"""


def _order_run(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("decimal(9,0)").alias("o_orderkey"), F.col("o_orderstatus").alias("o_status"), money("o_totalprice").cast("decimal(11,2)").alias("o_price"))
    return FileProgram(ORDER_PROGRAM).run({"ORDER-FILE": rows}, {"ORDER-FILE": "o_orderkey"})


@register("""SELECT 'Y' AS ws_eof, count(*) AS ws_read, count(*) FILTER (price > 200000) AS ws_big, count(*) FILTER (price <= 200000 AND o_orderstatus = 'P') AS ws_pending, CAST(sum(price) AS DECIMAL(25,2)) AS ws_total
 FROM (SELECT *, CAST(o_totalprice AS DECIMAL(15,2)) AS price FROM orders)""", "ws_total")
def file_loop_totals(spark, sf_dir):
    """READ … AT END under PERFORM UNTIL: counters and totals of a whole program."""
    items = _order_run(spark, sf_dir).items
    return items.select("ws_eof", *[F.col(c).cast("bigint").alias(c) for c in ("ws_read", "ws_big", "ws_pending")], "ws_total")


@register("SELECT o_orderkey AS place, 'BIG:' || o_orderstatus || lpad(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), 12, ' ') AS line FROM orders WHERE CAST(o_totalprice AS DECIMAL(15,2)) > 200000")
def file_loop_written(spark, sf_dir):
    return _order_run(spark, sf_dir).written["BIG-FILE"].select(F.col("place").cast("bigint").alias("place"), "line")


@register("""SELECT o_orderkey AS place, 'PENDING ' || o_orderkey AS line FROM orders WHERE CAST(o_totalprice AS DECIMAL(15,2)) > 200000 AND o_orderstatus = 'P'
 UNION ALL SELECT -1, 'READ ' || count(*) || ' BIG ' || count(*) FILTER (CAST(o_totalprice AS DECIMAL(15,2)) > 200000) FROM orders""")
def file_loop_displayed(spark, sf_dir):
    return _order_run(spark, sf_dir).shown.select(F.coalesce(F.col("place").cast("bigint"), F.lit(-1)).alias("place"), "line")


@register("""SELECT p_partkey, CAST(p_size * (p_size + 1) // 2 AS BIGINT) AS total, CAST(least(p_size, 7) AS BIGINT) AS left_at, (SELECT count(*) FROM generate_series(1, 5) a(i), generate_series(1, 5) b(j) WHERE j <= i AND i + j <= p_size) AS pairs FROM part""")
def perform_until(spark, sf_dir):
    """PERFORM UNTIL, VARYING … AFTER and EXIT PERFORM within a record's work."""
    records = parse_records("01 W.\n 05 P-SIZE PIC 9(3).\n 05 I PIC 9(3).\n 05 J PIC 9(3).\n 05 TOTAL PIC 9(6).\n 05 LEFT-AT PIC 9(3).\n 05 PAIRS PIC 9(3).")
    program = Program(
        """
        MAIN.
            PERFORM UNTIL I >= P-SIZE
                ADD 1 TO I
                ADD I TO TOTAL
            END-PERFORM.
            PERFORM VARYING J FROM 1 BY 1 UNTIL J > P-SIZE
                IF J = 8 EXIT PERFORM END-IF
                MOVE J TO LEFT-AT
            END-PERFORM.
            PERFORM COUNT-PAIR VARYING I FROM 1 BY 1 UNTIL I > 5 AFTER J FROM 1 BY 1 UNTIL J > I.
        COUNT-PAIR.
            IF I + J <= P-SIZE ADD 1 TO PAIRS.
        """,
        records,
        passes=60,
    )
    return program.apply(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", *[F.col(c).cast("bigint").alias(c) for c in ("total", "left_at", "pairs")])


@register("""SELECT p_partkey, split_part(p_type, ' ', 1) AS first, split_part(p_type, ' ', 2) AS second, len(string_split(p_type, ' ')) AS n_parts, rpad(split_part(p_type, ' ', 1) || '-' || p_brand, 40, ' ') AS joined,
 length(split_part(p_type, ' ', 1)) + length(p_brand) + 2 AS next_at, length(p_name) - length(replace(p_name, 'a', '')) AS n_a, 'PART ' || p_partkey || ' ' || p_brand AS line FROM part""")
def procedure_strings(spark, sf_dir):
    """UNSTRING, STRING WITH POINTER, INSPECT and DISPLAY within a paragraph, with their counters and pointers."""
    records = parse_records("01 W.\n 05 P-PARTKEY PIC 9(9).\n 05 P-TYPE PIC X(25).\n 05 P-NAME PIC X(60).\n 05 P-BRAND PIC X(10).\n 05 FIRST-PART PIC X(25).\n 05 SECOND-PART PIC X(25).\n 05 N-PARTS PIC 9(2).\n 05 JOINED PIC X(40).\n 05 NEXT-AT PIC 9(2) VALUE 1.\n 05 N-A PIC 9(2).")
    program = Program(
        """
        MAIN.
            UNSTRING P-TYPE DELIMITED BY " " INTO FIRST-PART SECOND-PART JOINED TALLYING IN N-PARTS.
            MOVE SPACES TO JOINED.
            STRING FIRST-PART DELIMITED BY SPACE "-" P-BRAND DELIMITED BY SIZE INTO JOINED WITH POINTER NEXT-AT.
            INSPECT P-NAME TALLYING N-A FOR ALL "a".
            DISPLAY "PART " P-PARTKEY " " P-BRAND.
        """,
        records,
    )
    out = program.apply(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_brand"))
    return out.select("p_partkey", F.rtrim("first_part").alias("first"), F.rtrim("second_part").alias("second"), F.col("n_parts").cast("bigint").alias("n_parts"), "joined", F.col("next_at").cast("bigint").alias("next_at"), F.col("n_a").cast("bigint").alias("n_a"), F.element_at("display", 1).alias("line"))


@register("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) * 2 AS doubled, CASE WHEN c_acctbal < 0 THEN 'STOPPED ' ELSE 'GONE ON ' END AS state FROM customer", "doubled")
def procedure_call_and_stop(spark, sf_dir):
    """CALL … USING a given program, and STOP RUN in a branch."""
    records = parse_records("01 W.\n 05 BAL PIC S9(7)V99.\n 05 DOUBLED PIC S9(7)V99.\n 05 STATE PIC X(8).")
    program = Program("""MAIN.\n CALL "TWICE" USING BAL DOUBLED.\n MOVE "STOPPED" TO STATE.\n IF BAL < 0 STOP RUN END-IF.\n MOVE "GONE ON" TO STATE.""", records, calls={"TWICE": lambda a, b: [a, a * 2]})
    return program.apply(table(spark, sf_dir, "customer").select("c_custkey", money("c_acctbal").cast("decimal(9,2)").alias("bal"))).select("c_custkey", "doubled", "state")


# sort and merge

@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) DESC, came, o_orderkey) AS place FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS came FROM orders)")
def sort_using_giving(spark, sf_dir):
    """SORT with two USING files and a mixed key, given to a file that is written and read again."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("price"))
    files = {"EVEN": df.where("o_orderkey % 2 = 0").orderBy("o_orderkey"), "ODD": df.where("o_orderkey % 2 = 1").orderBy("o_orderkey")}
    out = sorting.run_sort("SORT WORK ON ASCENDING KEY O-ORDERSTATUS DESCENDING KEY PRICE USING EVEN ODD GIVING DONE COPY-OF", files)
    assert set(out) == {"DONE", "COPY-OF"}
    path = sorting.write_sorted({"DONE": out["DONE"]}, _folder(spark), F.col("o_orderkey").cast("string"))["DONE"]
    lines = spark.read.text(path).select(F.col("value").cast("bigint").alias("o_orderkey"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return ordering.numbered(lines, [F.col("file").asc(), F.col("at").asc()], "place").select("o_orderkey", F.col("place").cast("bigint").alias("place"))


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def sort_numeric_offset(spark, sf_dir):
    """Keys by offset in the record's characters: a number with blanks before it."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lpad(F.col("o_custkey").cast("string"), 8, " ")).alias("raw"))
    keys = [(sorting.offset_key(F.col("raw"), 9, 8, numeric=True), True), (sorting.offset_key(F.col("raw"), 0, 9), True)]
    return sorting.placed(df, keys).select("o_orderkey", F.col("place").cast("bigint").alias("place"))


@register("SELECT o_orderkey, price FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS price, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') ORDER BY price DESC, o_orderkey LIMIT 7", "price")
def return_first_n(spark, sf_dir):
    """SORT with an input procedure that releases some records and an output procedure that returns the first seven."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("price"))
    procedures = {"PICK": lambda: sorting.release(df.where("o_orderstatus = 'O'"), df.where("o_orderstatus = 'F'")), "FIRST-SEVEN": lambda returned: returned.first(7)}
    return sorting.run_sort("SORT WORK DESCENDING KEY PRICE ASCENDING KEY O-ORDERKEY INPUT PROCEDURE IS PICK OUTPUT PROCEDURE IS FIRST-SEVEN", {}, procedures=procedures)["FIRST-SEVEN"].select("o_orderkey", "price")


@register("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DECIMAL(25,2)) AS so_far FROM orders", "so_far")
def report_running_sum(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.running(df, [F.col("o_orderkey").asc()], money("o_totalprice"), "so_far").select("o_orderkey", F.col("so_far").cast("decimal(25,2)").alias("so_far"))


REPORT = """
 RD SALES CONTROLS ARE FINAL REGION PAGE LIMIT IS 12 LINES HEADING 1 FIRST DETAIL 3 LAST DETAIL 10 FOOTING 12.
 01 TYPE PAGE HEADING.
    05 LINE 1 COLUMN 1 PIC X(5) VALUE "SALES".
 01 TYPE CONTROL HEADING REGION.
    05 LINE PLUS 1.
       10 COLUMN 1 PIC X(7) VALUE "REGION ".
       10 COLUMN 8 PIC 9 SOURCE REGION.
 01 NATION-LINE TYPE DETAIL.
    05 LINE PLUS 1.
       10 COLUMN 1 GROUP INDICATE PIC 9 SOURCE REGION.
       10 COLUMN 3 PIC X(20) SOURCE NAME.
       10 COLUMN 24 PIC ZZ9 SOURCE AMOUNT.
 01 TYPE CONTROL FOOTING REGION.
    05 LINE PLUS 1 COLUMN 24 PIC ZZ9 SUM AMOUNT.
 01 TYPE CONTROL FOOTING FINAL.
    05 LINE PLUS 1 COLUMN 20 PIC Z(6)9 SUM AMOUNT.
 01 TYPE PAGE FOOTING.
    05 LINE 12 COLUMN 1 PIC Z9 SOURCE PAGE-COUNTER.
"""


@register("""WITH rows AS (SELECT n_regionkey AS region, n_name AS name, n_nationkey AS amount, row_number() OVER (ORDER BY n_regionkey, n_name) AS place FROM nation),
 body AS (
 SELECT min(place) AS place, -99 AS sub, 'CONTROL HEADING' AS kind, 'REGION ' || region AS text, 'REGION ' || region AS plain FROM rows GROUP BY region
 UNION ALL SELECT place, 0, 'DETAIL', rtrim(region || ' ' || rpad(name, 21, ' ') || lpad(CAST(amount AS VARCHAR), 3, ' ')),
  CASE WHEN place = min(place) OVER (PARTITION BY region) THEN rtrim(region || ' ' || rpad(name, 21, ' ') || lpad(CAST(amount AS VARCHAR), 3, ' ')) ELSE '  ' || rpad(name, 21, ' ') || lpad(CAST(amount AS VARCHAR), 3, ' ') END FROM rows
 UNION ALL SELECT max(place), 99, 'CONTROL FOOTING', repeat(' ', 23) || lpad(CAST(sum(amount) AS VARCHAR), 3, ' '), '' FROM rows GROUP BY region
 UNION ALL SELECT max(place) + 1, 1, 'CONTROL FOOTING', repeat(' ', 19) || lpad(CAST(sum(amount) AS VARCHAR), 7, ' '), '' FROM rows),
 placed AS (SELECT *, row_number() OVER (ORDER BY place, sub) - 1 AS k FROM body),
 pages AS (SELECT unnest(generate_series(1, (SELECT max(k) // 8 + 1 FROM placed))) AS page)
 SELECT CAST(k // 8 + 1 AS INTEGER) AS page, CAST(k % 8 + 3 AS INTEGER) AS line, kind, CASE WHEN kind <> 'DETAIL' OR k % 8 = 0 THEN text ELSE plain END AS text FROM placed
 UNION ALL SELECT CAST(page AS INTEGER), 1, 'PAGE HEADING', 'SALES' FROM pages UNION ALL SELECT CAST(page AS INTEGER), 12, 'PAGE FOOTING', lpad(CAST(page AS VARCHAR), 2, ' ') FROM pages""")
def report_rows_of_nations(spark, sf_dir):
    """A whole report: page and control headings, details with GROUP INDICATE, footings with sums, in pages."""
    (spec,) = parse_reports(REPORT)
    df = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("amount"))
    return report_rows(spec, df, ["name"], 80)


# embedded SQL

@register("SELECT CAST(4 AS INTEGER) AS step, 'ROWS' AS what, '3' AS found UNION ALL SELECT 1, 'SQLCODE', '0' UNION ALL SELECT 2, 'NAME', (SELECT n_name FROM nation WHERE n_nationkey = 3) UNION ALL SELECT 3, 'NOT FOUND', '100 NO-ROW' UNION ALL SELECT 5, 'ROLLBACK', '25'")
def sql_select_into(spark, sf_dir):
    """INCLUDE SQLCA, SELECT INTO with and without a row, WHENEVER, a cursor, INSERT and ROLLBACK, in order."""
    base, v = sql_steps.Database(spark, {"NATION": table(spark, sf_dir, "nation")}), {"WS-KEY": 3}
    base.execute("EXEC SQL INCLUDE SQLCA END-EXEC", v)
    base.execute("EXEC SQL WHENEVER NOT FOUND GO TO NO-ROW END-EXEC", v)
    base.execute("EXEC SQL SELECT n_name INTO :WS-NAME FROM NATION WHERE n_nationkey = :WS-KEY END-EXEC", v)
    rows = [(1, "SQLCODE", str(base.sqlca["SQLCODE"])), (2, "NAME", v["WS-NAME"])]
    label = base.execute("EXEC SQL SELECT n_name INTO :WS-NAME FROM NATION WHERE n_nationkey = -1 END-EXEC", v)
    rows.append((3, "NOT FOUND", f"{base.sqlca['SQLCODE']} {label}"))
    base.execute("EXEC SQL DECLARE C1 CURSOR FOR SELECT n_nationkey FROM NATION WHERE n_nationkey < :WS-KEY ORDER BY 1 END-EXEC", v)
    base.execute("EXEC SQL OPEN C1 END-EXEC", v)
    fetched = 0
    while base.execute("EXEC SQL FETCH C1 INTO :WS-N END-EXEC", v) != "NO-ROW":
        fetched += 1
    base.execute("EXEC SQL CLOSE C1 END-EXEC", v)
    rows.append((4, "ROWS", str(fetched)))
    base.execute("EXEC SQL INSERT INTO NATION (n_nationkey, n_name, n_regionkey) VALUES (99, 'NOWHERE', 1) END-EXEC", v)
    base.execute("EXEC SQL ROLLBACK END-EXEC", v)
    rows.append((5, "ROLLBACK", str(base.tables["NATION"].count())))
    return spark.createDataFrame(rows, "step int, what string, found string")


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(c_custkey + 1000 AS INTEGER), c_name, c_nationkey % 5 FROM customer WHERE c_custkey <= 20")
def sql_insert_as_union(spark, sf_dir):
    base = sql_steps.Database(spark, {"NATION": table(spark, sf_dir, "nation"), "CUSTOMER": table(spark, sf_dir, "customer")})
    base.execute("EXEC SQL INSERT INTO NATION (n_nationkey, n_name, n_regionkey) SELECT c_custkey + 1000, c_name, c_nationkey % 5 FROM CUSTOMER c WHERE c.c_custkey <= :WS-TOP END-EXEC", {"WS-TOP": 20})
    base.execute("EXEC SQL COMMIT WORK END-EXEC", {})
    return base.tables["NATION"]


# middleware

@register("""SELECT 'GU' AS call, CAST(2 AS BIGINT) AS o_orderkey, CAST(-1 AS INTEGER) AS l_linenumber, '  ' AS status UNION ALL SELECT 'GNP', 2, (SELECT coalesce(min(l_linenumber), -1) FROM lineitem WHERE l_orderkey = 2), CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = 2) THEN '  ' ELSE 'GE' END
 UNION ALL SELECT 'GN', (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 2), -1, '  ' UNION ALL SELECT 'GU', -1, -1, 'GE'""")
def dli_call_sequence(spark, sf_dir):
    """Calls of a hierarchical database in order, each with its status: a root, its first child, the next root, a missing one."""
    store = middleware.SegmentStore({"ORDER": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "LINE": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")}, {"ORDER": ["o_orderkey"], "LINE": ["o_orderkey", "l_linenumber"]})
    calls = [("GU", "EXEC DLI GU SEGMENT(ORDER) INTO(WS-O) WHERE(O-ORDERKEY = WS-K) END-EXEC"), ("GNP", "EXEC DLI GNP SEGMENT(LINE) INTO(WS-L) END-EXEC"), ("GN", middleware.parse_call("CALL 'CBLTDLI' USING 'GN  ' PCB-MASK WS-O ORDER.")), ("GU", "EXEC DLI GU SEGMENT(ORDER) WHERE(O-ORDERKEY = -5) END-EXEC")]
    out = []
    for name, call in calls:
        row = store.run(call, {"WS-K": 2}).first()
        got = row.asDict() if row is not None else {}
        out.append((name, got.get("o_orderkey", -1), got.get("l_linenumber", -1), store.status))
    return spark.createDataFrame(out, "call string, o_orderkey bigint, l_linenumber int, status string")


SCREEN = """
 01 LOGIN-SCREEN.
    05 BLANK SCREEN.
    05 LINE 1 COLUMN 5 VALUE "LOGIN".
    05 LINE 3 COLUMN 1 VALUE "NAME:".
    05 COLUMN 7 PIC X(25) USING N-NAME.
"""


@register("SELECT n_nationkey, 1 AS line, '    LOGIN' AS text FROM nation UNION ALL SELECT n_nationkey, 2, '' FROM nation UNION ALL SELECT n_nationkey, 3, 'NAME: ' || n_name FROM nation")
def screen_display(spark, sf_dir):
    lines = middleware.screen_text(middleware.parse_screen(SCREEN), {"N-NAME": F.col("n_name")})
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*lines)).alias("line", "text")).select("n_nationkey", (F.col("line") + 1).alias("line"), "text")


# program text

def _sources(spark, sf_dir) -> DataFrame:
    """A program text for every nation."""
    name = F.concat(F.lit("P"), F.col("n_nationkey").cast("string"))
    text = F.concat(F.lit("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. "), name, F.lit(".\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       COPY BOOK"), (F.col("n_regionkey")).cast("string"), F.lit(" REPLACING ==:T:== BY =="), name, F.lit("== A BY B.\n       PROCEDURE DIVISION.\n       FIRST-PAR.\n      * A NOTE: MOVE NOTHING.\n           MOVE A TO A-BALANCE. ADD 1 TO N.\n           CALL 'SUB"), F.col("n_regionkey").cast("string"), F.lit("'.\n           GO TO LAST-PAR.\n       LOST-PAR.\n           EXEC SQL COMMIT END-EXEC.\n           DISPLAY 'LOST'.\n       LAST-PAR.\n           STOP RUN.\n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", name.alias("program"), F.concat(F.lit("src/"), name, F.lit(".cob")).alias("path"), text.alias("text"))


@register("SELECT 'P' || n_nationkey AS program, '       01 ' || 'P' || n_nationkey || '-REC.' AS first, '          05 B PIC 9. 05 A-BALANCE PIC 9.' AS second FROM nation")
def copy_replacing(spark, sf_dir):
    """COPY with REPLACING by text-words: pseudo-text within a name, and a word that is a part of other words."""
    books = spark.range(5).select(F.concat(F.lit("lib/BOOK"), F.col("id").cast("string"), F.lit(".cpy")).alias("path"), F.lit("       01 :T:-REC.\n          05 A PIC 9. 05 A-BALANCE PIC 9.\n").alias("text"))
    sources = _sources(spark, sf_dir)
    lines = F.split("text", "\n")
    return copying.expand_files(sources.select("path", "text"), books).select(F.regexp_extract("path", "src/(.*)\\.cob", 1).alias("program"), F.element_at(lines, 5).alias("first"), F.element_at(lines, 6).alias("second"))


@register("""SELECT program, verb, n FROM (SELECT 'P' || n_nationkey AS program FROM nation), (VALUES ('MOVE', CAST(1 AS BIGINT)), ('ADD', 1), ('CALL', 1), ('GO', 1), ('EXEC', 1), ('DISPLAY', 1), ('STOP', 1)) v(verb, n)""")
def source_verbs(spark, sf_dir):
    """Source texts parsed to statements: how often each verb stands in each program."""
    facts = corpus.facts_of(_sources(spark, sf_dir))
    return corpus.verb_counts(facts).select("program", "verb", F.col("count").alias("n"))


@register("SELECT 'P' || n_nationkey AS program, w AS warning FROM nation, (VALUES ('GO TO in FIRST-PAR'), ('Unreachable paragraph: LOST-PAR')) v(w) UNION ALL SELECT 'P' || n_nationkey, 'Missing copybook: book' || n_regionkey FROM nation WHERE n_regionkey > 2")
def source_warnings(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    there = spark.range(3).select(F.concat(F.lit("book"), F.col("id").cast("string")).alias("book"))
    missing = copying.references(sources, "program").join(there, "book", "left_anti")
    return corpus.warnings(corpus.facts_of(sources), missing=missing)


@register("SELECT 'P' || n_nationkey AS program, true AS db2, false AS cics, false AS dli, false AS mq FROM nation")
def source_middleware(spark, sf_dir):
    return corpus.middleware(corpus.facts_of(_sources(spark, sf_dir)))


@register("SELECT 'P' || n_nationkey AS program, CAST(3 AS BIGINT) AS paragraphs, CAST(7 AS BIGINT) AS statements, 'SUB' || n_regionkey AS callee, CAST(2 AS BIGINT) AS n_warnings FROM nation")
def source_map_json(spark, sf_dir):
    """The map of each program as JSON, read back."""
    facts = corpus.facts_of(_sources(spark, sf_dir))
    items = facts.select("program", F.lit("CUST-SSN").alias("name")).distinct().where("false")
    read = F.from_json("json", "program_id string, statistics struct<paragraphs: bigint, statements: bigint>, dependencies array<struct<call_target: string>>, warnings array<string>")
    return exports.to_json(exports.software_map(facts, items)).select(read.alias("j")).select(F.col("j.program_id").alias("program"), "j.statistics.paragraphs", "j.statistics.statements", F.element_at("j.dependencies", 1)["call_target"].alias("callee"), F.size("j.warnings").cast("bigint").alias("n_warnings"))


@register("SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'CICS/SQL' WHEN 1 THEN 'Other' WHEN 2 THEN 'Other' WHEN 3 THEN 'File I/O' WHEN 4 THEN 'File I/O' WHEN 5 THEN 'Control Flow' WHEN 6 THEN 'String Operations' WHEN 7 THEN 'Other' WHEN 8 THEN 'Arithmetic' ELSE 'Other' END AS category FROM part")
def corpus_review(spark, sf_dir):
    notes = ("EXEC SQL fetch", "send map", "pcb mask", "open failed", "call target", "go to exit", "unstring parts", "redefines base", "multiply twice", "nothing known")
    return corpus.review(table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, notes)), (F.col("p_partkey") % 10 + 1).cast("int")).alias("text"))).select("p_partkey", "category")


@register("SELECT CAST(o_custkey AS VARCHAR) AS program, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) AS rank FROM orders GROUP BY o_custkey")
def corpus_ranked(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("program")).agg(F.count("*").alias("n"))
    return corpus.ranked_programs(counted).select("program", "n", F.col("rank").cast("bigint").alias("rank"))


@register("SELECT 'R' || n_regionkey AS program, count(*) FILTER (n_nationkey < 3) AS added, count(*) FILTER (n_nationkey > 20) AS removed, count(*) FILTER (n_nationkey BETWEEN 3 AND 20 AND n_nationkey % 4 = 1) AS modified, count(*) FILTER (n_nationkey BETWEEN 3 AND 20 AND n_nationkey % 4 <> 1) AS unchanged, count(*) FILTER (n_nationkey < 3 OR n_nationkey > 20) > 0 OR n_regionkey = 2 AS structural FROM nation GROUP BY n_regionkey")
def corpus_change_summary(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("program"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("paragraph"), F.lit(1).alias("stmt_no"), F.lit("MOVE").alias("verb"), F.col("n_name").alias("text"), "n_nationkey")
    new = base.withColumn("text", F.when(F.col("n_nationkey") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    found = corpus.changes(corpus.fingerprints(base.where("n_nationkey >= 3")), corpus.fingerprints(new.where("n_nationkey <= 20")))
    items = base.select("program", F.lit(1).alias("item_no"), F.lit("X").alias("name"), F.lit("9").alias("picture")).distinct()
    other = items.withColumn("picture", F.when(F.col("program") == "R2", "X").otherwise(F.col("picture")))
    return corpus.change_summary(found, corpus.digests(items), corpus.digests(other))


# intrinsics that have no row elsewhere

@register("""SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, CAST(p_size AS BIGINT) AS whole, -CAST(p_size AS BIGINT) AS cut, ascii(p_name) AS code, chr(CAST(64 + p_size % 26 AS INTEGER)) AS letter, round(tan(p_size / 100.0), 6) AS tangent, round(acos(p_size / 100.0), 6) AS arc,
 CAST(factorial(CAST(p_size % 15 AS INTEGER)) AS DOUBLE) AS product, p_size + 5 - least(p_size, 3) AS span, round(list_aggregate([CAST(p_size AS DOUBLE), 3.0, 8.0], 'var_samp'), 6) AS variance, p_brand || '/' || p_size AS joined, round(pi(), 6) AS pi, round(exp(1), 6) AS e FROM part""")
def intrinsic_rest(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    size, name = F.col("p_size"), F.col("p_name")
    return df.select(
        "p_partkey", intrinsic("TRIM", F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), intrinsic("INTEGER", size + 0.5).alias("whole"), intrinsic("INTEGER-PART", -(size + 0.5)).alias("cut"), intrinsic("ORD", name).cast("int").alias("code"), intrinsic("CHAR", 64 + size % 26).alias("letter"), F.round(intrinsic("TAN", size / 100), 6).alias("tangent"), F.round(intrinsic("ACOS", size / 100), 6).alias("arc"),
        intrinsic("FACTORIAL", size % 15).cast("double").alias("product"), intrinsic("RANGE", size, F.lit(3), size + 5).alias("span"), F.round(intrinsic("VARIANCE", size, F.lit(3), F.lit(8)), 6).alias("variance"), intrinsic("CONCATENATE", F.col("p_brand"), F.lit("/"), size).alias("joined"), F.round(intrinsic("PI"), 6).alias("pi"), F.round(intrinsic("E"), 6).alias("e"),
    )


@register("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS back, date_diff('day', DATE '1601-01-01', CAST(o_orderdate AS DATE)) + 1 AS of_day, CAST(CASE WHEN year(o_orderdate) % 100 <= 50 THEN 2000 + year(o_orderdate) % 100 ELSE 1900 + year(o_orderdate) % 100 END * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS widened,
 CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS fails, list_max(list_transform(string_split(o_orderpriority, ''), lambda c: ascii(c))) AS most, list_min(list_transform(string_split(o_orderpriority, ''), lambda c: ascii(c))) AS least, 16 AS stamp, true AS chance FROM orders""")
def intrinsic_dates_and_codes(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    when, serial = F.col("o_orderdate"), intrinsic("INTEGER-OF-DATE", F.date_format("o_orderdate", "yyyyMMdd"))
    short = F.date_format(when, "yyMMdd").cast("int")
    amount = F.when(F.col("o_orderkey") % 2 == 0, " $1,234.50").otherwise("12-X")
    chance = intrinsic("RANDOM")
    return df.select(
        "o_orderkey", intrinsic("DATE-OF-INTEGER", serial).alias("back"), intrinsic("INTEGER-OF-DAY", F.date_format(when, "yyyyDDD")).cast("bigint").alias("of_day"), intrinsic("DATE-TO-YYYYMMDD", short).cast("bigint").alias("widened"), intrinsic("TEST-NUMVAL-C", amount).alias("fails"),
        intrinsic("ORD-MAX", F.col("o_orderpriority")).cast("int").alias("most"), intrinsic("ORD-MIN", F.col("o_orderpriority")).cast("int").alias("least"), F.length(F.substring(intrinsic("CURRENT-DATE"), 1, 16)).alias("stamp"), ((chance >= 0) & (F.length(intrinsic("WHEN-COMPILED")) >= 16)).alias("chance"),
    )
