"""The registered queries of the record engine and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import documents, intrinsics, semantics, strings
from recordloom.functions.semantics import coerce, pad
from recordloom.operators import keyed, loops, moves, reports, segments, sorting, tables
from recordloom.plans import corpus, sql_steps
from recordloom.plans.copybook import parse_records
from recordloom.plans.expressions import also, compute, condition, condition_name, evaluate
from recordloom.plans.procedure import Program
from recordloom.registry import fields, money, register, table
from recordloom.sources import fixed_width

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the record engine, those of whole programs and files too."""
    from recordloom import program_queries

    return dict(program_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    from recordloom import program_queries

    return dict(program_queries.ORACLES)


@register("""
SELECT c_mktsegment AS segment,
       count(*) AS n_orders,
       CAST(sum(CASE WHEN bal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
       CAST(sum(CASE WHEN bal >= 0 AND price > bal * 20 THEN 1 ELSE 0 END) AS BIGINT) AS n_over,
       CAST(sum(CASE WHEN bal >= 0 AND price <= bal * 20 THEN 1 ELSE 0 END) AS BIGINT) AS n_normal,
       CAST(sum(price) AS DECIMAL(25,2)) AS total_price,
       CASE WHEN grouping(c_mktsegment) = 1 THEN 0 ELSE 1 END AS break_level
FROM (SELECT c_mktsegment, CAST(c_acctbal AS DECIMAL(15,2)) AS bal, CAST(o_totalprice AS DECIMAL(15,2)) AS price
      FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY ROLLUP (c_mktsegment)""", "total_price")
def customer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", money("o_totalprice").alias("price"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), money("c_acctbal").alias("bal"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    names = {"BALANCE": F.col("bal"), "AMOUNT": F.col("price")}
    kind = evaluate([(condition("BALANCE IS NEGATIVE", names), F.lit("N")), (condition("AMOUNT > BALANCE * 20", names), F.lit("O"))], F.lit("R"))
    coded = rows.select("segment", "price", *[(kind == k).cast("bigint").alias(n) for n, k in (("is_n", "N"), ("is_o", "O"), ("is_r", "R"))])
    out = reports.footings(coded, reports.Report(["segment"], {"n_negative": "is_n", "n_over": "is_o", "n_normal": "is_r", "total_price": "price"}))
    return out.select("segment", F.col("n_details").alias("n_orders"), "n_negative", "n_over", "n_normal", "total_price", "break_level")


@register("SELECT o_orderkey, CAST(floor((CAST(o_totalprice AS DECIMAL(15,2)) % 10000) * 10) / 10 AS DECIMAL(6,1)) AS moved FROM orders", "moved")
def move_truncate(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce(money("o_totalprice"), 4, 1).alias("moved"))


@register("SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2)), 2) AS DECIMAL(12,2)) AS amount FROM lineitem", "amount")
def compute_rounded(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", coerce(compute("L-EXTENDEDPRICE * L-DISCOUNT", fields(df, "l_extendedprice", "l_discount")), 9, 2, rounded=True).alias("amount"))


@register("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_cents FROM lineitem")
def divide_truncate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    unit = coerce(semantics.divide(money("l_extendedprice"), F.col("l_quantity"), F.lit(0)), 9, 2)
    return df.select("l_orderkey", "l_linenumber", (unit * 100).cast("bigint").alias("unit_cents"))


@register("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) // (o_custkey + 1) AS quotient, CAST(floor(o_totalprice) AS BIGINT) % (o_custkey + 1) AS remainder FROM orders")
def divide_remainder(spark, sf_dir):
    whole = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(floor(o_totalprice) as bigint) div (o_custkey + 1)").alias("quotient"), intrinsics.intrinsic("REM", whole, F.col("o_custkey") + 1).alias("remainder"))


@register("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) + CAST(l_tax AS DECIMAL(15,2)) + CAST(l_quantity AS DECIMAL(15,2)) AS DECIMAL(12,2)) AS added,
 CAST(CAST(l_extendedprice AS DECIMAL(15,2)) - CAST(l_quantity AS DECIMAL(15,2)) AS DECIMAL(12,2)) AS subtracted,
 CAST(floor(CAST(l_quantity AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(15,2)) * 100) / 100 AS DECIMAL(12,2)) AS multiplied FROM lineitem""", "added", "subtracted", "multiplied")
def arithmetic_giving(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    f = fields(df, "l_extendedprice", "l_tax", "l_quantity")
    return df.select("l_orderkey", "l_linenumber", coerce(compute("L-EXTENDEDPRICE + L-TAX + L-QUANTITY", f), 9, 2, signed=True).alias("added"), coerce(compute("L-EXTENDEDPRICE - L-QUANTITY", f), 9, 2, signed=True).alias("subtracted"), coerce(compute("L-QUANTITY * L-TAX", f), 9, 2).alias("multiplied"))


@register("SELECT o_orderkey, abs(CAST(o_totalprice AS DECIMAL(15,2))) >= 100000 AS overflow FROM orders")
def size_error_flag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", semantics.size_error(money("o_totalprice"), 5).alias("overflow"))


@register("SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_linenumber + l_linenumber AS b FROM lineitem")
def corresponding_add(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_partkey").alias("A"), F.col("l_linenumber").alias("B"), F.lit(1).alias("C")).alias("g1"), F.struct(F.col("l_suppkey").alias("A"), F.col("l_linenumber").alias("B")).alias("g2"))
    return moves.add_corresponding(df, "g1", "g2").select("l_orderkey", "l_linenumber", F.col("g2.A").alias("a"), F.col("g2.B").alias("b"))


@register("SELECT o_orderkey FROM orders WHERE (CAST(o_totalprice AS DECIMAL(15,2)) > 100000 AND o_orderstatus = 'O') OR NOT (o_custkey >= 100)")
def filter_compound(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.where(condition("(O-TOTALPRICE > 100000 AND O-ORDERSTATUS = 'O') OR NOT O-CUSTKEY IS GREATER THAN OR EQUAL TO 100", fields(df, "o_totalprice"))).select("o_orderkey")


@register("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 30 OR p_size = 45 OR p_size = 50")
def filter_abbreviated(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.where(condition("P-SIZE > 10 AND < 30 OR P-SIZE = 45 OR 50", fields(df))).select("p_partkey")


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND (CAST(o_totalprice AS DECIMAL(15,2)) BETWEEN 1000 AND 50000 OR CAST(o_totalprice AS DECIMAL(15,2)) BETWEEN 200000 AND 300000)")
def filter_88(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    names = {"CLOSED": condition_name(F.col("o_orderstatus"), [("F", None), ("P", None)]), "NOTABLE": condition_name(money("o_totalprice"), [(1000, 50000), (200000, 300000)], numeric=True)}
    return df.where(condition("CLOSED AND NOTABLE", fields(df), names)).select("o_orderkey")


@register("SELECT c_custkey, regexp_matches(substr(c_name, 10), '^[0-9]+$') AS is_num, c_acctbal > 0 AS pos, c_acctbal < 0 AS neg, regexp_matches(c_mktsegment, '^[A-Za-z ]+$') AS alpha FROM customer")
def class_and_sign(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    f = fields(df, "c_acctbal")
    return df.select("c_custkey", condition("C-NAME(10:) IS NUMERIC", f).alias("is_num"), condition("C-ACCTBAL IS POSITIVE", f).alias("pos"), condition("C-ACCTBAL NEGATIVE", f).alias("neg"), condition("C-MKTSEGMENT IS ALPHABETIC", f).alias("alpha"))


@register("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'A' WHEN o_totalprice > 100000 OR o_orderstatus = 'P' THEN 'B' ELSE 'C' END AS grade FROM orders")
def evaluate_true(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    f = fields(df, "o_totalprice")
    return df.select("o_orderkey", evaluate([(condition("O-TOTALPRICE > 200000", f), F.lit("A")), (condition("O-TOTALPRICE > 100000 OR O-ORDERSTATUS = 'P'", f), F.lit("B"))], F.lit("C")).alias("grade"))


@register("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'S' WHEN p_size BETWEEN 11 AND 30 THEN 'M' ELSE 'L' END AS class FROM part")
def evaluate_thru(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", evaluate([(also((size, (1, 10))), F.lit("S")), (also((size, (11, 30))), F.lit("M"))], F.lit("L")).alias("class"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag IN ('A', 'N') AND l_linestatus = 'F' THEN 2 WHEN l_linenumber BETWEEN 1 AND 2 THEN 3 ELSE 0 END AS code FROM lineitem")
def evaluate_also(spark, sf_dir):
    flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    cases = [(also((flag, "R"), (status, None)), F.lit(1)), (also((flag, ["A", "N"]), (status, "F")), F.lit(2)), (also((flag, None), (number, (1, 2))), F.lit(3))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evaluate(cases, F.lit(0)).alias("code"))


@register("SELECT n_nationkey, rpad(n_name, 12, ' ') || rpad(CAST(n_regionkey AS VARCHAR), 3, ' ') AS grp, substr(rpad(n_name, 12, ' ') || rpad(CAST(n_regionkey AS VARCHAR), 3, ' '), 1, 5) AS head, substr(rpad(n_name, 12, ' ') || rpad(CAST(n_regionkey AS VARCHAR), 3, ' '), 6, 10) AS tail FROM nation")
def group_move(spark, sf_dir):
    grp = moves.group([(F.col("n_name"), 12), (F.col("n_regionkey"), 3)])
    head, tail = moves.spread(grp, [5, 10])
    return table(spark, sf_dir, "nation").select("n_nationkey", grp.alias("grp"), head.alias("head"), tail.alias("tail"))


@register("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year, CAST(strftime(o_orderdate, '%m') AS INTEGER) AS month, CAST(strftime(o_orderdate, '%d') AS INTEGER) AS day FROM orders")
def redefines_slice(spark, sf_dir):
    (record,) = parse_records("01 REC.\n 05 WHOLE PIC 9(8).\n 05 PARTS REDEFINES WHOLE.\n  10 YEAR PIC 9(4).\n  10 MONTH PIC 99.\n  10 DAY PIC 99.")
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("whole"))
    lines = raw.select("o_orderkey", fixed_width.encode(record).alias("line"))
    return lines.select("o_orderkey", *fixed_width.decode(F.col("line"), record)).select("o_orderkey", *[F.col(c).cast("int").alias(c) for c in ("year", "month", "day")])


@register("SELECT p_partkey, 7 AS p_size, 'N/A' AS p_brand, p_type FROM part")
def initialize_replacing(spark, sf_dir):
    return moves.initialize(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type"), 7, "N/A", ["p_size", "p_brand"])


@register("SELECT n_nationkey, 'ABABA' AS filled, substr(n_name, 1, 3) AS first3, length(n_name) AS len FROM nation")
def move_all_refmod(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    f = fields(df)
    return df.select("n_nationkey", moves.move_all("AB", 5).alias("filled"), compute("N-NAME(1:3)", f).alias("first3"), compute("LENGTH OF N-NAME", f).cast("bigint").alias("len"))


@register("SELECT vec_id, len(embedding) AS size, CAST(embedding[2] AS DOUBLE) AS second, coalesce(list_position(list_transform(embedding, lambda x: x > 0), true), 0) AS first_positive FROM embeddings")
def table_search(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("bigint").alias("size"), F.element_at(e, 2).cast("double").alias("second"), tables.search(e, lambda x: x > 0).alias("first_positive"))


@register("SELECT c_custkey, n_name, n_name IS NOT NULL AS found FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def search_all(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    probes = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return tables.search_all(probes, nation, "n_nationkey").select("c_custkey", "n_name", "found")


def _file(spark, sf_dir, where: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(where).select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("record_key"), F.col("o_orderstatus").alias("record_data"))


@register("SELECT lpad(CAST(a.o_orderkey AS VARCHAR), 9, '0') AS record_key, CASE WHEN a.o_orderkey % 2 = 0 THEN a.o_orderstatus END AS record_data, CASE WHEN a.o_orderkey % 2 = 0 THEN '00' ELSE '23' END AS status FROM orders a")
def read_random_key(spark, sf_dir):
    probes = _file(spark, sf_dir, "true").select("record_key")
    return keyed.read_keys(probes, _file(spark, sf_dir, "o_orderkey % 2 = 0"), "record_key")


@register("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS record_key, o_orderstatus AS record_data FROM orders WHERE lpad(CAST(o_orderkey AS VARCHAR), 9, '0') >= '000000500'")
def start_not_less(spark, sf_dir):
    return keyed.start(_file(spark, sf_dir, "true"), "record_key", ">=", F.lit("000000500"))


@register("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS record_key, o_orderstatus AS record_data FROM orders WHERE lpad(CAST(o_orderkey AS VARCHAR), 9, '0') >= (SELECT max(lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) FROM orders WHERE lpad(CAST(o_orderkey AS VARCHAR), 9, '0') < '000000500')")
def start_less(spark, sf_dir):
    return keyed.start(_file(spark, sf_dir, "true"), "record_key", "<", F.lit("000000500"))


@register("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS record_key, CASE WHEN o_orderkey % 3 = 0 THEN '22' ELSE '00' END AS status FROM orders")
def write_duplicate_22(spark, sf_dir):
    return keyed.write(_file(spark, sf_dir, "o_orderkey % 3 = 0"), _file(spark, sf_dir, "true"), "record_key")[1]


@register("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS record_key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS record_data FROM orders")
def rewrite_upsert(spark, sf_dir):
    changed = _file(spark, sf_dir, "o_orderkey % 5 = 0").withColumn("record_data", F.lit("X"))
    return keyed.rewrite(_file(spark, sf_dir, "true"), changed, "record_key")[0]


@register("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS record_key, o_orderstatus AS record_data FROM orders WHERE o_orderkey % 4 <> 0")
def delete_keyed(spark, sf_dir):
    return keyed.delete(_file(spark, sf_dir, "true"), _file(spark, sf_dir, "o_orderkey % 4 = 0"), "record_key")[0]


def _places(df: DataFrame, key: str, keys: list, alphabet: str | None = None, order: str | None = None) -> DataFrame:
    """Every row's key and its place in the sorted whole."""
    return sorting.placed(df, keys, alphabet, order or key).select(key, F.col("place").cast("bigint").alias("place"))


@register("SELECT p_partkey, row_number() OVER (ORDER BY p_size ASC, p_type DESC, p_partkey) AS place FROM part")
def sort_asc_desc(spark, sf_dir):
    return _places(table(spark, sf_dir, "part"), "p_partkey", [(F.col("p_size"), True), (F.col("p_type"), False)])


@register("SELECT n_nationkey, row_number() OVER (ORDER BY translate(n_name, 'ZYXWVUTSRQPONMLKJIHGFEDCBA', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), n_nationkey) AS place FROM nation")
def sort_custom_alphabet(spark, sf_dir):
    return _places(table(spark, sf_dir, "nation"), "n_nationkey", [(F.col("n_name"), True)], "ZYXWVUTSRQPONMLKJIHGFEDCBA")


#: The order of blank, hyphen, number sign, lower case, upper case and digits in EBCDIC, and marks that ascend in ASCII.
_IN_ORDER = " -#abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_MARKS = "".join(chr(256 + i) for i in range(len(_IN_ORDER)))
_MIXED = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) || ' ' || c_custkey WHEN 2 THEN upper(c_name) ELSE c_custkey || '-' || c_mktsegment END"


@register(f"SELECT c_custkey, row_number() OVER (ORDER BY translate({_MIXED}, '{_IN_ORDER}', '{_MARKS}'), c_custkey) AS place FROM customer")
def sort_ebcdic(spark, sf_dir):
    return _places(table(spark, sf_dir, "customer").withColumn("mixed", F.expr(_MIXED)), "c_custkey", [(F.col("mixed"), True)], "EBCDIC")


@register("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS price FROM orders ORDER BY CAST(o_totalprice AS DECIMAL(15,2)) DESC, o_orderkey LIMIT 10", "price")
def sort_topk(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("price"))
    return sorting.sort(df, [(F.col("price"), False)], ordinal="o_orderkey").limit(10)


@register("SELECT key, source, row_number() OVER (ORDER BY bal DESC, source, key) AS place FROM (SELECT c_custkey AS key, CAST(c_acctbal AS DECIMAL(15,2)) AS bal, 0 AS source FROM customer UNION ALL SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(15,2)), 1 FROM supplier)")
def merge_two_files(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), money("c_acctbal").alias("bal"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), money("s_acctbal").alias("bal"))
    merged = sorting.placed(sorting.gathered([a, b]).withColumn("_both", F.struct("_input", "key")), [(F.col("bal"), False)], ordinal="_both")
    return merged.select("key", F.col("_input").alias("source"), F.col("place").cast("bigint").alias("place"))


@register("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total, count(*) AS n_details,
 CASE WHEN grouping(l_returnflag) = 1 THEN 0 WHEN grouping(l_linestatus) = 1 THEN 1 ELSE 2 END AS break_level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""", "total")
def report_control_break(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", money("l_extendedprice").alias("price"))
    return reports.footings(df, reports.Report(["l_returnflag", "l_linestatus"], {"total": "price"}))


@register("""SELECT o_orderkey, o_custkey, CASE WHEN rn = 1 OR before IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END AS break_control, CAST((rn - 1) // 5 + 1 AS INTEGER) AS page, CAST((rn - 1) % 5 + 1 AS INTEGER) AS line
 FROM (SELECT *, row_number() OVER w AS rn, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""")
def report_pages(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return reports.breaks(df, reports.Report(["o_orderstatus"], {}, page=5), ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey", "break_control", "page", "line")


@register("SELECT n_nationkey, rtrim(rpad(CAST(n_nationkey AS VARCHAR), 4, ' ') || rpad(n_name, 20, ' ') || CAST(n_regionkey AS VARCHAR)) AS line FROM nation")
def report_line(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", reports.line([(1, F.col("n_nationkey").cast("string")), (5, pad(F.col("n_name"), 20)), (25, F.col("n_regionkey").cast("string"))], 40).alias("line"))


@register("""SELECT o_orderkey, CAST(date_diff('day', DATE '1601-01-01', CAST(o_orderdate AS DATE)) + 1 AS INTEGER) AS serial, strftime(o_orderdate, '%Y%j') AS julian,
 upper(o_orderpriority) AS up, lower(o_orderpriority) AS low, reverse(o_orderpriority) AS back, length(o_orderpriority) AS len, o_orderkey % 7 AS rem7,
 greatest(o_orderkey, o_custkey) AS hi, least(o_orderkey, o_custkey) AS lo, (o_orderkey + o_custkey + 3) AS total, o_orderkey & 12 AS bits FROM orders""")
def intrinsic_functions(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("ymd", F.date_format("o_orderdate", "yyyyMMdd"))
    f = fields(df)
    serial = compute("FUNCTION INTEGER-OF-DATE(YMD)", f)
    texts = {"up": "UPPER-CASE", "low": "LOWER-CASE", "back": "REVERSE"}
    return df.select("o_orderkey", serial.alias("serial"), intrinsics.intrinsic("DAY-OF-INTEGER", serial).alias("julian"), *[compute(f"FUNCTION {n}(O-ORDERPRIORITY)", f).alias(k) for k, n in texts.items()], compute("FUNCTION LENGTH(O-ORDERPRIORITY)", f).cast("bigint").alias("len"), compute("FUNCTION MOD(O-ORDERKEY 7)", f).alias("rem7"), compute("FUNCTION MAX(O-ORDERKEY, O-CUSTKEY)", f).alias("hi"), compute("FUNCTION MIN(O-ORDERKEY, O-CUSTKEY)", f).alias("lo"), compute("FUNCTION SUM(O-ORDERKEY, O-CUSTKEY, 3)", f).alias("total"), compute("O-ORDERKEY B-AND 12", f).alias("bits"))


@register("""SELECT p_partkey, round(sqrt(CAST(p_size AS DOUBLE)), 6) AS root, round(ln(p_size + 1.0), 6) AS log, round((p_size + 3 + 8) / 3.0, 6) AS mean,
 round(list_aggregate([CAST(p_size AS DOUBLE), 3.0, 8.0], 'median'), 6) AS median, round(sqrt(list_aggregate([CAST(p_size AS DOUBLE), 3.0, 8.0], 'var_samp')), 6) AS dev FROM part""")
def intrinsic_statistics(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    f = fields(df)
    spec = {"root": "SQRT(P-SIZE)", "log": "LOG(P-SIZE + 1)", "mean": "MEAN(P-SIZE 3 8)", "median": "MEDIAN(P-SIZE 3 8)", "dev": "STANDARD-DEVIATION(P-SIZE 3 8)"}
    return df.select("p_partkey", *[F.round(compute(f"FUNCTION {t}", f), 6).alias(k) for k, t in spec.items()])


@register("SELECT p_partkey, rpad(split_part(p_type, ' ', 1) || '/' || p_brand, 30, ' ') AS joined FROM part")
def string_delimited(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.string([(F.col("p_type"), " "), (F.lit("/"), None), (F.col("p_brand"), None)], 30).alias("joined"))


@register("SELECT c_custkey, rpad(split_part(c_name, '#', 1), 12, ' ') AS part1, rpad(split_part(c_name, '#', 2), 12, ' ') AS part2, len(string_split(c_name, '#')) AS n_parts FROM customer")
def unstring_fields(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.unstring(name, ["#"], 1, 12).alias("part1"), strings.unstring(name, ["#"], 2, 12).alias("part2"), F.size(strings.parts(name, ["#"])).cast("bigint").alias("n_parts"))


@register("""SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INTEGER) AS n_e, replace(p_name, 'a', 'X') AS replaced, regexp_replace(p_name, 'a', 'X') AS first_only,
 translate(p_name, 'abc', 'xyz') AS converted, CASE WHEN position(' ' IN p_name) > 0 THEN substr(p_name, 1, position(' ' IN p_name) - 1) ELSE p_name END AS head FROM part""")
def inspect_verbs(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", strings.tally_all(n, "e").alias("n_e"), strings.replace_all(n, "a", "X").alias("replaced"), strings.replace_first(n, "a", "X").alias("first_only"), strings.converting(n, "abc", "xyz").alias("converted"), strings.region(n, before=" ")[1].alias("head"))


@register("SELECT n_nationkey, '{\"N_NAME\":\"' || n_name || '\",\"N_REGIONKEY\":\"' || CAST(n_regionkey AS VARCHAR) || '\"}' AS json FROM nation")
def json_generate(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", documents.json_generate({"N_NAME": F.col("n_name"), "N_REGIONKEY": F.col("n_regionkey")}).alias("json"))


@register("SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total FROM orders WHERE o_custkey > 50 GROUP BY o_custkey", "total")
def sql_cursor(spark, sf_dir):
    text = "EXEC SQL SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total FROM ORDER_FILE WHERE o_custkey > :WS-LOW AND 'at:NO' <> '' GROUP BY o_custkey END-EXEC"
    return sql_steps.run(spark, text, {"WS-LOW": 50}, {"ORDER_FILE": table(spark, sf_dir, "orders")})


@register("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) % 1000 AS DECIMAL(7,2)) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey", "total")
def accumulate_total(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(coerce(F.sum(money("l_quantity")), 3, 2).alias("total").cast("decimal(7,2)").alias("total"), F.count("*").alias("n"))


@register(r"""SELECT program, count(*) AS total, count(*) FILTER (NOT blank AND NOT comment) AS code, count(*) FILTER (comment) AS comments, count(*) FILTER (blank) AS blanks FROM (
 SELECT program, blank, NOT blank AND CASE WHEN free THEN starts_with(ltrim(line), '*>') ELSE substr(line, 7, 1) IN ('*', '/') END AS comment FROM (
 SELECT program, free, line, regexp_matches(line, '^[ \t\r\f\v]*$') AS blank FROM (
 SELECT CAST(doc_id AS VARCHAR) AS program, doc_id % 2 = 0 AS free, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))) GROUP BY program""")
def line_statistics(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("program"), (F.col("doc_id") % 2 == 0).alias("free"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return corpus.line_counts(lines)


#: Names and notes that rows of part are given in turn, to run the analytics over.
NAMES = ("CUST-SSN", "WS-TAX-ID", "EMP-DOB", "TAX-IDS", "CUST-PIN-NO", "SPIN", "LOGON-PASSWORD", "ACCOUNT-NO", "WS-WAGE", "WAGES", "CUST-CREDIT", "EMP-NAME", "MAIL-ADDR", "FILLER", "WS-EOF", "WS-X")
NOTES = ("EXEC SQL fetch", "send map", "pcb mask", "open failed", "call target", "go to exit", "unstring parts", "redefines base", "multiply twice", "nothing known")


def _in_turn(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(p_partkey % {len(values)} + 1 AS INTEGER)]"


def _given(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


@register(f"""SELECT p_partkey, name, CASE WHEN name IN ('FILLER', 'WS-EOF', 'WS-ERROR') THEN NULL
 WHEN regexp_matches(name, '(^|-)(SSN|TAX-ID|DOB|BIRTH|PIN)(-|$)|(^|-)SOCIAL-SEC|PASSWORD') THEN 'HIGH'
 WHEN regexp_matches(name, 'ACCOUNT|BALANCE|SALARY|(^|-)WAGE(-|$)|CREDIT|PAYMENT') THEN 'MEDIUM'
 WHEN regexp_matches(name, '^CUST-|^EMP-|ADDR|PHONE|EMAIL') THEN 'LOW' END AS level FROM (SELECT p_partkey, {_in_turn(NAMES)} AS name FROM part)""")
def corpus_sensitivity(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", _given(NAMES).alias("name"))
    return named.select("p_partkey", "name", corpus.sensitivity(F.col("name")).alias("level"))


#: The categories' words as conditions of SQL, in their order.
_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(upper(text), {w!r})' for w in words)} THEN '{name}'" for name, words in corpus.CATEGORIES.items()) + " ELSE 'Other' END"


@register(f"""SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM (SELECT {_CATEGORY} AS category FROM (SELECT {_in_turn(NOTES)} AS text FROM part)) GROUP BY category""")
def corpus_todo_triage(spark, sf_dir):
    return corpus.triage(table(spark, sf_dir, "part").select(_given(NOTES).alias("text")))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_parse(spark, sf_dir):
    found = documents.json_parse(F.col("props"), ["k", "missing"])
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in found.items()])


@register("SELECT n_nationkey, '<nation><N_NAME>' || n_name || '</N_NAME><KEY>' || CAST(n_regionkey AS VARCHAR) || '</KEY><NONE /></nation>' AS xml FROM nation")
def xml_generate(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", documents.xml_generate("nation", {"N_NAME": F.col("n_name"), "KEY": F.col("n_regionkey"), "NONE": F.lit(None)}).alias("xml"))


@register("SELECT p_partkey, 'a<b&' || p_name AS name, CAST(p_size AS VARCHAR) AS size, '' AS none FROM part")
def xml_parse(spark, sf_dir):
    source = documents.xml_generate("part", {"name": F.concat(F.lit("a<b&"), F.col("p_name")), "size": F.col("p_size")})
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in documents.xml_parse(source, ["name", "size", "none"]).items()])


@register("SELECT event_id, strftime(ts, '%y%m%d') AS date6, strftime(ts, '%Y%j') AS day7, strftime(ts, '%u') AS week_day, strftime(ts, '%H%M%S') AS time6 FROM events")
def accept_from(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", documents.accept("DATE", ts).alias("date6"), documents.accept("DAY YYYYDDD", ts).alias("day7"), documents.accept("DAY-OF-WEEK", ts).alias("week_day"), documents.accept("TIME", ts).substr(1, 6).alias("time6"))


@register("""SELECT o_orderkey, coalesce(l_partkey, 0) AS l_partkey, CASE WHEN l_partkey IS NULL THEN 'GE' ELSE '  ' END AS status FROM orders LEFT JOIN
 (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) l ON o_orderkey = l_orderkey AND rn = 2""")
def dli_get_next_in_parent(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return segments.next_in_parent(table(spark, sf_dir, "orders").select("o_orderkey"), children, ["o_orderkey"], ["l_linenumber", "l_partkey"], 2).select("o_orderkey", F.coalesce("l_partkey", F.lit(0)).alias("l_partkey"), "status")


@register("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 7")
def dli_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "nation").where("n_nationkey = 7").select(F.col("n_nationkey").alias("c_nationkey"))
    return segments.delete([(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"])], gone)[0]


@register("SELECT r_regionkey, i, j FROM region, (SELECT CAST(unnest(generate_series(1, 9, 2)) AS BIGINT) AS i) a, (SELECT CAST(unnest(generate_series(9, 1, -1)) AS BIGINT) AS j) b WHERE i <= r_regionkey + 3 AND j <= i AND j >= 1")
def perform_varying(spark, sf_dir):
    return loops.varying(table(spark, sf_dir, "region").select("r_regionkey"), [("i", F.lit(1), F.lit(2), F.col("r_regionkey") + 3), ("j", F.col("i"), F.lit(-1), F.lit(1))])


@register("""SELECT o_orderkey, CASE WHEN rn % 5 = 1 OR before IS DISTINCT FROM o_orderstatus THEN o_orderstatus ELSE '' END AS shown
 FROM (SELECT *, row_number() OVER w AS rn, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""")
def report_group_indicate(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    marked = reports.breaks(df, reports.Report(["o_orderstatus"], {}, page=5), ["o_orderkey"], ["o_custkey"])
    return marked.select("o_orderkey", reports.indicate(F.col("o_orderstatus"), line="line").alias("shown"))


@register("SELECT 'C' || c_custkey AS program FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def entry_points_except(spark, sf_dir):
    """Customers as programs, of which pending orders call some: those that nothing calls."""
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("program"), F.lit("MOVE").alias("verb"), F.lit(None).cast("string").alias("target"))
    calls = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("C0").alias("program"), F.lit("CALL").alias("verb"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("target"))
    return corpus.call_graph(own.unionByName(calls))[1].where("program <> 'C0'")


@register("""SELECT o_orderkey, CASE WHEN price > 200000 THEN 'BIG ' WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'LOW ' END AS kind,
 CASE WHEN price > 200000 THEN CAST(round(price * 0.015, 2) AS DECIMAL(9,2)) WHEN o_orderstatus = 'F' THEN 0 ELSE 5 END + 1 AS fee
 FROM (SELECT *, CAST(o_totalprice AS DECIMAL(15,2)) AS price FROM orders)""", "fee")
def procedure_paragraphs(spark, sf_dir):
    records = parse_records("01 REC.\n 05 PRICE PIC 9(9)V99.\n 05 STATUS PIC X.\n    88 IS-FINAL VALUE 'F'.\n 05 KIND PIC X(4).\n 05 FEE PIC 9(7)V99.")
    program = Program(
        """
        MAIN-LINE.
            IF PRICE > 200000
                MULTIPLY PRICE BY 0.015 GIVING FEE ROUNDED
                MOVE "BIG" TO KIND
            ELSE IF IS-FINAL MOVE "DONE" TO KIND
            ELSE PERFORM LOW-ORDER.
            ADD 1 TO FEE.
        LOW-ORDER.
            MOVE "LOW" TO KIND.
            MOVE 5 TO FEE.
        """,
        records,
    )
    df = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return program.apply(df).select("o_orderkey", "kind", "fee")


@register("""SELECT p_partkey, round(sin(p_size / 100.0), 6) AS sine, round(cos(p_size / 100.0), 6) AS cosine, round(atan(p_size / 100.0), 6) AS arc, round(asin(p_size / 100.0), 6) AS arcsine,
 round(exp(p_size / 100.0), 6) AS power, round(log10(p_size + 1.0), 6) AS log, CAST(sign(p_size - 25) AS INTEGER) AS sign, abs(p_size - 25) AS distance FROM part""")
def intrinsic_trigonometry(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    f = fields(df)
    spec = {"sine": "SIN(P-SIZE / 100)", "cosine": "COS(P-SIZE / 100)", "arc": "ATAN(P-SIZE / 100)", "arcsine": "ASIN(P-SIZE / 100)", "power": "EXP(P-SIZE / 100)", "log": "LOG10(P-SIZE + 1)"}
    return df.select("p_partkey", *[F.round(compute(f"FUNCTION {t}", f), 6).alias(k) for k, t in spec.items()], compute("FUNCTION SIGN(P-SIZE - 25)", f).alias("sign"), compute("FUNCTION ABS(P-SIZE - 25)", f).cast("int").alias("distance"))


@register("""SELECT p_partkey, CASE WHEN p_size <= 50 THEN 2000 + p_size ELSE 1900 + p_size END AS year, (CASE WHEN p_size <= 50 THEN 2000 + p_size ELSE 1900 + p_size END) * 1000 + 45 AS year_day,
 round(0.05 / (1 - power(1.05, -p_size)), 6) AS annuity, round(p_size / 1.1 + 100 / power(1.1, 2), 6) AS present FROM part""")
def intrinsic_years_and_finance(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        intrinsics.intrinsic("YEAR-TO-YYYY", size).cast("int").alias("year"),
        intrinsics.intrinsic("DAY-TO-YYYYDDD", size * 1000 + 45).cast("int").alias("year_day"),
        F.round(intrinsics.intrinsic("ANNUITY", F.lit(0.05), size), 6).alias("annuity"),
        F.round(intrinsics.intrinsic("PRESENT-VALUE", F.lit(0.1), size, F.lit(100)), 6).alias("present"),
    )


@register("""SELECT c_custkey, round(CAST(substr(c_name, 10) AS DOUBLE), 2) AS number, CASE WHEN regexp_matches(c_name, '^[0-9]+$') THEN 0 ELSE 1 END AS text_fails, 0 AS digits_fail, 1234.5 + c_custkey AS amount FROM customer""", "amount")
def intrinsic_numval(spark, sf_dir):
    digits = F.expr("substr(c_name, 10)")
    value = intrinsics.intrinsic("NUMVAL-C", F.lit(" $1,234.5 "))
    return table(spark, sf_dir, "customer").select("c_custkey", intrinsics.intrinsic("NUMVAL", digits).cast("double").alias("number"), intrinsics.intrinsic("TEST-NUMVAL", F.col("c_name")).alias("text_fails"), intrinsics.intrinsic("TEST-NUMVAL", digits).alias("digits_fail"), (value + F.col("c_custkey")).alias("amount"))


@register("""SELECT p_partkey, length(regexp_extract(p_brand, '^(B*)', 1)) AS leading, CASE WHEN starts_with(p_brand, 'B') THEN 'X' || substr(p_brand, 2) ELSE p_brand END AS replaced,
 CASE WHEN position(' ' IN p_type) > 0 THEN substr(p_type, position(' ' IN p_type) + 1) ELSE p_type END AS behind FROM part""")
def inspect_leading_and_after(spark, sf_dir):
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", strings.tally_leading(brand, "B").cast("bigint").alias("leading"), strings.replace_leading(brand, "B", "X").alias("replaced"), strings.region(F.col("p_type"), after=" ")[1].alias("behind"))


@register("""SELECT c_custkey, rpad('#####' || c_mktsegment || repeat('#', 15 - length(c_mktsegment)), 20, ' ') AS spliced, 5 + length(c_mktsegment) > 14 AS overflow,
 len(regexp_split_to_array(c_name, '#|0')) AS n_parts, rpad(coalesce(regexp_split_to_array(c_name, '(#|0)+')[2], ''), 9, ' ') AS second FROM customer""")
def string_pointer_and_delimiters(spark, sf_dir):
    segment, name = [(F.col("c_mktsegment"), None)], F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        strings.string(segment, 20, F.lit("#" * 20), F.lit(6)).alias("spliced"),
        strings.string_overflow(segment, 14, F.lit(6)).alias("overflow"),
        F.size(strings.parts(name, ["#", "0"])).cast("bigint").alias("n_parts"),
        strings.unstring(name, ["#", "0"], 2, 9, every=True).alias("second"),
    )


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey < 100)")
def sql_delete_as_filter(spark, sf_dir):
    base = sql_steps.Database(spark, {"ORDERS": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")})
    base.execute("EXEC SQL DELETE FROM ORDERS WHERE o_orderstatus = :WS-DONE AND o_custkey < :WS-LOW END-EXEC", {"WS-DONE": "F", "WS-LOW": 100})
    return base.tables["ORDERS"].select("o_orderkey", "o_orderstatus")


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def sql_update_as_projection(spark, sf_dir):
    base = sql_steps.Database(spark, {"ORDERS": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")})
    base.execute("EXEC SQL UPDATE ORDERS SET o_orderstatus = :WS-TO, o_custkey = (o_custkey + 1) WHERE o_orderstatus = :WS-FROM END-EXEC", {"WS-FROM": "P", "WS-TO": "X"})
    return base.tables["ORDERS"].select("o_orderkey", "o_orderstatus", "o_custkey")


#: Statements that rows of nation are taken for: its name is a program that calls the next nation but one.
def _programs(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    verb = F.when(F.col("n_nationkey") % 3 == 0, "GO").when(F.col("n_nationkey") % 3 == 1, "CALL").otherwise("PERFORM")
    return df.select(F.concat(F.lit("P"), (F.col("n_nationkey") % 5).cast("string")).alias("program"), F.concat(F.lit("PAR-"), F.col("n_nationkey").cast("string")).alias("paragraph"), F.col("n_nationkey").alias("par_no"), F.lit(1).alias("stmt_no"), verb.alias("verb"), F.col("n_name").alias("text"), F.when(verb == "CALL", F.concat(F.lit("P"), (F.col("n_nationkey") % 7).cast("string"))).otherwise(F.concat(F.lit("PAR-"), (F.col("n_nationkey") + 10).cast("string"))).alias("target"))


@register("SELECT DISTINCT 'P' || (n_nationkey % 5) AS caller, 'P' || (n_nationkey % 7) AS callee, n_nationkey % 7 < 5 AS known FROM nation WHERE n_nationkey % 3 = 1")
def corpus_calls(spark, sf_dir):
    edges, _, missing = corpus.call_graph(_programs(spark, sf_dir))
    return edges.join(missing.withColumn("gone", F.lit(True)), "callee", "left").select("caller", "callee", F.col("gone").isNull().alias("known"))


@register("""SELECT 'P' || (n_nationkey % 5) AS program, 'PAR-' || n_nationkey AS paragraph FROM nation n WHERE n_nationkey > 4
 AND NOT EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey % 3 <> 1 AND m.n_nationkey + 10 = n.n_nationkey)
 AND NOT EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey % 3 <> 0 AND m.n_nationkey + 5 = n.n_nationkey)""")
def corpus_flow_unreached(spark, sf_dir):
    return corpus.flow(_programs(spark, sf_dir))[1]


@register("""SELECT 'P' || (n_nationkey % 5) AS program, 'PAR-' || n_nationkey AS paragraph, CASE WHEN n_nationkey < 3 THEN 'added' WHEN n_nationkey > 20 THEN 'removed' WHEN n_regionkey = 1 THEN 'modified' ELSE 'unchanged' END AS change FROM nation""")
def corpus_fingerprint_changes(spark, sf_dir):
    old = _programs(spark, sf_dir)
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("par_no"), "n_regionkey")
    new = old.join(regions, "par_no").withColumn("text", F.when(F.col("n_regionkey") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return corpus.changes(corpus.fingerprints(old.where("par_no >= 3")), corpus.fingerprints(new.where("par_no <= 20")))


@register("SELECT n_nationkey, rpad(n_name, 4, ' ') AS short, lpad(n_name, 20, ' ') AS flush, lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS digits FROM nation")
def move_padding(spark, sf_dir):
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", pad(name, 4).alias("short"), semantics.justified(name, 20).alias("flush"), semantics.zoned(F.col("n_regionkey"), 3).alias("digits"))


@register("SELECT n_nationkey, i FROM nation, (SELECT CAST(unnest(generate_series(1, 5)) AS BIGINT) AS i) s WHERE i <= n_regionkey")
def perform_times(spark, sf_dir):
    out = loops.times(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey"), "i")
    return out.select("n_nationkey", F.col("i").cast("bigint").alias("i"))
