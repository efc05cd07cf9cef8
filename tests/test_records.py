"""The record engine against stated values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.functions import strings
from recordloom.functions.intrinsics import FUNCTIONS, intrinsic
from recordloom.functions.semantics import coerce, divide, edited, equal, from_zoned, zoned
from recordloom.operators import keyed, loops, reports, segments, sorting
from recordloom.plans import copying, corpus
from recordloom.plans.copybook import column_names, parse_picture, parse_records
from recordloom.plans.corpus import call_graph, changes, facts, fingerprints, flow
from recordloom.plans.expressions import compute, condition
from recordloom.plans.procedure import Program, Unsupported
from recordloom.plans.sql_steps import Cursor, prepare
from recordloom.sources import fixed_width


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "shape", "want"), [("12345", (3, 0), "345"), ("-10", (5, 2), "10.00"), ("-10", (5, 2, True), "-10.00"), ("-5.999", (3, 2, True), "-5.99"), ("-100", (2, 0, True), "0"), ("-150", (2, 0, True), "-50"), ("2.345", (3, 2, True, True), "2.35"), ("-2.345", (3, 2, True, True), "-2.35"), ("junk", (3, 2), "0.00"), (None, (3, 2), "0.00")])
def test_coerce(spark, x, shape, want):
    assert value(spark, coerce(F.lit(x), *shape)) == Decimal(want)


def test_divide_and_text(spark):
    assert value(spark, coerce(divide(F.lit(10), F.lit(3), F.lit(0)), 5, 2)) == Decimal("3.33")
    assert value(spark, coerce(divide(F.lit(10), F.lit(0), F.lit(10)), 5, 2)) == Decimal("10.00")
    assert value(spark, equal(F.lit("AB "), F.lit("AB   ")))
    assert value(spark, zoned(F.lit(Decimal("-12.5")), 6, 2)) == "001250"
    assert value(spark, from_zoned(F.lit("  1250"), 2)) == Decimal("12.50")
    assert value(spark, edited(F.lit(Decimal("1234.5")), "$$$,$$9.99")) == " $1,234.50"


def test_conditions(spark):
    f = {"A": F.lit(5), "B": F.lit("YES  "), "N": F.lit(-1)}
    for text, want in {"A > 1 AND < 9": True, "A = 1 OR 5": True, "NOT A = 5": False, "B = 'YES'": True, "N IS NEGATIVE AND A IS NOT ZERO": True, "(A + 1) * 2 = 12": True, "A GREATER THAN OR EQUAL TO 6 OR N < 0": True, "A NOT = 5": False}.items():
        assert value(spark, condition(text, f)) is want, text
    with pytest.raises(SyntaxError):
        condition("A >", f)
    assert value(spark, compute("2 + 3 * A ** 2 - (4 - 2)", f)) == 75


def test_intrinsics(spark):
    assert len(FUNCTIONS) >= 53
    assert value(spark, intrinsic("INTEGER-OF-DATE", F.lit("20240101"))) == 154498
    assert value(spark, intrinsic("DATE-OF-INTEGER", F.lit(154498))) == "20240101"
    assert value(spark, intrinsic("FACTORIAL", F.lit(25))) == Decimal("15511210043330985984000000")
    assert value(spark, intrinsic("MEDIAN", F.lit(1), F.lit(9), F.lit(3), F.lit(4))) == 3.5
    assert value(spark, intrinsic("YEAR-TO-YYYY", F.lit(51))) == 1951


def test_strings(spark):
    assert value(spark, strings.string([(F.lit("JOHN   "), " "), (F.lit("DOE"), None)], 10)) == "JOHNDOE   "
    assert value(spark, strings.tally_all(F.lit("HELLO WORLD HELLO"), "LL")) == 2
    assert value(spark, strings.replace_all(F.lit("BANANA"), "A", "X")) == "BXNXNX"
    assert value(spark, strings.replace_leading(F.lit("00120"), "0", "*")) == "**120"
    assert value(spark, strings.unstring(F.lit("ALPHA,BETA"), [","], 3, 4)) == "    "


LAYOUT = """
01 CUST.
   05 CUST-ID PIC 9(4).
   05 CUST-NAME PIC X(6).
   05 BAL PIC 9(3)V99 OCCURS 2.
   05 FLAG PIC X.
      88 OPEN-FLAG VALUE "O" "P".
   05 WHOLE REDEFINES CUST-NAME PIC X(3).
"""


def test_layout_and_round_trip(spark, tmp_path):
    (item,) = parse_records(LAYOUT)
    assert item.size == 21
    assert [(n, x.offset) for n, x in column_names(item)] == [("cust_id", 0), ("cust_name", 4), ("bal", 10), ("flag", 20), ("whole", 4)]
    assert parse_picture("S9(7)V99").decimals == 2
    df = spark.createDataFrame([(7, "ANN", [Decimal("1.50"), Decimal("2.25")], "O")], "cust_id int, cust_name string, bal array<decimal(5,2)>, flag string")
    fixed_width.write(df, str(tmp_path / "f"), item)
    row = fixed_width.scan(spark, str(tmp_path / "f"), item).first()
    assert (row["cust_id"], row["cust_name"], row["bal"], row["flag"], row["whole"]) == (7, "ANN   ", [Decimal("1.50"), Decimal("2.25")], "O", "ANN")


def test_keyed(spark):
    file = spark.createDataFrame([("001", "A"), ("002", "B"), ("003", "C")], "record_key string, record_data string")
    new = spark.createDataFrame([("002", "X"), ("004", "D")], file.schema)
    whole, status = keyed.write(file, new, "record_key")
    assert whole.count() == 4
    assert dict(status.collect()) == {"002": "22", "004": "00"}
    changed, status = keyed.rewrite(file, new, "record_key")
    assert dict(changed.collect())["002"] == "X"
    assert dict(status.collect())["004"] == "23"
    assert [r[0] for r in keyed.start(file, "record_key", "<", F.lit("002")).orderBy("record_key").collect()] == ["001", "002", "003"]
    assert keyed.start(file, "record_key", "=", F.lit("009")).count() == 0


def test_sort_and_report(spark):
    df = spark.createDataFrame([("a1",), ("A1",), ("1a",)], "k string")
    assert [r.k for r in sorting.sort(df, [(F.col("k"), True)], "EBCDIC").collect()] == ["a1", "A1", "1a"]
    sales = spark.createDataFrame([("N", "x", 1), ("N", "y", 2), ("S", "x", 4)], "area string, who string, n int")
    out = {(r.area, r.who, r.break_level): r.total for r in reports.footings(sales, reports.Report(["area", "who"], {"total": "n"})).collect()}
    assert out[None, None, 0] == 7 and out["N", None, 1] == 3 and out["S", "x", 2] == 4


def test_sql(spark):
    assert prepare("EXEC SQL SELECT NAME INTO :WS-NAME FROM EMP WHERE ID = :WS-ID END-EXEC") == ("SELECT NAME FROM EMP WHERE ID = :ws_id", ["WS-ID"], ["WS-NAME"])
    spark.range(3).createOrReplaceTempView("three")
    cursor = Cursor(spark, "DECLARE C1 CURSOR FOR SELECT id FROM three WHERE id < :TOP ORDER BY id")
    cursor.open({"TOP": 2})
    assert [cursor.fetch()[0], cursor.fetch()[0], cursor.fetch(), cursor.sqlcode] == [0, 1, None, 100]


def test_corpus(spark, tmp_path):
    (tmp_path / "a.cob").write_text("IDENTIFICATION DIVISION.\nPROGRAM-ID. A.\nPROCEDURE DIVISION.\nP1.\n  CALL 'B'. GO TO P3.\nP2.\n  MOVE 1 TO X.\nP3.\n  CALL 'C'.\n  STOP RUN.\n")
    (tmp_path / "b.cbl").write_text("IDENTIFICATION DIVISION.\nPROGRAM-ID. B.\nPROCEDURE DIVISION.\nP1.\n  DISPLAY 'HI'.\n")
    rows = facts(spark, str(tmp_path))
    edges, entries, missing = call_graph(rows)
    assert sorted(map(tuple, edges.collect())) == [("A", "B"), ("A", "C")]
    assert [r[0] for r in entries.collect()] == ["A"] and [r[0] for r in missing.collect()] == ["C"]
    assert ("A", "P2") in set(map(tuple, flow(rows)[1].collect()))
    prints = fingerprints(rows)
    assert {r.change for r in changes(prints, prints.where("program = 'A'")).collect()} == {"unchanged", "removed"}


def test_copy(spark):
    books = {"a": "01 :T:-REC.\n    COPY B.\n", "b": "   05 OLD-ID PIC 9.\n   05 X-OLD PIC 9.\n   COPY A.\n"}
    text = "       COPY A REPLACING ==:T:== BY ==CUST==\n           LEADING ==OLD== BY ==NEW== TRAILING ==OLD== BY ==END==.\n       COPY GONE.\n       MOVE 1 TO COPY-X.\n"
    want = copying.expand(text, books)
    assert "01 CUST-REC." in want and "05 NEW-ID" in want and "05 X-END" in want
    assert "copybook A copies itself" in want and "no copybook GONE" in want and "MOVE 1 TO COPY-X." in want
    words = copying.substitutions(" REPLACING A BY B 'C' BY 'D' ==X Y== BY ====")
    assert copying.replacing("A-BALANCE OF A. MOVE 'C' TO\n   x\n  Y Z", words) == "A-BALANCE OF B. MOVE 'D' TO\n    Z"
    files = spark.createDataFrame([("p/x.cob", text), ("p/y.cob", None)], "path string, text string")
    shelf = spark.createDataFrame([("lib/A.cpy", books["a"]), ("lib/a.copy", "other"), ("lib/B.CBL", books["b"]), ("lib/C", "unused")], "path string, text string")
    assert {r.path: r.text for r in copying.expand_files(files, shelf).collect()} == {"p/x.cob": want, "p/y.cob": ""}


def test_segments_and_loops(spark):
    seg = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "p int, k int, v string")
    assert segments.get_unique(seg, ["p", "k"], F.col("p") == 2).first()["v"] == "c"
    assert segments.get_next(seg, ["p", "k"], [1, 2]).first()["v"] == "c"
    assert segments.get_next(seg, ["p", "k"], [2, 1]).count() == 0
    changed = spark.createDataFrame([(1, 2, "B"), (9, 9, "z")], seg.schema)
    assert sorted(r.v for r in segments.replace(seg, changed, ["p", "k"]).collect()) == ["B", "a", "c"]
    assert segments.insert(seg, changed).count() == 5
    one = spark.range(1)
    assert loops.times(one, F.lit(3)).count() == 3 and loops.times(one, F.lit(0)).count() == 0
    assert loops.varying(one, [("i", F.lit(5), F.lit(1), F.lit(1))], test_after=True).first()["i"] == 5


def test_triage(spark):
    rows = spark.createDataFrame([("A", "P1", 1, 0, "GO", "P3", "GO TO P3"), ("A", "P2", 2, 1, "MOVE", None, "MOVE 1 TO X"), ("A", "P3", 3, 2, "STOP", None, "STOP RUN")], "program string, paragraph string, par_no int, stmt_no int, verb string, target string, text string")
    items = spark.createDataFrame([("A", "CUST-SSN"), ("A", "FILLER")], "program string, name string")
    found = {r.warning for r in corpus.warnings(rows, items).collect()}
    assert {"GO TO in P1", "Unreachable paragraph: P2", "1 highly sensitive items"} <= found
    lines = spark.createDataFrame([("A", "      * NOTE", False), ("A", "       MOVE 1 TO X.", False), ("A", "  ", False), ("B", "*> NOTE", True), ("B", "      * 2", True)], "program string, line string, free boolean")
    assert sorted(map(tuple, corpus.line_counts(lines).collect())) == [("A", 3, 1, 1, 1), ("B", 2, 1, 1, 0)]
    points = spark.createDataFrame([("A", "x")], "program string, text string")
    assert sorted(map(tuple, corpus.triage_programs(spark.createDataFrame([("A",), ("B",)], "program string"), points).collect())) == [("A", 1, False), ("B", 0, True)]


STORE = """
01 REC.
   05 AMT PIC S9(5)V99.
   05 KIND PIC X(4).
      88 IS-DONE VALUE "DONE".
   05 N PIC 9(3).
   05 R PIC 9(3).
   05 T PIC 9(2) VALUE 7.
"""


def test_procedure(spark):
    program = Program(
        """
    MAIN-LINE.
        IF AMT > 100 AND NOT IS-DONE
            MOVE "BIG" TO KIND
            IF AMT > 1000 COMPUTE AMT ROUNDED = AMT / 3 ELSE ADD 1 2 TO N
        ELSE
            PERFORM OTHERS 2 TIMES.
        EVALUATE KIND ALSO TRUE
            WHEN "BIG" ALSO AMT > 500
            WHEN "HUGE" ALSO ANY MOVE 9 TO R
            WHEN OTHER DIVIDE 17 BY 5 GIVING R REMAINDER T
        END-EVALUATE.
        MULTIPLY 400 BY N ON SIZE ERROR SET IS-DONE TO TRUE NOT ON SIZE ERROR SUBTRACT 1 FROM N END-MULTIPLY.
    OTHERS.
        ADD 5 TO N.
        DIVIDE 0 INTO R.
        MOVE SPACES TO KIND.
    """,
        parse_records(STORE),
    )
    rows = spark.createDataFrame([(1, Decimal("2000.00"), "X", 0, 1), (2, Decimal("200.00"), "X", 0, 1), (3, Decimal("5.00"), "DONE", 0, 8)], "id int, amt decimal(7,2), kind string, n int, r int")
    out = {x.id: (x.amt, x.kind, int(x.n), int(x.r), int(x.t)) for x in program.apply(rows).collect()}
    assert out[1] == (Decimal("666.67"), "BIG ", 1, 9, 7)  # N is unsigned: 0 - 1 is kept as 1
    assert out[2] == (Decimal("200.00"), "DONE", 3, 3, 2)
    assert out[3] == (Decimal("5.00"), "DONE", 10, 3, 2)


@pytest.mark.parametrize("text", ["P.\n  READ F.", "P.\n  GO TO Q.", "P.\n  PERFORM P.", "P.\n  MOVE 1 TO NONE.", "P.\n  PERFORM P UNTIL N > 3.", "P.\n  MOVE 1 TO N ELSE.", "P.\n  SET IS-DONE TO FALSE.", "P.\n  CALL 'GONE'.", "P.\n  EXIT PERFORM.", "P.\n  ACCEPT N."])
def test_procedure_rejects(spark, text):
    with pytest.raises(Unsupported):
        Program(text, parse_records(STORE)).apply(spark.createDataFrame([(1,)], "n int"))


WORK = """
01 W.
   05 N PIC 9(4).
   05 I PIC 9(3).
   05 J PIC 9(3).
   05 TXT PIC X(20).
   05 A PIC X(6).
   05 B PIC X(6).
   05 C PIC 9(3).
   05 P PIC 9(2) VALUE 1.
   05 T PIC 9(2).
   05 SHOWN PIC ZZ9.99-.
"""


def run(spark, text, rows, **more):
    return Program(text, parse_records(WORK), **more).apply(spark.createDataFrame(rows, "n int")).orderBy("n").collect()


def test_loops_within_a_record(spark):
    text = """
    MAIN.
        PERFORM VARYING I FROM 1 BY 1 UNTIL I > N
            IF I = 5 EXIT PERFORM END-IF
            ADD I TO C
        END-PERFORM
        PERFORM ADD-J WITH TEST AFTER UNTIL J > 2
        PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3 AFTER J FROM 1 BY 1 UNTIL J > I
            ADD 1 TO T
        END-PERFORM.
        PERFORM N TIMES SUBTRACT 1 FROM P END-PERFORM.
    ADD-J.
        ADD 3 TO J.
    """
    got = [(r.n, int(r.c), int(r.j), int(r.i), int(r.t), int(r.p)) for r in run(spark, text, [(0,), (3,), (9,)], passes=30)]
    # P is unsigned, so 1 - 1 - 1 is 1 again
    assert [g[:2] for g in got] == [(0, 0), (3, 6), (9, 10)]
    assert {g[3:5] for g in got} == {(4, 6)} and [g[5] for g in got] == [1, 0, 0]
    with pytest.raises(Exception, match="not over after"):
        run(spark, "M.\n PERFORM UNTIL N > 99 ADD 0 TO N END-PERFORM.", [(1,)], passes=5)


def test_strings_within_a_record(spark):
    text = """
    MAIN.
        MOVE "ALPHA,BETA;;7" TO TXT.
        UNSTRING TXT DELIMITED BY "," OR ALL ";" INTO A B C WITH POINTER P TALLYING IN T
            ON OVERFLOW MOVE 99 TO I END-UNSTRING.
        MOVE SPACES TO TXT. MOVE 3 TO J.
        STRING A DELIMITED BY SPACE "-" B DELIMITED BY SIZE INTO TXT WITH POINTER J.
        INSPECT TXT TALLYING I FOR ALL "A" BEFORE INITIAL "-" REPLACING LEADING " " BY "*".
        INSPECT A CONVERTING "ALPH" TO "1234".
        MOVE -7.256 TO SHOWN.
        DISPLAY "N=" N " " SHOWN.
        IF N = 2 STOP RUN.
        DISPLAY "AFTER".
        MOVE 50 TO T.
    """
    one, two = run(spark, text, [(1,), (2,)])
    assert (one.a, one.b, int(one.c), int(one.p), int(one.t)) == ("12341 ", "BETA  ", 7, 21, 50)
    assert one.txt == "**ALPHA-BETA  ".ljust(20) and int(one.j) == 15 and int(one.i) == 2
    assert one.display == ["N=1   7.25-", "AFTER"] and two.display == ["N=2   7.25-"] and int(two.t) == 3


def test_calls_and_inputs(spark):
    text = """
    MAIN.
        CALL "TWICE" USING N C.
        CALL "NOWHERE" ON EXCEPTION MOVE 4 TO T END-CALL.
        ACCEPT A FROM ENVIRONMENT "HOME". ACCEPT B. ACCEPT J FROM COMMAND-LINE.
    """
    (row,) = run(spark, text, [(21,)], calls={"TWICE": lambda n, c: [n, n * 2]}, inputs={"ENVIRONMENT HOME": "here", "B": "typed", "COMMAND-LINE": "12"})
    assert (int(row.c), int(row.t), row.a, row.b, int(row.j)) == (42, 4, "here  ", "typed ", 12)


def test_qualified_names_and_groups(spark):
    records = parse_records("01 G1.\n 05 NAME PIC X(5).\n 05 N PIC 9(3).\n 05 ONLY-1 PIC 9.\n01 G2.\n 05 N PIC 9(4).\n 05 NAME PIC X(3).\n01 G3.\n 05 A PIC X(2).\n 05 B PIC 9(3).\n01 FLAT PIC X(10).")
    text = """
    MAIN.
        MOVE "ALICE" TO NAME OF G1. MOVE 12 TO N IN G1. MOVE 5 TO ONLY-1.
        MOVE CORRESPONDING G1 TO G2.
        ADD CORRESPONDING G1 TO G2.
        IF N OF G2 > N OF G1 MOVE G1 TO FLAT.
        MOVE "XY007" TO G3.
    """
    (row,) = Program(text, records).apply(spark.range(1)).collect()
    assert (row.name_of_g2, int(row.n_of_g2), row.flat, row.a, int(row.b)) == ("ALI", 24, "ALICE0125 ", "XY", 7)


NESTED = """
01 R.
  05 N PIC 9.
  05 T OCCURS 3.
     10 A PIC X(2).
     10 B PIC 9(3).
     10 G OCCURS 2 PIC 9.
  05 V OCCURS 1 TO 4 DEPENDING ON N PIC X.
  05 S PIC S9(3)V9.
  05 Q PIC S9(3) SIGN LEADING SEPARATE.
  05 Z PIC 9(3) BLANK WHEN ZERO.
  05 D PIC 9(8).
  05 PARTS REDEFINES D.
     10 Y PIC 9(4).
     10 MD PIC 9(4).
     10 MD-PARTS REDEFINES MD.
        15 M PIC 99.
  66 SIGNED RENAMES S THRU Q.
"""


def test_nested_layout(spark):
    (record,) = parse_records(NESTED)
    assert record.size == 45 and {n: x.offset for n, x in column_names(record)} == {"n": 0, "t": 1, "v": 22, "s": 26, "q": 30, "z": 34, "d": 37, "y": 37, "md": 41, "m": 41, "signed": 26}
    row = spark.range(1).select(F.lit(2).alias("n"), F.expr("array(named_struct('a','xy','b',12,'g',array(1,2)), named_struct('a','z','b',7,'g',array(3,4)))").alias("t"), F.expr("array('p','q')").alias("v"), F.lit(Decimal("-12.5")).alias("s"), F.lit(-45).alias("q"), F.lit(0).alias("z"), F.lit(20260321).alias("d"))
    line = row.select(fixed_width.encode(record).alias("value"))
    assert line.first()[0] == "2xy01212z 00734       pq  012N-045   20260321"
    got = line.select(*fixed_width.decode(F.col("value"), record)).first()
    assert [tuple(x) for x in got.t][:2] == [("xy", 12, [1, 2]), ("z ", 7, [3, 4])] and got.v == ["p", "q"]
    assert (got.s, got.q, got.z, got.y, got.m, got.signed) == (Decimal("-12.5"), -45, 0, 2026, 3, "012N-045")
    month = next(x for x in record.walk() if x.name == "M")
    assert value(spark, fixed_width.place(F.lit(line.first()[0]), month, F.lit(12))).endswith("20261221")
    for text, wrong in (("01 R.\n 05 A PIC 9 COMP-3.", "binary records"), ("01 R.\n 05 A OCCURS 1 TO 2 DEPENDING ON B PIC 9.", "isn't in its record")):
        with pytest.raises(ValueError, match=wrong):
            fixed_width.decode(F.lit("1"), parse_records(text)[0])
    with pytest.raises(ValueError, match="variable length"):
        parse_records("01 R.\n 05 N PIC 9.\n 05 A OCCURS 1 TO 2 DEPENDING ON N PIC 9.\n 05 B REDEFINES A PIC 99.")


@pytest.mark.parametrize(("x", "picture", "want"), [("1234.5", "$$$,$$9.99", " $1,234.50"), ("0", "ZZZ", "   "), ("-12345.678", "-ZZZ,ZZZ,ZZ9.99", "-     12,345.67"), ("7.5", "***9.99", "***7.50"), ("-3", "---9", "  -3"), ("-3", "ZZ9CR", "  3CR"), ("3", "ZZ9DB", "  3  "), ("20260102", "9999/99/99", "2026/01/02"), ("12", "99B99", "00 12"), ("3", "+ZZ9", "+  3"), ("56", "$***,**9.99", "$*****56.00"), ("505.97", "$$$,$$9.99", "   $505.97"), ("1234", "++,++9", "+1,234"[:6])])
def test_edited_pictures(spark, x, picture, want):
    assert value(spark, edited(F.lit(Decimal(x)), picture)) == want
