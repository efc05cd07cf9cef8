"""Whole programs, their files and what is known of them, against stated values."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import recordloom.__main__ as command
from recordloom.plans import corpus, exports, middleware, sql_steps, tools
from recordloom.plans.copybook import parse_records
from recordloom.plans.file_program import FileProgram
from recordloom.plans.procedure import Unsupported
from recordloom.plans.report_writer import ReportRun, parse_reports, write_report
from recordloom.sources.files import FileControl, RecordFile, parse_open

HEAD = """
 IDENTIFICATION DIVISION.
 PROGRAM-ID. SUMS.
 ENVIRONMENT DIVISION.
 INPUT-OUTPUT SECTION.
 FILE-CONTROL.
     SELECT IN-FILE ASSIGN TO "IN".
     SELECT OUT-FILE ASSIGN TO "OUT".
 DATA DIVISION.
 FILE SECTION.
 FD IN-FILE.
 01 IN-REC.
    05 ID-NO PIC 9(4).
    05 AMT PIC S9(5)V99.
 FD OUT-FILE.
 01 OUT-REC PIC X(20).
 WORKING-STORAGE SECTION.
 01 EOF PIC X VALUE "N".
    88 DONE VALUE "Y".
 01 N PIC 9(4).
 01 TOTAL PIC S9(7)V99.
 01 LAST-ID PIC 9(4).
 PROCEDURE DIVISION.
"""


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, Decimal("1.25")), (2, Decimal("-3.00")), (3, Decimal("10.10"))], "id_no int, amt decimal(7,2)")


def test_read_at_the_top(spark, rows):
    program = FileProgram(HEAD + """
 MAIN.
     OPEN INPUT IN-FILE OUTPUT OUT-FILE.
     PERFORM UNTIL DONE
         READ IN-FILE AT END MOVE "Y" TO EOF
             NOT AT END
                 ADD 1 TO N
                 SUBTRACT AMT FROM TOTAL
                 IF AMT > 0
                     MOVE ID-NO TO OUT-REC
                     WRITE OUT-REC AFTER ADVANCING 2 LINES
                 END-IF
         END-READ
     END-PERFORM.
     DISPLAY "SUM " TOTAL.
     CLOSE IN-FILE OUT-FILE.
     STOP RUN.
""")
    out = program.run({"IN-FILE": rows}, {"IN-FILE": "id_no"})
    end = out.items.first()
    assert (int(end.n), end.total, end.eof) == (3, Decimal("-8.35"), "Y")
    assert [r.line for r in out.written["OUT-FILE"].orderBy("place").collect()] == ["\n\n1", "\n\n3"]
    assert [r.line for r in out.shown.collect()] == ["SUM -8.35"] and out.statuses["IN-FILE"] == "10"
    empty = program.run({"IN-FILE": rows.where("false")})
    assert int(empty.items.first().n) == 0 and empty.written["OUT-FILE"].count() == 0
    with pytest.raises(FileNotFoundError, match="35"):
        program.run({})


@pytest.mark.parametrize("body", ["ADD 1 TO N IF LAST-ID > 1 ADD 1 TO N END-IF MOVE ID-NO TO LAST-ID", "MULTIPLY 2 BY TOTAL", "IF N > 2 STOP RUN END-IF ADD 1 TO N"])
def test_what_goes_from_record_to_record_is_refused(rows, body):
    text = HEAD + f"\n MAIN.\n PERFORM UNTIL DONE\n READ IN-FILE AT END SET DONE TO TRUE NOT AT END {body}\n END-READ\n END-PERFORM.\n DISPLAY TOTAL.\n"
    with pytest.raises(Unsupported):
        FileProgram(text).run({"IN-FILE": rows})


def test_open_and_files(spark, tmp_path):
    assert parse_open("OPEN INPUT A B OUTPUT C I-O D") == [("INPUT", "A"), ("INPUT", "B"), ("OUTPUT", "C"), ("I-O", "D")]
    (record,) = parse_records("01 R.\n 05 K PIC 9(3).\n 05 V PIC X(4).")
    file = RecordFile(spark, FileControl("F"), record, str(tmp_path / "f"))
    some = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert file.open("APPEND") == "37" and file.open("OUTPUT") == "00" and file.write(some) == "00" and file.close() == "00"
    assert file.open("EXTEND") == "00" and file.write(some) == "00" and file.close() == "00" and file.close() == "42"
    assert file.open("INPUT") == "00" and sorted(int(r.k) for r in file.read_all().collect()) == [1, 1, 2, 2] and file.status == "10"


def test_embedded_sql_literals_and_errors(spark):
    base = sql_steps.Database(spark, {"T": spark.createDataFrame([(1, "12:AB"), (2, "x")], "a int, b string")})
    v = {"N": 1}
    base.execute("EXEC SQL UPDATE T SET b = 'a:B, ''c''' WHERE b = '12:AB' AND a = :N -- :GONE\nEND-EXEC", v)
    assert sorted(map(tuple, base.tables["T"].collect())) == [(1, "a:B, 'c'"), (2, "x")]
    base.execute("EXEC SQL WHENEVER SQLERROR GO TO FAILED END-EXEC", v)
    assert base.execute("EXEC SQL SELECT none INTO :X FROM T END-EXEC", v) == "FAILED" and base.sqlca["SQLCODE"] < 0
    base.execute("EXEC SQL WHENEVER SQLERROR CONTINUE END-EXEC", v)
    assert base.execute("EXEC SQL DELETE FROM T WHERE a > 1 END-EXEC", v) is None and base.tables["T"].count() == 1
    base.execute("EXEC SQL COMMIT END-EXEC", v)
    base.execute("EXEC SQL DELETE FROM T END-EXEC", v)
    base.execute("EXEC SQL ROLLBACK END-EXEC", v)
    assert base.tables["T"].count() == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("v")]


def test_report_run(spark, tmp_path):
    (spec,) = parse_reports("RD R CONTROL IS K.\n01 TYPE RH.\n 02 LINE 1 COLUMN 1 VALUE 'HEAD'.\n01 D TYPE DE.\n 02 LINE PLUS 1.\n  03 COLUMN 2 PIC 9 SOURCE V.\n01 TYPE CF K.\n 02 LINE PLUS 1 COLUMN 2 PIC Z9 SUM V.\n01 TYPE RF.\n 02 LINE PLUS 1 COLUMN 1 VALUE 'END'.")
    run = ReportRun(spec)
    with pytest.raises(ValueError, match="isn't initiated"):
        run.generate(spark.range(1))
    run.initiate()
    run.generate(spark.createDataFrame([("b", 5), ("a", 1), ("a", 2)], "k string, v int"))
    lines = run.terminate(["v"])
    assert [r.text for r in lines.orderBy("page", "line").collect()] == ["HEAD", " 1", " 2", "  3", " 5", "  5", "END"]
    assert spark.read.text(write_report(lines, str(tmp_path), "R")).count() == 7


def test_config_and_format():
    patterns, excluded, notes = corpus.load_config(json.dumps({"sensitive_patterns": [{"pattern": "KEY", "level": "high", "reason": "r"}, {"pattern": "(", "level": "low", "reason": "r"}, {"pattern": "A"}, {"pattern": "B", "level": "huge", "reason": "r"}], "exclude_names": ["my-key"]}))
    assert patterns == [("KEY", "HIGH")] and excluded == ("MY-KEY",) and len(notes) == 3
    assert corpus.load_config("{")[0] is corpus.SENSITIVE and corpus.load_config("{}")[2] == []
    assert corpus.is_free("IDENTIFICATION DIVISION.\n*> note\n") and not corpus.is_free("000100 IDENTIFICATION DIVISION.\n000200* NOTE\n") and not corpus.is_free("")
    assert corpus.is_free("  PERFORM A.\n") and not corpus.is_free("  PERFORM A." + " " * 70 + "IDENT\n")
    assert corpus.extract_programs("AT_DATA([a.cob], [\n MOVE A(1) TO B@<:@2@:>@.\n DISPLAY [x].\n])\nAT_DATA([b.txt], [n])") == [("a.cob", " MOVE A(1) TO B[2].\n DISPLAY [x].\n")]


SOURCE = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ONE.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 A PIC 9.
       PROCEDURE DIVISION.
       DECLARATIVES.
       ON-ERROR SECTION. USE AFTER STANDARD ERROR PROCEDURE ON IN-FILE.
       SHOW-IT. DISPLAY "BAD".
       END DECLARATIVES.
       FIRST-PAR.
           MOVE 1 TO A.
       NEXT-PAR.
           GO TO FIRST-PAR.
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TWO.
       PROCEDURE DIVISION.
       ONLY.
           STOP RUN.
"""


def test_tools(spark, tmp_path):
    assert [n for n, _ in tools.programs(SOURCE)] == ["ONE", "TWO"]
    first = tools.programs(SOURCE)[0][1]
    uses, rest = tools.declaratives(tools.divisions(first)["PROCEDURE"])
    assert uses[0][:2] == ("ON-ERROR", "AFTER STANDARD ERROR PROCEDURE ON IN-FILE") and tools.handler(uses, "IN-FILE", "INPUT") == "ON-ERROR" and tools.handler(uses, "X", "INPUT") is None
    assert list(tools.paragraphs(rest)) == ["FIRST-PAR", "NEXT-PAR"]
    assert [p.split(":")[1].strip() for p in tools.problems(SOURCE)] == ["NEXT-PAR"]
    text, changed = tools.patch(first, first.replace("MOVE 1", "MOVE 2"))
    assert changed == ["FIRST-PAR"] and "MOVE 2 TO A" in text
    assert "test_paragraph" in tools.test_module("ONE", first)
    files = spark.createDataFrame([("a.cob", SOURCE), ("b.cob", None)], "path string, text string")
    assert [r.path for r in tools.validate(files).collect()] == ["a.cob", "b.cob"]
    made = {r.name: r.text for r in tools.package(files).collect()}
    assert {"one.cob", "two.cob", "CALL_GRAPH.txt"} <= set(made) and "ONE is an entry" in made["CALL_GRAPH.txt"]


def test_middleware():
    assert middleware.parse_cics("EXEC CICS LINK PROGRAM('SUB') COMMAREA(WS-C) END-EXEC") == ("LINK", "call", {"PROGRAM": "SUB", "COMMAREA": "WS-C"})
    assert middleware.parse_call("CALL 'CBLTDLI' USING FN PCB AREA SSA", {"FN": "ISRT"}) == middleware.SegmentCall("ISRT", "SSA", None, "AREA")
    assert sorted(middleware.stubs({"db2": True, "mq": False})) == ["db2_interface.py"]


def test_exports_and_commands(spark, tmp_path):
    (tmp_path / "one.cob").write_text(SOURCE.replace("MOVE 1 TO A.", "CALL 'SUB'. MOVE 1 TO A."))
    statements = corpus.facts(spark, str(tmp_path))
    items = spark.createDataFrame([("ONE", "CUST-SSN", "9(9)", 1)], "program string, name string, picture string, item_no int")
    maps = exports.software_map(statements, items)
    shown = {r.program: r.markdown for r in exports.to_markdown(maps).collect()}
    assert "| HIGH | CUST-SSN |" in shown["ONE"] and "| FIRST-PAR | SUB |" in shown["ONE"] and "Provide the programs" in shown["ONE"]
    assert {r.program: r.brief for r in exports.briefs(statements, items).collect()}["ONE"].startswith("PROGRAM ONE\nDATA\nCUST-SSN 9(9)\nPROCEDURE\n")
    points = spark.createDataFrame([(3, "TODO GO TO X"), (1, "TODO MOVE Y")], "line int, text string")
    assert {r.category: r.points for r in exports.review_report(points).collect()} == {"Control Flow": ["- Line 3: TODO GO TO X"], "Data Movement": ["- Line 1: TODO MOVE Y"]}
    assert len(command.answer(spark, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 7
    said = command.answer(spark, {"id": 2, "method": "tools/call", "params": {"name": "calls", "arguments": {"folder": str(tmp_path)}}})
    assert json.loads(said["result"]["content"][0]["text"]) == {"caller": "ONE", "callee": "SUB"}
    assert command.answer(spark, {"id": 3, "method": "none"})["error"]["code"] == -32601 and command.answer(spark, {"method": "x"}) is None
    assert corpus.project_middleware(statements).first().asDict() == {"db2": False, "cics": False, "dli": False, "mq": False}
    assert command.main([]) == 2 and F is not None
