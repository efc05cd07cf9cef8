"""Command line and JSON-RPC over standard input: python -m recordloom <command> [argument …], or python -m recordloom serve."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans import copying, corpus, exports, tools


def _files(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike("\\.(cob|cbl|cobol|cpy|copy)$"))
    return found.select("path", F.col("content").cast("string").alias("text"))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Statements of all programs below a folder."""
    return corpus.facts(spark, folder)


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Which program calls which."""
    return corpus.call_graph(corpus.facts(spark, folder))[0]


def warn(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings of all programs."""
    return corpus.warnings(corpus.facts(spark, folder))


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """What can't be lowered."""
    return tools.validate(_files(spark, folder))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of every paragraph."""
    return corpus.fingerprints(corpus.facts(spark, folder))


def report(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown report of every program."""
    statements = corpus.facts(spark, folder)
    items = statements.select("program", F.lit("").alias("name")).where("false")
    return exports.to_markdown(exports.software_map(statements, items))


def expand(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with their copybooks in place."""
    return copying.expand_files(_files(spark, folder), _files(spark, folder))


COMMANDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (facts, calls, warn, validate, fingerprints, report, expand)}


def answer(spark: SparkSession, request: dict) -> dict | None:
    """One JSON-RPC request: initialize, tools/list and tools/call; a notification has no answer."""
    method, key = request.get("method"), request.get("id")
    if key is None:
        return None
    try:
        if method == "initialize":
            result: object = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "recordloom", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": f.__doc__, "inputSchema": {"type": "object", "properties": {"folder": {"type": "string"}}, "required": ["folder"]}} for n, f in COMMANDS.items()]}
        elif method == "tools/call":
            call = request["params"]
            rows = COMMANDS[call["name"]](spark, call["arguments"]["folder"]).limit(int(call["arguments"].get("rows", 1000))).collect()
            result = {"content": [{"type": "text", "text": "\n".join(json.dumps(r.asDict(True), default=str) for r in rows)}]}
        else:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"no method {method}"}}
    except Exception as error:  # the server outlives a failed call
        return {"jsonrpc": "2.0", "id": key, "error": {"code": -32000, "message": f"{type(error).__name__}: {error}"[:500]}}
    return {"jsonrpc": "2.0", "id": key, "result": result}


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] not in {*COMMANDS, "serve"} or arguments[0] != "serve" and len(arguments) != 2:
        print(f"usage: python -m recordloom {'|'.join(COMMANDS)} FOLDER, or serve", file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if arguments[0] != "serve":
        for row in COMMANDS[arguments[0]](spark, arguments[1]).toLocalIterator():
            print(json.dumps(row.asDict(True), default=str))
        return 0
    for line in sys.stdin:
        if line.strip() and (said := answer(spark, json.loads(line))):
            print(json.dumps(said), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
