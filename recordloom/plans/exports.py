"""What is known of programs, as JSON, Markdown and briefs: one document a program, made where its facts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.plans import corpus


def software_map(statements: DataFrame, items: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """A row a program: statistics, paragraphs, sensitive items, calls and warnings, as arrays in a fixed order."""
    paragraphs = statements.groupBy("program", "paragraph").agg(F.min("par_no").alias("par_no"), F.count("*").alias("statement_count"), F.sort_array(F.collect_set("verb")).alias("verbs"))
    paragraphs = paragraphs.groupBy("program").agg(F.array_sort(F.collect_list(F.struct("par_no", F.col("paragraph").alias("name"), "statement_count", "verbs"))).alias("paragraphs"))
    marked = items.withColumn("level", corpus.sensitivity(F.col("name"))).where("level IS NOT NULL")
    sensitive = marked.groupBy("program").agg(F.sort_array(F.collect_set(F.struct("level", "name"))).alias("sensitivities"))
    calls = statements.where("verb = 'CALL' AND target IS NOT NULL").groupBy("program").agg(F.sort_array(F.collect_set(F.struct(F.col("target").alias("call_target"), F.col("paragraph").alias("source_paragraph")))).alias("dependencies"))
    noted = corpus.warnings(statements, items).groupBy("program").agg(F.sort_array(F.collect_set("warning")).alias("warnings"))
    out = corpus.statistics(statements, lines, items)
    figures = [c for c in out.columns if c != "program"]
    out = out.select("program", F.struct(*figures).alias("statistics"))
    for part in (paragraphs, sensitive, calls, noted):
        out = out.join(part, "program", "left")
    return out


def to_json(maps: DataFrame) -> DataFrame:
    """program and its map as one JSON document; what there is none of is an empty list."""
    lists = [F.coalesce(F.col(c), F.array().cast(maps.schema[c].dataType)).alias(c) for c in ("paragraphs", "sensitivities", "dependencies", "warnings")]
    return maps.select("program", F.to_json(F.struct(F.col("program").alias("program_id"), "statistics", *lists)).alias("json"))


def _table(rows: Column, head: list[str], cells) -> Column:
    top = f"| {' | '.join(head)} |\n|{'---|' * len(head)}\n"
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), *[x for c in cells(r) for x in (c.cast("string"), F.lit(" | "))][:-1], F.lit(" |"))), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.concat(F.lit(top), body)).otherwise("None.")


def to_markdown(maps: DataFrame) -> DataFrame:
    """program and its map as a Markdown report: figures, paragraphs, sensitive items, calls, warnings and what to do next."""
    figures = [f.name for f in maps.schema["statistics"].dataType]
    stats = F.concat(*[F.concat(F.lit(f"- {n.replace('_', ' ')}: "), F.coalesce(F.col(f"statistics.{n}").cast("string"), F.lit("0")), F.lit("\n")) for n in figures])
    verbs = F.flatten(F.transform(F.coalesce("paragraphs", F.array().cast(maps.schema["paragraphs"].dataType)), lambda p: p["verbs"]))
    high = F.exists(F.coalesce("sensitivities", F.array().cast(maps.schema["sensitivities"].dataType)), lambda s: s["level"] == "HIGH")
    advice = F.array_compact(F.array(F.when(high, "Look at what is highly sensitive before any data is run through."), F.when(F.coalesce(F.size("dependencies"), F.lit(0)) > 0, "Provide the programs that are called."), F.when(F.array_contains(verbs, "GO"), "Jumps need another shape: they can't be lowered.")))
    parts = [
        F.lit("# "), F.col("program"), F.lit("\n\n## Figures\n\n"), stats,
        F.lit("\n## Paragraphs\n\n"), _table(F.col("paragraphs"), ["Paragraph", "Statements", "Verbs"], lambda r: [r["name"], r["statement_count"], F.array_join(r["verbs"], ", ")]),
        F.lit("\n\n## Sensitive items\n\n"), _table(F.col("sensitivities"), ["Level", "Item"], lambda r: [r["level"], r["name"]]),
        F.lit("\n\n## Calls\n\n"), _table(F.col("dependencies"), ["Paragraph", "Program"], lambda r: [r["source_paragraph"], r["call_target"]]),
        F.lit("\n\n## Warnings\n\n"), F.when(F.coalesce(F.size("warnings"), F.lit(0)) > 0, F.concat(F.lit("- "), F.array_join("warnings", "\n- "))).otherwise("None."),
        F.lit("\n\n## Next\n\n"), F.when(F.size(advice) > 0, F.concat(F.lit("- "), F.array_join(advice, "\n- "))).otherwise("Nothing stands out."), F.lit("\n"),
    ]
    return maps.select("program", F.concat(*parts).alias("markdown"))


def briefs(statements: DataFrame, items: DataFrame, most: int = 40) -> DataFrame:
    """program and a short text of it for a language model: its items, paragraphs with their verbs, and calls; `most` items and paragraphs each."""
    order = items.groupBy("program").agg(F.slice(F.array_sort(F.collect_list(F.struct("item_no", F.concat_ws(" ", "name", "picture").alias("t")))), 1, most).alias("d"))
    made = statements.groupBy("program", "par_no", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stmt_no", "verb"))), lambda x: x["verb"]), " ").alias("verbs"))
    made = made.groupBy("program").agg(F.slice(F.array_sort(F.collect_list(F.struct("par_no", F.concat_ws(": ", "paragraph", "verbs").alias("t")))), 1, most).alias("p"))
    text = F.concat(F.lit("PROGRAM "), F.col("program"), F.lit("\nDATA\n"), F.coalesce(F.array_join(F.transform("d", lambda x: x["t"]), "\n"), F.lit("")), F.lit("\nPROCEDURE\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n"))
    return made.join(order, "program", "left").select("program", text.alias("brief"))


def review_report(points: DataFrame) -> DataFrame:
    """category, n and the points (line, text) of a review in order, from open points (line, text)."""
    found = corpus.review(points)
    return found.groupBy("category").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.concat(F.lit("- Line "), x["line"].cast("string"), F.lit(": "), x["text"])).alias("points"))


def write_documents(documents: DataFrame, folder: str) -> str:
    """One text file a program below a folder: the documents' second column, by program."""
    text = documents.columns[1]
    documents.select("program", F.col(text).alias("value")).write.mode("overwrite").partitionBy("program").text(folder)
    return folder
