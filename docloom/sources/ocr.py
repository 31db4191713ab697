"""Results of optical recognition, one JSON object a line, as Markdown pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.io import blank_to_null
from docloom.operators.running import numbered

_PART = "struct<layoutParsingResults: array<struct<markdown: struct<text: string>>>, markdown: struct<text: string>>"
LINE = f"result {_PART}, data {_PART}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(version_pk, line_no, payload): lines of JSONL files; a file is a version, its lines count from 1, blank ones too.

    Files are split between tasks like any text; a line's number is its place among those of its file, by the block of the
    file it lies in and its place there, so no task reads a whole file.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("version_pk"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("payload"))
    return numbered(rows, ["version_pk"], ["block", "at"], "line_no", "recognised-lines").select("version_pk", "line_no", "payload")


def line_markdown(lines: DataFrame) -> DataFrame:
    """(version_pk, line_no, markdown, error): the text of each line that is not blank.

    result goes before data; the texts of its layout parts are joined by empty lines, else its own text counts. A line
    that is no JSON object comes out with an error and no text.
    """
    kept = lines.where(F.col("payload").isNotNull() & (F.trim("payload") != ""))
    is_object = F.trim("payload").startswith("{") & F.try_parse_json("payload").isNotNull()
    parsed = F.from_json("payload", LINE)
    part = F.coalesce(parsed["result"], parsed["data"])
    texts = F.filter(F.transform(part["layoutParsingResults"], lambda x: x["markdown"]["text"]), lambda t: blank_to_null(t).isNotNull())
    text = F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, F.array_join(texts, "\n\n")).otherwise(part["markdown"]["text"])
    return kept.select("version_pk", "line_no", F.when(is_object, blank_to_null(text)).alias("markdown"), F.when(~is_object, F.lit("not an object")).alias("error"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """(version_pk, pages, markdown): the pages of each version joined by empty lines in order.

    One row is one document: its text has to fit a cell. Pages are sorted within the row, not gathered by a window.
    """
    rows = pages.where("markdown is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "markdown"))), lambda x: x["markdown"])
    return rows.groupBy("version_pk").agg(F.count("*").alias("pages"), F.array_join(ordered, "\n\n").alias("markdown"))
