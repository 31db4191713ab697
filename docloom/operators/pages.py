"""Pages of documents: windows over short neighbours and over groups of pages, and excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.running import numbered
from docloom.operators.text import estimate_tokens, strip

SAFE, SHORT, PART = 1400, 120, 6


def text_pages(chunks: DataFrame) -> DataFrame:
    """(version_pk, page, rn, text): the pages with text of each version, numbered in order; exact duplicates once."""
    page = F.coalesce("page_no", "page_span.first", "ordinal")
    rows = chunks.where((F.col("chunk_type") == "page_text_chunk") & (strip(F.coalesce("text", F.lit(""))) != "")).select("version_pk", "chunk_id", page.alias("page"), "text").dropDuplicates(["version_pk", "chunk_id"])
    return numbered(rows, ["version_pk"], ["page", "chunk_id"], "rn", "text-pages").select("version_pk", "page", "rn", "text")


def short_windows(pages: DataFrame, safe: int = SAFE, short: int = SHORT) -> DataFrame:
    """(version_pk, rn, first, last, text): neighbours that together are within the limit, one of them short."""
    after = pages.select("version_pk", (F.col("rn") - 1).alias("rn"), F.col("page").alias("next_page"), F.col("text").alias("next_text"))
    rows = pages.join(after, ["version_pk", "rn"])
    text = F.concat("text", F.lit("\n\n"), "next_text")
    one_short = (estimate_tokens(F.col("text")) < short) | (estimate_tokens(F.col("next_text")) < short)
    return rows.where(one_short & (estimate_tokens(text) <= safe)).select("version_pk", "rn", F.col("page").alias("first"), F.col("next_page").alias("last"), text.alias("text"))


def part_windows(pages: DataFrame, safe: int = SAFE, part: int = PART) -> DataFrame:
    """(version_pk, part, first, last, pages, text): groups of so many pages, two at least, together within the limit."""
    number = F.floor((F.col("rn") - 1) / part)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]), "\n\n")
    rows = pages.groupBy("version_pk", number.alias("part")).agg(F.min_by("page", "rn").alias("first"), F.max_by("page", "rn").alias("last"), F.count("*").alias("pages"), texts.alias("text"))
    return rows.where((F.col("pages") >= 2) & (estimate_tokens(F.col("text")) <= safe))


def excerpt(chunks: DataFrame, max_chunks: int = 3, max_chars: int = 2400) -> DataFrame:
    """(version_pk, chunk_id, n): first chunks of each version with text, until the characters would pass the limit; the
    first is always kept."""
    rows = chunks.where(strip(F.coalesce("text", F.lit(""))) != "").dropDuplicates(["version_pk", "chunk_id"])
    order = Window.partitionBy("version_pk").orderBy("ordinal", "chunk_id")
    rows = rows.select("version_pk", "chunk_id", "ordinal", F.length("text").alias("size")).withColumn("n", F.row_number().over(order))
    rows = rows.where(F.col("n") <= max_chunks).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("n") == 1) | (F.col("upto") <= max_chars)).select("version_pk", "chunk_id", "n")
