"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.io import materialize, new_path, table
from docloom.llm.languages import segment_languages, version_languages, wrong_labels
from docloom.llm.leaks import leaked_items
from docloom.llm.levels import reading_levels
from docloom.llm.mixture import mixture
from docloom.llm.pieces import file_pieces, oversized, split_chunks
from docloom.llm.scans import page_noise, paragraphs, repaired_pages


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise(repaired_pages(spark, table(spark, sf_dir, "chunks")))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(repaired_pages(spark, table(spark, sf_dir, "chunks")))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_languages(spark, table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"))


def p2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_languages(p2_segments(spark, sf_dir))


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = materialize(p2_segments(spark, sf_dir), "segments")
    wrong, other = wrong_labels(segments, table(spark, sf_dir, "extract_jobs"))
    head = wrong.select("version_pk", F.lit("*").alias("chunk_id"), F.lit(0).alias("seg_no"), "lang", "confidence")
    return head.unionByName(other.select("version_pk", "chunk_id", "seg_no", "lang", "confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_languages(spark, sf_dir).select("version_pk", "chunk_id", "seg_no", "lang")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(table(spark, sf_dir, "chunks")).select("version_pk", "chunk_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(table(spark, sf_dir, "chunks"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each kind and language as text files, cut into pieces by byte ranges."""
    at = new_path(spark, "corpus-files")
    kind = F.concat_ws("-", F.coalesce("doc_type", F.lit("none")), F.coalesce("lang", F.lit("none")))
    texts = table(spark, sf_dir, "documents").where("text is not null").select(kind.alias("kind"), F.concat("text", F.lit("\n")).alias("value"))
    texts.write.partitionBy("kind").text(at)
    cut = file_pieces(spark, at, 1 << 18)
    return cut.select(F.regexp_extract("item", "kind=([^/]*)", 1).alias("kind"), "piece_no", "first", "last", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("n_chars >= 200").select("doc_id", "grade").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p2_found": p2_found,
    "p2_languages": p2_languages,
    "p2_segments": p2_segments,
    "p2_versions": p2_versions,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_files": p5_files,
    "p6_found": p6_found,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

SQL: dict[str, str] = {
    "p5_found": """
select distinct version_pk, chunk_id from chunks
where ceil(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 4.0) > 1400
""",
}
