"""Cutting oversized texts at natural boundaries, range by range.

A text, or a file of any size, is seen as ranges. Tasks measure each range with a halo of a few characters on either
side; the measures are put together by prefix sums in two levels, so that no task sees a whole text. Once a range knows
what lies before it, its task finds the best boundary below each multiple of the step; the best over the ranges is one
aggregate, which needs no pass from left to right, and the pieces are put together from the ranges that they touch. Ranges
are read anew for each of these steps (files by seeking), not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.io import materialize, parallelism
from docloom.llm import arrays

#: A token by the offline estimate: four characters after white space is collapsed.
CHARS_A_TOKEN = 4
LIMIT_TOKENS, OVERLAP_TOKENS = 1400, 50
#: Characters (bytes for files) of a range, its halo, and ranges whose sums are put together at once.
RANGE, HALO, STITCH = 8192, 4, 1024
#: Kinds of boundary, best last.
ANYWHERE, SPACE, SENTENCE, LINE, BLOCK = range(5)
_RANGE_ROW = "item string, no long, before string, text string, after string"
_MEASURED = "item string, no long, size long, kept long, ends_blank boolean"
_CUTS = "item string, cut long, level int, kept long, at long"


def estimated_tokens(text: Column) -> Column:
    """Tokens by the offline estimate of a text that is not cut (null for null)."""
    s = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.ceil(F.length(s) / CHARS_A_TOKEN)


def _rows(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows one after another: a batch of large ranges is never a list of strings as a whole."""
    return (tuple(x.as_py() for x in row) for row in zip(*(b.column(n) for n in names)))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
            text = text or ""
            at = range(0, max(1, len(text)), RANGE)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(at), pa.string()), pa.array(range(len(at)), pa.int64()), pa.array([text[max(0, a - HALO) : a] for a in at], pa.string()),
                 pa.array([text[a : a + RANGE] for a in at], pa.string()), pa.array([text[a + RANGE : a + RANGE + HALO] for a in at], pa.string())],
                names=["item", "no", "before", "text", "after"],
            )


def text_ranges(items: DataFrame) -> DataFrame:
    """Ranges of the texts of (item, text), cut in one pass over each text."""
    return items.select("item", "text").mapInArrow(_cut_texts, _RANGE_ROW)


def read_range(uri: str, lo: int, n: int) -> bytes:
    """n bytes from place lo of a file on any file system that Arrow knows: local, HDFS, S3 and others."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else uri.replace("file:", "file://", 1))
    with system.open_input_file(path) as f:
        return f.read_at(n, lo)


def _decoded(item: str, no: int, size: int) -> tuple[str, str, str]:
    """Halo, text and halo of one range of a file."""
    lo = max(0, no * size - 4 * HALO)
    raw = read_range(item, lo, no * size - lo + size + 4 * HALO)
    first, last = no * size - lo, no * size - lo + size
    while first < len(raw) and first > 0 and raw[first] & 0xC0 == 0x80:
        first += 1
    while last < len(raw) and raw[last] & 0xC0 == 0x80:
        last += 1
    before, text, after = (raw[a:z].decode("utf-8", "replace") for a, z in ((0, first), (first, last), (last, len(raw))))
    return before[-HALO:], text, after[:HALO]


def _with_texts(rows: DataFrame, size: int) -> DataFrame:
    """Rows (item, no, ...) of ranges of files with before, text and after, read where the row is."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.StringType()) for c in ("before", "text", "after")]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (item, no) in enumerate(_rows(b, "item", "no")):
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, *(pa.array([x], pa.string()) for x in _decoded(item, no, size))], names=[*names, "before", "text", "after"])

    return rows.mapInArrow(read, schema)


def _file_parts(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(item, no): the ranges of all files, spread over tasks; a number of tasks of its own, for the rows are too small for the
    planner to spread them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("item"), "length")
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("long")
    parts = files.select("item", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("no"))
    return parts.repartition(max(parallelism(spark), -(-parts.count() // 64)), "item", "no")


def file_ranges(spark: SparkSession, path: str, size: int = 1 << 22) -> DataFrame:
    """Byte ranges of the UTF-8 files under path.

    A task opens a file, seeks, and reads one range and its halo: no file is loaded whole. A character belongs to the
    range in which its first byte lies. Malformed bytes become replacement characters.
    """
    return _with_texts(_file_parts(spark, path, size), size).select("item", "no", "before", "text", "after")


def file_pieces(spark: SparkSession, path: str, size: int = 1 << 22, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """The pieces of the UTF-8 files under path, as pieces gives them. What is known of a range goes to it before it is read
    again, so that texts are shuffled only as parts of pieces."""

    def attach(rows: DataFrame) -> DataFrame:
        tasks = max(parallelism(spark), -(-rows.count() // 64))
        return _with_texts(rows.repartition(tasks, "item", "no"), size)

    return pieces(file_ranges(spark, path, size), limit, overlap, attach)


def _kept(before: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of halo and range, their classes, and how many characters of the range stay, once white space is
    collapsed, before each of them and in all."""
    kinds, _, _ = arrays.tables()
    points, _ = arrays.code_points([before + text])
    points = points[:-1]
    kind = kinds[np.where(points > 0xFFFF, 0, points)]
    a = len(before)
    blank = (kind == arrays.SPACE) | (kind == arrays.LINE)
    prior = np.concatenate([[True], blank[:-1]]) if a == 0 else np.concatenate([[blank[0]], blank[:-1]])
    return kind, blank, np.concatenate([[0], np.cumsum(~(blank & prior)[a:])])


def _boundaries(before: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a range may be cut: place, characters that stay before it, kind of boundary."""
    kind, blank, kept = _kept(before, text)
    a, n = len(before), len(text)
    level = np.full(n + 1, -1, np.int8)
    level[:: 64] = ANYWHERE
    here = np.arange(a, a + n)
    # a boundary lies before a character that follows white space
    soft = here[(here > 0) & ~blank[here] & blank[here - 1]]
    level[soft - a] = SPACE
    stop = np.isin(kind, (arrays.STOP, arrays.IDEO_STOP))
    near = lambda back: np.where(soft >= back, soft - back, 0)
    level[soft[stop[near(2)] & (soft >= 2)] - a] = SENTENCE
    ideo = here[(here > 0)][kind[here[here > 0] - 1] == arrays.IDEO_STOP]
    level[ideo - a] = SENTENCE
    newline = kind == arrays.LINE
    level[soft[newline[near(1)]] - a] = LINE
    level[soft[newline[near(1)] & newline[near(2)] & (soft >= 2)] - a] = BLOCK
    level[n] = -1
    at = np.flatnonzero(level >= 0)
    return at, kept[at], level[at]


def _measures(before: str, text: str) -> tuple[int, int, bool]:
    _, blank, kept = _kept(before, text)
    return len(text), int(kept[-1]), bool(text and blank[-1])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [_measures(x.as_py() or "", t.as_py() or "") for x, t in zip(b.column("before"), b.column("text"))]
        size, kept, blank = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("item"), b.column("no"), pa.array(size, pa.int64()), pa.array(kept, pa.int64()), pa.array(blank, pa.bool_())], names=["item", "no", "size", "kept", "ends_blank"])


def _best_cuts(step: int, slack: int):
    """Of each range, the best boundary below each multiple of the step: the best kind wins, then the latest place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for item, before, text, size0, kept0 in _rows(b, "item", "before", "text", "size_before", "kept_before"):
                at, kept, level = _boundaries(before or "", text or "")
                kept = kept + kept0
                cut = -(-kept // step)
                near = np.flatnonzero((cut > 0) & (cut * step - kept < slack))
                near = near[np.lexsort((at[near], kept[near], level[near], cut[near]))]
                last = np.flatnonzero(np.diff(cut[near], append=-1))
                for c, v in zip(out, ([item] * len(last), cut[near][last], level[near][last], kept[near][last], at[near][last] + size0)):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["item", "cut", "level", "kept", "at"])

    return run


def measured(ranges: DataFrame) -> DataFrame:
    """(item, no, size, kept, ends_blank): the measures of each range."""
    return ranges.mapInArrow(_measure, _MEASURED)


def item_tokens(ranges: DataFrame) -> DataFrame:
    """(item, tokens): the offline estimate of each whole item, from the sums of its ranges."""
    sums = ranges.groupBy("item").agg(F.sum("kept").alias("kept"), F.max_by("ends_blank", "no").alias("ends_blank"))
    chars = F.greatest(F.lit(0), F.col("kept") - F.col("ends_blank").cast("int"))
    return sums.select("item", F.ceil(chars / CHARS_A_TOKEN).alias("tokens"))


def stitched(ranges: DataFrame) -> DataFrame:
    """Ranges with what lies before them in their item: size_before and kept_before, by prefix sums in two levels."""
    block = F.floor(F.col("no") / STITCH)
    rows = ranges.withColumn("block", block)
    sums = rows.groupBy("item", "block").agg(F.sum("size").alias("s"), F.sum("kept").alias("k"))
    earlier = Window.partitionBy("item").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("item", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "sk"])
    inside = Window.partitionBy("item", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumns({"s1": F.coalesce(F.sum("size").over(inside), F.lit(0)), "k1": F.coalesce(F.sum("kept").over(inside), F.lit(0))})
    return both.join(blocks, ["item", "block"]).select("item", "no", "size", "kept", (F.col("s0") + F.col("s1")).alias("size_before"), (F.col("k0") + F.col("k1")).alias("kept_before"))


def piece_bounds(attach: Callable[[DataFrame], DataFrame], places: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(item, piece, first, last, at): pieces from first to last (code points from the item's start); at is where the overlap ends.

    attach: gives rows (item, no, ...) the texts of their ranges; places: the stitched measures; limit and overlap are in estimated tokens. Cuts lie at most a slack of a
    fifth of the room below multiples of the step, and step + slack + overlap is the limit: no piece can be longer.
    """
    room = (limit - overlap) * CHARS_A_TOKEN
    step = max(64, room * 4 // 5)
    slack = room - step - 1
    placed = attach(places.select("item", "no", "size_before", "kept_before"))
    cuts = placed.select("item", "before", "text", "size_before", "kept_before").mapInArrow(_best_cuts(step, slack), _CUTS)
    best = cuts.groupBy("item", "cut").agg(F.max(F.struct("level", "kept", "at")).alias("b")).select("item", "cut", F.col("b.at").alias("at"))
    whole = places.groupBy("item").agg(F.sum("size").alias("size"))
    inner = best.join(whole, "item").where(F.col("at") < F.col("size")).select("item", F.col("cut").alias("piece"), "at")
    starts = inner.unionByName(whole.select("item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("at")))
    ends = inner.select("item", (F.col("piece") - 1).alias("piece"), F.col("at").alias("last"))
    spans = starts.join(ends, ["item", "piece"], "left").join(whole, "item")
    return spans.select("item", "piece", F.greatest(F.lit(0), F.col("at") - overlap * CHARS_A_TOKEN).alias("first"), F.coalesce("last", "size").alias("last"), "at")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part that each range gives to each of its pieces."""
    for b in batches:
        for item, no, text, parts in _rows(b, "item", "no", "text", "parts"):
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * n, pa.string()), pa.array([p["piece"] for p in parts], pa.int64()), pa.array([no] * n, pa.int64()), pa.array([text[p["lo"] : p["hi"]] for p in parts], pa.string())],
                names=["item", "piece", "no", "part"],
            )


def pieces(ranges: DataFrame, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS, attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(item, piece_no, first, last, text): each item of (item, no, before, text, after) as pieces within the limit.

    Every character of an item stands in a piece, in order. A piece begins with the last words of the one before it, at
    most overlap tokens of them. White space at the ends of a piece is stripped. Empty items give one empty piece.
    """
    # never a broadcast of the ranges: their texts look small to the planner, for they are cut behind it
    attach = attach or (lambda rows: ranges.hint("merge").join(rows, ["item", "no"]))
    stitch = materialize(stitched(measured(ranges)), "piece-places")
    spans = materialize(piece_bounds(attach, stitch, limit, overlap), "piece-bounds")
    places = stitch.select("item", "no", "size_before", (F.col("size_before") + F.col("size")).alias("size_after"))
    # a piece touches few ranges: step and range are of one order of size, so ranges are met through equal cells of RANGE
    cell = lambda c: F.floor(c / RANGE).cast("long")
    wanted = spans.select("*", F.explode(F.sequence(cell(F.col("first")), cell(F.greatest(F.col("first"), F.col("last") - 1)))).alias("cell"))
    offered = places.select("*", F.explode(F.sequence(cell(F.col("size_before")), cell(F.greatest(F.col("size_before"), F.col("size_after") - 1)))).alias("cell"))
    touch = (F.col("size_before") < F.col("last")) & (F.col("size_after") > F.col("first"))
    met = wanted.join(offered, ["item", "cell"]).where(touch).dropDuplicates(["item", "piece", "no"])
    # a range is met once, with all the pieces that it gives a part to: as many as steps fit in it
    part = F.struct("piece", F.greatest(F.lit(0), F.col("first") - F.col("size_before")).alias("lo"), (F.least("last", "size_after") - F.col("size_before")).alias("hi"))
    asked = met.groupBy("item", "no").agg(F.collect_list(part).alias("parts"))
    texts = attach(asked).select("item", "no", "text", "parts").mapInArrow(_parts, "item string, piece long, no long, part string")
    whole = texts.groupBy("item", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"]), "").alias("text"))
    whole = whole.hint("merge").join(spans, ["item", "piece"])
    # the overlap begins at a word
    inside = (F.col("at") - F.col("first")).cast("int")
    lead = F.substr(F.col("text"), F.lit(1), inside)
    lead = F.when(F.col("first") > 0, F.regexp_replace(lead, r"(?U)^\S*\s+", "")).otherwise(lead)
    text = F.concat(lead, F.substr(F.col("text"), inside + 1))
    # every multiple of the step has its cut, for boundaries lie closer together than the slack: numbers have no gaps
    return whole.select("item", (F.col("piece") + 1).cast("int").alias("piece_no"), "first", "last", F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"))


def chunk_items(chunks: DataFrame) -> DataFrame:
    """(item, version_pk, chunk_id, ordinal, section_path, text): one row a chunk, exact duplicates once.

    item is the key in one string. Rows of one key that differ are not duplicates in the data; the longest text stands.
    """
    key = F.to_json(F.struct("version_pk", "chunk_id"))
    best = chunks.groupBy("version_pk", "chunk_id").agg(F.max(F.struct(F.length("text").alias("n"), "text", "ordinal", "section_path")).alias("b"))
    return best.select(key.alias("item"), "version_pk", "chunk_id", "b.ordinal", "b.section_path", "b.text")


def _may_exceed(chunks: DataFrame, limit: int) -> DataFrame:
    """Collapsing white space only shortens a text: shorter ones than this cannot exceed the limit."""
    return chunks.where(F.length("text") > limit * CHARS_A_TOKEN)


def oversized(chunks: DataFrame, limit: int = LIMIT_TOKENS) -> DataFrame:
    """(version_pk, chunk_id, tokens) of the chunks over the limit, whatever their token_estimate says. Null texts are not."""
    items = chunk_items(_may_exceed(chunks, limit))
    sizes = item_tokens(measured(text_ranges(items)))
    key = F.from_json("item", "version_pk string, chunk_id string")
    return sizes.where(F.col("tokens") > limit).select(key.alias("key"), "tokens").select("key.version_pk", "key.chunk_id", "tokens")


def split_chunks(chunks: DataFrame, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """The chunks over the limit as pieces: (version_pk, ordinal, chunk_id, piece_id, piece_no, section_path, token_estimate, text)."""
    over = oversized(chunks, limit).select("version_pk", "chunk_id")
    same = chunks["version_pk"].eqNullSafe(over["version_pk"]) & chunks["chunk_id"].eqNullSafe(over["chunk_id"])
    items = materialize(chunk_items(_may_exceed(chunks, limit).join(over, same, "left_semi")), "piece-items")
    cut = pieces(text_ranges(items), limit, overlap)
    keys = items.select("item", "version_pk", "chunk_id", "ordinal", "section_path")
    rows = cut.join(keys, "item")
    name = F.concat("chunk_id", F.format_string("#part%02d", "piece_no"))
    return rows.select("version_pk", "ordinal", "chunk_id", name.alias("piece_id"), "piece_no", "section_path", estimated_tokens(F.col("text")).cast("int").alias("token_estimate"), "text")
