"""Languages of documents and of the segments in them, by a string kernel.

A segment is the set of its character n-grams (one to three characters, a blended spectrum of presences). The kernel of
two segments is the cosine of their sets. Landmarks from a bounded sample of labelled documents span a Nystroem
approximation, on which one-versus-rest kernel ridge regression is solved. Since the kernel is linear in presences, landmarks
and coefficients fold into one small matrix, and a batch of segments is scored by one matrix product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import arrays

LANGUAGES = ("en", "zh", "de", "fr", "es", "ja")
#: Hashed n-grams; landmarks; labelled documents a language in the sample that is fitted on; segments taken of each.
GRAMS, LANDMARKS, SAMPLE, SEGMENTS = 1 << 13, 240, 120, 3
RIDGE = 1e-2
#: Sharpness of the confidence: softmax of the scores times this.
SHARP = 4.0
#: Characters of a document, and of one of its segments, that are read to fit the kernel.
FIT_CHARS, FIT_SEGMENT = 6000, 1500
#: What a segment needs to count as foreign, or for its version's main language while others have it: letters (one
#: Chinese or Japanese character counts as three), and confidence. Every segment has its language whatever these are.
LEAST_LETTERS, LEAST_CONFIDENCE = 12, 0.71

# Codes of the six languages with two and with three letters.
CODES = {
    "en": "en", "eng": "en", "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "de": "de", "deu": "de", "ger": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es", "ja": "ja", "jpn": "ja",
}


def label_language(col: Column) -> Column:
    """The language that a label names, as a two-letter code; null if it names none of the six."""
    code = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), code)


_FENCE = re.compile(r"^\s*(```|~~~)")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_CODE = re.compile(r"""^\s*(?:[-*]\s+)?[\w.\-"']+\s*[:=]\s*["'\[{]?[\w.\-/]*["'\]}]?[,;]?\s*$|^\s*[{}\[\]()]+[,;]?\s*$|^\s*(?:\#!|\$ |//|<[/?!\w]).*$|[{};]\s*$|^\s*(?:def|class|import|return|if|for|while|SELECT|FROM|WHERE)\b.*[:();]\s*$""")


def segments_of(text: str) -> list[tuple[str, bool]]:
    """The blocks between empty lines, and whether each can have a language: code, tables and fenced blocks have none."""
    out, fenced = [], False
    for block in text.split("\n\n"):
        lines = [x for x in block.split("\n") if x.strip()]
        marks = sum(1 for x in lines if _FENCE.match(x))
        inside = fenced or bool(lines and _FENCE.match(lines[0]))
        if marks % 2:
            fenced = not fenced
        code = sum(1 for x in lines if _TABLE.match(x) or _CODE.match(x))
        out.append((block, bool(lines) and not inside and code * 2 <= len(lines)))
    return out


def _presences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of n-gram presences (texts by GRAMS), and the letters of each text."""
    kinds, lower, _ = arrays.tables()
    points, begin = arrays.code_points(texts)
    flat = np.where(points > 0xFFFF, 0, points)
    kind = kinds[flat]
    letter = ((kind == arrays.WORD) & ~((points >= 48) & (points <= 57))) | (kind == arrays.IDEO)
    c = np.where(letter, lower[flat], 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    gram, grams = c * np.uint64(0x9E3779B1), []
    owners = []
    for n in (1, 2, 3):
        if n > 1:
            gram = (gram[:-1] * np.uint64(0x85EBCA6B)) ^ (c[n - 1 :] * np.uint64(0x9E3779B1) + np.uint64(n))
        size = len(c) - n + 1
        some = letter[:size].copy()
        for k in range(1, n):
            some |= letter[k : k + size]
        some &= owner[:size] == owner[n - 1 : n - 1 + size]
        g = gram[:size][some]
        grams.append(((g ^ (g >> np.uint64(15))) * np.uint64(0xC2B2AE35) >> np.uint64(8)) & np.uint64(GRAMS - 1))
        owners.append(owner[:size][some])
    rows = np.zeros((len(texts), GRAMS), np.uint8)
    rows[np.concatenate(owners), np.concatenate(grams).astype(np.int64)] = 1
    letters = np.bincount(owner, letter * np.where(kind == arrays.IDEO, 3, 1), len(texts))
    return rows, letters


@dataclass
class Kernel:
    """weights: GRAMS by languages, landmarks and ridge coefficients folded together."""

    weights: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, letters = _presences(texts)
        x = rows.astype(np.float32)
        size = np.sqrt(np.maximum(x.sum(1), 1))
        return (x @ self.weights) / size[:, None], letters


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit_kernel(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, seed: int = 3) -> Kernel:
    """Kernel ridge regression of the labelled segments on landmarks drawn evenly from the languages."""
    x = _unit(_presences(texts)[0])
    y = np.array([[1.0 if lab == k else -1.0 for k in LANGUAGES] for lab in labels])
    order = np.random.default_rng(seed).permutation(len(texts))
    chosen: list[int] = []
    for k in LANGUAGES:
        own = [i for i in order if labels[i] == k]
        chosen += own[: max(1, landmarks // len(LANGUAGES))]
    base = x[chosen]
    km = (base @ base.T).astype(np.float64)
    kn = (x @ base.T).astype(np.float64)
    balance = np.array([1.0 / max(1, labels.count(lab)) for lab in labels])[:, None] * len(labels) / len(LANGUAGES)
    left = kn.T @ (balance * kn) + RIDGE * len(texts) / 100 * km + 1e-6 * np.eye(len(chosen))
    return Kernel((base.T @ np.linalg.solve(left, kn.T @ (balance * y))).astype(np.float32))


def training_segments(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Segments of about sample documents of each language, chosen by a hash of doc_id among those with a label."""
    rows = documents.withColumn("label", label_language(F.col("lang"))).where("label is not null and doc_id is not null")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    part = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * sample / n)))]) if counts else None
    if part is None:
        return [], []
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1_000_000
    picked = rows.where((draw < part[F.col("label")]) & (F.length("text") >= 60)).select("label", F.substr(F.col("text"), F.lit(1), F.lit(FIT_CHARS)).alias("text"))
    texts, labels, used = [], [], dict.fromkeys(counts, 0)
    for r in picked.limit(len(counts) * sample * 2).collect():
        if used[r.label] >= sample:
            continue
        used[r.label] += 1
        blocks = [b for b, ok in segments_of(r.text) if ok and len(b) >= 40]
        for b in blocks[-SEGMENTS:]:
            texts.append(b[:FIT_SEGMENT])
            labels.append(r.label)
    return texts, labels


_SCORED = "version_pk string, chunk_id string, langs array<string>, confidence array<float>, letters array<int>, sizes array<int>"


def _classify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(shared.value)
        trained = bool(kernel.weights.any())
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                blocks = [segments_of(t) if t else [] for t in part.column("text").to_pylist()]
                flat = [(i, s) for i, x in enumerate(blocks) for s, ok in x if ok]
                langs: list[list] = [[None] * len(x) for x in blocks]
                sure: list[list] = [[None] * len(x) for x in blocks]
                many: list[list] = [[0] * len(x) for x in blocks]
                sizes = [[len(s.encode("utf-8", "replace")) for s, _ in x] for x in blocks]
                if flat:
                    best, trust, size = [], [], []
                    for lo in range(0, len(flat), 256):
                        score, letters = kernel.scores([s for _, s in flat[lo : lo + 256]])
                        e = np.exp(SHARP * (score - score.max(1, keepdims=True)))
                        p = e.max(1) / e.sum(1)
                        best += [LANGUAGES[k] if n and trained else None for k, n in zip(score.argmax(1), letters)]
                        trust += p.tolist()
                        size += letters.astype(int).tolist()
                    k = 0
                    for i, x in enumerate(blocks):
                        for j, (_, ok) in enumerate(x):
                            if ok:
                                langs[i][j], sure[i][j], many[i][j] = best[k], trust[k] if best[k] else None, size[k]
                                k += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("version_pk"), part.column("chunk_id"), pa.array(langs, pa.list_(pa.string())), pa.array(sure, pa.list_(pa.float32())), pa.array(many, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))],
                    names=["version_pk", "chunk_id", "langs", "confidence", "letters", "sizes"],
                )

    return run


def segment_languages(spark: SparkSession, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(version_pk, chunk_id, seg_no, lang, confidence, letters, size): each block between empty lines; size in bytes.

    lang is null only for what has no language: code, tables, and blocks without a letter. Null and empty texts have no
    blocks. Exact duplicates of a chunk count once. Without any labelled document nothing can be told and lang is null
    throughout.
    """
    texts, labels = training_segments(documents)
    weights = fit_kernel(texts, labels).weights if texts else np.zeros((GRAMS, len(LANGUAGES)), np.float32)
    rows = chunks.select("version_pk", "chunk_id", "text").mapInArrow(_classify(spark.sparkContext.broadcast(weights)), _SCORED)
    rows = rows.dropDuplicates(["version_pk", "chunk_id"])
    each = F.posexplode(F.arrays_zip("langs", "confidence", "letters", "sizes"))
    return rows.select("version_pk", "chunk_id", each.alias("pos", "s")).select(
        "version_pk", "chunk_id", (F.col("pos") + 1).cast("int").alias("seg_no"), F.col("s.langs").alias("lang"), F.col("s.confidence").alias("confidence"),
        F.col("s.letters").alias("letters"), F.col("s.sizes").alias("size"),
    )


def _sure(letters: int, confidence: float) -> Column:
    return (F.col("letters") >= letters) & (F.col("confidence") >= confidence)


def version_languages(segments: DataFrame, letters: int = LEAST_LETTERS, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(version_pk, lang, confidence, sure): the language of most of a version's text; ties go to the first in the alphabet.

    Segments of so many letters and so much confidence decide; where a version has none, all its segments do, and sure
    is false.
    """
    known = segments.where("lang is not null").withColumn("sure", _sure(letters, confidence))
    sums = known.groupBy("version_pk", "sure", "lang").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("confidence")).alias("trust"))
    top = sums.groupBy("version_pk", "sure").agg(F.min(F.struct((-F.col("size")).alias("less"), "lang", "trust")).alias("t"), F.sum("size").alias("every"))
    best = top.groupBy("version_pk").agg(F.max_by(F.struct("t", "every"), "sure").alias("b"), F.max("sure").alias("sure"))
    return best.select("version_pk", "b.t.lang", F.round(F.col("b.t.trust") / F.col("b.every"), 4).alias("confidence"), "sure")


def version_labels(jobs: DataFrame) -> DataFrame:
    """(version_pk, label): the language that the deliveries of a version name; null if none does."""
    return jobs.where("version_pk is not null").groupBy("version_pk").agg(F.max(label_language(F.col("language"))).alias("label"))


def wrong_labels(segments: DataFrame, jobs: DataFrame, letters: int = LEAST_LETTERS, confidence: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Versions whose label is missing or wrong, and segments (of so many letters and so much confidence) in another than
    the main language of their version. Versions without a segment of that kind (character strings, numbers) are left out."""
    main = version_languages(segments, letters, confidence).where("sure")
    labelled = main.join(version_labels(jobs), "version_pk", "left")
    wrong = labelled.where(~F.col("label").eqNullSafe(F.col("lang"))).select("version_pk", "lang", "confidence")
    foreign = segments.where("lang is not null").where(_sure(letters, confidence))
    other = foreign.join(main.select("version_pk", F.col("lang").alias("main")), "version_pk").where("lang <> main")
    return wrong, other.select("version_pk", "chunk_id", "seg_no", "lang", "confidence")
