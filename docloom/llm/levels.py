"""Reading level of documents: harmonic propagation of grades over the graph of documents and the words in them.

A document is tied to each of its words and word pairs, and to the shapes (lengths) of its sentences, by how often they
occur in it. Graded documents are clamped to their mean grade; every other node, document or word, takes the weighted mean
of its neighbours, until no score of a word node moves by more than a tolerance. Words are hashed into a number of nodes
that the caller sets, so the scores of all word nodes are one array of bounded size: each step is one pass over the
documents' edges that sends partial sums a task, never an edge, through the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.io import materialize, parallelism
from docloom.llm import arrays

#: Hashed word nodes (a power of two; larger for larger vocabularies, words that share a node share its score), as many for
#: word pairs; sentence-shape nodes follow them. Bounds what is broadcast: two doubles a node, 2 MB.
WORDS, SHAPES = 1 << 16, 32
#: The iteration ends when no word node has moved by more than this on the scale from 1 to 3. Each step about halves what
#: is left, so the bound on the steps (an error, not a result) is never met by a graph that is sound.
TOLERANCE, MOST_STEPS = 0.01, 200
#: Cells of the histogram from which the cuts between grades are found.
CELLS = 400
_LANGS = ("en", "zh", "de", "fr", "es", "ja", "")
_GRAPH = "doc_id long, n_chars long, lang string, script string, grade double, sure int, nodes array<int>, weights array<float>"


def _nodes(words: int) -> int:
    return 2 * words + SHAPES


def _edges(texts: list[str | None], words: int = WORDS) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    """For each text its nodes, their weights, and the script most of it is in."""
    total = _nodes(words)
    t = arrays.tokenize(texts)
    first = arrays.sentence_starts(t)
    n = len(t.start)
    nodes, weights, scripts = [], [], []
    if not n:
        return [np.empty(0, np.int32)] * len(texts), [np.empty(0, np.float32)] * len(texts), [""] * len(texts)
    digit = (t.points[t.start] >= 48) & (t.points[t.start] <= 57)
    word = np.where(digit, 1, arrays.bins(t.hash, words))
    starts = np.flatnonzero(first)
    length = np.diff(np.append(starts, n))
    shape = 2 * words + np.minimum(np.log2(length) * 3, SHAPES - 1).astype(np.int64)
    inner = np.append(~first[1:], False)
    pair = words + arrays.bins(arrays.pairs(t), words)[inner]
    both = np.concatenate([word, pair, np.repeat(shape, length)])
    owner = np.concatenate([t.text, t.text[inner], t.text])
    key, count = np.unique(owner * total + both, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) * total)
    points = t.points[t.start]
    kana = np.bincount(t.text, (points >= 0x3040) & (points <= 0x30FF), len(texts))
    ideo = np.bincount(t.text, t.kind[t.start] == arrays.IDEO, len(texts))
    every = np.bincount(t.text, minlength=len(texts))
    for i in range(len(texts)):
        nodes.append((key[cut[i] : cut[i + 1]] % total).astype(np.int32))
        weights.append(count[cut[i] : cut[i + 1]].astype(np.float32))
        scripts.append("" if not every[i] else "ja" if kana[i] > 0.15 * every[i] else "zh" if ideo[i] > 0.4 * every[i] else "latin")
    return nodes, weights, scripts


def _graph(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                nodes, weights, scripts = _edges(part.column("text").to_pylist(), words)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "n_chars", "lang")] + [pa.array(scripts, pa.string())] + [part.column(c) for c in ("grade", "sure")]
                    + [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(nodes), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(weights), pa.float32()))],
                    names=["doc_id", "n_chars", "lang", "script", "grade", "sure", "nodes", "weights"],
                )

    return run


def mean_grades(samples: DataFrame) -> DataFrame:
    """(doc_id, grade, sure): mean of a document's grades; sure is their number where all agree, else 0."""
    known = samples.where("doc_id is not null and grade is not null")
    agree = F.when(F.min("grade") == F.max("grade"), F.count("*")).otherwise(0)
    return known.groupBy("doc_id").agg(F.avg("grade").alias("grade"), agree.cast("int").alias("sure"))


def graph(documents: DataFrame, samples: DataFrame, words: int = WORDS) -> DataFrame:
    """The document-word graph, one row a document with its edges. Null and empty texts have no edges.

    The grades are joined to the texts, not to the edges, which are larger; only where the grades are too many to be
    broadcast does the text go through a shuffle, once.
    """
    docs = documents.select("doc_id", F.coalesce("n_chars", F.length("text")).cast("long").alias("n_chars"), F.lower(F.trim("lang")).alias("lang"), "text")
    rows = docs.join(mean_grades(samples), "doc_id", "left").select("doc_id", "n_chars", "lang", "grade", "sure", "text")
    return rows.mapInArrow(_graph(words), _GRAPH)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = b.column("nodes")
    lengths = np.diff(nodes.offsets.to_numpy())
    owner = np.repeat(np.arange(b.num_rows), lengths)
    return owner, nodes.flatten().to_numpy(), b.column("weights").flatten().to_numpy().astype(np.float64)


def _document_scores(b: pa.RecordBatch, scores: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    owner, node, weight = _flat(b)
    w = weight * known[node]
    total = np.bincount(owner, w, b.num_rows)
    mean = np.bincount(owner, w * scores[node], b.num_rows) / np.maximum(total, 1e-12)
    return mean, total > 0, (owner, node, weight)


def _half_step(shared, nodes: int):
    """Partial sums a word node over a task's documents: weight and weighted score. Without scores, of graded documents alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, bottom = np.zeros(nodes), np.zeros(nodes)
        scores, known = shared.value if shared is not None else (None, None)
        for b in batches:
            if not b.num_rows:
                continue
            grade = b.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
            clamped = ~np.isnan(grade)
            if shared is None:
                owner, node, weight = _flat(b)
                value, has = np.where(clamped, grade, 0.0), clamped
            else:
                mean, has, (owner, node, weight) = _document_scores(b, scores, known)
                value, has = np.where(clamped, grade, mean), clamped | has
            w = weight * has[owner]
            bottom += np.bincount(node, w, nodes)
            top += np.bincount(node, w * value[owner], nodes)
        at = np.flatnonzero(bottom)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(top[at]), pa.array(bottom[at])], names=["node", "top", "bottom"])

    return run


def _word_scores(edges: DataFrame, shared, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each word node, and whether it has one: at most as many rows as nodes come to the driver."""
    sums = edges.mapInArrow(_half_step(shared, nodes), "node int, top double, bottom double").groupBy("node").agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    t = sums.toArrow()
    scores, known = np.zeros(nodes), np.zeros(nodes)
    node, top, bottom = (t.column(c).to_numpy() for c in ("node", "top", "bottom"))
    scores[node], known[node] = top / bottom, 1.0
    return scores, known


def settle(spark: SparkSession, edges: DataFrame, tolerance: float = TOLERANCE, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """The harmonic scores of the word nodes, which nodes have one, and the steps that it took."""
    few = edges.coalesce(4 * parallelism(spark))
    scores, known = _word_scores(few.where("grade is not null"), None, _nodes(words))
    for step in range(1, MOST_STEPS):
        if not known.any():
            return scores, known, step
        shared = spark.sparkContext.broadcast((scores, known))
        new, reached = _word_scores(few, shared, _nodes(words))
        shared.destroy()
        moved = np.abs(new - scores)[known > 0].max()
        still = bool((reached == known).all()) and moved <= tolerance
        scores, known = new, reached
        if still:
            return scores, known, step + 1
    raise RuntimeError(f"the scores still move by {moved:.3f} after {MOST_STEPS} steps")


def propagate(spark: SparkSession, edges: DataFrame, tolerance: float = TOLERANCE, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, lang, script, grade, sure, score): continuous difficulty; null where no path leads to a grade."""
    scores, known, _ = settle(spark, edges, tolerance, words)
    shared = spark.sparkContext.broadcast((scores, known))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, has, _ = _document_scores(b, *shared.value)
            keep = [b.column(c) for c in ("doc_id", "n_chars", "lang", "script", "grade", "sure")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(mean, mask=~has)], names=["doc_id", "n_chars", "lang", "script", "grade", "sure", "score"])

    return edges.mapInArrow(last, "doc_id long, n_chars long, lang string, script string, grade double, sure int, score double")


@dataclass
class Cuts:
    """For each group of documents the two scores between which grade 2 lies."""

    by_group: dict[str, tuple[float, float]]

    def grade(self, group: F.Column, score: F.Column) -> F.Column:
        low, high = (F.create_map(*[x for g, c in self.by_group.items() for x in (F.lit(g), F.lit(float(c[i])))]) for i in (0, 1))
        own = lambda m: F.coalesce(F.try_element_at(m, group), F.try_element_at(m, F.lit("")))
        return 1 + (score >= own(low)).cast("int") + (score >= own(high)).cast("int")


def _group() -> F.Column:
    lang = F.when(F.col("lang").isin(*_LANGS), F.col("lang"))
    return F.coalesce(lang, F.when(F.col("script").isin("ja", "zh"), F.col("script")), F.lit(""))


def find_cuts(scored: DataFrame) -> Cuts:
    """The cuts that mistake fewest graded documents, found from a histogram a language (7 x 3 x CELLS cells at most)."""
    cell = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((F.col("score") - 1) / 2 * CELLS))).cast("int")
    known = scored.where("grade is not null and score is not null and n_chars >= 200")
    table = known.groupBy(_group().alias("g"), F.round("grade", 1).alias("grade"), cell.alias("cell")).count().collect()
    hist = {g: np.zeros((2, 2, CELLS)) for g in _LANGS}
    for g, grade, c, n in table:
        for k, line in enumerate((1.5, 2.5)):
            if grade != line:
                for x in {g, ""}:
                    hist[x][k, int(grade > line), c] += n
    cuts: dict[str, tuple[float, float]] = {}
    for g, h in hist.items():
        if h[0].sum() < 30:
            h = hist[""]
        at = []
        for k in (0, 1):
            # a cut before cell c mistakes the lower grades from c on and the higher ones below c
            wrong = h[k, 0].sum() - np.concatenate([[0], np.cumsum(h[k, 0])]) + np.concatenate([[0], np.cumsum(h[k, 1])])
            least = np.flatnonzero(wrong == wrong.min())
            at.append(1 + 2 * float(least.mean()) / CELLS)
        cuts[g] = (at[0], max(at))
    return Cuts(cuts)


def reading_levels(spark: SparkSession, documents: DataFrame, samples: DataFrame, tolerance: float = TOLERANCE, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, score, grade): the continuous difficulty from 1 to 3 of each document and the grade it means.

    A document on whose grade two or more people agree keeps it. Documents without words, or without any tie to a
    graded one (as when no grades are given), get null for both. Repeated doc_ids come out once each row. Needs columns
    doc_id, text, lang, n_chars; others are ignored.
    """
    edges = materialize(graph(documents, samples, words), "level-graph")
    scored = materialize(propagate(spark, edges, tolerance, words), "level-scores")
    cuts = find_cuts(scored)
    grade = F.when(F.col("sure") >= 2, F.round("grade").cast("int")).otherwise(cuts.grade(_group(), F.col("score")))
    return scored.select("doc_id", "n_chars", "score", F.when(F.col("score").isNotNull(), grade).alias("grade"))
