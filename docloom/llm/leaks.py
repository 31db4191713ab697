"""Evaluation texts in training documents: latent semantic retrieval of passages, then longest common subsequences.

Passages are sentences (in documents, long ones also as windows); they are rows of a TF-IDF matrix over hashed words, with
counts over all documents. A randomised singular value decomposition of that matrix, computed over Spark, gives a latent
space: its rows are all sentences of all documents and all passages of the items, which together weigh ITEM_SHARE of it.
Every passage of every document and item is projected into the space. Items' passages are
held in cells around centres; a document's passage is compared with the cells that can hold anything above COSINE (an exact
bound by angles), by batched matrix products. Candidates that share enough of the item's rare words are checked by the
longest common subsequence, paraphrases also by the item's answer.

The decomposition reads the hashed words of all sentences, which the counting writes as two bytes a word. Documents are searched
once for any number of items, and nothing of them is gathered. The items' vectors are made on Spark and broadcast in blocks of about BLOCK passages, PASS_BLOCKS of them (about 60 MB) in one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.io import materialize, parallelism
from docloom.llm import arrays

#: Hashed words of the latent space, and of the counts from which rarity comes (both powers of two).
FEATURES, COUNTS = 1 << 14, 1 << 18
RANK, OVERSAMPLE, POWERS = 96, 16, 1
#: Part of the weight of the decomposition that the items' passages have together; the documents' passages have the rest.
ITEM_SHARE = 0.65
#: Words (about) of the passages that a product in the decomposition takes at a time.
_AT_ONCE = 1 << 18
#: Sums that are made side by side, so that they stay in the cache; rows of the runs that longer sums are split into.
_ABREAST, _RUN = 512, 128
#: Least cosine of a candidate in the latent space.
COSINE = 0.8
#: Least share of the words of the item's sentence that must run through the document's sentence, in order; and least
#: share of their rarity that must occur in it, for sentences of like form differ in the rare words: names and numbers.
SHARED, RARITY = 0.88, 0.84
#: The same where the item's answer stands in the document as well.
PARAPHRASED, KEPT = 0.6, 0.78
#: Words that an answer needs to prove anything. Words of a sentence that is looked up whole, since it has no form.
ANSWER, SHORT = 3, 2
#: Passages of documents times words of a block's items in one table of which word is where.
TABLE = 1 << 24
#: Item passages in one broadcast, about; broadcasts in one pass over the documents.
BLOCK, PASS_BLOCKS = 4096, 32
#: A sentence of more words than this (Latin, Chinese) is also a run of sentences that lost their stops: it is searched in
#: windows of so many words, a step apart.
LONG, WINDOW, STEP = (48, 80), (32, 56), (12, 16)
#: Features whose rows are added up together.
_PANEL = 2048
_MARK = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Sentences:
    """start, size: tokens of each sentence or window; window: which it is; text: the text of each; hash: of all tokens;
    bound: first token of each text, one more at the end."""

    start: np.ndarray
    size: np.ndarray
    window: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    bound: np.ndarray

    def words(self, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of all sentences (or those chosen) one after another, and where each sentence begins in them."""
        start, size = (self.start, self.size) if at is None else (self.start[at], self.size[at])
        return _ranges(start, size)


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.cumsum(size)
    first = last - size
    return np.arange(int(last[-1]) if len(last) else 0) - np.repeat(first, size) + np.repeat(start, size), first


def _windows(start: np.ndarray, size: np.ndarray, ideo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short sentences as they are, long ones as windows."""
    starts, sizes, flags = [start], [size], [np.zeros(len(start), bool)]
    keep = np.ones(len(start), bool)
    for k, script in ((0, ~ideo), (1, ideo)):
        at = np.flatnonzero((size > LONG[k]) & script)
        keep[at] = False
        n = (size[at] - WINDOW[k] + STEP[k] - 1) // STEP[k] + 1
        owner = np.repeat(at, n)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        offset = np.minimum(nth * STEP[k], size[owner] - WINDOW[k])
        starts.append(start[owner] + offset)
        sizes.append(np.full(len(owner), WINDOW[k]))
        flags.append(np.ones(len(owner), bool))
    starts[0], sizes[0], flags[0] = start[keep], size[keep], flags[0][keep]
    return tuple(np.concatenate(x) for x in (starts, sizes, flags))


def sentences(texts: list[str | None], windows: bool = False) -> Sentences:
    """The sentences of texts; with windows, long ones cut into these."""
    t = arrays.tokenize(texts)
    first = arrays.sentence_starts(t)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(first)))
    flags = np.zeros(len(start), bool)
    if windows and len(start):
        start, size, flags = _windows(start, size, t.kind[t.start[start + size // 2]] == arrays.IDEO)
    bound = np.searchsorted(t.text, np.arange(len(texts) + 1))
    return Sentences(start, size, flags, t.text[start], t.hash, bound)


# ---------------------------------------------------------------- counts

_READ = "own boolean, columns binary, sizes binary, id int, n long"
_KINDS = pa.schema([("own", pa.bool_()), ("columns", pa.binary()), ("sizes", pa.binary()), ("id", pa.int32()), ("n", pa.int64())])


def _bytes(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    """Stretches of an array as one binary each."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bound) - 1, [None, pa.py_buffer((bound * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the hashed words of its sentences one after another and the sentences' sizes: rows of the matrix. At the end
    (id, n): occurrences of each hashed word in documents; -1 words, -2 documents, -3 sentences of documents, -4 of items."""
    total, n = np.zeros(COUNTS, np.int64), np.zeros(4, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            own = part.column("own").to_numpy(zero_copy_only=False).astype(bool)
            s = sentences(part.column("text").to_pylist())
            counted = ~own[np.repeat(np.arange(len(own)), np.diff(s.bound))]
            np.add.at(total, arrays.bins(s.hash[counted], COUNTS), 1)
            mine = int(own[s.text].sum())
            n += (int(counted.sum()), int((~own).sum()), len(s.text) - mine, mine)
            columns = _bytes(arrays.bins(s.hash, FEATURES).astype(np.uint16), s.bound)
            sizes = _bytes(s.size.astype(np.int32), np.searchsorted(s.text, np.arange(len(own) + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(own), columns, sizes, pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.int64())], schema=_KINDS)
    at = np.flatnonzero(total)
    ids, counts = np.concatenate([at, [-1, -2, -3, -4]]), np.concatenate([total[at], n])
    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(ids), f.type) for f in list(_KINDS)[:3]), pa.array(ids.astype(np.int32)), pa.array(counts)], schema=_KINDS)


@dataclass
class Counts:
    """bins: occurrences of each hashed word over all documents; words: of all; documents: how many have a text; sentences and
    own: how many these and the items have."""

    bins: np.ndarray
    words: int
    documents: int
    sentences: int
    own: int

    def weight(self) -> np.ndarray:
        """Of each feature: its inverse frequency squared, never nothing."""
        folded = self.bins.reshape(-1, FEATURES).sum(0)
        idf = np.log((self.words / 25 + 1) / (folded + 1))
        return ((np.maximum(idf, 0) + 0.3) ** 2).astype(np.float32)

    def rarity(self, hashes: np.ndarray) -> np.ndarray:
        """Squared as the weights are: in sentences of like form the names and numbers decide."""
        return (np.log((self.words + 1) / (self.bins[arrays.bins(hashes, COUNTS)] + 1)) ** 2).astype(np.float32)


def read_passages(spark: SparkSession, documents: DataFrame, texts: DataFrame) -> tuple[DataFrame, Counts]:
    """(own, columns, sizes) of every text of documents and items, and the counts: COUNTS rows at most reach the driver."""
    rows = documents.select("text", F.lit(False).alias("own")).where("text is not null").coalesce(4 * parallelism(spark))
    read = materialize(rows.unionByName(texts.select("text", F.lit(True).alias("own"))).mapInArrow(_read, _READ), "leak-passages")
    t = read.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
    counts = np.zeros(COUNTS, np.int64)
    counts[ids[ids >= 0]] = n[ids >= 0]
    return read.where("id is null").select("own", "columns", "sizes"), Counts(counts, *(int(n[ids == -k].sum()) for k in (1, 2, 3, 4)))


# ---------------------------------------------------------------- latent space

def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.float32).ravel()))


def project(ids: np.ndarray, first: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sums of the basis rows of each passage: the first words of some passages of like length at once, then their second ones, and
    so on. Long passages are summed up in runs of _RUN words."""
    out = np.empty((len(first), basis.shape[1]), basis.dtype)
    size = np.diff(first, append=len(ids))
    if len(size) and size.max() > _RUN:
        runs = -(-size // _RUN)
        start = np.cumsum(runs) - runs
        nth = np.arange(int(runs.sum())) - np.repeat(start, runs)
        parts = project(ids, np.repeat(first, runs) + nth * _RUN, basis)
        return project(np.arange(len(parts)), start, parts)
    order = np.argsort(-size, kind="stable")
    total, row = np.empty((2, min(_ABREAST, len(order)), basis.shape[1]), basis.dtype)
    for a in range(0, len(order), _ABREAST):
        at = order[a : a + _ABREAST]
        begin, less = first[at], -size[at]
        np.take(basis, ids[begin], 0, out=total[: len(at)], mode="clip")
        for k, n in enumerate(np.searchsorted(less, np.arange(-1, less[0], -1)).tolist(), 1):
            np.take(basis, ids[begin[:n] + k], 0, out=row[:n], mode="clip")
            total[:n] += row[:n]
        out[at] = total[: len(at)]
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _stretches(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed words, sizes of the passages and whether they are items', for some texts of a batch at a time: about _AT_ONCE words."""
    length = np.cumsum(pc.binary_length(b.column("columns")).to_numpy(zero_copy_only=False))
    edges = np.unique(np.concatenate([[0], np.searchsorted(length, np.arange(2 * _AT_ONCE, int(length[-1]) + 1, 2 * _AT_ONCE)) + 1, [b.num_rows]]))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        columns, sizes = b.column("columns").slice(a, z - a).to_pylist(), b.column("sizes").slice(a, z - a).to_pylist()
        own = np.repeat(b.column("own").slice(a, z - a).to_numpy(zero_copy_only=False).astype(bool), [len(x) // 4 for x in sizes])
        if len(own):
            yield np.frombuffer(b"".join(columns), np.uint16), np.frombuffer(b"".join(sizes), np.int32), own


def _power(shared):
    """A task's rows: their part of (A'A)Q, without A ever being whole anywhere. Rows have length one, items' ones their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight, heavy = shared.value
        scaled, squares = q * weight[:, None], weight.astype(np.float64) ** 2
        out = np.zeros(q.shape)
        for b in batches:
            if not b.num_rows:
                continue
            for ids, size, own in _stretches(b):
                first = np.cumsum(size) - size
                norm = np.add.reduceat(squares[ids], first)
                y = project(ids, first, scaled) * (np.where(own, heavy, 1.0) / np.maximum(norm, 1e-9))[:, None].astype(np.float32)
                order = np.argsort(ids, kind="stable")
                owner = np.repeat(np.arange(len(size)), size)[order]
                some, begin = np.unique(ids[order], return_index=True)
                out[some] += project(owner, begin, y)
        out *= weight[:, None]
        used = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array((used // _PANEL).astype(np.int32)), pa.array(used.astype(np.int32)), _lists(out[used])], names=["panel", "column", "part"])

    return run


def _add_panel(t: pa.Table) -> pa.Table:
    """Sum of the parts of one panel of features."""
    t = t.combine_chunks()
    column = t.column("column").to_numpy()
    part = t.column("part").combine_chunks().flatten().to_numpy().reshape(len(column), -1)
    own, at = np.unique(column, return_inverse=True)
    total = np.zeros((len(own), part.shape[1]))
    np.add.at(total, at, part)
    return pa.table({"column": pa.array(own.astype(np.int32)), "part": _lists(total)})


def _times(spark: SparkSession, matrix: DataFrame, q: np.ndarray, weight: np.ndarray, heavy: float) -> np.ndarray:
    """(A'A)q: partial products of the tasks, added up panel by panel."""
    shared = spark.sparkContext.broadcast((q.astype(np.float32), weight, heavy))
    parts = matrix.mapInArrow(_power(shared), "panel int, column int, part array<float>")
    sums = parts.groupBy("panel").applyInArrow(_add_panel, "column int, part array<float>").toArrow()
    shared.destroy()
    out = np.zeros(q.shape)
    out[sums.column("column").to_numpy()] = sums.column("part").combine_chunks().flatten().to_numpy().reshape(-1, q.shape[1])
    return out


def latent_basis(spark: SparkSession, passages: DataFrame, counts: Counts, rank: int = RANK) -> np.ndarray | None:
    """FEATURES by rank, weights folded in: what turns hashed words into the latent space of all passages. None if the items
    have no words.

    Randomised range finding with POWERS power iterations on A'A over Spark; the square problem that is left
    (rank + OVERSAMPLE columns) is solved on the driver.
    """
    if not counts.own:
        return None
    # each task of a product sends FEATURES x (rank + OVERSAMPLE) floats
    matrix = passages.coalesce(parallelism(spark))
    heavy = ITEM_SHARE / (1 - ITEM_SHARE) * counts.sentences / counts.own if counts.sentences else 1.0
    weight = counts.weight()
    q = np.random.default_rng(7).standard_normal((FEATURES, min(rank + OVERSAMPLE, counts.own + counts.sentences)))
    for _ in range(POWERS + 1):
        q, _ = np.linalg.qr(_times(spark, matrix, q, weight, heavy))
    small = q.T @ _times(spark, matrix, q, weight, heavy)
    size, turn = np.linalg.eigh((small + small.T) / 2)
    return ((q @ turn[:, np.argsort(-size)[:rank]]) * weight[:, None]).astype(np.float32)


# ---------------------------------------------------------------- items

_ITEM = "item_id long, words array<long>, rarity array<float>, vector array<float>, answer array<long>"


def _item_rows(shared):
    """The passages of item texts: their words, how rare these are, their place in the latent space, the item's answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, counts = shared.value
        for b in batches:
            s = sentences(b.column("text").to_pylist())
            if not len(s.start):
                continue
            place, first = s.words()
            offsets = pa.array(np.append(first, len(place)).astype(np.int32))
            words = s.hash[place]
            vectors = _unit(project(arrays.bins(words, FEATURES), first, basis))
            a = arrays.tokenize(b.column("answer").to_pylist())
            edge = np.searchsorted(a.text, np.arange(b.num_rows + 1))
            answers = [a.hash[edge[i] : edge[i + 1]].view(np.int64) for i in s.text]
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id").take(pa.array(s.text)), pa.ListArray.from_arrays(offsets, pa.array(words.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(counts.rarity(words))), _lists(vectors), pa.array(answers, pa.list_(pa.int64()))],
                names=["item_id", "words", "rarity", "vector", "answer"],
            )

    return run


@dataclass
class Block:
    """Some passages of items, in cells: what the search takes to the tasks.

    first: where the words of each begin; places: cached per passage, the places of its words in bits; centre, radius,
    cell: unit vectors, greatest angles and bounds of the cells; short: hash of whole short sentences.
    """

    item: np.ndarray
    words: np.ndarray
    rarity: np.ndarray
    first: np.ndarray
    total: np.ndarray
    vectors: np.ndarray
    answers: list[bytes]
    centre: np.ndarray
    radius: np.ndarray
    cell: np.ndarray
    short: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Block:
        t = t.combine_chunks()
        vectors = t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        centre, of = _cells(vectors)
        order = np.argsort(of, kind="stable")
        t, vectors, of = t.take(pa.array(order)).combine_chunks(), vectors[order], of[order]
        angle = np.arccos(np.clip((vectors * centre[of]).sum(1), -1, 1))
        radius = np.zeros(len(centre))
        np.maximum.at(radius, of, angle)
        lists = t.column("words").combine_chunks()
        words = lists.flatten().to_numpy().view(np.uint64)
        first = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        rarity = t.column("rarity").combine_chunks().flatten().to_numpy()
        total = np.add.reduceat(rarity, first[:-1])
        answers = [np.asarray(x, np.int64).tobytes() for x in t.column("answer").to_pylist()]
        size = np.diff(first)
        short = np.where(size <= SHORT, _whole(words, first[:-1], size), 0)
        return cls(t.column("item_id").to_numpy(), words, rarity, first, total, vectors, answers, centre.astype(np.float32), radius, np.searchsorted(of, np.arange(len(centre) + 1)), short)

    def candidates(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (passage of v, passage of items) above COSINE. No cell is passed over that could hold one."""
        widest = np.minimum(self.radius + (np.arccos(COSINE) + 1e-3), np.pi)
        near = self.centre @ v.T >= np.where(widest < np.pi, np.cos(widest), -2)[:, None]
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for c in np.flatnonzero(near.any(1)):
            rows = np.flatnonzero(near[c])
            dots = v[rows] @ self.vectors[self.cell[c] : self.cell[c + 1]].T
            i, j = np.divmod(np.flatnonzero(dots >= COSINE), dots.shape[1])
            left.append(rows[i])
            right.append(j + self.cell[c])
        return np.concatenate(left), np.concatenate(right)

    @cached_property
    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all passages, each once and sorted, and which of them each word is."""
        return np.unique(self.words, return_inverse=True)

    def kept_share(self, s: Sentences, u: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each pair, the share of the rarity of the item's words that occur in the passage (around it, for windows)."""
        words, which = self.vocabulary
        some, at = np.unique(u, return_inverse=True)
        lo, hi = s.start[some], s.start[some] + s.size[some]
        reach = np.where(s.window[some], int(np.diff(self.first).max()), 0)
        lo, hi = np.maximum(s.bound[s.text[some]], lo - reach), np.minimum(s.bound[s.text[some] + 1], hi + reach)
        size = self.first[q + 1] - self.first[q]
        out = np.zeros(len(u))
        step = max(1, TABLE // len(words))
        for a in range(0, len(some), step):
            place, _ = _ranges(lo[a : a + step], (hi - lo)[a : a + step])
            word = np.minimum(np.searchsorted(words, s.hash[place]), len(words) - 1)
            known = words[word] == s.hash[place]
            there = np.zeros((min(step, len(some) - a), len(words)), bool)
            there[np.repeat(np.arange(len(there)), (hi - lo)[a : a + step])[known], word[known]] = True
            pair = np.flatnonzero((at >= a) & (at < a + step))
            place, begin = _ranges(self.first[q[pair]], size[pair])
            found = there[np.repeat(at[pair] - a, size[pair]), which[place]]
            out[pair] = np.add.reduceat(np.where(found, self.rarity[place], 0), begin) / np.maximum(self.total[q[pair]], 1e-9)
        return out

    def places(self, q: int) -> dict[int, int]:
        bits: dict[int, int] = {}
        for i, w in enumerate(self.words[self.first[q] : self.first[q + 1]].tolist()):
            bits[w] = bits.get(w, 0) | 1 << i
        return bits

    def holds(self, s: Sentences, u: int, q: int) -> bool:
        """Whether an item's sentence runs through a passage, or through a stretch of its own length around a window."""
        words, rarity = self.words[self.first[q] : self.first[q + 1]].tolist(), self.rarity[self.first[q] : self.first[q + 1]].tolist()
        length, places = len(words), self.places(q)
        lo, hi = int(s.start[u]), int(s.start[u] + s.size[u])
        if s.window[u]:
            lo, hi = max(int(s.bound[s.text[u]]), lo - length), min(int(s.bound[s.text[u] + 1]), hi + length)
        near = s.hash[lo:hi].tolist()

        def like(part: list[int], least: float, rare: float) -> bool:
            if common_length(places, length, part) < least * length:
                return False
            there = set(part)
            return sum(r for w, r in zip(words, rarity) if w in there) >= rare * sum(rarity)

        def anywhere(least: float, rare: float) -> bool:
            stretch = length + length // 6 + 2
            if not s.window[u] or len(near) <= stretch:
                return like(near, least, rare)
            return like(near, least, rare) and any(like(near[a : a + stretch], least, rare) for a in range(0, len(near) - stretch + 4, 4))

        if anywhere(SHARED, RARITY):
            return True
        answer = self.answers[q]
        if len(answer) < 8 * ANSWER or not anywhere(PARAPHRASED, KEPT):
            return False
        text = s.hash[s.bound[s.text[u]] : s.bound[s.text[u] + 1]].tobytes()
        at = text.find(answer)
        while at % 8 and at >= 0:
            at = text.find(answer, at + 1)
        return at >= 0


def _cells(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """About as many centres as members each: a few rounds of means of unit vectors."""
    n = max(1, int(len(vectors) ** 0.5))
    centre = vectors[np.random.default_rng(3).permutation(len(vectors))[:n]]
    for _ in range(4):
        of = (vectors @ centre.T).argmax(1)
        total = np.zeros(centre.shape)
        np.add.at(total, of, vectors)
        centre = np.where(np.bincount(of, minlength=n)[:, None] > 0, _unit(total), centre)
    return centre, (vectors @ centre.T).argmax(1)


def _whole(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for sentences of at most SHORT words, 0 for longer ones."""
    out = np.zeros(len(start), np.uint64)
    for n in range(1, SHORT + 1):
        at = start[size == n]
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = (value ^ hashes[at + k]) * _MARK
        out[size == n] = value
    return out


def common_length(a: dict[int, int], length: int, b: list[int]) -> int:
    """Length of the longest common subsequence of a sentence, given as places of its words in bits, and words b."""
    full = (1 << length) - 1
    v = full
    for y in b:
        u = v & a.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def item_blocks(rows: DataFrame) -> Iterator[Block]:
    """The items' passages in blocks of about BLOCK, dealt by a hash."""
    n = -(-rows.count() // BLOCK)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == i)
        t = part.toArrow()
        if t.num_rows:
            yield Block.of(t)


# ---------------------------------------------------------------- search

def _search(basis, shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, blocks = basis.value, [x.value for x in shared]
        for b in batches:
            found: set[tuple[int, int]] = set()
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for at in range(0, b.num_rows, 64):
                s = sentences(b.column("text").slice(at, 64).to_pylist(), windows=True)
                if not len(s.start):
                    continue
                place, first = s.words()
                v = _unit(project(arrays.bins(s.hash, FEATURES)[place], first, turn))
                short = _whole(s.hash, s.start, s.size)
                for block in blocks:
                    u, q = block.candidates(v)
                    if len(u):
                        keep = np.flatnonzero(block.kept_share(s, u, q) >= KEPT)
                        for i, j in zip(u[keep].tolist(), q[keep].tolist()):
                            pair = (int(ids[at + s.text[i]]), int(block.item[j]))
                            if pair not in found and block.holds(s, i, j):
                                found.add(pair)
                    some = np.flatnonzero(np.isin(short, block.short[block.short > 0]))
                    found.update((int(ids[at + s.text[i]]), int(x)) for i in some for x in block.item[block.short == short[i]])
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "item_id"])

    return run


def leaked_items(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a complete sentence of an item's passage, or its question, nearly word by word,
    or a paraphrase of it together with the item's answer.

    Null and empty texts hold nothing and match nothing. Sentences of one or two words count where they stand alone in the
    document. Each pair comes out once. Documents are read once for their words, of which counts and space are made, and
    once for the search of about BLOCK x PASS_BLOCKS item passages.
    """
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    texts = items.select("item_id", "answer", F.explode(F.array("passage", "question")).alias("text")).where("item_id is not null and text is not null")
    passages, counts = read_passages(spark, rows, texts)
    basis = latent_basis(spark, passages, counts)
    result = None
    if basis is not None:
        sent = spark.sparkContext.broadcast((basis, counts))
        found = materialize(texts.mapInArrow(_item_rows(sent), _ITEM), "leak-items")
        turn = spark.sparkContext.broadcast(basis)
        shared: list = []
        for block in item_blocks(found):
            shared.append(spark.sparkContext.broadcast(block))
            if len(shared) == PASS_BLOCKS:
                hits = rows.mapInArrow(_search(turn, shared), "doc_id long, item_id long")
                result = hits if result is None else result.unionByName(hits)
                shared = []
        if shared:
            hits = rows.mapInArrow(_search(turn, shared), "doc_id long, item_id long")
            result = hits if result is None else result.unionByName(hits)
    if result is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return result.distinct()
