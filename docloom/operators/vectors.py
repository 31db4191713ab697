"""Retrieval: filtered top-k by cosine, fusion of ranked lists, governance, and neighbouring chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.running import numbered

#: Constant of reciprocal rank fusion, and digits to which distances and scores are kept so that ties are ties everywhere.
RRF, DISTANCE_DIGITS, SCORE_DIGITS = 60, 4, 9
#: Greatest number of neighbours on either side.
MOST_NEIGHBOURS = 64
#: Bytes of query vectors in one broadcast, about; broadcasts in one pass over the vectors; products held at once in a task.
BLOCK_BYTES, PASS_BLOCKS, PRODUCTS = 16 << 20, 8, 1 << 22


class _Nearest:
    """The k nearest vectors so far of each query of a block, all of one dimension."""

    def __init__(self, unit: np.ndarray, keys: np.ndarray, k: int):
        self.unit, self.keys, self.k = unit, keys, k
        self.query, self.distance, self.vec = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        self.worst = np.full(len(unit), np.inf)

    def add(self, unit: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, PRODUCTS // len(self.unit))
        for lo in range(0, len(unit), step):
            part = slice(lo, lo + step)
            d = np.round(1.0 - self.unit @ unit[part].T, DISTANCE_DIGITS) + 0.0
            if len(self.keys):
                d[self.keys[:, None] != keys[part][None, :]] = np.inf
            worst = self.worst
            if d.shape[1] > self.k:
                worst = np.minimum(worst, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            q, v = np.nonzero((d <= worst[:, None]) & np.isfinite(d))
            if len(q):
                self._merge(q, d[q, v], ids[part][v])

    def _merge(self, query: np.ndarray, distance: np.ndarray, vec: np.ndarray) -> None:
        query, distance, vec = np.concatenate([self.query, query]), np.concatenate([self.distance, distance]), np.concatenate([self.vec, vec])
        order = np.lexsort((np.unique(vec, return_inverse=True)[1], distance, query))
        query, distance, vec = query[order], distance[order], vec[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.query, self.distance, self.vec = query[keep], distance[keep], vec[keep]
        last = place == self.k - 1
        self.worst[query[last]] = distance[last]


def _unit(b: pa.RecordBatch | pa.Table, name: str, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has the dimension, no nulls, and a direction; their unit vectors."""
    lists = b.column(name)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.asarray(lists.value_lengths().fill_null(-1))
    at = np.flatnonzero(size == dimension)
    if not len(at) or not dimension:
        return at[:0], np.empty((0, dimension))
    rows = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    norm = np.sqrt((rows * rows).sum(1))
    fine = norm > 0  # false for nulls, which are no numbers here
    return at[fine], rows[fine] / norm[fine][:, None]


def _search(shared: list, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(ids, _Nearest(unit, keys, k)) for x in shared for ids, unit, keys in x.value]
        out = None
        for b in batches:
            out = b.column("vec_id").type
            ids = b.column("vec_id").to_numpy(zero_copy_only=False).astype(object)
            keys = np.array(b.column("__same").to_pylist(), object)
            known: dict[int, tuple] = {}
            for _, near in blocks:
                n = near.unit.shape[1]
                if n not in known:
                    known[n] = _unit(b, "vector", n)
                at, unit = known[n]
                if len(at):
                    near.add(unit, keys[at], ids[at])
        for qids, near in blocks:
            if len(near.query):
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(near.query)), pa.array(near.vec.tolist(), out), pa.array(near.distance)], names=["qid", "vec_id", "distance"])

    return run


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """The queries (qid, q, __same) by dimension, in blocks of BLOCK_BYTES."""
    sizes = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    n = max(1, -(-(sizes[0] * max(1, sizes[1] or 1) * 8) // BLOCK_BYTES)) if sizes[0] else 0
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)
        t = part.toArrow().combine_chunks()
        keys = np.array(t.column("__same").to_pylist(), object)
        out = []
        for size in np.unique(np.asarray(t.column("q").combine_chunks().value_lengths().fill_null(-1))) if t.num_rows else ():
            at, unit = _unit(t, "q", int(size)) if size > 0 else (np.empty(0, int), None)
            if len(at):
                out.append((t.column("qid").combine_chunks().take(pa.array(at)), unit, keys[at]))
        if out:
            yield out


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None, same: Sequence[str] = ()) -> DataFrame:
    """(qid, vec_id, distance, rank): the k nearest vectors of each query by cosine distance, 1 - cosine in doubles.

    queries: (qid, q) and vectors: (vec_id, vector), both with the columns of same, which must agree in a pair (as the
    tenant; nulls agree with nothing). where filters the vectors before the search. Vectors that are null, of another
    dimension, or without a direction are neighbours of nothing. Ties go to the smaller vec_id.

    The queries are a stated set, broadcast in blocks of BLOCK_BYTES, PASS_BLOCKS of them in one pass over the vectors.
    Vectors are made unit vectors once and compared by matrix products; a task sends its k best of each query.
    """
    rows = vectors if where is None else vectors.where(where)
    agreed = F.concat_ws("\x01", *[F.col(c).cast("string") for c in same]) if same else F.lit("")
    whole = F.lit(True)
    for c in same:
        whole = whole & F.col(c).isNotNull()
    rows = rows.where(whole & F.col("vec_id").isNotNull()).select("vec_id", "vector", agreed.alias("__same"))
    schema = T.StructType([queries.schema["qid"], vectors.schema["vec_id"], T.StructField("distance", T.DoubleType())])
    found, shared = None, []

    def search() -> None:
        nonlocal found, shared
        if shared:
            hits = rows.mapInArrow(_search(shared, k), schema)
            found, shared = hits if found is None else found.unionByName(hits), []

    for block in _blocks(queries.where(whole).select("qid", "q", agreed.alias("__same"))):
        shared.append(rows.sparkSession.sparkContext.broadcast(block))
        if len(shared) == PASS_BLOCKS:
            search()
    search()
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse_ranks(lists: DataFrame) -> DataFrame:
    """(qid, vec_id, score, hits, distance, best_profile, first_profile, first_rank) from ranked lists (qid, profile_idx, rank, vec_id, distance).

    score is the sum of 1 / (60 + rank) over the lists that hold the vector; distance is its least one.
    """
    first = F.min(F.struct("profile_idx", "rank"))
    best = F.min(F.struct(F.col("distance").isNull().alias("none"), "distance", "profile_idx", "rank"))
    grouped = lists.groupBy("qid", "vec_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), SCORE_DIGITS).alias("score"), F.count("*").alias("hits"), best.alias("b"), first.alias("f"))
    return grouped.select("qid", "vec_id", "score", "hits", F.col("b.distance").alias("distance"), F.col("b.profile_idx").alias("best_profile"), F.col("f.profile_idx").alias("first_profile"), F.col("f.rank").alias("first_rank"))


def fused_topk(fused: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties keep the order in which the lists were read."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first_profile", "first_rank", "vec_id")
    return fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def govern(hits: DataFrame, state: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits that may be shown: those whose state (key, is_deleted, is_ready) is live and ready; without a state, those
    marked is_latest. Ranks close up afterwards."""
    joined = hits.join(state.select(key, "is_deleted", "is_ready"), key, "left")
    known = F.col("is_ready").isNotNull()
    keep = F.when(known, F.col("is_ready") & ~F.coalesce("is_deleted", F.lit(False))).otherwise(F.coalesce("is_latest", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return joined.where(keep).withColumn("final_rank", rank).drop("is_deleted", "is_ready")


def neighbours_of(matches: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """(version_pk, chunk_id, ordinal, offset, neighbour_ordinal, neighbour_id): the chunks up to n places before and after each match.

    Places are numbered within a version by ordinal, so gaps in ordinals do not matter; only versions with a match are
    numbered. n is clipped to 0..64. The join is on version and place (each match asks for at most 2n places), not a range
    join.
    """
    n = max(0, min(MOST_NEIGHBOURS, n))
    matched = chunks.join(matches.select("version_pk").distinct(), "version_pk", "left_semi")
    placed = numbered(matched.select("version_pk", "ordinal", "chunk_id"), ["version_pk"], ["ordinal", "chunk_id"], "place", "chunk-places")
    own = placed.join(matches.select("version_pk", "chunk_id").distinct(), ["version_pk", "chunk_id"], "left_semi")
    steps = F.explode(F.sequence(F.lit(-n), F.lit(n)))
    wanted = own.select("version_pk", "chunk_id", "ordinal", "place", steps.alias("offset")).where("offset <> 0").withColumn("place", F.col("place") + F.col("offset"))
    other = placed.select("version_pk", "place", F.col("ordinal").alias("neighbour_ordinal"), F.col("chunk_id").alias("neighbour_id"))
    return wanted.join(other, ["version_pk", "place"]).drop("place")


def neighbours(matches: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """neighbours_of without the match's own chunk_id."""
    return neighbours_of(matches, chunks, n).drop("chunk_id")
