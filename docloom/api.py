"""One object over the tables of a corpus: search, excerpts, versions, requests, cleaning up and backfill, each a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.identity import object_of_version_pk, tenant_of_pk, unescape_part
from docloom.functions.plugins import Embedder, embedded
from docloom.io import materialize, table
from docloom.operators import events, manifests, pages, search, vectors
from docloom.operators.changes import current_rows, fold_changes
from docloom.operators.manifests import Profile

# Bounds of what a caller may ask for, and what is taken where nothing is asked for.
HITS, NEIGHBOURS, CHUNKS, CHARS, VERSIONS, OBJECTS = (1, 20, 10), (0, 2, 1), (1, 20, 3), (120, 12_000, 2400), (1, 25, 10), (1, 100_000, 100_000)


def _within(value: int | None, bounds: tuple[int, int, int]) -> int:
    """A whole number inclusive of its bounds; the default for none; anything else is an error."""
    low, high, default = bounds
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{value!r} is not a whole number from {low} to {high}")
    return value


def _given(text: str | None) -> str:
    if not isinstance(text, str) or not text.strip():
        raise ValueError("a text is required")
    return text.strip()


class Corpus:
    """The tables under one folder, and the profiles in which their vectors are kept."""

    def __init__(self, spark: SparkSession, folder: str, profiles: list[Profile]):
        self.spark, self.folder, self.configured = spark, folder, profiles
        self.profiles = manifests.profile_table(spark, profiles)

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def state(self) -> DataFrame:
        """The state of every object after all changes, tombstones included."""
        return fold_changes(self.read("object_lookup"), self.read("lookup_changes"))

    def current(self) -> DataFrame:
        return current_rows(self.state())

    def chunk_texts(self) -> DataFrame:
        """Chunks with what a search may filter them by."""
        rows = self.read("chunks").dropDuplicates(["version_pk", "chunk_id"])
        key = unescape_part(F.get(F.split("version_pk", "#"), F.lit(2)))
        return rows.withColumns({"vec_id": F.concat_ws("|", "version_pk", "chunk_id"), "tenant_id": tenant_of_pk(F.col("version_pk")), "object_key": key})

    def embed(self, embedders: dict[str, Embedder]) -> dict[str, DataFrame]:
        """The vectors (vec_id, version_pk, chunk_id, tenant_id, doc_type, object_key, is_latest, metadata, vector) of all chunks for each profile
        that is written and has an embedder."""
        rows = self.chunk_texts()
        names = [p.profile_id for p in self.configured if p.enabled and p.enable_write and p.profile_id in embedders]
        meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
        return {n: rows.select("vec_id", "version_pk", "chunk_id", "tenant_id", "doc_type", "object_key", F.lit(True).alias("is_latest"), meta.alias("metadata"), embedded(F.col("text"), embedders[n]).alias("vector")) for n in names}

    def search(self, questions: DataFrame, by_profile: dict[str, DataFrame], embedders: dict[str, Embedder], tenant: str, k: int | None = None, neighbours: int | None = None,
               doc_type: str | None = None, key: str | None = None, projection: DataFrame | None = None, overfetch: int = 1) -> DataFrame:
        """The answers (search.answer_rows) to questions (qid, text), within one tenant, which is always required.

        by_profile: vectors as embed gives them; profiles that are not searched, or have none, find nothing. Each profile
        finds k, k of all are governed, and fewer may be left; overfetch takes so many times k before governance.
        """
        tenant, k, n = _given(tenant), _within(k, HITS), _within(neighbours, NEIGHBOURS)
        where = search.searchable(tenant, doc_type, key)
        names = [p.profile_id for p in self.configured if p.enabled and p.enable_query and p.profile_id in by_profile and p.profile_id in embedders]
        if not names:
            raise ValueError("no profile can be searched")
        lists = None
        for i, name in enumerate(names):
            asked = questions.select("qid", embedded(F.col("text"), embedders[name]).alias("q"))
            one = vectors.vector_topk(asked, by_profile[name], k * overfetch, where).select("qid", F.lit(i).alias("profile_idx"), "rank", "vec_id", "distance")
            lists = one if lists is None else lists.unionByName(one)
        top = materialize(vectors.fused_topk(vectors.fuse_ranks(lists), k * overfetch), "search-fused")
        known = None
        for i, name in enumerate(names):
            some = by_profile[name].where(where).join(top.where(F.col("best_profile") == i).select("vec_id").distinct(), "vec_id", "left_semi")
            part = some.select("vec_id", F.lit(i).alias("best_profile"), F.lit(name).alias("profile_id"), "version_pk", "chunk_id", "is_latest", "metadata")
            known = part if known is None else known.unionByName(part)
        hits = top.join(known, ["vec_id", "best_profile"])
        shown = search.govern_versions(hits, self.state(), projection).where(F.col("final_rank") <= k)
        return search.answer_rows(search.with_context(shown, self.read("chunks"), n))

    def excerpt(self, version_pk: str, tenant: str, max_chunks: int | None = None, max_chars: int | None = None, chunk_id: str | None = None) -> DataFrame:
        """The first chunks of a version of the tenant's, or the one that is named."""
        n, chars = _within(max_chunks, CHUNKS), _within(max_chars, CHARS)
        own = search.of_tenant(self.read("chunks").where(F.col("version_pk") == _given(version_pk)), _given(tenant), "version_pk").dropDuplicates(["version_pk", "chunk_id"])
        if chunk_id is not None:
            return own.where(F.col("chunk_id") == _given(chunk_id))
        return own.join(pages.excerpt(own, n, chars), ["version_pk", "chunk_id"], "left_semi")

    def versions(self, object_pk: str, tenant: str, limit: int | None = None) -> DataFrame:
        """The versions of one object of the tenant's, live ones before delete markers, newest first."""
        rows = search.of_tenant(self.read("lookup_changes").where(F.col("object_pk") == _given(object_pk)), _given(tenant))
        return events.version_list(rows, _within(limit, VERSIONS))

    def neighbours(self, matches: DataFrame, n: int = 1) -> DataFrame:
        rows = self.read("chunks").select("version_pk", "chunk_id", "ordinal").dropDuplicates(["version_pk", "chunk_id"])
        return vectors.neighbours(matches, rows, n)

    def requests(self) -> DataFrame:
        """What is to be embedded, for each profile that is written."""
        return manifests.fan_out(manifests.requests(self.read("chunks")), self.profiles)

    def cleanup(self, assets: DataFrame | None = None) -> DataFrame:
        return manifests.cleanup_keys(self.read("chunks"), self.state(), self.profiles, assets)

    def backfill(self, after: str | None = None, limit: int | None = None, profile: str | None = None, force: bool = False, projection: DataFrame | None = None) -> DataFrame:
        """(object_pk, reason, truncated): the next objects by key with the reason for which each is to be embedded again in a
        profile, or not. Without a profile there must be only one that is written, unless there is no projection to look at."""
        if projection is not None and profile is None:
            writable = [p.profile_id for p in self.configured if p.enabled and p.enable_write]
            if len(writable) != 1:
                raise ValueError("name a profile")
            profile = writable[0]
        page = manifests.page_of(events.prefer_lookup(self.read("object_lookup")), "object_pk", after, _within(limit, OBJECTS))
        page = materialize(page.select("object_pk", "latest_version_id", "truncated"), "backfill-page")
        reasons = manifests.backfill_reasons(page, self.state(), self.read("manifests"), projection, profile, force)
        return reasons.join(page.select("object_pk", "truncated"), "object_pk")

    def objects_of(self, tenant: str) -> DataFrame:
        """The state of the tenant's objects."""
        return search.of_tenant(self.state(), _given(tenant))

    def chunks_of_current(self) -> DataFrame:
        live = self.current().select(F.concat("object_pk", F.lit("#"), "latest_version_id").alias("version_pk"))
        return self.read("chunks").join(live, "version_pk", "left_semi").withColumn("object_pk", object_of_version_pk(F.col("version_pk")))
