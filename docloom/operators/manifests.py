"""Manifests, chunk index rows, embedding requests, their fan-out to profiles, and what has to be removed or redone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.identity import escape_part, object_of_version_pk, unescape_part, uri_of_version_pk
from docloom.operators.contracts import IMAGES
from docloom.operators.text import drop_empty, preview

@dataclass(frozen=True)
class Profile:
    """A place for vectors: what kinds of content it takes, and whether it is written and searched."""

    profile_id: str
    dimension: int
    kinds: tuple[str, ...] = ("text",)
    enabled: bool = True
    enable_write: bool = True
    enable_query: bool = True


def profile_table(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """The profiles in the order of configuration. Ids must be unique."""
    if len({p.profile_id for p in profiles}) < len(profiles):
        raise ValueError("profile ids must be unique")
    rows = [(i, p.profile_id, p.dimension, list(p.kinds), p.enabled and p.enable_write, p.enabled and p.enable_query) for i, p in enumerate(profiles)]
    return spark.createDataFrame(rows, "profile_idx int, profile_id string, dimension int, kinds array<string>, writes boolean, reads boolean")


def distinct_manifests(manifests: DataFrame) -> DataFrame:
    """One row a version; exact duplicates are one, of others the greatest format stands."""
    top = F.max(F.struct("source_format", "doc_type")).alias("t")
    return manifests.where("version_pk is not null").groupBy("version_pk").agg(top).select("version_pk", "t.doc_type", "t.source_format")


def index_rows(chunks: DataFrame) -> DataFrame:
    """(version_pk, sk, ordinal, is_latest, preview, token_estimate): one narrow row a chunk for lookups."""
    rows = chunks.dropDuplicates(["version_pk", "chunk_id"])
    return rows.select("version_pk", F.concat(F.lit("chunk#"), "chunk_id").alias("sk"), "ordinal", F.lit(True).alias("is_latest"), preview(F.col("text")).alias("preview"), "token_estimate")


def requests(chunks: DataFrame) -> DataFrame:
    """(version_pk, chunk_id, kind, metadata): what is to be embedded; a chunk's own metadata wins over the base."""
    rows = chunks.where("version_pk is not null and chunk_id is not null").dropDuplicates(["version_pk", "chunk_id"])
    pairs = {"object_pk": object_of_version_pk(F.col("version_pk")), "version_pk": F.col("version_pk"), "chunk_id": F.col("chunk_id"), "doc_type": F.col("doc_type"), "page_no": F.col("page_no").cast("string"),
             "slide_no": F.col("slide_no").cast("string"), "section_path": F.when(F.size("section_path") > 0, F.array_join("section_path", " / "))}
    base = F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values()))
    own = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(own), k), F.lit(False)))
    return rows.select("version_pk", "chunk_id", F.lit("text").alias("kind"), drop_empty(F.map_concat(kept, own)).alias("metadata"))


def embedding_requests(chunks: DataFrame, manifests: DataFrame, labels: DataFrame, assets: DataFrame | None = None, dimension: int = 1536) -> DataFrame:
    """(version_pk, chunk_id, chunk_type, kind, dimension, text, asset_uri, mime_type, metadata): what is to be embedded: every
    chunk as text, and assets (version_pk, asset_id, chunk_type, mime_type, asset_uri, page_no, slide_no, metadata) that are pictures.

    metadata: identity of the version and its language (labels: version_pk, label), then the chunk's own, then where it
    stands; what comes later wins. Exact duplicates count once.
    """
    part = F.split("version_pk", "#")
    at = lambda i: unescape_part(F.get(part, F.lit(i)))
    one = manifests.where("version_pk is not null").groupBy("version_pk").agg(F.max(F.struct("source_format", "doc_type")).alias("m"))
    known = one.select("version_pk", F.col("m.doc_type").alias("__doc_type"), F.col("m.source_format").alias("__format")).join(labels.groupBy("version_pk").agg(F.max("label").alias("__label")), "version_pk", "left")

    def with_metadata(rows: DataFrame, own: dict[str, Column]) -> DataFrame:
        joined = rows.join(known, "version_pk", "left")
        base = {"tenant_id": at(0), "bucket": at(1), "key": at(2), "version_id": at(3), "document_uri": uri_of_version_pk(F.col("version_pk")), "language": F.coalesce("__label", F.lit("zh")), "source_format": F.col("__format")}
        place = {"doc_type": F.col("__doc_type"), **own, "is_latest": F.lit("true"), "manifest_s3_uri": F.concat(F.lit("s3://manifests/"), F.sha1("version_pk"), F.lit("/manifest.json"))}
        first = F.map_from_arrays(F.array(*[F.lit(k) for k in base]), F.array(*[c.cast("string") for c in base.values()]))
        last = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in place]), F.array(*[c.cast("string") for c in place.values()])), lambda _, v: v.isNotNull())
        mine = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
        less = lambda a, b: F.map_filter(a, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(b), k), F.lit(False)))
        upper = F.map_concat(less(mine, last), last)
        return joined.withColumn("metadata", drop_empty(F.map_concat(less(first, upper), upper)))

    rows = chunks.where("version_pk is not null and chunk_id is not null").dropDuplicates(["version_pk", "chunk_id"])
    path = F.when(F.size("section_path") > 0, F.to_json("section_path"))
    span = F.when(F.col("page_span").isNotNull(), F.to_json(F.array("page_span.first", "page_span.last")))
    text = with_metadata(rows, {"page_no": F.col("page_no"), "page_span": span, "slide_no": F.col("slide_no"), "token_estimate": F.col("token_estimate"), "section_path": path})
    none = F.lit(None).cast("string")
    out = text.select("version_pk", "chunk_id", "chunk_type", F.lit("text").alias("kind"), F.lit(dimension).alias("dimension"), "text", none.alias("asset_uri"), none.alias("mime_type"), "metadata")
    if assets is not None:
        image = with_metadata(assets.where(F.col("chunk_type").isin(*IMAGES)), {"mime_type": F.col("mime_type"), "page_no": F.col("page_no"), "slide_no": F.col("slide_no")})
        out = out.unionByName(image.select("version_pk", F.col("asset_id").alias("chunk_id"), "chunk_type", F.lit("image").alias("kind"), F.lit(dimension).alias("dimension"), none.alias("text"), "asset_uri", "mime_type", "metadata"))
    return out


def fan_out(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each request for each written profile that takes its kind. Profiles are configuration: a handful of rows, broadcast."""
    takes = F.array_contains(F.col("kinds"), F.col("kind"))
    return wanted.join(F.broadcast(profiles.where("writes").select("profile_idx", "profile_id", "kinds")), takes).drop("kinds")


def vector_key(profile: Column, version_pk: Column, chunk_id: Column) -> Column:
    return F.concat_ws("#", profile, version_pk, chunk_id)


def superseded(versions: DataFrame, state: DataFrame) -> DataFrame:
    """(version_pk): versions that are not the current one of their object, or whose object is gone.

    versions: (version_pk); state: (object_pk, latest_version_id, is_deleted). Versions of unknown objects stay.
    """
    rows = versions.select("version_pk", object_of_version_pk(F.col("version_pk")).alias("object_pk"), F.substring_index("version_pk", "#", -1).alias("version_id"))
    joined = rows.join(state.select("object_pk", "latest_version_id", "is_deleted"), "object_pk")
    return joined.where(F.col("is_deleted") | ~F.col("version_id").eqNullSafe(F.col("latest_version_id"))).select("version_pk")


def cleanup_keys(chunks: DataFrame, state: DataFrame, profiles: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(profile_id, key): vectors of superseded versions, of chunks and of assets (version_pk, asset_id, chunk_type) that are
    pictures, in every written profile; each once."""
    keys = chunks.select("version_pk", "chunk_id")
    if assets is not None:
        keys = keys.unionByName(assets.where(F.col("chunk_type").isin(*IMAGES)).select("version_pk", F.col("asset_id").alias("chunk_id")))
    keys = keys.distinct()
    old = keys.join(superseded(keys.select("version_pk").distinct(), state), "version_pk", "left_semi")
    rows = old.join(F.broadcast(profiles.where("writes").select("profile_id")))
    return rows.select("profile_id", vector_key(F.col("profile_id"), F.col("version_pk"), F.col("chunk_id")).alias("key"))


def backfill_reasons(lookup: DataFrame, state: DataFrame, manifests: DataFrame, projection: DataFrame | None = None, profile: str | None = None, force: bool = False) -> DataFrame:
    """(object_pk, reason): why each looked-up object is to be embedded again, or not.

    lookup: one row an object; its version is compared with the current state, and must have a manifest. projection
    (version_pk, profile_id, query_status): versions that are indexed in the profile are already done, unless forced.
    """
    current = state.select("object_pk", F.col("latest_version_id").alias("current"), F.col("is_deleted").alias("gone"))
    rows = lookup.select("object_pk", "latest_version_id").join(current, "object_pk", "left")
    rows = rows.withColumn("version_pk", F.concat("object_pk", F.lit("#"), "latest_version_id")).join(manifests.select("version_pk", F.lit(True).alias("has")).distinct(), "version_pk", "left")
    ready = F.lit(False)
    if projection is not None and not force:
        done = projection.where((F.col("profile_id") == profile) & (F.col("query_status") == "INDEXED")).select("version_pk", F.lit(True).alias("ready")).distinct()
        rows, ready = rows.join(done, "version_pk", "left"), F.col("ready").isNotNull()
    reason = (
        F.when(F.col("gone").isNull(), "missing_state")
        .when(F.col("gone"), "deleted")
        .when(~F.col("current").eqNullSafe(F.col("latest_version_id")), "stale")
        .when(F.col("has").isNull(), "no_manifest")
        .when(ready, "already_projected")
        .otherwise("eligible")
    )
    return rows.select("object_pk", reason.alias("reason"))


def reason_counts(reasons: DataFrame, samples: int = 5) -> DataFrame:
    """(reason, objects, resume_after, samples): how many objects each reason has, the last key, and the first few keys."""
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("object_pk"))
    some = reasons.select("reason", "object_pk").withColumn("n", rank).where(F.col("n") <= samples).groupBy("reason").agg(F.sort_array(F.collect_list("object_pk")).alias("samples"))
    counts = reasons.groupBy("reason").agg(F.count("*").alias("objects"), F.max("object_pk").alias("resume_after"))
    return counts.join(some, "reason")


def summary(chunks: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(version_pk, chunks, pages, chars, last_ordinal, assets): what each version's manifest holds; exact duplicates count once."""
    rows = chunks.select("version_pk", "chunk_id", "chunk_type", F.length("text").alias("n"), "ordinal").dropDuplicates(["version_pk", "chunk_id"])
    page = F.when(F.col("chunk_type") == "page_text_chunk", 1).otherwise(0)
    out = rows.groupBy("version_pk").agg(F.count("*").alias("chunks"), F.sum(page).alias("pages"), F.sum("n").alias("chars"), F.max("ordinal").alias("last_ordinal"))
    if assets is None:
        return out.withColumn("assets", F.lit(0).cast("long"))
    n = assets.groupBy("version_pk").agg(F.count_distinct("asset_id").alias("assets"))
    return out.join(n, "version_pk", "left").withColumn("assets", F.coalesce("assets", F.lit(0).cast("long")))


def page_of(rows: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """The next n rows by key (and the other columns, in their order) after a cursor, with truncated: whether there are more.

    A top-k of n + 1, not a sort of everything."""
    rest = rows if after is None else rows.where(F.col(key) > after)
    order = [key, *[c for c in rows.columns if c != key and rows.schema[c].dataType.typeName() != "map"]]
    # n + 1 rows at most
    place = F.row_number().over(Window.partitionBy().orderBy(*order))
    some = rest.orderBy(*order).limit(n + 1).withColumn("__place", place)
    return some.withColumn("truncated", F.max("__place").over(Window.partitionBy()) > n).where(F.col("__place") <= n).drop("__place")


def batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Rows with batch_no, at most size in each batch of a group, without one task for a large group.

    Places come from prefix sums over hash buckets of a group, a bucket for about 10 000 rows; order within a bucket is by
    the given columns. Rows of equal order have no order among them.
    """
    buckets = max(1, -(-rows.count() // 10_000))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = placed.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order))
    joined = placed.withColumn("inside", inside).join(base, [group, "bucket"])
    return joined.withColumn("batch_no", F.floor((F.col("base") + F.col("inside") - 1) / size)).drop("bucket", "inside", "base")


def complete_versions(versions: DataFrame, profiles: DataFrame, marks: DataFrame) -> DataFrame:
    """(version_pk, complete): whether every written profile is done with a version.

    marks: (version_pk, profile_id, done). A profile without a mark is not done; without any written profile nothing is
    complete. Profiles are few and broadcast; marks are reduced to one row a pair before the join.
    """
    wanted = profiles.where("writes").select("profile_id")
    best = marks.groupBy("version_pk", "profile_id").agg(F.bool_or("done").alias("done"))
    done = best.join(F.broadcast(wanted), "profile_id").where("done").groupBy("version_pk").agg(F.count("*").alias("n"))
    total = wanted.count()
    rows = versions.select("version_pk").distinct().join(done, "version_pk", "left")
    return rows.select("version_pk", (F.lit(total > 0) & (F.coalesce("n", F.lit(0)) == total)).alias("complete"))


def two_generations(wanted: DataFrame, lookup: DataFrame) -> DataFrame:
    """(bucket, object_key, pk, object_pk): each wanted key's lookup row, of the newer key generation if there is one.

    wanted: (bucket, object_key). Several rows of one key: the greatest object_pk stands.
    """
    tail = F.concat(escape_part(F.col("bucket")), F.lit("#"), escape_part(F.col("object_key")))
    keys = wanted.select("bucket", "object_key", F.concat(F.lit("lookup-v2#"), tail).alias("new"), F.concat(F.lit("lookup#"), tail).alias("old")).distinct()
    one = lookup.where("pk is not null").groupBy("pk").agg(F.max("object_pk").alias("object_pk"))
    both = keys.join(one.select(F.col("pk").alias("new"), F.col("object_pk").alias("new_object")), "new", "left").join(one.select(F.col("pk").alias("old"), F.col("object_pk").alias("old_object")), "old", "left")
    pk = F.when(F.col("new_object").isNotNull(), F.col("new")).when(F.col("old_object").isNotNull(), F.col("old"))
    return both.select("bucket", "object_key", pk.alias("pk"), F.coalesce("new_object", "old_object").alias("object_pk"))


def flag_latest(index: DataFrame, state: DataFrame) -> DataFrame:
    """Index rows with is_latest as the state has it; rows of unknown objects keep their own flag."""
    rows = index.withColumn("object_pk", object_of_version_pk(F.col("version_pk")))
    known = state.select("object_pk", F.when(~F.col("is_deleted"), F.concat("object_pk", F.lit("#"), "latest_version_id")).alias("current"), F.lit(True).alias("known"))
    joined = rows.join(known, "object_pk", "left")
    flag = F.when(F.col("known"), F.col("version_pk").eqNullSafe(F.col("current"))).otherwise(F.col("is_latest"))
    return joined.withColumn("is_latest", flag).drop("object_pk", "current", "known")
