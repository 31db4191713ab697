"""Search from a question to what is shown: tenant, governance by version and projection, context, and what may be told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.identity import document_id, object_of_version_pk, unescape_part, uri_of_version_pk
from docloom.io import blank_to_null
from docloom.operators import vectors as vec

# Metadata that is kept inside.
INTERNAL = ("tenant_id", "bucket", "key", "manifest_s3_uri", "profile_id", "provider", "model", "dimension", "security_scope", "chunk_id")
INDEXED = "INDEXED"


def resolve_tenant(claim: str | None, asked: str | None = None, anonymous: bool = False, default: str | None = None) -> str:
    """The tenant to search for: a claim wins and must equal what is asked for; without one, what is asked for or a default
    only if anonymous callers are allowed. The tenant of unknown origin, lookup, is never searched."""
    claim, asked = (claim or "").strip(), (asked or "").strip()
    if claim and asked and claim != asked:
        raise PermissionError("the tenant asked for is not the caller's")
    if not claim and not anonymous:
        raise PermissionError("no tenant")
    tenant = claim or asked or (default or "").strip()
    if not tenant or tenant == "lookup":
        raise PermissionError("no tenant")
    return tenant


def searchable(tenant: str, doc_type: str | None = None, key: str | None = None) -> Column:
    """What may be found at all, before the search: the tenant always, kind and key where they are given."""
    if not tenant.strip():
        raise ValueError("a tenant is required")
    tests = [F.col("tenant_id") == tenant] + [F.col(c) == v for c, v in (("doc_type", doc_type), ("object_key", key)) if v]
    return reduce(lambda a, b: a & b, tests)


def govern_versions(hits: DataFrame, state: DataFrame, projection: DataFrame | None = None) -> DataFrame:
    """hits (qid, place, version_pk, profile_id, is_latest, ...) that may be shown, with final_rank, gaps closed.

    state (object_pk, latest_version_id, is_deleted) must name the hit's version as the current one; without a row for the
    object, hits marked is_latest stay. projection (version_pk, profile_id, query_status), where it is given, must be
    indexed; without a row, hits marked is_latest stay. Hits are few; their state is looked up by key.
    """
    latest = F.coalesce("is_latest", F.lit(False))
    rows = hits.withColumn("object_pk", object_of_version_pk(F.col("version_pk")))
    wanted = rows.select("object_pk").distinct()
    known = state.join(wanted, "object_pk", "left_semi").select("object_pk", F.concat("object_pk", F.lit("#"), "latest_version_id").alias("__current"), F.col("is_deleted").alias("__gone"), F.lit(True).alias("__known"))
    rows = rows.join(known, "object_pk", "left")
    keep = F.when(F.col("__known"), ~F.coalesce("__gone", F.lit(False)) & F.col("version_pk").eqNullSafe(F.col("__current"))).otherwise(latest)
    if projection is not None:
        one = projection.groupBy("version_pk", "profile_id").agg(F.max(F.coalesce(F.col("query_status"), F.lit("")) == INDEXED).alias("__ready"))
        rows = rows.join(one, ["version_pk", "profile_id"], "left")
        keep = keep & F.coalesce("__ready", latest)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return rows.where(keep).withColumn("final_rank", rank).drop("__current", "__gone", "__known", "__ready")


def public_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.isin(*INTERNAL))


def with_context(hits: DataFrame, chunks: DataFrame, n: int = 1, assets: DataFrame | None = None) -> DataFrame:
    """hits (qid, final_rank, version_pk, chunk_id, ...) with the text of the chunk, else of the asset of that name, and
    neighbours, array<struct<offset, chunk_id, text>>, up to n on either side. Hits that are neither are left out."""
    wanted = hits.select("version_pk", "chunk_id").distinct()
    near = chunks.join(wanted.select("version_pk").distinct(), "version_pk", "left_semi").dropDuplicates(["version_pk", "chunk_id"])
    own = near.join(wanted, ["version_pk", "chunk_id"], "left_semi").select("version_pk", "chunk_id", F.struct(F.lit("chunk").alias("source"), "text").alias("__chunk"))
    rows = hits.join(own, ["version_pk", "chunk_id"], "left")
    match = F.col("__chunk")
    if assets is not None:
        other = assets.join(wanted, (assets["version_pk"] == wanted["version_pk"]) & (assets["asset_id"] == wanted["chunk_id"]), "left_semi")
        other = other.groupBy("version_pk", F.col("asset_id").alias("chunk_id")).agg(F.max(F.struct(F.lit("asset").alias("source"), F.col("payload").alias("text"))).alias("__asset"))
        rows = rows.join(other, ["version_pk", "chunk_id"], "left")
        match = F.coalesce("__chunk", "__asset")
    rows = rows.withColumn("match", match).where("match is not null").drop("__chunk", "__asset")
    places = near.select("version_pk", "chunk_id", "ordinal")
    around = vec.neighbours_of(own.select("version_pk", "chunk_id"), places, n)
    texts = near.select("version_pk", F.col("chunk_id").alias("neighbour_id"), F.col("text").alias("neighbour_text"))
    each = around.join(texts, ["version_pk", "neighbour_id"]).groupBy("version_pk", "chunk_id")
    # at most 2n of them
    listed = each.agg(F.array_sort(F.collect_list(F.struct("offset", F.col("neighbour_id").alias("chunk_id"), F.col("neighbour_text").alias("text")))).alias("neighbours"))
    rows = rows.join(listed, ["version_pk", "chunk_id"], "left")
    return rows.withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<struct<offset:int,chunk_id:string,text:string>>")))


def answer_rows(found: DataFrame) -> DataFrame:
    """(qid, rank, document_id, object_pk, version_id, document_uri, fusion_score, profile_hit_count, metadata, match,
    neighbours) of governed hits with context: what callers are told."""
    part = F.split("version_pk", "#")
    at = lambda i: unescape_part(F.get(part, F.lit(i)))
    return found.select(
        "qid", F.col("final_rank").alias("rank"), document_id(at(0), at(1), at(2), at(3)).alias("document_id"), object_of_version_pk(F.col("version_pk")).alias("object_pk"), at(3).alias("version_id"),
        uri_of_version_pk(F.col("version_pk")).alias("document_uri"), F.col("score").alias("fusion_score"), F.col("hits").alias("profile_hit_count"), public_metadata(F.col("metadata")).alias("metadata"), "match", "neighbours",
    )


def answers_json(answers: DataFrame) -> DataFrame:
    """(qid, rank, answer): each answer as one JSON text."""
    return answers.select("qid", "rank", F.to_json(F.struct(*[c for c in answers.columns if c != "qid"])).alias("answer"))


def degraded_profiles(failures: DataFrame) -> DataFrame:
    """(profile_id, stage, manifest_uri, error): each failing part of a search once, with its first error by the order of seq."""
    first = F.min(F.struct("seq", "error"))
    return failures.groupBy("profile_id", "stage", "manifest_uri").agg(first.alias("f")).select("profile_id", "stage", "manifest_uri", "f.error")


def of_tenant(rows: DataFrame, tenant: str, key: str = "object_pk") -> DataFrame:
    """Rows whose key is the tenant's: what is looked up for one tenant is never another's."""
    return rows.where(blank_to_null(unescape_part(F.substring_index(F.col(key), "#", 1))) == tenant)
