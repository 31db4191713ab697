"""Applying a change feed: a commutative fold of base rows and changes into one state row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.identity import sequencer_order

#: Columns that the fold reads; any of them but object_pk may be absent and then counts as null.
PAYLOAD = ("latest_version_id", "latest_manifest_s3_uri", "updated_at")


def _column(df: DataFrame, name: str, kind: str) -> F.Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def as_changes(df: DataFrame) -> DataFrame:
    """Base rows, feed rows or an earlier state, as rows that the fold can take: (object_pk, order, gone, payload).

    A row is a removal if its op is D, in any letter case, or is_deleted is true; both may be null. Rows with a null
    or empty object_pk belong to no object and are left out.
    """
    op = F.upper(F.trim(_column(df, "op", "string")))
    gone = F.coalesce(op == "D", F.lit(False)) | F.coalesce(_column(df, "is_deleted", "boolean"), F.lit(False))
    payload = F.struct(*[_column(df, c, "timestamp" if c == "updated_at" else "string").alias(c) for c in PAYLOAD])
    key = F.col("object_pk")
    return df.select(
        key,
        sequencer_order(_column(df, "latest_sequencer", "string")).alias("order"),
        gone.alias("gone"),
        payload.alias("payload"),
    ).where(key.isNotNull() & (key != ""))


def fold_changes(*parts: DataFrame) -> DataFrame:
    """State after all rows of all parts, in any order and number of arrivals: one row a key, tombstones included.

    The maximum of (sequencer by value, removal, payload) decides. Maximum is commutative, associative and idempotent:
    repeated and late rows change nothing, partial maxima are built before the shuffle (so a key with a third of all
    rows sends one row a task), and a state can itself be folded with later changes. Rows without a sequencer count
    below all others; of two rows with the deciding sequencer a removal wins, then the greatest payload, so a null
    version never beats one that is given. Empty parts give an empty state.
    """
    rows = as_changes(parts[0])
    for p in parts[1:]:
        rows = rows.unionByName(as_changes(p))
    top = rows.groupBy("object_pk").agg(F.max(F.struct("order", "gone", "payload")).alias("top"))
    return top.select(
        "object_pk",
        "top.payload.latest_version_id",
        F.nullif(F.col("top.order.value"), F.lit("")).alias("latest_sequencer"),
        "top.payload.latest_manifest_s3_uri",
        F.col("top.gone").alias("is_deleted"),
        "top.payload.updated_at",
    )


def current_rows(state: DataFrame) -> DataFrame:
    """The objects of a state that exist."""
    return state.where(~F.col("is_deleted"))
