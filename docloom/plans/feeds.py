"""Queries of the general problems: change feeds (p3) and repeated messages (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.io import table
from docloom.operators.changes import current_rows, fold_changes
from docloom.streaming.messages import repeated_deliveries


def p3_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fold_changes(table(spark, sf_dir, "object_lookup"), table(spark, sf_dir, "lookup_changes"))
    return state.select("object_pk", "latest_version_id", "latest_sequencer", "is_deleted")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(p3_state(spark, sf_dir)).select("object_pk", "latest_version_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(spark, f"{sf_dir}/extract_jobs.parquet")


QUERIES = {"p3_found": p3_found, "p3_state": p3_state, "p4_found": p4_found}

_SEQ = "nullif(ltrim(upper(trim({0})), '0'), '')"
_STATE = """
with every as (
  select object_pk, latest_version_id, latest_sequencer, is_deleted, null as op from object_lookup
  union all select object_pk, latest_version_id, latest_sequencer, is_deleted, op from lookup_changes
), rows as (
  select object_pk, latest_version_id, coalesce(op = 'D', false) or coalesce(is_deleted, false) as gone,
    case when trim(coalesce(latest_sequencer, '')) = '' then null
         else coalesce(nullif(ltrim(upper(trim(latest_sequencer)), '0'), ''), '0') end as seq
  from every where coalesce(object_pk, '') <> ''
), ranked as (
  select *, rank() over (partition by object_pk order by seq is not null desc, length(seq) desc, seq desc) as r from rows
)
select object_pk, max_by(latest_version_id, (gone, coalesce(latest_version_id, ''))) as latest_version_id,
  any_value(seq) as latest_sequencer, bool_or(gone) as is_deleted
from ranked where r = 1 group by object_pk
"""

SQL = {
    "p3_state": _STATE,
    "p3_found": f"select object_pk, latest_version_id from ({_STATE}) where not is_deleted",
    "p4_found": """
with rows as (
  select delivery_id, received_at, version_pk, upper(trim(operation)) as operation,
    case when trim(coalesce(sequencer, '')) = '' then null
         else coalesce(nullif(ltrim(upper(trim(sequencer)), '0'), ''), '0') end as seq,
    coalesce(nullif(trim(trace_id), ''), 's3://' || url_decode(split_part(version_pk, '#', 2)) || '/'
      || replace(split_part(version_pk, '#', 3), '%2F', '/') || '?versionId=' || split_part(version_pk, '#', 4)) as trace
  from extract_jobs where delivery_id is not null
)
select delivery_id from (
  select delivery_id, row_number() over (partition by version_pk, operation, seq, trace
    order by received_at nulls last, delivery_id) as n from rows)
where n > 1
""",
}
