"""Queries of the document pipeline's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import identity as ident
from docloom.io import new_path, stream_source, table
from docloom.operators import events as ev
from docloom.operators import manifests as mf
from docloom.operators import markdown as md
from docloom.operators import pages as pg
from docloom.operators import text as tx
from docloom.operators import vectors as vec
from docloom.operators.changes import fold_changes
from docloom.sources import ocr
from docloom.streaming.versions import judged_rows, judged_stream

K, NEIGHBOURS = 10, 1
PROFILES = [mf.Profile("main", 64), mf.Profile("images", 64, ("image",)), mf.Profile("short", 32), mf.Profile("paused", 32, enable_write=False)]
HOSTS = ["*.archive.example.com", "vendor.example.org"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------ identity and text

_URI = "'s3://' || bucket || '/' || replace(url_encode(object_key), '%2F', '/') || '?versionId=' || url_encode(version_id)"
_OBJ = "url_encode(tenant_id) || '#' || url_encode(bucket) || '#' || url_encode(object_key)"


@query(f"""
select delivery_id, {_OBJ} as object_pk, {_OBJ} || '#' || url_encode(version_id) as version_pk, {_URI} as document_uri,
  case when contains(object_key, '.') then lower(regexp_extract(object_key, '[^.]*$')) else '' end as extension,
  'doc_' || substr(sha1(tenant_id || chr(0) || bucket || chr(0) || object_key || chr(0) || version_id), 1, 20) as document_id
from extract_jobs
""")
def ident_keys(spark: SparkSession, d: str) -> DataFrame:
    t, b, k, v = (F.col(c) for c in ("tenant_id", "bucket", "object_key", "version_id"))
    return table(spark, d, "extract_jobs").select(
        "delivery_id", ident.object_pk(t, b, k).alias("object_pk"), ident.version_pk(t, b, k, v).alias("version_pk"), ident.document_uri(b, k, v).alias("document_uri"),
        ident.extension(k).alias("extension"), ident.document_id(t, b, k, v).alias("document_id"),
    )


@query("""
select version_pk, url_decode(split_part(version_pk, '#', 1)) as tenant, split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3) as object_pk,
  's3://' || url_decode(split_part(version_pk, '#', 2)) || '/' || replace(split_part(version_pk, '#', 3), '%2F', '/') || '?versionId=' || split_part(version_pk, '#', 4) as uri
from manifests
""")
def pk_parts(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("version_pk")
    return table(spark, d, "manifests").select("version_pk", ident.tenant_of_pk(v).alias("tenant"), ident.object_of_version_pk(v).alias("object_pk"), ident.uri_of_version_pk(v).alias("uri"))


@query("""
select feed_pos, case when length(s) < 32 then lpad(s, 32, '0') else s end as sequencer
from (select feed_pos, nullif(upper(trim(latest_sequencer)), '') as s from lookup_changes)
""")
def sequencer_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lookup_changes").select("feed_pos", ident.sequencer_norm(F.col("latest_sequencer")).alias("sequencer"))


_NORM = "regexp_replace(regexp_replace(replace(replace(regexp_replace(text, '\\s+style=(\"[^\"]*\"|''[^'']*'')', '', 'gi'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"select doc_id, sha1(n) as digest, length(n) as chars from (select doc_id, {_NORM} as n from documents)")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = tx.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha1(n).alias("digest"), F.length(n).cast("long").alias("chars"))


_COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_TOKENS = "coalesce(cast(ceil(length(" + _COLLAPSED + ") / 4.0) as bigint), 0)"


@query(f"select version_pk, chunk_id, {_TOKENS.format('text')} as tokens, coalesce(token_estimate = {_TOKENS.format('text')}, false) as agrees from chunks")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = tx.estimate_tokens(F.col("text"))
    return table(spark, d, "chunks").select("version_pk", "chunk_id", n.alias("tokens"), F.coalesce(F.col("token_estimate") == n, F.lit(False)).alias("agrees"))


@query("""
select doc_id, case when length(s) <= 512 then s else regexp_replace(substr(s, 1, 511), '\\s+$', '') || '…' end as preview
from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as s from documents)
""")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query(r"""
select doc_id, count(distinct u) as urls, min(u) as first_url from (
  select doc_id, unnest(regexp_extract_all(text || chr(10) || '![scan](<img/' || doc_id || '.png> "page") ![b](img/b.png) ![scan](<img/' || doc_id || '.png>)', '!\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)', 1)) as u
  from documents) group by doc_id
""")
def image_urls(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png>"))
    text = F.concat("text", F.lit("\n![scan](<"), own, F.lit(' "page") ![b](img/b.png) ![scan](<'), own, F.lit(")"))
    urls = tx.image_urls(text)
    return table(spark, d, "documents").select("doc_id", F.size(urls).cast("long").alias("urls"), F.array_min(urls).alias("first_url")).where("first_url is not null")


@query("""
select doc_id, sha1(replace(replace(text, 'the scanner', 'SCAN'), 'the', 'a')) as digest from documents
""")
def link_rewrite(spark: SparkSession, d: str) -> DataFrame:
    links = F.create_map(F.lit("the"), F.lit("a"), F.lit("the scanner"), F.lit("SCAN"))
    return table(spark, d, "documents").select("doc_id", F.sha1(tx.rewrite_links(F.col("text"), links)).alias("digest"))


@query("""
select doc_id, row_number() over (partition by doc_id order by i) as window_no, w as text from (
  select doc_id, i, regexp_replace(substr(text, (i - 1) * 2800 + 1, 2800), '^\\s+|\\s+$', '', 'g') as w
  from (select doc_id, text, unnest(range(1, greatest(1, cast(ceil(length(text) / 2800.0) as bigint)) + 1)) as i from documents where text is not null))
where w <> ''
""")
def forced_windows(spark: SparkSession, d: str) -> DataFrame:
    windows = tx.forced_windows(F.col("text"), 2800)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(windows).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("window_no"), "text")


@query("""
select doc_id, host_ok from (select doc_id, lower(regexp_replace(coalesce(trim(source), ''), '[^A-Za-z0-9-]', '', 'g')) as s,
  case when s = '' then false when doc_type = 'pdf' then true else s = 'vendor' end as host_ok from documents)
""")
def host_allowed(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.regexp_replace(F.coalesce(F.trim("source"), F.lit("")), "[^A-Za-z0-9-]", ""))
    url = F.when(s == "", F.lit("https:///none")).when(F.col("doc_type") == "pdf", F.concat(F.lit("https://"), s, F.lit(".archive.example.com/x?y=1"))).otherwise(F.concat(F.lit("https://"), s, F.lit(".example.org/x")))
    return table(spark, d, "documents").select("doc_id", tx.allowed_host(url, HOSTS).alias("host_ok"))


@query("""
select version_pk, chunk_id, k as name, case when regexp_matches(lower(k), 'api_key|authorization|credential|password|private_key|secret|token') then '[redacted]' else substr(v, 1, 2000) end as value from (
  select version_pk, chunk_id, unnest(map_keys(m)) as k, unnest(map_values(m)) as v from (
    select distinct version_pk, chunk_id, map_concat(coalesce(metadata, map()), map {'Reader_Token': chunk_id, 'note': repeat(chunk_id, 200), 'left': ' '}) as m from chunks))
where trim(coalesce(v, '')) <> ''
""")
def metadata_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of chunks, to which a secret, a long and a blank value are added."""
    more = F.create_map(F.lit("Reader_Token"), F.col("chunk_id"), F.lit("note"), F.repeat("chunk_id", F.lit(200)), F.lit("left"), F.lit(" "))
    mine = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), more)
    return table(spark, d, "chunks").select("version_pk", "chunk_id", F.explode(tx.redact(tx.drop_empty(mine))).alias("name", "value")).distinct()


# ------------------------------------------------------------ events and versions

def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries written as the JSON they came in: direct ones plainly, queued ones wrapped once."""
    jobs = table(spark, d, "extract_jobs")
    name = F.when(F.upper(F.trim("operation")) == "DELETE", "ObjectRemoved:Delete").otherwise("ObjectCreated:Put")
    thing = F.struct(F.col("object_key").alias("key"), F.col("version_id").alias("versionId"), "sequencer", F.col("etag").alias("eTag"))
    record = F.struct(F.lit("2.1").alias("eventVersion"), F.lit("aws:s3").alias("eventSource"), name.alias("eventName"), "tenant_id", "language",
                      F.create_map(F.lit("x-amz-request-id"), F.col("trace_id")).alias("responseElements"), F.struct(F.struct(F.col("bucket").alias("name")).alias("bucket"), thing.alias("object")).alias("s3"))
    inner = F.to_json(F.struct(F.array(record).alias("Records")))
    outer = F.to_json(F.struct(F.array(F.struct(F.lit("aws:sqs").alias("eventSource"), inner.alias("body"))).alias("Records")))
    return jobs.select(F.col("delivery_id").alias("envelope_id"), F.when(F.col("source") == "queue", outer).otherwise(inner).alias("payload"))


_KEY = "url_decode(replace(object_key, '+', ' '))"


@query(f"""
with k as (select *, {_KEY} as key from extract_jobs)
select delivery_id as envelope_id, case when upper(trim(operation)) = 'DELETE' then 'DELETE' else 'UPSERT' end as operation,
  coalesce(nullif(trim(tenant_id), ''), 'lookup') as tenant_id, bucket, key as object_key, nullif(trim(version_id), '') as version_id,
  case when length(nullif(upper(trim(sequencer)), '')) < 32 then lpad(upper(trim(sequencer)), 32, '0') else nullif(upper(trim(sequencer)), '') end as sequencer,
  coalesce(nullif(trim(language), ''), 'zh') as language,
  coalesce(nullif(trim(trace_id), ''), 's3://' || bucket || '/' || replace(url_encode(key), '%2F', '/') || '?versionId=' || url_encode(trim(version_id))) as trace_id
from k where nullif(trim(version_id), '') is not null and bucket is not null and object_key is not null
""")
def event_parse(spark: SparkSession, d: str) -> DataFrame:
    return ev.messages(ev.envelope_records(_envelopes(spark, d)))


def _log(spark: SparkSession, d: str) -> DataFrame:
    version = F.col("event_id").cast("string")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("object"), F.md5(version).alias("arrival"), version.alias("version"), F.lpad(F.hex("event_id"), 32, "0").alias("seq"), op.alias("op")
    )


_JUDGED = """
log as (select cast(user_id as varchar) as object, md5(cast(event_id as varchar)) as arrival, cast(event_id as varchar) as version,
    lpad(upper(to_hex(event_id)), 32, '0') as seq, case when event_type = 'error' then 'DELETE' else 'UPSERT' end as op from events),
counted as (select *, op = 'DELETE' and coalesce(sum((op = 'UPSERT')::int) over (partition by object order by arrival, seq, version
    rows between unbounded preceding and 1 preceding), 0) = 0 as orphan from log),
judged as (select *, case when orphan then 'delete_without_object' when seq <= max(case when not orphan then seq end) over (
    partition by object order by arrival, seq, version rows between unbounded preceding and 1 preceding) then 'stale' else 'accepted' end as reason from counted)
"""


@query(f"with {_JUDGED} select object, version, seq, op, reason from judged")
def event_accept(spark: SparkSession, d: str) -> DataFrame:
    return ev.judge_events(_log(spark, d)).select("object", "version", "seq", "op", "reason")


@query(f"""with {_JUDGED}, taken as (select *, lag(version) over (partition by object order by seq) as previous_version,
  row_number() over (partition by object order by seq desc) as n from judged where reason = 'accepted')
select object, version, seq, op = 'DELETE' as is_deleted, previous_version from taken where n = 1""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return ev.latest_versions(ev.judge_events(_log(spark, d)))


@query(f"with {_JUDGED} select reason, count(*) as events, count(distinct object) as objects from judged group by reason")
def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.outcome_counts(ev.judge_events(_log(spark, d)))


@query(f"with {_JUDGED} select object, version, seq, op, reason from judged")
def stream_accept(spark: SparkSession, d: str) -> DataFrame:
    """The same judgement by the stateful stream, read in one go so that arrival orders the events."""
    path = f"{d}/events.parquet"
    folder, options = stream_source(spark, path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(folder)
    version = F.col("event_id").cast("string")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT")
    log = source.select(F.col("user_id").cast("string").alias("object"), F.md5(version).alias("arrival"), version.alias("version"), F.lpad(F.hex("event_id"), 32, "0").alias("seq"), op.alias("op"))
    at = new_path(spark, "judged")
    judged_stream(log, at).trigger(availableNow=True).start().awaitTermination()
    return judged_rows(spark, at)


# ------------------------------------------------------------ lookups

_PREFERRED = """select * exclude (n) from (select *, row_number() over (partition by object_pk
  order by starts_with(pk, 'lookup#')::int, updated_at desc nulls last, pk desc) as n from object_lookup where object_pk is not null) where n = 1"""


@query(f"select object_pk, pk, latest_version_id from ({_PREFERRED})")
def lookup_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ev.prefer_lookup(table(spark, d, "object_lookup")).select("object_pk", "pk", "latest_version_id")


@query("""select object_pk, pk, (select count(*) from object_lookup where object_pk > 'tn-h') > 500 as truncated from object_lookup where object_pk > 'tn-h' order by object_pk, pk limit 500""")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return mf.page_of(table(spark, d, "object_lookup").select("object_pk", "pk"), "object_pk", "tn-h", 500)


@query("""
select j.version_pk, j.deliveries, l.is_deleted, l.latest_version_id from
  (select version_pk, count(*) as deliveries, any_value(split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3)) as object_pk
   from extract_jobs where version_pk is not null group by version_pk) j
left join (""" + _PREFERRED + ") l on j.object_pk = l.object_pk")  # fmt: skip
def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "extract_jobs").where("version_pk is not null").groupBy("version_pk").agg(F.count("*").alias("deliveries"))
    wanted = wanted.withColumn("object_pk", ident.object_of_version_pk(F.col("version_pk")))
    return ev.lookup_of(wanted, table(spark, d, "object_lookup")).drop("object_pk")


@query("""
select object_pk, version_id, is_marker, place from (
  select object_pk, version_id, is_marker, row_number() over (partition by object_pk order by is_marker, seq desc nulls last, version_id) as place from (
    select object_pk, latest_version_id as version_id, bool_and(op = 'D') as is_marker,
      max(lpad(nullif(upper(trim(latest_sequencer)), ''), 40, '0')) as seq
    from lookup_changes where object_pk is not null and latest_version_id is not null group by all))
where place <= 10
""")
def version_list(spark: SparkSession, d: str) -> DataFrame:
    """The versions of each object, live ones before delete markers, newest first, ten at most."""
    return ev.version_list(table(spark, d, "lookup_changes"), 10)


# ------------------------------------------------------------ manifests, chunks, requests

_ONE = "(select distinct on (version_pk, chunk_id) * from chunks)"


@query(f"""select version_pk, 'chunk#' || chunk_id as sk, ordinal, true as is_latest, token_estimate,
  case when length(s) <= 512 then s else regexp_replace(substr(s, 1, 511), '\\s+$', '') || '…' end as preview
from (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as s from {_ONE})""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return mf.index_rows(table(spark, d, "chunks"))


@query("""
select version_pk, count(*) as chunks, cast(sum((chunk_type = 'page_text_chunk')::int) as bigint) as pages, cast(sum(length(text)) as bigint) as chars, max(ordinal) as last_ordinal
from (select distinct version_pk, chunk_id, chunk_type, text, ordinal from chunks) group by version_pk
""")
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return mf.summary(table(spark, d, "chunks")).drop("assets")


@query(f"""
with base as (select version_pk, chunk_id, coalesce(metadata, map()) as own, {{'object_pk': split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3),
    'version_pk': version_pk, 'chunk_id': chunk_id, 'doc_type': doc_type, 'page_no': cast(page_no as varchar), 'slide_no': cast(slide_no as varchar),
    'section_path': case when len(section_path) > 0 then array_to_string(section_path, ' / ') end}} as b from {_ONE} where version_pk is not null and chunk_id is not null),
pairs as (
  select version_pk, chunk_id, own, unnest(['object_pk', 'version_pk', 'chunk_id', 'doc_type', 'page_no', 'slide_no', 'section_path']) as name,
    unnest([b.object_pk, b.version_pk, b.chunk_id, b.doc_type, b.page_no, b.slide_no, b.section_path]) as value, false as mine from base
  union all select version_pk, chunk_id, own, unnest(map_keys(own)), unnest(map_values(own)), true from base)
select version_pk, chunk_id, 'text' as kind, name, value from pairs where trim(coalesce(value, '')) <> '' and (mine or not list_contains(map_keys(own), name))
""")
def request_build(spark: SparkSession, d: str) -> DataFrame:
    return mf.requests(table(spark, d, "chunks")).select("version_pk", "chunk_id", "kind", F.explode("metadata").alias("name", "value"))


@query(f"select version_pk, chunk_id, p as profile_id, p || '#' || version_pk || '#' || chunk_id as key from {_ONE}, (values ('main'), ('short')) as t(p)")
def profile_fanout(spark: SparkSession, d: str) -> DataFrame:
    fan = mf.fan_out(mf.requests(table(spark, d, "chunks")), mf.profile_table(spark, PROFILES))
    return fan.select("version_pk", "chunk_id", "profile_id", mf.vector_key(F.col("profile_id"), F.col("version_pk"), F.col("chunk_id")).alias("key"))


@query("""
with sizes as (select profile_id, batch_no, count(*) as rows from (select p as profile_id, floor((row_number() over (partition by p order by version_pk, chunk_id) - 1) / 500) as batch_no
  from (select distinct version_pk, chunk_id from chunks), (values ('main'), ('short')) as t(p)) group by all)
select profile_id, cast(batch_no as bigint) as batch_no, rows from sizes
""")
def vector_batches(spark: SparkSession, d: str) -> DataFrame:
    """Writes of at most 500 vectors: how many batches each profile needs and how full they are."""
    fan = mf.fan_out(mf.requests(table(spark, d, "chunks")), mf.profile_table(spark, PROFILES)).select("profile_id", "version_pk", "chunk_id")
    return mf.batches(fan, "profile_id", ["version_pk", "chunk_id"], 500).groupBy("profile_id", "batch_no").agg(F.count("*").alias("rows"))


_STATE = """(select object_pk, max_by(latest_version_id, (gone, coalesce(latest_version_id, ''))) as latest_version_id, bool_or(gone) as is_deleted from (
  select *, rank() over (partition by object_pk order by seq is not null desc, length(seq) desc, seq desc) as r from (
    select object_pk, latest_version_id, coalesce(op = 'D', false) or coalesce(is_deleted, false) as gone,
      case when trim(coalesce(latest_sequencer, '')) = '' then null else coalesce(nullif(ltrim(upper(trim(latest_sequencer)), '0'), ''), '0') end as seq
    from (select object_pk, latest_version_id, latest_sequencer, is_deleted, null as op from object_lookup
          union all select object_pk, latest_version_id, latest_sequencer, is_deleted, op from lookup_changes) where coalesce(object_pk, '') <> '')) where r = 1 group by object_pk)"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    return fold_changes(table(spark, d, "object_lookup"), table(spark, d, "lookup_changes"))


@query(f"""
select p as profile_id, p || '#' || version_pk || '#' || chunk_id as key from (select distinct version_pk, chunk_id from chunks) c
join {_STATE} s on s.object_pk = split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3)
cross join (values ('main'), ('images'), ('short')) as t(p)
where is_deleted or latest_version_id is distinct from split_part(version_pk, '#', 4)
""")
def cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    return mf.cleanup_keys(table(spark, d, "chunks"), _state(spark, d), mf.profile_table(spark, PROFILES))


_REASONS = f"""(select l.object_pk, case when s.object_pk is null then 'missing_state' when s.is_deleted then 'deleted'
  when s.latest_version_id is distinct from l.latest_version_id then 'stale' when m.version_pk is null then 'no_manifest' else 'eligible' end as reason
from ({_PREFERRED}) l left join {_STATE} s on l.object_pk = s.object_pk
left join (select distinct version_pk from manifests) m on m.version_pk = l.object_pk || '#' || l.latest_version_id)"""


@query(f"select object_pk, reason from {_REASONS}")
def backfill_reasons(spark: SparkSession, d: str) -> DataFrame:
    return mf.backfill_reasons(ev.prefer_lookup(table(spark, d, "object_lookup")), _state(spark, d), table(spark, d, "manifests"))


@query(f"select reason, count(*) as objects, max(object_pk) as resume_after, array_to_string(list_slice(list_sort(list(object_pk)), 1, 5), '|') as samples from {_REASONS} group by reason")
def backfill_counts(spark: SparkSession, d: str) -> DataFrame:
    return mf.reason_counts(backfill_reasons(spark, d)).withColumn("samples", F.array_join("samples", "|"))


@query(f"""
select c.version_pk, c.chunk_id from (select distinct version_pk, chunk_id from chunks) c
join {_STATE} s on s.object_pk || '#' || s.latest_version_id = c.version_pk where not s.is_deleted
""")
def current_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the versions that are current."""
    live = _state(spark, d).where("not is_deleted").select(F.concat("object_pk", F.lit("#"), "latest_version_id").alias("version_pk"))
    return table(spark, d, "chunks").select("version_pk", "chunk_id").distinct().join(live, "version_pk", "left_semi")


@query(f"""
select version_pk, 'chunk#' || chunk_id as sk, case when s.object_pk is null then true else not s.is_deleted and s.object_pk || '#' || s.latest_version_id is not distinct from version_pk end as is_latest
from (select distinct version_pk, chunk_id from chunks) c
left join {_STATE} s on s.object_pk = split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3)
""")
def index_latest(spark: SparkSession, d: str) -> DataFrame:
    return mf.flag_latest(mf.index_rows(table(spark, d, "chunks")), _state(spark, d)).select("version_pk", "sk", "is_latest")


@query("""
select cast(o_orderkey as varchar) as version_pk, coalesce(n, 0) = 2 as complete from (select distinct o_orderkey from orders) o
left join (select l_orderkey, count(distinct l_linenumber) as n from lineitem where l_linenumber in (1, 2) and l_linestatus = 'F' group by l_orderkey) on l_orderkey = o_orderkey
""")
def version_complete(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions, their first two lines as the marks of two profiles."""
    profiles = mf.profile_table(spark, [mf.Profile("1", 64), mf.Profile("2", 32), mf.Profile("3", 32, enabled=False)])
    marks = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("version_pk"), F.col("l_linenumber").cast("string").alias("profile_id"), (F.col("l_linestatus") == "F").alias("done"))
    return mf.complete_versions(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("version_pk")), profiles, marks)


@query("""
with w as (select distinct bucket, object_key, url_encode(bucket) || '#' || url_encode(object_key) as k from lookup_changes),
l as (select pk, max(object_pk) as object_pk from object_lookup where pk is not null group by pk)
select bucket, object_key, case when n.pk is not null then n.pk else o.pk end as pk, coalesce(n.object_pk, o.object_pk) as object_pk
from w left join l n on n.pk = 'lookup-v2#' || k left join l o on o.pk = 'lookup#' || k
""")
def lookup_generations(spark: SparkSession, d: str) -> DataFrame:
    return mf.two_generations(table(spark, d, "lookup_changes"), table(spark, d, "object_lookup"))


# ------------------------------------------------------------ Markdown and pages

_PLAIN = "regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def markdown_sql(source: str, soft: int = 1148, hard: int = 1400) -> tuple[str, str, str]:
    """Recursive common tables that read the Markdown of source (doc_id, text): up to blocks, up to sections, up to chunks."""
    features = f"""
texts as (select doc_id, string_split({_PLAIN}, chr(10)) as l from ({source}) where text is not null and {_PLAIN} <> ''),
lines as (select doc_id, i, l[i] as line, l[i + 1] as after from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from texts)),
marks as (select doc_id, i, trim(line) = '' as blank, line[1] = chr(9) or regexp_matches(line, '^ {{4}}') as deep, line[1] = chr(9) or regexp_matches(line, '^  ') as inner_,
  regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) as f, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 2) as info, regexp_extract(line, '^ {{0,3}}((`+)|(~+))\\s*$', 1) as bare,
  regexp_matches(line, '^ {{0,3}}#{{1,6}}(\\s|$)') as head, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})(\\s|$)', 1)) as level,
  regexp_extract(line, '^ {{0,3}}(=+|-+)\\s*$', 1) as under, regexp_matches(line, '^ {{0,3}}((\\*\\s*){{3,}}|(-\\s*){{3,}}|(_\\s*){{3,}})$') as rule,
  regexp_extract(line, '^ {{0,3}}([-*+]|[0-9]{{1,9}}[.)])(\\s|$)', 1) as item, regexp_matches(line, '^ {{0,3}}>') as quote,
  contains(line, '|') and contains(coalesce(after, ''), '|') and regexp_matches(coalesce(after, ''), '^ {{0,3}}\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$') as tabled,
  regexp_matches(line, '^ {{0,3}}<([!?]|/?[A-Za-z])') as html from lines),
features as (select doc_id, i, deep, inner_, f, level, under, right(item, 1) as mark, case when blank then 'blank' when f <> '' and not (f[1] = '`' and contains(info, '`')) then 'fence' else '' end as pre,
  bare, head, rule, item <> '' as listed, quote, tabled, html from marks)
"""
    # one step of the scanner: what the line is, given the block that the line before belongs to (o), the list or code that may go on
    # behind empty lines (g), its mark, and the open fence (fence)
    step = """case when fence <> '' then 'fenced' when pre = 'blank' then 'blank' when pre = 'fence' then 'fence' when o = 'html_block' then 'same' when coalesce(nullif(o, ''), g) = 'list' and inner_ then 'going'
  when head then 'heading' when o = 'paragraph' and under <> '' then 'under' when rule then 'rule' when listed then case when coalesce(nullif(o, ''), g) = 'list' and m = mark then 'going' else 'list' end
  when quote then case when o = 'blockquote' then 'same' else 'blockquote' end
  when deep then case when o in ('paragraph', 'list', 'blockquote', 'table') then 'same' when coalesce(nullif(o, ''), g) = 'code_block' then 'going' else 'code_block' end
  when tabled and o not in ('list', 'blockquote', 'table') then 'table' when html and o not in ('paragraph', 'table') then 'html_block'
  when o in ('paragraph', 'list', 'blockquote', 'table', 'html_block') then 'same' else 'paragraph' end"""
    scan = f"""
state as (
  select doc_id, 0::bigint as i, '' as step, '' as kind, '' as o, '' as g, '' as m, '' as fence, 0::bigint as block_no, 0 as level from texts
  union all
  select doc_id, i, step,
    case when step in ('blank', 'rule') then '' when step = 'under' then 'heading' when step = 'fence' or step = 'fenced' then 'code_fence' when step = 'same' then o when step = 'going' then coalesce(nullif(o, ''), g) else step end as kind,
    case when step in ('blank', 'rule', 'under', 'heading', 'fence', 'fenced') then '' when step = 'same' then o when step = 'going' then coalesce(nullif(o, ''), g) else step end,
    case when step = 'blank' then g when step = 'same' then case when o in ('list', 'code_block') then o else '' end when step = 'going' then coalesce(nullif(o, ''), g) when step in ('list', 'code_block') then step else '' end,
    case when step = 'list' then mark else m end,
    case when step = 'fence' then f when step = 'fenced' and bare <> '' and bare[1] = fence[1] and length(bare) >= length(fence) then '' else fence end,
    case when step in ('fence', 'heading', 'list', 'blockquote', 'code_block', 'table', 'html_block', 'paragraph') then block_no + 1 else block_no end,
    case when step = 'heading' then level when step = 'under' then case when under[1] = '=' then 1 else 2 end else 0 end
  from (select f.*, s.o, s.g, s.m, s.fence, s.block_no, {step} as step from state s join features f on f.doc_id = s.doc_id and f.i = s.i + 1)
)"""
    blocks = f"""{features}, {scan},
spans as (select doc_id, block_no, case when max(level) > 0 then 'heading' else min_by(kind, i) end as kind, max(level) as level, min(i) as first_line, max(i) as last_line,
  bool_or(step = 'under') as underlined from state where kind <> '' group by doc_id, block_no),
placed as (select s.*, sum((kind = 'heading')::int) over (partition by s.doc_id order by block_no) as section_no,
  regexp_replace(regexp_replace(array_to_string(l[first_line:last_line], chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as text from spans s join texts t on s.doc_id = t.doc_id)"""
    sections = f"""{blocks},
sections as (select doc_id, section_no, count(*) as n_blocks, string_agg(text, chr(10) || chr(10) order by block_no) as text from placed group by doc_id, section_no),
numbered as (select *, row_number() over (partition by doc_id order by section_no) as n, {_TOKENS.format('text')} as tokens from sections)"""
    part = "regexp_replace(regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
    at = "case when strpos(reverse(w), reverse({0})) > 0 and length(w) - strpos(reverse(w), reverse({0})) - length({0}) + 1 >= greatest(1, length(w) // 2) then length(w) - strpos(reverse(w), reverse({0})) - length({0}) + 1 + {1} end"
    cuts = ", ".join(at.format("chr(10) || " * (m.count("\n")) + f"'{m.strip(chr(10))}'" if m.strip("\n") else " || ".join(["chr(10)"] * m.count("\n")), k) for m, k in md.CUTS)
    chunks = f"""{sections},
large as (select p.doc_id, n.n, p.block_no, p.text from placed p join numbered n on p.doc_id = n.doc_id and p.section_no = n.section_no where n.tokens > {soft}),
forced as (
  select doc_id, n, block_no, 0 as k, null::varchar as part, text as rest from large
  union all
  select doc_id, n, block_no, k + 1, case when cut is null then rest else {part.format('substr(rest, 1, cut)')} end, case when cut is null then '' else regexp_replace(substr(rest, cut + 1), '^\\s+', '') end
  from (select *, case when {_TOKENS.format('rest')} <= {hard} then null when length(rest) > {4 * hard} then coalesce({cuts}, {4 * hard}) else length(rest) end as cut from (select *, substr(rest, 1, {4 * hard}) as w from forced where rest <> ''))),
units as (select doc_id, n, row_number() over (partition by doc_id, n order by block_no, k) as u, part from forced where part <> ''),
runs as (
  select doc_id, n, u, 1 as part_no, part as text from units where u = 1
  union all
  select doc_id, n, u, case when fits then part_no else part_no + 1 end, case when fits then text || chr(10) || chr(10) || part else part end
  from (select r.doc_id, r.n, r.part_no, r.text, x.u, x.part, {_TOKENS.format("(r.text || chr(10) || chr(10) || x.part)")} <= {hard} as fits from runs r join units x on x.doc_id = r.doc_id and x.n = r.n and x.u = r.u + 1)),
parts as (select doc_id, n, part_no, arg_max(text, u) as text from runs group by doc_id, n, part_no
  union all select doc_id, n, 1, text from numbered where tokens <= {soft})"""
    return blocks, sections, chunks


_BLOCKS, _SECTIONS, _CHUNKS = markdown_sql("select doc_id, text from documents")


@query(f"with recursive {_BLOCKS} select doc_id, cast(block_no as bigint) as block_no, kind, nullif(level, 0) as level, first_line, last_line, cast(section_no as bigint) as section_no, sha1(text) as digest from placed")
def md_blocks(spark: SparkSession, d: str) -> DataFrame:
    return md.blocks(table(spark, d, "documents")).select("doc_id", "block_no", "kind", "level", "first_line", "last_line", "section_no", F.sha1("text").alias("digest"))


@query(f"""with recursive {_SECTIONS} select doc_id, cast(section_no as bigint) as section_no, n_blocks, sha1(text) as digest,
  case when section_no = 0 and n = max(n) over (partition by doc_id) then 'preamble' else 'heading_section' end as kind from numbered""")
def section_group(spark: SparkSession, d: str) -> DataFrame:
    return md.sections(table(spark, d, "documents")).select("doc_id", "section_no", "n_blocks", F.sha1("text").alias("digest"), "kind")


@query(f"""with recursive {_CHUNKS} select doc_id, 'chunk#' || lpad(cast(row_number() over (partition by doc_id order by n, part_no) as varchar), 6, '0') as chunk_id, cast(n as bigint) as section_no,
  cast(part_no as bigint) as part, count(*) over (partition by doc_id, n) as parts, {_TOKENS.format('text')} as token_estimate, sha1(text) as digest from parts""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = md.chunks(table(spark, d, "documents"))
    return rows.select("doc_id", "chunk_id", F.col("section_no").cast("long").alias("section_no"), F.col("part").cast("long").alias("part"), F.col("parts").cast("long").alias("parts"), "token_estimate", F.sha1("text").alias("digest"))


@query(f"""select version_pk, chunk_id || case when tokens > 1400 then '#part' || lpad(cast(i as varchar), 2, '0') else '' end as chunk_id, case when tokens > 1400 then chunk_id end as split_from,
  cast(case when tokens > 1400 then i end as bigint) as split_index, sha1(part) as digest from (
  select version_pk, chunk_id, tokens, row_number() over (partition by version_pk, chunk_id order by k) as i, part from (
    select version_pk, chunk_id, tokens, k, case when tokens > 1400 then regexp_replace(substr(text, (k - 1) * 2800 + 1, 2800), '^\\s+|\\s+$', '', 'g') else text end as part
    from (select *, unnest(range(1, case when tokens > 1400 then cast(ceil(length(text) / 2800.0) as bigint) + 1 else 2 end)) as k
      from (select version_pk, chunk_id, text, {_TOKENS.format('text')} as tokens from (select distinct version_pk, chunk_id, text from chunks))))
  where tokens <= 1400 or part <> '')""")
def oversize_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("version_pk", "chunk_id", "text").dropDuplicates()
    return md.expand_oversized(rows).select("version_pk", "chunk_id", "split_from", F.col("split_index").cast("long").alias("split_index"), F.sha1("text").alias("digest"))


_PAGES = """pages as (select version_pk, page, text, row_number() over (partition by version_pk order by page, chunk_id) as rn from (
  select distinct version_pk, chunk_id, coalesce(page_no, page_span.first, ordinal) as page, text from chunks
  where chunk_type = 'page_text_chunk' and regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> ''))"""


@query(f"""with {_PAGES}, near as (select version_pk, page as first, lead(page) over w as last, text as a, lead(text) over w as b from pages window w as (partition by version_pk order by rn)),
t as (select *, a || chr(10) || chr(10) || b as c from near where b is not null)
select version_pk, first, last, sha1(c) as digest from t where ({_TOKENS.format('a')} < 120 or {_TOKENS.format('b')} < 120) and {_TOKENS.format('c')} <= 1400""")
def page_short_windows(spark: SparkSession, d: str) -> DataFrame:
    return pg.short_windows(pg.text_pages(table(spark, d, "chunks"))).select("version_pk", "first", "last", F.sha1("text").alias("digest"))


@query(f"""with {_PAGES}, parts as (select version_pk, cast(floor((rn - 1) / 6) as bigint) as part, min_by(page, rn) as first, max_by(page, rn) as last, count(*) as pages,
  string_agg(text, chr(10) || chr(10) order by rn) as c from pages group by all)
select version_pk, part, first, last, pages, sha1(c) as digest from parts where pages >= 2 and {_TOKENS.format('c')} <= 1400""")
def page_part_windows(spark: SparkSession, d: str) -> DataFrame:
    return pg.part_windows(pg.text_pages(table(spark, d, "chunks"))).select("version_pk", "part", "first", "last", "pages", F.sha1("text").alias("digest"))


@query("""
with c as (select distinct version_pk, chunk_id, ordinal, length(text) as size from chunks where regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> ''),
n as (select *, row_number() over w as n, sum(size) over (w rows between unbounded preceding and current row) as upto from c window w as (partition by version_pk order by ordinal, chunk_id))
select version_pk, chunk_id, n from n where n <= 3 and (n = 1 or upto <= 2400)
""")
def excerpt_select(spark: SparkSession, d: str) -> DataFrame:
    return pg.excerpt(table(spark, d, "chunks"))


@query(f"""with {_PAGES} select version_pk, count(*) as pages, sha1(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by rn)) as digest from pages group by version_pk""")
def ocr_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as lines of recognition results, every other one in the older form, and read back as documents."""
    pages = pg.text_pages(table(spark, d, "chunks"))
    own = F.struct(F.col("text").alias("text"))
    layout = F.to_json(F.struct(F.struct(F.array(F.struct(own.alias("markdown"))).alias("layoutParsingResults")).alias("result")))
    plain = F.to_json(F.struct(F.struct(own.alias("markdown")).alias("data")))
    lines = pages.select("version_pk", F.col("rn").alias("line_no"), F.when(F.col("rn") % 2 == 0, layout).otherwise(plain).alias("payload"))
    whole = ocr.document_markdown(ocr.line_markdown(lines))
    return whole.select("version_pk", "pages", F.sha1("markdown").alias("digest"))


# ------------------------------------------------------------ retrieval

def _vectors(spark: SparkSession, d: str, dims: int) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", "label", (F.col("label") < 5).alias("is_latest"), F.slice("embedding", 1, dims).alias("vector"))


def _asked(spark: SparkSession, d: str, dims: int) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.slice("embedding", 1, dims).alias("q"))


def _nearest_sql(dims: int, extra: str = "") -> str:
    dot = "list_dot_product({0}, {1})"
    a, b = f"q.embedding[1:{dims}]::double[]", f"v.embedding[1:{dims}]::double[]"
    dist = f"round(1 - {dot.format(a, b)} / (sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)})), 4) + 0.0"
    return f"""select * from (select *, row_number() over (partition by qid order by distance, vec_id) as rank from (
      select q.vec_id as qid, v.vec_id, v.label, v.label < 5 as is_latest, {dist} as distance from embeddings q, embeddings v where q.vec_id % 100 = 0 {extra})) where rank <= 10"""


@query(f"select qid, vec_id, distance, rank from ({_nearest_sql(64)})")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vec.vector_topk(_asked(spark, d, 64), _vectors(spark, d, 64), K).select("qid", "vec_id", "distance", "rank")


@query(f"select qid, vec_id, distance, rank from ({_nearest_sql(64, 'and v.label in (1, 2, 3)')})")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = vec.vector_topk(_asked(spark, d, 64), _vectors(spark, d, 64), K, where=F.col("label").isin(1, 2, 3))
    return found.select("qid", "vec_id", "distance", "rank")


_FUSED = f"""
lists as (select qid, 0 as profile_idx, rank, vec_id, distance, label, is_latest from ({_nearest_sql(64)})
          union all select qid, 1, rank, vec_id, distance, label, is_latest from ({_nearest_sql(32)})),
fused as (select qid, vec_id, round(sum(1.0 / (60 + rank)), 9) as score, count(*) as hits, min(distance) as distance, min((profile_idx, rank)) as f,
    any_value(label) as label, any_value(is_latest) as is_latest from lists group by qid, vec_id),
top as (select * from (select *, row_number() over (partition by qid order by score desc, f, vec_id) as place from fused) where place <= 10)
"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    lists = None
    for i, dims in enumerate((64, 32)):
        one = vec.vector_topk(_asked(spark, d, dims), _vectors(spark, d, dims), K).select("qid", F.lit(i).alias("profile_idx"), "rank", "vec_id", "distance")
        lists = one if lists is None else lists.unionByName(one)
    return vec.fused_topk(vec.fuse_ranks(lists), K)


@query(f"with {_FUSED} select qid, vec_id, score, hits, distance, place from top")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("qid", "vec_id", "score", "hits", "distance", "place")


@query(f"""with {_FUSED} select qid, vec_id, score, row_number() over (partition by qid order by place) as final_rank from top
where case when label = 4 then is_latest when label = 6 then is_latest else label <> 3 and label <> 7 end""")
def search_fused(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: two searches, fused, then governed by a state in which two labels are unknown, one not ready, one deleted."""
    rows = table(spark, d, "embeddings")
    state = rows.where(~F.col("label").isin(4, 6)).select("vec_id", (F.col("label") == 7).alias("is_deleted"), (F.col("label") != 3).alias("is_ready"))
    hits = _fused(spark, d).join(rows.select("vec_id", (F.col("label") < 5).alias("is_latest")), "vec_id")
    return vec.govern(hits, state).select("qid", "vec_id", "score", "final_rank")


@query("""
with c as (select version_pk, chunk_id, ordinal, row_number() over (partition by version_pk order by ordinal, chunk_id) as place from (select distinct version_pk, chunk_id, ordinal from chunks))
select a.version_pk, a.ordinal, cast(b.place - a.place as integer) as "offset", b.ordinal as neighbour_ordinal, b.chunk_id as neighbour_id
from c a join c b on a.version_pk = b.version_pk and abs(a.place - b.place) = 1
""")
def neighbor_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("version_pk", "chunk_id", "ordinal").dropDuplicates(["version_pk", "chunk_id"])
    return vec.neighbours(rows, rows, NEIGHBOURS)
