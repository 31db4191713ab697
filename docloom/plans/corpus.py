"""Queries of names, contracts, extraction, search and sinks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import identity as ident
from docloom.functions import names as nm
from docloom.functions import plugins as pl
from docloom.io import materialize, new_path, table
from docloom.operators import contracts as ct
from docloom.operators import events as ev
from docloom.operators import extract as ex
from docloom.operators import manifests as mf
from docloom.operators import pages as pg
from docloom.operators import search as se
from docloom.operators import sinks as sk
from docloom.operators import vectors as vec
from docloom.plans.pipeline import _KEY, _OBJ, _ONE, _PAGES, _PREFERRED, _STATE, _TOKENS, K, PROFILES, _envelopes, _state, markdown_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------ names

_FOLDER = r"""case when safe = '' then 'document' else safe end || lower(suffix) || '--' || substr(sha1(object_pk), 1, 12)"""


@query(rf"""with n as (select distinct object_key, {_OBJ} as object_pk, trim(regexp_extract(regexp_replace(object_key, '/+$', ''), '([^/]*)$', 1)) as last from extract_jobs),
s as (select *, regexp_extract(last, '^.+(\.[^.]+)$', 1) as suffix, case when suffix = '' then last else regexp_extract(last, '^(.+)\.[^.]+$', 1) end as stem from n),
f as (select *, regexp_replace(regexp_replace(replace(trim(regexp_replace(stem, '[^\p{{L}}\p{{N}}._\- ]', '-', 'g')), ' ', '-'), '[-_.]{{2,}}', '-', 'g'), '^[.\-_]+|[.\-_]+$', '', 'g') as safe from s)
select object_pk, 'out/' || {_FOLDER} || '/manifest.json' as path from f""")
def manifest_paths(spark: SparkSession, d: str) -> DataFrame:
    pk = ident.object_pk(F.col("tenant_id"), F.col("bucket"), F.col("object_key"))
    return table(spark, d, "extract_jobs").select("object_key", pk.alias("object_pk")).distinct().select("object_pk", nm.manifest_path(F.col("object_key"), F.col("object_pk"), prefix="/out/").alias("path"))


@query(r"""with u as (select version_pk, 's3://' || url_decode(split_part(version_pk, '#', 2)) || '/' || replace(split_part(version_pk, '#', 3), '%2F', '/') || '?versionId=' || split_part(version_pk, '#', 4) as uri from manifests
  union all select 'https://x/' || version_pk, 'https://x/' || version_pk from manifests), v as (select *, regexp_matches(uri, '^s3://[^/?#]+/') as ok from u)
select version_pk, case when ok then regexp_extract(uri, '^s3://([^/?#]+)', 1) end as bucket, case when ok then regexp_extract(uri, '^s3://[^/?#]+/([^?#]*)', 1) end as key, case when ok then url_decode(regexp_extract(uri, 'versionId=(.*)$', 1)) end as version_id from v""")
def uri_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifests").select("version_pk", ident.uri_of_version_pk(F.col("version_pk")).alias("uri"))
    both = rows.unionByName(rows.select(F.concat(F.lit("https://x/"), "version_pk").alias("version_pk"), F.concat(F.lit("https://x/"), "version_pk").alias("uri")))
    p = nm.uri_parts(F.col("uri"))
    return both.select("version_pk", p["bucket"].alias("bucket"), p["key"].alias("key"), p["version_id"].alias("version_id"))


@query(r"""with p as (select delivery_id, case delivery_id % 5 when 0 then ' /' || object_key when 1 then '../' || object_key when 2 then 'a//' || object_key when 3 then object_key || '/.' else object_key end as path from extract_jobs),
s as (select *, ltrim(regexp_replace(path, '^\s+|\s+$', '', 'g'), '/') as v from p)
select delivery_id, case when v <> '' and len(list_filter(string_split(v, '/'), lambda x: x in ('', '.', '..'))) = 0 then v end as clean from s""")
def clean_paths(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("object_key"), F.col("delivery_id") % 5
    path = F.when(n == 0, F.concat(F.lit(" /"), k)).when(n == 1, F.concat(F.lit("../"), k)).when(n == 2, F.concat(F.lit("a//"), k)).when(n == 3, F.concat(k, F.lit("/."))).otherwise(k)
    return table(spark, d, "extract_jobs").select("delivery_id", nm.clean_path(path).alias("clean"))


_RUN = "'ingest-' || substr(sha1(tenant_id), 1, 8) || '-b' || substr(sha1(bucket), 1, 8) || '-k' || substr(sha1(object_key), 1, 16) || '-v' || substr(sha1(version_id), 1, 12) || '-s' || substr(sha1(coalesce(nullif(sequencer, ''), 'noseq')), 1, 12)"


@query(f"""select delivery_id, {_RUN} as run, {_RUN} || '-cleanup-p' || substr(sha1('main'), 1, 8) || '-i' || substr(sha1('index'), 1, 8) as cleanup,
  'cleanup-' || substr(sha256('{{"key": "' || replace(replace(object_key, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '", "version": "' || version_id || '"}}'), 1, 48) as payload from extract_jobs
  where tenant_id is not null and bucket is not null and object_key is not null and version_id is not null""")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    run = nm.execution_name(*(F.col(c) for c in ("tenant_id", "bucket", "object_key", "version_id", "sequencer")))
    rows = table(spark, d, "extract_jobs").where("tenant_id is not null and bucket is not null and object_key is not null and version_id is not null")
    payload = nm.payload_name(F.create_map(F.lit("version"), F.col("version_id"), F.lit("key"), F.col("object_key")))
    return rows.select("delivery_id", run.alias("run"), nm.cleanup_name(run, F.lit("main"), F.lit(None).cast("string")).alias("cleanup"), payload.alias("payload"))


@query(r"""select delivery_id, coalesce(nullif(regexp_replace(regexp_replace(object_key, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.\-_]+|[.\-_]+$', '', 'g'), ''), 'asset') as name,
  case lower(trim(content_type)) when 'application/pdf' then '.pdf' when 'text/plain' then '.txt' when 'text/html' then '.html' when 'image/png' then '.png' else case when starts_with(lower(trim(content_type)), 'text/markdown') then '.md' else '.bin' end end as ending
from extract_jobs where object_key is not null""")
def asset_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extract_jobs").where("object_key is not null").select("delivery_id", nm.safe_filename(F.col("object_key")).alias("name"), nm.ending(F.col("content_type")).alias("ending"))


@query("""select delivery_id, case when requested_at is null and received_at is null then nullif(trim(source), '') when received_at is null or requested_at >= received_at then strftime(requested_at, '%Y-%m-%dT%H:%M:%S.%fZ')
  else strftime(received_at, '%Y-%m-%dT%H:%M:%S.%fZ') end as latest, lower(trim(coalesce(source, ''))) in ('1', 'true', 'yes', 'y') or delivery_id % 3 = 0 as flagged from extract_jobs""")
def latest_times(spark: SparkSession, d: str) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    word = F.when(F.col("delivery_id") % 3 == 0, F.lit(" Yes ")).otherwise(F.col("source"))
    return table(spark, d, "extract_jobs").select("delivery_id", nm.latest_time(F.col("source"), iso("requested_at"), iso("received_at")).alias("latest"), nm.truthy(word).alias("flagged"))


# ------------------------------------------------------------ plug-ins

@query("select vec_id, len(embedding) as dimension, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 6) as squares from embeddings")
def vectors_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as base64 of their bytes, as embedding services answer, and read back."""
    import base64

    import pandas as pd

    encode = F.pandas_udf(lambda s: pd.Series([base64.b64encode(x.astype("<f4").tobytes()).decode() for x in s], index=s.index), "string")
    rows = table(spark, d, "embeddings").select("vec_id", pl.decoded_vector(encode("embedding")).alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("dimension"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6).alias("squares"))


@query()
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the evaluation items, embedded by the plug-in without a model, against all documents in their language."""
    embed = pl.hashing_embedder(64)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", pl.embedded(F.col("text"), embed).alias("vector"))
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "lang", pl.embedded(F.col("question"), embed).alias("q"))
    return vec.vector_topk(asked, docs, 3, same=["lang"])


# ------------------------------------------------------------ contracts

_REQUIRED = """values ('md|markdown', ['section_count']), ('docx|python-docx', ['section_count']), ('pptx|python-pptx', ['slide_count', 'image_asset_count']), ('pdf|pdf', ['page_count', 'page_image_asset_count', 'visual_page_numbers']),
  ('pdf|paddleocr_async', ['page_count', 'page_image_asset_count', 'raw_json_asset_count', 'layout_markdown_asset_count', 'document_markdown_asset_count', 'markdown_asset_count', 'ocr_engine'])"""
_MANIFESTS = "(select version_pk, doc_type, source_format, case when length(version_pk) % 7 = 0 then map {'source_format': 'tiff'} when length(version_pk) % 7 = 1 then map {'page_count': '3'} else metadata end as metadata from manifests)"


def _broken_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests, of which some are made to name an unknown format or none."""
    n = F.length("version_pk") % 7
    broken = F.when(n == 0, F.create_map(F.lit("source_format"), F.lit("tiff"))).when(n == 1, F.create_map(F.lit("page_count"), F.lit("3"))).otherwise(F.col("metadata"))
    return table(spark, d, "manifests").withColumn("metadata", broken)


@query(f"""with spec(k, names) as ({_REQUIRED}), m as (select *, nullif(trim(metadata['source_format']), '') as declared from {_MANIFESTS}), j as (select m.*, names from m left join spec on k = doc_type || '|' || declared)
select distinct version_pk, violation from (
  select version_pk, 'missing source_format' as violation from j where declared is null union all select version_pk, 'source_format differs' from j where declared <> source_format
  union all select version_pk, 'unsupported format' from j where declared is not null and names is null
  union all select version_pk, 'missing ' || n from (select version_pk, metadata, unnest(names) as n from j) where coalesce(metadata[n], '') = '')""")
def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    return ct.manifest_violations(_broken_manifests(spark, d))


@query("""with one as (select version_pk, max((source_format, doc_type)) as m from manifests where version_pk is not null group by version_pk),
spec(k, names) as (values ('md|markdown', ['source_format']), ('docx|python-docx', ['source_format', 'converter']), ('pptx|python-pptx', ['source_format', 'image_count', 'has_notes']), ('pdf|pdf', ['source_format']), ('pdf|paddleocr_async', ['source_format', 'layout_index'])),
c as (select distinct c.version_pk, chunk_id, case when ordinal % 5 = 0 then map {'source_format': 'pdf'} else metadata end as metadata, case when ordinal % 3 = 0 then 5 else page_span.first end as a, case when ordinal % 3 = 0 then 2 else page_span.last end as b,
    page_span is not null or ordinal % 3 = 0 as has, m[1] as f, names from chunks c left join one on c.version_pk = one.version_pk left join spec on k = m[2] || '|' || m[1])
select distinct version_pk, chunk_id, violation from (
  select version_pk, chunk_id, 'no manifest' as violation from c where f is null union all select version_pk, chunk_id, 'no metadata' from c where metadata is null
  union all select version_pk, chunk_id, 'source_format differs' from c where metadata['source_format'] <> f union all select version_pk, chunk_id, 'page_span incomplete' from c where has and (a is null or b is null)
  union all select version_pk, chunk_id, 'page_span reversed' from c where a > b
  union all select version_pk, chunk_id, 'missing ' || n from (select version_pk, chunk_id, metadata, unnest(names) as n from c where metadata is not null) where coalesce(metadata[n], '') = '')""")
def chunk_violations(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, of which some are given another format or a span that runs backwards."""
    span = F.when(F.col("ordinal") % 3 == 0, F.struct(F.lit(5).alias("first"), F.lit(2).alias("last"))).otherwise(F.col("page_span"))
    meta = F.when(F.col("ordinal") % 5 == 0, F.create_map(F.lit("source_format"), F.lit("pdf"))).otherwise(F.col("metadata"))
    return ct.chunk_violations(table(spark, d, "chunks").withColumns({"metadata": meta, "page_span": span}), table(spark, d, "manifests"))


def _page_assets(spark: SparkSession, d: str) -> DataFrame:
    """A picture of each page, as a renderer would leave it; without an address where the page number is unknown."""
    pages = table(spark, d, "chunks").where("chunk_type = 'page_text_chunk'").dropDuplicates(["version_pk", "chunk_id"])
    uri = F.concat(F.lit("s3://assets/"), F.sha1("version_pk"), F.lit("/"), F.col("page_no").cast("string"), F.lit(".png"))
    return pages.select("version_pk", F.concat(F.lit("asset#"), "chunk_id").alias("asset_id"), F.lit("page_image_chunk").alias("chunk_type"), F.lit("image/png").alias("mime_type"), uri.alias("asset_uri"), "page_no", "slide_no", F.col("metadata"), F.lit(False).alias("has_payload"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "extract_jobs").where("version_pk is not null")
    return jobs.groupBy("version_pk").agg(F.max(F.nullif(F.trim("language"), F.lit(""))).alias("label"))


_REQUESTS = f"""one as (select version_pk, max((source_format, doc_type)) as m from manifests where version_pk is not null group by version_pk),
lab as (select version_pk, max(nullif(trim(language), '')) as label from extract_jobs where version_pk is not null group by version_pk),
both_ as (select version_pk, chunk_id, chunk_type, 'text' as kind, text, null as asset_uri, null as mime_type, page_no, slide_no, token_estimate, section_path, page_span, metadata from {_ONE} where version_pk is not null and chunk_id is not null
  union all select version_pk, 'asset#' || chunk_id, 'page_image_chunk', 'image', null, 's3://assets/' || sha1(version_pk) || '/' || page_no || '.png', 'image/png', page_no, slide_no, null, null, null, metadata from {_ONE} where chunk_type = 'page_text_chunk'),
built as (select b.*, map_from_entries(list_filter([('tenant_id', url_decode(split_part(b.version_pk, '#', 1))), ('bucket', url_decode(split_part(b.version_pk, '#', 2))), ('key', url_decode(split_part(b.version_pk, '#', 3))), ('version_id', url_decode(split_part(b.version_pk, '#', 4))),
    ('document_uri', 's3://' || url_decode(split_part(b.version_pk, '#', 2)) || '/' || replace(split_part(b.version_pk, '#', 3), '%2F', '/') || '?versionId=' || split_part(b.version_pk, '#', 4)), ('language', coalesce(label, 'zh')), ('source_format', m[1])], lambda e: e[2] is not null)) as base,
  map_from_entries(list_filter([('doc_type', m[2]), ('page_no', page_no::varchar), ('page_span', case when page_span is not null then '[' || coalesce(page_span.first::varchar, 'null') || ',' || coalesce(page_span.last::varchar, 'null') || ']' end), ('slide_no', slide_no::varchar),
    ('token_estimate', token_estimate::varchar), ('mime_type', mime_type), ('section_path', case when len(section_path) > 0 then to_json(section_path)::varchar end), ('is_latest', 'true'), ('manifest_s3_uri', 's3://manifests/' || sha1(b.version_pk) || '/manifest.json')], lambda e: e[2] is not null)) as place
  from both_ b left join one on b.version_pk = one.version_pk left join lab on b.version_pk = lab.version_pk),
requests as (select *, map_concat(map_concat(base, coalesce(metadata, map())), place) as meta from built)"""


@query(f"with {_REQUESTS} select version_pk, chunk_id, kind, name, value from (select version_pk, chunk_id, kind, unnest(map_keys(meta)) as name, unnest(map_values(meta)) as value from requests) where trim(coalesce(value, '')) <> ''")
def embedding_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = mf.embedding_requests(table(spark, d, "chunks"), table(spark, d, "manifests"), _labels(spark, d), _page_assets(spark, d))
    return rows.select("version_pk", "chunk_id", "kind", F.explode("metadata").alias("name", "value"))


@query(f"""with {_REQUESTS}, r as (select version_pk, chunk_id, kind, text, asset_uri, meta from requests union all select version_pk, chunk_id, kind, text, asset_uri, meta from requests where length(version_pk) % 11 = 0)
select distinct version_pk, chunk_id, violation from (
  select version_pk, chunk_id, 'text without text' as violation from r where kind = 'text' and trim(coalesce(text, '')) = '' union all select version_pk, chunk_id, 'image without uri' from r where kind = 'image' and trim(coalesce(asset_uri, '')) = ''
  union all select version_pk, chunk_id, 'missing ' || n from (select *, unnest(['tenant_id', 'bucket', 'key', 'version_id', 'document_uri', 'language', 'doc_type', 'source_format', 'manifest_s3_uri', 'is_latest']) as n from r) where trim(coalesce(meta[n], '')) = ''
  union all select version_pk, chunk_id, 'duplicate chunk_id' from r group by version_pk, chunk_id having count(*) > 1)""")
def request_violations(spark: SparkSession, d: str) -> DataFrame:
    """Requests, of which those of some versions come twice; pictures of pages without a number have no address."""
    rows = mf.embedding_requests(table(spark, d, "chunks"), table(spark, d, "manifests"), _labels(spark, d), _page_assets(spark, d))
    return ct.request_violations(rows.unionByName(rows.where(F.length("version_pk") % 11 == 0)))


@query("""with n as (select version_pk, count(*) as requests from (select distinct version_pk, chunk_id from chunks) group by version_pk),
j as (select delivery_id as job_id, case when delivery_id % 4 = 0 then ' ' else 'main' end as profile_id, trace_id, case when delivery_id % 7 > 0 then 's3://m/' || delivery_id end as manifest_uri, requests from extract_jobs e left join n on e.version_pk = n.version_pk)
select job_id, 'missing profile_id' as violation from j where trim(profile_id) = '' union all select job_id, 'missing trace_id' from j where trim(coalesce(trace_id, '')) = ''
union all select job_id, 'missing manifest_uri' from j where manifest_uri is null union all select job_id, 'no requests' from j where coalesce(requests, 0) = 0""")
def job_violations(spark: SparkSession, d: str) -> DataFrame:
    return sk.dispatch_jobs(_jobs(spark, d))[1]


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "chunks").select("version_pk", "chunk_id").distinct().groupBy("version_pk").agg(F.count("*").alias("requests"))
    i = F.col("delivery_id")
    uri = F.when(i % 7 > 0, F.concat(F.lit("s3://m/"), i.cast("string")))
    rows = table(spark, d, "extract_jobs").join(n, "version_pk", "left")
    return rows.select(i.alias("job_id"), F.when(i % 4 == 0, " ").otherwise("main").alias("profile_id"), "trace_id", uri.alias("manifest_uri"), "requests")


@query("""with v as (select distinct version_pk from chunks), j as (select e.delivery_id from extract_jobs e join v on e.version_pk = v.version_pk where delivery_id % 4 > 0 and delivery_id % 7 > 0 and trim(coalesce(trace_id, '')) <> '')
select cast(b as bigint) as batch_no, count(*) as jobs from (select floor((row_number() over (order by delivery_id) - 1) / 10) as b from j) group by b""")
def job_batches(spark: SparkSession, d: str) -> DataFrame:
    return sk.dispatch_jobs(_jobs(spark, d))[0].groupBy("batch_no").agg(F.count("*").alias("jobs"))


@query("""select delivery_id as envelope_id, case when delivery_id % 9 = 0 then 'event version' else 'no version' end as error from extract_jobs where delivery_id % 9 = 0 or delivery_id % 9 = 1""")
def refused_events(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes, of which some are of an old event version and some without a version of the object."""
    n, body = F.col("envelope_id") % 9, F.col("payload")
    q = lambda text: F.lit(text)
    old = F.replace(F.replace(body, q('"eventVersion":"2.1"'), q('"eventVersion":"2.0"')), q('\\"eventVersion\\":\\"2.1\\"'), q('\\"eventVersion\\":\\"2.0\\"'))
    none = F.replace(body, F.lit("versionId"), F.lit("versionNo"))
    made = _envelopes(spark, d).withColumn("payload", F.when(n == 0, old).when(n == 1, none).otherwise(body))
    return ev.refused_records(ev.envelope_records(made))


# ------------------------------------------------------------ extraction

@query(f"""with e as (select delivery_id, case when contains(object_key, '.') then lower(regexp_extract(object_key, '[^.]*$')) else '' end as x0, case when delivery_id % 6 = 0 then 'ppt' when delivery_id % 6 = 1 then 'exe' else x0 end as x from extract_jobs where object_key is not null)
select delivery_id, case when x in ('md', 'docx', 'pptx') then 'sync' when x = 'pdf' then 'ocr' end as route, case when x in ('doc', 'ppt') then 'convert first: ' || x when x not in ('md', 'docx', 'pptx', 'pdf') then 'unsupported: ' || x end as error from e""")
def route_formats(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("delivery_id") % 6
    x = F.when(n == 0, "ppt").when(n == 1, "exe").otherwise(ident.extension(F.col("object_key")))
    return table(spark, d, "extract_jobs").where("object_key is not null").select("delivery_id", ct.route(x).alias("r")).select("delivery_id", "r.route", "r.error")


_SLIDES = f"""(select version_pk || '|' || slide_no as doc_id, string_agg(text, chr(10) order by ordinal, chunk_id) || case when slide_no % 2 = 0 then chr(10) || 'Notes of ' || slide_no else '' end as text
  from {_ONE} where chunk_type = 'slide_text_chunk' and slide_no is not null and text is not null group by version_pk, slide_no)"""


@query(f"""with recursive {markdown_sql("select * from " + _SLIDES, 1400, 1400)[2]}, c as (select doc_id, row_number() over (partition by doc_id order by n, part_no) as k, count(*) over (partition by doc_id) as many, text from parts)
select regexp_extract(doc_id, '^(.*)\\|[0-9]+$', 1) as version_pk, 'chunk#' || lpad(regexp_extract(doc_id, '([0-9]+)$', 1), 6, '0') || case when many > 1 then '-' || lpad(k::varchar, 2, '0') else '' end as chunk_id,
  sha1(text) as digest, {_TOKENS.format('text')} as token_estimate, regexp_extract(doc_id, '([0-9]+)$', 1)::int % 2 = 0 as has_notes from c""")
def slide_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("chunk_type = 'slide_text_chunk' and text is not null").dropDuplicates(["version_pk", "chunk_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text"))), lambda x: x["text"]), "\n")
    slides = rows.groupBy("version_pk", "slide_no").agg(text.alias("text")).withColumn("notes", F.when(F.col("slide_no") % 2 == 0, F.concat(F.lit("Notes of "), F.col("slide_no").cast("string")))).withColumn("images", F.lit(0))
    made = ex.slide_chunks(slides)
    return made.select("version_pk", "chunk_id", F.sha1("text").alias("digest"), "token_estimate", (F.col("metadata")["has_notes"] == "true").alias("has_notes"))


_NEAT = "regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""with {_PAGES}, p as (select version_pk, page, rn, {_NEAT.replace('text', "replace(text, chr(13), '')", 1)} as text from pages),
short as (select version_pk, rn, page as first, lead(page) over w as last, text as a, lead(text) over w as b from p window w as (partition by version_pk order by rn)),
parts as (select version_pk, floor((rn - 1) / 6) as part, min_by(page, rn) as first, max_by(page, rn) as last, count(*) as n, string_agg(text, chr(10) || chr(10) order by rn) as c from p group by all),
every as (select version_pk, 0 as kind, rn as pos, page as first, page as last, text from p
  union all select version_pk, 1, rn, first, last, a || chr(10) || chr(10) || b from short where b is not null and ({_TOKENS.format('a')} < 120 or {_TOKENS.format('b')} < 120) and {_TOKENS.format("(a || chr(10) || chr(10) || b)")} <= 1400
  union all select version_pk, 2, part, first, last, c from parts where n >= 2 and {_TOKENS.format('c')} <= 1400)
select version_pk, 'chunk#' || lpad((row_number() over (partition by version_pk order by kind, pos))::varchar, 6, '0') as chunk_id, case when kind = 0 then 'page_text_chunk' else 'window_pdf_chunk' end as chunk_type, first as page_first, last as page_last, sha1(text) as digest,
  case kind when 1 then 'short_adjacent_pages' when 2 then 'page_part_window' end as reason from every""")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = ex.page_chunks(pg.text_pages(table(spark, d, "chunks")))
    return made.select("version_pk", "chunk_id", "chunk_type", "page_first", "page_last", F.sha1("text").alias("digest"), F.try_element_at("metadata", F.lit("window_reason")).alias("reason"))


@query("""with p as (select version_pk, coalesce(page_no, page_span.first, ordinal) as page, bool_or(regexp_replace(coalesce(case when ordinal % 4 = 0 then ' ' else text end, ''), '\\s+', '', 'g') <> '') as has from chunks where chunk_type = 'page_text_chunk' group by all)
select version_pk, count(*) as pages, coalesce(string_agg(case when not has then page::varchar end, ',' order by page), '') as visual from p group by version_pk""")
def visual_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages, of which every fourth is made blank."""
    rows = table(spark, d, "chunks").withColumn("text", F.when(F.col("ordinal") % 4 == 0, " ").otherwise(F.col("text")))
    return ex.visual_pages(rows).withColumn("visual", F.array_join(F.col("visual").cast("array<string>"), ","))


@query(f"""with c as (select version_pk, ordinal as i, chunk_id, regexp_replace(substr(replace(replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '\\', ''), '`', ''), 1, 40), '^ | $', '', 'g') as t from {_ONE} where doc_type = 'docx'),
l as (select version_pk, i, chunk_id, 'a ' || case when i % 2 = 0 then '**' || t || '**' else '*' || t || '*' end || ' [more](https://x.example/' || i || ')' as line, t from c),
b as (select version_pk, i, chunk_id, case when i % 6 = 5 then '| ' || case when t = '' then '' else t end || ' | n |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || i || ' |  |'
  when i % 6 = 0 then '# ' || line when i % 6 = 1 then '### ' || line when i % 6 = 2 then '  - ' || line when i % 6 = 3 then '1. ' || line else line end as line from l)
select version_pk, sha1(string_agg(line, chr(10) order by i, chunk_id)) as digest, count(*) as blocks from b group by version_pk""")
def docx_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of word-processor documents written as the blocks of one: headings, items, runs with emphasis and links, tables."""
    rows = table(spark, d, "chunks").where("doc_type = 'docx'").dropDuplicates(["version_pk", "chunk_id"])
    i = F.col("ordinal")
    clean = F.replace(F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.lit("\\"), F.lit("")), F.lit("`"), F.lit(""))
    t = F.regexp_replace(F.substring(clean, 1, 40), "^ | $", "")
    style = F.element_at(F.array(*[F.lit(x) for x in ("Title", "Heading 3", "List Bullet 2", "Normal", "Body", "Table")]), (i % 6 + 1).cast("int"))
    no, none = F.lit(False), F.lit(None).cast("string")
    run = lambda text, bold=no, italic=no, href=none: F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic"), href.alias("href"))
    runs = F.array(run(F.lit("a ")), run(F.when(t == "", "").otherwise(t), i % 2 == 0, i % 2 != 0), run(F.lit(" ")), run(F.lit("more"), href=F.concat(F.lit("https://x.example/"), i.cast("string"))))
    cells = F.when(i % 6 == 5, F.array(F.array(t, F.lit("n")), F.array(i.cast("string")), F.array(F.lit(" "))))
    blocks = rows.select("version_pk", F.struct("ordinal", "chunk_id").alias("block_no"), style.alias("style"), (i % 6 == 3).alias("numbered"), F.when(i % 6 == 2, 1).otherwise(0).alias("level"), runs.alias("runs"), cells.alias("cells"))
    made = ex.docx_markdown(blocks)
    return made.join(rows.groupBy("version_pk").agg(F.count("*").alias("blocks")), "version_pk").select("version_pk", F.sha1("markdown").alias("digest"), "blocks")


def _recognised(spark: SparkSession, d: str) -> DataFrame:
    """Scanned versions as one Markdown document each, every page with a picture."""
    pages = pg.text_pages(table(spark, d, "chunks"))
    link = F.concat(F.lit("\n\n![page](https://ocr.example/p/"), F.col("page").cast("string"), F.lit(".PNG?sig=1)"))
    part = F.struct("rn", F.concat(F.regexp_replace("text", r"^\s+|\s+$", ""), link).alias("text"))
    ordered = F.array_sort(F.collect_list(part))
    rows = pages.groupBy("version_pk").agg(F.transform(ordered, lambda x: F.to_json(F.struct(x["text"].alias("text")))).alias("lines"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("markdown"))
    return ex.local_images(rows.withColumn("lines", F.when(F.length("version_pk") % 5 > 0, F.col("lines"))))


_WHOLE = f"""w as (select version_pk, count(*) as pages, count(distinct page) as images, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || '![page](assets/asset-' || lpad(k::varchar, 6, '0') || '.png)', chr(10) || chr(10) order by rn) as text
  from (select *, dense_rank() over (partition by version_pk order by f) as k from (select *, min(rn) over (partition by version_pk, page) as f from pages)) group by version_pk)"""


@query(f"""with recursive {_PAGES}, {_WHOLE}, {markdown_sql("select version_pk as doc_id, text from w", 1400, 2048)[2]}, n as (select doc_id, count(*) as n, max({_TOKENS.format('text')}) as most, sha1(string_agg(text, chr(10) order by n, part_no)) as digest from parts group by doc_id)
select version_pk, n as chunks, digest, case when length(version_pk) % 5 > 0 then pages else 0 end as page_count, images as page_image_asset_count, (length(version_pk) % 5 > 0)::int as raw_json_asset_count, n + 1 as markdown_asset_count,
  n + 1 + images + (length(version_pk) % 5 > 0)::int as assets from w join n on doc_id = version_pk""")
def ocr_manifest(spark: SparkSession, d: str) -> DataFrame:
    documents = materialize(_recognised(spark, d), "recognised")
    chunks = materialize(ex.ocr_chunks(documents), "recognised-chunks")
    made = ex.ocr_manifests(documents, chunks)
    count = lambda k: F.col("metadata")[k].cast("long").alias(k)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n")
    text = chunks.groupBy("version_pk").agg(F.count("*").alias("chunks"), F.sha1(whole).alias("digest"))
    assets = ex.ocr_assets(documents, chunks).groupBy("version_pk").agg(F.count("*").alias("assets"))
    return made.select("version_pk", *[count(k) for k in ("page_count", "page_image_asset_count", "raw_json_asset_count", "markdown_asset_count")]).join(text, "version_pk").join(assets, "version_pk")


# ------------------------------------------------------------ search

_SIZE = "(select count(*) from embeddings)"
_OF_CHUNK = "select version_pk, chunk_id, split_part(version_pk, '#', 1) as tenant, (('0x' || substr(md5(version_pk || chunk_id), 1, 7))::bigint % {0}) as vec from (select distinct version_pk, chunk_id from chunks)"


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each chunk: the tables' vectors dealt to chunks by a hash of their key."""
    rows = table(spark, d, "embeddings")
    deal = F.conv(F.substring(F.md5(F.concat("version_pk", "chunk_id")), 1, 7), 16, 10).cast("long") % rows.count()
    chunks = table(spark, d, "chunks").select("version_pk", "chunk_id").distinct()
    dealt = chunks.select(F.concat_ws("|", "version_pk", "chunk_id").alias("vec_id"), "version_pk", "chunk_id", ident.tenant_of_pk(F.col("version_pk")).alias("tenant"), deal.alias("v"))
    return dealt.join(rows.select(F.col("vec_id").alias("v"), "embedding", "label"), "v")


def _asked_of_tenants(spark: SparkSession, d: str, dealt: DataFrame) -> DataFrame:
    """Every hundredth vector asks for the tenant of the last chunk that holds it."""
    return dealt.where("v % 100 = 0").groupBy(F.col("v").alias("qid"), F.col("embedding").alias("q")).agg(F.max("tenant").alias("tenant"))


_DEALT = f"""dealt as (select version_pk || '|' || chunk_id as vec_id, c.version_pk, chunk_id, tenant, vec as v, embedding, label from ({_OF_CHUNK.format(_SIZE)}) c join embeddings e on e.vec_id = c.vec),
asked as (select v as qid, any_value(embedding) as q, max(tenant) as tenant from dealt where v % 100 = 0 group by v)"""


def _near(dims: int) -> str:
    a, b = f"q[1:{dims}]::double[]", f"embedding[1:{dims}]::double[]"
    dot = "list_dot_product({0}, {1})"
    return f"""select * from (select qid, vec_id, version_pk, chunk_id, label, distance, row_number() over (partition by qid order by distance, vec_id) as rank from (
      select qid, vec_id, version_pk, chunk_id, label, round(1 - {dot.format(a, b)} / (sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)})), 4) + 0.0 as distance from asked join dealt using (tenant))) where rank <= {K}"""


@query(f"with {_DEALT} select qid, vec_id, distance, rank from ({_near(64)})")
def tenant_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of each question's own tenant."""
    dealt = materialize(_chunk_vectors(spark, d), "chunk-vectors")
    return vec.vector_topk(_asked_of_tenants(spark, d, dealt), dealt.withColumnRenamed("embedding", "vector"), K, same=["tenant"])


_READY = "('0x' || substr(md5(version_pk || p), 1, 1))::int"


@query(f"""with {_DEALT},
lists as (select *, 0 as i, 'main' as p from ({_near(64)}) union all select *, 1, 'short' from ({_near(32)})),
fused as (select qid, vec_id, any_value(version_pk) as version_pk, any_value(chunk_id) as chunk_id, any_value(label) as label, round(sum(1.0 / (60 + rank)), 9) as score, count(*) as hits, min((i, rank)) as f, min((distance, i))[2] as bi from lists group by qid, vec_id),
top as (select *, case bi when 0 then 'main' else 'short' end as p from (select *, row_number() over (partition by qid order by score desc, f, vec_id) as place from fused) where place <= {K}),
proj as (select version_pk, p, {_READY} as h from (select distinct version_pk from chunks), (values ('main'), ('short')) as t(p)),
seen as (select t.*, row_number() over (partition by qid order by place) as rank from top t left join {_STATE} s on s.object_pk = split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3)
  left join proj using (version_pk, p)
  where case when s.object_pk is null then label < 5 else not s.is_deleted and s.object_pk || '#' || s.latest_version_id is not distinct from version_pk end and case when h is null or h < 2 then label < 5 else h > 4 end),
text as (select version_pk, chunk_id, max(text) as text from chunks group by all),
placed as (select version_pk, chunk_id, row_number() over (partition by version_pk order by ordinal, chunk_id) as n from (select distinct version_pk, chunk_id, ordinal from chunks)),
around as (select a.version_pk, a.chunk_id, string_agg((b.n - a.n)::varchar || ':' || b.chunk_id, ',' order by b.n) as near from placed a join placed b on a.version_pk = b.version_pk and abs(a.n - b.n) = 1 group by all)
select qid, rank, 'doc_' || substr(sha1(url_decode(split_part(version_pk, '#', 1)) || chr(0) || url_decode(split_part(version_pk, '#', 2)) || chr(0) || url_decode(split_part(version_pk, '#', 3)) || chr(0) || url_decode(split_part(version_pk, '#', 4))), 1, 20) as document_id,
  score as fusion_score, hits as profile_hit_count, sha1(coalesce(text, '')) as digest, coalesce(near, '') as near from seen join text using (version_pk, chunk_id) left join around using (version_pk, chunk_id)""")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """Search from end to end: two profiles within the tenant, fused, cut, governed by state and projection, with text and neighbours."""
    dealt = materialize(_chunk_vectors(spark, d), "chunk-vectors")
    asked = _asked_of_tenants(spark, d, dealt)
    lists = None
    for i, dims in enumerate((64, 32)):
        vectors, queries = dealt.withColumn("vector", F.slice("embedding", 1, dims)), asked.withColumn("q", F.slice("q", 1, dims))
        one = vec.vector_topk(queries, vectors, K, same=["tenant"]).select("qid", F.lit(i).alias("profile_idx"), "rank", "vec_id", "distance")
        lists = one if lists is None else lists.unionByName(one)
    top = materialize(vec.fused_topk(vec.fuse_ranks(lists), K), "fused")
    known = dealt.join(top.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "version_pk", "chunk_id", (F.col("label") < 5).alias("is_latest"))
    hits = top.join(known, "vec_id").withColumn("profile_id", F.when(F.col("best_profile") == 0, "main").otherwise("short"))
    chunks = table(spark, d, "chunks")
    every = chunks.select("version_pk").distinct().join(F.broadcast(mf.profile_table(spark, PROFILES).where("profile_id in ('main', 'short')").select("profile_id")))
    h = F.conv(F.substring(F.md5(F.concat("version_pk", "profile_id")), 1, 1), 16, 10).cast("int")
    projection = every.select("version_pk", "profile_id", h.alias("h")).where("h >= 2").select("version_pk", "profile_id", F.when(F.col("h") > 4, "INDEXED").otherwise("PENDING").alias("query_status"))
    shown = se.govern_versions(hits, _state(spark, d), projection).withColumn("metadata", F.create_map(F.lit("tenant_id"), F.lit("x"), F.lit("doc_type"), F.lit("y")))
    answers = se.answer_rows(se.with_context(shown, chunks, 1))
    near = F.array_join(F.transform("neighbours", lambda x: F.concat(x["offset"].cast("string"), F.lit(":"), x["chunk_id"])), ",")
    return answers.select("qid", "rank", "document_id", "fusion_score", "profile_hit_count", F.sha1(F.coalesce("match.text", F.lit(""))).alias("digest"), near.alias("near"))


@query("""select 'p' || (delivery_id % 3) as profile_id, case when batch_no % 2 = 0 then 'search' else 'manifest_load' end as stage, tenant_id as manifest_uri, arg_min('e' || delivery_id, delivery_id) as error from extract_jobs group by all""")
def degraded_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as failures of profiles."""
    i = F.col("delivery_id")
    rows = table(spark, d, "extract_jobs").select(F.concat(F.lit("p"), (i % 3).cast("string")).alias("profile_id"), F.when(F.col("batch_no") % 2 == 0, "search").otherwise("manifest_load").alias("stage"), F.col("tenant_id").alias("manifest_uri"), i.alias("seq"), F.concat(F.lit("e"), i.cast("string")).alias("error"))
    return se.degraded_profiles(rows)


@query(f"""with r as ({_REQUESTS.join(['with ', ' select version_pk, chunk_id, meta from requests'])})
select version_pk, chunk_id, string_agg(name, ',' order by name) as names from (select version_pk, chunk_id, unnest(map_keys(meta)) as name, unnest(map_values(meta)) as value from r)
where trim(coalesce(value, '')) <> '' and name not in ('tenant_id', 'bucket', 'key', 'manifest_s3_uri', 'profile_id', 'provider', 'model', 'dimension', 'security_scope', 'chunk_id') group by version_pk, chunk_id""")
def public_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = mf.embedding_requests(table(spark, d, "chunks"), table(spark, d, "manifests"), _labels(spark, d), _page_assets(spark, d))
    return rows.select("version_pk", "chunk_id", F.array_join(F.array_sort(F.map_keys(se.public_metadata(F.col("metadata")))), ",").alias("names"))


# ------------------------------------------------------------ sinks

@query("""with n as (select *, split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3) as o, length(version_pk) % 2 as late from (select distinct version_pk, chunk_id from chunks)),
late as (select distinct o from n where late = 1) select version_pk, 'chunk#' || chunk_id as sk, late = 1 or late.o is null as is_latest from n left join late on n.o = late.o""")
def index_persist(spark: SparkSession, d: str) -> DataFrame:
    """Index rows written in two goes, the second demoting earlier versions of its objects; what then stands is read back."""
    rows = materialize(mf.index_rows(table(spark, d, "chunks")), "index-rows")
    at = new_path(spark, "chunk-index")
    for late in (0, 1):
        sk.persist_index(spark, at, rows.where(F.length("version_pk") % 2 == late), 16)
    return sk.read_index(spark, at, rows).select("version_pk", "sk", "is_latest")


_MARKS = "select version_pk, p from (select distinct version_pk from chunks), (values ('main'), ('images'), ('short')) as t(p) where ('0x' || substr(md5(version_pk || p), 1, 1))::int > 1"
_OLD = f"""old as (select v.version_pk, s.object_pk, s.is_deleted from (select distinct version_pk from chunks) v join {_STATE} s on s.object_pk = split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3)
  where s.is_deleted or s.latest_version_id is distinct from split_part(version_pk, '#', 4)),
done as (select s.object_pk from {_STATE} s join ({_MARKS}) m on m.version_pk = s.object_pk || '#' || s.latest_version_id where not s.is_deleted group by s.object_pk having count(*) = 3),
gone as (select version_pk from old where is_deleted or object_pk in (select object_pk from done))"""


def _marks(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "chunks").select("version_pk").distinct().join(F.broadcast(mf.profile_table(spark, PROFILES).where("writes").select("profile_id")))
    return every.withColumn("done", F.conv(F.substring(F.md5(F.concat("version_pk", "profile_id")), 1, 1), 16, 10).cast("int") > 1)


@query(f"with {_OLD} select p as profile_id, count(*) as vectors from (select distinct version_pk, chunk_id from chunks) c, (values ('main'), ('short')) as t(p) where version_pk not in (select version_pk from gone) group by p")
def vectors_left(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that stand after the clean-up of earlier versions, which waits until the current one is complete."""
    chunks, profiles = table(spark, d, "chunks"), mf.profile_table(spark, PROFILES)
    gone = sk.previous_versions(chunks, _state(spark, d), profiles, _marks(spark, d))
    fan = mf.fan_out(mf.requests(chunks), profiles).select("profile_id", "version_pk", mf.vector_key(F.col("profile_id"), F.col("version_pk"), F.col("chunk_id")).alias("key"))
    keys = fan.join(gone, "version_pk", "left_semi").select("profile_id", "key")
    return sk.without_keys(fan, keys).groupBy("profile_id").agg(F.count("*").alias("vectors"))


@query(f"""select p as profile_id, p || '#' || version_pk || '#' || x as key from (select distinct version_pk, chunk_id as x from chunks union select version_pk, 'asset#' || chunk_id from chunks where chunk_type = 'page_text_chunk') c
join {_STATE} s on s.object_pk = split_part(version_pk, '#', 1) || '#' || split_part(version_pk, '#', 2) || '#' || split_part(version_pk, '#', 3) cross join (values ('main'), ('images'), ('short')) as t(p)
where is_deleted or latest_version_id is distinct from split_part(version_pk, '#', 4)""")
def previous_keys(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of superseded versions, of chunks and of pictures of pages."""
    return mf.cleanup_keys(table(spark, d, "chunks"), _state(spark, d), mf.profile_table(spark, PROFILES), _page_assets(spark, d))


@query(f"""select l.object_pk, case when s.object_pk is null then 'missing_state' when s.is_deleted then 'deleted' when s.latest_version_id is distinct from l.latest_version_id then 'stale' when m.version_pk is null then 'no_manifest'
  when k.version_pk is not null then 'already_projected' else 'eligible' end as reason
from ({_PREFERRED}) l left join {_STATE} s on l.object_pk = s.object_pk left join (select distinct version_pk from manifests) m on m.version_pk = l.object_pk || '#' || l.latest_version_id
left join (select version_pk from ({_MARKS}) where p = 'main') k on k.version_pk = l.object_pk || '#' || l.latest_version_id""")
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    """Reasons for one profile, versions that are indexed in it left out."""
    projection = _marks(spark, d).select("version_pk", "profile_id", F.when(F.col("done"), "INDEXED").alias("query_status"))
    return mf.backfill_reasons(ev.prefer_lookup(table(spark, d, "object_lookup")), _state(spark, d), table(spark, d, "manifests"), projection, "main")


@query("""with s as (select object_pk, latest_version_id from object_lookup where object_pk is not null and latest_version_id is not null), t as (select object_pk, max(latest_version_id) as v from s group by object_pk)
select feed_pos, coalesce(op = 'U' and c.latest_version_id = v, false) as same from lookup_changes c left join t on t.object_pk = c.object_pk where c.object_pk is not null""")
def same_version(spark: SparkSession, d: str) -> DataFrame:
    """Changes judged as accepted that name the version which the lookup already holds."""
    rows = table(spark, d, "lookup_changes").where("object_pk is not null").select("feed_pos", F.col("object_pk").alias("object"), F.col("latest_version_id").alias("version"), F.when(F.col("op") == "U", "UPSERT").otherwise("DELETE").alias("op"), F.lit("accepted").alias("reason"), F.lit(True).alias("accepted"))
    stored = table(spark, d, "object_lookup").where("object_pk is not null and latest_version_id is not null").groupBy(F.col("object_pk").alias("object")).agg(F.max("latest_version_id").alias("version"))
    judged = ev.same_version(rows, stored)
    return judged.select("feed_pos", (~F.col("accepted")).alias("same"))
