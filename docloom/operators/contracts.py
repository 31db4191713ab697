"""Contracts of manifests, chunks, assets, requests and jobs, as rows of what breaks them: nothing is dropped, nothing raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.io import blank_to_null

# Kind of document, format, and the metadata that each requires of its manifest, chunks and assets.
FORMATS = (
    ("md", "markdown", ("source_format", "section_count"), ("source_format",), ("source_format",)),
    ("docx", "python-docx", ("source_format", "section_count"), ("source_format", "converter"), ("source_format",)),
    ("pptx", "python-pptx", ("source_format", "slide_count", "image_asset_count"), ("source_format", "image_count", "has_notes"), ("source_format",)),
    ("pdf", "pdf", ("source_format", "page_count", "page_image_asset_count", "visual_page_numbers"), ("source_format",), ("source_format",)),
    ("pdf", "paddleocr_async", ("source_format", "page_count", "page_image_asset_count", "raw_json_asset_count", "layout_markdown_asset_count", "document_markdown_asset_count", "markdown_asset_count", "ocr_engine"),
     ("source_format", "layout_index"), ("source_format", "relative_path", "source_field")),
)
# Metadata that every request must carry, and the kinds of its content.
REQUEST_KEYS = ("tenant_id", "bucket", "key", "version_id", "document_uri", "language", "doc_type", "source_format", "manifest_s3_uri", "is_latest")
KINDS = ("text", "image", "pdf")
# Assets that are embedded as images.
IMAGES = ("page_image_chunk", "slide_image_chunk", "image_chunk")
# Formats that can be read, and those that are known but refused.
ROUTES = {"md": "sync", "docx": "sync", "pptx": "sync", "pdf": "ocr"}
REFUSED = ("doc", "ppt")


def _required(part: int) -> Column:
    """From kind of document and format to the names that one part requires."""
    return F.create_map(*[x for f in FORMATS for x in (F.lit(f"{f[0]}|{f[1]}"), F.array(*[F.lit(k) for k in f[part]]))])


def _missing(metadata: Column, names: Column) -> Column:
    """Names that a map lacks: absent, null or empty."""
    return F.filter(names, lambda k: F.coalesce(F.try_element_at(metadata, k), F.lit("")) == "")


def _named(rules: dict[str, Column], lacking: Column) -> Column:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return F.concat(broken, F.transform(F.coalesce(lacking, F.array().cast("array<string>")), lambda k: F.concat(F.lit("missing "), k)))


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """(version_pk, violation): contracts that manifests break; the same one of a version comes out once. A null map lacks all."""
    declared = blank_to_null(F.col("metadata")["source_format"])
    names = F.try_element_at(_required(2), F.concat("doc_type", F.lit("|"), declared))
    rules = {
        "missing source_format": declared.isNull(),
        "source_format differs": declared != F.col("source_format"),
        "unsupported format": declared.isNotNull() & names.isNull(),
    }
    return manifests.select("version_pk", F.explode(_named(rules, F.filter(_missing(F.col("metadata"), names), lambda k: k != "source_format"))).alias("violation")).distinct()


def _of_manifest(rows: DataFrame, manifests: DataFrame, part: int) -> DataFrame:
    """rows with the format that their version's manifest declares, and the names that it requires of them."""
    one = manifests.where("version_pk is not null").groupBy("version_pk").agg(F.max(F.struct("source_format", "doc_type")).alias("m"))
    spec = one.select("version_pk", F.col("m.source_format").alias("__format"), F.try_element_at(_required(part), F.concat("m.doc_type", F.lit("|"), "m.source_format")).alias("__names"))
    return rows.join(spec, "version_pk", "left")


def chunk_violations(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """(version_pk, chunk_id, violation): what the format of a version's manifest asks of its chunks. Exact duplicates count once."""
    rows = _of_manifest(chunks.select("version_pk", "chunk_id", "metadata", "page_span"), manifests, 3)
    own = F.try_element_at("metadata", F.lit("source_format"))
    rules = {
        "no manifest": F.col("__format").isNull(),
        "no metadata": F.col("metadata").isNull(),
        "source_format differs": own != F.col("__format"),
        "page_span incomplete": F.col("page_span").isNotNull() & (F.col("page_span.first").isNull() | F.col("page_span.last").isNull()),
        "page_span reversed": F.col("page_span.first") > F.col("page_span.last"),
    }
    lacking = F.when(F.col("metadata").isNotNull(), _missing(F.col("metadata"), F.col("__names")))
    return rows.select("version_pk", "chunk_id", F.explode(_named(rules, lacking)).alias("violation")).distinct()


def asset_violations(assets: DataFrame, manifests: DataFrame) -> DataFrame:
    """(version_pk, asset_id, violation) of assets (version_pk, asset_id, metadata, has_payload, asset_uri)."""
    rows = _of_manifest(assets, manifests, 4)
    own = F.try_element_at("metadata", F.lit("source_format"))
    rules = {
        "no manifest": F.col("__format").isNull(),
        "no metadata": F.col("metadata").isNull(),
        "source_format differs": own != F.col("__format"),
        "no payload and no uri": ~F.coalesce("has_payload", F.lit(False)) & blank_to_null(F.col("asset_uri")).isNull(),
    }
    lacking = F.when(F.col("metadata").isNotNull(), _missing(F.col("metadata"), F.col("__names")))
    return rows.select("version_pk", "asset_id", F.explode(_named(rules, lacking)).alias("violation")).distinct()


def request_violations(requests: DataFrame) -> DataFrame:
    """(version_pk, chunk_id, violation) of requests (version_pk, chunk_id, chunk_type, kind, dimension, text, asset_uri,
    mime_type, metadata). A chunk_id that a version has more than once is told once."""
    blank = lambda c: blank_to_null(F.col(c)).isNull()
    kind = F.col("kind")
    rules = {
        "missing chunk_id": blank("chunk_id"),
        "missing chunk_type": F.coalesce("chunk_type", F.lit("")) == "",
        "dimension not positive": F.coalesce("dimension", F.lit(0)) <= 0,
        "unknown kind": ~F.coalesce(kind.isin(*KINDS), F.lit(False)),
        "text without text": (kind == "text") & blank("text"),
        "image without uri": (kind == "image") & blank("asset_uri"),
        "image without mime_type": (kind == "image") & blank("mime_type"),
        "pdf without text or uri": (kind == "pdf") & F.col("text").isNull() & blank("asset_uri"),
    }
    lacking = _missing(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.array(*[F.lit(k) for k in REQUEST_KEYS]))
    each = requests.select("version_pk", "chunk_id", F.explode(_named(rules, lacking)).alias("violation")).distinct()
    twice = requests.groupBy("version_pk", "chunk_id").count().where("count > 1").select("version_pk", "chunk_id", F.lit("duplicate chunk_id").alias("violation"))
    return each.unionByName(twice)


def job_violations(jobs: DataFrame) -> DataFrame:
    """(job_id, violation) of jobs (job_id, profile_id, trace_id, manifest_uri, requests), requests being their number."""
    rules = {f"missing {c}": blank_to_null(F.col(c)).isNull() for c in ("profile_id", "trace_id", "manifest_uri")}
    rules["no requests"] = F.coalesce("requests", F.lit(0)) <= 0
    return jobs.select("job_id", F.explode(_named(rules, F.array().cast("array<string>"))).alias("violation"))


def route(extension: Column) -> Column:
    """struct (route, error): how a file is read by its ending, or why it is not."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), extension)
    error = F.when(extension.isin(*REFUSED), F.concat(F.lit("convert first: "), extension)).when(known.isNull(), F.concat(F.lit("unsupported: "), F.coalesce(extension, F.lit(""))))
    return F.struct(known.alias("route"), error.alias("error"))
