"""Names that are derived from identity: folders, paths, addresses, run names, file names. Native but for one normal form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.identity import unescape_part
from docloom.io import blank_to_null

# File name endings of the media types that documents come with.
ENDINGS = {
    "application/x-ndjson": ".jsonl", "application/jsonl": ".jsonl", "application/json": ".json", "application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif",
    "image/webp": ".webp", "image/svg+xml": ".svg", "image/tiff": ".tiff", "image/bmp": ".bmp", "text/plain": ".txt", "text/html": ".html", "text/csv": ".csv",
}
# Words that mean yes, in metadata and in requests; words of a configuration, which knows no others.
TRUE_METADATA, TRUE_REQUEST = ("1", "true", "yes", "y"), ("1", "true", "yes", "on")
FLAGS = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def source_folder(key: Column, object_pk: Column) -> Column:
    """A readable folder that no two objects share: the file name made safe, and a digest of the object's key."""
    last = F.regexp_extract(F.regexp_replace(key, "/+$", ""), "([^/]*)$", 1)
    name = F.regexp_replace(nfkc(last), r"(?U)^\s+|\s+$", "")
    name = F.when(name.isNull() | name.isin("", ".", ".."), "document").otherwise(name)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.when(suffix == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))
    safe = F.replace(F.trim(F.regexp_replace(stem, r"[^\p{L}\p{N}._\- ]", "-")), F.lit(" "), F.lit("-"))
    safe = F.regexp_replace(F.regexp_replace(safe, "[-_.]{2,}", "-"), r"^[.\-_]+|[.\-_]+$", "")
    safe = F.when(safe == "", "document").otherwise(safe)
    return F.concat(safe, F.lower(suffix), F.lit("--"), F.substring(F.sha1(object_pk), 1, 12))


def clean_path(path: Column) -> Column:
    """A relative path without leading slashes; null for empty ones and those with empty, '.' or '..' steps."""
    p = F.regexp_replace(F.regexp_replace(path, r"(?U)^\s+|\s+$", ""), "^/+", "")
    return F.when((p != "") & ~F.rlike(p, F.lit(r"(^|/)\.{0,2}(/|$)")), p)


def manifest_path(key: Column, object_pk: Column, relative: Column | str = "manifest.json", prefix: str = "") -> Column:
    """Where a manifest, or an asset beside it, is kept; null for a path that is not allowed."""
    tail = F.lit(relative) if isinstance(relative, str) else relative
    return F.concat(F.lit(prefix.strip("/") + "/" if prefix.strip("/") else ""), source_folder(key, object_pk), F.lit("/"), clean_path(tail))


def uri_parts(uri: Column) -> Column:
    """Address to struct (bucket, key, version_id); null if it is none. The key may be escaped, the version absent."""
    bucket, path = F.regexp_extract(uri, r"^s3://([^/?#]+)", 1), F.regexp_extract(uri, r"^s3://[^/?#]+/([^?#]*)", 1)
    version = unescape_part(blank_to_null(F.regexp_extract(uri, r"[?&]versionId=([^&#]*)", 1)))
    valid = F.rlike(uri, F.lit(r"^s3://[^/?#]+/"))
    return F.when(valid, F.struct(bucket.alias("bucket"), F.regexp_replace(path, "^/+", "").alias("key"), version.alias("version_id")))


def _digest(col: Column, n: int) -> Column:
    return F.substring(F.sha1(col), 1, n)


def execution_name(tenant: Column, bucket: Column, key: Column, version: Column, sequencer: Column) -> Column:
    seq = F.coalesce(F.nullif(sequencer, F.lit("")), F.lit("noseq"))
    return F.concat(F.lit("ingest-"), _digest(tenant, 8), F.lit("-b"), _digest(bucket, 8), F.lit("-k"), _digest(key, 16), F.lit("-v"), _digest(version, 12), F.lit("-s"), _digest(seq, 12))


def cleanup_name(base: Column, profile: Column, index: Column) -> Column:
    own = lambda c, word: F.coalesce(F.nullif(c, F.lit("")), F.lit(word))
    return F.concat(base, F.lit("-cleanup-p"), _digest(own(profile, "profile"), 8), F.lit("-i"), _digest(own(index, "index"), 8))


def payload_name(payload: Column) -> Column:
    """cleanup- and the digest of a map of strings, written as JSON with its names in order."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    entries = F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.concat(F.lit("cleanup-"), F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")), 256), 1, 48))


def ending(mime: Column) -> Column:
    """File name ending of a media type; .bin for unknown ones."""
    low = F.lower(F.trim(mime))
    table = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return F.when(F.startswith(low, F.lit("text/markdown")), ".md").otherwise(F.coalesce(F.try_element_at(table, low), F.lit(".bin")))


def safe_filename(name: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), r"^[.\-_]+|[.\-_]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("asset"))


def latest_time(*times: Column) -> Column:
    """The latest of several times written as text, as it is written; the first that says anything if none is a time."""
    each = F.transform(F.array(*times), lambda t: F.struct(F.try_to_timestamp(t).alias("at"), t.alias("raw")))
    best = F.array_max(F.filter(each, lambda x: x["at"].isNotNull()))
    return F.coalesce(best["raw"], *[blank_to_null(t) for t in times])


def truthy(col: Column, words: tuple[str, ...] = TRUE_METADATA) -> Column:
    return F.coalesce(F.lower(F.trim(col)).isin(*words), F.lit(False))


def config_flag(text: str | None, default: bool = False) -> bool:
    """A configuration's word as a flag; words that it does not know are an error."""
    if text is None or not text.strip():
        return default
    if text.strip().lower() not in FLAGS:
        raise ValueError(f"not a flag: {text!r}")
    return FLAGS[text.strip().lower()]
