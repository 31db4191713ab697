"""Identity of objects and versions: escaped keys, document addresses, sequencers. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.io import blank_to_null


def escape_part(col: Column) -> Column:
    """Percent-escape everything but unreserved characters (Spark's url_encode escapes for forms, hence the repairs)."""
    form = F.url_encode(col)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unescape_part(col: Column) -> Column:
    """The reverse of escape_part; malformed escapes stay as they are."""
    safe = F.regexp_replace(F.replace(col, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), col)


def object_pk(tenant: Column, bucket: Column, key: Column) -> Column:
    return F.concat(escape_part(tenant), F.lit("#"), escape_part(bucket), F.lit("#"), escape_part(key))


def version_pk(tenant: Column, bucket: Column, key: Column, version: Column) -> Column:
    return F.concat(object_pk(tenant, bucket, key), F.lit("#"), escape_part(version))


def document_uri(bucket: Column, key: Column, version: Column) -> Column:
    path = F.replace(escape_part(key), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), path, F.lit("?versionId="), escape_part(version))


def uri_of_version_pk(pk: Column) -> Column:
    """Document address of the version that an escaped version key names."""
    part = F.split(pk, "#")
    key = F.replace(F.get(part, F.lit(2)), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit("s3://"), unescape_part(F.get(part, F.lit(1))), F.lit("/"), key, F.lit("?versionId="), F.get(part, F.lit(3)))


def object_of_version_pk(pk: Column) -> Column:
    return F.substring_index(pk, "#", 3)


def tenant_of_pk(pk: Column) -> Column:
    return unescape_part(F.substring_index(pk, "#", 1))


def extension(key: Column) -> Column:
    return F.when(F.contains(key, F.lit(".")), F.lower(F.substring_index(key, ".", -1))).otherwise(F.lit(""))


def document_id(tenant: Column, bucket: Column, key: Column, version: Column) -> Column:
    nul = F.lit("\x00")
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat(tenant, nul, bucket, nul, key, nul, version)), 1, 20))


def sequencer_norm(col: Column) -> Column:
    """Stripped, upper case, zero-padded to 32; blank is null; longer ones stay whole."""
    s = F.upper(blank_to_null(col))
    return F.when(F.length(s) < 32, F.lpad(s, 32, "0")).otherwise(s)


def sequencer_value(col: Column) -> Column:
    """Sequencers of one value in one writing: stripped, upper case, no leading zeros; blank is null."""
    return F.regexp_replace(F.upper(blank_to_null(col)), r"^0+(?=.)", "")


def sequencer_order(col: Column) -> Column:
    """A struct that orders sequencers by value whatever their length, absent ones first."""
    v = sequencer_value(col)
    return F.struct(v.isNotNull().alias("has"), F.coalesce(F.length(v), F.lit(0)).alias("digits"), F.coalesce(v, F.lit("")).alias("value"))
