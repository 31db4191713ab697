"""Change events: envelopes to messages, and the version of each object that a log of events leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.identity import document_uri, sequencer_norm
from docloom.io import blank_to_null, materialize
from docloom.operators.running import BLOCK, before, in_blocks

_RECORD = """struct<eventVersion:string, eventSource:string, eventName:string, tenant_id:string, language:string,
 responseElements:map<string,string>, body:string,
 s3:struct<bucket:struct<name:string>, object:struct<key:string, versionId:string, sequencer:string, eTag:string>>>"""
ENVELOPE = f"Event string, Records array<{_RECORD}>"
# Deepest nesting of envelopes that is unwrapped, defaults of a message.
DEEPEST = 5
TENANT, LANGUAGE = "lookup", "zh"


def envelope_records(envelopes: DataFrame, payload: str = "payload") -> DataFrame:
    """(envelope_id, depth, record, error): the records of JSON envelopes (envelope_id, payload).

    Queue records wrap a further envelope in their body; these are unwrapped level by level. A record that is still
    wrapped below the deepest level, and an envelope without Records that is no test event, come out with an error
    instead of a record. Each level is one parse of what is still wrapped.
    """
    parsed = envelopes.select("envelope_id", F.from_json(payload, ENVELOPE).alias("e"))
    no_records = parsed.where(F.col("e").isNull() | (F.col("e.Records").isNull() & ~F.coalesce(F.col("e.Event").rlike("TestEvent$"), F.lit(False))))
    none = F.lit(None).cast(_RECORD)
    out = no_records.select("envelope_id", F.lit(0).alias("depth"), none.alias("record"), F.lit("no records").alias("error"))
    level = parsed.select("envelope_id", F.explode("e.Records").alias("record"))
    wrapped = F.coalesce(F.col("record.eventSource") == "aws:sqs", F.lit(False))
    for depth in range(DEEPEST + 1):
        plain = level.where(~wrapped).select("envelope_id", F.lit(depth).alias("depth"), "record", F.lit(None).cast("string").alias("error"))
        out = out.unionByName(plain)
        inner = level.where(wrapped)
        if depth == DEEPEST:
            out = out.unionByName(inner.select("envelope_id", F.lit(depth).alias("depth"), none.alias("record"), F.lit("nested too deep").alias("error")))
        else:
            level = inner.select("envelope_id", F.from_json("record.body", ENVELOPE).alias("e")).select("envelope_id", F.explode("e.Records").alias("record"))
    return out


def unquote_key(key: Column) -> Column:
    """A key with its form escapes decoded, malformed ones left as they are."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(key, "%(?![0-9A-Fa-f]{2})", "%25")), key)


def _operation() -> Column:
    r = F.col("record")
    return F.when(F.startswith(r["eventName"], F.lit("ObjectCreated")), "UPSERT").when(F.startswith(r["eventName"], F.lit("ObjectRemoved")), "DELETE")


def _fault() -> Column:
    """Why an object record gives no message; null if it does. Event versions from 2.1 on are read."""
    r = F.col("record")
    number = F.split(F.trim(r["eventVersion"]), r"\.")
    major, minor = F.get(number, F.lit(0)).try_cast("int"), F.coalesce(F.get(number, F.lit(1)).try_cast("int"), F.lit(0))
    return (
        F.when(F.coalesce((major > 2) | (major == 2) & (minor >= 1), F.lit(False)) == F.lit(False), "event version")
        .when(blank_to_null(r["s3"]["object"]["versionId"]).isNull(), "no version")
        .when(r["s3"]["bucket"]["name"].isNull() | r["s3"]["object"]["key"].isNull(), "no object")
    )


def refused_records(records: DataFrame) -> DataFrame:
    """(envelope_id, error): envelopes and object records that give no message though they should, each with the reason.

    Records of other kinds (neither created nor removed, from other sources) are no faults.
    """
    broken = records.where("error is not null").select("envelope_id", "error")
    return broken.unionByName(records.where(F.col("record").isNotNull() & _operation().isNotNull()).select("envelope_id", _fault().alias("error")).where("error is not null"))


def messages(records: DataFrame) -> DataFrame:
    """Messages of object records: created means UPSERT, removed means DELETE, all else is dropped.

    A version is required, and an event version that can be read; refused_records has what lacks them. Blank trace ids
    become the document's address.
    """
    r, operation = F.col("record"), _operation()
    bucket, key, version = r["s3"]["bucket"]["name"], unquote_key(r["s3"]["object"]["key"]), blank_to_null(r["s3"]["object"]["versionId"])
    trace = F.coalesce(blank_to_null(r["responseElements"]["x-amz-request-id"]), document_uri(bucket, key, version))
    return records.where(r.isNotNull() & _fault().isNull()).select(
        "envelope_id", operation.alias("operation"), F.coalesce(blank_to_null(r["tenant_id"]), F.lit(TENANT)).alias("tenant_id"), bucket.alias("bucket"), key.alias("object_key"),
        version.alias("version_id"), sequencer_norm(r["s3"]["object"]["sequencer"]).alias("sequencer"), F.coalesce(blank_to_null(r["language"]), F.lit(LANGUAGE)).alias("language"), trace.alias("trace_id"),
    ).where("operation is not null and version_id is not null and bucket is not null and object_key is not null")


def judge_events(log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The log (object, arrival, version, seq, op) with accepted and reason, each object's events in order of arrival.

    An event is accepted if its sequencer is above all earlier ones of its object; a delete before the object's first
    upsert is refused and leaves no mark, so a later, older create is accepted. Without a sequencer an event is accepted only as
    the first of its object. Ties in arrival go by sequencer, then version. state: (object, top, seen), one row an object, what events before the log have left: the
    top sequencer and whether there was an upsert.
    """
    order = ["arrival", "seq", "version"]
    upsert, carried = F.when(F.col("op") == "UPSERT", 1).otherwise(0), F.lit(False)
    if state is not None:  # its rows go before all events
        first = state.select("object", F.col("top").alias("seq"), F.when(F.col("seen"), "UPSERT").alias("op"), F.lit(True).alias("carried"))
        log = log.withColumn("carried", F.lit(False)).unionByName(first, allowMissingColumns=True).withColumn("event", ~F.col("carried"))
        order, carried = ["event", *order], F.col("carried")
    counted = before(in_blocks(log, ["object"], order, "event-log"), ["object"], order, {"upserts": (upsert, "sum")})
    orphan = ~carried & (F.col("op") == "DELETE") & (F.coalesce("upserts", F.lit(0)) == 0)
    marked = materialize(counted.withColumn("orphan", orphan), "event-orphans")
    seen = F.when(~F.col("orphan"), 1)
    topped = before(marked, ["object"], order, {"top": (F.when(~F.col("orphan"), F.col("seq")), "max"), "earlier": (seen, "sum")}).where(~carried)
    unnumbered = F.col("seq").isNull() & F.col("earlier").isNotNull()
    reason = F.when(F.col("orphan"), "delete_without_object").when((F.col("seq") <= F.col("top")) | unnumbered, "stale").otherwise("accepted")
    return topped.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted").drop("orphan", "upserts", "top", "earlier", "carried", "event", BLOCK)


def same_version(judged: DataFrame, state: DataFrame) -> DataFrame:
    """judged with accepted and reason revised against what is stored (object, version): an event that names the version
    which is already its object's current one changes nothing and is refused as same_version. Deletes are not."""
    stored = state.select("object", F.col("version").alias("__stored"))
    rows = judged.join(stored, "object", "left")
    same = F.col("accepted") & (F.col("op") == "UPSERT") & F.coalesce(F.col("version") == F.col("__stored"), F.lit(False))
    return rows.withColumn("reason", F.when(same, "same_version").otherwise(F.col("reason"))).withColumn("accepted", F.col("accepted") & ~same).drop("__stored")


def outcome_counts(judged: DataFrame) -> DataFrame:
    """(reason, events, objects) of judged events."""
    return judged.groupBy("reason").agg(F.count("*").alias("events"), F.count_distinct("object").alias("objects"))


def lookup_of(wanted: DataFrame, lookup: DataFrame) -> DataFrame:
    """wanted (object_pk, ...) with is_deleted and latest_version_id of the preferred lookup row; null for unknown objects.
    The keys asked for are made distinct before the lookup is read by them."""
    keys = wanted.select("object_pk").distinct()
    found = prefer_lookup(lookup.join(keys, "object_pk", "left_semi")).select("object_pk", "is_deleted", "latest_version_id")
    return wanted.join(found, "object_pk", "left")


def version_list(changes: DataFrame, limit: int = 10) -> DataFrame:
    """(object_pk, version_id, is_marker, place): the versions of each object, live ones before delete markers, newest first,
    limit at most. A version is a marker if it was only ever deleted."""
    rows = changes.where("object_pk is not null and latest_version_id is not null")
    seq = F.lpad(sequencer_norm(F.col("latest_sequencer")), 40, "0")
    each = rows.groupBy("object_pk", F.col("latest_version_id").alias("version_id")).agg(F.bool_and(F.col("op") == "D").alias("is_marker"), F.max(seq).alias("seq"))
    order = Window.partitionBy("object_pk").orderBy("is_marker", F.desc_nulls_last("seq"), "version_id")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("seq")


def latest_versions(judged: DataFrame) -> DataFrame:
    """(object, version, seq, is_deleted, previous_version): the state that the accepted events leave."""
    accepted = judged.where("accepted")
    top = accepted.groupBy("object").agg(F.max(F.struct("seq", "version", "op")).alias("t"))
    # accepted sequencers of an object all differ: what is left below the top one has the previous version at its top
    rest = accepted.join(top.select("object", "t.seq"), ["object", "seq"], "left_anti")
    previous = rest.groupBy("object").agg(F.max(F.struct("seq", "version")).alias("p"))
    return top.join(previous, "object", "left").select("object", "t.version", "t.seq", (F.col("t.op") == "DELETE").alias("is_deleted"), F.col("p.version").alias("previous_version"))


def prefer_lookup(lookup: DataFrame) -> DataFrame:
    """One lookup row an object: the newer key generation, then the later update, then the greater key."""
    rank = F.struct((~F.col("pk").startswith("lookup#")).alias("new"), F.col("updated_at").alias("at"), "pk")
    rest = [c for c in lookup.columns if c not in ("object_pk", "pk")]
    top = lookup.where("object_pk is not null").groupBy("object_pk").agg(F.max(F.struct(rank.alias("rank"), F.struct(*rest).alias("row"))).alias("t"))
    return top.select("object_pk", "t.rank.pk", *[F.col(f"t.row.`{c}`").alias(c) for c in rest])
