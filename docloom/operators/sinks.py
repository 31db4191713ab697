"""Writing what the pipeline makes: index rows by buckets of objects, vectors by profile, jobs in batches; and taking it back.

A sink is a folder of Parquet. Rows of an object lie in one of BUCKETS buckets, so a change rewrites the buckets it touches
and no others. What is to stand there is first written beside (io.materialize), then put in place by one overwrite of these
buckets: a writer that is lost before leaves everything as it was, and one that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.identity import object_of_version_pk
from docloom.io import exists, materialize, remove
from docloom.operators.contracts import job_violations
from docloom.operators.manifests import batches, complete_versions, flag_latest, superseded

BUCKETS, BATCH = 256, 10
#: Vectors of one file, as of one write.
VECTORS = 500


def _bucket(object_pk: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(object_pk), F.lit(buckets)).cast("int")


def read_index(spark: SparkSession, at: str, like: DataFrame) -> DataFrame:
    """The rows that stand in the index in folder at; none if nothing was written yet."""
    return spark.read.schema(like.schema).parquet(at).select(like.columns) if exists(spark, at) else like.limit(0)


def _replace(spark: SparkSession, at: str, rows: DataFrame, touched: DataFrame, buckets: int) -> None:
    """Rows in place of all that stands in the buckets of the touched objects."""
    keep = rows.withColumn("bucket", _bucket(object_of_version_pk(F.col("version_pk")), buckets))
    hit = [r.bucket for r in touched.select(_bucket(F.col("object_pk"), buckets).alias("bucket")).distinct().collect()]  # as many as there are buckets
    staged = materialize(keep.where(F.col("bucket").isin(hit)), "index-stage")
    # one file a bucket; an overwrite of partitions leaves those alone that get no rows, so they are removed
    left = {r.bucket for r in staged.select("bucket").distinct().collect()}
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)
    for b in set(hit) - left:
        remove(spark, f"{at}/bucket={b}")


def after_persist(index: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows (version_pk, sk, is_latest, ...) once new ones are in: new versions stand as they come, is_latest; other
    versions of their objects stay and are no longer latest; all else stays."""
    versions = new.select("version_pk").distinct()
    objects = versions.select(object_of_version_pk(F.col("version_pk")).alias("__object"), F.lit(True).alias("__hit")).distinct()
    old = index.join(versions, "version_pk", "left_anti").withColumn("__object", object_of_version_pk(F.col("version_pk"))).join(objects, "__object", "left")
    demoted = old.withColumn("is_latest", F.col("is_latest") & F.col("__hit").isNull()).drop("__object", "__hit")
    return demoted.unionByName(new.withColumn("is_latest", F.lit(True)).select(index.columns))


def _touched(rows: DataFrame) -> DataFrame:
    return rows.select(object_of_version_pk(F.col("version_pk")).alias("object_pk")).distinct()


def persist_index(spark: SparkSession, at: str, new: DataFrame, buckets: int = BUCKETS) -> None:
    """New index rows into folder at; earlier versions of their objects are demoted."""
    touched = materialize(_touched(new), "index-touched")
    standing = read_index(spark, at, new)
    near = standing.join(F.broadcast(touched.select(_bucket(F.col("object_pk"), buckets).alias("b")).distinct()), _bucket(object_of_version_pk(F.col("version_pk")), buckets) == F.col("b"), "left_semi")
    _replace(spark, at, after_persist(near, new), touched, buckets)


def rollback_index(spark: SparkSession, at: str, new: DataFrame, previous: DataFrame, buckets: int = BUCKETS) -> None:
    """Take new index rows out again and put the previous ones of their objects back as they were loaded."""
    touched = materialize(_touched(new.select("version_pk").unionByName(previous.select("version_pk"))), "index-touched")
    standing = read_index(spark, at, new)
    rest = standing.join(new.select("version_pk").unionByName(previous.select("version_pk")).distinct(), "version_pk", "left_anti")
    _replace(spark, at, rest.unionByName(previous.select(rest.columns)), touched, buckets)


def previous_versions(index: DataFrame, state: DataFrame, profiles: DataFrame, marks: DataFrame) -> DataFrame:
    """(version_pk): versions whose artifacts may go: superseded ones of objects whose current version is complete in every
    written profile, and those of deleted objects. Nothing goes while the current version is still being written."""
    old = superseded(index.select("version_pk").distinct(), state)
    current = state.where(~F.col("is_deleted")).select("object_pk", F.concat("object_pk", F.lit("#"), "latest_version_id").alias("version_pk"))
    done = complete_versions(current.select("version_pk"), profiles, marks).where("complete").join(current, "version_pk").select("object_pk")
    free = done.unionByName(state.where("is_deleted").select("object_pk")).distinct()
    return old.withColumn("object_pk", object_of_version_pk(F.col("version_pk"))).join(free, "object_pk", "left_semi").select("version_pk")


def delete_versions(spark: SparkSession, at: str, versions: DataFrame, like: DataFrame, buckets: int = BUCKETS) -> None:
    """Take all index rows of versions out of folder at."""
    touched = materialize(_touched(versions), "index-touched")
    _replace(spark, at, read_index(spark, at, like).join(versions.select("version_pk").distinct(), "version_pk", "left_anti"), touched, buckets)


def refresh_latest(index: DataFrame, state: DataFrame) -> DataFrame:
    """Index rows with is_latest as the state has it."""
    return flag_latest(index, state)


def without_keys(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Vectors (profile_id, key, ...) but for those named by keys (profile_id, key)."""
    return vectors.join(keys.select("profile_id", "key").distinct(), ["profile_id", "key"], "left_anti")


def put_vectors(rows: DataFrame, at: str, size: int = VECTORS) -> None:
    """Append vectors (profile_id, ...) to folder at, by profile, at most size in a file."""
    rows.write.mode("append").option("maxRecordsPerFile", size).partitionBy("profile_id").parquet(at)


def dispatch_jobs(jobs: DataFrame, size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Valid jobs (job_id, profile_id, ...) with batch_no, at most size in a batch of a profile, and what is wrong with the others
    (job_id, violation)."""
    wrong = job_violations(jobs)
    valid = jobs.join(wrong.select("job_id").distinct(), "job_id", "left_anti")
    return batches(valid, "profile_id", ["job_id"], size), wrong
