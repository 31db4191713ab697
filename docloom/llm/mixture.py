"""Mixing sources to target shares of tokens.

Every record gets a random key from its identity. Within its source, keys are cut into equal ranges (they are uniform, so
the ranges hold equally many records, however large the source), token counts are summed by range, and the prefix sums
of ranges and of records within them give each record its place on its source's line of tokens. The source's budget
cuts that line exactly, once an epoch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.io import materialize

#: Vocabulary file of a public tokenizer; its path is a parameter, as is the pattern by which it parts words.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Records of a key range, about.
RANGE = 20_000
SEED = 20


@lru_cache(2)
def _encoder(path: str, pattern: str | None):
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # the package that holds the vocabulary files
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of each row; null texts have none. pattern: how the tokenizer parts words, that of the package of
    the vocabulary files if none is given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, tokens long")


def source_key(col: Column) -> Column:
    """One name for the ways of writing a source: its letters and digits in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]", "")), F.lit(""))


def plan_budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(key, source, target_share, max_repeats, available, budget): tokens that each source is to give.

    sizes: (key, available). Without total, the mixture is as large as it can be with every source that has records at
    its share: the least over these of available x max_repeats / share. A source without records, or without a share,
    gives nothing; with a total that is too large, a source gives all that it may.
    """
    rows = targets.select(source_key(F.col("source")).alias("key"), "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    rows = rows.join(sizes, "key", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    most = (F.col("available") * F.col("max_repeats")).cast("double")
    if total is None:
        reach = F.min(F.when((F.col("target_share") > 0) & (F.col("available") > 0), most / F.col("target_share"))).over(Window.partitionBy())
    else:
        reach = F.lit(float(total))
    wanted = F.coalesce(F.floor(reach * F.col("target_share") + F.lit(1e-6)), F.lit(0))
    return rows.withColumn("budget", F.least(wanted, F.col("available") * F.col("max_repeats")).cast("long"))


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture, (doc_id, source, epoch, tokens), one row each time a record is used, and its report.

    The report has a row for each target: (source, target_share, max_repeats, available_tokens, records, tokens,
    share, planned_share). share is of all tokens of the mixture, null if it has none. A record whose last token would pass the budget is
    left out, so a source falls short of its budget by less than one record. Records of sources that are no target,
    and empty records, are not used; a doc_id that stands in several rows counts in each.
    """
    counted = token_counts(documents, vocabulary, pattern).withColumn("key", source_key(F.col("source"))).where("key is not null and tokens > 0")
    rows = materialize(counted.withColumn("at", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "tokens"), 1)), "mixture-tokens")
    stats = rows.groupBy("key").agg(F.sum("tokens").alias("available"), F.count("*").alias("n"))
    budgets = plan_budgets(stats.select("key", "available"), targets, total)
    plan = budgets.join(stats.select("key", "n"), "key", "left")
    plan = materialize(plan.withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(float(2**63)) / F.ceil(F.coalesce("n", F.lit(1)) / RANGE)).cast("long"))), "mixture-plan")

    # the plan has a row for each target: as many as sources are named
    used = rows.select("doc_id", "key", "tokens", "at").join(plan.where("budget > 0").select("key", "budget", "available", "width"), "key")
    placed = used.withColumn("range", F.floor(F.col("at") / F.col("width")))
    sums = placed.groupBy("key", "range").agg(F.sum("tokens").alias("s"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("key", "range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "range").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    lines = placed.withColumn("upto", F.sum("tokens").over(inside)).join(base, ["key", "range"])
    end = F.col("before") + F.col("upto")
    # epoch e of a record ends at e x available + end on its source's line
    epochs = F.floor((F.col("budget") - end) / F.col("available")) + 1
    taken = lines.withColumn("epochs", epochs).where("epochs > 0")
    mixed = taken.select("doc_id", "key", "tokens", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("epoch"))
    names = plan.select("key", "source")
    mixed = materialize(mixed.join(names, "key").select("doc_id", "source", "epoch", "tokens"), "mixture")

    given = mixed.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("given"))
    every = Window.partitionBy()
    zero = F.lit(0).cast("long")
    part = lambda a, b: F.round(F.try_divide(a, F.nullif(b, zero)), 6)
    report = plan.join(given, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"),
        F.coalesce("records", zero).alias("records"), F.coalesce("given", zero).alias("tokens"),
        part(F.coalesce("given", zero), F.sum("given").over(every)).alias("share"),
        part(F.col("budget"), F.sum("budget").over(every)).alias("planned_share"),
    )
    return mixed, report
