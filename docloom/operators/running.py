"""Running numbers, sums and maxima over long groups without one task for each group.

Rows are range-partitioned by key and order, so that a group of any size is spread over tasks; each range is a block.
Blocks are summed up, the sums of earlier blocks of the same key (at most as many as there are ranges) are added up, and
the rest is a window within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.io import materialize

BLOCK = "__block"


def in_blocks(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number of the range that each row lies in. Written once, for ranges may fall otherwise when made again."""
    spread = df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return materialize(spread, name)


def before(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """rows of in_blocks with, for each name, the sum or max of a column over all earlier rows of the same keys.

    values: name to (column, "sum" or "max"); null where no earlier row has a value. Rows with a null key are left out.
    """
    total = {"sum": F.sum, "max": F.max}
    sums = rows.groupBy(*keys, BLOCK).agg(*[total[how](c).alias(n) for n, (c, how) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, BLOCK, *[total[how](n).over(earlier).alias(f"__{n}") for n, (_, how) in values.items()])
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({n: total[how](c).over(inside) for n, (c, how) in values.items()})
    both = own.join(base, [*keys, BLOCK])
    add = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest}
    return both.withColumns({n: add[how](F.col(n), F.col(f"__{n}")) for n, (_, how) in values.items()}).drop(*[f"__{n}" for n in values])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, name: str) -> DataFrame:
    """df with the place, from 1, of each row among those of the same keys."""
    rows = in_blocks(df, keys, order, name)
    return before(rows, keys, order, {out: (F.lit(1), "sum")}).withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("int") + 1).drop(BLOCK)
