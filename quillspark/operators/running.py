"""Running sums over keys of any size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def running_sums(df: DataFrame, key: str, order, **sums) -> DataFrame:
    """Add the sum of a column over the rows before each row of its key, in ``order``.

    ``sums`` names result and column; sums are 0 on the first row. The rows are
    dealt out in ranges of (key, order), so a key fills as many partitions as it
    needs; a window sums inside each, over its part of a key, and the totals of the
    parts before are added: one row per key and partition.
    """
    order = [order] if isinstance(order, str) else list(order)
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kept = settle(dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    inside = Window.partitionBy(key, "_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy(key, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    carried = totals.select(
        F.col(key).alias("_key"), F.col("_part").alias("_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    local = kept.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
