"""Places in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import kept


def ranked(df: DataFrame, group: list[str], order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """df with n (rows of its group) and at (its place there by order, from 0), and the table of groups with their n.

    Rows are range-partitioned by group and order, and kept so; each counts within its partition, and what the partitions before it hold
    of its group is added. The largest task is a range, also where one group holds all rows. Rows that tie keep some order."""
    placed = kept(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # as many rows as there are partitions and groups: a partition holds a stretch of the order
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = kept(runs.select("*", before.alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias("n")))
    groups = runs.select(*group, "n").distinct()
    own = runs.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__{g}") for g in group], "__first", "__before", "n")
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return placed.join(own, on).select(*df.columns, "n", (F.col("__before") + F.col("__at") - F.col("__first")).alias("at")), groups
