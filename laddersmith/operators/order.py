"""Running numbers over a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laddersmith.session import materialize, parallelism


def numbered(df: DataFrame, *order: Column, name: str = "pos", weight: Column | None = None, weights: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with 1, 2, ... in ``order`` (or with running sums of ``weight``, or of several ``weights`` by name): rows are dealt by ranges, summed within each, and moved on by the sums before.

    The only window over everything has a row for each range.
    """
    weights = weights or {name: F.lit(1) if weight is None else weight}
    parts = df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    parts = materialize(parts, "numbered")
    counts = parts.groupBy("_range").agg(*[F.sum(w).alias(f"_n_{c}") for c, w in weights.items()])
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *[F.coalesce(F.sum(f"_n_{c}").over(past), F.lit(0)).alias(f"_before_{c}") for c in weights])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = parts.select("*", *[F.sum(w).over(own).alias(f"_own_{c}") for c, w in weights.items()]).join(F.broadcast(offsets), "_range")
    sums = {c: F.col(f"_own_{c}") + F.col(f"_before_{c}") for c in weights}
    return running.select(*[c for c in df.columns if c not in weights], *[x.alias(c) for c, x in sums.items()])
