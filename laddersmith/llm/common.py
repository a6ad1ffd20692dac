"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.operators.graph import components
from laddersmith.session import discard, materialize, parallelism, ship

__all__ = ["by_group", "components", "discard", "fold", "materialize", "parallelism", "read", "ship"]


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """A table of ``sf_dir``, cut to ``cols``, with the package shipped to the executors."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def fold(col: str, n: int):
    """crc32 of the id's text modulo ``n``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def by_group(df: DataFrame, key: str, fn: Callable[[int, pa.Table], pa.Table | None], schema: str, order: list[str] | None = None, parts: int | None = None, task: Column | None = None) -> DataFrame:
    """Rows of each value of the long column ``key`` through ``fn``, one whole group at a time.

    Groups must be bounded by construction: callers split hot ones first. Unlike
    applyInArrow this has no cost per group on the JVM side. ``task`` (an int below ``parts`` that the key determines) deals
    groups to tasks; without it their hash does.
    """
    out_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = fn(last, pa.Table.from_batches(held))
                if out is not None and out.num_rows:
                    yield from out.cast(out_schema).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(k)], strict=True):
                if held and k[s] != last:
                    yield from flush()
                    held = []
                last = int(k[s])
                held.append(b.slice(s, e - s))
        yield from flush()

    n = parts or parallelism(df.sparkSession)
    dealt = df.repartition(n, key) if task is None else df.repartitionById(n, task)
    return dealt.sortWithinPartitions(key, *(order or [])).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
