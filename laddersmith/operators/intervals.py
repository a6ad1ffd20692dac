"""Dense histories out of changes, without a grid of entities and times.

A change holds until the next one, so a history is a set of validity intervals (entity, from, until, value). Entities are numbered and cut into
blocks of columns, times into stretches; each interval goes to the stretches that it touches, and a block's stretch streams its intervals and
its times in order and gives one array of values for each time. Nothing is as large as entities times times but the arrays themselves, which are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laddersmith.operators.order import numbered
from laddersmith.session import materialize, parallelism, ship

#: Entities of a block of columns, and times of a stretch.
WIDTH, STRETCH = 256, 4096
#: Entities standing for others, at most, whose values at a time are one array.
STANDS = 4096
#: Where rows without a time stand (behind all others), and the place before all times.
_LAST, _FIRST = 2**63 - 1, -(2**63)


def _us() -> Column:
    return F.coalesce(F.unix_micros("ts"), F.lit(_LAST)).alias("us")


def changes(history: DataFrame, key: str) -> DataFrame:
    """(key, us, value) of ``history`` (ts, key, rating[, game_id]): of rows at one time that of the last game counts; NaN is no value."""
    last = F.max_by("rating", F.struct("game_id", "rating")) if "game_id" in history.columns else F.max("rating")
    rows = history.groupBy(key, _us()).agg(last.alias("value"))
    return rows.withColumn("value", F.expr("nullif(value, double('NaN'))"))


def intervals(marks: DataFrame, key: str) -> DataFrame:
    """(key, us, until, value): each change with the time of the next one, null where none follows."""
    return marks.withColumn("until", F.lead("us").over(Window.partitionBy(key).orderBy("us")))


def filled(marks: DataFrame, key: str, members: DataFrame | None = None, default: float | None = None, width: int | None = None, stretch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every entity's value at every time: ((us, block, at, ratings), (block, slot, key)).

    ``marks`` as of changes(). The times are those of the marks. ``members`` (key) are the entities, by default those that have marks; they stand in order, in blocks of ``width``,
    and have ``default`` until their first mark."""
    spark = marks.sparkSession
    ship(spark)
    width, stretch = width or WIDTH, stretch or STRETCH
    marks = materialize(marks.select(key, "us", "value"), "filled-marks")
    members = (marks if members is None else members).select(key).where(F.col(key).isNotNull()).distinct()
    slots = numbered(members, F.col(key)).select(key, F.expr(f"cast((pos - 1) div {width} as int)").alias("block"), F.expr(f"cast((pos - 1) % {width} as int)").alias("slot"))
    slots = materialize(slots, "filled-slots")
    times = materialize(numbered(marks.select("us").distinct(), F.col("us")).select("us", (F.col("pos") - 1).alias("at")), "filled-times")
    n_times, n_blocks = times.count(), (slots.agg(F.max("block")).first()[0] or 0) + 1
    if default is not None:
        marks = marks.unionByName(members.select(key, F.lit(_FIRST).alias("us"), F.lit(default).alias("value")))
    held = intervals(marks.where(F.col(key).isNotNull()), key).join(slots, key).select("block", "slot", "us", "until", "value")
    # what stands before all times begins with the first of them
    held = held.join(times, "us", "left").join(times.select(F.col("us").alias("until"), F.col("at").alias("end")), "until", "left")
    held = held.select("block", "slot", "value", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("end", F.lit(n_times)).alias("end")).where("end > at")
    held = held.withColumn("stretch", F.explode(F.expr(f"sequence(at div {stretch}, (end - 1) div {stretch})")))
    held = held.select("block", "stretch", F.greatest("at", F.col("stretch") * stretch).alias("at"), F.lit(None).cast("long").alias("us"), "slot", "value")
    ticks = times.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.expr(f"at div {stretch}").alias("stretch"), "at", "us", F.lit(width).alias("slot"), F.lit(None).cast("double").alias("value"))
    n = parallelism(spark)
    # a time's tick stands behind its changes
    rows = held.unionByName(ticks).repartitionById(n, F.pmod(F.xxhash64("block", "stretch"), F.lit(n)).cast("int")).sortWithinPartitions("block", "stretch", "at", "slot")

    def run(batches):
        key_, now = None, None
        for b in batches:
            block, part, at, us, slot = (b.column(c).to_pylist() for c in ("block", "stretch", "at", "us", "slot"))
            value = b.column("value").to_numpy(zero_copy_only=False)
            out = []
            for i, s in enumerate(slot):
                if (block[i], part[i]) != key_:
                    key_, now = (block[i], part[i]), np.full(width, np.nan)
                if s < width:
                    now[s] = value[i]
                else:
                    out.append((us[i], block[i], at[i], now.copy()))
            if out:
                u, k, a, v = zip(*out, strict=True)
                flat = np.concatenate(v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * width, pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(k, pa.int32()), pa.array(a, pa.int64()), lists], names=["us", "block", "at", "ratings"])

    done = rows.mapInArrow(run, "us long, block int, at long, ratings array<double>")
    # the last block may have fewer columns
    size = slots.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return done.join(size, "block").select("us", "block", "at", F.slice("ratings", F.lit(1), F.col("size")).alias("ratings")), slots


def filled_for(marks: DataFrame, members: DataFrame, key: str, shown: Column, width: int | None = None, most: int | None = None) -> DataFrame:
    """(us, block, at, ratings) of all ``members`` (stand, key), by the ``marks`` of those who stand for them; ``shown`` says of an array ``ratings`` what is shown of it.

    The stands are filled, and shown, once; a block's columns are places in their array. Where they are more than ``most``, every member is filled by itself."""
    n = members.select("stand").distinct().count()
    if n > (most or STANDS):
        own = marks.withColumnRenamed(key, "stand").join(members, "stand").select(key, "us", "value")
        return filled(own, key, width=width)[0].select("us", "block", "at", shown)
    blocks, slots = filled(marks, key, width=max(n, 1))
    width = width or WIDTH
    places = numbered(members.join(slots.select(F.col(key).alias("stand"), (F.col("slot") + 1).alias("place")), "stand"), F.col(key))
    places = places.select(F.expr(f"cast((pos - 1) div {width} as int)").alias("block"), F.col("pos"), "place").groupBy("block")
    places = materialize(places.agg(F.array_sort(F.collect_list(F.struct("pos", "place"))).alias("x")).select("block", F.transform("x", lambda y: y["place"]).alias("places")), "filled-places")
    # a row for each time, written out so that reading it is no part of dealing the blocks
    one = materialize(blocks.select("us", "at", shown).repartition(parallelism(marks.sparkSession)), "filled-stands")
    return one.crossJoin(places).select("us", "block", "at", F.transform("places", lambda k: F.element_at("ratings", k)).alias("ratings"))


def time_of(us: str = "us") -> Column:
    return F.when(F.col(us) < _LAST, F.timestamp_micros(us))


def long(blocks: DataFrame, slots: DataFrame, key: str, value: str = "rating") -> DataFrame:
    """(ts, key, value): a row for each entity and time."""
    flat = blocks.select(time_of().alias("ts"), "block", F.posexplode("ratings").alias("slot", value))
    return flat.join(slots, ["block", "slot"]).select("ts", key, value)


def lists(blocks: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """(key, ratings): each entity's values at all times, in order of time, rounded to hundredths."""
    flat = blocks.select("at", "block", F.posexplode("ratings").alias("slot", "rating"))
    rows = flat.groupBy("block", "slot").agg(F.array_sort(F.collect_list(F.struct("at", F.round("rating", 2).alias("rating")))).alias("r"))
    return rows.join(slots, ["block", "slot"]).select(key, F.transform("r", lambda x: x["rating"]).alias("ratings"))


def group_changes(marks: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """(group, us, value): the mean of a group's members after each change of one of them; null where none has a value.

    ``members`` (group, key) may say as how many each counts, n. Each change is a difference to its groups' sums and numbers, and these run on over time: neither entities times times nor a join of ranges arises."""
    w = Window.partitionBy(key).orderBy("us")
    before = F.lag("value").over(w)
    steps = marks.select(key, "us", (F.coalesce("value", F.lit(0.0)) - F.coalesce(before, F.lit(0.0))).alias("step"), (F.col("value").isNotNull().cast("int") - before.isNotNull().cast("int")).alias("more"))
    members = members.select(group, key, (F.col("n") if "n" in members.columns else F.lit(1)).alias("n")).distinct()
    sums = steps.join(members, key).groupBy(group, "us").agg(F.sum(F.col("step") * F.col("n")).alias("step"), F.sum(F.col("more") * F.col("n")).alias("more"))
    w = Window.partitionBy(group).orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("more").over(w)
    return sums.select(group, "us", F.when(n > 0, F.sum("step").over(w) / n).alias("value"))


def wide_lines(blocks: DataFrame, slots: DataFrame, key: str, time_text) -> DataFrame:
    """(block, at, line): the wide history as lines of text, a file for each block of columns: a header (at -1), then a line for each time in order."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    head = slots.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", F.col(key).cast("string").alias("name")))).alias("names"))
    head = head.select("block", F.lit(-1).cast("long").alias("at"), F.concat_ws(",", F.lit("Time"), F.transform("names", lambda x: quoted(x["name"]))).alias("line"))
    cells = F.transform("ratings", lambda x: F.coalesce(x.cast("string"), F.lit("")))
    body = blocks.select("block", "at", F.concat_ws(",", F.coalesce(time_text(time_of()), F.lit("")), F.array_join(cells, ",")).alias("line"))
    return head.unionByName(body)
