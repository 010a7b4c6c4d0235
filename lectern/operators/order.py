"""Places in an order, and the neighbours of points in time, with no task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import cut_lineage


def in_ranges(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows, written, with ``_part`` and ``_at``: ranges of the order, and the place in it over all ranges."""
    placed = cut_lineage(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    )
    return placed.withColumn("_part", F.shiftright("_at", 33))


def ranked_in_order(
    rows: DataFrame, key: str, order: Sequence[str | Column], total: str = "n", name: str = "rank"
) -> DataFrame:
    """Add the gapless place of each row among those of its ``key`` by ``order``, from 0, and their number ``total``.

    Rows are cut into ranges of key and order, so a key may fill many tasks; only counts of ranges meet by key. Rows
    equal in ``order`` come in any order. ``key`` must not be null. The ordered rows are written.
    """
    placed = in_ranges(rows, [key, *order])
    ranges = placed.groupBy(key, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.select(
        key,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_shift"),
        F.sum("_rows").over(whole).alias(total),
    )
    return placed.join(shift, [key, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def around(probes: DataFrame, events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``query_id, previous_id, next_id``: the events before and after each probe's time ``at``, among those of its keys.

    The previous one is the last that ended before that time, the lower id on ties; the next one starts first among
    those that have not ended, again the lower id on ties. Events without an end count for nothing, probes without a
    time have no neighbours. Probes and events lie in one order of time, cut into ranges. Within a range both are running
    extremes from either end; what a range hands on to the ranges behind and before it is one extreme a key.
    """
    asked = probes.select(
        *keys, F.col("at").alias("t"), F.lit(0).alias("kind"), "query_id",
        F.lit(None).cast(dict(events.dtypes)["start_date"]).alias("start_date"),
        F.lit(None).cast(dict(events.dtypes)["event_id"]).alias("event_id"),
    )
    known = events.filter("end_date is not null").select(
        *keys, F.col("end_date").alias("t"), F.lit(1).alias("kind"),
        F.lit(None).cast(dict(probes.dtypes)["query_id"]).alias("query_id"), "start_date", "event_id",
    )
    # A probe lies before the events that end at its time: those have not ended before it.
    placed = in_ranges(asked.filter("t is not null").unionByName(known), [*keys, "t", "kind", "query_id", "event_id"])
    ended = F.when(F.col("kind") == 1, F.struct("t", (-F.col("event_id")).alias("id")))
    coming = F.when(F.col("kind") == 1, F.struct("start_date", F.col("event_id").alias("id")))
    inside = Window.partitionBy("_part", *keys)
    before = inside.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    after = inside.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("_ended", F.max(ended).over(before)).withColumn("_coming", F.min(coming).over(after))
    # One row a range and key.
    ranges = placed.groupBy("_part", *keys).agg(F.max(ended).alias("_e"), F.min(coming).alias("_c"))
    all_before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_after = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(
        "_part", *keys, F.max("_e").over(all_before).alias("_before"), F.min("_c").over(all_after).alias("_after")
    )
    found = near.filter("kind = 0").join(carried, ["_part", *keys]).select(
        "query_id", (-F.greatest("_ended", "_before")["id"]).alias("previous_id"), F.least("_coming", "_after")["id"].alias("next_id")
    )
    return probes.select("query_id").join(found, "query_id", "left") if not keys else found
