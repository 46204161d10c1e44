"""Balanced batches by number: keyed permutations choose groups and images, nothing is sorted or exploded for a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch.functions.storage import written

ROUNDS = 32


def keyed(*parts: Column | str) -> Column:
    """60 bits of the hash of ``parts``, as a number from 0."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``x`` in a permutation of 0..n-1 that depends on ``key``; null if ``n`` is below 1.

    Swap or not: in each round x and its mirror image (shift - x modulo n) change places or stay, as a bit keyed by the greater of
    both says. Each round is a permutation for any n, so nothing is drawn twice and no number has to be drawn again.
    """
    some = F.nullif(F.greatest(n, F.lit(0)).cast("long"), F.lit(0))
    shifts = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.struct(r.alias("r"), F.pmod(keyed(*key, r), some).alias("by")))

    def swap(at: Column, s: Column) -> Column:
        mirror = F.pmod(s["by"] - at, some)
        return F.when(keyed(*key, s["r"], F.greatest(at, mirror)) % 2 == 1, mirror).otherwise(at)

    return F.when(some.isNotNull(), F.aggregate(shifts, x.cast("long"), swap))


def numbered(rows: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``no``, 0, 1, ... by ``order`` in each group of ``within`` (in all rows, if that is empty).

    Rows are dealt by ranges of both, so a group of any size is spread over tasks; numbers come from counts of ranges.
    """
    keys = [*within, *order]
    held = written(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    ends = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(*within, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ends), F.lit(0)))
    inside = Window.partitionBy(*within, "_part").orderBy(*order)
    return held.join(sizes, [*within, "_part"]).withColumn("no", F.col("_before") + F.row_number().over(inside) - 1).drop("_part", "_n", "_before")


def sampled_batches(manifest: DataFrame, classes: int, per_class: int, steps: int, seed: str = "batch") -> DataFrame:
    """``manifest(group_id, image_id)`` -> ``(step, group_id, image_id, slot)``: in each step ``classes`` groups, ``per_class`` images of each.

    Neither repeats within a step: a step's groups, and a group's images, are the first places of a permutation keyed by step and group.
    A group with too few images gives all of them in turn; with fewer groups than ``classes`` all are taken. Rows without a group
    or image are left out, further columns too, a repeated row is an image of its own, and an empty manifest gives no batches.
    The manifest is numbered once; after that the work is that of steps x classes x images, whatever the sizes of the groups.
    """
    if min(classes, per_class, steps) < 1:
        raise ValueError("classes, per_class and steps must be 1 or more")
    known = manifest.select("group_id", "image_id").where("group_id is not null and image_id is not null")
    images = written(numbered(known, ["group_id"], ["image_id"], "batch-ranges"), "batch-images")
    groups = written(numbered(images.groupBy("group_id").agg(F.count("*").alias("n")), [], ["group_id"], "batch-group-ranges"), "batch-groups")
    n_groups = groups.count()
    taken = min(classes, n_groups)
    spark, key = manifest.sparkSession, F.lit(seed)
    draws = spark.range(steps * taken).select(F.floor(F.col("id") / max(1, taken)).cast("int").alias("step"), (F.col("id") % max(1, taken)).alias("place"))
    chosen = draws.withColumn("no", permuted(F.col("place"), F.lit(n_groups), key, F.col("step"))).join(groups, "no").select("step", "group_id", "n")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(per_class).cast("long"), F.col("n")) - 1))
    picks = chosen.withColumn("at", first).withColumn("no", permuted(F.col("at"), F.col("n"), key, F.col("step"), F.col("group_id").cast("string")))
    slots = F.explode(F.sequence(F.col("at").cast("int"), F.lit(per_class - 1), F.least(F.col("n"), F.lit(per_class)).cast("int")))
    return picks.join(images, ["group_id", "no"]).select("step", "group_id", "image_id", slots.alias("slot"))
