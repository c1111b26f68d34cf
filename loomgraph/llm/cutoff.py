"""Per-group score cutoffs that keep a target share (problem 6).

One pass over the raw records sketches every group: a mergeable quantile sketch whose rank error is
guaranteed (a rank is off by at most one in ``ACCURACY``), read at a fixed grid of ranks. The two grid
values around the wanted rank, one cell wider on either side, bracket the cutoff. A second pass counts
what lies above the bracket and counts equal scores inside it; only these are sorted, in a sort that is
spread over partitions whatever the size of a group. Counts prove the bracket: a group whose cutoff
were not inside would be sorted whole instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut, running_counts

#: Ranks are read at this many even steps; the sketch errs by less than a quarter of a step.
GRID = 256
ACCURACY = 4 * GRID


def needed(keep: Column, total: Column) -> Column:
    """The fewest records that are at least ``keep`` percent of ``total`` (one at least), without rounding errors."""
    return F.greatest(F.ceil(keep.cast("decimal(12,6)") * total.cast("decimal(20,0)") * F.expr("cast(0.01 as decimal(3,2))")).cast("bigint"), F.lit(1).cast("bigint"))


def brackets(usable: DataFrame, keep: DataFrame) -> DataFrame:
    """(g, need, total, lo, hi) of (g, x) records: the cutoff lies within lo..hi; groups no score can satisfy have no row."""
    grid = [i / GRID for i in range(GRID + 1)]
    y = F.col("x").cast("double")
    sketch = usable.groupBy("g").agg(F.count(F.lit(1)).alias("total"), F.min(y).alias("least"), F.max(y).alias("most"), F.percentile_approx(y, grid, ACCURACY).alias("q"))
    need = sketch.join(keep, "g").withColumn("need", needed(F.col("keep"), F.col("total"))).where("need <= total")
    place = (F.col("total") - F.col("need") + 1) / F.col("total") * GRID  # ascending rank of the cutoff on the grid
    below, above = F.floor(place).cast("int") - 1, F.ceil(place).cast("int") + 1
    return need.select(
        "g", "need", "total",
        F.when(below <= 0, F.col("least")).otherwise(F.get("q", F.greatest(below, F.lit(0)))).alias("lo"),
        F.when(above >= GRID, F.col("most")).otherwise(F.get("q", F.least(above, F.lit(GRID)))).alias("hi"),
    )


def bracketed(usable: DataFrame, bounds: DataFrame) -> DataFrame:
    """(g, need, total, x, n): equal scores inside the bracket with their counts, and all above it as one row without score."""
    y = F.col("x").cast("double")
    inside = usable.join(bounds, "g").where(y >= F.col("lo"))
    return inside.groupBy("g", "need", "total", F.when(y <= F.col("hi"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def _chosen(values: DataFrame) -> DataFrame:
    """(g, cutoff, n_kept, n_all) from counted scores; groups whose cutoff does not lie among them have no row."""
    ranked = running_counts(values, ["g"], [F.col("x").desc_nulls_first()], F.col("n"), name="cutoffs")
    first = ranked.where("_upto >= need").groupBy("g").agg(F.min_by(F.struct("x", "total"), "_upto").alias("c"), F.min("_upto").alias("n_kept"))
    return first.where("c.x is not null").select("g", F.col("c.x").alias("cutoff"), "n_kept", F.col("c.total").alias("n_all"))


def cutoffs(scores: DataFrame, keep: DataFrame, group: str, score: str) -> DataFrame:
    """(group, cutoff, n_kept, n_all): the largest occurring score c with 100·(scores ≥ c) ≥ keep·(all).

    ``scores``: (group, score), one row per record, of any numeric type; rows with a null group or a
    null or not-a-number score are ignored. ``keep``: (group, keep) percentages (six decimals count),
    one row per group; a group missing there gives no row. A ``keep`` of 0 or less keeps the largest
    score and its ties; a ``keep`` over 100 is met by no score and gives no row.
    """
    x = F.col(score)
    known = x.isNotNull() & ~F.isnan(x.cast("double"))
    usable = scores.where(F.col(group).isNotNull() & known).select(F.col(group).alias("g"), x.alias("x"))
    bounds = cut(brackets(usable, keep.select(F.col(group).alias("g"), "keep").where("g is not null and keep is not null")), "brackets")
    found = cut(_chosen(cut(bracketed(usable, bounds), "bracketed")), "cutoffs")
    lost = bounds.join(found.select("g"), "g", "left_anti")
    if not lost.isEmpty():  # no sketch within its guarantee leaves one
        whole = lost.select("g", "need", "total", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
        found = found.union(_chosen(cut(bracketed(usable, whole), "bracketed")))
    return found.withColumnRenamed("g", group)
