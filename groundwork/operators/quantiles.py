"""Exact quantiles, and distributions, of columns of any size: by mergeable sketches and counts that narrow what is left."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.sources.shared import stored

#: Parts of the sketch of each pass, its accuracy, and distinct values that are counted out in the end.
PARTS, ACCURACY, DISTINCT = 256, 10_000, 10_000


def exact_quantiles(rows: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = (), distinct: int = DISTINCT) -> DataFrame:
    """by..., probability, value: exact quantiles of the numbers of a column, interpolated between neighbours in order.

    Each pass takes a sketch of the values that are left for a group and a probability, whose size does not depend on
    them, and keeps those between the two parts about the wanted place; what lies below is counted. With few distinct
    values left, they are counted one by one. So no task holds a group's values, however many there are: a pass leaves
    about a hundredth of them. Nulls and NaN are left out; a group without a number has no row. Groups may be null.
    """
    names = [f"_g{i}" for i in range(len(by))]
    value = F.col(f"`{column}`").cast("double")
    values = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)], value.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not names:
        values, names = values.withColumn("_g0", F.lit(0)), ["_g0"]
    values = stored(values)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    totals = values.groupBy(*names).agg(F.count("*").alias("_n")).filter("_n > 0")
    place = F.col("_p") * (F.col("_n") - 1)
    state = totals.withColumn("_p", F.explode(wanted)).withColumns({"_first": F.floor(place), "_share": place - F.floor(place), "_low": F.lit(float("-inf")), "_high": F.lit(float("inf"))})
    state = stored(state)
    keys = [*names, "_p"]

    def left(now: DataFrame) -> DataFrame:
        """The values between the bounds of each group and probability; values below are known by their count alone."""
        hit = reduce(lambda x, y: x & y, [values[n].eqNullSafe(now[n]) for n in names])
        return values.join(now, hit).select(*[now[c] for c in now.columns], "_v")

    def below(now: DataFrame) -> DataFrame:
        return left(now).groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"))

    while True:
        inside = left(state).filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        sketch = inside.groupBy(*keys).agg(F.approx_count_distinct("_v").alias("_d"), F.count("*").alias("_m"), F.percentile_approx("_v", [k / PARTS for k in range(PARTS + 1)], ACCURACY).alias("_grid"))
        met = stored(_keyed(state, sketch, keys, "left"))
        if met.filter((F.col("_d") > distinct) & (F.col("_low") < F.col("_high"))).isEmpty():
            break
        known = _keyed(met, below(state), keys, "inner")
        # The grid's parts about the wanted places, one more on either side for the sketch's own error.
        at = (F.col("_first") - F.col("_below")) / F.col("_m") * PARTS
        part = lambda k: F.element_at("_grid", (F.least(F.greatest(k, F.lit(0)), F.lit(PARTS)) + 1).cast("int"))
        narrow = F.col("_d") > distinct
        low = F.when(narrow, F.greatest(F.col("_low"), part(F.floor(at) - 1))).otherwise(F.col("_low"))
        high = F.when(narrow, F.least(F.col("_high"), part(F.ceil(at + PARTS / F.col("_m")) + 1))).otherwise(F.col("_high"))
        state = stored(known.select(*names, "_p", "_n", "_first", "_share", low.alias("_low"), high.alias("_high"), ((low > F.col("_low")) | (high < F.col("_high"))).alias("_moved")))
        if state.filter("_moved").isEmpty():
            break
    each = left(state).filter(F.col("_v").between(F.col("_low"), F.col("_high"))).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    each = _keyed(_keyed(each, below(state), keys, "inner"), state.select(*keys, "_first", "_share"), keys, "inner")
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    ranked = each.withColumn("_upto", upto)
    pick = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    told = ranked.groupBy(*keys, "_first", "_share").agg(pick(F.col("_first")).alias("_a"), pick(F.col("_first") + 1).alias("_b"))
    exact = F.when((F.col("_share") == 0) | F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share"))
    return told.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=False)], F.col("_p").alias("probability"), exact.alias("value"))


def _keyed(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """a joined with the other columns of b on keys that may be null."""
    named = b.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in b.columns if c not in keys])
    hit = reduce(lambda x, y: x & y, [a[k].eqNullSafe(named[f"_r{k}"]) for k in keys])
    return a.join(named, hit, how).drop(*[f"_r{k}" for k in keys])


def histogram(rows: DataFrame, column: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """by..., bin, low, high, n, density: counts in bins of one width from the least to the greatest value of each group.

    The densities times the widths of a group's bins make 1. The greatest value falls in the last bin; where all values
    are equal there is one bin, of width 0, without a density. Empty bins have no row; nulls and NaN are left out.
    """
    names = [f"_g{i}" for i in range(len(by))]
    values = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)], F.col(f"`{column}`").cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not names:
        values, names = values.withColumn("_g0", F.lit(0)), ["_g0"]
    range_ = values.groupBy(*names).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    width = (F.col("_high") - F.col("_low")) / bins
    met = _keyed(values, range_, names, "inner").withColumn("_w", width)
    bin_ = F.when(F.col("_w") == 0, 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_low")) / F.col("_w")), F.lit(bins - 1))).cast("int")
    counted = met.groupBy(*names, bin_.alias("bin"), "_low", "_w", "_n").agg(F.count("*").alias("n"))
    low = F.col("_low") + F.col("bin") * F.col("_w")
    density = F.when(F.col("_w") > 0, F.col("n") / (F.col("_n") * F.col("_w")))
    return counted.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=False)], "bin", low.alias("low"), (low + F.col("_w")).alias("high"), "n", density.alias("density"))
