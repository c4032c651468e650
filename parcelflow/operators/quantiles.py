"""Exact quantiles whose groups may be of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Parts that the values of one group fall into, of equal width on a logarithmic scale.
PARTS = 1024


def quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], parts: int = PARTS) -> DataFrame:
    """(keys, one column for each of ``wanted``): the quantile of a number by group, interpolated; nulls don't count.

    The group's buffer of the built-in aggregate has each of its different values.
    Here each (group, value) is counted first; the counts are summed
    up by parts of the group's range, which say in which part the two values
    around the quantile lie; and only those parts are ranked. So a hot group
    is dealt out by its values, and no task has more of it than a part. A
    group whose values are all null gets null; without ``keys`` there is
    one row. Equal columns are counted once, however many quantiles are taken of them.
    """
    names = list(wanted)
    columns: dict[str, int] = {}
    which = {n: columns.setdefault(str(wanted[n][0]._jc.toString()), len(columns)) for n in names}
    value_of = {which[n]: wanted[n][0].cast("double") for n in names}
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("w"), v.alias("v")) for i, v in value_of.items()))).alias("_x")
    # What is counted is read four times and made once.
    known = stored(df.select(*keys, each).groupBy(*keys, F.col("_x.w").alias("_w"), F.nanvl("_x.v", F.lit(None).cast("double")).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    counted = known.where("_v is not null")
    group = [*keys, "_w"]
    # Both grow with the value, so a part's values lie between those of the parts around it.
    scaled = F.signum("_v") * F.log1p(F.abs("_v"))
    ends = counted.groupBy(*group).agg(F.min(scaled).alias("_low"), F.max(scaled).alias("_high"), F.sum("_n").alias("_total"))
    part = F.least(F.lit(parts - 1), F.floor((scaled - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * parts))
    parted = counted.join(_safe(ends, group), _same(group)).select(*group, "_v", "_n", "_total", F.coalesce(part, F.lit(0)).cast("long").alias("_part"))
    sums = parted.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"), F.max("_total").alias("_total"))
    sums = sums.withColumn("_before", F.sum("_size").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"))
    # The two places, from 0, that each quantile lies between.
    at = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    places = F.flatten(F.array(*(F.array(F.struct(F.lit(n).alias("name"), F.floor(at(wanted[n][1])).alias("place")), F.struct(F.lit(n).alias("name"), F.ceil(at(wanted[n][1])).alias("place"))) for n in names)))
    mine = F.create_map(*(x for n in names for x in (F.lit(n), F.lit(which[n]))))
    targets = sums.select(*group, "_part", "_before", "_size", F.explode(places).alias("_t")).where((mine[F.col("_t.name")] == F.col("_w")) & F.col("_t.place").between(F.col("_before"), F.col("_before") + F.col("_size") - 1))
    wanted_parts = targets.groupBy(*group, "_part").agg(F.max("_before").alias("_before"), F.collect_set("_t.place").alias("_places"))
    inside = parted.join(_safe(wanted_parts, [*group, "_part"]), _same([*group, "_part"])).select(*group, "_part", "_v", "_n", "_total", "_before", "_places")
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    ranked = inside.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    hit = ranked.where(F.exists("_places", lambda p: p.between(F.col("_first"), F.col("_last"))))

    def pick(name: str) -> Column:
        mine = F.col("_w") == which[name]
        place = at(wanted[name][1])
        held = lambda p: F.max(F.when(mine & p.between(F.col("_first"), F.col("_last")), F.col("_v")))
        low, high = held(F.floor(place)), held(F.ceil(place))
        share = F.max(F.when(mine, place - F.floor(place)))
        return (low + (high - low) * share).alias(name)

    picked = hit.groupBy(*keys).agg(*map(pick, names))
    if not keys:
        return picked
    return known.select(*keys).distinct().join(_safe(picked, keys), _same(keys), "left").select(*keys, *names)


def _safe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with its keys under names of their own, for a join in which null keys are equal."""
    return df.withColumnsRenamed({k: f"_{k}_r" for k in keys})


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}_r"))
    return out
