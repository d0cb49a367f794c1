"""Exact quantiles without a buffer of all values: distributed selection.

A quantile is one or two order statistics.  Each lies in a bracket of values, at first the group's whole range.  A pass counts the values of every
bracket in ``width`` ranges of equal size (counts are combined where rows lie), finds the range that holds the
rank and makes it the bracket, with the least and the greatest value found in it.  When a bracket holds one value, or at most
``settle`` rows, those few are ranked.  A task never holds more than ``width`` counts of a bracket or ``settle`` rows,
whatever the group; ranges shrink by ``width`` a pass, so passes are few, and ties end them at once.

Between two order statistics the quantile is interpolated.  Defined cases: nulls don't count; a group of nulls alone has
null quantiles; NaN is the greatest value; infinities are values; null keys are a group; an empty table gives no group, or
one row of nulls where there are no keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.jobs import kept

_INF = float("inf")


def _bin(width: int):
    """The range of a value in its bracket: rises with the value; halves keep the difference of large values finite."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    open_ = F.isnan(hi) | (hi == _INF) | (lo == -_INF)
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return (
        F.when(F.isnan(v), width + 2).when(v == _INF, width + 1).when(v == -_INF, -1)
        .when(open_, 0).otherwise(F.least(F.floor(share * width), F.lit(width - 1))).cast("int")
    )


def quantiles(rows: DataFrame, value: str, wanted: dict[str, float], *by: str, width: int = 4096, settle: int = 20_000) -> DataFrame:
    """``(*by, *wanted)``: the quantiles ``{name: share}`` of a numeric column per group, or of all rows."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))  # structs match on nulls too
    base = kept(rows.select(key.alias("key"), F.col(value).cast("double").alias("v")), "values")
    there = base.where("v is not null")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in wanted.items()]))
    stats = there.groupBy("key").agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = kept(stats.select("*", asked.alias("a")).withColumn("at", F.col("a.q") * (F.col("inside") - 1)).select("key", "lo", "hi", "inside", "a.name", "at", F.floor("at").alias("first"), F.ceil("at").alias("second")), "places")
    targets = places.select("key", "lo", "hi", F.lit(0).cast("long").alias("below"), "inside", F.explode(F.array_distinct(F.array("first", "second"))).alias("rank")).distinct()
    targets = kept(targets, "targets")
    while True:
        wide = (F.col("inside") > settle) & (F.col("lo") < F.col("hi"))
        if targets.where(wide).isEmpty():
            break
        brackets = targets.where(wide).select("key", "lo", "hi").distinct()
        counts = there.join(brackets, "key").where("v >= lo and v <= hi").groupBy("key", "lo", "hi", _bin(width).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy("key", "lo", "hi").orderBy("bin"))  # at most a bracket's ranges
        counts = counts.withColumn("upto", upto)
        found = targets.where(wide).join(counts, ["key", "lo", "hi"]).where("rank >= below + upto - n and rank < below + upto")
        found = found.select("key", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"), "rank")
        targets = kept(targets.where(~wide).unionByName(found), "targets")
    few = targets.where("lo < hi")
    order = Window.partitionBy("key", "rank").orderBy("v")  # at most ``settle`` rows
    ranked = there.join(few, "key").where("v >= lo and v <= hi").withColumn("k", F.row_number().over(order) - 1).where("below + k = rank")
    one = targets.where("not lo < hi").select("key", "rank", F.col("lo").alias("x")).unionByName(ranked.select("key", "rank", F.col("v").alias("x")))
    sides = places.join(one.select("key", F.col("rank").alias("first"), F.col("x").alias("x")), ["key", "first"]).join(one.select("key", F.col("rank").alias("second"), F.col("x").alias("y")), ["key", "second"])
    between = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.col("second") - F.col("at")) * F.col("x") + (F.col("at") - F.col("first")) * F.col("y"))
    told = sides.select("key", "name", between.alias("value")).groupBy("key").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])
    groups = base.select("key").distinct() if by else base.sparkSession.range(1).select(key.alias("key"))
    return groups.join(told, "key", "left").select(*[F.col(f"key.{b}").alias(b) for b in by], *wanted)
