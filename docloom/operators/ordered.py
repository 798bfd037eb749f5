"""Joins along an order: each row with the last one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.lineage import cut


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, how: str = "left", within: object = None, strict: bool = False) -> DataFrame:
    """left with the columns of the last row of right that has the same ``by`` and an ``at`` that isn't later.

    ``strict`` asks for an earlier one; ``within`` (a number, or an interval literal as text) bounds how much earlier it may
    be; how "inner" drops rows without one. Of right rows at one time the greatest by their other columns counts. Null keys
    and times meet nothing. Columns of right but ``by`` get the prefix ``right_`` where left has their name.

    Both sides are sorted together by key and time into ranges, so that one key may fill many of them; within a range the
    last right row is carried down, and from range to range only the last one of the keys that cross their borders.
    """
    k, others = [f"by {i}" for i in range(len(by))], [c for c in right.columns if c not in by]
    named = {c: f"right_{c}" if c in left.columns else c for c in others}
    value = F.struct(F.col(f"`{at}`").alias("when"), *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(others)))
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)))
    key = [F.col(f"`{c}`").alias(n) for c, n in zip(by, k, strict=True)]
    usable = F.col(f"`{at}`").isNotNull()
    for c in by:
        usable &= F.col(f"`{c}`").isNotNull()
    r = right.where(usable).groupBy(*key, F.col(f"`{at}`").alias("at")).agg(F.max(value).alias("found"))
    first, second = (0, 1) if not strict else (1, 0)  # of one time, which side comes first
    l = left.where(usable).select(*key, F.col(f"`{at}`").alias("at"), F.lit(second).alias("side"), whole.alias("row"), F.lit(None).cast(r.schema["found"].dataType).alias("found"))
    both = l.unionByName(r.select(*k, "at", F.lit(first).alias("side"), F.lit(None).cast(l.schema["row"].dataType).alias("row"), "found"))
    both = both.repartitionByRange(*k, "at", "side").withColumn("part", F.spark_partition_id())
    both = cut(both)  # the ranges are fixed from here on
    w = Window.partitionBy("part", *k).orderBy("at", "side")
    last = F.last("found", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy("part").agg(F.min(F.struct(*k)).alias("lo"), F.max(F.struct(*k)).alias("hi"))
    ends = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key")).groupBy("key").count().where("count > 1").select("key.*")  # a few for each part
    carry = both.join(F.broadcast(ends), k).where("found is not null").groupBy("part", *k).agg(F.max_by("found", "at").alias("found"))
    parts = both.join(F.broadcast(ends), k).select("part", *k).distinct().join(carry, ["part", *k], "left")
    before = F.last("found", ignorenulls=True).over(Window.partitionBy(*k).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", *k, before.alias("before"))
    d = both.withColumn("found", last).where("row is not null").join(F.broadcast(parts), ["part", *k], "left")
    d = d.select("row", "at", F.coalesce("found", "before").alias("found"))
    if within is not None:
        least = F.col("at") - (F.expr(within) if isinstance(within, str) else F.lit(within))
        d = d.withColumn("found", F.when(F.col("found.when") >= least, F.col("found")))
    out = d.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(left.columns)), F.col("found").isNotNull().alias("met"), *(F.col(f"found.v{i}").alias(named[c]) for i, c in enumerate(others)))
    if how == "inner":
        return out.where("met").drop("met")
    rest = left.where(~usable).select(*(F.col(f"`{c}`") for c in left.columns), *(F.lit(None).cast(right.schema[c].dataType).alias(named[c]) for c in others))
    return out.drop("met").unionByName(rest)
