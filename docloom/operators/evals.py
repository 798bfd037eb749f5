"""Sessions and evals: turns, orders, windows, outcomes, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def turns(events: DataFrame, session: str, order: str, is_prompt: Column) -> DataFrame:
    """events with ``turn_no``: the prompts of the session so far."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn_no", F.sum(is_prompt.cast("int")).over(w))


def last_turn(events: DataFrame, session: str, order: str, is_prompt: Column) -> DataFrame:
    """Events from each session's last prompt on; none if nothing follows it."""
    at = events.groupBy(session).agg(F.max(F.when(is_prompt, F.col(order))).alias("at"), F.max(order).alias("end")).where(F.col("end") > F.col("at"))
    return events.join(at, session).where(F.col(order) >= F.col("at")).drop("at", "end")


def tool_order(events: DataFrame, session: str, order: str, kind: str, first: str, then: str) -> DataFrame:
    """(session, pass): the first event of one kind comes before the last of another; neither of them is in order, one alone isn't."""
    g = events.groupBy(session).agg(F.min(F.when(F.col(kind) == first, F.col(order))).alias("a"), F.max(F.when(F.col(kind) == then, F.col(order))).alias("b"))
    return g.select(session, F.coalesce(F.col("a") < F.col("b"), F.col("a").isNull() & F.col("b").isNull()).alias("pass"))


def intervals(events: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    """Islands of equal consecutive states: (key, state, opened, closed, n); closed is null for the last."""
    w = Window.partitionBy(*key).orderBy(order)
    e = events.withColumn("new", (~F.col(state).eqNullSafe(F.lag(state).over(w))) | F.lag(order).over(w).isNull())
    e = e.withColumn("island", F.sum(F.col("new").cast("int")).over(w))
    g = e.groupBy(*key, "island", state).agg(F.min(order).alias("opened"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("closed", F.lead("opened").over(Window.partitionBy(*key).orderBy("island"))).drop("island")


def classify(expected: Column, actual: Column) -> Column:
    """How an outcome compares with its label."""
    return (
        F.when(actual.isin("error", "skipped"), actual)
        .when((actual == "review") & (expected == "review"), "agree")
        .when(actual == "review", "review")
        .when(expected == "review", "missed-review")
        .when(actual == expected, "agree")
        .when(actual == "pass", "false-pass")
        .otherwise("false-fail")
    )


def calibration(cases: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row of (expected, actual) booleans over judged cases: agreement, errors, whether it certifies."""
    judged = F.col("actual").isNotNull()
    n, agree = F.count_if(judged), F.count_if(judged & (F.col("expected") == F.col("actual")))
    rate = F.when(n == 0, 0.0).otherwise(F.round(agree / n, 6))
    both = (F.count_if(judged & F.col("expected")) > 0) & (F.count_if(judged & ~F.col("expected")) > 0)
    return cases.agg(n.alias("judged"), rate.alias("agreement"), F.count_if(judged & F.col("expected") & ~F.col("actual")).alias("false_fail"), F.count_if(judged & ~F.col("expected") & F.col("actual")).alias("false_pass"), both.alias("balanced"), ((rate >= threshold) & (F.count_if(~judged) == 0)).alias("certified"))


def pass_rate(results: DataFrame, by: str) -> DataFrame:
    """(by, graded, passed, rate) of (by, outcome, weight): the weighted share of passes, 1 if none was graded."""
    graded = F.col("outcome").isin("pass", "fail")
    w, p = F.sum(F.when(graded, F.col("weight"))), F.sum(F.when(F.col("outcome") == "pass", F.col("weight")))
    return results.groupBy(by).agg(F.count_if(graded).alias("graded"), F.count_if(F.col("outcome") == "pass").alias("passed"), F.coalesce(F.round(F.coalesce(p, F.lit(0.0)) / w, 6), F.lit(1.0)).alias("rate"))


def newest(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= n)
