"""Mastery, error statistics and hypotheses from attempts and learning events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RED = ("WRONG", "BLANK")
SLOW = ("STUCK", "SLOW")


def latest_judgement(attempts: DataFrame) -> DataFrame:
    """learner, item_type, judgement of the last attempt."""
    return attempts.groupBy("learner", "item_type").agg(F.max_by("judgement", F.struct("ts", "event_id")).alias("judgement"))


def colour(a: Column, b: Column) -> Column:
    """The colour that a key's last attempt and the one before (null if there is none) give: red if the last is wrong or blank; green if both are right
    on different days; yellow otherwise."""
    twice = (a["judgement"] == "OK") & (b["judgement"] == "OK") & (F.to_date(a["ts"]) != F.to_date(b["ts"]))
    return F.when(a["judgement"].isin(*RED), "red").when(F.coalesce(twice, F.lit(False)), "green").otherwise("yellow")


def mastery(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, colour, attempts: red if the last attempt is wrong or blank; green if the last two are right on different
    days; yellow otherwise. Keys without an attempt are untouched and have no row."""
    # what decides is the last two attempts: a group keeps two structs, not its history
    at = F.struct("ts", "event_id", "judgement")
    order = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    last = attempts.withColumn("back", F.row_number().over(order)).where("back <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("back") == 1, at)).alias("a"), F.max(F.when(F.col("back") == 2, at)).alias("b")
    )
    n = attempts.groupBy(*keys).agg(F.count("*").alias("attempts"))
    return last.join(n, keys).select(*keys, colour(F.col("a"), F.col("b")).alias("colour"), "attempts")


def error_stats(attempts: DataFrame, causes: str, *by: str, small: int = 30) -> DataFrame:
    """Errors by cause overall and by each column of by, with the share and a flag for few errors."""
    rows = attempts.where(F.col("judgement").isin(*RED, *SLOW)).withColumn("cause", F.col(causes))
    out = rows.groupingSets([["cause"], *[["cause", b] for b in by]], "cause", *by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return out.withColumn("few", F.col("n") < small)


def hypotheses(events: DataFrame, *, least: int = 2) -> DataFrame:
    """learner, hypothesis, times, evidence (ids in order), latest_probe, confidence of those that come up repeatedly."""
    at = F.struct("ts", "event_id")
    g = events.where("hypothesis IS NOT NULL").groupBy("learner", "hypothesis").agg(
        F.count("*").alias("times"), F.transform(F.array_sort(F.collect_list(at)), lambda x: x["event_id"]).alias("evidence"),
        F.max_by("probe", at).alias("latest_probe"), F.max_by("confidence", at).alias("confidence"),
    )
    return g.where(F.col("times") >= least)


def stubborn(attempts: DataFrame, blockers: DataFrame, cause: str = "CONCEPT") -> DataFrame:
    """item_type in the blocker ledger and among attempts of that cause."""
    return attempts.where(F.col("cause") == cause).select("item_type").distinct().join(blockers, "item_type", "left_semi")


def untested(blockers: DataFrame, attempts: DataFrame) -> DataFrame:
    return blockers.select("item_type").distinct().join(attempts, "item_type", "left_anti")


def cause_actions(cause: Column, plan: dict[str, list[str]]) -> Column:
    """The actions that a wrong cause calls for, in the plan's order; none for a cause that it doesn't have."""
    rows = [x for k, v in plan.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.try_element_at(F.create_map(*rows), cause), F.array().cast("array<string>"))
