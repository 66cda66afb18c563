"""Ranked views and presentation scalars over profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .trends import GROWTH, METHOD


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def trend_order() -> list[Column]:
    return [F.asc("trend_priority"), F.desc(F.abs("delta")), F.desc(zero("r_rate")), F.desc(zero("r_total")), F.asc("entity")]


def importance_order() -> list[Column]:
    return [F.asc("role_priority"), F.asc("trend_priority"), F.desc(zero("r_rate")), F.desc(zero("r_total")), F.asc("entity")]


def ranking(profiles: DataFrame, *, by: str = "importance", keys: tuple[str, ...] = ("paper_type",)) -> DataFrame:
    """profiles with rank within keys, by importance or trend; by ranges, since a few paper types hold all entities."""
    d, _ = ranked(profiles, list(keys), importance_order() if by == "importance" else trend_order())
    return d.select(*profiles.columns, (F.col("at") + 1).cast("int").alias("rank"))


def leading(profiles: DataFrame, k: int, *, by: str = "importance", keys: tuple[str, ...] = ("paper_type",)) -> DataFrame:
    """The first k of each of keys with their rank. Each task keeps k rows of a key before any are shuffled."""
    order = importance_order() if by == "importance" else trend_order()
    return profiles.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def focus(profiles: DataFrame, *, k: int = 3) -> DataFrame:
    """The k most important entities of each paper type."""
    return leading(profiles, k)


def alerts(profiles: DataFrame, *, per_class: int = 8) -> DataFrame:
    """The first entities of each paper type and alert class: growth, method, cooling. An entity may stand in two."""
    classes = F.filter(
        F.array(
            F.when(F.col("trend").isin(*GROWTH), "growth"),
            F.when(F.arrays_overlap("secondary", F.array(*map(F.lit, METHOD))), "method"),
            F.when(F.col("trend") == "COOL", "cooling"),
        ),
        lambda c: c.isNotNull(),
    )
    found = profiles.withColumn("alert", F.explode(classes))
    return leading(found, per_class, by="trend", keys=("paper_type", "alert"))


def low_signals(profiles: DataFrame) -> DataFrame:
    """Entities of low roles, or cooling, by importance."""
    return ranking(profiles.where(F.col("role").isin("LOWRISK", "LOWWATCH", "NONE") | (F.col("trend") == "COOL")))


def trend_appendix(profiles: DataFrame) -> DataFrame:
    """All entities in trend order with their trends as text and the years they were met in, before and now."""
    d = ranking(profiles, by="trend").withColumn("text", trend_text())
    return d.withColumn("before", F.concat_ws("/", "h_hits", "h_years")).withColumn("now", F.concat_ws("/", "r_hits", "r_years"))


def paper_evidence(facts: DataFrame, unknown: str) -> DataFrame:
    """What each paper holds: items, those with a score and with a form, and its themes."""
    return facts.groupBy("paper").agg(
        F.min("paper_type").alias("paper_type"), F.min("year").alias("year"), F.count("*").alias("items"), F.count("score").alias("scored"),
        F.count_if(F.col("form") != unknown).alias("forms"), F.array_join(F.array_sort(F.collect_set("theme")), ", ").alias("themes"),
    )


def chart_series(profiles: DataFrame) -> DataFrame:
    """Percentages for a chart per entity, with the score axis of its paper type: at least 10, five above the largest."""
    tops = profiles.groupBy("paper_type").agg(F.greatest(F.lit(10.0), F.round(F.max(zero("r_total")) + 5)).cast("long").alias("axis_max"))
    d = profiles.select("entity", "paper_type", percent(zero("h_rate")).alias("historical"), percent(zero("r_rate")).alias("recent"), percent(F.col("delta")).alias("change"), zero("r_total").alias("score"))
    return d.join(tops, "paper_type")


def percent(c: Column) -> Column:
    """Half-up percent; null stays null."""
    return F.round(c * 100).cast("int")


def rate_text(c: Column) -> Column:
    return F.coalesce(F.concat(percent(c).cast("string"), F.lit("%")), F.lit("—"))


def delta_text(c: Column) -> Column:
    return F.coalesce(F.concat(F.format_string("%+d", percent(c)), F.lit("pp")), F.lit("—"))


def number_text(c: Column) -> Column:
    """Up to four decimals without trailing zeros."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), "—").otherwise(text)


def coverage_text(hits: Column, years: Column, rate: Column) -> Column:
    return F.concat(hits.cast("string"), F.lit("/"), years.cast("string"), F.lit("("), rate_text(rate), F.lit(")"))


def distribution_text(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One text per key: names with percent, highest share first, then by name."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col(name).alias("n"))))
    text = F.array_join(F.transform(order, lambda x: F.concat_ws(" ", x["n"], rate_text(-x["s"]))), "; ")
    return values.groupBy(*keys).agg(text.alias("distribution"))


def trend_text() -> Column:
    return F.concat_ws(" · ", F.col("trend"), F.col("secondary"))
