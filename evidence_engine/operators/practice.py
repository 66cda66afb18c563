"""Practice candidates, cram lists, mock papers, and matching of results and views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import kept
from .mastery import latest_judgement, mastery


def matched_results(requests: DataFrame, results: DataFrame, *, missing: int) -> DataFrame:
    """requests (id, name) with the value v of the result of the same id, or else, among results without an id, of the same name."""
    by_id = results.where(F.col("id") != missing).select("id", F.col("v").alias("by_id"))
    by_name = results.where(F.col("id") == missing).groupBy("name").agg(F.max("v").alias("by_name"))
    out = requests.join(by_id, "id", "left").join(by_name, "name", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return out.select("id", "name", F.coalesce("by_id", "by_name").alias("v"), how.alias("by"))


def unattempted_first(items: DataFrame, attempted: DataFrame, key: str, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first k items of each group, those without an attempt first."""
    d = items.join(attempted.select(key, F.lit(1).alias("__tried")), key, "left").withColumn("attempted", F.coalesce("__tried", F.lit(0)))
    return d.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("attempted", *order))).where(F.col("position") <= k).drop("__tried")


def view_drift(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stored, current (structs) of the rows that differ or stand on one side only."""
    side = lambda df, n: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(n))
    both = side(stored, "stored").join(side(current, "current"), keys, "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("current")))


def candidates(items: DataFrame, events: DataFrame, *, attempted: Column, blockers: list[int], waived: list[int], pending: str, n: int, mode: str = "normal", green_share: float = 0.15) -> DataFrame:
    """The n items one learner should practise next, with the evidence for each.

    Red types first, then blocker types without an attempt, then items not yet attempted; green types take at most
    green_share of n; pending items and waived types never come. Mode ``red`` keeps red types only and may be empty.
    """
    red = latest_judgement(events).where(F.col("judgement").isin("WRONG", "BLANK")).select("item_type", F.lit(1).alias("is_red"))
    green = mastery(events, ["learner", "item_type"]).where("colour = 'green'").select("item_type", F.lit(1).alias("is_green"))
    seen = events.select("item_type").distinct().withColumn("seen", F.lit(1))
    own = items.where((F.col("ocr") != pending) & ~F.col("item_type").isin(*waived)).withColumn("attempted", attempted.cast("int"))
    for side in (red, green, seen):
        own = own.join(side, "item_type", "left")
    own = own.na.fill(0, ["is_red", "is_green"]).withColumn("untested", (F.col("item_type").isin(*blockers) & F.col("seen").isNull()).cast("int"))
    if mode == "red":
        own = own.where("is_red = 1")
    points = F.coalesce("score", F.lit(0.0))
    first = [F.desc("is_red"), F.desc("untested")]
    last = [F.asc("attempted"), points.desc(), F.asc("anchor"), F.asc("tie")]
    # each side needs its first rows only, so both are top-k sorts, and one window over at most 2 n rows numbers them
    greens = own.where("is_green = 1").orderBy(*first, *last).limit(math.floor(green_share * n))
    both = own.where("is_green = 0").orderBy(*first, *last).limit(n).unionByName(greens)
    return both.withColumn("position", F.row_number().over(Window.orderBy(*first, F.asc("is_green"), *last))).where(F.col("position") <= n)


def cram_list(events: DataFrame, starters: DataFrame, *, k: int) -> DataFrame:
    """The k most frequent types that have past errors, with their starter or a placeholder."""
    n = events.groupBy("item_type").agg(F.count("*").alias("n"), F.count_if(F.col("judgement").isin("WRONG", "BLANK")).alias("errors")).where("errors > 0")
    top = n.join(starters, "item_type", "left").withColumn("starter", F.coalesce("starter", F.lit("pending"))).orderBy(F.desc("n"), "item_type").limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "item_type")))


def starter_list(events: DataFrame, starters: DataFrame) -> DataFrame:
    """item_type, colour, starter (or a placeholder) of the red and yellow types."""
    own = mastery(events, ["item_type"]).where("colour IN ('red', 'yellow')").select("item_type", "colour")
    return own.join(starters, "item_type", "left").select("item_type", "colour", F.coalesce("starter", F.lit("pending")).alias("starter"))


def top_causes(errors: DataFrame, cause: str, *, k: int) -> DataFrame:
    """The k causes with most errors, ties by name."""
    n = errors.groupBy(F.col(cause).alias("cause")).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "cause").limit(k)
    return n.withColumn("position", F.row_number().over(Window.orderBy(F.desc("errors"), "cause")))


#: Groups that each form's items are dealt to before its first ones are taken.
SALTS = 64


def mock_paper(items: DataFrame, template: DataFrame) -> DataFrame:
    """Items not of the template's paper, as many of each form as it has.

    Forms are few and may hold any share of the items, so each group of a form's items gives its first ones, up to the largest
    quota (the size of one paper at most), and the final order runs over those. The template is one paper, kept."""
    template = kept(template.select("form", "paper"))
    quota = template.groupBy("form").agg(F.count("*").alias("quota"))
    most = quota.agg(F.max("quota")).first()[0] or 0
    own = items.join(template.select("paper").distinct(), "paper", "left_anti").withColumn("__salt", F.pmod(F.xxhash64("anchor", "tie"), F.lit(SALTS)))
    order = ["anchor", "tie"]
    some = own.withColumn("__k", F.row_number().over(Window.partitionBy("form", "__salt").orderBy(*order))).where(F.col("__k") <= most).drop("__k", "__salt")
    d = some.withColumn("position", F.row_number().over(Window.partitionBy("form").orderBy(*order)))
    return d.join(quota, "form").where(F.col("position") <= F.col("quota"))
