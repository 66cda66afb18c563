"""Items found in dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_type(role: Column, text: Column, keywords: dict[str, list[str]], excluded: list[str]) -> Column:
    """question, doubt, misconception or explanation by words of the text, in the order given; skipped for phrases of progress."""
    low = F.lower(text)
    any_of = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: low.contains(w))
    out = F.when(any_of(excluded), "skipped")
    for name, found in keywords.items():
        who = "assistant" if name in ("misconception", "explanation") else "user"
        out = out.when((role == who) & any_of(found), name)
    return out.otherwise("other")


def last_question(turns: DataFrame) -> DataFrame:
    """turns with question_turn: the nearest user turn before, within the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("question_turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w))


def dialogue_items(turns: DataFrame, keywords: dict[str, list[str]], excluded: list[str]) -> DataFrame:
    """turns with kind and question_turn; an explanation without a question before it is skipped."""
    d = last_question(turns).withColumn("kind", turn_type(F.col("role"), F.col("text"), keywords, excluded))
    return d.withColumn("kind", F.when((F.col("kind") == "explanation") & F.col("question_turn").isNull(), "skipped").otherwise(F.col("kind")))
