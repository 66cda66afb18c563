"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import kept

#: The white space of all word and line rules: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and lost executors cost no recomputation."""
    return kept(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Texts without wider characters take the quick built-in; for others, one replacement per
    letter is far quicker than translate, which looks up every character."""
    wide = c
    for x in UPPER:
        wide = F.replace(wide, F.lit(x), F.lit(x.lower()))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(wide)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), "")


def chunks(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about most characters; a longer text is a range of its own."""
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
