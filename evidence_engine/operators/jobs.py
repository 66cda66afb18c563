"""Chunk jobs: failure classes, next actions, reports, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_class(code: Column, message: Column, codes: dict[str, list[int]], markers: dict[str, list[str]]) -> Column:
    """resplit, permanent, retry or unknown: by code first, then by words of the message."""
    out = None
    for name, values in codes.items():
        hit = code.isin(*values)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    text = F.lower(F.coalesce(message, F.lit("")))
    for name, found in markers.items():
        for word in found:
            out = out.when(text.contains(word), name)
    return out.otherwise("unknown")


def next_action(kind: Column, pages: Column, attempts: Column, retry_limit: int = 2) -> Column:
    return F.when((kind == "resplit") & (pages > 1), "resplit").when(kind.isin("retry", "unknown") & (attempts < retry_limit), "retry").otherwise("final-failed")


def failure_report(jobs: DataFrame, *keys: str, threshold: float = 0.2) -> DataFrame:
    """keys, failed, total, ratio, recommendation."""
    d = jobs.groupBy(*keys).agg(F.count_if("failed").alias("failed"), F.count("*").alias("total"))
    ratio = F.round(F.col("failed") / F.col("total"), 4)
    return d.withColumn("ratio", ratio).withColumn("recommendation", F.when(F.col("ratio") > threshold, "rerun").otherwise("accept"))


def progress(snapshots: DataFrame, *keys: str) -> DataFrame:
    """keys, completed, distinct pages reviewed, blockers (rows: done, pages array, n_blockers)."""
    sums = snapshots.groupBy(*keys).agg(F.count_if("done").alias("completed"), F.sum("n_blockers").alias("blockers"))
    # pages are told apart by rows, not in one array of a key
    pages = snapshots.select(*keys, F.explode("pages").alias("page")).distinct().groupBy(*keys).agg(F.count("*").cast("int").alias("pages"))
    return sums.join(pages, list(keys), "left").select(*keys, "completed", F.coalesce("pages", F.lit(0)).alias("pages"), "blockers")


def page_ranges(docs: DataFrame, units: Column, size: int) -> DataFrame:
    """docs with first and last of each range of at most size units."""
    d = docs.withColumn("__n", units).where("__n > 0").withColumn("first", F.explode(F.sequence(F.lit(1), F.col("__n"), F.lit(size))))
    return d.withColumn("last", F.least(F.col("first") + size - 1, F.col("__n"))).drop("__n")


def parse_range(spec: Column, total: Column) -> Column:
    """``a-b`` or ``a`` within 1 to total as (first, last), or null."""
    ok = spec.rlike(r"^\s*\d+\s*(-\s*\d+\s*)?$")
    first = F.regexp_extract(spec, r"(\d+)", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(spec, r"-\s*(\d+)", 1).try_cast("int"), first)
    return F.when(ok & (first >= 1) & (last >= first) & (last <= total), F.struct(first.alias("first"), last.alias("last")))


def bounded_ranges(units: DataFrame, *, max_units: int, max_bytes: int, key: str = "doc_id") -> DataFrame:
    """key, first, last, bytes, ok: ranges of units (key, unit from 1, bytes) of at most max_units, bisected while
    they hold more than max_bytes; a single unit beyond it comes with ok false.

    The ranges of all documents are halved together: log2(max_units) rounds at most, each over prefix sums kept per document.
    """
    running = F.sum("bytes").over(Window.partitionBy(key).orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    totals = units.select(key, "unit", running.alias("c")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("unit", "c"))).alias("u"))
    d = totals.select(key, F.concat(F.array(F.lit(0).cast("long")), F.transform("u", lambda x: x["c"])).alias("sums"))
    first = F.sequence(F.lit(1), F.size("sums") - 1, F.lit(max_units))
    ranges = F.transform(first, lambda a: F.struct(a.alias("first"), F.least(a + max_units - 1, F.size("sums") - 1).alias("last")))
    d = d.where(F.size("sums") > 1).withColumn("ranges", ranges)
    size = lambda r: F.get("sums", r["last"]) - F.get("sums", r["first"] - 1)

    def halved(r: Column) -> Column:
        middle = F.floor((r["first"] + r["last"]) / 2).cast("int")
        both = F.array(F.struct(r["first"].alias("first"), middle.alias("last")), F.struct((middle + 1).alias("first"), r["last"].alias("last")))
        return F.when((size(r) > max_bytes) & (r["last"] > r["first"]), both).otherwise(F.array(F.struct(r["first"].alias("first"), r["last"].alias("last"))))

    for _ in range(max(0, max_units - 1).bit_length()):
        d = d.withColumn("ranges", F.flatten(F.transform("ranges", halved)))
    d = d.withColumn("r", F.explode("ranges"))
    return d.select(key, "r.first", "r.last", size(F.col("r")).alias("bytes"), (size(F.col("r")) <= max_bytes).alias("ok"))
