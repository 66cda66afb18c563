"""Quality rules over whole texts as a short-circuit cascade, by DataFrame operations alone.

Every document gets the base measures. The remaining rules form one CASE expression, whose branches Spark evaluates
in order until one holds. The order comes from a sample, drawn by hash from all documents: a rule's cost is the mean work that it states (characters
that it scans; one for a comparison of numbers that are there), its selectivity its rejection rate among the sampled
documents that the rules before it leave. The rule with most rejections per cost comes next; among rules that reject none, the
cheaper one. Counted work gives one order for one table, where clock times gave another on each run. The order changes
only the work, never the verdict.

Defined cases: null and blank texts have no words, so they fail the base rule ``n_words < 10``; very long texts are judged whole;
repeated rows are judged one by one; a null doc_id is kept as it is; rules that tie keep the order given; an empty table keeps it too and
gives no rows; all columns of docs, whatever their names, come back in one struct. Windows of words are compared by 64 bits of hash within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, words

#: Documents, at most, that the cost and selectivity estimates read.
SAMPLE_ROWS = 2_000
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

#: A rule is a name, a condition that rejects, over the columns text, words and the base measures, and its work.
Rule = tuple[str, Callable[[], Column], Callable[[], Column]]


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of that many words which the text holds twice or more."""
    ahead = range(1, window)
    every = let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda s: F.transform(s, lambda x, i: F.xxhash64(x, *[F.get(s, i + k) for k in ahead])),
    )
    hashes = F.slice(every, F.lit(1), F.greatest(F.lit(0), F.size(w) - window + 1))

    def repeated(sorted_windows: Column) -> Column:
        at = lambda k: F.get(sorted_windows, k)
        here = lambda k: (at(k)["h"] == at(k - 1)["h"]) | (at(k)["h"] == at(k + 1)["h"])
        ks = F.sequence(F.lit(0), F.size(sorted_windows) - 1)
        return F.array_sort(F.transform(F.filter(ks, here), lambda k: at(k)["i"]))

    def covered(found: Column) -> Column:
        gaps = F.transform(found, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(found, k + 1) - s, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, repeated), covered))

    return let(hashes, count)


def with_base_measures(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The columns row (all of docs), text, words, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"))
    rows = rows.select("row", "text", words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = rows.select(
        "row", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _one() -> Column:
    return F.lit(1)


def _characters() -> Column:
    return F.length("text")


#: Rejecting rules beyond the base. A clean prose document is far from each of these limits.
RULES: list[Rule] = [
    ("symbols", lambda: 5 * F.col("n_symbols") > F.col("n_words"), _one),
    ("duplicate_lines", lambda: 2 * F.col("n_dup_lines") > F.size("lines"), _one),
    ("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), _one),
    ("shouting", lambda: 2 * F.regexp_count("text", F.lit(r"\p{Lu}")) > F.col("word_chars"), _characters),
    ("exclamations", lambda: 5 * F.regexp_count("text", F.lit("!")) > F.col("n_words"), _characters),
    ("few_letters", lambda: 2 * F.regexp_count("text", F.lit(r"\p{L}+")) < F.col("n_words"), _characters),
]


def sampled(docs: DataFrame, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """sample_rows documents at most, the ones with the smallest hashes of their text."""
    share = min(1.0, 2 * sample_rows / max(1, docs.count()))
    by = F.xxhash64(F.lit("sample"), docs[text_col])
    return docs.where(F.pmod(by, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(by).limit(sample_rows)


def ordered_rules(measured: DataFrame, rules: list[Rule] = RULES) -> list[tuple[Rule, float, float]]:
    """The rules with their rejection rate among what the rules before leave, and their mean work, most rejections per
    cost first. measured: base measures of the sample; documents that fail the base rules don't count."""
    hits = [F.coalesce(rule(), F.lit(False)).alias(f"r{k}") for k, (_, rule, _) in enumerate(rules)]
    sample = measured.where(~F.col("base_failed")).select(*hits, *[work().cast("double").alias(f"w{k}") for k, (_, _, work) in enumerate(rules)])
    n = len(rules)
    groups = sample.groupBy(*[f"r{k}" for k in range(n)]).agg(F.count("*").alias("n"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(n)]).collect()  # a row per combination met
    left, out = list(range(n)), []
    while left:
        total = sum(g["n"] for g in groups)
        rate = {k: sum(g["n"] for g in groups if g[f"r{k}"]) / total if total else 0.0 for k in left}
        cost = {k: max(1.0, sum(g[f"w{k}"] for g in groups) / total) if total else 1.0 for k in left}
        best = min(left, key=lambda k: (-rate[k] / cost[k], cost[k], k)) if total else left[0]
        out.append((rules[best], rate[best], cost[best]))
        left.remove(best)
        groups = [g for g in groups if not g[f"r{best}"]]
    return out


def quality_rules(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), the base measures, base_failed, rejected_by (the first
    rule of the cascade that holds, or null) and kept."""
    measured = with_base_measures(docs, text_col=text_col)
    sample = with_base_measures(sampled(docs, text_col=text_col, sample_rows=sample_rows), text_col=text_col)
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for (name, rule, _), _, _ in ordered_rules(sample, rules):
        cascade = cascade.when(rule(), F.lit(name))
    out = measured.withColumn("rejected_by", cascade)
    return out.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by",
        F.col("rejected_by").isNull().alias("kept"),
    )
