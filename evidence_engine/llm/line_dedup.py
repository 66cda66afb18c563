"""Line deduplication across documents, by DataFrame operations alone.

A line's key is the line without white space at both ends, with A-Z lower-cased. A key of at least ``min_chars``
code points that at least two documents hold loses all its lines except those in the smallest doc_id holding it.

Hashes of keys are range-partitioned and sorted by document and position within each hash, so that one streaming pass
meets the first occurrence before all others. A key may hold a third of all lines, so the range key carries a salt of
the document, and the pass has two levels: the first finds the first document of every (hash, salt) group, the second
compares these groups' heads, of which a key has no more than there are salts. Only positions leave the passes; a document's decisions come back as a
bitmap of kept lines in run-length form, and texts move once, to meet their bitmap.

Defined cases: a null text is one empty line; rows with a null doc_id keep all their lines and drop no other's; rows
that share a doc_id are one document, so they drop no lines of each other, and each row is judged by its own text.
Keys are compared by 128 bits of hash. Very long texts and lines are read whole, and only their hashes and positions are sorted;
repeated lines of a document go or stay together; an empty table gives no rows; other columns pass through, and those made have a prefix
that the caller chooses, so that no name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, let, shuffle_partitions, stored

MIN_CHARS = 10


def _text(docs: DataFrame, text_col: str):
    return F.coalesce(docs[text_col], F.lit(""))


def line_hashes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: h1, h2, doc, th (of the whole text), n (lines of the text), pos."""
    lines = F.split(_text(docs, text_col), "\n", -1)
    rows = docs.where(docs[id_col].isNotNull()).select(
        docs[id_col].alias("doc"), F.xxhash64(_text(docs, text_col)).alias("th"), lines.alias("lines")
    )
    rows = rows.select("doc", "th", F.size("lines").alias("n"), "lines")  # counted first: no row then carries the array
    rows = rows.select("doc", "th", "n", F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("doc", "th", "n", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).where(F.length("key") >= min_chars)
    return rows.withColumn("key", ascii_lower(F.col("key"))).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "th", "n", "pos"
    )


def dropped_lines(docs: DataFrame, **how) -> DataFrame:
    """doc, th, n, pos of every line that goes."""
    salts = shuffle_partitions(docs.sparkSession)
    hashes = stored(line_hashes(docs, **how)).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))

    def streamed(rows: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
        return rows.repartitionByRange(*group).withColumn("first", F.first("doc").over(order))

    once = stored(streamed(hashes, "h1", "h2", "salt"))
    heads = streamed(once.where("doc = first").drop("first"), "h1", "h2")
    return (
        once.where("doc > first").select("doc", "th", "n", "pos").unionAll(heads.where("doc > first").select("doc", "th", "n", "pos"))
    )


def keep_bitmaps(docs: DataFrame, **how) -> DataFrame:
    """doc, th, n_lines, n_dropped, kept_runs for each document that loses a line; kept_runs is the bitmap of kept lines
    as runs (start, length), in order. Documents without a row keep all lines."""
    gone = dropped_lines(docs, **how).groupBy("doc", "th").agg(
        F.max("n").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone")
    )
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("gone", i - 1) + 1)
    runs = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.struct(
            start(i).alias("start"), (F.coalesce(F.get("gone", i), F.col("n_lines")) - start(i)).alias("length")
        ),
    )
    return gone.select(
        "doc", "th", "n_lines", F.size("gone").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("kept_runs")
    )


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: str = "kept") -> DataFrame:
    """All rows and columns of docs, with {prefix}_lines, {prefix}_dropped (counts) and {prefix}_text (lines left), which
    replace columns of these names."""
    mine = {f"{prefix}_lines", f"{prefix}_dropped", f"{prefix}_text"}
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(_text(docs, text_col)).alias("hash"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    left = let(
        F.split(text, "\n", -1),
        lambda lines: F.array_join(
            F.flatten(
                F.transform("kept_runs", lambda r: F.transform(F.sequence(r["start"], r["start"] + r["length"] - 1), lambda i: F.get(lines, i)))
            ),
            "\n",
        ),
    )
    joined = row.join(bitmaps.hint("shuffle_hash"), (F.col("id") == F.col("doc")) & (F.col("hash") == F.col("th")), "left")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in mine],
        F.coalesce(F.col("n_lines"), F.size(F.split(text, "\n", -1))).cast("long").alias(f"{prefix}_lines"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias(f"{prefix}_dropped"),
        F.when(F.col("n_dropped").isNull(), text).otherwise(left).alias(f"{prefix}_text"),
    )


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, prefix: str = "kept") -> DataFrame:
    """docs with the text left after line deduplication; see the module's docstring."""
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    return with_kept_text(docs, bitmaps, id_col=id_col, text_col=text_col, prefix=prefix)
