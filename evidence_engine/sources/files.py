"""Readers of course folders, and sinks."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import matched, stripped, text_lines
from .store import Store


def read_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """file (name) and text of whole files; a byte-order mark goes."""
    d = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"^\uFEFF", "").alias("text"))


def read_sections(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, file (name), part, at, text: files cut before each line that begins with a number sign, so none is held whole. (part, at) is the order in a
    file. The line feed and the number sign at a cut belong to no text; a byte-order mark goes."""
    d = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n#").text(path)
    m = lambda n: F.col(f"_metadata.{n}")
    return d.select(m("file_path").alias("path"), m("file_name").alias("file"), m("file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def tag_library(texts: DataFrame) -> DataFrame:
    """chapter, theme, tag, expected_count of each four-column table row; headers and rules of tables have no number."""
    row = r"^\s*\|([^|]*)\|([^|]*)\|([^|]*)\|\s*(\d+)\s*\|\s*$"
    lines = texts.select("file", F.posexplode(text_lines(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike(row))
    cell = lambda k: stripped(F.regexp_extract("line", row, k))
    return lines.select("file", (F.col("pos") + 1).alias("pos"), cell(1).alias("chapter"), cell(2).alias("theme"), cell(3).alias("tag"), cell(4).try_cast("int").alias("expected_count"))


def attempt_log(texts: DataFrame) -> DataFrame:
    """date, anchor, judgement, wrong_cause, note, screenshot of each six-column table row that starts with a date."""
    lines = texts.select("file", F.posexplode(text_lines(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike(r"^\s*\|\s*\d{4}-\d{2}-\d{2}\s*\|"))
    cells = lines.withColumn("c", F.split("line", r"(?<!\\)\|", -1)).where(F.size("c") == 8)
    name = ["date", "anchor", "judgement", "wrong_cause", "note", "screenshot"]
    return cells.select((F.col("pos") + 1).alias("pos"), *[F.nullif(stripped(F.get("c", k + 1)), F.lit("")).alias(n) for k, n in enumerate(name)]).withColumn("date", F.col("date").try_cast("date"))


def event_lines(texts: DataFrame, schema: str) -> DataFrame:
    """file, line (1-based), raw, event (null where the line is no JSON object)."""
    d = texts.select("file", F.posexplode(text_lines(F.col("text"))).alias("pos", "raw")).where(stripped(F.col("raw")) != "")
    return d.select("file", (F.col("pos") + 1).alias("line"), "raw", F.when(F.try_parse_json("raw").isNotNull() & F.col("raw").rlike(r"^\s*\{"), F.from_json("raw", schema)).alias("event"))


def blockers(texts: DataFrame, quote_marker: str = "quote:") -> DataFrame:
    """file, line, sha, item_type, ranges, fields (map) and has_quote (a line with the quote's marker) of each block that a marker opens."""
    marker = r"<!--\s*item\s+sha=([0-9A-Fa-f]+)\s+type=(\S+)\s+lines=([^>]*?)\s*-->"
    d = texts.select("file", F.posexplode(text_lines(F.col("text"))).alias("pos", "line")).withColumn("mark", F.col("line").rlike(marker))
    d = d.withColumn("block", F.sum(F.col("mark").cast("int")).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    field = r"^\s*-\s*(\w+)\s*:\s*(.*?)\s*$"
    entry = F.when(F.col("line").rlike(field), F.struct("pos", F.regexp_extract("line", field, 1).alias("k"), F.regexp_extract("line", field, 2).alias("v")))
    g = d.groupBy("file", "block").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.sort_array(F.collect_list(entry)).alias("es"), F.max(stripped(F.col("line")) == quote_marker).alias("has_quote"))
    keys = F.array_distinct(F.transform("es", lambda e: e["k"]))
    fields = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter("es", lambda e: e["k"] == k), -1)["v"])))
    part = lambda k: matched(F.col("line"), marker, k)
    return g.select("file", (F.col("pos") + 1).alias("line_no"), F.lower(part(1)).alias("sha"), part(2).alias("item_type"), part(3).alias("ranges"), fields.alias("fields"), "has_quote")


def read_manifests(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Whole JSON files below a folder with their path; unreadable ones are left out."""
    d = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("mode", "PERMISSIVE").json(path)
    return d.withColumn("manifest", F.col("_metadata.file_path")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def file_fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and SHA-256 of each file below a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return d.select("path", "length", F.sha2("content", 256).alias("sha256"))


#: Versions of a published folder that stay, the current one included; readers of older ones must have ended.
VERSIONS = 2


def _publish(spark: SparkSession, folder: str, write, version: str | None, keep: int) -> str:
    """A new version below folder by write(path), then the pointer moves to it, then old versions go. Whatever breaks leaves the pointer at a whole version."""
    store = Store(spark, folder)
    version = version or f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    if "/" in version or version[0] in "._":
        raise ValueError(f"not a version's name: {version}")
    current = store.read(f"{folder}/_current")
    if current == version:
        raise ValueError(f"version {version} is the current one")
    store.delete(f"{folder}/{version}")  # of a try that broke
    write(f"{folder}/{version}")
    store.write(f"{folder}/_previous", "\n".join([*(store.read(f"{folder}/_previous") or "").split("\n"), current or ""]).strip())
    store.write(f"{folder}/_current", version)
    # of the versions that were current, so many stay; what was never current is a broken try of before
    known = [v for v in (store.read(f"{folder}/_previous") or "").split("\n") if v]
    old = known[: len(known) - (keep - 1)]
    for v in old:
        if v != version:
            store.delete(f"{folder}/{v}")
    store.write(f"{folder}/_previous", "\n".join(v for v in known if v not in old))
    return version


def _current(spark: SparkSession, folder: str) -> str:
    version = Store(spark, folder).read(f"{folder}/_current")
    if version is None:
        raise FileNotFoundError(f"nothing is published below {folder}")
    return f"{folder}/{version}"


def publish(df: DataFrame, folder: str, fmt: str = "parquet", *, version: str | None = None, keep: int = VERSIONS) -> str:
    """Replaces a result as a whole: a new version is written beside the old one, and one rename of a pointer makes it the result."""
    return _publish(df.sparkSession, folder, lambda path: df.write.format(fmt).save(path), version, keep)


def published(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """The result that the pointer names."""
    return spark.read.format(fmt).load(_current(spark, folder))


def publish_views(views: dict[str, DataFrame], folder: str, version: str | None = None, *, keep: int = VERSIONS) -> str:
    """Writes all views below a new version, then points to it; readers follow the pointer, so they see all or none."""

    def write(path: str) -> None:
        for name, df in views.items():
            df.write.parquet(f"{path}/{name}")

    return _publish(next(iter(views.values())).sparkSession, folder, write, version, keep)


def published_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{_current(spark, folder)}/{name}")
