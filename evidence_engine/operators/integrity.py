"""Content hashes, manifests, links and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import kept


def fingerprints(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(key, F.sha2(content, 256).alias("sha256"))


#: Rows that an array of the dataset's fingerprint holds on average, at most.
PER_BUCKET = 10_000


def dataset_fingerprint(df: DataFrame, key: str, buckets: int = 4096, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One hash of all (key, sha256) rows, whatever their order.

    A tree of hashes: those of a bucket are joined in key order and hashed, then the hashes of each ``buckets`` buckets, up to one. The
    tree gets a level more where a bucket would hold over ``per_bucket`` rows, so no array grows with the data.
    """
    n, levels = df.count(), 1
    while n > per_bucket * buckets**levels:
        levels += 1
    digest = F.sha2(F.col(key).cast("string"), 256)
    at = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") % buckets for k in range(levels)]
    b = df.select(F.struct(F.concat_ws(":", F.col(key).cast("string"), "sha256").alias("h"), F.col(key).cast("string").alias("k"), "sha256").alias("x"), *[c.alias(f"b{k}") for k, c in enumerate(at)])
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.k").alias("k"), F.col("x.sha256").alias("s"), F.col("x.h").alias("h")))), lambda x: x["h"])
    one = b.groupBy(*[f"b{k}" for k in range(levels)]).agg(F.sha2(F.array_join(own, "\n"), 256).alias("h"), F.count("*").alias("n"))
    for k in range(levels - 1, -1, -1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(f"b{k}", "h"))), lambda x: x["h"]), "\n")
        one = one.groupBy(*[f"b{j}" for j in range(k)]).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
    return one.select(F.col("h").alias("fingerprint"), "n")


class HashTree:
    """A stored tree of hashes over rows (key, sha256), whose versions are compared from the top: only subtrees that differ are opened.

    A row lies in the leaf bucket that its key's digest names by ``levels`` bytes of ``fan`` values each, so equal keys lie alike in all
    versions. A level's file holds node (its path of bucket numbers as text), hash and n, sorted and split by node, so that a read of some nodes skips the rest;
    rows are stored in the order of their buckets, for the same reason. Hashes of a node are those of its children in order, of a leaf those of its rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, levels: int, fan: int):
        self.spark, self.path, self.key, self.levels, self.fan = spark, path.rstrip("/"), key, levels, fan
        self.opened = 0  # rows that comparisons have read

    @staticmethod
    def _node(key: str, depth: int, fan: int) -> Column:
        digest = F.sha2(F.col(key).cast("string"), 256)
        return F.array_join(F.array(*[F.lpad((F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") % fan).cast("string"), 4, "0") for k in range(depth)]), "/")

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str, *, levels: int | None = None, fan: int = 64, per_leaf: int = 1000) -> HashTree:
        """Stores the tree of df; levels follow from its rows where they aren't given (of another version, to be compared with)."""
        spark = df.sparkSession
        if levels is None:
            n, levels = df.count(), 1
            while n > per_leaf * fan**levels:
                levels += 1
        rows = df.select(cls._node(key, levels, fan).alias("node"), F.col(key), "sha256")
        rows.repartitionByRange("node", key).sortWithinPartitions("node", key).write.mode("overwrite").parquet(f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        told = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), "sha256"))), lambda x: F.concat_ws(":", x["k"], x["sha256"]))
        one = stored.groupBy("node").agg(F.sha2(F.array_join(told, "\n"), 256).alias("hash"), F.count("*").alias("n"))
        for depth in range(levels, -1, -1):
            one.repartitionByRange("node").sortWithinPartitions("node").write.mode("overwrite").parquet(f"{path}/level={depth}")
            below = spark.read.parquet(f"{path}/level={depth}")
            up = F.substring("node", 1, max(0, 5 * (depth - 1) - 1))
            hashes = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
            one = below.groupBy(up.alias("node")).agg(F.sha2(F.array_join(hashes, "\n"), 256).alias("hash"), F.sum("n").alias("n"))
        return cls(spark, path, key, levels, fan)

    def root(self) -> tuple[str | None, int]:
        r = self.spark.read.parquet(f"{self.path}/level=0").first()
        return (r["hash"], r["n"]) if r else (None, 0)

    def _read(self, what: str, within: DataFrame | None, depth: int) -> DataFrame:
        """The nodes or rows below some nodes of the level above."""
        d = self.spark.read.parquet(f"{self.path}/{what}")
        if within is None:
            return d
        few = within.agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).first()
        if few["n"] == 0:
            return d.limit(0)
        d = d.where((F.col("node") >= few["lo"]) & (F.col("node") <= few["hi"] + "/~"))  # row groups beside these aren't read
        return d.join(within.select(F.col("node").alias("__up")), F.substring("node", 1, max(0, 5 * depth - 1)) == F.col("__up"), "left_semi")

    def diff(self, other: HashTree) -> DataFrame:
        """key, change (added, missing or changed: in other against this one) of every row that differs."""
        if (self.levels, self.fan) != (other.levels, other.fan):
            raise ValueError("trees of different shapes can't be compared")
        none = self.spark.read.parquet(f"{self.path}/rows").limit(0).select(self.key, F.lit("").alias("change"))
        if self.root()[0] == other.root()[0]:
            return none
        within: DataFrame | None = None
        for depth in range(1, self.levels + 1):
            a, b = (t._read(f"level={depth}", within, depth - 1).select("node", "hash") for t in (self, other))
            both = a.join(b.withColumnRenamed("hash", "now"), "node", "full_outer")
            within = kept(both.where("NOT (hash <=> now)").select("node"))
        a, b = (kept(t._read("rows", within, self.levels).select(self.key, "sha256")) for t in (self, other))
        self.opened, other.opened = a.count(), b.count()
        both = a.join(b.withColumnRenamed("sha256", "now"), self.key, "full_outer")
        change = F.when(F.col("sha256").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("sha256") != F.col("now"), "changed")
        return both.select(self.key, change.alias("change")).where("change IS NOT NULL")


def verify_hashes(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """key, verdict of each stored hash: ok, missing or mismatch."""
    now = live.select(key, F.col("sha256").alias("now"))
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "mismatch").otherwise("ok")
    return stored.join(now, key, "left").select(key, verdict.alias("verdict"))


def duplicate_content(df: DataFrame, key: str) -> DataFrame:
    """key, first, copies of every row whose content other rows have, by one aggregation and a join back."""
    g = df.groupBy("sha256").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return df.join(g, "sha256").select(key, "first", "copies")


def staleness(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, verdict of stored results: missing, schema, stale or current (columns fingerprint, schema_version)."""
    now = current.select(key, F.col("fingerprint").alias("f"), F.col("schema_version").alias("v"))
    verdict = F.when(F.col("f").isNull(), "missing").when(F.col("v") != F.col("schema_version"), "schema").when(F.col("f") != F.col("fingerprint"), "stale").otherwise("current")
    return stored.join(now, key, "left").select(key, verdict.alias("verdict"))


def certified_path(path: Column, bad_names: list[str], bad_parts: list[str], suffix: str) -> Column:
    """Whether a path may count as certified: right suffix, no draft name, no draft folder."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    draft = F.lit(False)
    for x in bad_names:
        draft = draft | name.contains(x)
    return ~draft & low.endswith(suffix) & ~F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, bad_parts)))


#: Links of one target in a task, at most about so many times the tasks' mean.
SALTS = 64


def target_index(targets: DataFrame) -> DataFrame:
    """name, order: the best way in which a spelling leads to a path: 1 the path, 2 the path without .md, 3 its last part, if no other path has it, 4 that
    without .md. Spellings without .md have no suffix of another kind."""
    paths = targets.select("path").distinct()
    last = F.element_at(F.split("path", "/"), -1)
    bare = lambda c: F.regexp_replace(c, r"\.md$", "")
    plain = lambda c: c.rlike(r"(^|/)[^./][^./]*\.md$")
    spelled = lambda d, name, order: d.select(name.alias("name"), F.lit(order).alias("order"))
    only = paths.groupBy(last.alias("last")).agg(F.count("*").alias("n")).where("n = 1")
    p, q = F.col("path"), F.col("last")
    ways = spelled(paths, p, 1).unionAll(spelled(paths.where(plain(p)), bare(p), 2)).unionAll(spelled(only, q, 3)).unionAll(spelled(only.where(plain(q)), bare(q), 4))
    return ways.groupBy("name").agg(F.min("order").alias("order"))


def resolve_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links (with target) and how they resolve: exact, suffixed (with .md), basename (a target without a folder, if one path alone ends so), or broken.

    Targets that are linked are resolved once each, however many links have them. The way back goes by salted target: links of one target are dealt to ``SALTS`` keys,
    and each resolved target stands once for each salt that its links take, so a popular one doesn't meet in one task."""
    salt = F.pmod(F.xxhash64(*links.columns), F.lit(SALTS)).cast("int")
    dealt = links.withColumn("__salt", salt)
    asked = dealt.groupBy("target", "__salt").agg(F.lit(1).alias("__one"))
    distinct = asked.groupBy("target").agg(F.collect_set("__salt").alias("__salts"))
    found = distinct.join(target_index(targets).withColumnRenamed("name", "target"), "target", "left")
    how = F.when(F.col("order") == 1, "exact").when(F.col("order") == 2, "suffixed").when((F.col("order") > 2) & ~F.contains("target", F.lit("/")), "basename").otherwise("broken")
    found = found.select("target", how.alias("how"), F.explode("__salts").alias("__salt"))
    missing = F.coalesce("how", F.lit("broken"))  # a null target
    return dealt.join(found, ["target", "__salt"], "left").select(*links.columns, missing.alias("how"))


def missing_headings(links: DataFrame, headings: DataFrame) -> DataFrame:
    """links (doc, heading) whose document has no such heading."""
    return links.join(headings.select("doc", "heading").distinct(), ["doc", "heading"], "left_anti")


def link_style(target: Column) -> Column:
    """Whether a link says its file from the vault's root on: with a folder, and neither absolute nor relative to where it stands. A link within the page is."""
    path = F.trim(F.replace(F.split_part(target, F.lit("#"), F.lit(1)), F.lit("\\"), F.lit("/")))
    return F.trim(target).startswith("#") | ~(path.rlike(r"^(\.\./|\./|/|[A-Za-z]:/)") | ~F.contains(path, F.lit("/")))


def quote_issues(quotes: DataFrame, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """quotes (key, first, last, quote, sha256) with issue: out_of_range, text, hash, or null.

    The lines of a document are an array, so a quote takes an equi-join on the document, not a range join on lines.
    """
    d = quotes.join(docs.select(key, F.split(text, "\n", -1).alias("lines")), key, "left")
    said = F.array_join(F.slice("lines", F.col("first"), F.greatest(F.lit(0), F.col("last") - F.col("first") + 1)), "\n")
    outside = F.col("lines").isNull() | (F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > F.size("lines"))
    issue = F.when(outside, "out_of_range").when(said != F.col("quote"), "text").when(F.sha2(said, 256) != F.col("sha256"), "hash")
    return d.withColumn("issue", issue).drop("lines")


def part_issues(chunks: DataFrame, segments: DataFrame, key: str, *, allow_unrepaired: bool = False) -> DataFrame:
    """key, issue, part: chunks (key, part, status) that aren't done, and segments (key, part, repaired) without a repaired text, where those aren't allowed."""
    open_ = chunks.where(F.coalesce("status", F.lit("")) != "done").select(key, F.lit("chunk_not_done").alias("issue"), "part")
    if allow_unrepaired:
        return open_
    return open_.unionByName(segments.where(~F.coalesce("repaired", F.lit(False))).select(key, F.lit("segment_unrepaired").alias("issue"), "part"))


def bind_issues(outputs: DataFrame, sources: DataFrame, root: str, key: str) -> DataFrame:
    """key, issue of intakes: an output outside the folder root or without an anchor (outputs: key, path, anchors), or a source
    whose content an earlier key has (sources: key, sha256)."""
    checks = {"outside": ~F.col("path").startswith(root) | F.col("path").contains("/../"), "no_anchor": F.coalesce(F.size("anchors"), F.lit(0)) <= 0}
    own = outputs.select(key, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("issue"))
    again = duplicate_content(sources, key).where(F.col(key) > F.col("first")).select(key, F.lit("duplicate_source").alias("issue"))
    return own.unionByName(again)


def certificate_issues(certificates: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """key, issue of certificates (status, unresolved, sha256): every rule that one breaks."""
    d = certificates.join(live.select(key, F.col("sha256").alias("now")), key, "left")
    checks = {
        "status": F.col("status") != "complete", "unresolved": F.col("unresolved") > 0,
        "missing": F.col("now").isNull(), "changed": F.col("now") != F.col("sha256"),
    }
    return d.select(key, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("issue"))


def previous_marker(rows: DataFrame, key: str, order: list[str], marker: Column, value: Column, name: str) -> DataFrame:
    """rows with the value of the nearest marked row before or at them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(marker, value), ignorenulls=True).over(w))


def scoped(docs: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """docs in a named scope: rules (scope, prefix) say which values of a column belong; a document counts once per scope."""
    return docs.join(rules, F.col(column).startswith(F.col("prefix"))).select("scope", *docs.columns).distinct()


def blocker_quote_issues(blockers: DataFrame, *, final_type: str, types: list[str], max_lines: int = 25) -> DataFrame:
    """file, line_no, issue: a type that isn't known, an item of another type than its marker, a marker that was there before, and, for items of the
    final type, missing quote fields, no quote, quote lines that aren't one range, and a long quote without a reason."""
    from .ledger import line_ranges

    field = lambda n: F.col("fields").getItem(n)
    no = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    final = F.coalesce(F.col("item_type") == final_type, F.lit(False))
    lacks = F.exists(F.array(*[field(n).isNull() for n in ("quote_source", "quote_source_sha256", "quote_lines", "quote_sha256")]), lambda x: x)
    first = F.row_number().over(Window.partitionBy("sha", "item_type", "ranges").orderBy("file", "line_no"))
    d = blockers.withColumn("__seq", first).withColumn("__q", line_ranges(field("quote_lines")))
    one = F.coalesce(F.size("__q") == 1, F.lit(False))
    long = one & (F.get("__q", 0)["end"] - F.get("__q", 0)["start"] + 1 > max_lines)
    checks = {
        "unknown_type": ~F.col("item_type").isin(*types), "type_differs": field("type") != F.col("item_type"), "repeated": F.col("__seq") > 1, "no_quote_fields": final & lacks,
        "no_quote": final & ~lacks & ~F.col("has_quote"),
        "bad_quote_lines": final & ~lacks & F.col("has_quote") & ~one, "long_quote_without_reason": final & ~lacks & F.col("has_quote") & long & no(field("quote_scope_reason")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return d.select("file", "line_no", F.explode(found).alias("issue"))


def blocker_issues(blockers: DataFrame, docs: DataFrame, *, max_lines: int = 25) -> DataFrame:
    """file, line_no, issue of blocker items: every rule that a marker or its fields break.

    blockers: as read from a ledger (sha, item_type, ranges, fields with evidence_source, source_sha256, lines, reason);
    docs: path, sha256, n_lines of the evidence sources.
    """
    from .ledger import line_ranges

    field = lambda n: F.col("fields").getItem(n)
    live = docs.select(F.col("path").alias("evidence_source"), F.col("sha256").alias("now"), "n_lines")
    d = blockers.withColumn("evidence_source", field("evidence_source")).join(live, "evidence_source", "left").withColumn("r", line_ranges(F.col("ranges")))
    long = F.exists("r", lambda x: x["end"] - x["start"] + 1 > max_lines)
    no = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = {
        "bad_marker": (F.length("sha") != 64) | no(F.col("item_type")), "bad_ranges": F.col("r").isNull(), "no_body": F.size("fields") == 0,
        "marker_differs": (F.lower(field("source_sha256")) != F.col("sha")) | (field("lines") != F.col("ranges")),
        "no_source": F.col("now").isNull(), "source_changed": F.col("now") != F.col("sha"),
        "out_of_range": F.exists("r", lambda x: x["end"] > F.col("n_lines")), "long_without_reason": long & no(field("reason")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return d.select("file", "line_no", F.explode(found).alias("issue"))


def starter_provenance(lines: DataFrame, registered: DataFrame, records: DataFrame, *, pending: str = "pending") -> DataFrame:
    """lines (anchor, text) with verdict: pending, registered (equals its anchor's starter), cited (names the day of a record of
    its anchor) or unsupported. registered: anchor, starter; records: anchor, day."""
    day = F.when(F.col("text").rlike(r"\d{4}-\d{2}-\d{2}"), F.regexp_extract("text", r"\d{4}-\d{2}-\d{2}", 0))
    known = registered.select("anchor", F.col("starter").alias("__starter"))
    held = records.select("anchor", F.col("day").cast("string").alias("__day"), F.lit(True).alias("__held")).distinct()
    d = lines.withColumn("__day", day).join(known, "anchor", "left").join(held, ["anchor", "__day"], "left")
    verdict = F.when(F.col("text") == pending, "pending").when(F.col("text") == F.col("__starter"), "registered").when(F.col("__held"), "cited").otherwise("unsupported")
    return d.withColumn("verdict", verdict).drop("__day", "__starter", "__held")
