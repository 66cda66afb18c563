"""The item bank: field rules, integrity rules and counts over items, and the reading of banks kept as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import choices, matched, non_blank, stripped, union_all


def infer_paper_type(source: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The type whose word the source holds, first rule first."""
    out = None
    for word, kind in rules:
        hit = source.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def academic_year(value: Column, source: Column) -> Column:
    """The start of the first ``YYYY-YYYY`` that touches no digit and spans one year. A given value that holds none hides
    the source."""
    text = F.coalesce(non_blank(value), source)
    pattern = r"(?<!\d)(\d{4})-(\d{4})(?!\d)"
    start, end = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2))
    return F.when(end == start + 1, start)


def item_form(anchor: Column, explicit: Column, patterns: list[tuple[str, str]], unknown: str) -> Column:
    """struct(form, form_source): explicit, inferred from the anchor, or unknown."""
    given = non_blank(explicit)
    inferred = choices(anchor, patterns)
    return F.struct(
        F.coalesce(given, inferred, F.lit(unknown)).alias("form"),
        F.when(given.isNotNull(), "explicit").when(inferred.isNotNull(), "inferred").otherwise("unknown").alias("form_source"),
    )


def parse_score(text: Column) -> Column:
    """The first signed number in a text; nothing if there is none or it isn't positive."""
    number = matched(text, r"[+-]?\d+(?:\.\d+)?").try_cast("double")
    return F.when(number > 0, number)


def status_with_source(status: Column, default: str) -> Column:
    given = non_blank(status)
    return F.struct(F.coalesce(given, F.lit(default)).alias("status"), F.when(given.isNull(), "legacy_default").otherwise("explicit").alias("status_source"))


def inherited(child: DataFrame, parent: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """child with each field taken from its parent where the child has none; an empty text counts as given."""
    p = parent.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = child.join(p, key, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in child.columns])


def patched(rows: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the fields that the patch gives; null keeps the old value."""
    return inherited(patch.select(key, *fields), rows, key, fields).unionByName(rows.join(patch.select(key), key, "left_anti").select(key, *fields))


def stable_ids(dimension: DataFrame, column: str, prefix: str) -> DataFrame:
    """column and id, numbered by name. For dimensions of a closed vocabulary: one window over their rows."""
    return dimension.select(column, F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(column))).alias("id"))


def with_theme(facts: DataFrame, dimension: DataFrame) -> DataFrame:
    """facts joined with their tag's row of the dimension (tag, theme, chapter)."""
    return facts.join(dimension, "tag")


def unknown_keys(facts: DataFrame, dimension: DataFrame, key: str = "tag") -> DataFrame:
    return facts.join(dimension.select(key), key, "left_anti")


def reconcile_counts(dimension: DataFrame, facts: DataFrame, key: str = "tag") -> DataFrame:
    """key, expected, actual of the keys whose declared count differs; keys without a row count zero."""
    actual = facts.groupBy(key).agg(F.count("*").alias("actual"))
    return dimension.select(key, F.col("expected_count").alias("expected")).join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where("expected <> actual")


def first_of_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with seq (1 for the one that stays)."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def scope_counts(facts: DataFrame) -> DataFrame:
    """One row of totals."""
    n = F.count_distinct
    return facts.agg(F.count("*").alias("items"), n("anchor").alias("anchors"), n("paper").alias("papers"), n("tag").alias("tags"), n("theme").alias("themes"), n("paper_type").alias("paper_types"))


def papers_per_type(facts: DataFrame) -> DataFrame:
    return facts.groupBy("paper_type").agg(F.count_distinct("paper").alias("papers"))


def quality_counts(facts: DataFrame, *, explicit: str = "explicit", inferred: str = "anchor", unknown: str = "unknown", legacy: str = "legacy_default") -> DataFrame:
    """Per paper type: items by where their form (form_source) and status (ocr_source) come from, by status (ocr; a map), without a score, and papers without a year."""
    f, o = F.col("form_source"), F.col("ocr_source")
    keys = facts.groupBy("paper_type").agg(
        F.count_if(f == explicit).alias("form_explicit"), F.count_if(f == inferred).alias("form_inferred"), F.count_if(f == unknown).alias("form_unknown"),
        F.count_if(o == explicit).alias("status_explicit"), F.count_if(o == legacy).alias("status_legacy_default"),
        F.count_distinct(F.when(F.col("year").isNull(), F.col("paper"))).alias("unknown_year_papers"), F.count_if(F.col("score").isNull()).alias("unknown_scores"),
    )
    statuses = series_counts(facts, ["paper_type"], "ocr").select("paper_type", F.col("counts").alias("statuses"))
    return keys.join(statuses, "paper_type")


def series_counts(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and a map of value to count, with keys sorted."""
    counts = facts.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("items"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def entity_totals(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Totals for every entity of the dimension, with those that have no item; unknown years count here."""
    own = facts.groupBy(key).agg(F.count("*").alias("items"), F.count_distinct("paper").alias("papers"), F.sum("score").alias("score"))
    return dimension.select(key).distinct().join(own, key, "left").na.fill(0, ["items", "papers"]).na.fill(0.0, ["score"])


def paper_breakdown(facts: DataFrame, *keys: str) -> DataFrame:
    """Items and points by keys, with subtotals."""
    return facts.rollup(*keys).agg(F.count("*").alias("items"), F.sum("score").alias("points"), F.grouping_id().alias("level"))


def intake_issues(rows: DataFrame, dimension: DataFrame, *, forms: list[str], statuses: list[str]) -> DataFrame:
    """anchor, rule: all blocking findings of an intake (rows: anchor, pos, chapter, tag, source, form, ocr)."""
    blank = lambda c: F.coalesce(stripped(F.col(c)), F.lit("")) == ""
    checks = {
        "missing_chapter": blank("chapter"), "missing_tag": blank("tag"), "missing_source": blank("source"),
        "illegal_form": F.col("form").isNotNull() & ~F.col("form").isin(*forms), "illegal_status": F.col("ocr").isNotNull() & ~F.col("ocr").isin(*statuses),
    }
    rules = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    found = rows.select("anchor", F.explode(rules).alias("rule"))
    again = first_of_key(rows, "anchor", ["pos"])
    kept = again.where("seq = 1")
    return union_all([
        found,
        again.where("seq > 1").select("anchor", F.lit("duplicate_anchor").alias("rule")),
        unknown_keys(kept.where(~blank("tag")), dimension).select("anchor", F.lit("unknown_tag").alias("rule")),
        reconcile_counts(dimension, kept).select(F.col("tag").alias("anchor"), F.lit("count_mismatch").alias("rule")),
        dimension.groupBy("tag").count().where("count > 1").select(F.col("tag").alias("anchor"), F.lit("duplicate_tag").alias("rule")),
        dimension.where(blank("theme")).select(F.col("tag").alias("anchor"), F.lit("no_theme").alias("rule")),
    ])


class QualityError(ValueError):
    """Blocking findings; issues holds the frame with all of them."""

    def __init__(self, issues: DataFrame, count: int):
        super().__init__(f"{count} blocking findings")
        self.issues, self.count = issues, count


def quality_gate(issues: DataFrame) -> None:
    """Stops a job that has findings, instead of publishing a part."""
    if not issues.isEmpty():
        raise QualityError(issues, issues.count())


# -- banks kept as Markdown --------------------------------------------------------------------------------------


HEADING = r"^#{1,6}\s+(.+?)\s*$"


def blocks(texts: DataFrame, heading: str = HEADING) -> DataFrame:
    """file, block, anchor, pos (1-based line of the heading), body: the heading-delimited blocks of texts (file, text)."""
    lines = texts.select("file", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))
    d = lines.withColumn("head", F.col("line").rlike(heading))
    d = d.withColumn("block", F.sum(F.col("head").cast("int")).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    g = d.where("block > 0").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    first = F.element_at("ls", 1)
    body = F.array_join(F.transform(F.slice("ls", F.lit(2), F.size("ls")), lambda x: x["line"]), "\n")
    return g.select("file", "block", F.regexp_extract(first["line"], heading, 1).alias("anchor"), (first["pos"] + 1).alias("pos"), body.alias("body"))


def section_blocks(sections: DataFrame, heading: str = HEADING) -> DataFrame:
    """path and the columns of blocks, of files that come by sections (``read_sections``): memory holds what stands between two lines that begin with a
    number sign, and a block, but never a file. Every heading begins with a number sign; other lines that do open no block."""
    w = Window.partitionBy("path").orderBy("part", "at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    first, last = F.row_number().over(w) == 1, F.lead("at").over(w).isNull()
    text = F.concat(F.when(first, "").otherwise("#"), F.when(last, F.col("text")).otherwise(F.regexp_replace("text", r"\r\z", "")))
    d = sections.withColumn("text", F.regexp_replace(text, "\r\n", "\n"))
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    d = d.withColumn("pos", F.sum(feeds + 1).over(so_far) - feeds)
    d = d.withColumn("block", F.sum(F.substring_index("text", "\n", 1).rlike(heading).cast("int")).over(so_far)).where("block > 0")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    g = d.groupBy("path", "file", "block").agg(F.min("pos").cast("int").alias("pos"), whole.alias("text"))
    line = F.substring_index("text", "\n", 1)
    body = F.substr("text", F.length(line) + 2)
    return g.select("path", "file", "block", F.regexp_extract(line, heading, 1).alias("anchor"), "pos", body.alias("body"))


def metadata(body: Column) -> Column:
    """A map of the fields in the closed %% block right after a heading (blank lines may stand between); last one wins."""
    inner = matched(body, r"(?s)\A(?:[ \t]*\n)*[ \t]*%%[ \t]*\n(.*?)\n[ \t]*%%[ \t]*(?:\n|\z)", 1)
    pairs = F.filter(F.split(F.coalesce(inner, F.lit("")), "\n"), lambda x: x.rlike(r"^[^:]+:"))
    keys = F.transform(pairs, lambda x: stripped(F.substring_index(x, ":", 1)))
    last = F.filter(F.sequence(F.lit(0), F.size(keys)), lambda i: (i < F.size(keys)) & ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), F.coalesce(F.get(keys, i), F.lit(""))))
    return F.when(inner.isNotNull(), F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(keys, i), stripped(F.substr(F.get(pairs, i), F.instr(F.get(pairs, i), ":") + 1))))))


def starters(block: DataFrame, doubtful: str = "doubtful") -> DataFrame:
    """anchor, starter: the first step of each block whose solution isn't marked doubtful."""
    step = matched(F.col("body"), r"(?m)^>\s*starter:\s*(.+?)\s*$", 1)
    status = F.coalesce(matched(F.col("body"), r"(?m)^>\s*status:\s*(.+?)\s*$", 1), F.lit(""))
    return block.select("anchor", step.alias("starter"), status.alias("s")).where(F.col("starter").isNotNull() & (F.col("s") != doubtful)).select("anchor", "starter")


def block_statuses(block: DataFrame, default: str) -> DataFrame:
    """anchor, status of each block; the last of an anchor wins."""
    status = F.coalesce(non_blank(matched(F.col("body"), r"(?m)^ocr_status:\s*(.*?)\s*$", 1)), F.lit(default))
    return block.groupBy("anchor").agg(F.max_by(status, F.struct("file", "pos")).alias("status"))


def profile_sections(texts: DataFrame, required: list[str]) -> DataFrame:
    """file, section, items (list entries), text and issue (missing, repeated, empty) for each required section."""
    own = blocks(texts, r"^##\s+(.+?)\s*$")
    entries = F.filter(F.transform(F.split("body", "\n"), lambda x: F.regexp_replace(x, r"^\s*-\s*", "")), lambda x: stripped(x) != "")
    found = own.groupBy("file", F.col("anchor").alias("section")).agg(F.count("*").alias("n"), F.max("body").alias("body")).withColumn("items", entries)
    wanted = texts.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, required))).alias("section"))
    d = wanted.join(found, ["file", "section"], "left")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(stripped(F.col("body")) == "", "empty")
    return d.select("file", "section", "items", stripped(F.col("body")).alias("text"), issue.alias("issue"))


def intake_completeness(block: DataFrame, paper_fields: list[str], item_fields: list[str], paper_anchor: str) -> DataFrame:
    """file, anchor, level, missing: required fields that a paper's header or an item lacks.

    block: file, anchor, body of all blocks; the block whose anchor starts with paper_anchor is the paper's header, and items inherit its fields.
    """
    d = block.withColumn("meta", F.coalesce(metadata(F.col("body")), F.create_map().cast("map<string,string>"))).withColumn("paper", F.col("anchor").startswith(paper_anchor))
    heads = d.where("paper").groupBy("file").agg(F.max_by("meta", "pos").alias("head"))
    d = d.join(heads, "file", "left").withColumn("head", F.coalesce("head", F.create_map().cast("map<string,string>")))

    def lacking(fields: list[str], *maps: str) -> Column:
        given = lambda n: F.coalesce(*[F.col(m).getItem(n) for m in maps], F.lit(""))
        return F.filter(F.array(*[F.when(stripped(given(n)) == "", F.lit(n)) for n in fields]), lambda x: x.isNotNull())

    missing = F.when(F.col("paper"), lacking(paper_fields, "meta")).otherwise(lacking(item_fields, "meta", "head"))
    level = F.when(F.col("paper"), "paper").otherwise("item")
    return d.select("file", "anchor", level.alias("level"), missing.alias("missing")).where(F.size("missing") > 0)


def dated(year: Column) -> Column:
    """Whether an item counts by year; others count in totals only."""
    return year.isNotNull()


def has_form(form: Column, unknown: str) -> Column:
    return F.coalesce(form, F.lit(unknown)) != unknown


def is_long(form: Column, forms: tuple[str, ...]) -> Column:
    """Whether a form asks for a long answer."""
    return F.coalesce(form.isin(*forms), F.lit(False))


def without_pending(facts: DataFrame, pending: str, status: str = "ocr") -> DataFrame:
    """Items whose text is settled; an unknown status is."""
    return facts.where(~F.coalesce(F.col(status) == pending, F.lit(False)))


def consumption_guard(queue: DataFrame, papers: DataFrame, pending: str, *, key: str = "paper", status: str = "status") -> DataFrame:
    """Rows of a queue that take items of papers whose status is pending: these block it."""
    return queue.join(papers.where(F.col(status) == pending).select(key).distinct(), key, "left_semi")


def type_order(types: DataFrame, first: tuple[str, ...], column: str = "paper_type") -> DataFrame:
    """Distinct types with their position: those of first come before others. A closed vocabulary, so one window over a few rows."""
    own = types.select(column).distinct()
    return own.withColumn("position", F.row_number().over(Window.orderBy(F.when(F.col(column).isin(*first), 0).otherwise(1), column)))


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that both frames hold."""
    return a.select(*keys).intersect(b.select(*keys))


def same_lists(now: DataFrame, was: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, same: whether each key's values, in order, are those that it had."""
    listed = lambda df, n: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]).alias(n))
    both = listed(now, "__now").join(listed(was, "__was"), key, "left")
    return both.select(key, F.coalesce(F.col("__now") == F.col("__was"), F.lit(False)).alias("same"))
