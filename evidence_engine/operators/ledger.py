"""Learning events: defaults, signatures, validation, duplicates, ledgers that grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The vocabularies of an event, and the fields that an event of a machine's origin may not have.
VOCABULARY = {
    "event_type": ("attempt", "question", "explanation", "probe", "repair", "variant", "reflection", "state_update"),
    "origin": ("s3", "s10", "manual", "import"),
    "created_by": ("main_agent", "subagent", "user", "script"),
    "outcome": ("not_tested", "observed", "repaired_independently", "repaired_with_hint", "needs_followup", "not_repaired", "deferred"),
    "confidence": ("low", "medium", "high"),
    "judgement": ("对", "对但慢", "卡", "错", "空"),
    "wrong_cause": ("概念错", "起手错", "计算错", "审题错", "没思路"),
}
MACHINE, ATTEMPT = "s3", "attempt"
MACHINE_FORBIDDEN = ("hypothesis", "probe", "tutor_action", "hint_level")
#: The fields that make an event what it is.
SIGNED = ("event_type", "anchor", "hypothesis", "evidence", "probe")
#: Who wrote an event, by its origin, where it doesn't say so; others are a user's.
WRITERS = {"s10": "main_agent", "s3": "script"}
SEPARATOR = "␟"


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", ""), F.lit("")) == ""


def normalize_events(df: DataFrame, *, origin: str = "s10", writers: dict[str, str] = WRITERS, writer: str = "user", outcome: str = "observed") -> DataFrame:
    """df with origin, created_by (by origin) and outcome where they are null; what an event says itself stays."""
    had = {n: F.col(n) if n in df.columns else F.lit(None).cast("string") for n in ("origin", "created_by", "outcome")}
    d = df.withColumn("origin", F.coalesce(had["origin"], F.lit(origin)))
    by = F.lit(writer)
    for o, w in writers.items():
        by = F.when(F.col("origin") == o, w).otherwise(by)
    return d.withColumn("created_by", F.coalesce(had["created_by"], by)).withColumn("outcome", F.coalesce(had["outcome"], F.lit(outcome)))


def signature(*fields: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over the fields; a missing field counts as empty."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 16)


def event_signature(columns: list[str]) -> Column:
    """The signature of an event over SIGNED; a column that isn't there is empty."""
    return signature(*[F.col(n) if n in columns else F.lit(None) for n in SIGNED])


def event_identity(time: Column, payload: Column) -> Column:
    """Time prefix and 6 hexadecimal digits of the payload's digest."""
    return F.concat(F.date_format(time, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(payload, 256), 1, 6))


def append_new(ledger: DataFrame, df: DataFrame, key: str = "signature") -> DataFrame:
    """The rows of df to append: one of each key that the ledger doesn't hold."""
    fresh = df.join(ledger.select(key).distinct(), key, "left_anti")
    return fresh.dropDuplicates([key])


def in_vocabulary(row: dict[str, Column], vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """Whether every field of the vocabulary is one of its words."""
    out = F.lit(True)
    for n, words in vocabulary.items():
        out = out & F.coalesce(row[n].isin(*words), F.lit(False))
    return out


def missing_fields(row: dict[str, Column], required: list[str]) -> Column:
    present = F.filter(F.array(*[F.when(~blank(c.cast("string")), F.lit(n)) for n, c in row.items()]), lambda x: x.isNotNull())
    return F.array_except(F.array(*map(F.lit, required)), present)


def forbidden_fields(row: dict[str, Column], forbidden: list[str]) -> Column:
    present = F.filter(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in row.items()]), lambda x: x.isNotNull())
    return F.array_intersect(F.array(*map(F.lit, forbidden)), present)


def valid_time(c: Column) -> Column:
    """Whether a text is a date and time in extended ISO form."""
    return c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$") & F.try_to_timestamp(c).isNotNull()


def event_rules(columns: list[str], vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> Column:
    """The names of all rules that an event breaks. columns: those it has, of time, event_type, origin, evidence (required),
    created_by, outcome, confidence, judgement, wrong_cause, hypothesis, probe, tutor_action and hint_level."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("string")
    given = lambda n: c(n).isNotNull()
    machine = F.coalesce(c("origin") == MACHINE, F.lit(False))
    other = ~F.coalesce(c("event_type") == ATTEMPT, F.lit(False))
    checks = {
        "missing_time": blank(c("time")), "bad_time": ~blank(c("time")) & ~F.coalesce(valid_time(c("time")), F.lit(False)),
        "missing_type": ~given("event_type"), "missing_origin": ~given("origin"), "no_evidence": blank(c("evidence")),
        **{f"bad_{n}": given(n) & ~c(n).isin(*known) for n, known in vocabulary.items()},
        "machine_writes_other_event": machine & other,
        "machine_writes_forbidden": machine & F.exists(F.array(*[given(n) for n in MACHINE_FORBIDDEN]), lambda x: x),
        "judgement_on_non_attempt": given("judgement") & other, "cause_on_non_attempt": given("wrong_cause") & other,
        "hypothesis_without_confidence": ~blank(c("hypothesis")) & blank(c("confidence")), "hypothesis_without_probe": ~blank(c("hypothesis")) & blank(c("probe")),
    }
    return F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in checks.items()]), lambda x: x.isNotNull())


def event_issues(df: DataFrame, key: str = "event_id", vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> DataFrame:
    """key, rule: one row per finding, from one pass over the events."""
    return df.select(key, F.explode(event_rules(df.columns, vocabulary)).alias("rule"))


def ref_issues(refs: DataFrame, targets: DataFrame, headings: DataFrame, key: str = "event_id") -> DataFrame:
    """key, ref, issue of source references (key, ref) that are no link, lead nowhere, or to a heading that isn't there.

    targets: path; headings: path, heading. A link within the own page (#heading) is not followed."""
    from .integrity import resolve_links

    inner = F.regexp_extract(F.trim("ref"), r"^!?\[\[([^\]]+)\]\]$", 1)
    d = refs.select(key, "ref", F.trim(F.split_part(inner, F.lit("|"), F.lit(1))).alias("__link"))
    d = d.select(key, "ref", "__link", F.split_part("__link", F.lit("#"), F.lit(1)).alias("target"), F.nullif(F.split_part("__link", F.lit("#"), F.lit(2)), F.lit("")).alias("heading"))
    d = resolve_links(d, targets)
    known = headings.select(F.regexp_replace("path", r"\.md$", "").alias("target"), "heading", F.lit(True).alias("__has")).distinct()
    d = d.withColumn("target", F.regexp_replace("target", r"\.md$", "")).join(known, ["target", "heading"], "left")
    issue = (
        F.when(F.col("__link") == "", "no_link").when(F.col("__link").startswith("#"), None).when(F.col("how") == "broken", "broken")
        .when(F.col("heading").isNotNull() & F.col("__has").isNull(), "no_heading")
    )
    return d.select(key, "ref", issue.alias("issue")).where("issue IS NOT NULL")


def unresolved_refs(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """refs (with key) that no row of known has."""
    return refs.join(known.select(key).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, key: list[Column], position: str) -> DataFrame:
    """df with first (position of the key's first row), for the rows after it."""
    first = F.min(position).over(Window.partitionBy(*key))
    return df.withColumn("first", first).where(F.col(position) > F.col("first"))


def line_ranges(raw: Column) -> Column:
    """``a-b, c-d`` as an array of (start, end); null if any part isn't a range from 1 on."""
    parts = F.transform(F.split(raw, ","), lambda p: F.trim(p))
    ok = F.forall(parts, lambda p: p.rlike(r"^\d+-\d+$"))
    got = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int").alias("start"), F.split_part(p, F.lit("-"), F.lit(2)).try_cast("int").alias("end")))
    return F.when(ok & F.forall(got, lambda r: (r["start"] >= 1) & (r["end"] >= r["start"])), got)


def latest_state(updates: DataFrame, key: str, *fields: str) -> DataFrame:
    """key and the fields of its newest update (ts, then event_id)."""
    return updates.groupBy(key).agg(*[F.max_by(f, F.struct("ts", "event_id")).alias(f) for f in fields])


def progress_deltas(snapshots: DataFrame, keys: list[str], order: list[str], value: str, run: str) -> DataFrame:
    """snapshots with status against the one before: first, other_run, advanced or stalled, and the delta."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = snapshots.withColumn("delta", F.col(value) - F.lag(value).over(w)).withColumn("before", F.lag(run).over(w))
    status = F.when(F.col("delta").isNull(), "first").when(F.col("before") != F.col(run), "other_run").when(F.col("delta") > 0, "advanced").otherwise("stalled")
    return d.withColumn("status", status).withColumn("delta", F.when(F.col("before") == F.col(run), F.col("delta"))).drop("before")


def snapshot_triggers(events: DataFrame) -> DataFrame:
    """learner, item_type, repeated (an error again), repaired (right after an error), answered (right after a probe)."""
    w = Window.partitionBy("learner", "item_type").orderBy("ts", "event_id")
    before = F.lag("judgement").over(w)
    bad = lambda c: c.isin("WRONG", "BLANK")
    d = events.withColumn("before", before)
    return d.groupBy("learner", "item_type").agg(
        F.count_if(bad(F.col("judgement")) & bad(F.col("before"))).alias("repeated"), F.count_if((F.col("judgement") == "OK") & bad(F.col("before"))).alias("repaired"),
        F.count_if((F.col("judgement") == "OK") & (F.col("before") == "STUCK")).alias("answered"),
    )
