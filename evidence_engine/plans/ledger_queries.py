"""Queries over the event ledger and over jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators import jobs as J
from ..operators import ledger as L
from ..operators import mastery as M
from .bindings import LEDGER_SQL, ledger, table
from .registry import Registry
from .scratch import scratch

query = Registry()
W = f"WITH {LEDGER_SQL}"
SLIM = "event_id, learner, item_type, judgement"


@query(W + ", a AS (SELECT event_id, CAST(ts AS DATE) AS day, item_type, judgement, CASE WHEN judgement IN ('WRONG', 'BLANK') THEN 'CONCEPT' END AS cause FROM ledger) SELECT judgement, cause, count(*) AS n, count(DISTINCT day) AS days FROM a GROUP BY judgement, cause")
def src3_attempt_log(spark, d):
    """The ledger as a log table in files, with other lines between its rows, read back."""
    from ..sources.files import attempt_log, read_texts

    cause = F.when(F.col("judgement").isin(*M.RED), " CONCEPT ").otherwise(" ")
    row = F.concat(F.lit("| "), F.to_date("ts").cast("string"), F.lit(" | Q"), F.col("item_type").cast("string"), F.lit(" | "), "judgement", F.lit(" |"), cause, F.lit("| a \\| b | |\n| date | no row |"))
    where = scratch(spark)
    ledger(spark, d).select(row.alias("value")).write.text(where)
    a = attempt_log(read_texts(spark, where, "*.txt")).withColumnRenamed("wrong_cause", "cause")
    return a.groupBy("judgement", "cause").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"))


@query(W + " SELECT event_id, k, event_id % 20 <> 0 AS parsed FROM (SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN k END AS k FROM ledger)")
def src4_event_lines(spark, d):
    from ..sources.files import event_lines

    raw = table(spark, d, "events").select(F.col("event_id").cast("string").alias("file"), F.when(F.col("event_id") % 20 == 0, F.concat(F.lit("broken "), "props")).otherwise(F.col("props")).alias("text"))
    return event_lines(raw, "k int").select(F.col("file").cast("long").alias("event_id"), "event.k", F.col("event").isNotNull().alias("parsed"))


def _events(spark, d):
    e = ledger(spark, d)
    origin = F.when(F.col("event_id") % 4 == 0, " ").when(F.col("event_id") % 4 == 1, "student").when(F.col("event_id") % 4 == 2, "tutor").otherwise("robot")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.when(F.col("event_id") % 3 == 0, "attempt").otherwise("note").alias("event_type"), origin.alias("origin"),
        F.when(F.col("k") != 5, F.concat(F.lit("k"), F.col("k").cast("string"))).otherwise(" ").alias("evidence"), F.when(F.col("event_id") % 5 < 3, F.col("judgement")).alias("judgement"),
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("h"), F.col("k").cast("string"))).alias("hypothesis"), F.when(F.col("k") % 14 == 0, "high").alias("confidence"),
        F.when(F.col("event_id") % 2 == 0, "probe").alias("probe"), F.lit(None).cast("string").alias("created_by"), F.lit(None).cast("string").alias("outcome"), "ts", "learner",
    )


EV = """, ev AS (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, CASE WHEN event_id % 3 = 0 THEN 'attempt' ELSE 'note' END AS event_type,
    CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'student' WHEN 2 THEN 'tutor' ELSE 'robot' END AS origin, CASE WHEN k <> 5 THEN 'k' || k ELSE ' ' END AS evidence,
    CASE WHEN event_id % 5 < 3 THEN judgement END AS judgement, CASE WHEN k % 7 = 0 THEN 'h' || k END AS hypothesis, CASE WHEN k % 14 = 0 THEN 'high' END AS confidence,
    CASE WHEN event_id % 2 = 0 THEN 'probe' END AS probe, ts, learner FROM ledger)"""


@query(W + """, e AS (SELECT event_id, CASE event_id % 4 WHEN 1 THEN 's3' WHEN 2 THEN 'manual' WHEN 3 THEN 's10' END AS origin, CASE WHEN k % 5 = 0 THEN 'subagent' END AS writer, CASE WHEN k % 3 = 0 THEN 'deferred' END AS outcome FROM ledger)
SELECT event_id, coalesce(origin, 's10') AS origin, coalesce(writer, CASE coalesce(origin, 's10') WHEN 's10' THEN 'main_agent' WHEN 's3' THEN 'script' ELSE 'user' END) AS created_by, coalesce(outcome, 'observed') AS outcome, 0::BIGINT AS findings FROM e""")
def prj26_event_defaults(spark, d):
    """Sound events with some fields left out; with defaults they break no rule."""
    i, k = F.col("event_id"), F.col("k")
    e = ledger(spark, d).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.lit("attempt").alias("event_type"), F.lit("e").alias("evidence"),
        F.when(i % 4 == 1, "s3").when(i % 4 == 2, "manual").when(i % 4 == 3, "s10").alias("origin"), F.when(k % 5 == 0, "subagent").alias("created_by"), F.when(k % 3 == 0, "deferred").alias("outcome"),
    )
    d = L.normalize_events(e)
    return d.select("event_id", "origin", "created_by", "outcome", F.size(L.event_rules(d.columns)).cast("long").alias("findings"))


@query(W + " SELECT event_id, substr(sha256(array_to_string([event_type, CAST(learner AS VARCHAR), '', CAST(k AS VARCHAR), ''], '␟')), 1, 16) AS signature FROM ledger")
def prj27_signature(spark, d):
    """Events with an anchor and evidence, and neither hypothesis nor probe."""
    e = ledger(spark, d).select("event_id", "event_type", F.col("learner").alias("anchor"), F.col("k").alias("evidence"))
    return e.select("event_id", L.event_signature(e.columns).alias("signature"))


@query(W + """ SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || '-' || substr(sha256('{"event_type":"' || event_type || '","k":' || k || '}'), 1, 6) AS identity FROM ledger""")
def prj28_event_id(spark, d):
    return ledger(spark, d).select("event_id", L.event_identity(F.col("ts"), F.to_json(F.struct("event_type", "k"))).alias("identity"))


SIG = ", s AS (SELECT *, learner || '|' || event_type || '|' || CAST(ts AS DATE) || '|' || k AS sig FROM ledger)"


def _signed(spark, d):
    return ledger(spark, d).withColumn("signature", F.concat_ws("|", "learner", "event_type", F.to_date("ts"), "k"))


@query(W + SIG + ", old AS (SELECT DISTINCT sig FROM s WHERE event_id % 2 = 0) SELECT DISTINCT sig AS signature FROM s WHERE event_id % 2 = 1 AND sig NOT IN (SELECT sig FROM old)")
def snk3_append_new(spark, d):
    s = _signed(spark, d)
    return L.append_new(s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1")).select("signature")


@query(W + ", r AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN k || '-' || (k + 5) || ', ' || (k + 9) || '-' || (k + 4 + event_id % 10) ELSE (k + 1) || '-' || (k + 3) END AS raw, k FROM ledger) SELECT event_id, CASE WHEN k % 3 <> 0 THEN 1 WHEN k < 1 OR 4 + event_id % 10 < 9 THEN NULL ELSE 2 END AS n, CASE WHEN k % 3 <> 0 THEN k + 1 WHEN k < 1 OR 4 + event_id % 10 < 9 THEN NULL ELSE k END AS first FROM r")
def prj15_line_ranges(spark, d):
    s = lambda c: c.cast("string")
    k = F.col("k")
    raw = F.when(k % 3 == 0, F.concat(s(k), F.lit("-"), s(k + 5), F.lit(", "), s(k + 9), F.lit("-"), s(k + 4 + F.col("event_id") % 10))).otherwise(F.concat(s(k + 1), F.lit("-"), s(k + 3)))
    e = ledger(spark, d).select("event_id", L.line_ranges(raw).alias("r"))
    return e.select("event_id", F.when(F.col("r").isNotNull(), F.size("r")).alias("n"), F.get("r", F.lit(0))["start"].alias("first"))


@query(W + " SELECT event_id, judgement IN ('OK', 'SLOW') AND event_type IN ('purchase', 'view', 'click') AS known FROM ledger")
def flt5_vocabulary(spark, d):
    words = {"judgement": ("OK", "SLOW"), "event_type": ("purchase", "view", "click")}
    return ledger(spark, d).select("event_id", L.in_vocabulary({n: F.col(n) for n in words}, words).alias("known"))


@query(W + EV + " SELECT event_id FROM ev WHERE trim(evidence) = ''")
def flt6_blank_evidence(spark, d):
    return _events(spark, d).where(L.blank(F.col("evidence"))).select("event_id")


@query(W + EV + ", t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN time WHEN 1 THEN replace(time, '-', '/') ELSE substr(time, 1, 5) || '13' || substr(time, 8) END AS t FROM ev) SELECT event_id, event_id % 3 = 0 AS valid FROM t")
def flt7_iso_time(spark, d):
    i, t = F.col("event_id") % 3, F.col("time")
    text = F.when(i == 0, t).when(i == 1, F.replace(t, F.lit("-"), F.lit("/"))).otherwise(F.concat(F.substring(t, 1, 5), F.lit("13"), F.substr(t, F.lit(8))))
    return _events(spark, d).select("event_id", F.coalesce(L.valid_time(text), F.lit(False)).alias("valid"))


@query(W + ", b AS (SELECT DISTINCT item_type FROM ledger WHERE k % 4 = 0) SELECT DISTINCT item_type FROM ledger WHERE judgement = 'WRONG' AND k > 50 AND item_type IN (SELECT item_type FROM b)")
def jon16_stubborn_points(spark, d):
    e = ledger(spark, d)
    return M.stubborn(e.where("k > 50").withColumn("cause", F.when(F.col("judgement") == "WRONG", "CONCEPT")), e.where("k % 4 = 0"))


@query(W + " SELECT DISTINCT item_type FROM ledger WHERE k > 90 AND item_type NOT IN (SELECT item_type FROM ledger WHERE learner = 7 AND k > 70)")
def jon17_untested_blockers(spark, d):
    e = ledger(spark, d)
    return M.untested(e.where("k > 90"), e.where("learner = 7 AND k > 70"))


@query(W + ", e AS (SELECT judgement AS cause, item_type, learner FROM ledger WHERE judgement IN ('WRONG', 'BLANK', 'SLOW', 'STUCK')) SELECT cause, item_type, learner, grouping(cause, item_type, learner) AS level, count(*) AS n, count(*) < 30 AS few FROM e GROUP BY GROUPING SETS ((cause), (cause, item_type), (cause, learner))")
def agg17_error_stats(spark, d):
    return M.error_stats(ledger(spark, d).withColumn("why", F.col("judgement")), "why", "item_type", "learner")


@query(W + EV + ", g AS (SELECT learner, hypothesis, count(*) AS times, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS evidence, max_by(coalesce(probe, ''), (ts, event_id)) AS latest_probe, max_by(coalesce(confidence, ''), (ts, event_id)) AS confidence FROM ev WHERE hypothesis IS NOT NULL GROUP BY learner, hypothesis) SELECT * FROM g WHERE times >= 2")
def agg18_hypotheses(spark, d):
    h = M.hypotheses(_events(spark, d).na.fill("", ["probe", "confidence"]))
    return h.select("learner", "hypothesis", "times", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"), "latest_probe", "confidence")


@query(W + " SELECT learner, count(*) FILTER (WHERE judgement = 'OK') AS completed, count(DISTINCT k) AS pages, CAST(sum(CASE WHEN judgement = 'STUCK' THEN 1 ELSE 0 END) AS BIGINT) AS blockers FROM ledger GROUP BY learner")
def agg19_progress(spark, d):
    s = ledger(spark, d).select("learner", (F.col("judgement") == "OK").alias("done"), F.array("k").alias("pages"), (F.col("judgement") == "STUCK").cast("int").alias("n_blockers"))
    return J.progress(s, "learner")


@query(W + ", r AS (SELECT learner, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS total FROM ledger GROUP BY learner) SELECT *, round(failed / total, 4) AS ratio, CASE WHEN round(failed / total, 4) > 0.2::DOUBLE THEN 'rerun' ELSE 'accept' END AS recommendation FROM r")
def agg20_failure_report(spark, d):
    return J.failure_report(ledger(spark, d).withColumn("failed", F.col("event_type") == "error"), "learner")


@query(W + ", w AS (SELECT *, learner || '/' || event_type || '/' || CAST(ts AS DATE) || '/' || k AS key FROM ledger), f AS (SELECT event_id, key, min(event_id) OVER (PARTITION BY key) AS first FROM w) SELECT event_id, first FROM f WHERE event_id > first")
def win8_duplicate_keys(spark, d):
    e = ledger(spark, d).select("event_id", F.concat_ws("/", "learner", "event_type", F.to_date("ts"), "k").alias("key"))
    return L.duplicate_keys(e, [F.col("key")], "event_id").select("event_id", "first")


@query(W + ", s AS (SELECT learner, event_type, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM ledger WINDOW w AS (PARTITION BY learner ORDER BY ts, event_id)) SELECT learner, count(*) FILTER (WHERE event_type = 'view' AND b = 'click' AND c = 'purchase') AS n FROM s GROUP BY learner")
def win10_fixed_sequence(spark, d):
    from ..operators.textlint import sequence_count

    return sequence_count(ledger(spark, d), ["learner"], ["ts", "event_id"], "event_type", ["view", "click", "purchase"])


LAST2 = ", a AS (SELECT *, row_number() OVER (PARTITION BY learner, item_type ORDER BY ts DESC, event_id DESC) AS back FROM ledger)"
MASTERY_SQL = W + LAST2 + """ SELECT learner, item_type, CASE WHEN bool_or(back = 1 AND judgement IN ('WRONG', 'BLANK')) THEN 'red'
 WHEN count(*) FILTER (WHERE back <= 2 AND judgement = 'OK') = 2 AND count(DISTINCT CASE WHEN back <= 2 THEN CAST(ts AS DATE) END) = 2 THEN 'green' ELSE 'yellow' END AS colour, count(*) AS attempts FROM a GROUP BY learner, item_type"""


@query(MASTERY_SQL)
def win15_mastery(spark, d):
    return M.mastery(ledger(spark, d), ["learner", "item_type"])


@query(W + """, s AS (SELECT learner, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE judgement = 'OK') AS done, month(min(ts)) * 10 + day(min(ts)) // 10 AS run FROM ledger GROUP BY learner, CAST(ts AS DATE)),
 l AS (SELECT *, lag(done) OVER w AS was, lag(run) OVER w AS ran FROM s WINDOW w AS (PARTITION BY learner ORDER BY day))
 SELECT learner, day, done, CASE WHEN ran = run THEN done - was END AS delta, CASE WHEN was IS NULL THEN 'first' WHEN ran <> run THEN 'other_run' WHEN done > was THEN 'advanced' ELSE 'stalled' END AS status FROM l""")
def win16_progress_delta(spark, d):
    run = F.month(F.min("ts")) * 10 + F.floor(F.dayofmonth(F.min("ts")) / 10)
    s = ledger(spark, d).groupBy("learner", F.to_date("ts").alias("day")).agg(F.count_if(F.col("judgement") == "OK").alias("done"), run.alias("run"))
    return L.progress_deltas(s, ["learner"], ["day"], "done", "run").select("learner", "day", "done", "delta", "status")


@query(W + EV + " SELECT event_id, array_to_string(list_filter([CASE WHEN probe IS NULL THEN 'probe' END, CASE WHEN hypothesis IS NULL THEN 'hypothesis' END], lambda x: x IS NOT NULL), ',') AS missing FROM ev")
def set2_missing_fields(spark, d):
    row = {n: F.col(n) for n in ("time", "probe", "hypothesis")}
    return _events(spark, d).select("event_id", F.array_join(L.missing_fields(row, ["time", "probe", "hypothesis"]), ",").alias("missing"))


@query(W + EV + " SELECT event_id, array_to_string(list_filter([CASE WHEN judgement IS NOT NULL THEN 'judgement' END, CASE WHEN confidence IS NOT NULL THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS forbidden FROM ev")
def set3_forbidden_fields(spark, d):
    row = {n: F.col(n) for n in ("time", "judgement", "confidence")}
    return _events(spark, d).select("event_id", F.array_join(L.forbidden_fields(row, ["judgement", "confidence"]), ",").alias("forbidden"))


CODES = {"resplit": list(range(0, 20)), "permanent": list(range(20, 30)), "retry": list(range(30, 45))}
MARKERS = {"resplit": ["click"], "retry": ["view"]}
CLASS_SQL = "CASE WHEN k < 20 THEN 'resplit' WHEN k < 30 THEN 'permanent' WHEN k < 45 THEN 'retry' WHEN event_type = 'click' THEN 'resplit' WHEN event_type = 'view' THEN 'retry' ELSE 'unknown' END"


@query(W + f" SELECT event_id, {CLASS_SQL} AS kind FROM ledger")
def cls5_failure_class(spark, d):
    return ledger(spark, d).select("event_id", J.failure_class(F.col("k"), F.upper("event_type"), CODES, MARKERS).alias("kind"))


@query(W + f", c AS (SELECT event_id, {CLASS_SQL} AS kind, 1 + event_id % 3 AS pages, event_id % 4 AS attempts FROM ledger) SELECT event_id, CASE WHEN kind = 'resplit' AND pages > 1 THEN 'resplit' WHEN kind IN ('retry', 'unknown') AND attempts < 2 THEN 'retry' ELSE 'final-failed' END AS action FROM c")
def cls6_next_action(spark, d):
    e = ledger(spark, d).withColumn("kind", J.failure_class(F.col("k"), F.upper("event_type"), CODES, MARKERS))
    return e.select("event_id", J.next_action(F.col("kind"), 1 + F.col("event_id") % 3, F.col("event_id") % 4).alias("action"))


@query(W + " SELECT event_id, CASE judgement WHEN 'WRONG' THEN 'redo,review' WHEN 'BLANK' THEN 'starter' WHEN 'STUCK' THEN 'hint' WHEN 'SLOW' THEN 'timed' ELSE '' END AS actions FROM ledger")
def cls7_cause_actions(spark, d):
    plan = {"WRONG": ["redo", "review"], "BLANK": ["starter"], "STUCK": ["hint"], "SLOW": ["timed"]}
    return ledger(spark, d).select("event_id", F.array_join(M.cause_actions(F.col("judgement"), plan), ",").alias("actions"))


@query(W + ", s AS (SELECT *, lag(judgement) OVER (PARTITION BY learner, item_type ORDER BY ts, event_id) AS before FROM ledger) SELECT learner, item_type, count(*) FILTER (WHERE judgement IN ('WRONG', 'BLANK') AND before IN ('WRONG', 'BLANK')) AS repeated, count(*) FILTER (WHERE judgement = 'OK' AND before IN ('WRONG', 'BLANK')) AS repaired, count(*) FILTER (WHERE judgement = 'OK' AND before = 'STUCK') AS answered FROM s GROUP BY learner, item_type")
def cls9_snapshot_triggers(spark, d):
    return L.snapshot_triggers(ledger(spark, d))


#: The vocabularies of events on the given tables.
EVENT_VOCABULARY = {
    "event_type": ("attempt", "note", "probe"), "origin": ("student", "tutor", "system", "s3"), "created_by": ("agent", "student"), "outcome": ("recorded", "observed"),
    "confidence": ("high",), "judgement": ("OK", "SLOW", "STUCK", "WRONG", "BLANK"), "wrong_cause": ("CONCEPT",),
}


def _full_events(spark, d):
    """Events with all fields that rules look at."""
    i, k, c = F.col("event_id"), F.col("k"), F.col
    return ledger(spark, d).select(
        "event_id", F.when(k % 13 == 0, "yesterday").when(k % 17 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"),
        F.when(i % 3 == 0, "attempt").when(i % 3 == 1, "probe").when(k % 4 == 0, "gossip").when(k % 4 == 1, None).otherwise("note").alias("event_type"),
        F.when(i % 5 == 0, " ").when(i % 5 == 1, "s3").when(i % 5 == 2, "tutor").when(i % 5 == 3, "robot").alias("origin"), F.when(k != 5, F.concat(F.lit("k"), k.cast("string"))).otherwise(" ").alias("evidence"),
        F.when(i % 4 == 0, "agent").when(i % 4 == 1, "robot").alias("created_by"), F.when(k % 8 == 0, "lost").when(k % 8 == 1, "observed").alias("outcome"),
        F.when(k % 14 == 0, "high").when(k % 14 == 7, "sure").alias("confidence"), F.when(i % 7 == 0, "HM").when(i % 7 < 4, c("judgement")).alias("judgement"),
        F.when(k % 9 == 0, "CONCEPT").when(k % 9 == 1, "odd").alias("wrong_cause"), F.when(k % 7 == 0, "h").alias("hypothesis"), F.when(i % 2 == 0, "p").alias("probe"), F.when(k % 11 == 0, "hint").alias("tutor_action"),
    )


FULL_EVENTS_SQL = """, ev AS (SELECT event_id, CASE WHEN k % 13 = 0 THEN 'yesterday' WHEN k % 17 <> 0 THEN 'ok' END AS time,
 CASE WHEN event_id % 3 = 0 THEN 'attempt' WHEN event_id % 3 = 1 THEN 'probe' WHEN k % 4 = 0 THEN 'gossip' WHEN k % 4 = 1 THEN NULL ELSE 'note' END AS event_type,
 CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 's3' WHEN 2 THEN 'tutor' WHEN 3 THEN 'robot' END AS origin, k,
 CASE event_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'robot' END AS created_by, CASE k % 8 WHEN 0 THEN 'lost' WHEN 1 THEN 'observed' END AS outcome, CASE k % 14 WHEN 0 THEN 'high' WHEN 7 THEN 'sure' END AS confidence,
 CASE WHEN event_id % 7 = 0 THEN 'HM' WHEN event_id % 7 < 4 THEN judgement END AS judgement, CASE k % 9 WHEN 0 THEN 'CONCEPT' WHEN 1 THEN 'odd' END AS cause,
 k % 7 = 0 AS hyp, event_id % 2 = 0 AS probe, k % 11 = 0 AS action FROM ledger),
i AS (SELECT event_id, 'missing_time' AS rule FROM ev WHERE time IS NULL UNION ALL SELECT event_id, 'bad_time' FROM ev WHERE time = 'yesterday'
 UNION ALL SELECT event_id, 'missing_type' FROM ev WHERE event_type IS NULL UNION ALL SELECT event_id, 'bad_event_type' FROM ev WHERE event_type = 'gossip'
 UNION ALL SELECT event_id, 'missing_origin' FROM ev WHERE origin IS NULL UNION ALL SELECT event_id, 'bad_origin' FROM ev WHERE origin IN (' ', 'robot') UNION ALL SELECT event_id, 'no_evidence' FROM ev WHERE k = 5
 UNION ALL SELECT event_id, 'bad_created_by' FROM ev WHERE created_by = 'robot' UNION ALL SELECT event_id, 'bad_outcome' FROM ev WHERE outcome = 'lost' UNION ALL SELECT event_id, 'bad_confidence' FROM ev WHERE confidence = 'sure'
 UNION ALL SELECT event_id, 'bad_judgement' FROM ev WHERE judgement = 'HM' UNION ALL SELECT event_id, 'bad_wrong_cause' FROM ev WHERE cause = 'odd'
 UNION ALL SELECT event_id, 'machine_writes_other_event' FROM ev WHERE origin = 's3' AND event_type IS DISTINCT FROM 'attempt'
 UNION ALL SELECT event_id, 'machine_writes_forbidden' FROM ev WHERE origin = 's3' AND (hyp OR probe OR action)
 UNION ALL SELECT event_id, 'judgement_on_non_attempt' FROM ev WHERE judgement IS NOT NULL AND event_type IS DISTINCT FROM 'attempt' UNION ALL SELECT event_id, 'cause_on_non_attempt' FROM ev WHERE cause IS NOT NULL AND event_type IS DISTINCT FROM 'attempt'
 UNION ALL SELECT event_id, 'hypothesis_without_confidence' FROM ev WHERE hyp AND confidence IS NULL UNION ALL SELECT event_id, 'hypothesis_without_probe' FROM ev WHERE hyp AND NOT probe)"""


@query(W + FULL_EVENTS_SQL + " SELECT event_id, rule FROM i")
def dq8_all_event_rules(spark, d):
    return L.event_issues(_full_events(spark, d), vocabulary=EVENT_VOCABULARY)


@query(W + """, r AS (SELECT event_id, k, CASE k % 6 WHEN 0 THEN 'no link ' || k WHEN 1 THEN '[[d' || k || ']]' WHEN 2 THEN '![[d' || k || '#part 1|shown]]' WHEN 3 THEN '[[#own]]' WHEN 4 THEN ' [[d' || k || '.md#part 2]] ' ELSE '[[x/d' || k || ']]' END AS ref FROM ledger),
t AS (SELECT doc_id AS k, doc_id % 5 = 0 AS gone, doc_id % 3 = 0 AS headed FROM documents)
SELECT event_id, ref, CASE WHEN r.k % 6 = 0 THEN 'no_link' WHEN r.k % 6 = 3 THEN NULL WHEN r.k % 6 = 5 OR t.k IS NULL OR gone THEN 'broken' WHEN r.k % 6 = 2 AND NOT headed THEN 'no_heading' WHEN r.k % 6 = 4 THEN 'no_heading' END AS issue
FROM r LEFT JOIN t ON t.k = r.k WHERE issue IS NOT NULL""")
def dq8_source_refs(spark, d):
    k = F.col("k").cast("string")
    text = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    kind = F.col("k") % 6
    ref = F.when(kind == 0, text("no link ", k)).when(kind == 1, text("[[d", k, "]]")).when(kind == 2, text("![[d", k, "#part 1|shown]]")).when(kind == 3, "[[#own]]").when(kind == 4, text(" [[d", k, ".md#part 2]] ")).otherwise(text("[[x/d", k, "]]"))
    refs = ledger(spark, d).select("event_id", ref.alias("ref"))
    docs = table(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    headings = docs.where("doc_id % 3 = 0").select("path", F.lit("part 1").alias("heading"))
    return L.ref_issues(refs, docs.select("path"), headings)


@query(W + EV + """, i AS (
 SELECT event_id, 'bad_origin' AS rule FROM ev WHERE origin NOT IN ('student', 'tutor', 'system') UNION ALL SELECT event_id, 'no_evidence' FROM ev WHERE trim(evidence) = ''
 UNION ALL SELECT event_id, 'judgement_on_non_attempt' FROM ev WHERE judgement IS NOT NULL AND event_type <> 'attempt'
 UNION ALL SELECT event_id, 'hypothesis_without_confidence' FROM ev WHERE hypothesis IS NOT NULL AND confidence IS NULL
 UNION ALL SELECT event_id, 'hypothesis_without_probe' FROM ev WHERE hypothesis IS NOT NULL AND probe IS NULL) SELECT event_id, rule FROM i""")
def dq8_event_rules(spark, d):
    return L.event_issues(_events(spark, d).drop("created_by", "outcome"), vocabulary=EVENT_VOCABULARY)


@query(W + """, rec AS (SELECT DISTINCT item_type, CAST(ts AS DATE) AS day FROM ledger WHERE judgement = 'OK' AND k > 60),
l AS (SELECT event_id, item_type, CAST(ts AS DATE) AS day, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'start ' || (item_type + event_id % 3) WHEN 2 THEN 'see ' || CAST(CAST(ts AS DATE) AS VARCHAR) ELSE 'other' END AS text FROM ledger)
SELECT event_id, CASE WHEN text = 'pending' THEN 'pending' WHEN text = 'start ' || item_type THEN 'registered' WHEN event_id % 4 = 2 AND EXISTS (SELECT 1 FROM rec WHERE rec.item_type = l.item_type AND rec.day = l.day) THEN 'cited' ELSE 'unsupported' END AS verdict FROM l""")
def jon8_starter_provenance(spark, d):
    e = ledger(spark, d).withColumn("anchor", F.col("item_type"))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, "pending").when(kind == 1, F.concat(F.lit("start "), (F.col("item_type") + F.col("event_id") % 3).cast("string"))).when(kind == 2, F.concat(F.lit("see "), F.to_date("ts").cast("string"))).otherwise("other")
    known = e.select("anchor").distinct().select("anchor", F.concat(F.lit("start "), F.col("anchor").cast("string")).alias("starter"))
    records = e.where("judgement = 'OK' AND k > 60").select("anchor", F.to_date("ts").alias("day"))
    return I.starter_provenance(e.select("event_id", "anchor", text.alias("text")), known, records).select("event_id", "verdict")


QUERIES, ORACLES = query.queries, query.oracles
