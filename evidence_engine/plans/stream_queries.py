"""Streaming queries: each drains the event table through a stream and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..streaming import streams as S
from ..streaming.batches import Batch
from ..streaming.key_index import read_ledger
from .bindings import LEDGER_SQL, ledger
from .ledger_queries import EV, EVENT_VOCABULARY, MASTERY_SQL, _events
from .registry import Registry
from .scratch import scratch

query = Registry()
W = f"WITH {LEDGER_SQL}"


def _source(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    """rows as a stream of files, and a scratch folder for its results."""
    where = scratch(spark)
    rows.repartition(4, "event_id").write.parquet(f"{where}/source")
    return S.read_stream(spark, f"{where}/source", rows.schema, files_per_batch=2), where


@query(W + " SELECT DISTINCT learner || '|' || event_type || '|' || CAST(ts AS DATE) || '|' || k AS signature FROM ledger")
def str1_stream_ledger(spark, d):
    """Into a ledger that append_new has begun, by one checkpoint to the middle and by a new one over all rows."""
    rows = ledger(spark, d).select("event_id", F.concat_ws("|", "learner", "event_type", F.to_date("ts"), "k").alias("signature"))
    stream, where = _source(spark, rows)
    L.append_new(rows.limit(0), rows.where("event_id % 5 = 0")).write.parquet(f"{where}/ledger/first")
    rows.where("event_id % 2 = 0").repartition(2, "event_id").write.parquet(f"{where}/half")
    S.stream_ledger(S.read_stream(spark, f"{where}/half", rows.schema), f"{where}/ledger", f"{where}/lost")
    S.stream_ledger(stream, f"{where}/ledger", f"{where}/checkpoint")
    return read_ledger(spark, f"{where}/ledger").select("signature")


@query(W + " SELECT event_id, learner % 10 AS batch_id FROM ledger")
def str2_batch_append(spark, d):
    """All batches appended, and some of them again."""
    where = scratch(spark)
    rows = ledger(spark, d).select("event_id", (F.col("learner") % 10).alias("batch_id"))
    S.append_batches(rows, f"{where}/ledger")
    S.append_batches(rows.where("batch_id < 4"), f"{where}/ledger")
    return spark.read.parquet(f"{where}/ledger").select("event_id", F.col("batch_id").cast("long").alias("batch_id"))


@query(W + " SELECT event_id, learner % 3 AS batch, CASE learner % 3 WHEN 0 THEN 'appended,skipped' WHEN 1 THEN 'appended' ELSE 'resumed' END AS told, true AS archived FROM ledger")
def str2_batch_journal(spark, d):
    """Three batches of files of events: one that comes again, one that comes once, and one that stopped after a file had moved. archived:
    whether the event stands in the archived files, from which nothing may be missing."""
    where = scratch(spark)
    rows = ledger(spark, d).select("event_id", (F.col("learner") % 3).alias("b"))
    rows.repartition(4, "event_id").write.partitionBy("b").parquet(f"{where}/inbox")
    read = lambda paths: spark.read.schema("event_id long").parquet(*paths)

    def batch(b: int) -> tuple[Batch, list[str]]:
        out = Batch(spark, f"{where}/journal", f"b{b}", inbox=f"{where}/inbox", archive=f"{where}/archive", ledger=f"{where}/ledger")
        return out, [f"{where}/inbox/b={b}/{n}" for n in out.store.names(f"{where}/inbox/b={b}")]

    broken, files = batch(2)
    broken.prepare(files)
    broken.append(read(files))
    broken.move(0)
    told: dict[int, list[str]] = {0: [], 1: [], 2: []}
    known = {b: batch(b)[1] for b in told}
    for b in (0, 1, 2, 0):
        told[b].append(batch(b)[0].run(known[b], read))
    said = F.element_at(F.create_map(*[F.lit(x) for b, t in told.items() for x in (b, ",".join(t))]), F.col("batch"))
    kept = read_ledger(spark, f"{where}/ledger").where("batch_row > 0").select("event_id", F.substring("batch_id", 2, 1).cast("long").alias("batch"))
    there = spark.read.schema("event_id long").option("recursiveFileLookup", "true").parquet(f"{where}/archive").select("event_id", F.lit(True).alias("there"))
    return kept.withColumn("told", said).join(there, "event_id", "left").withColumn("archived", F.coalesce("there", F.lit(False))).drop("there")


@query(W + EV + """ SELECT event_id, NOT (origin NOT IN ('student', 'tutor', 'system') OR trim(evidence) = '' OR (judgement IS NOT NULL AND event_type <> 'attempt') OR (hypothesis IS NOT NULL AND (confidence IS NULL OR probe IS NULL))) AS good FROM ev""")
def str3_stream_validated(spark, d):
    stream, where = _source(spark, _events(spark, d))
    S.stream_validated(stream, f"{where}/good", f"{where}/bad", f"{where}/checkpoint", EVENT_VOCABULARY)
    sink = lambda n, ok: spark.read.parquet(f"{where}/{n}").select("event_id", F.lit(ok).alias("good"))
    return sink("good", True).unionByName(sink("bad", False))


@query(MASTERY_SQL)
def str4_stream_mastery(spark, d):
    stream, where = _source(spark, ledger(spark, d).select("event_id", "ts", "learner", "item_type", "judgement"))
    S.stream_mastery(stream, f"{where}/out", f"{where}/checkpoint")
    return S.latest_mastery(spark, f"{where}/out")


@query(W + " SELECT learner AS job, max_by(event_type, (ts, event_id)) AS state FROM ledger GROUP BY learner")
def str5_job_states(spark, d):
    rows = ledger(spark, d).select("event_id", "ts", F.col("learner").alias("job"), F.col("event_type").alias("state"))
    stream, where = _source(spark, rows)
    S.stream_job_states(stream, f"{where}/out", f"{where}/checkpoint")
    return spark.read.parquet(f"{where}/out").groupBy("job").agg(F.max_by("state", F.struct("ts", "event_id", "version")).alias("state"))


@query(W + ", l AS (SELECT learner, event_id, value, k // 50 AS run, lag(value) OVER w AS was, lag(k // 50) OVER w AS ran FROM ledger WINDOW w AS (PARTITION BY learner ORDER BY ts, event_id)) SELECT learner, event_id, CASE WHEN was IS NULL THEN 'first' WHEN ran <> run THEN 'other_run' WHEN value > was THEN 'advanced' ELSE 'stalled' END AS status FROM l")
def str6_stream_progress(spark, d):
    rows = ledger(spark, d).select("learner", "event_id", "ts", "value", F.floor(F.col("k") / 50).alias("run"))
    stream, where = _source(spark, rows)
    # files hold rows of all days, so the delay covers the table's span
    S.stream_progress(stream, f"{where}/out", f"{where}/checkpoint", ["learner"], ["ts", "event_id"], "value", "run", delay="60 days")
    return S.latest_progress(spark, f"{where}/out", ["learner", "event_id"]).select("learner", "event_id", "status")


@query(W + " SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM ledger GROUP BY CAST(ts AS DATE), event_type")
def str7_stream_windows(spark, d):
    # files hold rows of all days, so the delay covers the table's span
    stream, where = _source(spark, ledger(spark, d).select("event_id", "ts", "event_type"))
    S.stream_windows(stream, f"{where}/out", f"{where}/checkpoint", delay="60 days")
    return S.latest_windows(spark, f"{where}/out").select(F.to_date("start").cast("string").alias("day"), "event_type", "n")


QUERIES, ORACLES = query.queries, query.oracles
