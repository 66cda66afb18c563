"""Ledgers as streams. Each job drains what its source holds and can run again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ledger import VOCABULARY, event_rules
from ..operators.mastery import colour
from .key_index import BUCKETS, KeyIndex, append_fresh


def read_stream(spark: SparkSession, path: str, schema, *, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files below a path, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


#: The store whose state lies on disk, in a memory that all its parts on an executor share.
_STORE = "spark.sql.streaming.stateStore."
ROCKS = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.boundedMemoryUsage": "true", _STORE + "rocksdb.maxMemoryUsageMB": "128",
}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within hold their state in ROCKS."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a checkpoint's query; a new checkpoint has another."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def stream_ledger(stream: DataFrame, ledger: str, checkpoint: str, key: str = "signature", *, sign: Column | None = None, buckets: int = BUCKETS) -> None:
    """Appends rows whose key the ledger doesn't hold, whoever wrote it: another checkpoint, ``append_new``, or a time when rows had no key
    (sign: the key of such rows). An index of keys lies beside the ledger (``key_index``), so no state grows with it, and a batch reads
    the buckets that it touches. An entry's name holds checkpoint and batch: one that runs twice replaces its own entry alone.
    One stream at a time may write a ledger."""
    spark = stream.sparkSession
    index = KeyIndex(spark, ledger, key, sign=sign, buckets=buckets)

    def each(batch: DataFrame, number: int) -> None:
        index.spark = batch.sparkSession
        append_fresh(batch, index, f"batch={run_id(batch.sparkSession, checkpoint)}-{number}")

    drain(stream, checkpoint, each)


def append_batches(rows: DataFrame, ledger: str, batch: str = "batch_id") -> None:
    """Appends each source batch once: its rows go to a partition of their own, which a retry replaces."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(ledger)


def stream_validated(stream: DataFrame, good: str, quarantine: str, checkpoint: str, vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> None:
    """Events that break no rule to one sink, the others with their rules to another."""

    def each(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("rules", event_rules(batch.columns, vocabulary)).persist()
        judged.where(F.size("rules") == 0).drop("rules").write.mode("overwrite").parquet(f"{good}/batch={number}")
        judged.where(F.size("rules") > 0).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        judged.unpersist()

    drain(stream, checkpoint, each)


def stream_windows(stream: DataFrame, out: str, checkpoint: str, *, time: str = "ts", delay: str = "1 day", width: str = "1 day", by: str = "event_type") -> None:
    """Counts per window and value; late rows within the delay still count. Each batch updates its windows' files."""
    counts = stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    rows = counts.select(F.col("window.start").alias("start"), by, "n")

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(rows, checkpoint, each, mode="update")


def latest_windows(spark: SparkSession, out: str, by: str = "event_type") -> DataFrame:
    d = spark.read.parquet(out)
    return d.groupBy("start", by).agg(F.max_by("n", "version").alias("n"))


def stream_mastery(stream: DataFrame, out: str, checkpoint: str) -> None:
    """learner, item_type, colour, attempts as they change. A key's state is the number of its attempts and the last two of them, in an aggregate of
    Spark's own: nothing runs by key in Python, and the state lies on disk."""
    last = InternalFunction.collect_top_k(F.struct("ts", "event_id", "judgement"), 2, False)  # the latest first
    counted = stream.groupBy("learner", "item_type").agg(last.alias("last"), F.count("*").alias("attempts"))
    keyed = counted.select("learner", "item_type", colour(F.get("last", F.lit(0)), F.get("last", F.lit(1))).alias("colour"), "attempts")

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocks(stream.sparkSession):
        drain(keyed, checkpoint, each, mode="update")


def latest_mastery(spark: SparkSession, out: str) -> DataFrame:
    d = spark.read.parquet(out)
    best = F.max_by(F.struct("colour", "attempts"), "version")
    return d.groupBy("learner", "item_type").agg(best.alias("s")).select("learner", "item_type", "s.colour", "s.attempts")


def stream_job_states(stream: DataFrame, out: str, checkpoint: str) -> None:
    """key and state of the newest update per job."""
    newest = stream.groupBy("job").agg(F.max(F.struct("ts", "event_id", "state")).alias("s"))
    rows = newest.select("job", "s.state", "s.ts", "s.event_id")

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(rows, checkpoint, each, mode="update")


def _plain(snapshot) -> tuple:
    """A row's values as Python's own."""
    return tuple(None if x is None or x != x else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in snapshot)


class _Progress(StatefulProcessor):
    """A key's open snapshots (those a late one may still come before) and the last one before them, in order."""

    def __init__(self, schema: StructType, keys: list[str], time: str):
        self.schema, self.keys, self.time = schema, keys, time

    def init(self, handle) -> None:
        self.handle = handle
        self.open, self.before = handle.getListState("open", self.schema), handle.getValueState("before", self.schema)

    def _place(self, snapshot: tuple) -> tuple:
        return snapshot[:-2]  # all but value and run

    def _closed(self, snapshots: list[tuple], watermark: int) -> list[tuple]:
        """Keeps what is open; of the rest only the last counts for what follows."""
        time = self.schema.fieldNames().index(self.time)
        closed = [s for s in snapshots if pd.Timestamp(s[time]).timestamp() * 1000 <= watermark]
        if closed:
            self.before.update(closed[-1])
        return snapshots[len(closed) :]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        names = self.schema.fieldNames()
        known = set(map(_plain, self.open.get()))
        fresh = {_plain(x) for pdf in rows for x in pdf[names].astype(object).itertuples(index=False)} - known
        snapshots = sorted(known | fresh, key=self._place)
        last = _plain(self.before.get()) if self.before.exists() else None
        out = []
        for k, s in enumerate(snapshots):
            was = snapshots[k - 1] if k else last
            if s in fresh or was in fresh:
                same = was is not None and was[-1] == s[-1]
                delta = None if was is None or s[-2] is None or was[-2] is None else s[-2] - was[-2]
                status = "first" if delta is None else "other_run" if not same else "advanced" if delta > 0 else "stalled"
                out.append((*key, *s, delta if same else None, status))
        watermark = timerValues.getCurrentWatermarkInMs()
        left = self._closed(snapshots, watermark)
        self.open.put(left) if left else self.open.clear()
        if left:
            time = names.index(self.time)
            self.handle.registerTimer(int(max(pd.Timestamp(s[time]).timestamp() for s in left) * 1000))
        yield pd.DataFrame(out, columns=[*self.keys, *names, "delta", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        left = self._closed(sorted(map(_plain, self.open.get()), key=self._place), timerValues.getCurrentWatermarkInMs())
        self.open.put(left) if left else self.open.clear()
        yield pd.DataFrame(columns=[*self.keys, *self.schema.fieldNames(), "delta", "status"])

    def close(self) -> None:
        pass


def stream_progress(stream: DataFrame, out: str, checkpoint: str, keys: list[str], order: list[str], value: str, run: str, *, delay: str = "1 day") -> None:
    """Status of each snapshot against the one before (as ``progress_deltas``), in versions: a late snapshot is put between its neighbours,
    and the one after it gets a new status. The first of order is the time. A key's state is its snapshots within the delay and one before, which a timer
    drops, so a batch costs what it touches, not the history. Snapshots later than the delay are left out by the watermark."""
    names = [*order, value, run]
    kind = {f.name: f.dataType for f in stream.schema}
    schema = StructType([StructField(n, kind[n]) for n in names])
    result = StructType([*[StructField(k, kind[k]) for k in keys], *schema.fields, StructField("delta", kind[value]), StructField("status", StringType())])
    rows = stream.select(*keys, *names).withWatermark(order[0], delay).groupBy(*keys)
    changed = rows.transformWithStateInPandas(_Progress(schema, keys, order[0]), result, "update", "eventTime")

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocks(stream.sparkSession):  # the only store that holds lists and timers
        drain(changed, checkpoint, each, mode="update")


def latest_progress(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest status of each snapshot."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct("delta", "status"), "version").alias("s")).select(*keys, "s.delta", "s.status")
