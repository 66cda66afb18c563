"""Ledgers that several writers share, batches that stop anywhere, publishing that can break."""

from __future__ import annotations

import pytest
from evidence_engine.operators import ledger as L
from evidence_engine.sources.store import Store
from evidence_engine.streaming import streams as S
from evidence_engine.streaming.batches import STATES, Batch, BatchError
from evidence_engine.streaming.key_index import KeyIndex, append_fresh, read_ledger
from pyspark.sql import functions as F


def signed(spark, *keys):
    return spark.createDataFrame([(k, f"{k}-{n}") for n, k in enumerate(keys)], "signature string, said string")


def held(spark, ledger):
    return sorted(r["signature"] for r in read_ledger(spark, ledger).collect())


def streamed(spark, tmp_path, name, checkpoint, *keys, **how):
    rows, src = signed(spark, *keys), str(tmp_path / f"source-{name}")
    rows.coalesce(1).write.mode("append").parquet(src)
    S.stream_ledger(S.read_stream(spark, src, rows.schema), str(tmp_path / "ledger"), str(tmp_path / checkpoint), buckets=8, **how)


def test_new_checkpoint_loses_nothing_and_repeats_nothing(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    streamed(spark, tmp_path, "one", "c1", "a", "b", "a")
    streamed(spark, tmp_path, "two", "c2", "a", "c")
    assert held(spark, ledger) == ["a", "b", "c"]
    streamed(spark, tmp_path, "two", "c2", "b", "d")  # the same checkpoint goes on
    assert held(spark, ledger) == ["a", "b", "c", "d"]


def test_ledger_written_by_append_and_rows_without_a_key(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    L.append_new(signed(spark), signed(spark, "a", "b")).write.mode("append").parquet(ledger)  # files at the top
    old = spark.createDataFrame([("x", "1"), ("y", "2")], "kind string, said string")  # from a time without signatures
    old.write.parquet(f"{ledger}/old")
    sign = L.signature(F.col("kind"), F.col("said"))
    rows = spark.createDataFrame([("b", None, None), (None, "x", "1"), (None, "z", "3"), (None, "z", "3")], "signature string, kind string, said string")
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    S.stream_ledger(S.read_stream(spark, str(tmp_path / "src"), rows.schema), ledger, str(tmp_path / "c"), sign=sign, buckets=4)
    got = read_ledger(spark, ledger)
    assert got.count() == 5 and got.where("kind = 'x'").count() == 1 and got.where("kind = 'z'").count() == 1 and got.where("signature = 'b'").count() == 1


def test_an_entry_that_broke_is_replaced_and_one_that_was_complete_stays(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    index = KeyIndex(spark, ledger, buckets=4)
    append_fresh(signed(spark, "a"), index, "e1")
    signed(spark, "torn").write.parquet(f"{ledger}/e2")  # no index part: its writer stopped
    append_fresh(signed(spark, "a", "b"), index, "e2")
    assert held(spark, ledger) == ["a", "b"]
    append_fresh(signed(spark, "a", "b"), index, "e2")
    assert held(spark, ledger) == ["a", "b"]
    Store(spark, ledger).delete(f"{ledger}/_keys")  # a lost index is built again
    append_fresh(signed(spark, "b", "c"), KeyIndex(spark, ledger, buckets=4), "e3")
    assert held(spark, ledger) == ["a", "b", "c"]
    index.merge()
    assert len(index._parts()) == 1
    append_fresh(signed(spark, "c", "d"), index, "e4")
    assert held(spark, ledger) == ["a", "b", "c", "d"]


def test_key_index_against_a_set(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    index = KeyIndex(spark, ledger, buckets=16)
    for k in range(3):
        spark.range(1000 * k, 1000 * k + 500).select(F.concat(F.lit("k"), "id").alias("signature")).write.parquet(f"{ledger}/e{k}")
    assert index.catch_up() == ["e0", "e1", "e2"] and index.catch_up() == []
    asked = spark.range(0, 5000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    assert {r["key"] for r in index.known(asked).collect()} == {f"k{i}" for i in range(0, 5000, 7) if i % 1000 < 500 and i < 2500}


# batches of files


def make(spark, tmp_path, name="b1", n=3):
    inbox = tmp_path / "inbox"
    inbox.mkdir(exist_ok=True)
    paths = []
    for k in range(n):
        p = inbox / f"{name}-{k}.txt"
        p.write_text(f"{name} row {k}\n")
        paths.append(str(p))
    return Batch(spark, str(tmp_path / "journal"), name, inbox=str(inbox), archive=str(tmp_path / "archive"), ledger=str(tmp_path / "ledger")), paths


def rows_of(spark):
    return lambda paths: spark.read.text(paths).select(F.col("value").alias("said"))


def said(spark, tmp_path):
    return sorted(r["said"] for r in read_ledger(spark, str(tmp_path / "ledger")).where("batch_row > 0").collect())


@pytest.mark.parametrize("stop", range(6))
def test_batch_resumes_after_every_stop(spark, tmp_path, stop):
    """It stops after prepare, half an append, append, a move without its note, a move, and all moves."""
    batch, paths = make(spark, tmp_path)
    batch.prepare(paths)
    with pytest.raises(BatchError):
        batch.verify()
    if stop == 1:
        spark.createDataFrame([("b1", 5, "torn")], "batch_id string, batch_row long, said string").write.parquet(f"{batch.ledger}/batch=b1")
    if stop >= 2:
        batch.append(rows_of(spark)(paths))
        assert batch.state() == STATES[1]
    if stop == 3:
        assert batch.store.move(batch.files()[0]["source"], batch.files()[0]["destination"])
    if stop >= 4:
        batch.move(0)
        assert batch.state() == STATES[2]
        with pytest.raises(BatchError):
            batch.finalize()
    if stop == 5:
        batch.move(1)
        batch.move(2)
    again, _ = make(spark, tmp_path, n=0)
    assert again.run(paths, rows_of(spark)) == "resumed"
    assert again.state() == STATES[3] and said(spark, tmp_path) == ["b1 row 0", "b1 row 1", "b1 row 2"]
    assert again.run(paths, rows_of(spark)) == "skipped" and said(spark, tmp_path) == ["b1 row 0", "b1 row 1", "b1 row 2"]
    assert not any((tmp_path / "inbox").iterdir()) and len(list((tmp_path / "archive" / "b1").glob("*.txt"))) == 3


def test_batch_rejects_what_does_not_hold(spark, tmp_path):
    with pytest.raises(BatchError):
        make(spark, tmp_path, "../bad", 0)
    batch, paths = make(spark, tmp_path)
    with pytest.raises(BatchError):
        batch.prepare([*paths, str(tmp_path / "elsewhere.txt")])
    batch.prepare(paths)
    with pytest.raises(BatchError):
        batch.prepare(paths)
    with pytest.raises(BatchError):
        batch.mark_appended()  # no marker
    with pytest.raises(BatchError):
        batch.move(0)
    batch.append(rows_of(spark)(paths))
    with pytest.raises(BatchError):
        batch.append(rows_of(spark)(paths))
    (tmp_path / "inbox" / "b1-1.txt").write_text("another text")
    with pytest.raises(BatchError, match="digest"):
        batch.move(1)
    spark.createDataFrame([("b1", 0)], "batch_id string, batch_row long").write.parquet(f"{batch.ledger}/stray")
    assert "marker 2 times" in batch.issues()


def test_state_is_set_by_one_of_two(spark, tmp_path):
    batch, paths = make(spark, tmp_path)
    batch.prepare(paths)
    store = batch.store
    a, b = (store.move(f"{batch.home}/state/prepared", f"{batch.home}/state/records_appended") for _ in range(2))
    assert (a, b) == (True, False)


# progress by state


def test_progress_out_of_order_equals_the_window(spark, tmp_path):
    import datetime
    import random

    rng = random.Random(1)
    day = datetime.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 3), day + datetime.timedelta(hours=rng.randint(0, 200)), n, float(rng.randint(0, 5)) if rng.random() < 0.9 else None, rng.randint(0, 2)) for n in range(120)]
    kind = "learner long, ts timestamp, event_id long, value double, run long"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], kind).coalesce(1).write.mode("append").parquet(src)
        S.stream_progress(S.read_stream(spark, src, spark.createDataFrame([], kind).schema, files_per_batch=1), out, str(tmp_path / "c"), ["learner"], ["ts", "event_id"], "value", "run", delay="30 days")
    d = L.progress_deltas(spark.createDataFrame(rows, kind), ["learner"], ["ts", "event_id"], "value", "run")
    want = sorted((r["learner"], r["event_id"], r["status"], r["delta"]) for r in d.collect())
    got = sorted((r["learner"], r["event_id"], r["status"], r["delta"]) for r in S.latest_progress(spark, out, ["learner", "event_id"]).collect())
    assert list(map(str, got)) == list(map(str, want))


class _List:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class _Value:
    def __init__(self):
        self.row = None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def exists(self):
        return self.row is not None


def test_progress_state_holds_what_the_delay_leaves_open():
    import datetime

    import pandas as pd
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType

    class Handle:
        timers: list = []

        def getListState(self, name, schema):  # noqa: N802
            return _List()

        def getValueState(self, name, schema):  # noqa: N802
            return _Value()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    names = {"ts": TimestampType(), "event_id": LongType(), "value": DoubleType(), "run": LongType()}
    p = S._Progress(StructType([StructField(n, t) for n, t in names.items()]), ["learner"], "ts")
    p.init(Handle())
    clock, day, told = Clock(), datetime.datetime(2024, 1, 1), {}
    for k in range(200):
        at = day + datetime.timedelta(hours=k)
        clock.now = int(pd.Timestamp(at).timestamp() * 1000) - 3 * 3_600_000
        (out,) = p.handleInputRows((1,), iter([pd.DataFrame([(at, k, float(k), 1)], columns=list(names))]), clock)
        told |= dict(zip(out["event_id"], out["status"], strict=True))
        assert len(p.open.rows) <= 3
    assert told[0] == "first" and set(told.values()) == {"first", "advanced"} and len(told) == 200
    clock.now += 10 * 3_600_000
    list(p.handleExpiredTimer((1,), clock, None))
    assert p.open.rows == [] and p.before.row[1] == 199


# publishing


def test_a_broken_publication_leaves_the_old_result(spark, tmp_path):
    from evidence_engine.sources.files import publish, publish_views, published, published_view

    fail = F.udf(lambda x: 1 // (x - x), "long")
    where, d = str(tmp_path / "one"), spark.range(5)
    publish(d, where)
    with pytest.raises(Exception, match="ZeroDivision"):
        publish(d.select(fail("id").alias("id")), where)
    assert published(spark, where).count() == 5
    publish(spark.range(7), where)
    assert published(spark, where).count() == 7
    views = str(tmp_path / "views")
    publish_views({"a": d, "b": d}, views)
    with pytest.raises(Exception, match="ZeroDivision"):
        publish_views({"a": spark.range(9), "b": d.select(fail("id").alias("id"))}, views)
    assert published_view(spark, views, "a").count() == published_view(spark, views, "b").count() == 5
    with pytest.raises(FileNotFoundError):
        published(spark, str(tmp_path / "none"))
    for k in range(4):
        publish(spark.range(k), where)
    assert len(Store(spark, where).names(where)) <= 3 and published(spark, where).count() == 3


# trees of hashes


def test_tree_diff_opens_what_differs(spark, tmp_path):
    from evidence_engine.operators.integrity import HashTree, fingerprints

    rows = spark.range(20_000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    old = HashTree.write(fingerprints(rows, "id", "text"), str(tmp_path / "a"), "id", fan=16, per_leaf=100)
    assert old.levels == 2 and old.root()[1] == 20_000
    same = HashTree.write(fingerprints(rows.repartition(7), "id", "text"), str(tmp_path / "b"), "id", levels=2, fan=16)
    assert old.root() == same.root() and old.diff(same).count() == 0
    changed = rows.where("id NOT IN (5, 17)").withColumn("text", F.when(F.col("id").isin(3, 4, 9000), "other").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(50_000, "new")], "id long, text string"))
    new = HashTree.write(fingerprints(changed, "id", "text"), str(tmp_path / "c"), "id", levels=2, fan=16)
    assert {(r["id"], r["change"]) for r in old.diff(new).collect()} == {(5, "missing"), (17, "missing"), (3, "changed"), (4, "changed"), (9000, "changed"), (50_000, "added")}
    assert 0 < old.opened < 1000  # 6 leaves of 256
    empty = HashTree.write(fingerprints(rows.limit(0), "id", "text"), str(tmp_path / "d"), "id", levels=2, fan=16)
    assert empty.diff(old).where("change = 'added'").count() == 20_000


def test_links_of_one_target_are_dealt_out(spark):
    from evidence_engine.operators.integrity import resolve_links

    targets = spark.createDataFrame([("a/x.md",), ("b/y.md",), ("c/y.md",), ("d/z",), ("x",)], "path string")
    asked = ["a/x.md", "a/x", "x", "x.md", "q/x", "y", "b/y", "z", "d/z", "none", None, ""]
    links = spark.createDataFrame([(k, t) for k, t in enumerate(asked)] + [(1000 + k, "a/x") for k in range(2000)], "id long, target string")
    out = resolve_links(links, targets)
    got = {r["id"]: r["how"] for r in out.collect()}
    assert [got[k] for k in range(12)] == ["exact", "suffixed", "exact", "basename", "broken", "broken", "suffixed", "basename", "exact", "broken", "broken", "broken"]
    assert len(got) == 2012 and out.columns == ["id", "target", "how"]
