"""The streamed mastery against the one over tables."""

from __future__ import annotations

import datetime
import random

from evidence_engine.operators import mastery as M
from evidence_engine.streaming import streams as S

SCHEMA = "event_id long, ts timestamp, learner long, item_type int, judgement string"


def test_late_and_unjudged_attempts_over_batches(spark, tmp_path):
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    files = [
        [(1, at(1), 1, 1, "OK"), (2, at(2), 1, 1, None), (3, at(1), 2, 1, "OK"), (4, at(5), 3, None, "OK"), (5, None, 4, 1, "OK"), (6, at(9), 5, 1, "WRONG"), (7, at(1), None, 1, "OK"), (12, at(3), 7, 1, "OK")],
        [(8, at(3), 1, 1, "OK"), (9, at(2), 2, 1, "OK"), (10, at(6), 3, None, "OK"), (11, at(1), 4, 1, "OK"), (13, at(2), 5, 1, "OK"), (14, at(2), None, 1, "OK"), (15, at(4), 6, 1, "BLANK"), (16, at(3), 7, 1, "WRONG")],
        [],
    ]
    r = random.Random(7)
    ids = iter(range(100, 10_000))
    for f in files:
        f += [(next(ids), at(r.randint(1, 5), r.randint(0, 2)), r.randint(10, 40), r.randint(0, 3), r.choice(["OK", "OK", "OK", "WRONG", "SLOW", None])) for _ in range(300)]
    for k, f in enumerate(files):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        S.stream_mastery(S.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in/0")).schema, files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    columns = ["learner", "item_type", "colour", "attempts"]
    got = {tuple(x) for x in S.latest_mastery(spark, str(tmp_path / "out")).select(*columns).collect()}
    every = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    want = {(3, None, "green", 2), (None, 1, "green", 2)}  # keys that are null are keys
    known = every.where("learner IS NOT NULL AND item_type IS NOT NULL")
    want |= {tuple(x) for x in M.mastery(known, ["learner", "item_type"]).select(*columns).collect()}
    assert got == want and sum(x[3] for x in got) == 916
    assert (1, 1, "yellow", 3) in got  # the attempt without a judgement stands between two right ones
    assert list((tmp_path / "checkpoint/state").rglob("*.zip")), "the state lies in a store on disk"
