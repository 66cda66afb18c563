"""Thresholds of the trend rules at their boundaries, and streams that run again."""

from __future__ import annotations

import pytest
from evidence_engine.operators import trends as T
from evidence_engine.streaming import streams as S
from pyspark.sql import functions as F

BASE = dict(h_years=4, r_years=4, h_hits=0, r_hits=0, h_rate=0.0, r_rate=0.0, has_return=False, latest_present=False, absent_run=0, transitions=0)
KIND = "h_years int, r_years int, h_hits int, r_hits int, h_rate double, r_rate double, has_return boolean, latest_present boolean, absent_run int, transitions int"


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({"h_years": 2}, "THIN"), ({"r_years": 2}, "THIN"),
        ({"r_hits": 2, "latest_present": True}, "FIRST"), ({"r_hits": 1, "latest_present": True}, "FLAT"), ({"h_rate": None, "r_hits": 2, "latest_present": True}, "FIRST"),
        ({"h_rate": 0.25, "has_return": True}, "RETURN"),
        ({"h_rate": 0.2, "r_rate": 0.5, "latest_present": True}, "WARM"), ({"h_rate": 0.2, "r_rate": 0.4999, "latest_present": True}, "FLAT"), ({"h_rate": 0.4, "r_rate": 0.7, "latest_present": True}, "FLAT"),
        ({"h_rate": 0.5, "r_rate": 0.25, "absent_run": 2}, "COOL"), ({"h_rate": 0.5, "r_rate": 0.25, "absent_run": 1, "transitions": 3}, "CYCLE"),
        ({"h_rate": 0.6, "r_rate": 0.75, "latest_present": True}, "CORE"), ({"h_rate": 0.6, "r_rate": 0.75}, "FLAT"),
    ],
)
def test_primary_trend(spark, change, want):
    d = spark.createDataFrame([tuple((BASE | change).values())], KIND)
    assert d.select(T.primary_trend().alias("t")).first()["t"] == want


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((3, 3, 0.25, 0.6, 0, 0, None, None), ["UPSIZE"]), ((3, 3, 0.3, 0.6, 0, 0, None, None), []), ((2, 3, 0.0, 1.0, 0, 0, None, None), []),
        ((3, 3, 0.6, 0.25, 0, 0, None, None), ["DOWNSIZE"]), ((0, 0, None, None, 3, 3, 4.0, 8.0), ["UPSIZE"]), ((0, 0, None, None, 3, 2, 4.0, 8.0), []),
        ((3, 3, 0.0, 1.0, 3, 3, 9.0, 5.0), ["UPSIZE", "DOWNSIZE"]), ((3, 3, 0.0, 1.0, 3, 3, 5.0, 9.0), ["UPSIZE"]),
    ],
)
def test_size_shifts(spark, row, want):
    d = spark.createDataFrame([row], "h_forms int, r_forms int, h_long double, r_long double, h_scores int, r_scores int, h_median double, r_median double")
    assert d.select(T.size_shifts().alias("s")).first()["s"] == want


@pytest.mark.parametrize(
    ("flags", "want"),
    [("", (0, 0, 0, False)), ("1", (1, 0, 0, False)), ("1100", (0, 2, 1, False)), ("10011", (2, 0, 2, True)), ("0011", (2, 0, 1, False)), ("1011", (2, 0, 2, False)), ("1001", (1, 0, 2, False)), ("010101", (1, 0, 5, False))],
)
def test_series_features(spark, flags, want):
    d = spark.createDataFrame([("e", "t", [(2000 + i, c == "1", 0) for i, c in enumerate(flags)])], "entity string, paper_type string, series array<struct<year:int,present:boolean,n:int>>")
    r = T.series_features(d).first()
    assert (r["present_run"], r["absent_run"], r["transitions"], r["has_return"]) == want


def facts(spark, rows):
    return spark.createDataFrame(rows, "paper long, paper_type string, year int, theme string, tag string, score double, form string, anchor string, tie string")


def test_profiles_do_not_depend_on_order_or_partitions(spark):
    rows = [(y * 10 + k, "A" if k % 2 else "B", None if y == 3 and k == 1 else 2000 + y, f"th{(y + k) % 3}", f"t{(y * k) % 5}", float(k), "proof" if k % 3 else "unknown", f"a{y}-{k}", str(k)) for y in range(10) for k in range(6)]
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    one = key(T.profile_entities(facts(spark, rows)))
    assert one == key(T.profile_entities(facts(spark, rows[::-1]).repartition(7)))
    assert len(one) == 2 * (3 + 5)


def test_distribution_weighs_papers_equally(spark):
    rows = [(1, "A", 2000, "t", "x", None, "proof", "a", "1")] * 3 + [(1, "A", 2000, "t", "x", None, "calculation", "b", "2"), (2, "A", 2000, "t", "x", None, "calculation", "c", "3"), (3, "A", 2000, "t", "x", None, "unknown", "d", "4")]
    d = T.form_distribution(T.with_period(facts(spark, rows)), "theme")
    assert {r["form"]: r["share"] for r in d.collect()} == {"proof": 0.375, "calculation": 0.625}


def test_stream_ledger_runs_again_without_new_rows(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7, k) for k in range(40)], "signature long, n long")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows.repartition(5).write.parquet(src)
    for k in range(2):
        S.stream_ledger(S.read_stream(spark, src, rows.schema, files_per_batch=2), out, str(tmp_path / f"checkpoint{k}"))
        assert spark.read.parquet(out).count() == 7
    spark.createDataFrame([(3, 1), (9, 1)], rows.schema).write.mode("append").parquet(src)
    S.stream_ledger(S.read_stream(spark, src, rows.schema), out, str(tmp_path / "checkpoint1"))
    assert sorted(r[0] for r in spark.read.parquet(out).select("signature").collect()) == [0, 1, 2, 3, 4, 5, 6, 9]


def test_entry_works_without_llm(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "evidence_engine.llm", None)
    monkeypatch.setitem(sys.modules, "evidence_engine.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "flagship_trends" in e.queries() and not any(k.startswith("op1_") for k in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "evidence_engine"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text() and "import llm" not in p.read_text(), p


def test_late_facts_are_counted_in_totals_only(spark):
    d = facts(spark, [(1, "A", None, "t", "x", 2.0, "proof", "a", "1"), (2, "A", 2000, "t", "x", 3.0, "proof", "b", "2")])
    m = T.period_metrics(d, "theme").first()
    assert (m["r_items"], m["r_total"]) == (1, 3.0) and d.groupBy("theme").agg(F.sum("score")).first()[1] == 5.0


def test_dataset_fingerprint_with_more_levels(spark):
    from evidence_engine.operators.integrity import dataset_fingerprint

    d = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    one = [dataset_fingerprint(x, "id", 4, 20).first() for x in (d, d.repartition(7), d.orderBy(F.desc("id")))]  # three levels
    assert one[0]["n"] == 500 and len({r["fingerprint"] for r in one}) == 1
    changed = d.withColumn("sha256", F.when(F.col("id") == 77, "x").otherwise(F.col("sha256")))
    assert dataset_fingerprint(changed, "id", 4, 20).first()["fingerprint"] != one[0]["fingerprint"]
    swapped = d.withColumn("id", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("id")))
    assert dataset_fingerprint(swapped, "id", 4, 20).first()["fingerprint"] != one[0]["fingerprint"]


def test_stream_windows_count_late_rows_within_the_delay_only(spark, tmp_path):
    import time

    src, kind = str(tmp_path / "src"), "event_id long, ts timestamp, event_type string"
    batches = [["2024-01-10 12:00:00"], ["2024-01-09 23:00:00"], ["2024-01-11 00:00:00", "2024-01-02 00:00:00", "2024-01-10 01:00:00"]]
    for k, times in enumerate(batches):
        rows = spark.createDataFrame([(10 * k + i, t, "a") for i, t in enumerate(times)], "event_id long, ts string, event_type string")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files come in the order of their times
    S.stream_windows(S.read_stream(spark, src, kind, files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), delay="1 day")
    got = {str(r["start"])[:10]: r["n"] for r in S.latest_windows(spark, str(tmp_path / "out")).collect()}
    assert got == {"2024-01-10": 2, "2024-01-09": 1, "2024-01-11": 1}  # rows are late by what batches before the last one showed
