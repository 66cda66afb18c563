"""Field rules, Markdown readers and gates, on small inline tables and files."""

from __future__ import annotations

import hashlib
import json

import pytest
from evidence_engine.operators import bank as B
from evidence_engine.operators import integrity as I
from evidence_engine.operators import textprep as P
from evidence_engine.sources import files as S
from pyspark.sql import functions as F


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, text string")


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_academic_year(spark):
    d = spark.createDataFrame([("2021-2022", None), ("2021-2023", "2020-2021"), ("", "exam 2020-2021 A"), ("none", "2020-2021"), (None, "12020-2021"), (None, "x2019-2020-2"), (None, None)], "v string, s string")
    assert values(d.select(B.academic_year(F.col("v"), F.col("s")).alias("y")), "y") == [(2021,), (None,), (2020,), (None,), (None,), (2019,), (None,)]


def test_form_score_status(spark):
    d = spark.createDataFrame([("a proof", None), ("a", "given"), ("a", " "), ("proof calc", None)], "anchor string, form string")
    out = d.select(B.item_form(F.col("anchor"), F.col("form"), [("calc", "C"), ("proof", "P")], "unknown").alias("f"))
    assert [tuple(r["f"]) for r in out.collect()] == [("P", "inferred"), ("given", "explicit"), ("unknown", "unknown"), ("C", "inferred")]
    s = spark.createDataFrame([("12.5 points",), ("-3",), ("0",), ("none",), (None,), ("about 7 or 8",)], "t string")
    assert values(s.select(B.parse_score(F.col("t")).alias("s")), "s") == [(12.5,), (None,), (None,), (None,), (None,), (7.0,)]
    assert [tuple(r["s"]) for r in s.select(B.status_with_source(F.nullif(F.col("t"), F.lit("0")), "PENDING").alias("s")).collect()][2] == ("PENDING", "legacy_default")


def test_inherit_keeps_an_explicit_empty_value(spark):
    child = spark.createDataFrame([(1, None), (1, ""), (1, "x")], "k int, v string")
    parent = spark.createDataFrame([(1, "p")], "k int, v string")
    assert sorted(values(B.inherited(child, parent, "k", ["v"]), "v")) == [("",), ("p",), ("x",)]


BANK = """# Paper 2020-2021
%%
source: Midterm 2020-2021
chapter: 1
%%

## Q1 proof

%%
question_type: limits
score: 5
score: 6
%%
body
> starter: use the definition
> status: checked

## Q2
text before
%%
question_type: late
%%
ocr_status: VERIFIED

## Q3
%%
question_type: open
> starter: doubtful start
> status: doubtful
"""


def test_blocks_and_metadata(spark):
    b = B.blocks(texts(spark, ("a.md", BANK)))
    got = {r["anchor"]: (r["pos"], r["m"]) for r in b.withColumn("m", B.metadata(F.col("body"))).collect()}
    assert got["Paper 2020-2021"] == (1, {"source": "Midterm 2020-2021", "chapter": "1"})
    assert got["Q1 proof"][1] == {"question_type": "limits", "score": "6"}  # the last one wins
    assert got["Q2"][1] is None and got["Q3"][1] is None  # not adjacent; not closed
    assert values(B.starters(b), "anchor", "starter") == [("Q1 proof", "use the definition")]
    assert dict(values(B.block_statuses(b, "PENDING"), "anchor", "status"))["Q2"] == "VERIFIED"
    missing = {r["anchor"]: r["missing"] for r in B.intake_completeness(b, ["source", "year"], ["question_type", "source"], "Paper").collect()}
    assert missing == {"Paper 2020-2021": ["year"], "Q2": ["question_type"], "Q3": ["question_type"]}


def test_tag_library_and_attempt_log(spark, tmp_path):
    (tmp_path / "tags.md").write_bytes("﻿| chapter | theme | tag | count |\n| --- | --- | --- | --- |\n| 1 | Limits | epsilon | 3 |\r\n| 2 |  | series | 0 |\n".encode())
    (tmp_path / "log.md").write_text("| 2026-01-02 | Q1 | WRONG | CONCEPT | said a \\| b | [[x.png]] |\n| date | a | b | c | d | e |\n| 2026-01-03 | Q2 | OK | | | |\n")
    t = S.read_texts(spark, str(tmp_path), "tags.md")
    assert t.count() == 1 and not t.first()["text"].startswith("﻿")
    assert values(S.tag_library(t), "chapter", "theme", "tag", "expected_count") == [("1", "Limits", "epsilon", 3), ("2", "", "series", 0)]
    log = S.attempt_log(S.read_texts(spark, str(tmp_path), "log.md"))
    assert [(str(r["date"]), r["anchor"], r["judgement"], r["wrong_cause"], r["note"]) for r in log.collect()] == [("2026-01-02", "Q1", "WRONG", "CONCEPT", "said a \\| b"), ("2026-01-03", "Q2", "OK", None, None)]


def test_event_lines_keep_malformed_ones(spark):
    d = S.event_lines(texts(spark, ("e.jsonl", '{"event_id": "a"}\n\nbroken\n[1]\n{"event_id": "b"}\n')), "event_id string")
    assert [(r["line"], r["event"] and r["event"]["event_id"]) for r in d.orderBy("line").collect()] == [(1, "a"), (3, None), (4, None), (5, "b")]


def test_blockers_and_their_rules(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    text = f"intro\n<!-- item sha={sha.upper()} type=limits lines=1-2, 4-5 -->\n- evidence_source: d.md\n- source_sha256: {sha}\n- lines: 1-2, 4-5\n- reason: old\n- reason: new\n<!-- item sha=00 type=x lines=9-3 -->\n"
    b = S.blockers(texts(spark, ("b.md", text)))
    first = b.where("line_no = 2").first()
    assert first["sha"] == sha and first["fields"]["reason"] == "new" and first["ranges"] == "1-2, 4-5"
    docs = spark.createDataFrame([("d.md", sha, 4)], "path string, sha256 string, n_lines int")
    got = {(r["line_no"], r["issue"]) for r in I.blocker_issues(b, docs).collect()}
    assert got == {(2, "out_of_range"), (8, "bad_marker"), (8, "bad_ranges"), (8, "no_body"), (8, "no_source")}


def test_manifests_and_fingerprints(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"status": "complete", "outputs": [{"path": "p", "sha256": "s"}]}, indent=1))
    (tmp_path / "in/b.json").write_text("{broken")
    m = S.read_manifests(spark, str(tmp_path), "status string, outputs array<struct<path:string,sha256:string>>")
    assert [(r["status"], r["outputs"][0]["path"]) for r in m.collect()] == [("complete", "p")]
    f = S.file_fingerprints(spark, str(tmp_path), "b.json").first()
    assert f["sha256"] == hashlib.sha256(b"{broken").hexdigest()


def test_publish_views_and_gate(spark, tmp_path):
    d = spark.range(3)
    S.publish_views({"x": d, "y": d.where("id > 0")}, str(tmp_path / "v"), "v1")
    S.publish_views({"x": d.where("id > 1"), "y": d}, str(tmp_path / "v"), "v2")
    assert S.published_view(spark, str(tmp_path / "v"), "x").count() == 1
    S.publish_views({"x": d}, str(tmp_path / "v"), "v3")
    assert not (tmp_path / "v/v1").exists() and (tmp_path / "v/v2").exists()  # the one before stays for its readers
    B.quality_gate(d.where("id > 9"))
    with pytest.raises(B.QualityError) as e:
        B.quality_gate(d)
    assert e.value.issues.count() == 3


def test_profile_sections(spark):
    d = B.profile_sections(texts(spark, ("p.md", "# P\n## Stage\nreview\n## Scope\n- a\n- b\n## Scope\n- c\n## Emphasis\n\n")), ["Stage", "Scope", "Emphasis", "Exclusions"])
    got = {r["section"]: (r["issue"], r["items"]) for r in d.collect()}
    assert got["Stage"] == (None, ["review"]) and got["Scope"][0] == "repeated" and got["Emphasis"][0] == "empty" and got["Exclusions"][0] == "missing"


def test_wikilinks_and_math(spark):
    d = texts(spark, ("a", "[[x/y#Head|name]] and [[plain]] in a table [[t\\|shown]]"))
    got = values(P.wikilinks(d, id_col="file", text_col="text"), "target", "alias", "file", "heading")
    assert [(t, a, h) for t, a, _, h in got] == [("x/y#Head", "name", "Head"), ("plain", None, None), ("t", "shown", None)]
    m = spark.createDataFrame([(r"\(a+b\) \[c\] [x_1=2] [link](u) [plain]",)], "t string")
    assert m.select(P.repair_math(F.col("t")).alias("t")).first()["t"] == "$a+b$ \\$$\nc\\\n$$ $$\nx_1=2\n$$ [link](u) [plain]"  # brackets come first, also those of a delimiter
    s = spark.createDataFrame([("a%20b+c",), ("bad%zz",)], "t string").select(P.decoded(F.col("t")).alias("t"))
    assert values(s, "t") == [("a b+c",), ("bad%zz",)]
