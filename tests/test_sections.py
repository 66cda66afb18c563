"""Banks of questions read by sections, never by whole files."""

from __future__ import annotations

import pytest
from evidence_engine.operators import bank as B
from evidence_engine.plans import file_queries as Q
from evidence_engine.sources import files as S

FILES = {
    "a.md": "# Paper\n\nintro\n## Q1\nx\n#tag\n\n####### seven\n## Q2  \n%%\r\nk: v\r\n%%\n# \n## Q3", "b.md": "﻿## Q1\ny\n", "c.md": "before\n#no\n## Q1\r\nz\r\n#\r\n### Q4\r\nend\r", "d.md": "\n## Q1\n\n\n",
    "e.md": "", "f.md": "no heading\nat all\n", "g.md": "#\n##\n## \n", "h.md": "## Q1", "i.md": "## Q1\n## Q1\n\n#\n", "j.md": "## Q1\nö 漢字 # in line\n#\x0bodd\n## Q2 ﻿x\n", "k.md": "##  Q9\r\n\r\n" + "long " * 300 + "\n## Q8\r\n#x\r",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


@pytest.mark.parametrize("split", ["128m", "7b", "64b"])
@pytest.mark.parametrize("heading", [B.HEADING, r"^##\s+(Q\d+)\s*$"])
def test_sections_give_the_blocks_of_whole_texts(spark, folder, split, heading):
    columns = ["file", "block", "anchor", "pos", "body"]
    whole = B.blocks(S.read_texts(spark, folder), heading)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        own = B.section_blocks(S.read_sections(spark, folder), heading)
        got = sorted(map(tuple, own.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(map(tuple, whole.select(*columns).collect())) and len(got) > 10
    assert dict(own.dtypes)["pos"] == dict(whole.dtypes)["pos"]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "bank.md").write_text(f"## Q{k}\nfirst {k}\n## R{k}\nlast {k}\n")
    got = {(r["anchor"], r["pos"], r["body"]) for r in B.section_blocks(S.read_sections(spark, str(tmp_path))).collect()}
    assert got == {(f"{n}{k}", p, b) for k in "ab" for n, p, b in (("Q", 1, f"first {k}"), ("R", 3, f"last {k}\n"))}


def test_no_row_holds_a_file(spark, tmp_path):
    (tmp_path / "bank.md").write_text("".join(f"## Q{k}\nbody {k}\n" for k in range(5000)))
    d = S.read_sections(spark, str(tmp_path))
    assert d.selectExpr("max(length(text))").first()[0] < 30 and B.section_blocks(d).count() == 5000


def whole_texts(*_):
    raise AssertionError("a file is read whole")


def test_prj14_reads_by_sections(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "read_texts", whole_texts)
    spark.createDataFrame([(k, "n", "b", "t", 7) for k in range(6)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in Q.prj14_block_statuses(spark, str(tmp_path)).collect()}
    assert got == {(f"Q{k}", "PENDING" if k % 3 else "S2") for k in range(6)}


def test_prj2_metadata_goes_on_over_a_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "read_texts", whole_texts)
    parts = [(0, "n", "b", "a\n#b: c\n#d", 7), (1, "n", "b", "t", 7), (2, "n", "b", "t", 7), (3, "n", "b", "## x", 9)]  # types with lines that begin with a number sign
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in Q.prj2_metadata(spark, str(tmp_path)).collect()}
    assert got == {("Q0", "a", "7"), ("Q1", None, None), ("Q2", None, None), ("Q3", "## x", "9")}


def test_src1_finds_every_question(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "read_texts", whole_texts)
    parts = [(k, "a\n#b" if k % 2 else "n", "b", "t", 7) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").repartition(3).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in Q.src1_question_files(spark, str(tmp_path)).collect())
    assert got == sorted((f"Q{k}", k % 4 == 1, k % 2 == 0) for k in range(40))
