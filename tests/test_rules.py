"""Rules on cases whose verdicts are known beforehand."""

from __future__ import annotations

import pytest
from evidence_engine.operators import bank as B
from evidence_engine.operators import integrity as I
from evidence_engine.operators import ledger as L
from evidence_engine.operators import textlint as X
from evidence_engine.operators import textprep as P
from evidence_engine.sources import files as S
from pyspark.sql import functions as F


def of(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("target", "ok"),
    [("../bank/paper", False), ("./bank/paper", False), ("/bank/paper", False), ("C:/bank/paper", False), ("paper", False), ("paper#part/one", False), ("..\\bank\\paper", False), ("course/bank/paper", True), ("course\\bank", True), ("a/b#part", True), ("#part", True)],
)
def test_link_style(spark, target, ok):
    assert of(spark, target, I.link_style) is ok


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        ("costs \\$5 each", []), ("use `$x` here", []), ("a $x$ and \\$$", []), ("$A \\Rightarrow B$", []), ("```\n$ $$ \\left( frac{\n```", []), ("$$a$$ $b$", []),
        ("bad frac{x}", ["known_bad"]), ("$\\frac{x}{y}$", []), ("x $$$ y", ["known_bad", "odd_display"]), ("\\left( a", ["left_right"]), ("\\left( a \\right)", []), ("a $$ b", ["odd_display"]), ("a $ b", ["odd_inline"]),
        ("\\left$$", ["known_bad", "left_right", "odd_display"]),
    ],
)
def test_delimiters(spark, text, rules):
    assert of(spark, text, X.delimiter_rules) == rules


@pytest.mark.parametrize(
    ("text", "found"),
    [("so \\frac{1}{x} is", True), ("x^{2} bare", True), ("(a)^n", True), ("\\alpha", True), ("\\alphabet", False), ("`a^2` and ```x^2```", False), ("$x^2$ or $$y^2$$", False), ("a_1 = b", False), ("\\$x^2\\$", True), (None, None)],
)
def test_bare_math(spark, text, found):
    assert of(spark, text, X.bare_math) is found


def test_control_characters(spark):
    assert [of(spark, f"a{c}b", X.control_characters) for c in "\x00\x08\x0b\x0c\x1f\x7f\t\n\r "] == [True] * 6 + [False] * 4


@pytest.mark.parametrize(
    ("text", "repaired"),
    [
        ("see [ x_1 = 2 ] now", "see $$\nx_1 = 2\n$$ now"), ("[plain] and [a=b](u)", "[plain] and $$\na=b\n$$(u)"), ("\\( a + b \\) end", "$a + b$ end"), ("\\(a\nb\\)", "$a\nb$"),
        ("[\n a \\times b\n]", "$$\na \\times b\n$$"), ("[a\nb=1]", "[a\nb=1]"), ("[ ]", "[ ]"), ("a [b [c=1] d]", "a $$\nb [c=1\n$$ d]"), ("\\[ plain \\]", "\\$$\nplain \\\n$$"), ("", ""),
    ],
)
def test_math_repair(spark, text, repaired):
    assert of(spark, text, P.repair_math) == repaired


def test_delimiter_repair_alone(spark):
    assert of(spark, "x \\[\n a^2 \n\\] y \\[b\\]", P.repair_delimiters) == "x $$\na^2\n$$ y $$\nb\n$$"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("a $x$ b", [("text", "a "), ("inline", "$x$"), ("text", " b")]), ("\\$5 and `$y`", [("text", "\\$5 and "), ("code", "`$y`")]), ("```\n$x$\n```$$y\n$$", [("fence", "```\n$x$\n```"), ("display", "$$y\n$$")]),
        ("\\(a\\)\\[b\\]", [("paren", "\\(a\\)"), ("bracket", "\\[b\\]")]), ("", []), ("open $x", [("text", "open $x")]),
    ],
)
def test_math_segments(spark, text, kinds):
    assert [tuple(x) for x in of(spark, text, P.math_segments)] == kinds


def test_event_defaults_pass_the_vocabulary(spark):
    rows = [(1, None, None, None), (2, "s3", None, None), (3, "manual", None, None), (4, "import", "subagent", "deferred"), (5, " ", None, None)]
    d = spark.createDataFrame(rows, "event_id long, origin string, created_by string, outcome string")
    d = L.normalize_events(d.withColumn("event_type", F.lit("attempt")).withColumn("evidence", F.lit("e")).withColumn("time", F.lit("2024-01-02T03:04:05+08:00")))
    assert [tuple(r) for r in d.select("origin", "created_by", "outcome").collect()] == [("s10", "main_agent", "observed"), ("s3", "script", "observed"), ("manual", "user", "observed"), ("import", "subagent", "deferred"), (" ", "user", "observed")]
    assert [(r["event_id"], r["rule"]) for r in L.event_issues(d).collect()] == [(5, "bad_origin")]
    bare = L.normalize_events(spark.createDataFrame([(1,)], "event_id long"))
    assert bare.select("origin", "created_by", "outcome").first() == ("s10", "main_agent", "observed")


def test_event_signature(spark):
    import hashlib

    d = spark.createDataFrame([("attempt", "Q1", None, "seen", "p")], "event_type string, anchor string, hypothesis string, evidence string, probe string")
    want = hashlib.sha256("␟".join(["attempt", "Q1", "", "seen", "p"]).encode()).hexdigest()[:16]
    assert d.select(L.event_signature(d.columns).alias("s")).first()["s"] == want


CJK = r"[\u4e00-\u9fff]"
LIMITS = {"short_error": 2000, "short_warning": 2500, "prose": 80, "bullet_share": 0.45, "bullet_run": 8, "paragraph": 250}
NUMBERED = r"^\s*(?:[-*+]|\d+[.)]|[一二三四五六七八九十]+[、.])\s+"


def linted(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {(r["rule"], r["severity"]) for r in X.lint(d, P.lines_of(d), char_class=CJK, limits=LIMITS, chain=("mermaid", "过程链"), bullet=NUMBERED).collect()}


def test_chapter_lint(spark):
    prose = "自然段解释" * 20  # 100 characters
    sound = "\n\n".join(["# 标题", *[prose] * 26, "甲 -> 乙 → 丙 \\rightarrow 丁"])
    assert linted(spark, sound) == set()
    assert linted(spark, "latin letters only " * 500) == {("short", "error"), ("no_chain", "warning")}
    assert linted(spark, "\n\n".join(["短句解释" * 15] * 40) + "\n过程链") == {("short", "warning"), ("no_prose", "error")}
    assert linted(spark, sound.replace(" → ", " ")) == {("no_chain", "warning")}
    assert linted(spark, sound + "\n\n" + "字" * 251) == {("long_paragraph", "warning")}
    assert linted(spark, sound + "\n\n" + "\n".join(f"{k}. 条" for k in range(9))) == {("bullet_run", "warning")}
    assert linted(spark, sound + "\n\n" + "\n".join(f"- 第 {k} 条\n## 题\n> [!note] 注" for k in range(40))) == {("bullets", "warning")}
    assert linted(spark, None) == {("short", "error"), ("no_chain", "warning")}


def test_quality_counts(spark):
    rows = [("A", 1, 2000, 5.0, "ok", "explicit", "explicit"), ("A", 1, 2000, None, "ok", "anchor", "legacy_default"), ("A", 2, None, 1.0, "pending", "unknown", "explicit"), ("B", 3, 2001, 1.0, "ok", "unknown", "legacy_default")]
    d = spark.createDataFrame(rows, "paper_type string, paper long, year int, score double, ocr string, form_source string, ocr_source string")
    got = {r["paper_type"]: r.asDict() for r in B.quality_counts(d).collect()}
    assert got["A"] == {"paper_type": "A", "form_explicit": 1, "form_inferred": 1, "form_unknown": 1, "status_explicit": 2, "status_legacy_default": 1, "unknown_year_papers": 1, "unknown_scores": 1, "statuses": {"ok": 2, "pending": 1}}
    assert got["B"]["statuses"] == {"ok": 1} and got["B"]["form_unknown"] == 1


def test_quote_rules(spark):
    sha = "a" * 64
    fields = "- quote_source: s\n- quote_source_sha256: x\n- quote_lines: 1-2\n- quote_sha256: y\n"
    item = lambda kind, body: f"<!-- item sha={sha} type={kind} lines={len(body)}-9999 -->\n{body}"
    text = item("final", f"- type: final\n{fields}  quote:\n  > said\n") + item("final", f"- type: open\n{fields}quote:\n") + item("final", f"- type: final \n{fields}") + item("open", "- type: open\n") + item("final", "- type: final\n")
    found = S.blockers(spark.createDataFrame([("b.md", text)], "file string, text string"))
    got = [(r["line_no"], r["issue"]) for r in I.blocker_quote_issues(found, final_type="final", types=["final", "open"]).orderBy("line_no").collect()]
    assert [x for _, x in got] == ["type_differs", "no_quote", "no_quote_fields"]
