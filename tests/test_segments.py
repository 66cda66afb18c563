"""win13_segments on texts that the given tables don't have."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from evidence_engine.operators import textprep as P
from evidence_engine.plans import text_queries as T

A = lambda n: "a" * (n - 1)  # a line that counts n
TEXTS = [
    None, "", "\n", "a\n", "a\n\n", "a\r\nb\rc\x0cd e", " ", "　\n  ", "\t",
    "\n".join([A(600), "", A(200), A(900), A(30)]),  # what the cut leaves behind and the next line exceed the budget
    "\n".join([A(501), "", A(400), " " * 300, A(900)]),  # the line that exceeds it is a place to cut as well
    "\n".join([A(1000), "", A(1000), A(1001), "", "", A(999), ""]), "\n".join([A(1500), " " * 600, " " * 600, A(500)]), "\n".join([A(600), "　" * 2, A(600)]),
    "\n".join([" " * 1200, A(5), " " * 700, A(400)]), "\n".join([A(600), "\t", A(600)]), "\n".join([A(500), "", A(499), A(1)]), "\n".join([A(499), "", A(500), A(1)]),
]


def test_odd_texts_equal_sql(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(x for t in TEXTS for x in [t] * 5)]  # each with line feeds doubled and without
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, T.QUERIES["win13_segments"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, segment, start_line, end_line, char_count FROM ({T.ORACLES['win13_segments']})").fetchall())
    assert got == want


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("\n".join([A(6), "", A(2), A(9), A(3)]), [(1, 2, 7), (3, 3, 2), (4, 4, 9), (5, 5, 3)]), ("a\n", [(1, 2, 3)]), ("", [(1, 1, 1)]), ("a\r\nb", [(1, 2, 5)]),
        ("\n".join([A(6), "　", A(5)]), [(1, 2, 8), (3, 3, 5)]), (A(30), [(1, 1, 30)]),
    ],
)
def test_segments(spark, text, parts):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["start_line"], r["end_line"], r["char_count"]) for r in P.segments(d, max_chars=10).orderBy("segment").collect()] == parts
