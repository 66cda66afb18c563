from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, line string, row int, words int, score double, kept_text string, doc long, fp long, length int"


def frame(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text), with extra columns whose names operators use inside."""
    extra = ("en", "s", 0, "k", "l", 1, 2, 0.5, "old", 9, 8, 7)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], schema)


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["ba", "de", "gi", "lo", "mu", "ne", "pa", "ri", "so", "tu", "ka", "fe"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


def edge_rows():
    """Nulls, empty and very long texts, repeated rows, one doc_id with two texts."""
    return [
        (None, None), (None, "no id here, but a line of text"), (1, None), (2, ""), (3, " \t\n \x0b"), (4, prose(30_000, 1)), (5, prose(40, 2)), (5, prose(40, 2)),
        (6, prose(50, 3)), (6, prose(60, 4)), (7, "É ñ 中文 \U0001f600 a"), (8, "\n\n\n"), (9, "x" * 200_000),
    ]
