"""Queries over course files: rows of the given tables are written as Markdown, JSON or tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bank as B
from ..operators import integrity as I
from ..operators import textprep as P
from ..sources import files as S
from .bindings import table
from .registry import Registry
from .scratch import scratch

query = Registry()


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _saved(df: DataFrame, value: Column) -> str:
    """A folder of files that hold the value of each row, with a line end behind it."""
    path = scratch(df.sparkSession)
    df.select(value.alias("value")).write.text(path)
    return path


def _written(df: DataFrame, value: Column) -> DataFrame:
    """The texts of such files."""
    return S.read_texts(df.sparkSession, _saved(df, value), "*.txt")


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _bank(spark, d):
    """Parts as questions: with a metadata block, one that isn't adjacent (key % 4 = 1), or one that isn't closed (key % 4 = 2)."""
    c, kind = F.col, F.col("p_partkey") % 4
    block = _text("%%\nchapter: ", c("p_type"), "\nsize: 0\nsize: ", c("p_size"), F.when(kind == 2, "\n").otherwise("\n%%\n"))
    status = F.when(c("p_partkey") % 3 == 0, _text("ocr_status: S", c("p_size") % 5, "\n")).otherwise("")
    step = _text("> starter: take ", c("p_name"), "\n", F.when(c("p_partkey") % 5 == 0, "> status: doubtful\n").otherwise("> status: checked\n"))
    return _parts(spark, d), _text("## Q", c("p_partkey"), "\n\n", F.when(kind == 1, "text before\n").otherwise(""), block, status, F.when(c("p_partkey") % 2 == 0, step).otherwise(""), "end")


def _blocks(spark, d):
    return B.section_blocks(S.read_sections(spark, _saved(*_bank(spark, d)), "*.txt"), r"^##\s+(Q\d+)\s*$")


@query("SELECT 'Q' || p_partkey AS anchor, p_partkey % 4 = 1 AS early_text, p_partkey % 2 = 0 AS has_step FROM part")
def src1_question_files(spark, d):
    """Every question of a folder of Markdown files, wherever a file ends."""
    b = _blocks(spark, d)
    return b.select("anchor", F.col("body").contains("text before").alias("early_text"), F.col("body").contains("> starter:").alias("has_step"))


@query("SELECT p_type AS chapter, p_brand AS theme, CAST(p_partkey AS VARCHAR) AS tag, p_size AS expected_count FROM part WHERE p_partkey % 9 <> 0")
def src2_tag_library(spark, d):
    """Rows with a number; a heading and a rule stand between them, and other rows have none."""
    c = F.col
    row = _text("| ", c("p_type"), " | ", c("p_brand"), " |", c("p_partkey"), " | ", F.when(c("p_partkey") % 9 == 0, "many").otherwise(c("p_size").cast("string")), " |\n| chapter | theme | tag | count |\n| --- | --- | --- | --- |")
    return S.tag_library(_written(_parts(spark, d), row)).select("chapter", "theme", "tag", "expected_count")


def _blocker_text() -> Column:
    c = F.col
    return _text(
        "<!-- item sha=", F.upper(F.sha2("text", 256)), " type=", F.when(c("doc_id") % 8 == 0, "x").otherwise(c("source")), " lines=1-", c("doc_id") % 40 + 1, " -->\n- evidence_source: ", c("doc_id"),
        "\n- source_sha256: ", F.when(c("doc_id") % 10 == 0, "0").otherwise(F.sha2("text", 256)), "\n- lines: 1-", c("doc_id") % 40 + 1, F.when(c("doc_id") % 3 == 0, "\n- reason: old\n- reason: long proof").otherwise(""),
    )


def _blockers(spark, d):
    return S.blockers(_written(table(spark, d, "documents").select("doc_id", "text", "source"), _blocker_text()))


@query("""SELECT sha256(text) AS sha, CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE source END AS item_type, '1-' || (doc_id % 40 + 1) AS ranges, CAST(doc_id AS VARCHAR) AS evidence_source,
CASE WHEN doc_id % 3 = 0 THEN 'long proof' END AS reason FROM documents""")
def src5_blockers(spark, d):
    f = lambda n: F.col("fields").getItem(n).alias(n)
    return _blockers(spark, d).select("sha", "item_type", "ranges", f("evidence_source"), f("reason"))


#: Conversations of a manifest.
PER_MANIFEST = 100


@query(f"SELECT conv_id // {PER_MANIFEST} AS batch, CASE WHEN (conv_id // {PER_MANIFEST}) % 3 = 0 THEN 'open' ELSE 'complete' END AS status, conv_id, turn, sha256(text) AS sha256 FROM conversations WHERE (conv_id // {PER_MANIFEST}) % 5 <> 2")
def src6_manifests(spark, d):
    """One JSON file for so many conversations; some are broken, and left out."""
    c = table(spark, d, "conversations").withColumn("batch", F.floor(F.col("conv_id") / PER_MANIFEST).cast("long"))
    one = c.groupBy("batch").agg(F.collect_list(F.struct("conv_id", "turn", F.sha2("text", 256).alias("sha256"))).alias("outputs"))
    one = one.withColumn("status", F.when(F.col("batch") % 3 == 0, "open").otherwise("complete"))
    value = F.when(F.col("batch") % 5 == 2, F.lit("{broken")).otherwise(F.to_json(F.struct("batch", "status", "outputs")))
    path = scratch(spark)
    one.select(F.col("batch").alias("folder"), value.alias("value")).write.partitionBy("folder").text(path)
    found = S.read_manifests(spark, path, "batch long, status string, outputs array<struct<conv_id: long, turn: long, sha256: string>>", "*.txt")
    return found.select("batch", "status", F.inline("outputs")).select("batch", "status", "conv_id", F.col("turn").cast(dict(c.dtypes)["turn"]).alias("turn"), "sha256")


@query("SELECT 'Q' || p_partkey AS anchor, CASE WHEN p_partkey % 4 IN (0, 3) THEN p_type END AS chapter, CASE WHEN p_partkey % 4 IN (0, 3) THEN CAST(p_size AS VARCHAR) END AS size FROM part")
def prj2_metadata(spark, d):
    m = _blocks(spark, d).withColumn("m", B.metadata(F.col("body")))
    return m.select("anchor", F.col("m").getItem("chapter").alias("chapter"), F.col("m").getItem("size").alias("size"))


@query("""WITH l AS (SELECT doc_id, 0 AS pos, 'd' || doc_id % 50 AS file, 'part ' || doc_id % 7 AS heading, CASE WHEN doc_id % 2 = 0 THEN source END AS alias FROM documents
UNION ALL SELECT doc_id, 1, 'plain' || lang, NULL, NULL FROM documents) SELECT doc_id, pos, file, heading, alias FROM l""")
def prj10_wikilinks(spark, d):
    c = F.col
    link = _text(c("text"), " [[d", c("doc_id") % 50, "#part ", c("doc_id") % 7, F.when(c("doc_id") % 4 == 0, _text("\\|", c("source"))).when(c("doc_id") % 2 == 0, _text("|", c("source"))).otherwise(""), "]] and [[plain", c("lang"), "]] [not [a link]]")
    docs = table(spark, d, "documents").select("doc_id", link.alias("text"))
    return P.wikilinks(docs, id_col="doc_id", text_col="text").select("doc_id", "pos", "file", "heading", "alias")


@query("SELECT 'Q' || p_partkey AS anchor, 'take ' || p_name AS starter FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0")
def prj13_starters(spark, d):
    return B.starters(_blocks(spark, d))


@query("SELECT 'Q' || p_partkey AS anchor, CASE WHEN p_partkey % 3 = 0 THEN 'S' || p_size % 5 ELSE 'PENDING' END AS status FROM part")
def prj14_block_statuses(spark, d):
    return B.block_statuses(_blocks(spark, d), "PENDING")


SECTIONS = ["Stage", "Scope", "Emphasis", "Exclusions"]


def _profiles(spark, d):
    """Customers as profiles: without exclusions (key % 4 = 0), with two scopes (key % 5 = 0), or an empty emphasis (key % 6 = 0)."""
    c, k = F.col, F.col("c_custkey")
    scope = _text("## Scope\n- ", c("c_mktsegment"), "\n-  nation ", c("c_nationkey"), "\n")
    text = _text("# Profile\n## Stage\nreview ", k % 3, "\n", scope, F.when(k % 5 == 0, scope).otherwise(""), "## Emphasis\n", F.when(k % 6 == 0, " \n").otherwise("- proofs\n"), F.when(k % 4 == 0, "").otherwise("## Exclusions\n- none"))
    texts = table(spark, d, "customer").select(k.cast("string").alias("file"), text.alias("text"))
    return B.profile_sections(texts, SECTIONS)


PROFILE_SQL = """WITH p AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS file, c_mktsegment AS m, c_nationkey AS n FROM customer),
s AS (SELECT file, 'Stage' AS section, 'review ' || k % 3 AS items, NULL AS issue FROM p
 UNION ALL SELECT file, 'Scope', m || ';nation ' || n, CASE WHEN k % 5 = 0 THEN 'repeated' END FROM p
 UNION ALL SELECT file, 'Emphasis', CASE WHEN k % 6 = 0 THEN '' ELSE 'proofs' END, CASE WHEN k % 6 = 0 THEN 'empty' END FROM p
 UNION ALL SELECT file, 'Exclusions', CASE WHEN k % 4 = 0 THEN NULL ELSE 'none' END, CASE WHEN k % 4 = 0 THEN 'missing' END FROM p)"""


@query(PROFILE_SQL + " SELECT file, section, items, issue FROM s")
def prj16_profile_sections(spark, d):
    return _profiles(spark, d).select("file", "section", F.array_join("items", ";").alias("items"), "issue")


@query(PROFILE_SQL + " SELECT file, string_agg(section || ' ' || issue, ',' ORDER BY section) AS issues FROM s WHERE issue IS NOT NULL GROUP BY file")
def dq13_profile_rules(spark, d):
    own = _profiles(spark, d).where("issue IS NOT NULL")
    return own.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "section", "issue"))), ",").alias("issues"))


@query("""WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS file, p_partkey AS k FROM part)
SELECT file, 'Paper' AS anchor, 'paper' AS level, 'year' AS missing FROM f WHERE k % 3 <> 0
UNION ALL SELECT file, 'Q1', 'item', 'chapter' FROM f WHERE k % 2 = 0
UNION ALL SELECT file, 'Q2', 'item', CASE WHEN k % 2 = 0 THEN 'chapter,question_type' ELSE 'question_type' END FROM f""")
def dq7_intake_completeness(spark, d):
    """A file for each part: a paper's header, whose fields its two items inherit."""
    k = F.col("p_partkey")
    head = _text("# Paper\n%%\nsource: ", F.col("p_brand"), "\n", F.when(k % 3 == 0, "year: 2020\n").otherwise(""), F.when(k % 2 == 1, "chapter: 1\n").otherwise(""), "%%\n")
    text = _text(head, "## Q1\n%%\nquestion_type: a\n%%\n## Q2\nno fields\n")
    texts = _parts(spark, d).select(k.cast("string").alias("file"), text.alias("text"))
    found = B.intake_completeness(B.blocks(texts), ["source", "year"], ["source", "chapter", "question_type"], "Paper")
    return found.select("file", "anchor", "level", F.array_join("missing", ",").alias("missing"))


@query("""WITH b AS (SELECT doc_id, doc_id % 40 + 1 AS last, len(string_split(text, chr(10))) AS n FROM documents),
i AS (SELECT doc_id, 'marker_differs' AS issue FROM b WHERE doc_id % 10 = 0
 UNION ALL SELECT doc_id, 'no_source' FROM b WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'source_changed' FROM b WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0
 UNION ALL SELECT doc_id, 'out_of_range' FROM b WHERE doc_id % 11 <> 0 AND last > n UNION ALL SELECT doc_id, 'long_without_reason' FROM b WHERE last > 25 AND doc_id % 3 <> 0)
SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def dq9_blocker_issues(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 11 <> 0")
    live = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.sha2("text", 256)).alias("sha256"), F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return I.blocker_issues(_blockers(spark, d), live).groupBy("issue").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 4 <> 3 AS q, sha256(text) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY h, k ORDER BY doc_id) AS seq, count(*) OVER (PARTITION BY h, k) AS n FROM b)
SELECT 'unknown_type' AS issue, count(*) AS n FROM r WHERE k = 5 HAVING count(*) > 0 UNION ALL SELECT 'repeated', count(*) FROM r WHERE seq > 1 HAVING count(*) > 0
UNION ALL SELECT 'type_differs', count(*) FROM r WHERE doc_id % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'no_quote', count(*) FROM r WHERE k NOT IN (1, 5) AND NOT q HAVING count(*) > 0
UNION ALL SELECT 'no_quote_fields', count(*) FROM r WHERE k = 1 HAVING count(*) > 0 UNION ALL SELECT 'bad_quote_lines', count(*) FROM r WHERE k = 2 AND q HAVING count(*) > 0
UNION ALL SELECT 'long_quote_without_reason', count(*) FROM r WHERE k = 3 AND q HAVING count(*) > 0""")
def dq9_quote_rules(spark, d):
    """Items by id: 0 sound, 1 without quote fields, 2 with two ranges, 3 long, 4 long with a reason, 5 of an unknown type; some without the quote, some of another type than the marker's."""
    k, c = F.col("doc_id") % 6, F.col("doc_id")
    lines = F.when(k == 2, "1-2, 4-5").when(k.isin(3, 4), "1-40").otherwise("3-9")
    quote = _text("\n- quote_source: s\n- quote_source_sha256: x\n- quote_lines: ", lines, "\n- quote_sha256: y", F.when(k == 4, "\n- quote_scope_reason: whole proof").otherwise(""))
    kind = F.when(k == 5, "odd").otherwise("final")
    text = _text("<!-- item sha=", F.sha2("text", 256), " type=", kind, " lines=1-", k + 1, " -->\n- type: ", F.when(c % 9 == 0, "open").otherwise(kind), "\n- lines: 1-", k + 1, F.when(k == 1, "").otherwise(quote), F.when(c % 4 == 3, "").otherwise("\n  quote:\n  > said"))
    found = S.blockers(_written(table(spark, d, "documents").select("doc_id", "text"), text))
    return I.blocker_quote_issues(found, final_type="final", types=["final", "open"]).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size > 45 THEN 'too_large' ELSE 'no_brand' END AS rule, count(*) AS n, (SELECT count(*) FROM part WHERE p_size > 45 OR p_brand IS NULL) AS findings FROM part WHERE p_size > 45 OR p_brand IS NULL GROUP BY 1")
def snk4_quality_gate(spark, d):
    """What a blocked job leaves: its findings instead of a part of its result."""
    rule = F.when(F.col("p_size") > 45, "too_large").when(F.col("p_brand").isNull(), "no_brand")
    issues = _parts(spark, d).select("p_partkey", rule.alias("rule")).where("rule IS NOT NULL")
    try:
        B.quality_gate(issues)
    except B.QualityError as blocked:
        return blocked.issues.groupBy("rule").agg(F.count("*").alias("n")).withColumn("findings", F.lit(blocked.count).cast("long"))
    return issues.groupBy("rule").agg(F.count("*").alias("n")).withColumn("findings", F.lit(0).cast("long"))


QUERIES, ORACLES = query.queries, query.oracles
