"""Views of the given tables in the library's data model, each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The recent window used on these tables, whose years span 1995 to 2001.
RECENT_SPAN = 3
LONG_FORMS = ("AF", "AO")
UNKNOWN_FORM = "NO"
PENDING = "P"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: a line of an order, whose order is its paper and whose part is its tag."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    score = F.floor(F.col("l_quantity") / 3).cast("double")
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("anchor"),
        F.col("l_orderkey").alias("paper"),
        F.col("o_orderpriority").alias("paper_type"),
        F.year("o_orderdate").alias("year"),
        F.col("p_type").alias("chapter"),
        F.col("p_brand").alias("theme"),
        F.col("l_partkey").cast("string").alias("tag"),
        F.when(score > 0, score).alias("score"),
        F.concat("l_returnflag", "l_linestatus").alias("form"),
        F.col("o_orderstatus").alias("ocr"),
        F.concat_ws("/", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("tie"),
    )


FACTS_SQL = """
facts AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS anchor, l_orderkey AS paper,
         o_orderpriority AS paper_type, CAST(year(o_orderdate) AS INTEGER) AS year, p_type AS chapter, p_brand AS theme,
         CAST(l_partkey AS VARCHAR) AS tag,
         CASE WHEN floor(l_quantity / 3) > 0 THEN CAST(floor(l_quantity / 3) AS DOUBLE) END AS score,
         l_returnflag || l_linestatus AS form, o_orderstatus AS ocr,
         CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
           || '/' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS tie
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning events: event_id, ts (a timestamp), learner, event_type, value, props, k, item_type and judgement."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    judged = F.when(F.col("event_type") == "purchase", "OK").when(F.col("event_type") == "view", "SLOW").when(F.col("event_type") == "click", "STUCK").when(F.col("event_type") == "error", "WRONG").when(F.col("event_type") == "signup", "BLANK")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("learner"), "event_type", "value", "props",
        k.alias("k"), (k % 10).alias("item_type"), judged.alias("judgement"),
    )


LEDGER_SQL = """
ledger AS (
  SELECT event_id, ts, user_id AS learner, event_type, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS item_type,
         CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'view' THEN 'SLOW' WHEN 'click' THEN 'STUCK' WHEN 'error' THEN 'WRONG'
                         WHEN 'signup' THEN 'BLANK' END AS judgement
  FROM events)"""


def injected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with defects put in by id, so that lint rules have something to find."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    by = lambda n: F.col("doc_id") % n == 0
    lines = F.split("text", "\n", -1)
    d = d.withColumn("text", F.when(by(5) & (F.size(lines) >= 2), F.concat_ws("\n\n", F.element_at(lines, 1), F.array_join(F.slice(lines, 2, F.size(lines) - 1), "\n"))).otherwise(F.col("text")))
    d = d.withColumn("text", F.when(by(7), F.concat("text", F.lit("\x07"))).otherwise(F.col("text")))
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("- "), x)).otherwise(x)), "\n")
    d = d.withColumn("text", F.when(by(11), marked).otherwise(F.col("text")))
    d = d.withColumn("text", F.when(by(13), F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")))
    return d.withColumn("text", F.when(by(17), F.concat("text", F.lit("[a_1=b]"))).otherwise(F.col("text")))


INJECTED_SQL = """
i5 AS (SELECT doc_id, lang, source, n_chars,
         CASE WHEN doc_id % 5 = 0 AND contains(text, chr(10))
              THEN substr(text, 1, instr(text, chr(10))) || chr(10) || substr(text, instr(text, chr(10)) + 1) ELSE text END AS text FROM documents),
i7 AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN text || chr(7) ELSE text END AS text) FROM i5),
i11 AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 0 THEN array_to_string(
          list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 2 = 0 THEN '- ' || x ELSE x END), chr(10)) ELSE text END AS text) FROM i7),
i13 AS (SELECT * REPLACE (CASE WHEN doc_id % 13 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS text) FROM i11),
docs AS (SELECT * REPLACE (CASE WHEN doc_id % 17 = 0 THEN text || '[a_1=b]' ELSE text END AS text) FROM i13)"""
