"""Item-bank queries: field rules, integrity, counts, practice and mock papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bank as B
from ..operators import practice as P
from ..operators import trends as T
from .bindings import FACTS_SQL, LEDGER_SQL, LONG_FORMS, PENDING, RECENT_SPAN, UNKNOWN_FORM, item_facts, ledger, table
from .registry import Registry
from .scratch import kept

query = Registry()
W = f"WITH {FACTS_SQL}"


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE l_returnflag END END, o_orderpriority) AS paper_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def prj3_inherit_metadata(spark, d):
    own = F.when(F.col("l_linenumber") % 2 == 0, F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.col("l_returnflag")))
    child = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", own.alias("paper_type"))
    parent = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("paper_type"))
    return B.inherited(child, parent, "l_orderkey", ["paper_type"])


@query("SELECT doc_id, CASE WHEN contains(source, '1') THEN 'midterm' WHEN contains(source, '2') THEN 'final' ELSE 'other' END AS paper_type FROM documents")
def prj4_paper_type(spark, d):
    return table(spark, d, "documents").select("doc_id", B.infer_paper_type(F.col("source"), [("1", "midterm"), ("2", "final")], "other").alias("paper_type"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'unknown' END AS given,
 'paper ' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + o_orderkey % 3 AS VARCHAR) || ' A' AS src, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CASE WHEN given = 'unknown' THEN NULL WHEN o_orderkey % 3 = 1 THEN CAST(y AS INTEGER) END AS year_start FROM s""")
def prj5_academic_year(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    given = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, "unknown")
    source = F.concat(F.lit("paper "), F.col("y").cast("string"), F.lit("-"), (F.col("y") + F.col("o_orderkey") % 3).cast("string"), F.lit(" A"))
    return o.select("o_orderkey", B.academic_year(given, source).alias("year_start"))


@query(W + """ SELECT anchor, tie, CASE WHEN form LIKE 'R%' THEN form WHEN anchor LIKE '%-1' THEN 'calculation' WHEN anchor LIKE '%-2' THEN 'proof' ELSE 'unknown' END AS form,
 CASE WHEN form LIKE 'R%' THEN 'explicit' WHEN anchor LIKE '%-1' OR anchor LIKE '%-2' THEN 'inferred' ELSE 'unknown' END AS form_source FROM facts""")
def prj6_item_form(spark, d):
    explicit = F.when(F.col("form").startswith("R"), F.col("form")).otherwise("  ")
    out = B.item_form(F.col("anchor"), explicit, [("-1$", "calculation"), ("-2$", "proof")], "unknown")
    return item_facts(spark, d).select("anchor", "tie", out.alias("f")).select("anchor", "tie", "f.form", "f.form_source")


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS score FROM events")
def prj7_parse_score(spark, d):
    return table(spark, d, "events").select("event_id", B.parse_score(F.col("props")).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'VERIFIED' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN 'legacy_default' ELSE 'explicit' END AS status_source FROM orders")
def prj8_default_status(spark, d):
    given = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", B.status_with_source(given, "VERIFIED").alias("s")).select("o_orderkey", "s.status", "s.status_source")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'P' || c_custkey ELSE c_name END AS c_name FROM customer")
def prj17_partial_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    patch = rows.where("c_custkey % 3 = 0").select("c_custkey", F.lit("patched").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("P"), F.col("c_custkey").cast("string"))).alias("c_name"))
    return B.patched(rows, patch, "c_custkey", ["c_mktsegment", "c_name"])


@query(W + " SELECT paper_type, count(year) AS dated, count(*) AS items FROM (SELECT paper_type, CASE WHEN paper % 10 <> 0 THEN year END AS year FROM facts) GROUP BY paper_type")
def flt1_known_year(spark, d):
    facts = item_facts(spark, d).select("paper_type", F.when(F.col("paper") % 10 != 0, F.col("year")).alias("year"))
    return facts.groupBy("paper_type").agg(F.count_if(B.dated(F.col("year"))).alias("dated"), F.count("*").alias("items"))


@query(W + f" SELECT paper_type, count(*) FILTER (WHERE form <> '{UNKNOWN_FORM}') AS known, count(*) FILTER (WHERE form IN ('AF', 'AO')) AS long FROM facts GROUP BY paper_type")
def flt2_form_predicates(spark, d):
    return item_facts(spark, d).groupBy("paper_type").agg(F.count_if(B.has_form(F.col("form"), UNKNOWN_FORM)).alias("known"), F.count_if(B.is_long(F.col("form"), LONG_FORMS)).alias("long"))


@query(W + f" SELECT anchor, tie FROM facts WHERE ocr <> '{PENDING}'")
def flt3_exclude_pending(spark, d):
    return B.without_pending(item_facts(spark, d), PENDING).select("anchor", "tie")


DIM_SQL = "dim AS (SELECT CAST(p_partkey AS VARCHAR) AS tag, p_brand AS theme, p_type AS chapter, p_size FROM part)"


def _dimension(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("tag"), F.col("p_brand").alias("theme"), F.col("p_type").alias("chapter"), "p_size")


@query(f"WITH {DIM_SQL} SELECT theme, count(*) AS items FROM lineitem JOIN dim ON CAST(l_partkey AS VARCHAR) = tag GROUP BY theme")
def jon1_fact_dimension(spark, d):
    facts = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("tag"))
    return B.with_theme(facts, _dimension(spark, d)).groupBy("theme").agg(F.count("*").alias("items"))


@query(f"WITH {DIM_SQL} SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS tag FROM lineitem WHERE CAST(l_partkey AS VARCHAR) NOT IN (SELECT tag FROM dim WHERE p_size <= 40)")
def jon2_unknown_keys(spark, d):
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("tag"))
    return B.unknown_keys(facts, _dimension(spark, d).where("p_size <= 40")).select("l_orderkey", "l_linenumber", "tag")


@query("""WITH n AS (SELECT p_partkey, count(l_partkey) AS actual FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT CAST(p_partkey AS VARCHAR) AS tag, 30 + p_partkey % 3 AS expected, actual FROM n WHERE actual <> 30 + p_partkey % 3""")
def jon3_count_mismatch(spark, d):
    dim = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("tag"), (30 + F.col("p_partkey") % 3).alias("expected_count"))
    return B.reconcile_counts(dim, table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("tag")))


@query(W + f", q AS (SELECT anchor, tie, paper FROM facts) SELECT q.anchor, q.tie FROM q WHERE q.paper IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = '{PENDING}')")
def jon7_consumption_guard(spark, d):
    queue = item_facts(spark, d).select("anchor", "tie", "paper")
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderstatus").alias("status"))
    return B.consumption_guard(queue, papers, PENDING).select("anchor", "tie")


@query("""WITH req AS (SELECT o_orderkey AS id, 'n' || o_custkey AS name FROM orders),
res AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS id, 'n' || o_custkey AS name, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0),
byname AS (SELECT name, max(v) AS v FROM res WHERE id = -1 GROUP BY name)
SELECT req.id, round(coalesce(a.v, b.v), 2) AS v, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.name IS NOT NULL THEN 'name' ELSE 'none' END AS by
FROM req LEFT JOIN res a ON a.id = req.id LEFT JOIN byname b ON b.name = req.name""")
def jon12_match_with_fallback(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_totalprice").alias("v"))
    results = o.where("id % 7 <> 0").withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")))
    return P.matched_results(o.select("id", "name"), results, missing=-1).select("id", F.round("v", 2).alias("v"), "by")


@query(W + f"""{''}, own AS (SELECT *, max(year) OVER (PARTITION BY paper_type) - {RECENT_SPAN} + 1 AS rs FROM facts),
o AS (SELECT theme AS entity, paper_type, anchor, tag, year, tie, coalesce(score, 0) AS points, row_number() OVER (PARTITION BY theme, paper_type, tag ORDER BY year DESC, coalesce(score, 0) DESC, anchor, tie) AS of_tag FROM own WHERE year >= rs),
p AS (SELECT *, row_number() OVER (PARTITION BY entity, paper_type ORDER BY CASE WHEN of_tag > 1 THEN 1 ELSE 0 END, year DESC, points DESC, anchor, tie) AS position FROM o)
SELECT entity, paper_type, p.anchor, 'start with ' || substr(comment, 1, 8) AS starter FROM p JOIN (SELECT CAST(p_partkey AS VARCHAR) AS tag, p_name AS comment FROM part WHERE p_partkey % 2 = 0) s ON s.tag = p.tag WHERE position <= 2""")
def jon15_representative_starters(spark, d):
    reps = T.representatives(item_facts(spark, d), "theme", recent_span=RECENT_SPAN, keep=kept).where("period = 'recent'")
    known = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("tag"), F.concat(F.lit("start with "), F.substring("p_name", 1, 8)).alias("starter"))
    return reps.join(known, "tag", "left").where("starter IS NOT NULL").select("entity", "paper_type", "anchor", "starter")


@query(W + " SELECT tag, anchor, tie, row_number() OVER (PARTITION BY tag ORDER BY CASE WHEN paper % 4 = 0 THEN 1 ELSE 0 END, anchor, tie) AS position FROM facts QUALIFY position <= 3")
def jon18_unattempted_first(spark, d):
    facts = item_facts(spark, d)
    attempted = facts.where("paper % 4 = 0").select("paper").distinct()
    return P.unattempted_first(facts, attempted, "paper", ["tag"], ["anchor", "tie"], 3).select("tag", "anchor", "tie", "position")


@query("""SELECT p_partkey, p_brand, p_size + CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS stored, p_size AS current FROM part WHERE p_partkey % 50 = 0""")
def jon21_view_drift(spark, d):
    now = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    stored = now.withColumn("p_size", F.when(F.col("p_partkey") % 50 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    out = P.view_drift(stored, now, ["p_partkey"])
    return out.select("p_partkey", F.col("stored.p_brand").alias("p_brand"), F.col("stored.p_size").alias("stored"), F.col("current.p_size").alias("current"))


@query(W + " SELECT count(*) AS items, count(DISTINCT anchor) AS anchors, count(DISTINCT paper) AS papers, count(DISTINCT tag) AS tags, count(DISTINCT theme) AS themes, count(DISTINCT paper_type) AS paper_types FROM facts")
def agg1_scope_counts(spark, d):
    return B.scope_counts(item_facts(spark, d))


@query(W + " SELECT paper_type, count(DISTINCT paper) AS papers FROM facts GROUP BY paper_type")
def agg1_papers_per_type(spark, d):
    return B.papers_per_type(item_facts(spark, d))


SERIES = "SELECT {k}, sum(n)::BIGINT AS items, string_agg({v} || '=' || n, ',' ORDER BY {v}) AS counts FROM c GROUP BY {k}"


def _flat(df, *keys):
    return df.select(*keys, "items", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"))


@query(W + ", c AS (SELECT paper_type, year, theme, count(*) AS n FROM facts GROUP BY paper_type, year, theme) " + SERIES.format(k="paper_type, year", v="theme"))
def agg11_year_series(spark, d):
    return _flat(B.series_counts(item_facts(spark, d), ["paper_type", "year"], "theme"), "paper_type", "year")


@query(W + ", c AS (SELECT paper, theme, count(*) AS n FROM facts GROUP BY paper, theme) " + SERIES.format(k="paper", v="theme"))
def agg12_paper_series(spark, d):
    return _flat(B.series_counts(item_facts(spark, d), ["paper"], "theme"), "paper")


SOURCED = f""", s AS (SELECT *, CASE WHEN form = '{UNKNOWN_FORM}' THEN 'unknown' WHEN form LIKE 'R%' THEN 'anchor' ELSE 'explicit' END AS form_source, CASE WHEN ocr = 'F' THEN 'legacy_default' ELSE 'explicit' END AS ocr_source FROM facts),
o AS (SELECT paper_type, string_agg(ocr || '=' || n, ';' ORDER BY ocr) AS statuses FROM (SELECT paper_type, ocr, count(*) AS n FROM facts GROUP BY paper_type, ocr) GROUP BY paper_type)"""


@query(W + SOURCED + """ SELECT paper_type, count(*) FILTER (WHERE form_source = 'explicit') AS form_explicit, count(*) FILTER (WHERE form_source = 'anchor') AS form_inferred, count(*) FILTER (WHERE form_source = 'unknown') AS form_unknown,
 count(*) FILTER (WHERE ocr_source = 'explicit') AS status_explicit, count(*) FILTER (WHERE ocr_source = 'legacy_default') AS status_legacy_default,
 count(DISTINCT CASE WHEN year IS NULL THEN paper END) AS unknown_year_papers, count(*) FILTER (WHERE score IS NULL) AS unknown_scores, any_value(statuses) AS statuses FROM s JOIN o USING (paper_type) GROUP BY paper_type""")
def agg13_quality_counts(spark, d):
    """Returned items count as inferred from their anchor, filled orders as of a time without a status."""
    form = F.when(F.col("form") == UNKNOWN_FORM, "unknown").when(F.col("form").startswith("R"), "anchor").otherwise("explicit")
    facts = item_facts(spark, d).withColumn("form_source", form).withColumn("ocr_source", F.when(F.col("ocr") == "F", "legacy_default").otherwise("explicit"))
    told = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return B.quality_counts(facts).withColumn("statuses", told)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS tag, count(l_orderkey) AS items, count(DISTINCT l_orderkey) AS papers,
 coalesce(sum(CASE WHEN floor(l_quantity / 3) > 0 THEN floor(l_quantity / 3) END), 0)::DOUBLE AS score FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def agg16_entity_totals(spark, d):
    return B.entity_totals(_dimension(spark, d), item_facts(spark, d), "tag")


@query(W + " SELECT paper_type, form, count(*) AS items, sum(score) AS points, grouping(paper_type, form) AS level FROM facts GROUP BY ROLLUP (paper_type, form)")
def agg24_paper_breakdown(spark, d):
    return B.paper_breakdown(item_facts(spark, d), "paper_type", "form")


@query(W + " SELECT anchor, tie, seq FROM (SELECT anchor, tie, row_number() OVER (PARTITION BY anchor ORDER BY tie) AS seq FROM facts) WHERE seq > 1")
def win7_duplicate_anchors(spark, d):
    return B.first_of_key(item_facts(spark, d), "anchor", ["tie"]).where("seq > 1").select("anchor", "tie", "seq")


@query(W + """, rows AS (SELECT anchor, tie, CASE WHEN paper % 50 = 0 THEN ' ' ELSE chapter END AS chapter, CASE WHEN paper % 60 = 0 THEN NULL ELSE tag END AS tag, form, ocr FROM facts),
f AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY tie) AS seq FROM rows),
dim AS (SELECT CAST(p_partkey AS VARCHAR) AS tag, p_brand AS theme, 30 AS expected FROM part WHERE p_size <= 45),
a AS (SELECT anchor, 'missing_chapter' AS rule FROM f WHERE trim(chapter) = '' UNION ALL SELECT anchor, 'missing_tag' FROM f WHERE tag IS NULL
  UNION ALL SELECT anchor, 'illegal_form' FROM f WHERE form NOT IN ('AF', 'AO', 'RF', 'NO') UNION ALL SELECT anchor, 'illegal_status' FROM f WHERE ocr NOT IN ('F', 'O', 'P')
  UNION ALL SELECT anchor, 'duplicate_anchor' FROM f WHERE seq > 1
  UNION ALL SELECT anchor, 'unknown_tag' FROM f WHERE seq = 1 AND tag IS NOT NULL AND tag NOT IN (SELECT tag FROM dim)
  UNION ALL SELECT dim.tag, 'count_mismatch' FROM dim LEFT JOIN (SELECT tag, count(*) AS n FROM f WHERE seq = 1 GROUP BY tag) c ON c.tag = dim.tag WHERE coalesce(n, 0) <> 30)
SELECT anchor, rule, count(*) AS n FROM a GROUP BY anchor, rule""")
def dq1_intake_rules(spark, d):
    rows = item_facts(spark, d).select("anchor", F.col("tie").alias("pos"), F.when(F.col("paper") % 50 == 0, " ").otherwise(F.col("chapter")).alias("chapter"), F.when(F.col("paper") % 60 != 0, F.col("tag")).alias("tag"), F.lit("bank").alias("source"), "form", "ocr")
    dim = _dimension(spark, d).where("p_size <= 45").withColumn("expected_count", F.lit(30))
    issues = B.intake_issues(rows, dim, forms=["AF", "AO", "RF", "NO"], statuses=["F", "O", "P"])
    return issues.groupBy("anchor", "rule").agg(F.count("*").alias("n"))


@query("SELECT l.l_orderkey AS a, r.l_orderkey AS b, l.l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) r ON l.l_partkey = r.l_partkey AND r.l_orderkey = l.l_orderkey + 1")
def set5_shared_anchors(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    after = own.select((F.col("l_orderkey") - 1).alias("l_orderkey"), "l_partkey")
    return B.shared_keys(own, after, ["l_orderkey", "l_partkey"]).select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"), "l_partkey")


@query("""WITH now AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY l_orderkey),
was AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS a FROM lineitem WHERE NOT (l_orderkey % 13 = 0 AND l_linenumber = 1) GROUP BY l_orderkey)
SELECT now.l_orderkey, coalesce(now.a = was.a, false) AS same FROM now LEFT JOIN was USING (l_orderkey)""")
def set6_ordered_list_equality(spark, d):
    line = table(spark, d, "lineitem")
    return B.same_lists(line, line.where("NOT (l_orderkey % 13 = 0 AND l_linenumber = 1)"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_linenumber")


MASTERY_TYPES = """
att AS (SELECT *, row_number() OVER (PARTITION BY learner, item_type ORDER BY ts DESC, event_id DESC) AS back FROM ledger),
red AS (SELECT DISTINCT item_type FROM att WHERE learner = 7 AND back = 1 AND judgement IN ('WRONG', 'BLANK')),
green AS (SELECT item_type FROM att WHERE learner = 7 GROUP BY item_type HAVING bool_and(judgement = 'OK') FILTER (WHERE back <= 2) AND count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE back <= 2) = 2),
seen AS (SELECT DISTINCT item_type FROM ledger WHERE learner = 7)"""


@query(f"""WITH {FACTS_SQL},{LEDGER_SQL},{MASTERY_TYPES},
it AS (SELECT anchor, tie, paper, CAST(tag AS INTEGER) % 10 AS item_type, score FROM facts WHERE ocr <> 'P' AND CAST(tag AS INTEGER) % 10 <> 9),
f AS (SELECT it.*, CASE WHEN item_type IN (SELECT item_type FROM red) THEN 1 ELSE 0 END AS is_red, CASE WHEN item_type IN (SELECT item_type FROM green) THEN 1 ELSE 0 END AS is_green,
      CASE WHEN item_type = 3 AND item_type NOT IN (SELECT item_type FROM seen) THEN 1 ELSE 0 END AS untested, CASE WHEN paper % 40 = 0 THEN 1 ELSE 0 END AS attempted FROM it),
o AS (SELECT *, row_number() OVER (PARTITION BY is_green ORDER BY is_red DESC, untested DESC, attempted, coalesce(score, 0) DESC, anchor, tie) AS within FROM f),
k AS (SELECT *, row_number() OVER (ORDER BY is_red DESC, untested DESC, is_green, attempted, coalesce(score, 0) DESC, anchor, tie) AS position FROM o WHERE is_green = 0 OR within <= floor(0.15 * 20))
SELECT anchor, tie, item_type, is_red, is_green, attempted, position FROM k WHERE position <= 20""")
def top11_practice_candidates(spark, d):
    facts = item_facts(spark, d).withColumn("item_type", F.col("tag").cast("int") % 10)
    return P.candidates(
        facts, ledger(spark, d).where("learner = 7"), attempted=(F.col("paper") % 40 == 0), blockers=[3], waived=[9], pending=PENDING, n=20
    ).select("anchor", "tie", "item_type", "is_red", "is_green", "attempted", "position")


@query(f"""WITH {LEDGER_SQL}, f AS (SELECT item_type, count(*) AS n FROM ledger GROUP BY item_type), e AS (SELECT item_type, count(*) AS errors FROM ledger WHERE judgement IN ('WRONG', 'BLANK') GROUP BY item_type),
s AS (SELECT item_type, min_by(event_id, (ts, event_id)) AS starter FROM ledger WHERE judgement = 'OK' AND item_type <> 4 GROUP BY item_type)
SELECT f.item_type, n, errors, coalesce('event ' || starter, 'pending') AS starter, row_number() OVER (ORDER BY n DESC, f.item_type) AS position FROM f JOIN e USING (item_type) LEFT JOIN s USING (item_type) QUALIFY position <= 5""")
def top12_cram_list(spark, d):
    events = ledger(spark, d)
    known = events.where("judgement = 'OK' AND item_type <> 4").groupBy("item_type").agg(F.concat(F.lit("event "), F.min_by("event_id", F.struct("ts", "event_id")).cast("string")).alias("starter"))
    return P.cram_list(events, known, k=5)


@query(f"""WITH {LEDGER_SQL}, att AS (SELECT *, row_number() OVER (PARTITION BY item_type ORDER BY ts DESC, event_id DESC) AS back FROM ledger),
c AS (SELECT item_type, bool_or(back = 1 AND judgement IN ('WRONG', 'BLANK')) AS red, bool_and(judgement = 'OK') FILTER (WHERE back <= 2) AND count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE back <= 2) = 2 AS green FROM att GROUP BY item_type),
s AS (SELECT item_type, min_by(event_id, (ts, event_id)) AS starter FROM ledger WHERE judgement = 'OK' AND item_type <> 4 GROUP BY item_type)
SELECT item_type, CASE WHEN red THEN 'red' ELSE 'yellow' END AS colour, coalesce('event ' || starter, 'pending') AS starter FROM c LEFT JOIN s USING (item_type) WHERE red OR NOT green""")
def top12_starter_list(spark, d):
    events = ledger(spark, d)
    known = events.where("judgement = 'OK' AND item_type <> 4").groupBy("item_type").agg(F.concat(F.lit("event "), F.min_by("event_id", F.struct("ts", "event_id")).cast("string")).alias("starter"))
    return P.starter_list(events, known)


@query(f"WITH {LEDGER_SQL}, n AS (SELECT event_type AS cause, count(*) AS errors FROM ledger WHERE judgement IN ('WRONG', 'BLANK', 'STUCK') GROUP BY event_type) SELECT cause, errors, row_number() OVER (ORDER BY errors DESC, cause) AS position FROM n QUALIFY position <= 2")
def top12_wrong_causes(spark, d):
    return P.top_causes(ledger(spark, d).where("judgement IN ('WRONG', 'BLANK', 'STUCK')"), "event_type", k=2)


@query(W + """, q AS (SELECT form, count(*) AS quota FROM facts WHERE paper = (SELECT min(paper) FROM facts) GROUP BY form),
c AS (SELECT form, anchor, tie, row_number() OVER (PARTITION BY form ORDER BY anchor, tie) AS position FROM facts WHERE paper % 3 <> 0 AND paper <> (SELECT min(paper) FROM facts))
SELECT form, anchor, tie, position FROM c JOIN q USING (form) WHERE position <= quota""")
def top13_mock_paper(spark, d):
    facts = item_facts(spark, d)
    template = facts.join(facts.agg(F.min("paper").alias("paper")), "paper", "left_semi")
    return P.mock_paper(facts.where("paper % 3 <> 0"), template).select("form", "anchor", "tie", "position")


@query(W + " SELECT paper_type, count(*) AS items, sum(score) AS points FROM facts GROUP BY paper_type")
def snk1_publish_result(spark, d):
    """The result as it reads back after it was published twice."""
    from ..plans.scratch import scratch
    from ..sources.files import publish, published

    where = scratch(spark)
    publish(table(spark, d, "region"), where)
    publish(item_facts(spark, d).groupBy("paper_type").agg(F.count("*").alias("items"), F.sum("score").alias("points")), where)
    return published(spark, where)


@query(W + " SELECT 'chapter' AS view, chapter AS name, count(*) AS items FROM facts GROUP BY chapter UNION ALL SELECT 'theme', theme, count(*) FROM facts GROUP BY theme")
def snk2_publish_views(spark, d):
    """Both views as a reader finds them through the pointer."""
    from ..plans.scratch import scratch
    from ..sources.files import publish_views, published_view

    facts, where = item_facts(spark, d), scratch(spark)
    publish_views({n: facts.groupBy(F.col(n).alias("name")).agg(F.count("*").alias("items")) for n in ("chapter", "theme")}, where, "v1")
    views = [published_view(spark, where, n).select(F.lit(n).alias("view"), "name", "items") for n in ("chapter", "theme")]
    return views[0].unionByName(views[1])


# -- With an entity that has no item, and by other plans --------------------------------------------------------------


@query(W + f" SELECT anchor, tie FROM facts WHERE paper IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = '{PENDING}')")
def jon7_consumption_guard_all(spark, d):
    pending = table(spark, d, "orders").where(F.col("o_orderstatus") == PENDING).select(F.col("o_orderkey").alias("paper"))
    return item_facts(spark, d).join(pending, "paper", "left_semi").select("anchor", "tie")


@query("""SELECT tag, count(l_orderkey) AS items, count(DISTINCT l_orderkey) AS papers, coalesce(sum(CASE WHEN floor(l_quantity / 3) > 0 THEN floor(l_quantity / 3) END), 0)::DOUBLE AS score
FROM (SELECT CAST(p_partkey AS VARCHAR) AS tag FROM part UNION ALL SELECT 'unused') LEFT JOIN lineitem ON CAST(l_partkey AS VARCHAR) = tag GROUP BY tag""")
def agg16_entity_totals_all(spark, d):
    dim = _dimension(spark, d).select("tag").unionByName(spark.range(1).select(F.lit("unused").alias("tag")))  # an entity without items
    return B.entity_totals(dim, item_facts(spark, d), "tag")


@query(f"""WITH {FACTS_SQL},{LEDGER_SQL},{MASTERY_TYPES},
it AS (SELECT anchor, tie, paper, CAST(tag AS INTEGER) % 10 AS item_type, score FROM facts WHERE ocr <> 'P' AND CAST(tag AS INTEGER) % 10 <> 9),
f AS (SELECT it.*, CASE WHEN item_type IN (SELECT item_type FROM red) THEN 1 ELSE 0 END AS is_red, CASE WHEN item_type IN (SELECT item_type FROM green) THEN 1 ELSE 0 END AS is_green,
      CASE WHEN item_type = 3 AND item_type NOT IN (SELECT item_type FROM seen) THEN 1 ELSE 0 END AS untested, CASE WHEN paper % 40 = 0 THEN 1 ELSE 0 END AS attempted FROM it),
o AS (SELECT *, row_number() OVER (PARTITION BY is_green ORDER BY is_red DESC, untested DESC, attempted, coalesce(score, 0) DESC, anchor, tie) AS within FROM f),
k AS (SELECT *, row_number() OVER (ORDER BY is_red DESC, untested DESC, is_green, attempted, coalesce(score, 0) DESC, anchor, tie) AS position FROM o WHERE is_green = 0 OR within <= floor(0.15 * 20))
SELECT anchor, tie, item_type, is_red, is_green, attempted, position FROM k WHERE position <= 20""")
def top11_practice_candidates_all(spark, d):
    facts = item_facts(spark, d).withColumn("item_type", F.col("tag").cast("int") % 10)
    return P.candidates(
        facts, ledger(spark, d).where("learner = 7"), attempted=(F.col("paper") % 40 == 0), blockers=[3], waived=[9], pending=PENDING, n=20
    ).select("anchor", "tie", "item_type", "is_red", "is_green", "attempted", "position")


QUERIES, ORACLES = query.queries, query.oracles
