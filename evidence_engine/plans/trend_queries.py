"""Trend queries over the item bank, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trends as T
from ..operators import views as V
from .bindings import FACTS_SQL, LONG_FORMS, RECENT_SPAN, UNKNOWN_FORM, item_facts
from .registry import Registry
from .scratch import kept

HOW = {"recent_span": RECENT_SPAN, "long_forms": LONG_FORMS, "unknown": UNKNOWN_FORM, "keep": kept}
query = Registry()


PERIOD_SQL = f"""{FACTS_SQL},
dims AS (SELECT paper_type, max(year) - {RECENT_SPAN} + 1 AS recent_start FROM facts WHERE year IS NOT NULL GROUP BY paper_type),
own AS (SELECT f.*, CASE WHEN year < recent_start THEN 'historical' ELSE 'recent' END AS period FROM facts f JOIN dims USING (paper_type) WHERE year IS NOT NULL)"""


def profile_sql(entity: str, name: str = "prof", migrate: str | None = None) -> str:
    """CTEs that end in a profile per entity and paper type."""
    n = name
    return f"""
{n}_keyed AS (SELECT *, {entity} AS entity FROM own),
{n}_sizes AS (
  SELECT paper_type, count(DISTINCT CASE WHEN period = 'historical' THEN year END) AS h_years, count(DISTINCT CASE WHEN period = 'recent' THEN year END) AS r_years,
         count(DISTINCT CASE WHEN period = 'historical' THEN paper END) AS h_papers, count(DISTINCT CASE WHEN period = 'recent' THEN paper END) AS r_papers
  FROM own GROUP BY paper_type),
{n}_pairs AS (SELECT * FROM (SELECT DISTINCT {entity} AS entity FROM facts) CROSS JOIN {n}_sizes),
{n}_m AS (
  SELECT entity, paper_type,
    {", ".join(f"count(DISTINCT CASE WHEN period = '{w}' THEN year END) AS {p}_hits, count(*) FILTER (WHERE period = '{w}') AS {p}_items, count(*) FILTER (WHERE period = '{w}' AND form <> '{UNKNOWN_FORM}') AS {p}_forms, count(score) FILTER (WHERE period = '{w}') AS {p}_scores, round(sum(score) FILTER (WHERE period = '{w}'), 4) AS {p}_total, round(median(score) FILTER (WHERE period = '{w}'), 4) AS {p}_median" for p, w in (("h", "historical"), ("r", "recent")))},
    min(year) AS first_seen, max(year) AS last_seen
  FROM {n}_keyed GROUP BY entity, paper_type),
{n}_fc AS (SELECT entity, paper_type, period, paper, form, count(*) AS c FROM {n}_keyed WHERE form <> '{UNKNOWN_FORM}' GROUP BY ALL),
{n}_fs AS (SELECT *, c / sum(c) OVER (PARTITION BY entity, paper_type, period, paper) AS s FROM {n}_fc),
{n}_fp AS (SELECT entity, paper_type, period, count(DISTINCT paper) AS papers FROM {n}_fc GROUP BY entity, paper_type, period),
{n}_fd AS (
  SELECT entity, paper_type, period, form, round(sum(s) / max(papers), 4) AS share
  FROM {n}_fs JOIN {n}_fp USING (entity, paper_type, period) GROUP BY entity, paper_type, period, form),
{n}_long AS (
  SELECT entity, paper_type, period, round(sum(CASE WHEN form IN ('AF', 'AO') THEN share ELSE 0 END), 4) AS l FROM {n}_fd GROUP BY entity, paper_type, period),
{n}_y AS (SELECT DISTINCT paper_type, year FROM own),
{n}_grid AS (
  SELECT p.entity, p.paper_type, y.year, count(k.anchor) AS n
  FROM {n}_pairs p JOIN {n}_y y ON p.paper_type = y.paper_type
  LEFT JOIN {n}_keyed k ON k.entity = p.entity AND k.paper_type = p.paper_type AND k.year = y.year GROUP BY p.entity, p.paper_type, y.year),
{n}_steps AS (SELECT *, n > 0 AS present, lag(n > 0) OVER w AS before FROM {n}_grid WINDOW w AS (PARTITION BY entity, paper_type ORDER BY year)),
{n}_isl AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM present THEN 1 ELSE 0 END) OVER (PARTITION BY entity, paper_type ORDER BY year) AS isl FROM {n}_steps),
{n}_runs AS (SELECT entity, paper_type, isl, bool_or(present) AS present, count(*) AS len, row_number() OVER (PARTITION BY entity, paper_type ORDER BY isl DESC) AS back FROM {n}_isl GROUP BY entity, paper_type, isl),
{n}_feat AS (
  SELECT entity, paper_type, coalesce(max(CASE WHEN back = 1 AND present THEN len END), 0) AS present_run,
         coalesce(max(CASE WHEN back = 1 AND NOT present THEN len END), 0) AS absent_run, count(*) - 1 AS transitions,
         coalesce(max(CASE WHEN back = 1 AND present THEN len END), 0) >= 2 AND coalesce(max(CASE WHEN back = 2 AND NOT present THEN len END), 0) >= 2
           AND bool_or(back >= 3 AND present) AS has_return,
         coalesce(bool_or(back = 1 AND present), false) AS latest_present
  FROM {n}_runs GROUP BY entity, paper_type),
{n}_all AS (
  SELECT p.entity, p.paper_type, h_years, r_years, h_papers, r_papers, first_seen, last_seen,
    {", ".join(f"coalesce({p}_hits, 0) AS {p}_hits, coalesce({p}_items, 0) AS {p}_items, coalesce({p}_forms, 0) AS {p}_forms, coalesce({p}_scores, 0) AS {p}_scores, coalesce({p}_total, 0.0::DOUBLE) AS {p}_total, {p}_median, CASE WHEN {p}_years > 0 THEN round(coalesce({p}_hits, 0) / {p}_years, 4) END AS {p}_rate, CASE WHEN {p}_papers > 0 THEN round(coalesce({p}_items, 0) / {p}_papers, 4) END AS {p}_per_paper, CASE WHEN {p}_papers > 0 THEN round(coalesce({p}_total, 0) / {p}_papers, 4) END AS {p}_score_per_paper" for p in "hr")},
    lh.l AS h_long, lr.l AS r_long, present_run, absent_run, transitions, has_return, latest_present
  FROM {n}_pairs p LEFT JOIN {n}_m m ON p.entity = m.entity AND p.paper_type = m.paper_type
  LEFT JOIN {n}_long lh ON lh.entity = p.entity AND lh.paper_type = p.paper_type AND lh.period = 'historical'
  LEFT JOIN {n}_long lr ON lr.entity = p.entity AND lr.paper_type = p.paper_type AND lr.period = 'recent'
  JOIN {n}_feat f ON f.entity = p.entity AND f.paper_type = p.paper_type),
{n}_t AS (
  SELECT *, round(coalesce(r_rate, 0) - coalesce(h_rate, 0), 4) AS delta,
    CASE WHEN h_years < 3 OR r_years < 3 THEN 'THIN'
         WHEN coalesce(h_rate, 0) = 0 AND r_hits >= 2 AND latest_present THEN 'FIRST'
         WHEN has_return THEN 'RETURN'
         WHEN coalesce(r_rate, 0) >= 0.5::DOUBLE AND coalesce(r_rate, 0) - coalesce(h_rate, 0) >= 0.3::DOUBLE AND latest_present THEN 'WARM'
         WHEN coalesce(h_rate, 0) >= 0.5::DOUBLE AND coalesce(r_rate, 0) <= 0.25::DOUBLE AND absent_run >= 2 THEN 'COOL'
         WHEN coalesce(h_rate, 0) >= 0.6::DOUBLE AND coalesce(r_rate, 0) >= 0.75::DOUBLE AND latest_present THEN 'CORE'
         WHEN transitions >= 3 THEN 'CYCLE' ELSE 'FLAT' END AS trend FROM {n}_all),
{n}_r AS (
  SELECT *,
    CASE WHEN coalesce(r_rate, 0) = 0 THEN 'NONE' WHEN r_rate >= 0.75::DOUBLE AND coalesce(r_median, 0) >= 8 THEN 'LEVER' WHEN r_rate >= 0.75::DOUBLE THEN 'MAIN'
         WHEN r_rate >= 0.5::DOUBLE THEN 'MID' WHEN trend IN ('FIRST', 'RETURN', 'WARM') THEN 'LOWRISK' ELSE 'LOWWATCH' END AS role,
    coalesce(h_forms >= 3 AND r_forms >= 3 AND r_long >= 0.6::DOUBLE AND r_long - h_long >= 0.35::DOUBLE, false) AS fu,
    coalesce(h_forms >= 3 AND r_forms >= 3 AND h_long >= 0.6::DOUBLE AND r_long - h_long <= -0.35::DOUBLE, false) AS fd,
    coalesce(h_scores >= 3 AND r_scores >= 3 AND r_median - h_median >= 4, false) AS su,
    coalesce(h_scores >= 3 AND r_scores >= 3 AND r_median - h_median <= -4, false) AS sd FROM {n}_t),
{n} AS (
  SELECT *, list_filter([CASE WHEN fu THEN 'UPSIZE' WHEN fd THEN 'DOWNSIZE' END,
                         CASE WHEN su AND NOT fu THEN 'UPSIZE' WHEN sd AND NOT (fd AND NOT fu) THEN 'DOWNSIZE' END], lambda x: x IS NOT NULL) AS secondary,
    CASE trend WHEN 'FIRST' THEN 1 WHEN 'RETURN' THEN 2 WHEN 'WARM' THEN 3 WHEN 'COOL' THEN 4 WHEN 'CORE' THEN 5 WHEN 'CYCLE' THEN 6 WHEN 'FLAT' THEN 7 ELSE 8 END AS trend_priority,
    CASE role WHEN 'LEVER' THEN 1 WHEN 'MAIN' THEN 2 WHEN 'MID' THEN 3 WHEN 'LOWRISK' THEN 4 WHEN 'LOWWATCH' THEN 5 ELSE 6 END AS role_priority FROM {n}_r)"""


TAG, THEME = profile_sql("tag"), profile_sql("theme")
WITH_TAG, WITH_THEME = f"WITH {PERIOD_SQL},{TAG}", f"WITH {PERIOD_SQL},{THEME}"
IMPORTANCE = "role_priority, trend_priority, coalesce(r_rate, 0) DESC, coalesce(r_total, 0) DESC, entity"
TREND = "trend_priority, abs(delta) DESC, coalesce(r_rate, 0) DESC, coalesce(r_total, 0) DESC, entity"


def facts_of(spark, d, *columns):
    """Some columns of the facts, kept, for operators that read them more than once."""
    return kept(item_facts(spark, d).select("paper", "paper_type", "year", *columns))


def tags(spark, d):
    return T.profiles(item_facts(spark, d), "tag", **HOW)


def themes(spark, d):
    return T.profiles(item_facts(spark, d), "theme", **HOW)


def both_kinds(spark, d):
    return T.profile_entities(item_facts(spark, d), migrate=False, **HOW)


@query(WITH_TAG + " SELECT entity, paper_type, h_rate, r_rate, delta, r_total, trend, role, trend_priority FROM prof")
def flagship_trends(spark, d):
    return tags(spark, d).select("entity", "paper_type", "h_rate", "r_rate", "delta", "r_total", "trend", "role", "trend_priority")


@query(f"WITH {FACTS_SQL}, ys AS (SELECT paper_type, year, max(year) OVER (PARTITION BY paper_type) AS latest FROM facts) SELECT DISTINCT paper_type, year, latest, CASE WHEN year < latest - 2 THEN 'historical' ELSE 'recent' END AS period FROM ys")
def win1_periods(spark, d):
    facts = facts_of(spark, d)
    dims = kept(T.year_dimension(facts, recent_span=RECENT_SPAN))
    own, dims = T.with_period(facts, dims=dims), dims.select("paper_type", "latest")
    return own.select("paper_type", "year", "period").distinct().join(dims, "paper_type").select("paper_type", "year", "latest", "period")


@query(WITH_THEME + " SELECT entity, paper_type, year, n > 0 AS present, n FROM prof_grid")
def jon4_presence_grid(spark, d):
    return T.presence_grid(facts_of(spark, d, "theme"), "theme")


@query(WITH_TAG + ", s AS (SELECT entity, paper_type, string_agg(CASE WHEN n > 0 THEN '1' ELSE '0' END, '' ORDER BY year) AS flags FROM prof_grid GROUP BY entity, paper_type) SELECT * FROM s")
def win5_year_series(spark, d):
    return T.series_features(T.presence(facts_of(spark, d, "tag"), "tag")).select("entity", "paper_type", "flags")


@query(WITH_TAG + " SELECT entity, paper_type, present_run, absent_run FROM prof_feat")
def win2_trailing_runs(spark, d):
    return T.series_features(T.presence(facts_of(spark, d, "tag"), "tag")).select("entity", "paper_type", "present_run", "absent_run")


@query(WITH_TAG + " SELECT entity, paper_type, transitions FROM prof_feat")
def win3_transitions(spark, d):
    return T.series_features(T.presence(facts_of(spark, d, "tag"), "tag")).select("entity", "paper_type", "transitions")


@query(WITH_TAG + " SELECT entity, paper_type, has_return FROM prof_feat")
def win4_return_pattern(spark, d):
    return T.series_features(T.presence(facts_of(spark, d, "tag"), "tag")).select("entity", "paper_type", "has_return")


@query(WITH_TAG + " SELECT entity, paper_type, h_hits, h_years, h_rate, r_hits, r_years, r_rate FROM prof")
def agg2_year_coverage(spark, d):
    return T.period_metrics(item_facts(spark, d), "tag", **HOW).select("entity", "paper_type", "h_hits", "h_years", "h_rate", "r_hits", "r_years", "r_rate")


@query(WITH_TAG + " SELECT entity, paper_type, h_papers, h_per_paper, r_papers, r_per_paper FROM prof")
def agg3_items_per_paper(spark, d):
    return T.period_metrics(item_facts(spark, d), "tag", **HOW).select("entity", "paper_type", "h_papers", "h_per_paper", "r_papers", "r_per_paper")


@query(WITH_THEME + " SELECT * FROM prof_fd")
def agg4_form_distribution(spark, d):
    return T.form_distribution(T.with_period(facts_of(spark, d, "theme", "form"), recent_span=RECENT_SPAN), "theme", unknown=UNKNOWN_FORM)


TAG_SHARES = """
tc AS (SELECT entity, paper_type, period, paper, tag, count(*) AS c FROM prof_keyed GROUP BY ALL),
ts AS (SELECT *, c / sum(c) OVER (PARTITION BY entity, paper_type, period, paper) AS s FROM tc),
tp AS (SELECT entity, paper_type, period, count(DISTINCT paper) AS papers FROM tc GROUP BY entity, paper_type, period),
td AS (SELECT entity, paper_type, period, tag, round(sum(s) / max(papers), 4) AS share FROM ts JOIN tp USING (entity, paper_type, period) GROUP BY entity, paper_type, period, tag)"""


@query(WITH_THEME + "," + TAG_SHARES + " SELECT * FROM td")
def agg5_tag_distribution(spark, d):
    own = T.with_period(facts_of(spark, d, "theme", "tag"), recent_span=RECENT_SPAN).withColumn("entity", F.col("theme"))
    return T.equal_weight(own, ["entity", "paper_type", "period"], "tag")


@query(WITH_TAG + " SELECT entity, paper_type, period, l AS long_ratio FROM prof_long")
def agg6_long_ratio(spark, d):
    own = T.with_period(facts_of(spark, d, "tag", "form"), recent_span=RECENT_SPAN)
    return T.long_ratio(T.form_distribution(own, "tag", unknown=UNKNOWN_FORM), LONG_FORMS)


@query(WITH_TAG + " SELECT entity, paper_type, h_scores, h_median, r_scores, r_median FROM prof")
def agg7_score_median(spark, d):
    return T.period_metrics(item_facts(spark, d), "tag", **HOW).select("entity", "paper_type", "h_scores", "h_median", "r_scores", "r_median")


@query(WITH_TAG + " SELECT entity, paper_type, h_total, h_score_per_paper, r_total, r_score_per_paper FROM prof")
def agg8_score_totals(spark, d):
    return T.period_metrics(item_facts(spark, d), "tag", **HOW).select("entity", "paper_type", "h_total", "h_score_per_paper", "r_total", "r_score_per_paper")


METRICS = [f"{p}_{c}" for p in "hr" for c in ("years", "papers", "hits", "rate", "items", "per_paper", "forms", "long", "scores", "total", "score_per_paper", "median")]


@query(WITH_THEME + f" SELECT entity, paper_type, {', '.join(METRICS)} FROM prof")
def agg9_period_metrics(spark, d):
    return T.period_metrics(item_facts(spark, d), "theme", **HOW).select("entity", "paper_type", *METRICS)


BOTH = f"WITH {PERIOD_SQL},{profile_sql('theme', 'th')},{profile_sql('tag', 'tg')}"


@query(BOTH + " SELECT 'theme' AS kind, entity, paper_type, trend, role, delta FROM th UNION ALL SELECT 'tag', entity, paper_type, trend, role, delta FROM tg")
def agg10_two_entity_kinds(spark, d):
    return T.profile_entities(item_facts(spark, d), **HOW).select("kind", "entity", "paper_type", "trend", "role", "delta")


@query(WITH_TAG + " SELECT entity, paper_type, first_seen, last_seen FROM prof")
def agg15_first_last_seen(spark, d):
    return T.period_metrics(item_facts(spark, d), "tag", **HOW).select("entity", "paper_type", "first_seen", "last_seen")


@query(WITH_THEME + "," + TAG_SHARES + " SELECT entity, paper_type, period, tag AS dominant, share FROM td QUALIFY row_number() OVER (PARTITION BY entity, paper_type, period ORDER BY share DESC, tag) = 1")
def agg14_dominant_tag(spark, d):
    own = T.with_period(facts_of(spark, d, "theme", "tag"), recent_span=RECENT_SPAN).withColumn("entity", F.col("theme"))
    return T.dominant(T.equal_weight(own, ["entity", "paper_type", "period"], "tag"), "tag")


@query(WITH_TAG + " SELECT entity, paper_type, trend FROM prof")
def cls1_primary_trend(spark, d):
    return tags(spark, d).select("entity", "paper_type", "trend")


@query(WITH_TAG + " SELECT entity, paper_type, array_to_string(secondary, ',') AS shifts FROM prof")
def cls2_size_shift(spark, d):
    return tags(spark, d).select("entity", "paper_type", F.array_join("secondary", ",").alias("shifts"))


@query(WITH_TAG + " SELECT entity, paper_type, role, role_priority FROM prof")
def cls3_importance_role(spark, d):
    return tags(spark, d).select("entity", "paper_type", "role", "role_priority")


MIGRATION = f"""WITH {PERIOD_SQL},
k AS (SELECT *, tag AS entity, substr(form, 1, 1) AS of FROM own),
tc AS (SELECT entity, paper_type, period, paper, of, count(*) AS c FROM k GROUP BY ALL),
ts AS (SELECT *, c / sum(c) OVER (PARTITION BY entity, paper_type, period, paper) AS s FROM tc),
tp AS (SELECT entity, paper_type, period, count(DISTINCT paper) AS papers FROM tc GROUP BY entity, paper_type, period),
td AS (SELECT entity, paper_type, period, of, round(sum(s) / max(papers), 4) AS share FROM ts JOIN tp USING (entity, paper_type, period) GROUP BY entity, paper_type, period, of),
best AS (SELECT * FROM td QUALIFY row_number() OVER (PARTITION BY entity, paper_type, period ORDER BY share DESC, of) = 1),
keys AS (SELECT entity, paper_type, count(*) FILTER (WHERE period = 'historical') AS h, count(*) FILTER (WHERE period = 'recent') AS r FROM k GROUP BY entity, paper_type),
j AS (
  SELECT keys.*, b.of AS old_tag, b.share AS old_share, a.of AS new_tag, a.share AS new_share,
         (SELECT count(DISTINCT year) FROM k WHERE k.entity = keys.entity AND k.paper_type = keys.paper_type AND k.period = 'recent' AND k.of = a.of) AS new_tag_years,
         coalesce(w.share, 0.0::DOUBLE) AS was
  FROM keys LEFT JOIN best b ON b.entity = keys.entity AND b.paper_type = keys.paper_type AND b.period = 'historical'
  LEFT JOIN best a ON a.entity = keys.entity AND a.paper_type = keys.paper_type AND a.period = 'recent'
  LEFT JOIN td w ON w.entity = keys.entity AND w.paper_type = keys.paper_type AND w.period = 'historical' AND w.of = a.of)
SELECT entity, paper_type, old_tag, old_share, new_tag, new_share, new_tag_years,
       coalesce(h >= 5 AND r >= 3 AND old_tag <> new_tag AND new_share >= 0.4::DOUBLE AND new_share - was >= 0.25::DOUBLE AND new_tag_years >= 2, false) AS migrated FROM j"""


@query(MIGRATION)
def cls4_method_migration(spark, d):
    facts = item_facts(spark, d).withColumn("flag", F.substring("form", 1, 1))
    return T.migrations(facts, "tag", "flag", recent_span=RECENT_SPAN, keep=kept)


@query(f"""WITH {PERIOD_SQL},
o AS (SELECT theme AS entity, paper_type, period, anchor, tag, year, score, form, tie, coalesce(score, 0) AS points,
             row_number() OVER (PARTITION BY theme, paper_type, period, tag ORDER BY year DESC, coalesce(score, 0) DESC, anchor, tie) AS of_tag FROM own),
p AS (SELECT *, row_number() OVER (PARTITION BY entity, paper_type, period ORDER BY CASE WHEN period = 'recent' AND of_tag > 1 THEN 1 ELSE 0 END, year DESC, points DESC, anchor, tie) AS position FROM o)
SELECT entity, paper_type, period, position, anchor, tag, year, score, form FROM p WHERE position <= CASE WHEN period = 'recent' THEN 2 ELSE 1 END""")
def win6_representatives(spark, d):
    return T.representatives(item_facts(spark, d), "theme", recent_span=RECENT_SPAN, keep=kept)


RANKED = ["entity", "paper_type", "rank", "trend", "role", "delta", "r_rate", "r_total"]


@query(WITH_TAG + f" SELECT entity, paper_type, row_number() OVER (PARTITION BY paper_type ORDER BY {TREND}) AS rank, trend, role, delta, r_rate, r_total FROM prof")
def top1_trend_order(spark, d):
    return V.ranking(tags(spark, d), by="trend").select(*RANKED)


@query(WITH_TAG + f" SELECT entity, paper_type, row_number() OVER (PARTITION BY paper_type ORDER BY {IMPORTANCE}) AS rank, trend, role, delta, r_rate, r_total FROM prof")
def top2_importance_order(spark, d):
    return V.ranking(tags(spark, d)).select(*RANKED)


@query(BOTH + f""", u AS (SELECT 'theme' AS kind, * FROM th UNION ALL SELECT 'tag', * FROM tg),
a AS (SELECT *, 'growth' AS alert FROM u WHERE trend IN ('FIRST', 'RETURN', 'WARM') UNION ALL SELECT *, 'method' FROM u WHERE list_has_any(secondary, ['UPSIZE', 'DOWNSIZE']) UNION ALL SELECT *, 'cooling' FROM u WHERE trend = 'COOL'),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_type, alert ORDER BY {TREND}) AS rank FROM a)
SELECT alert, entity, paper_type, rank, trend, role, delta, r_rate, r_total FROM r WHERE rank <= 8""")
def top3_alerts(spark, d):
    return V.alerts(both_kinds(spark, d)).select("alert", *RANKED)


@query(WITH_THEME + f", r AS (SELECT *, row_number() OVER (PARTITION BY paper_type ORDER BY {IMPORTANCE}) AS rank FROM prof) SELECT {', '.join(RANKED)} FROM r WHERE rank <= 3")
def top4_focus(spark, d):
    return V.focus(themes(spark, d)).select(*RANKED)


@query(WITH_THEME + f", r AS (SELECT *, row_number() OVER (PARTITION BY paper_type ORDER BY {IMPORTANCE}) AS rank FROM prof) SELECT {', '.join(RANKED)}, h_rate, r_per_paper FROM r")
def top5_importance_table(spark, d):
    return V.ranking(themes(spark, d)).select(*RANKED, "h_rate", "r_per_paper")


@query(WITH_TAG + f", r AS (SELECT *, row_number() OVER (PARTITION BY paper_type ORDER BY {IMPORTANCE}) AS rank FROM prof WHERE role IN ('LOWRISK', 'LOWWATCH', 'NONE') OR trend = 'COOL') SELECT {', '.join(RANKED)} FROM r")
def top6_low_signals(spark, d):
    return V.low_signals(tags(spark, d)).select(*RANKED)


@query(f"WITH {FACTS_SQL} SELECT paper_type, year, count(DISTINCT paper) AS papers, count(*) AS items FROM facts WHERE year IS NOT NULL GROUP BY paper_type, year")
def top7_year_buckets(spark, d):
    return item_facts(spark, d).where("year IS NOT NULL").groupBy("paper_type", "year").agg(F.count_distinct("paper").alias("papers"), F.count("*").alias("items"))


@query(WITH_THEME + f" SELECT entity, paper_type, row_number() OVER (PARTITION BY paper_type ORDER BY {TREND}) AS rank, array_to_string(list_concat([trend], secondary), ' · ') AS text, h_hits || '/' || h_years AS before, r_hits || '/' || r_years AS now FROM prof")
def top7_trend_appendix(spark, d):
    return V.trend_appendix(themes(spark, d)).select("entity", "paper_type", "rank", "text", "before", "now")


@query(f"WITH {FACTS_SQL} SELECT paper, min(paper_type) AS paper_type, min(year) AS year, count(*) AS items, count(score) AS scored, count(*) FILTER (WHERE form <> '{UNKNOWN_FORM}') AS forms, string_agg(DISTINCT theme, ', ' ORDER BY theme) AS themes FROM facts GROUP BY paper")
def top7_paper_evidence(spark, d):
    return V.paper_evidence(item_facts(spark, d), UNKNOWN_FORM)


@query(WITH_THEME + "," + TAG_SHARES + """,
b AS (SELECT * FROM td QUALIFY row_number() OVER (PARTITION BY entity, paper_type, period ORDER BY share DESC, tag) = 1),
o AS (SELECT theme AS entity, paper_type, anchor, tag, year, tie, coalesce(score, 0) AS points, row_number() OVER (PARTITION BY theme, paper_type, tag ORDER BY year DESC, coalesce(score, 0) DESC, anchor, tie) AS of_tag FROM own WHERE period = 'recent'),
p AS (SELECT *, row_number() OVER (PARTITION BY entity, paper_type ORDER BY CASE WHEN of_tag > 1 THEN 1 ELSE 0 END, year DESC, points DESC, anchor, tie) AS position FROM o),
reps AS (SELECT entity, paper_type, string_agg(anchor, ', ' ORDER BY position) AS reps FROM p WHERE position <= 2 GROUP BY entity, paper_type)
SELECT prof.entity, prof.paper_type, role, trend, delta, h.tag AS old_tag, r.tag AS new_tag, coalesce(reps, '') AS reps
FROM prof LEFT JOIN b h ON h.entity = prof.entity AND h.paper_type = prof.paper_type AND h.period = 'historical'
LEFT JOIN b r ON r.entity = prof.entity AND r.paper_type = prof.paper_type AND r.period = 'recent'
LEFT JOIN reps ON reps.entity = prof.entity AND reps.paper_type = prof.paper_type""")
def top8_theme_view(spark, d):
    facts = item_facts(spark, d)
    moved = T.migrations(facts, "theme", "tag", recent_span=RECENT_SPAN, keep=kept).select("entity", "paper_type", "old_tag", "new_tag")
    reps = T.representatives(facts, "theme", recent_span=RECENT_SPAN, keep=kept).where("period = 'recent'").groupBy("entity", "paper_type")
    reps = reps.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "anchor"))), lambda x: x["anchor"]), ", ").alias("reps"))
    out = T.profiles(facts, "theme", **HOW).join(moved, ["entity", "paper_type"], "left").join(reps, ["entity", "paper_type"], "left")
    return out.select("entity", "paper_type", "role", "trend", "delta", "old_tag", "new_tag", F.coalesce("reps", F.lit("")).alias("reps"))


@query(WITH_THEME + ", x AS (SELECT paper_type, CAST(greatest(10, round(max(coalesce(r_total, 0)) + 5)) AS BIGINT) AS axis_max FROM prof GROUP BY paper_type) SELECT entity, paper_type, CAST(round(coalesce(h_rate, 0) * 100) AS INTEGER) AS historical, CAST(round(coalesce(r_rate, 0) * 100) AS INTEGER) AS recent, CAST(round(delta * 100) AS INTEGER) AS change, coalesce(r_total, 0) AS score, axis_max FROM prof JOIN x USING (paper_type)")
def top9_chart_series(spark, d):
    return V.chart_series(themes(spark, d))


@query(f"WITH {FACTS_SQL}, t AS (SELECT DISTINCT paper_type FROM facts) SELECT paper_type, row_number() OVER (ORDER BY CASE WHEN paper_type IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, paper_type) AS position FROM t")
def top10_paper_type_order(spark, d):
    from ..operators.bank import type_order

    return type_order(item_facts(spark, d), ("1-URGENT", "2-HIGH"))


@query(WITH_THEME + """ SELECT entity, paper_type, h_hits || '/' || h_years || '(' || coalesce(CAST(round(h_rate * 100) AS INTEGER) || '%', '—') || ')' AS coverage,
 CASE WHEN round(delta * 100) >= 0 THEN '+' ELSE '' END || CAST(round(delta * 100) AS INTEGER) || 'pp' AS change,
 coalesce(regexp_replace(regexp_replace(printf('%.4f', r_per_paper), '0+$', ''), '\\.$', ''), '—') AS per_paper FROM prof""")
def prj24_presentation(spark, d):
    p = themes(spark, d)
    return p.select("entity", "paper_type", V.coverage_text(F.col("h_hits"), F.col("h_years"), F.col("h_rate")).alias("coverage"), V.delta_text(F.col("delta")).alias("change"), V.number_text(F.col("r_per_paper")).alias("per_paper"))


@query(WITH_THEME + " SELECT entity, paper_type, period, string_agg(form || ' ' || CAST(round(share * 100) AS INTEGER) || '%', '; ' ORDER BY share DESC, form) AS distribution FROM prof_fd GROUP BY entity, paper_type, period")
def prj24_distribution_text(spark, d):
    own = T.with_period(facts_of(spark, d, "theme", "form"), recent_span=RECENT_SPAN)
    return V.distribution_text(T.form_distribution(own, "theme", unknown=UNKNOWN_FORM), ["entity", "paper_type", "period"], "form")


@query(WITH_TAG + " SELECT entity, paper_type, array_to_string(list_concat([trend], secondary), ' · ') AS text FROM prof")
def prj25_trend_text(spark, d):
    return tags(spark, d).select("entity", "paper_type", V.trend_text().alias("text"))


@query(WITH_THEME + ", e AS (SELECT DISTINCT entity FROM prof) SELECT entity, 'T' || row_number() OVER (ORDER BY entity) AS id FROM e")
def win14_entity_ids(spark, d):
    from ..operators.bank import stable_ids

    return stable_ids(item_facts(spark, d).select(F.col("theme").alias("entity")).distinct(), "entity", "T")


@query(BOTH + " SELECT entity, paper_type, trend FROM th UNION ALL SELECT entity, paper_type, trend FROM tg")
def set1_union(spark, d):
    return both_kinds(spark, d).select("entity", "paper_type", "trend")


@query(WITH_TAG + " SELECT entity, paper_type, list_has_any(secondary, ['UPSIZE', 'DOWNSIZE', 'MIGRATE']) AS changed FROM prof")
def set4_any_overlap(spark, d):
    return tags(spark, d).select("entity", "paper_type", F.arrays_overlap("secondary", F.array(*map(F.lit, T.METHOD))).alias("changed"))


QUERIES, ORACLES = query.queries, query.oracles
