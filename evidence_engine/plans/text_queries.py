"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialogue as G
from ..operators import integrity as I
from ..operators import jobs as J
from ..operators import textlint as X
from ..operators import textprep as P
from .bindings import INJECTED_SQL, injected_documents, table
from .registry import Registry
from .scratch import scratch

query = Registry()
W = f"WITH {INJECTED_SQL}"
HREF = r'href="([^"]*)"'


def docs(spark, d):
    return table(spark, d, "documents")


def pages(spark, d):
    return table(spark, d, "pages")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def src7_fingerprints(spark, d):
    return I.fingerprints(docs(spark, d), "doc_id", "text")


@query("WITH r(scope, prefix) AS (VALUES ('ones', 'src1'), ('all', 'src'), ('two', 'src2')) SELECT DISTINCT scope, doc_id FROM documents JOIN r ON starts_with(source, prefix)")
def src8_scopes(spark, d):
    rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(p).alias("prefix")) for s, p in (("ones", "src1"), ("all", "src"), ("two", "src2"))])).alias("r")).select("r.scope", "r.prefix")
    return I.scoped(docs(spark, d).select("doc_id", "source"), rules, "source").select("scope", "doc_id")


@query("SELECT page_id, pos, chars FROM (SELECT page_id, unnest(range(0, len(p))) AS pos, unnest(list_transform(p, lambda x: length(x))) AS chars FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS p FROM pages))")
def prj1_blocks(spark, d):
    return P.extracted(pages(spark, d), "<p>([^<]*)", id_col="page_id", text_col="html", name="body").select("page_id", "pos", F.length("body").alias("chars"))


@query("SELECT doc_id, md5(replace(regexp_replace(replace(text, 'the', '`the`'), '`[^`\n]*`', '', 'g'), '`', '')) AS h FROM documents")
def prj9_strip_code(spark, d):
    text = F.replace("text", F.lit("the"), F.lit("`the`"))
    return docs(spark, d).select("doc_id", F.md5(F.replace(P.strip_code(text), F.lit("`"), F.lit(""))).alias("h"))


@query(f"SELECT page_id, pos, target FROM (SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS target FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS l FROM pages)) WHERE NOT regexp_matches(target, '(?i)^(https?:|mailto:|data:|#)') AND target <> ''")
def prj11_links(spark, d):
    links = P.extracted(pages(spark, d), HREF, id_col="page_id", text_col="html", name="target").where(~P.external(F.col("target")))
    return links.select("page_id", "pos", P.decoded(F.col("target")).alias("target"))


@query("SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS heading FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS l FROM pages)")
def prj12_headings(spark, d):
    return P.extracted(pages(spark, d), "<h1>([^<]*)</h1>", id_col="page_id", text_col="html", name="heading")


@query("SELECT page_id, CASE WHEN url LIKE '%.org%' AND url LIKE '%x' THEN 'query' WHEN url LIKE '%#top' THEN 'top' ELSE 'main' END AS role, CASE WHEN url LIKE '%#top' THEN substr(url, 1, length(url) - 4) WHEN url LIKE '%.org%' AND url LIKE '%x' THEN substr(url, 1, length(url) - 1) ELSE url END AS key FROM pages")
def prj18_chapter_role(spark, d):
    u = F.col("url")
    role = X.chapter_role(u, {"#top": "top"})
    q = u.contains(".org") & u.endswith("x")
    p = pages(spark, d).select("page_id", u, role.alias("r"))
    return p.select("page_id", F.when(q, "query").otherwise(F.col("r.role")).alias("role"), F.when(q, F.substr(u, F.lit(1), F.length(u) - 1)).otherwise(F.col("r.key")).alias("key"))


@query(W + r" SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\n\x0B\f\r]+$', '') || chr(10)) AS h FROM docs")
def prj19_normalize_newlines(spark, d):
    return injected_documents(spark, d).select("doc_id", F.md5(P.normalize_newlines(F.col("text"))).alias("h"))


@query(W + r""", t AS (SELECT doc_id, text, text || CASE doc_id % 4 WHEN 0 THEN ' \(' || chr(10) || ' x^2 \)' WHEN 1 THEN ' [ see ' || chr(10) || ' it ]' WHEN 2 THEN ' [b_2](u) [c]' ELSE '' END AS told FROM docs)
SELECT doc_id, md5(replace(replace(replace(told, '[a_1=b]', '$$' || chr(10) || 'a_1=b' || chr(10) || '$$'), '\(' || chr(10) || ' x^2 \)', '$x^2$'), '[b_2]', '$$' || chr(10) || 'b_2' || chr(10) || '$$')) AS h FROM t""")
def prj20_repair_math(spark, d):
    """Brackets with and without math, over lines, and before a link's target; LaTeX's delimiters over lines."""
    i = F.col("doc_id") % 4
    more = F.when(i == 0, " \\(\n x^2 \\)").when(i == 1, " [ see \n it ]").when(i == 2, " [b_2](u) [c]").otherwise("")
    return injected_documents(spark, d).select("doc_id", F.md5(P.repair_math(F.concat("text", more))).alias("h"))


MATH_SQL = r"""t AS (SELECT doc_id, text AS raw, CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'so $x_1$ and $$' || chr(10) || 'y' || chr(10) || '$$ or ' || chr(96) || 'c $z$' || chr(96) ELSE '' END AS more FROM documents WHERE NOT contains(coalesce(text, ''), '$'))"""


@query(f"WITH {MATH_SQL} SELECT doc_id, CASE WHEN more = '' THEN CASE WHEN raw = '' THEN 0 ELSE 1 END ELSE 6 END AS n, CASE WHEN more = '' THEN '' ELSE 'inline:$x_1$|display:$$' || chr(10) || 'y' || chr(10) || '$$|code:' || chr(96) || 'c $z$' || chr(96) END AS spans FROM t WHERE raw IS NOT NULL")
def prj9_segments(spark, d):
    """Documents without dollars of their own, with math and code added to some; the segments join to the text again."""
    add = F.when(F.col("doc_id") % 3 == 0, "\nso $x_1$ and $$\ny\n$$ or `c $z$`").otherwise("")
    t = docs(spark, d).where("NOT contains(text, '$')").select("doc_id", F.concat("text", add).alias("t")).select("doc_id", "t", P.math_segments(F.col("t")).alias("s"))
    t = t.where(F.array_join(F.transform("s", lambda x: x["text"]), "") == F.col("t"))
    spans = F.transform(F.filter("s", lambda x: x["kind"] != "text"), lambda x: F.concat_ws(":", x["kind"], x["text"]))
    return t.select("doc_id", F.size("s").alias("n"), F.array_join(spans, "|").alias("spans"))


LINKS = f"l AS (SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS target FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS l FROM pages))"
ASSETS = f"WITH {LINKS}, named AS (SELECT page_id, pos, target, 'p' || page_id || '-' || printf('%03d', row_number() OVER (PARTITION BY page_id ORDER BY target, pos)) AS renamed FROM l)"


def _links(spark, d):
    return P.extracted(pages(spark, d), HREF, id_col="page_id", text_col="html", name="target")


@query("WITH g AS (SELECT page_id, html, regexp_extract_all(html, '" + HREF + "', 1) AS l FROM pages) SELECT page_id, md5(list_reduce(list_prepend(html, list_transform(list_distinct(list_filter(l, lambda x: length(x) % 2 = 0)), lambda x: x)), lambda a, x: replace(a, 'href=\"' || x || '\"', 'href=\"/assets' || x || '\"'))) AS h FROM g")
def prj21_rewrite_targets(spark, d):
    assets = _links(spark, d).select("target").distinct().where("length(target) % 2 = 0").withColumn("renamed", F.concat(F.lit("/assets"), "target"))
    out = P.rewrite_targets(pages(spark, d).select("page_id", "html"), assets, r'(href=")([^"]*)(")', id_col="page_id", text_col="html")
    return out.select("page_id", F.md5("html").alias("h"))


@query(ASSETS + " SELECT page_id, pos, target, renamed FROM named")
def prj22_asset_names(spark, d):
    return P.asset_names(_links(spark, d), ["page_id"], ["target", "pos"], F.concat(F.lit("p"), F.col("page_id").cast("string"))).select("page_id", "pos", "target", "renamed")


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), ''), 'chunk') AS slug FROM pages")
def prj23_slug(spark, d):
    return pages(spark, d).select("page_id", P.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, first, least(first + 499, n_chars) AS last FROM (SELECT doc_id, n_chars, unnest(range(1, n_chars + 1, 500)) AS first FROM documents)")
def prj29_page_ranges(spark, d):
    return J.page_ranges(docs(spark, d).select("doc_id", "n_chars"), F.col("n_chars"), 500).select("doc_id", F.col("first"), "last")


@query("""WITH RECURSIVE u AS (SELECT doc_id, generate_subscripts(l, 1) AS unit, length(unnest(l)) AS bytes FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
s AS (SELECT doc_id, unit, sum(bytes) OVER (PARTITION BY doc_id ORDER BY unit) AS c, max(unit) OVER (PARTITION BY doc_id) AS n FROM u),
r(doc_id, first, last) AS (
  SELECT doc_id, unit, least(unit + 7, n) FROM s WHERE (unit - 1) % 8 = 0
  UNION ALL
  SELECT r.doc_id, CASE WHEN h = 0 THEN r.first ELSE (r.first + r.last) // 2 + 1 END, CASE WHEN h = 0 THEN (r.first + r.last) // 2 ELSE r.last END
  FROM r JOIN s b ON b.doc_id = r.doc_id AND b.unit = r.last LEFT JOIN s a ON a.doc_id = r.doc_id AND a.unit = r.first - 1 CROSS JOIN (VALUES (0), (1)) v(h)
  WHERE b.c - coalesce(a.c, 0) > 1500 AND r.last > r.first)
SELECT r.doc_id, r.first, r.last, CAST(b.c - coalesce(a.c, 0) AS BIGINT) AS bytes, b.c - coalesce(a.c, 0) <= 1500 AS ok
FROM r JOIN s b ON b.doc_id = r.doc_id AND b.unit = r.last LEFT JOIN s a ON a.doc_id = r.doc_id AND a.unit = r.first - 1 WHERE b.c - coalesce(a.c, 0) <= 1500 OR r.last = r.first""")
def prj30_bounded_ranges(spark, d):
    units = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "x")).select("doc_id", (F.col("p") + 1).alias("unit"), F.length("x").alias("bytes"))
    return J.bounded_ranges(units, max_units=8, max_bytes=1500)


@query("SELECT page_id FROM pages WHERE NOT contains(list_extract(string_split(lower(url), '/'), -1), 'page=') AND NOT contains(list_extract(string_split(lower(url), '/'), -1), 'ref') AND NOT list_contains(string_split(lower(url), '/'), 'de') AND regexp_matches(lower(url), '[0-9]$')")
def flt4_certified_path(spark, d):
    ok = I.certified_path(F.col("url"), ["page=", "ref"], ["de"], "") & F.lower("url").rlike("[0-9]$")
    return pages(spark, d).where(ok).select("page_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.quality = 0")
def flt8_unreviewed(spark, d):
    done = table(spark, d, "labels").where("quality <> 0").select("doc_id").distinct()
    return docs(spark, d).select("doc_id").join(done, "doc_id", "left_anti")


@query(f"""WITH {LINKS}, paths AS (SELECT DISTINCT '/' || list_extract(string_split(url, '/'), -1) AS path FROM pages WHERE page_id % 2 = 0 UNION SELECT DISTINCT target || CASE WHEN length(target) % 3 = 0 THEN '.md' ELSE '' END FROM l WHERE length(target) % 5 <> 0),
u AS (SELECT list_extract(string_split(path, '/'), -1) AS name FROM paths GROUP BY 1 HAVING count(*) = 1),
k AS (SELECT page_id, pos, CASE WHEN (page_id + pos) % 3 = 0 THEN list_extract(string_split(target, '/'), -1) ELSE target END AS target FROM l)
SELECT page_id, pos, target, CASE WHEN target IN (SELECT path FROM paths) THEN 'exact' WHEN target || '.md' IN (SELECT path FROM paths) AND NOT contains(list_extract(string_split(target, '/'), -1), '.') THEN 'suffixed'
 WHEN NOT contains(target, '/') AND (target IN (SELECT name FROM u) OR (NOT contains(target, '.') AND target || '.md' IN (SELECT name FROM u))) THEN 'basename' ELSE 'broken' END AS how FROM k""")
def jon5_broken_links(spark, d):
    """The pages' links, some of them by the last part alone."""
    links = _links(spark, d)
    last = F.concat(F.lit("/"), F.element_at(F.split("url", "/"), -1)).alias("path")
    own = pages(spark, d).where("page_id % 2 = 0").select(last)
    named = links.where("length(target) % 5 <> 0").select(F.concat("target", F.when(F.length("target") % 3 == 0, ".md").otherwise("")).alias("path"))
    asked = links.withColumn("target", F.when((F.col("page_id") + F.col("pos")) % 3 == 0, F.element_at(F.split("target", "/"), -1)).otherwise(F.col("target")))
    return I.resolve_links(asked, own.unionByName(named)).select("page_id", "pos", "target", "how")


@query(f"WITH {LINKS}, h AS (SELECT page_id, unnest(string_split(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ')) AS heading FROM pages) SELECT page_id AS doc, substr(target, 2) AS heading FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page_id = l.page_id AND h.heading = substr(l.target, 2))")
def jon6_missing_headings(spark, d):
    links = _links(spark, d).select(F.col("page_id").alias("doc"), F.substr("target", F.lit(2)).alias("heading"))
    heads = pages(spark, d).select(F.col("page_id").alias("doc"), F.explode(F.split(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), " ")).alias("heading"))
    return I.missing_headings(links, heads).select("doc", "heading")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), q AS (SELECT doc_id, ls, 2 AS first, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 9 ELSE 2 END AS last FROM l)
SELECT doc_id, CASE WHEN last > len(ls) THEN 'out_of_range' WHEN doc_id % 4 = 3 THEN 'text' WHEN doc_id % 12 = 0 THEN 'hash' END AS issue FROM q""")
def jon9_quote_evidence(spark, d):
    ls, last = F.split("text", "\n", -1), F.when(F.col("doc_id") % 4 == 1, 3).when(F.col("doc_id") % 4 == 2, 9).otherwise(2)
    said = F.array_join(F.slice(ls, F.lit(2), F.greatest(F.lit(0), F.least(last, F.size(ls)) - 1)), "\n")
    quotes = docs(spark, d).select(
        "doc_id", F.lit(2).alias("first"), last.alias("last"), F.when(F.col("doc_id") % 4 == 3, F.concat(said, F.lit("!"))).otherwise(said).alias("quote"),
        F.when(F.col("doc_id") % 12 == 0, "0").otherwise(F.sha2(said, 256)).alias("sha256"),
    )
    return I.quote_issues(quotes, docs(spark, d)).select("doc_id", "issue")


STORED = "s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents), n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 15 <> 1)"


def _stored_live(spark, d):
    live = I.fingerprints(docs(spark, d), "doc_id", "text")
    stored = live.withColumn("sha256", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("sha256")))
    return stored, live.where("doc_id % 15 <> 1")


@query(f"WITH {STORED} SELECT s.doc_id, CASE WHEN n.h IS NULL THEN 'missing' WHEN n.h <> s.h THEN 'mismatch' ELSE 'ok' END AS verdict FROM s LEFT JOIN n USING (doc_id)")
def jon10_manifest_hashes(spark, d):
    return I.verify_hashes(*_stored_live(spark, d), "doc_id")


@query(f"WITH {STORED} SELECT s.doc_id, CASE WHEN n.h IS NULL THEN 'missing' ELSE 'changed' END AS change FROM s LEFT JOIN n USING (doc_id) WHERE n.h IS DISTINCT FROM s.h")
def jon10_tree_diff(spark, d):
    """Two stored versions, compared from their roots down."""
    (old, new), where = _stored_live(spark, d), scratch(spark)
    before = I.HashTree.write(old, f"{where}/old", "doc_id")
    return before.diff(I.HashTree.write(new, f"{where}/new", "doc_id", levels=before.levels))


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), g AS (SELECT h, min(doc_id) AS first, count(*) AS copies FROM h GROUP BY h HAVING count(*) > 1) SELECT doc_id, first, copies FROM h JOIN g USING (h)")
def jon11_duplicate_content(spark, d):
    return I.duplicate_content(I.fingerprints(docs(spark, d), "doc_id", "text"), "doc_id")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[' || md5(text) || ']' ELSE md5(text) END AS text, turn % 3 <> 0 AS missing FROM conversations")
def jon13_merge_repaired(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("text"))
    fixed = c.where("turn % 3 = 0").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    return P.merge_repaired(c, fixed, ["conv_id", "turn"])


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS h FROM conversations GROUP BY conv_id")
def jon14_concatenate(spark, d):
    return P.merged(table(spark, d, "conversations"), "conv_id", ["turn"], "text").select("conv_id", F.md5("text").alias("h"))


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question_turn FROM conversations")
def jon19_last_question(spark, d):
    return G.last_question(table(spark, d, "conversations").select("conv_id", "turn", "role")).select("conv_id", "turn", "question_turn")


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'schema' WHEN doc_id % 10 = 0 THEN 'stale' ELSE 'current' END AS verdict FROM documents")
def jon20_staleness(spark, d):
    stored, live = _stored_live(spark, d)
    stored = stored.select("doc_id", F.col("sha256").alias("fingerprint"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(2).alias("schema_version"))
    now = I.fingerprints(docs(spark, d), "doc_id", "text").where("doc_id % 11 <> 0").select("doc_id", F.col("sha256").alias("fingerprint"), F.lit(2).alias("schema_version"))
    return I.staleness(stored, now, "doc_id")


@query(W + ", i AS (SELECT 'control' AS rule FROM docs WHERE contains(text, chr(7)) UNION ALL SELECT 'bare_math' FROM docs WHERE contains(text, 'a_1=b')) SELECT rule, 'error' AS severity, count(*) AS n FROM i GROUP BY rule")
def agg21_issue_summary(spark, d):
    t = F.col("text")
    rules = F.filter(F.array(F.when(X.control_characters(t), F.lit("control")), F.when(X.bare_math(F.replace(t, F.lit("a_1=b"), F.lit("a^1=b"))), F.lit("bare_math"))), lambda x: x.isNotNull())
    return X.issue_summary(injected_documents(spark, d).select(F.explode(rules).alias("rule"), F.lit("error").alias("severity")))


@query("""WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS k, sha256(text) AS h FROM documents),
b AS (SELECT CAST('0x' || substr(sha256(k), 1, 8) AS BIGINT) % 4096 AS b, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k, h)) AS h, count(*) AS n FROM f GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n, (SELECT count(DISTINCT h) FROM f) AS contents FROM b""")
def agg22_dataset_fingerprint(spark, d):
    prints = I.fingerprints(docs(spark, d), "doc_id", "text")
    contents = prints.agg(F.count_distinct("sha256")).scalar()
    return I.dataset_fingerprint(prints, "doc_id").withColumn("contents", contents)


KEYWORDS = {"question": ["ing the"], "doubt": ["stupid"], "misconception": ["wrong"], "explanation": ["the", " la ", "der "]}
ITEM_SQL = """q AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question_turn, lower(text) AS t FROM conversations),
k AS (SELECT *, CASE WHEN contains(t, 'next page') THEN 'skipped' WHEN role = 'user' AND contains(t, 'ing the') THEN 'question' WHEN role = 'user' AND contains(t, 'stupid') THEN 'doubt'
 WHEN role = 'assistant' AND contains(t, 'wrong') THEN 'misconception' WHEN role = 'assistant' AND (contains(t, 'the') OR contains(t, ' la ') OR contains(t, 'der ')) THEN CASE WHEN question_turn IS NULL THEN 'skipped' ELSE 'explanation' END ELSE 'other' END AS kind FROM q)"""


@query(f"WITH {ITEM_SQL} SELECT conv_id, turn, kind FROM k")
def cls8_turn_types(spark, d):
    return G.dialogue_items(table(spark, d, "conversations"), KEYWORDS, ["next page"]).select("conv_id", "turn", "kind")


@query(f"WITH {ITEM_SQL} SELECT kind, role, count(*) AS n FROM k GROUP BY kind, role")
def agg23_extraction_counts(spark, d):
    return G.dialogue_items(table(spark, d, "conversations"), KEYWORDS, ["next page"]).groupBy("kind", "role").agg(F.count("*").alias("n"))


LINES = """, ls AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13), ''), '\n$', ''), chr(10)) AS l FROM docs))"""


def _lines(spark, d):
    return P.lines_of(injected_documents(spark, d))


@query(W + r" SELECT doc_id, len(regexp_extract_all(text, '[aeiou]')) AS chars, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^- '))) AS bullets, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM docs")
def agg25_signals(spark, d):
    return X.signals(injected_documents(spark, d), "[aeiou]").select("doc_id", "chars", "bullets", "lines")


@query(W + LINES + r""", f AS (SELECT doc_id, line, regexp_matches(content, '^- ') OR length(content) > 300 AS flag FROM ls WHERE trim(content) <> ''),
i AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS isl FROM f), r AS (SELECT doc_id, isl, count(*) FILTER (WHERE flag) AS n FROM i GROUP BY doc_id, isl) SELECT doc_id, max(n) AS longest FROM r GROUP BY doc_id""")
def win9_longest_run(spark, d):
    return X.longest_run(_lines(spark, d), F.col("content").rlike("^- ") | (F.length("content") > 300))


@query(W + LINES + r""", f AS (SELECT *, trim(content) <> '' AND NOT regexp_matches(content, '^\s*(#|\||[-*+]\s)') AS plain FROM ls), i AS (SELECT *, sum(CASE WHEN plain THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM f)
SELECT doc_id, block, sum(len(regexp_extract_all(content, '[aeiou]')))::BIGINT AS chars FROM i WHERE plain GROUP BY doc_id, block""")
def win11_paragraphs(spark, d):
    return X.paragraphs(_lines(spark, d), char_class="[aeiou]")


@query(W + LINES + """, f AS (SELECT doc_id, line, contains(content, 'a') AS flag, max(CASE WHEN contains(content, 'z') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ls) SELECT doc_id, line FROM f WHERE flag AND near = 0""")
def win12_context(spark, d):
    return X.context_flag(_lines(spark, d), F.col("content").contains("a"), F.col("content").contains("z"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, length(unnest(ls)) + 1 AS n, trim(unnest(ls)) = '' AS blank, len(ls) AS lines FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END, chr(10)) AS ls FROM documents)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM l),
r(doc_id, segment, start_line, end_line, char_count) AS (
  SELECT doc_id, 0, 0, 0, 0::HUGEINT FROM s WHERE line = 1
  UNION ALL
  SELECT doc_id, segment + 1, start_line, e.end_line, (SELECT c FROM s WHERE s.doc_id = x.doc_id AND s.line = e.end_line) - x.base
  FROM (SELECT r.doc_id, r.segment, r.end_line + 1 AS start_line, coalesce((SELECT c FROM s WHERE s.doc_id = r.doc_id AND s.line = r.end_line), 0) AS base FROM r) x,
  LATERAL (SELECT CASE WHEN m.over IS NULL THEN m.lines ELSE coalesce(m.cut, m.over) END AS end_line FROM (
    SELECT max(lines) AS lines, min(CASE WHEN c - x.base > 1000 AND line > x.start_line THEN line END) - 1 AS over,
      max(CASE WHEN blank AND 2 * (c - x.base) > 1000 AND c - x.base <= 1000 THEN line END) AS cut FROM s WHERE s.doc_id = x.doc_id AND s.line >= x.start_line) m) e
  WHERE e.end_line >= x.start_line)
SELECT doc_id, segment, start_line, end_line, CAST(char_count AS INTEGER) AS char_count FROM r WHERE segment > 0""")
def win13_segments(spark, d):
    text = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return P.segments(docs(spark, d).select("doc_id", text.alias("text")), max_chars=1000)


@query("SELECT conv_id, turn, max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS scope FROM conversations")
def win17_block_scope(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return I.previous_marker(c, "conv_id", ["turn"], F.col("role") != "assistant", F.col("turn"), "scope").select("conv_id", "turn", "scope")


@query(W + " SELECT doc_id FROM docs WHERE contains(text, chr(7)) OR doc_id % 19 = 0")
def dq2_control_characters(spark, d):
    text = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("\x7f"))).otherwise(F.col("text"))
    return injected_documents(spark, d).where(X.control_characters(text)).select("doc_id")


MATH = {6: "\\left( $$x", 21: "\nbroken frac{x}", 22: "\n$$$", 10: "\ncosts \\$5 each", 15: "\nuse `$x` and `\\left(` here", 25: "\n$A \\Rightarrow B$"}


@query(r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 6 = 0 THEN '\left( $$x' WHEN doc_id % 21 = 0 THEN chr(10) || 'broken frac{x}' WHEN doc_id % 22 = 0 THEN chr(10) || '$$$' ELSE '' END AS text FROM documents),
c AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\left')) AS l, list_transform(regexp_extract_all(text, '\$+'), lambda x: length(x)) AS runs, regexp_replace(text, '(?s)\$\$.*?\$\$', '', 'g') AS bare FROM t),
r AS (SELECT doc_id, contains(text, '$$$') OR contains(text, 'frac{') AS known, l, list_sum(list_transform(runs, lambda x: x // 2)) AS dd, len(list_filter(regexp_extract_all(bare, '\$+'), lambda x: length(x) = 1)) AS s FROM c)
SELECT doc_id, array_to_string(list_filter([CASE WHEN known THEN 'known_bad' END, CASE WHEN l > 0 THEN 'left_right' END, CASE WHEN dd % 2 = 1 THEN 'odd_display' END, CASE WHEN s % 2 = 1 THEN 'odd_inline' END], lambda x: x IS NOT NULL), ',') AS rules FROM r""")
def dq3_delimiter_balance(spark, d):
    """Math added by id, the first that fits: some broken, some escaped or in code, which the SQL doesn't see."""
    more = F.lit("")
    for n in reversed(MATH):
        more = F.when(F.col("doc_id") % n == 0, F.lit(MATH[n])).otherwise(more)
    return docs(spark, d).select("doc_id", F.concat("text", more).alias("text")).select("doc_id", F.array_join(X.delimiter_rules(F.col("text")), ",").alias("rules"))


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR (doc_id % 25 = 0 AND doc_id % 8 <> 0 AND doc_id % 12 <> 0)")
def dq4_bare_math(spark, d):
    """Commands and powers added by id, also within math and code, where they belong."""
    i = F.col("doc_id")
    more = F.when(i % 9 == 0, "\nso \\frac{1}{x} is").when(i % 8 == 0, "\nand $x^2$ in math").when(i % 12 == 0, "\nand `x^2` in code").when(i % 25 == 0, "\nor x^{2} bare").otherwise("\na_1 = b")
    return docs(spark, d).where(X.bare_math(F.concat("text", more))).select("doc_id")


@query(f"WITH {LINKS}, s AS (SELECT page_id, pos, CASE (page_id + pos) % 6 WHEN 0 THEN ltrim(target, '/') WHEN 1 THEN '../' || target WHEN 2 THEN 'C:' || target WHEN 3 THEN '#top' WHEN 4 THEN 'bare#a/b' ELSE target END AS t FROM l) SELECT page_id, pos, starts_with(t, '#') OR NOT (starts_with(t, '/') OR starts_with(t, '../') OR starts_with(t, './') OR regexp_matches(t, '^[A-Za-z]:/') OR NOT contains(split_part(t, '#', 1), '/')) AS ok FROM s")
def dq5_link_style(spark, d):
    """The pages' links, some written in other ways."""
    kind, t = (F.col("page_id") + F.col("pos")) % 6, F.col("target")
    text = F.when(kind == 0, F.ltrim(t, F.lit("/"))).when(kind == 1, F.concat(F.lit("../"), t)).when(kind == 2, F.concat(F.lit("C:"), t)).when(kind == 3, "#top").when(kind == 4, "bare#a/b").otherwise(t)
    return _links(spark, d).select("page_id", "pos", I.link_style(text).alias("ok"))


@query("SELECT page_id, starts_with(html, '<!DOCTYPE html><html lang=\"en\">') AS derived FROM pages")
def dq6_derived_marker(spark, d):
    first = F.concat_ws("\n", F.substring("html", 1, 31), "html")
    return pages(spark, d).select("page_id", X.first_line_is(first, '<!DOCTYPE html><html lang="en">').alias("derived"))


LINTED = r""", own AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'a -> b → c \rightarrow d' WHEN 1 THEN chr(10) || 'a -> b' WHEN 2 THEN chr(10) || '> [!note] n' || chr(10) || '- one' WHEN 3 THEN chr(10) || 'a mermaid' ELSE '' END AS text FROM docs),
ls AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13), ''), '\n$', ''), chr(10)) AS l FROM own)),
s AS (SELECT doc_id, len(regexp_extract_all(text, '[aeiou]')) AS chars, doc_id % 5 IN (0, 3) OR contains(text, 'mermaid') OR (len(string_split(text, '->')) + len(string_split(text, '→')) + len(string_split(text, '\rightarrow')) - 3 >= 3) AS chain FROM own),
f AS (SELECT doc_id, line, regexp_matches(content, '^\s*[-*+]\s') AS flag, NOT regexp_matches(content, '^\s*#|^\s*> \[!') AS said FROM ls WHERE trim(content) <> ''),
sh AS (SELECT doc_id, count(*) FILTER (WHERE flag) / count(*) AS share FROM f WHERE said GROUP BY doc_id),
i AS (SELECT *, sum(CASE WHEN flag AND said THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS isl FROM f), r AS (SELECT doc_id, isl, count(*) FILTER (WHERE flag AND said) AS n FROM i GROUP BY doc_id, isl), run AS (SELECT doc_id, max(n) AS longest FROM r GROUP BY doc_id),
pf AS (SELECT *, trim(content) <> '' AND NOT regexp_matches(content, '^\s*(#|\||[-*+]\s)') AS plain FROM ls), pi AS (SELECT *, sum(CASE WHEN plain THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM pf),
pg AS (SELECT doc_id, block, sum(len(regexp_extract_all(content, '[aeiou]'))) AS c FROM pi WHERE plain GROUP BY doc_id, block), par AS (SELECT doc_id, max(c) AS paragraph FROM pg GROUP BY doc_id),
a AS (SELECT s.*, coalesce(share, 0) AS share, coalesce(longest, 0) AS longest, coalesce(paragraph, 0) AS paragraph FROM s LEFT JOIN sh USING (doc_id) LEFT JOIN run USING (doc_id) LEFT JOIN par USING (doc_id))"""


@query(W + LINTED + r""" SELECT doc_id, 'short' AS rule, CASE WHEN chars < 200 THEN 'error' ELSE 'warning' END AS severity FROM a WHERE chars < 250 UNION ALL SELECT doc_id, 'no_prose', 'error' FROM a WHERE chars >= 200 AND paragraph < 150
UNION ALL SELECT doc_id, 'bullets', 'warning' FROM a WHERE share > 0.45::DOUBLE UNION ALL SELECT doc_id, 'bullet_run', 'warning' FROM a WHERE longest > 0
UNION ALL SELECT doc_id, 'long_paragraph', 'warning' FROM a WHERE paragraph > 900 UNION ALL SELECT doc_id, 'no_chain', 'warning' FROM a WHERE NOT chain""")
def dq10_chapter_lint(spark, d):
    """With chains and callouts added by id; lengths count vowels."""
    limits = {"short_error": 200, "short_warning": 250, "prose": 150, "bullet_share": 0.45, "bullet_run": 0, "paragraph": 900}
    add = F.element_at(F.array(*map(F.lit, ("\na -> b → c \\rightarrow d", "\na -> b", "\n> [!note] n\n- one", "\na mermaid", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    own = injected_documents(spark, d).withColumn("text", F.concat("text", add))
    return X.lint(own, P.lines_of(own), char_class="[aeiou]", limits=limits, chain=("mermaid",))


@query("SELECT doc_id, contains(substr(text, 1, 500), 'the') AND contains(substr(text, 1, 500), 'la ') AND (contains(text, 'der ') OR contains(text, 'ing the')) AS grounded FROM documents")
def dq11_start_card(spark, d):
    """Cards without a finding; dq11_start_card_issues has the findings of all four rules."""
    issues = X.start_card_issues(docs(spark, d), start=["the", "la "], answers=["der ", "ing the"]).select("doc_id").distinct()
    found = docs(spark, d).select("doc_id").join(issues.withColumn("found", F.lit(True)), "doc_id", "left")
    return found.select("doc_id", F.col("found").isNull().alias("grounded"))


@query("WITH f AS (SELECT split_part(url, '/', 3) AS key, CASE WHEN url LIKE '%#top' THEN 'top' ELSE 'main' END AS role FROM pages) SELECT key, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, bool_or(role = 'main') AS complete FROM f GROUP BY key")
def dq12_role_completeness(spark, d):
    f = pages(spark, d).select(F.split_part("url", F.lit("/"), F.lit(3)).alias("key"), F.when(F.col("url").endswith("#top"), "top").otherwise("main").alias("role"))
    return X.role_completeness(f, "main")


@query(f"WITH {STORED}, c AS (SELECT s.doc_id, CASE WHEN s.doc_id % 9 = 0 THEN 'open' ELSE 'complete' END AS status, s.doc_id % 6 AS unresolved, s.h, n.h AS now FROM s LEFT JOIN n USING (doc_id)) SELECT doc_id, 'status' AS issue FROM c WHERE status <> 'complete' UNION ALL SELECT doc_id, 'unresolved' FROM c WHERE unresolved > 0 UNION ALL SELECT doc_id, 'missing' FROM c WHERE now IS NULL UNION ALL SELECT doc_id, 'changed' FROM c WHERE now <> h")
def dq14_certificates(spark, d):
    stored, live = _stored_live(spark, d)
    c = stored.withColumn("status", F.when(F.col("doc_id") % 9 == 0, "open").otherwise("complete")).withColumn("unresolved", F.col("doc_id") % 6)
    return I.certificate_issues(c, live, "doc_id")


@query("WITH h AS (SELECT doc_id, source, sha256(text) AS h FROM documents), o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM h) SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'no_anchor' WHEN doc_id > first THEN 'duplicate_source' ELSE 'ok' END AS verdict FROM o")
def dq15_bind_checks(spark, d):
    prints = I.fingerprints(docs(spark, d), "doc_id", "text")
    again = I.duplicate_content(prints, "doc_id").where("doc_id > first").select("doc_id", F.lit(1).alias("again"))
    out = prints.join(again, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("doc_id") % 17 == 0, "no_anchor").when(F.col("again") == 1, "duplicate_source").otherwise("ok").alias("verdict"))


@query("""WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS k, sha256(text) AS h FROM documents),
b AS (SELECT CAST('0x' || substr(sha256(k), 1, 8) AS BIGINT) % 4096 AS b, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k, h)) AS h, count(*) AS n FROM f GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM b""")
def agg22_dataset_fingerprint_hash(spark, d):
    return I.dataset_fingerprint(I.fingerprints(docs(spark, d), "doc_id", "text"), "doc_id")


@query(r"""WITH t AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '## The Sources  and limits' WHEN doc_id % 3 = 1 THEN text || chr(10) || 'Sources and limits' ELSE text END, '') AS text FROM documents)
SELECT doc_id, 'start' AS rule, 'error' AS severity FROM t WHERE NOT (contains(substr(text, 1, 500), 'the') AND contains(substr(text, 1, 500), 'la '))
UNION ALL SELECT doc_id, 'answers', 'error' FROM t WHERE NOT (contains(text, 'der ') OR contains(text, 'ing the'))
UNION ALL SELECT doc_id, 'sources', 'warning' FROM t WHERE NOT regexp_matches(text, '(^|\n)#{1,6}[ \t]+[^\n]*(Sources\s*and\s*limits|Open\s*scope)')
UNION ALL SELECT doc_id, 'probes', 'warning' FROM t WHERE NOT (contains(text, 'the') AND contains(text, 'un'))""")
def dq11_start_card_issues(spark, d):
    """All four rules, over whole texts but for the head."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n## The Sources  and limits"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\nSources and limits"))).otherwise(F.col("text"))
    d = docs(spark, d).select("doc_id", text.alias("text"))
    card = X.start_card_issues(d, start=["the", "la "], answers=["der ", "ing the"])
    return card.unionByName(X.grounding_issues(d, headings=["Sources and limits", "Open scope"], probes=["the", "un"]))


STRUCTURED = r"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '# The  whole picture' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '## Intuition' || chr(10) || 'x' || chr(10) || '## Formula / terms' ELSE '' END
 || CASE WHEN doc_id % 10 = 0 THEN chr(10) || '### 1. Intuition' || chr(10) || '### Formula, terms' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '## Ask here' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'line' || chr(10) || '$$a$$' || CASE WHEN doc_id % 8 = 0 THEN chr(10) || 'because aeiou aeiou aeiou aeiou' ELSE '' END ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'in one sentence' ELSE '' END AS text FROM documents), u AS (SELECT * FROM t),
ml AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM t)),
mw AS (SELECT doc_id, contains(content, '$$') OR contains(content, '\[') OR contains(content, '\]') AS shown, string_agg(content, chr(10)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ml),
um AS (SELECT doc_id FROM mw WHERE shown GROUP BY doc_id HAVING NOT bool_or(len(regexp_extract_all(near, '[aeiou]')) >= 20 AND (contains(near, 'because') OR contains(near, 'where'))))"""


@query(STRUCTURED + r""" SELECT doc_id, 'checklist' AS rule, 'error' AS severity FROM u WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'no_picture', 'error' FROM u WHERE doc_id % 2 <> 0
UNION ALL SELECT doc_id, 'template_repeated', 'error' FROM u WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'template_once', 'warning' FROM u WHERE doc_id % 5 = 0 AND doc_id % 10 <> 0
UNION ALL SELECT doc_id, 'unexplained_math', 'warning' FROM um UNION ALL SELECT doc_id, 'no_entry', 'warning' FROM u WHERE doc_id % 3 <> 0""")
def dq10_structure(spark, d):
    """Headings, math and phrases added by id."""
    i = F.col("doc_id")
    add = lambda n, t, r=0: F.when(i % n == r, F.lit(t)).otherwise("")
    text = F.concat(
        F.coalesce("text", F.lit("")), add(2, "\n# The  whole picture"), add(5, "\n## Intuition\nx\n## Formula / terms"), add(10, "\n### 1. Intuition\n### Formula, terms"), add(3, "\n## Ask here"),
        add(4, "\nline\n$$a$$"), add(8, "\nbecause aeiou aeiou aeiou aeiou"), add(7, "\nin one sentence"),
    )
    own = docs(spark, d).select("doc_id", text.alias("text"))
    return X.structure_issues(own, groups={"picture": ["The whole picture", "Overview"]}, entry=["Ask here"], phrases=["in one sentence"], template=["Intuition", "Formula terms"], char_class="[aeiou]", words=["because", "where"])


@query("""WITH f AS (SELECT split_part(url, '/', 3) AS key, CASE WHEN url LIKE '%#top' THEN 'top' ELSE 'side' END AS role FROM pages), g AS (SELECT key, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM f GROUP BY key)
SELECT key, roles, contains(roles, 'top') OR (NOT contains(roles, ',') AND length(key) % 2 = 0) AS complete FROM g""")
def dq12_manifest_exemption(spark, d):
    f = pages(spark, d).select(F.split_part("url", F.lit("/"), F.lit(3)).alias("key"), F.when(F.col("url").endswith("#top"), "top").otherwise("side").alias("role"))
    return X.role_completeness(f, "top", exempt=f.where("length(key) % 2 = 0"))


@query("""SELECT conv_id, 'chunk_not_done' AS issue, turn AS part FROM conversations WHERE turn % 4 = 1 AND conv_id % 3 = 0
UNION ALL SELECT conv_id, 'segment_unrepaired', turn FROM conversations WHERE length(text) % 5 = 0 OR text IS NULL""")
def dq14_chunks_and_segments(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("turn", "part")
    chunks = c.select("conv_id", "part", F.when((F.col("part") % 4 == 1) & (F.col("conv_id") % 3 == 0), F.when(F.col("conv_id") % 2 == 0, "failed")).otherwise("done").alias("status"))
    return I.part_issues(chunks, c.select("conv_id", "part", (F.length("text") % 5 != 0).alias("repaired")), "conv_id")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM h)
SELECT doc_id, 'outside' AS issue FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'no_anchor' FROM documents WHERE NOT regexp_matches(text, '[0-9]{4}') UNION ALL SELECT doc_id, 'duplicate_source' FROM o WHERE doc_id > first""")
def dq15_bind_rules(spark, d):
    """Anchors are the years of a text; the folder goes by id."""
    own = docs(spark, d)
    path = F.concat(F.when(F.col("doc_id") % 13 == 0, "/elsewhere/").otherwise("/course/"), F.col("doc_id").cast("string"))
    outputs = own.select("doc_id", path.alias("path"), F.regexp_extract_all("text", F.lit("[0-9]{4}"), 0).alias("anchors"))
    return I.bind_issues(outputs, I.fingerprints(own, "doc_id", "text"), "/course/", "doc_id")


@query("SELECT conv_id, turn AS part FROM conversations WHERE turn % 4 = 1 AND conv_id % 3 = 0 UNION SELECT conv_id, turn FROM conversations WHERE length(text) % 5 = 0 OR text IS NULL")
def flt8_unresolved_parts(spark, d):
    return dq14_chunks_and_segments(spark, d).select("conv_id", "part").distinct()


QUERIES, ORACLES = query.queries, query.oracles
