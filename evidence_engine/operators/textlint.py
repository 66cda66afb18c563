"""Lint rules over texts and their lines. Findings have the columns of the key, rule and detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textprep import strip_code

BULLET = r"^\s*[-*+]\s"
#: What broken math looks like, and math that wants delimiters.
BROKEN_MATH = r"\$\$\$|\\left\$\$|\\right\$\$|(?<!\\)\b(?:frac|qquad|quad|left|right)\{"
BARE_MATH = r"\\(?:frac|dfrac|tfrac|sqrt|int|iint|iiint|sum|prod|lim|partial|nabla|infty|alpha|beta|gamma|theta)\b|[A-Za-z0-9)]\^[{A-Za-z0-9]"
#: Headings and callouts carry no content of their own.
NO_CONTENT = r"^\s*#|^\s*> \[!"
ARROWS = ("→", "->", "\\rightarrow")


def ordered(key: str = "doc_id") -> Window:
    return Window.partitionBy(key).orderBy("line")


def longest_run(lines: DataFrame, flag: Column, *, key: str = "doc_id", breaks: Column | None = None) -> DataFrame:
    """key, longest: the most flagged lines in a row; blank lines neither count nor break, lines of breaks always break."""
    d = lines.where(F.trim("content") != "").withColumn("flag", flag & ~(breaks if breaks is not None else F.lit(False)))
    d = d.withColumn("isl", F.sum((~F.col("flag")).cast("int")).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(key, "isl").agg(F.count_if("flag").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def paragraphs(lines: DataFrame, *, char_class: str = "(?s).", key: str = "doc_id", bullet: str = BULLET) -> DataFrame:
    """key, block, chars (characters of a class) of each group of plain lines in a row; blank lines, headings, tables and bullets break."""
    plain = (F.trim("content") != "") & ~F.col("content").rlike(r"^\s*(#|\|)") & ~F.col("content").rlike(bullet)
    d = lines.withColumn("plain", plain).withColumn("block", F.sum((~F.col("plain")).cast("int")).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("plain").groupBy(key, "block").agg(F.sum(F.regexp_count(F.trim("content"), F.lit(char_class))).alias("chars"))


def context_flag(lines: DataFrame, flag: Column, wanted: Column, n: int = 2, *, key: str = "doc_id") -> DataFrame:
    """Flagged lines without a wanted line within n lines."""
    near = F.max(wanted.cast("int")).over(ordered(key).rowsBetween(-n, n))
    return lines.withColumn("near", near).where(flag & (F.col("near") == 0)).select(key, "line")


def sequence_count(rows: DataFrame, keys: list[str], order: list[str], value: str, sequence: list[str]) -> DataFrame:
    """keys, n: how often the values follow one another."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hit = F.lit(True)
    for k, x in enumerate(sequence):
        hit = hit & F.coalesce(F.lead(value, k).over(w) == x, F.lit(False))
    return rows.withColumn("__hit", hit).groupBy(*keys).agg(F.count_if("__hit").alias("n"))


def signals(docs: DataFrame, char_class: str, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, chars (of a class), bullets, lines (not blank), bullet_share, arrows."""
    filled = F.filter(F.split(text_col, "\n", -1), lambda x: F.trim(x) != "")
    bullets = F.size(F.filter(filled, lambda x: x.rlike(BULLET)))
    d = docs.select(key, F.regexp_count(text_col, F.lit(char_class)).alias("chars"), bullets.alias("bullets"), F.size(filled).alias("lines"), F.regexp_count(text_col, F.lit("->|→|=>")).alias("arrows"))
    return d.withColumn("bullet_share", F.when(F.col("lines") > 0, F.round(F.col("bullets") / F.col("lines"), 4)).otherwise(F.lit(0.0)))


def control_characters(c: Column) -> Column:
    return c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def delimiter_rules(c: Column) -> Column:
    """Names of the broken rules of math delimiters, code aside: broken patterns, and \\left, $$ and $ without a partner. Escaped dollars don't count."""
    clean = strip_code(c)
    odd = lambda x: x % 2 == 1
    single = F.regexp_replace(clean, r"(?s)(?<!\\)\$\$.*?(?<!\\)\$\$", "")
    checks = {
        "known_bad": clean.rlike(BROKEN_MATH),
        "left_right": F.regexp_count(clean, F.lit(r"\\left(?![A-Za-z])")) != F.regexp_count(clean, F.lit(r"\\right(?![A-Za-z])")),
        "odd_display": odd(F.regexp_count(clean, F.lit(r"(?<!\\)\$\$"))),
        "odd_inline": odd(F.regexp_count(single, F.lit(r"(?<!\\)(?<!\$)\$(?!\$)"))),
    }
    return F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in checks.items()]), lambda x: x.isNotNull())


def bare_math(c: Column) -> Column:
    """Whether a command or a power stands outside math and code."""
    clean = F.regexp_replace(strip_code(c), r"(?s)(?<!\\)\$\$.*?(?<!\\)\$\$", "")
    return F.regexp_replace(clean, r"(?d)(?<!\\)(?<!\$)\$.*?(?<!\\)\$(?!\$)", "").rlike(BARE_MATH)


def first_line_is(c: Column, marker: str) -> Column:
    return F.element_at(F.split(c, "\n", -1), 1) == marker


def has_chain(c: Column, words: tuple[str, ...] = (), *, least: int = 3) -> Column:
    """Whether a text shows a chain: enough arrows, or one of some words."""
    arrows = reduce(lambda a, b: a + b, [(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))) / len(x) for x in ARROWS])
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], arrows >= least)


def lint(docs: DataFrame, lines: DataFrame, *, char_class: str, limits: dict[str, float], key: str = "doc_id", text_col: str = "text", chain: tuple[str, ...] = (), bullet: str = BULLET) -> DataFrame:
    """key, rule, severity: length bands, no paragraph of prose, bullet share and runs, long paragraphs, missing chain.

    Lengths count the characters of a class. Content lines are those that are neither blank nor headings nor callouts. limits: short_error, short_warning,
    prose (length that one paragraph has at least, in a text that isn't too short), bullet_share, bullet_run, paragraph. chain: words that stand for one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    s = docs.select(key, F.regexp_count(text, F.lit(char_class)).alias("chars"), has_chain(text, chain).alias("chain"))
    own = lines.where(F.trim("content") != "")
    content = ~F.col("content").rlike(NO_CONTENT)
    share = own.where(content).groupBy(key).agg((F.count_if(F.col("content").rlike(bullet)) / F.count("*")).alias("bullet_share"))
    run = longest_run(lines, F.col("content").rlike(bullet), key=key, breaks=~content)
    long = paragraphs(lines, char_class=char_class, key=key, bullet=bullet).groupBy(key).agg(F.max("chars").alias("paragraph"))
    d = s.join(share, key, "left").join(run, key, "left").join(long, key, "left")
    level = lambda n, sev: F.struct(F.lit(n).alias("rule"), F.lit(sev).alias("severity"))
    checks = [
        F.when(F.col("chars") < limits["short_error"], level("short", "error")).when(F.col("chars") < limits["short_warning"], level("short", "warning")),
        F.when((F.col("chars") >= limits["short_error"]) & (F.coalesce("paragraph", F.lit(0)) < limits["prose"]), level("no_prose", "error")),
        F.when(F.coalesce("bullet_share", F.lit(0.0)) > limits["bullet_share"], level("bullets", "warning")),
        F.when(F.coalesce("longest", F.lit(0)) > limits["bullet_run"], level("bullet_run", "warning")),
        F.when(F.coalesce("paragraph", F.lit(0)) > limits["paragraph"], level("long_paragraph", "warning")),
        F.when(~F.col("chain"), level("no_chain", "warning")),
    ]
    return d.select(key, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("r")).select(key, "r.rule", "r.severity")


def has_heading(c: Column, heading: str) -> Column:
    """Whether a heading holds a text, white space aside."""
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    heads = F.filter(F.split(c, "\n", -1), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    return F.exists(heads, lambda x: bare(F.regexp_replace(x, r"^#{1,6}\s+", "")).contains("".join(heading.split())))


def _issues(docs: DataFrame, key: str, checks: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(sev).alias("severity"))) for c, n, sev in checks]), lambda x: x.isNotNull())
    return docs.select(key, F.explode(found).alias("r")).select(key, "r.rule", "r.severity")


def start_card_issues(docs: DataFrame, *, start: list[str], answers: list[str], head: int = 500, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, rule, severity: a start token that the first characters lack, and no answer token in the whole text. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lacks = F.exists(F.array(*map(F.lit, start)), lambda x: ~F.contains(F.substring(text, 1, head), x))
    silent = ~F.exists(F.array(*map(F.lit, answers)), lambda x: F.contains(text, x))
    return _issues(docs, key, [(lacks, "start", "error"), (silent, "answers", "error")])


def grounding_issues(docs: DataFrame, *, headings: list[str], probes: list[str], key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, rule, severity: none of the source headings, or not all probe tokens, in the whole text. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sourced = F.lit(False)
    for h in headings:
        sourced = sourced | has_heading(text, h)
    lacks = F.exists(F.array(*map(F.lit, probes)), lambda x: ~F.contains(text, x))
    return _issues(docs, key, [(~sourced, "sources", "warning"), (lacks, "probes", "warning")])


def headings(c: Column) -> Column:
    """The titles of all headings, in order."""
    heads = F.filter(F.split(c, "\n", -1), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    return F.transform(heads, lambda x: F.trim(F.regexp_replace(x, r"^#{1,6}\s+", "")))


def _bare(c: Column) -> Column:
    """A title without white space and punctuation."""
    return F.regexp_replace(c, r"[\s`/／：:、，,。.!！?？（）()]+", "")


def template_count(titles: Column, template: list[str]) -> Column:
    """How often a template's headings follow one another."""
    starts = F.sequence(F.lit(0), F.size(titles) - len(template))
    wanted = [_bare(F.lit(t)) for t in template]
    hit = lambda i: reduce(lambda a, b: a & b, [F.contains(_bare(F.get(titles, i + k)), w) for k, w in enumerate(wanted)])
    return F.when(F.size(titles) < len(template), 0).otherwise(F.size(F.filter(starts, hit)))


def unexplained_math(c: Column, char_class: str, words: list[str], *, least: int = 20, around: int = 2) -> Column:
    """Whether display math stands in a text, and no line of it has an explanation within some lines: enough characters and a word."""
    lines = F.split(c, "\n", -1)
    shown = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"\$\$|\\\[|\\\]"))

    def told(i: Column) -> Column:
        low = F.greatest(F.lit(0), i - around)
        near = F.array_join(F.slice(lines, low + 1, i + around + 1 - low), "\n")
        return (F.regexp_count(near, F.lit(char_class)) >= least) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(near, w))

    return (F.size(shown) > 0) & ~F.exists(shown, told)


def structure_issues(
    docs: DataFrame, *, groups: dict[str, list[str]], entry: list[str], phrases: list[str], template: list[str], char_class: str, words: list[str], key: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """key, rule, severity: phrases of a bare checklist, a missing group of headings, a template once or repeated, math that nothing
    explains, and no heading to enter by. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has = lambda names: reduce(lambda a, b: a | b, [has_heading(text, h) for h in names])
    d = docs.withColumn("__n", template_count(headings(text), template))
    checks = [
        (F.exists(F.array(*map(F.lit, phrases)), lambda x: F.contains(text, x)), "checklist", "error"),
        *[(~has(names), f"no_{name}", "error") for name, names in groups.items()],
        (F.col("__n") >= 2, "template_repeated", "error"), (F.col("__n") == 1, "template_once", "warning"),
        (unexplained_math(text, char_class, words), "unexplained_math", "warning"), (~has(entry), "no_entry", "warning"),
    ]
    return _issues(d, key, checks)


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def chapter_role(name: Column, suffixes: dict[str, str], default: str = "main") -> Column:
    """struct(key, role): the role of the first suffix that a name ends with, and the name without it."""
    role, key = F.lit(default), name
    for suffix, r in reversed(list(suffixes.items())):
        hit = name.endswith(suffix)
        role, key = F.when(hit, r).otherwise(role), F.when(hit, F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(key)
    return F.struct(key.alias("key"), role.alias("role"))


def role_completeness(files: DataFrame, required: str, *, single_ok: bool = False, exempt: DataFrame | None = None) -> DataFrame:
    """key, roles, complete: whether a key has the required role, or one role alone where that is allowed, for all keys or for
    those that a manifest exempts (exempt: key)."""
    g = files.groupBy("key").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    single = F.lit(single_ok)
    if exempt is not None:
        g = g.join(exempt.select("key", F.lit(True).alias("__exempt")).distinct(), "key", "left")
        single = single | F.coalesce("__exempt", F.lit(False))
    return g.select("key", F.array_join("roles", ",").alias("roles"), (F.array_contains("roles", required) | ((F.size("roles") == 1) & single)).alias("complete"))
