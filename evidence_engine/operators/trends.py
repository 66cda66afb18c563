"""Coverage, distributions, presence series and trend classes per entity and paper type.

Facts have the columns paper, paper_type, year (null if unknown), theme, tag, score (null if unknown), form, anchor and
tie (any column that makes an order unique). An entity is a column of the facts, such as theme or tag. Years split at
``latest - recent_span + 1`` of their paper type. Rates are rounded to 4 digits before thresholds see them.

Facts are read twice and never copied: once for what is known per paper type, a closed vocabulary (``year_dimension``; ``keep`` stores those few
rows, so that no plan computes them again), and once for everything else. That pass is one grouping-sets aggregate for all kinds of entities, per
paper and per score, with years as bit sets; counts, forms, medians and series come from its sums. What is known per paper type is a scalar subquery, so no join meets the hot keys that types are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_FORM = "unknown"
LONG_FORMS = ("calculation", "proof", "application", "synthesis")
#: Order of the trend classes and of the roles.
TREND_PRIORITY = {"FIRST": 1, "RETURN": 2, "WARM": 3, "COOL": 4, "CORE": 5, "CYCLE": 6, "FLAT": 7, "THIN": 8}
ROLE_PRIORITY = {"LEVER": 1, "MAIN": 2, "MID": 3, "LOWRISK": 4, "LOWWATCH": 5, "NONE": 6}
GROWTH = ("FIRST", "RETURN", "WARM")
METHOD = ("UPSIZE", "DOWNSIZE", "MIGRATE")


def rounded(c: Column) -> Column:
    return F.round(c, 4)


def rate(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, rounded(numerator / denominator))


def year_dimension(facts: DataFrame, *, recent_span: int = 5) -> DataFrame:
    """paper_type, latest, recent_start, years (sorted), h_years, r_years, h_papers, r_papers: one row per paper type with a known year.

    A paper counts before the split if its first year does, and after it if its last year does; papers' spans and the years come from one aggregate."""
    known = facts.where("year IS NOT NULL AND paper_type IS NOT NULL").select("paper_type", "paper", "year")
    first, last, one = F.min("year").alias("lo"), F.max("year").alias("hi"), F.grouping("paper").alias("year_row")
    spans = known.groupingSets([["paper_type", "paper"], ["paper_type", "year"]], "paper_type", "paper", "year").agg(first, last, one)
    kinds = spans.groupBy("paper_type", "year_row", "lo", "hi").agg(F.count("*").alias("n"))
    d = kinds.groupBy("paper_type").agg(F.collect_list(F.struct("year_row", "lo", "hi", "n")).alias("kinds"))
    d = d.withColumn("years", F.array_sort(F.transform(F.filter("kinds", lambda k: k["year_row"] == 1), lambda k: k["lo"])))
    start = F.array_max("years") - recent_span + 1
    d = d.select("paper_type", F.array_max("years").alias("latest"), start.alias("recent_start"), "years", F.filter("kinds", lambda k: k["year_row"] == 0).alias("papers"))
    out = [F.col(c) for c in ("paper_type", "latest", "recent_start", "years")]
    for p, here, paper in (("h", lambda y: y < F.col("recent_start"), lambda k: k["lo"] < F.col("recent_start")), ("r", lambda y: y >= F.col("recent_start"), lambda k: k["hi"] >= F.col("recent_start"))):
        out.append(F.size(F.filter("years", here)).cast("long").alias(f"{p}_years"))
        out.append(F.aggregate(F.filter("papers", paper), F.lit(0).cast("long"), lambda a, k: a + k["n"]).alias(f"{p}_papers"))
    return d.select(*out)


def paper_types(dims: DataFrame) -> Column:
    """The rows of year_dimension in one array, by paper type; a scalar subquery."""
    return dims.agg(F.array_sort(F.collect_list(F.struct(*dims.columns)))).scalar()


def dimension_of(facts: DataFrame, recent_span: int, keep=None) -> DataFrame:
    dims = year_dimension(facts, recent_span=recent_span)
    return keep(dims) if keep else dims


def of_type(dims: DataFrame, value: str) -> Column:
    """A column of year_dimension for the paper type of a row, by a map in a scalar subquery."""
    return F.try_element_at(dims.agg(F.map_from_entries(F.collect_list(F.struct("paper_type", value)))).scalar(), F.col("paper_type"))


def with_period(facts: DataFrame, *, recent_span: int = 5, dims: DataFrame | None = None) -> DataFrame:
    """facts with period: historical, recent, or null for an unknown year. dims: their year_dimension, where it is known already."""
    start = of_type(year_dimension(facts, recent_span=recent_span) if dims is None else dims, "recent_start")
    return facts.withColumn("period", F.when(F.col("year") < start, "historical").when(F.col("year") >= start, "recent"))


def per_type(own: DataFrame, types: Column, values: list[str], keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """keys and every paper type with its columns of types, and in v the values of own (keys, paper_type, values) or null."""
    d = own.groupBy(*keys).agg(F.collect_list(F.struct("paper_type", *values)).alias("vs"))
    mine = F.get(F.filter("vs", lambda v: v["paper_type"] == F.col("t.paper_type")), 0)
    return d.select(*keys, "vs", F.explode(types).alias("t")).select(*keys, "t.*", mine.alias("v"))


def presence(facts: DataFrame, entity: str, *, recent_span: int = 5) -> DataFrame:
    """entity, paper_type and series: an array of (year, present, n) over the type's observed years, for every pair."""
    counts = facts.groupBy(F.col(entity).alias("entity"), "paper_type", "year").agg(F.count("*").alias("n"))
    of = F.filter(F.collect_list(F.struct("year", "n")), lambda x: x["year"].isNotNull())  # an entity without a year stays
    seen = counts.groupBy("entity", "paper_type").agg(F.map_from_entries(of).alias("seen"))
    d = per_type(seen, paper_types(year_dimension(facts, recent_span=recent_span)), ["seen"])
    n = lambda y: F.coalesce(F.try_element_at(F.col("v")["seen"], y), F.lit(0))
    series = F.transform("years", lambda y: F.struct(y.alias("year"), (n(y) > 0).alias("present"), n(y).alias("n")))
    return d.select("entity", "paper_type", series.alias("series"))


def presence_grid(facts: DataFrame, entity: str) -> DataFrame:
    """The series in long form: entity, paper_type, year, present, n."""
    return presence(facts, entity).select("entity", "paper_type", F.explode("series").alias("s")).select("entity", "paper_type", "s.year", "s.present", "s.n")


def flag_features() -> list[Column]:
    """present_run and absent_run (at the end), transitions, has_return and latest_present, by the column flags."""
    tail = lambda p: F.length(F.regexp_extract("flags", p, 0))
    return [
        tail("1*$").alias("present_run"), tail("0*$").alias("absent_run"),
        (F.regexp_count("flags", F.lit("01")) + F.regexp_count("flags", F.lit("10"))).alias("transitions"),
        F.col("flags").rlike("1[01]*001{2,}$").alias("has_return"), F.col("flags").endswith("1").alias("latest_present"),
    ]


def series_features(series: DataFrame) -> DataFrame:
    """flags (1 for each year present, else 0) and their features, of each series."""
    flags = F.array_join(F.transform("series", lambda s: F.when(s["present"], "1").otherwise("0")), "")
    return series.withColumn("flags", flags).select("entity", "paper_type", "flags", *flag_features())


def equal_weight(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, share: the share of each value within a paper, averaged over the papers that have a value at all."""
    counts = facts.where(F.col(value).isNotNull()).groupBy(*keys, "paper", value).agg(F.count("*").alias("n"))
    per_paper = counts.groupBy(*keys, "paper").agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col(value).alias("v"), "n")).alias("vs"))
    # a paper's values are few, and collected with its total; the number of papers comes from the same pass
    shares = per_paper.select(*keys, F.explode("vs").alias("x"), "total").select(*keys, F.col("x.v").alias(value), (F.col("x.n") / F.col("total")).alias("share"))
    papers = per_paper.groupBy(*keys).agg(F.count("*").alias("papers"))
    return shares.groupBy(*keys, value).agg(F.sum("share").alias("share")).join(papers, keys).select(*keys, value, rounded(F.col("share") / F.col("papers")).alias("share"))


def known_forms(facts: DataFrame, unknown: str) -> DataFrame:
    return facts.where((F.col("form") != unknown) & F.col("form").isNotNull())


def form_distribution(facts: DataFrame, entity: str, *, unknown: str = UNKNOWN_FORM) -> DataFrame:
    """entity, paper_type, period, form, share, over facts with a period."""
    return equal_weight(known_forms(facts.withColumn("entity", F.col(entity)), unknown), ["entity", "paper_type", "period"], "form")


def long_ratio(distribution: DataFrame, long_forms: tuple[str, ...] = LONG_FORMS) -> DataFrame:
    """The share of long forms, over already rounded shares."""
    share = F.sum(F.when(F.col("form").isin(*long_forms), F.col("share")).otherwise(F.lit(0.0)))
    return distribution.groupBy("entity", "paper_type", "period").agg(rounded(share).alias("long_ratio"))


#: Years that a word of a year bit set holds.
WORD = 62


def year_bits(dims: DataFrame, words: int) -> list[Column]:
    """For an item, the bit of its year among its type's years, as words of a bit set; merged by bit_or."""
    at = F.array_position(of_type(dims, "years"), F.col("year")).cast("int") - 1
    return [F.when((at >= WORD * w) & (at < WORD * (w + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), at - WORD * w)).otherwise(F.lit(0).cast("long")) for w in range(words)]


def entity_sums(own: DataFrame, dims: DataFrame, kinds: dict[str, str], long_forms: tuple[str, ...], unknown: str, words: int) -> DataFrame:
    """Facts with period, summed by one grouping-sets aggregate for each kind of entity (name and column) in two ways: per entity, paper type, period and
    paper (score_row 0), and per entity, paper type, period and score. n, known forms, each long form (f0 on), score total, year bits (b0 on)."""
    known = (F.col("form") != unknown) & F.col("form").isNotNull()
    mine = [F.count_if(F.col("form") == f).alias(f"f{k}") for k, f in enumerate(long_forms)]
    names = {k: f"__{k}" for k in kinds}
    kind_of = {dict(own.dtypes)[c] for c in kinds.values()}
    one = kind_of.pop() if len(kind_of) == 1 else "string"
    bits = [c.alias(f"b{w}") for w, c in enumerate(year_bits(dims, words))]
    d = own.select(*[F.col(c).cast(one).alias(names[k]) for k, c in kinds.items()], "paper_type", "period", "paper", F.col("score").cast("double").alias("score"), "form", *bits)
    sets = [[n, "paper_type", "period", x] for n in names.values() for x in ("paper", "score")]
    level = F.grouping("paper").alias("score_row")
    sums = d.groupingSets(sets, *names.values(), "paper_type", "period", "paper", "score").agg(
        F.count("*").alias("n"), F.count_if(known).alias("known"), *mine, F.sum("score").alias("total"), *[F.bit_or(f"b{w}").alias(f"b{w}") for w in range(words)],
        level, *[F.grouping(n).alias(f"without{n}") for n in names.values()],
    )
    kind, entity = F.lit(None).cast("string"), F.lit(None).cast(one)
    for k, n in names.items():
        kind, entity = F.when(F.col(f"without{n}") == 0, k).otherwise(kind), F.when(F.col(f"without{n}") == 0, F.col(n)).otherwise(entity)
    return sums.select(kind.alias("kind"), entity.alias("entity"), "paper_type", "period", "score_row", "score", "n", "known", *[f"f{k}" for k in range(len(long_forms))], "total", *[f"b{w}" for w in range(words)])


def kind_metrics(facts: DataFrame, kinds: dict[str, str], *, recent_span: int = 5, long_forms: tuple[str, ...] = LONG_FORMS, unknown: str = UNKNOWN_FORM, keep=None) -> DataFrame:
    """kind, entity, paper_type and both periods' metrics side by side (prefix h_ and r_), for every pair of an entity and a type, and flags."""
    dims = dimension_of(facts, recent_span, keep)
    types = paper_types(dims)
    words = max(1, -(-(dims.agg(F.max(F.size("years"))).first()[0] or 1) // WORD))
    rows = entity_sums(with_period(facts, dims=dims), dims, kinds, long_forms, unknown, words)
    paper, score = F.col("score_row") == 0, (F.col("score_row") == 1) & F.col("score").isNotNull()
    sums, names = [], []
    for p, name in (("h", "historical"), ("r", "recent")):
        here = F.coalesce(F.col("period") == name, F.lit(False))
        count = lambda c, of: F.coalesce(F.sum(F.when(here & of, F.col(c))), F.lit(0))  # noqa: B023, E731
        share = lambda k: rounded(F.avg(F.when(here & paper & (F.col("known") > 0), F.col(f"f{k}") / F.col("known"))))  # noqa: B023, E731
        some = F.count_if(here & paper & (F.col("known") > 0)) > 0
        sums += [
            count("n", paper).alias(f"{p}_items"), count("known", paper).alias(f"{p}_forms"), count("n", score).alias(f"{p}_scores"), rounded(F.sum(F.when(here & paper, F.col("total")))).alias(f"{p}_total"),
            rounded(F.percentile(F.when(here & score, F.col("score")), F.lit(0.5), F.col("n"))).alias(f"{p}_median"), F.when(some, rounded(sum((share(k) for k in range(len(long_forms))), F.lit(0.0)))).alias(f"{p}_long"),
        ]
        names += [f"{p}_{c}" for c in ("items", "forms", "scores", "total", "median", "long")]
    keys, bits = ("kind", "entity"), [f"b{w}" for w in range(words)]
    d = per_type(rows.groupBy(*keys, "paper_type").agg(*sums, *[F.bit_or(b).alias(b) for b in bits]), types, [*names, *bits], keys)
    # the year bit set as flags: bit k tells the type's k-th year
    bit = lambda k: F.coalesce(F.get(F.array(*[F.col("v")[b] for b in bits]), F.floor(k / WORD).cast("int")), F.lit(0).cast("long"))
    present = F.transform("years", lambda y, k: F.call_function("shiftright", bit(k), k % WORD).bitwiseAND(F.lit(1).cast("long")) == 1)
    d = d.withColumn("seen", F.filter(F.transform(present, lambda x, k: F.when(x, F.get("years", k))), lambda y: y.isNotNull()))
    flags = F.array_join(F.transform(present, lambda x: F.when(x, "1").otherwise("0")), "")
    hits = {"h": F.size(F.filter("seen", lambda y: y < F.col("recent_start"))), "r": F.size(F.filter("seen", lambda y: y >= F.col("recent_start")))}
    zero = {"items": 0, "forms": 0, "scores": 0, "total": 0.0}
    out = d.select(
        *keys, "paper_type", "h_years", "r_years", "h_papers", "r_papers", F.array_min("seen").alias("first_seen"), F.array_max("seen").alias("last_seen"), flags.alias("flags"),
        *[hits[p].cast("long").alias(f"{p}_hits") for p in "hr"], *[F.coalesce(F.col("v")[n], F.lit(zero[n[2:]])).alias(n) if n[2:] in zero else F.col("v")[n].alias(n) for n in names],
    )
    for p in "hr":
        out = out.withColumn(f"{p}_rate", rate(F.col(f"{p}_hits"), F.col(f"{p}_years")))
        out = out.withColumn(f"{p}_per_paper", rate(F.col(f"{p}_items"), F.col(f"{p}_papers"))).withColumn(f"{p}_score_per_paper", rate(F.col(f"{p}_total"), F.col(f"{p}_papers")))
    return out.withColumn("delta", rounded(F.coalesce("r_rate", F.lit(0.0)) - F.coalesce("h_rate", F.lit(0.0))))


def period_metrics(facts: DataFrame, entity: str, **how) -> DataFrame:
    """kind_metrics of one kind of entity."""
    return kind_metrics(facts, {entity: entity}, **how).drop("kind")


def primary_trend() -> Column:
    """The first rule that holds; see TREND_PRIORITY for the names."""
    h, r = F.coalesce("h_rate", F.lit(0.0)), F.coalesce("r_rate", F.lit(0.0))
    latest = F.col("latest_present")
    return (
        F.when((F.col("h_years") < 3) | (F.col("r_years") < 3), "THIN")
        .when((h == 0) & (F.col("r_hits") >= 2) & latest, "FIRST")
        .when(F.col("has_return"), "RETURN")
        .when((r >= 0.5) & (r - h >= 0.3) & latest, "WARM")
        .when((h >= 0.5) & (r <= 0.25) & (F.col("absent_run") >= 2), "COOL")
        .when((h >= 0.6) & (r >= 0.75) & latest, "CORE")
        .when(F.col("transitions") >= 3, "CYCLE")
        .otherwise("FLAT")
    )


def size_shifts() -> Column:
    """UPSIZE and DOWNSIZE by forms, then by median score; both may hold at once."""
    forms = (F.col("h_forms") >= 3) & (F.col("r_forms") >= 3) & F.col("h_long").isNotNull() & F.col("r_long").isNotNull()
    scores = (F.col("h_scores") >= 3) & (F.col("r_scores") >= 3)
    by, step = F.col("r_long") - F.col("h_long"), F.col("r_median") - F.col("h_median")
    form_up = forms & (F.col("r_long") >= 0.6) & (by >= 0.35)
    form_down = forms & ~form_up & (F.col("h_long") >= 0.6) & (by <= -0.35)
    yes = lambda c: F.coalesce(c, F.lit(False))
    first = F.when(yes(form_up), F.array(F.lit("UPSIZE"))).when(yes(form_down), F.array(F.lit("DOWNSIZE"))).otherwise(F.array().cast("array<string>"))
    second = F.when(yes(scores & (step >= 4)), F.array(F.lit("UPSIZE"))).when(yes(scores & (step <= -4)), F.array(F.lit("DOWNSIZE"))).otherwise(F.array().cast("array<string>"))
    return F.array_union(first, second)


def importance_role() -> Column:
    r = F.coalesce("r_rate", F.lit(0.0))
    return (
        F.when(r == 0, "NONE")
        .when((r >= 0.75) & (F.coalesce("r_median", F.lit(0.0)) >= 8), "LEVER")
        .when(r >= 0.75, "MAIN")
        .when(r >= 0.5, "MID")
        .when(F.col("trend").isin(*GROWTH), "LOWRISK")
        .otherwise("LOWWATCH")
    )


def dominant(distribution: DataFrame, value: str) -> DataFrame:
    """The value of the highest share, ties by name, per entity, paper_type and period."""
    best = F.min_by(F.struct(value, "share"), F.struct(-F.col("share"), F.col(value)))
    return distribution.groupBy("entity", "paper_type", "period").agg(best.alias("b")).select("entity", "paper_type", "period", F.col(f"b.{value}").alias("dominant"), F.col("b.share").alias("share"))


def migrations(facts: DataFrame, entity: str, tag: str, *, recent_span: int = 5, keep=None) -> DataFrame:
    """entity, paper_type, old_tag, old_share, new_tag, new_share, new_tag_years, migrated."""
    dims = dimension_of(facts, recent_span, keep)
    own = with_period(facts.select(F.col(entity).alias("entity"), "paper_type", "year", "paper", F.col(tag).alias("of")), dims=dims).where("period IS NOT NULL")
    tagged = F.when(F.col("of").isNotNull(), F.struct("of", "year"))
    papers = own.groupBy("entity", "paper_type", "period", "paper").agg(F.count("*").alias("all"), F.count("of").alias("total"), F.collect_list(tagged).alias("tags"))
    # each item of a paper gives its tag with its share of it, and a row without a tag counts the paper
    shares = F.transform("tags", lambda t: F.struct(t["of"].alias("of"), t["year"].alias("year"), (F.lit(1.0) / F.col("total")).alias("share"), F.lit(0).cast("long").alias("all")))
    none = F.struct(F.lit(None).cast(dict(own.dtypes)["of"]).alias("of"), F.lit(None).cast("int").alias("year"), F.when(F.size("tags") > 0, 1.0).otherwise(0.0).alias("share"), F.col("all").alias("all"))
    rows = papers.select("entity", "paper_type", "period", F.explode(F.concat(shares, F.array(none))).alias("x")).select("entity", "paper_type", "period", "x.*")
    sums = []
    for p, name in (("h", "historical"), ("r", "recent")):
        here = F.col("period") == name
        sums += [F.sum(F.when(here, F.col("share"))).alias(p), F.sum(F.when(here, F.col("all"))).alias(f"{p}_all"), F.size(F.collect_set(F.when(here, F.col("year")))).alias(f"{p}_years")]
    tags = rows.groupBy("entity", "paper_type", "of").agg(*sums)
    whole = Window.partitionBy("entity", "paper_type")
    of_type = lambda c: F.max(F.when(F.col("of").isNull(), F.col(c))).over(whole)
    tags = tags.withColumn("h_papers", of_type("h")).withColumn("r_papers", of_type("r")).withColumn("h_all", of_type("h_all")).withColumn("r_all", of_type("r_all"))
    tags = tags.withColumn("h", rounded(F.col("h") / F.nullif("h_papers", F.lit(0.0)))).withColumn("r", rounded(F.col("r") / F.nullif("r_papers", F.lit(0.0))))
    real = F.col("of").isNotNull()
    first = lambda p: F.min(F.when(real & F.col(p).isNotNull(), F.struct((-F.col(p)).alias("order"), "of", "h", "r", "r_years")))
    d = tags.groupBy("entity", "paper_type").agg(first("h").alias("old"), first("r").alias("new"), F.max("h_all").alias("h"), F.max("r_all").alias("r"))
    moved = (
        (F.col("h") >= 5) & (F.col("r") >= 3) & (F.col("old.of") != F.col("new.of")) & (F.col("new.r") >= 0.4)
        & (F.col("new.r") - F.coalesce("new.h", F.lit(0.0)) >= 0.25) & (F.col("new.r_years") >= 2)
    )
    d = d.where("old IS NOT NULL OR new IS NOT NULL")
    return d.select(
        "entity", "paper_type", F.col("old.of").alias("old_tag"), F.col("old.h").alias("old_share"), F.col("new.of").alias("new_tag"), F.col("new.r").alias("new_share"),
        F.coalesce("new.r_years", F.lit(0)).cast("long").alias("new_tag_years"), F.coalesce(moved, F.lit(False)).alias("migrated"),
    )


def classified(metrics: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """Metrics with series features, trend, priority, role and secondary trends. moved: entity, paper_type that have migrated (with kind, where metrics have it)."""
    d = metrics.select("*", *flag_features())
    d = d.withColumn("trend", primary_trend()).withColumn("role", importance_role()).withColumn("secondary", size_shifts())
    if moved is not None:
        d = d.join(moved.withColumn("__moved", F.lit(True)), moved.columns, "left")
        d = d.withColumn("secondary", F.when(F.col("__moved"), F.concat("secondary", F.array(F.lit("MIGRATE")))).otherwise(F.col("secondary"))).drop("__moved")
    number = lambda c, of: F.element_at(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.lit(v))]), F.col(c))
    return d.withColumn("trend_priority", number("trend", TREND_PRIORITY)).withColumn("role_priority", number("role", ROLE_PRIORITY))


def moved_entities(facts: DataFrame, entity: str, tag: str, recent_span: int, keep=None) -> DataFrame:
    return migrations(facts, entity, tag, recent_span=recent_span, keep=keep).where("migrated").select("entity", "paper_type")


def profiles(facts: DataFrame, entity: str, *, recent_span: int = 5, long_forms: tuple[str, ...] = LONG_FORMS, unknown: str = UNKNOWN_FORM, tag: str | None = None, keep=None) -> DataFrame:
    """Metrics, series features, trend, priority, role and secondary trends of every entity and paper type. tag: the
    column whose dominant value may migrate within the entity."""
    m = period_metrics(facts, entity, recent_span=recent_span, long_forms=long_forms, unknown=unknown, keep=keep)
    return classified(m, moved_entities(facts, entity, tag, recent_span, keep) if tag else None)


def profile_entities(facts: DataFrame, *, recent_span: int = 5, long_forms: tuple[str, ...] = LONG_FORMS, unknown: str = UNKNOWN_FORM, keep=None, migrate: bool = True) -> DataFrame:
    """Profiles of themes and tags in one frame, with kind, from one pass over the facts, and one more for the themes' tags, where those may migrate."""
    m = kind_metrics(facts, {"theme": "theme", "tag": "tag"}, recent_span=recent_span, long_forms=long_forms, unknown=unknown, keep=keep)
    moved = moved_entities(facts, "theme", "tag", recent_span, keep).select(F.lit("theme").alias("kind"), F.col("entity").cast("string").alias("entity"), "paper_type") if migrate else None
    return classified(m, moved)


def representatives(facts: DataFrame, entity: str, *, recent_span: int = 5, n_hist: int = 1, n_recent: int = 2, keep=None) -> DataFrame:
    """Newest items of each entity, paper type and period: highest score, then anchor; recent ones of different tags first. Both windows end
    in a limit, so each task keeps the first rows of a key alone before any are shuffled."""
    own = with_period(facts, dims=dimension_of(facts, recent_span, keep)).where("period IS NOT NULL").withColumn("entity", F.col(entity))
    order = [F.desc("year"), F.desc("points"), F.asc("anchor"), F.asc("tie")]
    own = own.withColumn("points", F.coalesce("score", F.lit(0.0)))
    keys = ["entity", "paper_type", "period"]
    # the first n_recent rows of each tag suffice, and of any entity the first n_recent tags
    first = own.withColumn("of_tag", F.row_number().over(Window.partitionBy(*keys, "tag").orderBy(*order))).where(F.col("of_tag") <= max(n_hist, n_recent))
    again = F.when(F.col("period") == "recent", (F.col("of_tag") > 1).cast("int")).otherwise(0)
    picked = first.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(again, *order)))
    limit = F.when(F.col("period") == "recent", n_recent).otherwise(n_hist)
    return picked.where(F.col("position") <= limit).select(*keys, "position", "anchor", "tag", "year", "score", "form")
