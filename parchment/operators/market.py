"""Market ranges from web pages: source tiers, observations, normalisation, ladder, conflicts, benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.operators.requests import distinct_in_order

from parchment.functions import values as V
from parchment.functions.text import domain_of, page_sentences

MIN_MONTHLY, MAX_MONTHLY = 500.0, 500_000.0
PER_PAGE = 6
PER_QUERY = 8
CONFLICT_RATIO = 4.0
TIERS = ("official", "market", "supplementary", "lead_only")

# Known sources and how far they are trusted.
KNOWN_SOURCES = (
    ("stats.gov.sa", "GASTAT (General Authority for Statistics)", "official"),
    ("open.data.gov.sa", "Saudi Open Data", "official"),
    ("saudisalary.com", "SaudiSalary", "market"),
    ("paylab.com", "Paylab Saudi Arabia", "market"),
    ("kaggle.com", "Kaggle dataset", "supplementary"),
    ("linkedin.com", "LinkedIn", "lead_only"),
    ("lnkd.in", "LinkedIn", "lead_only"),
)

#: A comma or blank between the figures of one number; how a figure looks without those; what stands between the ends of a range.
GROUPING = r"(?=[,٬ ])(?<=\d)(?<!\d{4})[,٬ ](?=\d{3}(?!\d))"
FIGURE = r"\d+(?:\.\d+)*"
# What may stand between the ends of a range.
RANGE_WORDS = ("-", "–", "—", "to", "until", "إلى", "حتى")


def known_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_SOURCES), "domain string, name string, tier string")


def build_query(title: Column, location: Column, years: Column, seniority: Column, year: Column) -> Column:
    experience = F.coalesce(F.concat(years.cast("string"), F.lit(" years experience")), seniority)
    return F.concat_ws(" ", title, F.lit("salary"), location, F.lit("Saudi Arabia"), experience, year.cast("string"))


def host_suffixes(host: Column) -> Column:
    """The host and what is left after each of its dots, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tier_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages with the tier and name of the source whose domain ends their host, the longest one; else supplementary.

    An equi-join on suffixes: the list of sources may be of any size."""
    host = pages.withColumn("host", domain_of(F.col("url")))
    found = (
        host.select("url", F.posexplode(host_suffixes(F.col("host"))).alias("cut", "domain")).distinct()
        .join(sources, "domain").groupBy("url").agg(F.min_by(F.struct("tier", "name"), "cut").alias("s"))
    )
    return host.join(found, "url", "left").select(
        *host.columns,
        F.coalesce("s.tier", F.lit("supplementary")).alias("tier"),
        F.coalesce("s.name", F.nullif("host", F.lit("")), F.lit("unknown source")).alias("source_name"),
    )


def select_urls(found: DataFrame, allowed: DataFrame | None = None, limit: int = PER_QUERY) -> DataFrame:
    """found(query_id, position, url): each address once at its first place, allowed domains alone, ``limit`` a query."""
    rows = found
    if allowed is not None:
        ends = rows.select("query_id", "position", "url", F.explode(host_suffixes(domain_of(F.col("url")))).alias("domain"))
        rows = ends.join(allowed.select("domain"), "domain", "left_semi").select("query_id", "position", "url").distinct()
    first = rows.groupBy("query_id", "url").agg(F.min("position").alias("position"))
    order = Window.partitionBy("query_id").orderBy("position", "url")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def plain_figures(sentence: Column) -> Column:
    """The sentence with its numbers in one piece and without the names of currencies."""
    names = sorted({t for ts in V.CURRENCY_TOKENS.values() for t in ts}, key=len, reverse=True)
    signs = "".join(f"|\\Q{t}\\E" for t in names if not t[0].isalpha())
    written = V.words_pattern([t for t in names if t[0].isalpha()], r"(?<!\p{L})", r"(?!\p{L})") + signs
    return F.regexp_replace(F.regexp_replace(sentence, GROUPING, ""), f"(?i){written}", " ")


def amounts(sentence: Column) -> Column:
    """Array of (low, high): ranges that rise, then the numbers outside them."""
    between = "|".join(RANGE_WORDS)
    pair = F.lit(rf"(?i)({FIGURE})\s*(?:{between})\s*({FIGURE})")

    def both(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    def ranges_in(text: Column) -> Column:
        ends = F.arrays_zip(*[F.regexp_extract_all(text, pair, F.lit(i)).alias(name) for i, name in enumerate(("raw", "low", "high"))])
        read = F.transform(ends, lambda r: F.struct(V.read_number(r["low"]).alias("low"), V.read_number(r["high"]).alias("high"), r["raw"].alias("raw")))
        return F.filter(read, lambda r: r["high"] >= r["low"])

    def found(text: Column, ranges: Column) -> Column:
        rest = F.aggregate(ranges, text, lambda t, r: F.replace(t, r["raw"], F.lit(" # ")))
        single = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(FIGURE), F.lit(0)), V.read_number), lambda v: v.isNotNull())
        return F.concat(F.transform(ranges, lambda r: both(r["low"], r["high"])), F.transform(single, lambda v: both(v, v)))

    return V.let(plain_figures(sentence), lambda text: V.let(ranges_in(text), lambda ranges: found(text, ranges)))


def observations(pages: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """pages(page_id, url, tier, title, snippet, text) -> figures with currency, period and basis: from the sentence, else
    from the page's head; a figure once per page, the first ``per_page``."""

    def read(low: Column) -> Column:
        return F.struct(
            V.has_word(low, V.SALARY_WORDS).alias("salary"), V.currency_of(low).alias("currency"), V.period_of(low).alias("period"), V.basis_of(low).alias("basis")
        )

    # a page's head and each of its sentences are read once, inside the generators: a filter moves below a projection and takes a copy of
    # its patterns along, but not below a generator
    head = F.lower(F.concat_ws(" ", "title", "snippet", F.substring("text", 1, 400)))
    of_page = V.let(head, lambda low: F.struct(V.period_of(low).alias("period"), V.basis_of(low).alias("basis")))
    titled = F.when(F.col("tier") == "official", V.find_currency(F.col("title")))
    told = F.transform(page_sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), V.let(F.lower(s), read).alias("own")))
    s = pages.select("page_id", "url", "tier", titled.alias("titled"), of_page.alias("page"), F.posexplode(told).alias("no", "told"))
    own = F.col("told.own")
    some = s.where((own["salary"] | own["currency"].isNotNull()) & F.coalesce(own["currency"], "titled").isNotNull())
    each = some.select(
        "page_id", "url", "tier", "no", F.col("told.sentence").alias("sentence"),
        F.coalesce(own["currency"], "titled").alias("currency"),
        F.coalesce(own["period"], "page.period").alias("period"),
        F.coalesce(own["basis"], "page.basis", F.lit("unspecified")).alias("basis"),
        F.posexplode(amounts(F.col("told.sentence"))).alias("k", "amount"),
    )
    flat = each.select("*", F.col("amount.low").alias("minimum"), F.col("amount.high").alias("maximum")).drop("amount")
    same = Window.partitionBy("page_id", "minimum", "maximum", "currency").orderBy("no", "k")
    once = flat.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    order = Window.partitionBy("page_id").orderBy("no", "k")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_page)


def cents(amount: Column) -> Column:
    """Rounded to two places in binary arithmetic, the same on every engine."""
    return F.floor(amount * 100 + 0.5) / 100


def normalise(obs: DataFrame, fx: DataFrame) -> DataFrame:
    """Monthly amounts in one currency.  obs(..., tier, currency, period, minimum, maximum), fx(currency, rate).

    Without a rate a figure is unusable (dropped where its period is missing too); without a period unusable; outside
    the plausible band dropped; leads are unusable."""
    joined = obs.join(fx, "currency", "left")
    rate = F.when(F.col("currency") == "SAR", 1.0).otherwise(F.col("rate"))
    share = F.when(F.col("period") == "annual", F.lit(12.0)).otherwise(1.0)
    low, high = F.col("minimum") * rate / share, F.col("maximum") * rate / share
    readable = rate.isNotNull() & F.col("period").isNotNull()
    band = low.between(MIN_MONTHLY, MAX_MONTHLY) & high.between(MIN_MONTHLY, MAX_MONTHLY)
    kept = joined.where((rate.isNotNull() | F.col("period").isNotNull()) & (~readable | band))
    return kept.select(
        *obs.columns,
        cents(F.when(readable, low).otherwise(F.col("minimum"))).alias("monthly_min"),
        cents(F.when(readable, high).otherwise(F.col("maximum"))).alias("monthly_max"),
        F.when(readable & (F.col("currency") != "SAR"), F.col("currency")).alias("converted_from"),
        (readable & (F.col("tier") != "lead_only")).alias("usable"),
    )


def mentions_title(text: Column, title: Column) -> Column:
    """Whether all words of the title with more than two letters are in the text."""
    ws = F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 2)
    return (F.size(ws) > 0) & F.forall(ws, lambda w: F.contains(F.lower(text), w))


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier).cast("int")


def choose_basis(obs: DataFrame) -> DataFrame:
    """(query_id, basis): of usable figures that of the best tier, then of most addresses, then first seen."""
    by = obs.where("usable").groupBy("query_id", "basis").agg(
        F.min(tier_rank(F.col("tier"))).alias("tier"), F.countDistinct("url").alias("urls"), F.min("position").alias("first")
    )
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("urls"), "first")
    return by.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "basis")


def tier_ladder(obs: DataFrame) -> DataFrame:
    """Usable figures of the tiers, best first, up to the one at which they are a range: a published range, or two
    different rounded figures."""
    by = obs.where("usable").withColumn("rank", tier_rank(F.col("tier")))
    tiers = by.groupBy("query_id", "rank").agg(
        F.max((F.col("monthly_max") > F.col("monthly_min")).cast("int")).alias("wide"),
        F.min(F.bround("monthly_min")).alias("lo"),
        F.max(F.bround("monthly_min")).alias("hi"),
    )
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranges = tiers.withColumn(
        "is_range", ((F.max("wide").over(w) == 1) | (F.max("hi").over(w) > F.min("lo").over(w))).cast("int")
    )
    used = ranges.withColumn("done", F.coalesce(F.max("is_range").over(before), F.lit(0))).where("done = 0")
    return by.join(used.select("query_id", "rank", "is_range"), ["query_id", "rank"])


def conflicts(obs: DataFrame) -> DataFrame:
    """(query_id, low, high, conflict): figures that span over CONFLICT_RATIO with two pages whose spans are apart.
    Two spans are apart just if the largest low is above the smallest high."""
    pages = obs.groupBy("query_id", "url").agg(F.min("monthly_min").alias("lo"), F.max("monthly_max").alias("hi"))
    return pages.groupBy("query_id").agg(
        F.min("lo").alias("low"),
        F.max("hi").alias("high"),
        ((F.min("lo") > 0) & (F.max("hi") / F.min("lo") > CONFLICT_RATIO) & (F.max("lo") > F.min("hi"))).alias("conflict"),
    )


def benchmark(obs: DataFrame) -> DataFrame:
    """One row a query: span, quality (tier, mixed, insufficient or conflicting), status, number of sources."""
    chosen = tier_ladder(obs.join(choose_basis(obs), ["query_id", "basis"], "left_semi"))
    spans = conflicts(chosen)
    facts = chosen.groupBy("query_id").agg(
        F.max("is_range").alias("is_range"),
        F.countDistinct("tier").alias("tiers"),
        F.min_by("tier", "rank").alias("tier"),
        F.countDistinct("url").alias("sources"),
        F.first("basis").alias("basis"),
    )
    ok = (F.col("is_range") == 1) & ~F.col("conflict")
    quality = (
        F.when(F.col("is_range") != 1, "insufficient").when(F.col("conflict"), "conflicting")
        .when(F.col("tiers") == 1, F.col("tier")).otherwise("mixed")
    )
    rows = facts.join(spans, "query_id").select(
        "query_id", "basis",
        F.when(ok, "success").otherwise("insufficient_data").alias("status"),
        quality.alias("quality"),
        F.when(ok, F.round("low", 2)).alias("market_min"),
        F.when(ok, F.round("high", 2)).alias("market_max"),
        "sources",
    )
    return rows


def benchmark_report(obs: DataFrame) -> DataFrame:
    """``benchmark`` for every query that has figures at all, with the sources the range rests on, in order of first appearance, and
    the limits of it: (query_id, basis, status, quality, market_min, market_max, source_list, limits).

    A query without a usable figure is insufficient and has no sources."""
    chosen = tier_ladder(obs.join(choose_basis(obs), ["query_id", "basis"], "left_semi"))
    listed = distinct_in_order(chosen, "query_id", "url", "position").withColumnRenamed("items", "source_list")
    levels = distinct_in_order(chosen, "query_id", "tier", "rank").withColumnRenamed("items", "levels")
    facts = chosen.groupBy("query_id").agg(F.bool_or(F.col("converted_from").isNotNull()).alias("converted"), F.bool_or(F.col("period") == "annual").alias("annual"))
    rows = limitations(obs).join(benchmark(obs), "query_id", "left")
    for part in (listed, levels, facts):
        rows = rows.join(part, "query_id", "left")
    good, none = F.col("status") == "success", F.col("status").isNull()
    span = F.concat(F.lit("span of "), F.size("source_list").cast("string"), F.lit(" at level "), F.array_join("levels", " and "))
    limits = F.array(
        F.when(F.col("unconverted") != "", F.concat(F.lit("no rate for "), "unconverted")), F.when(F.col("lead_only"), "leads set no range"), F.when(F.col("no_period"), "period not stated"),
        F.when(none, "no usable figure"), F.when(F.col("quality") == "insufficient", "a single figure"), F.when(F.col("quality") == "conflicting", "sources conflict"),
        F.when(good, span), F.when(good & F.col("converted"), "converted at the given rate"), F.when(good & F.col("annual"), "annual figures divided by 12"),
    )
    return rows.select(
        "query_id", "basis", F.coalesce("status", F.lit("insufficient_data")).alias("status"), F.coalesce("quality", F.lit("insufficient")).alias("quality"),
        "market_min", "market_max", F.coalesce("source_list", F.array().cast(listed.schema["source_list"].dataType)).alias("source_list"), F.array_compact(limits).alias("limits"),
    )


def position(amount: Column, period: Column, low: Column, high: Column) -> Column:
    """below, inside or above the range; annual pay is brought to a month first."""
    monthly = F.when(period == "annual", amount / 12).when(F.coalesce(period, F.lit("monthly")) == "monthly", amount)
    return F.when(monthly < low, "below").when(monthly > high, "above").when(monthly.isNotNull(), "inside")


def limitations(obs: DataFrame) -> DataFrame:
    """(query_id, unconverted, lead_only, no_period) of what was left out and why."""
    lost = ~F.col("usable") & (F.col("currency") != "SAR") & F.col("converted_from").isNull() & F.col("period").isNotNull()
    return obs.groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(lost, F.col("currency")))), ",").alias("unconverted"),
        F.bool_or(F.col("tier") == "lead_only").alias("lead_only"),
        F.bool_or(F.col("period").isNull()).alias("no_period"),
    )
