"""Matching CVs to requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import cv_tokens

ITEM_SPLIT = r"\s*[,،;|•]\s*|\s+-\s+"


def cv_sections(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """lines(document_id, line_no, text, is_heading) x titles(title_key, section): a known title of at most 60 letters opens a section,
    an unknown heading closes it."""
    from parchment.functions.text import matching_key

    keyed = lines.withColumn("k", F.when(F.length("text") <= 60, matching_key(F.col("text"))))
    named = keyed.join(titles, F.col("k") == F.col("title_key"), "left")
    mark = F.when(F.col("section").isNotNull(), F.col("section")).when(F.col("is_heading"), F.lit("_other"))
    w = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = named.withColumn("in_section", F.last(mark, ignorenulls=True).over(w)).withColumn("opens", mark.isNotNull())
    return filled.where("NOT opens AND in_section IS NOT NULL AND in_section <> '_other'").select("document_id", "line_no", F.col("in_section").alias("section"), "text")


def _known_titles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """lines with ``section``: of known titles of at most 60 letters, a colon at the end aside."""
    from parchment.functions.text import matching_key

    bare = F.trim(F.regexp_replace(F.trim("text"), "[:：]+$", ""))
    keyed = lines.withColumn("_k", F.when(F.length(bare) <= 60, matching_key(bare)))
    known = titles.select(F.col("title_key").alias("_k"), "section").dropDuplicates(["_k"])
    return keyed.join(known, "_k", "left").drop("_k")


def cv_sections_by_level(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """lines(document_id, line_no, text, is_heading, level: null if unknown) x titles(title_key, section) -> (document_id, line_no,
    section, text): lines under a known title, up to the next one or to an unknown heading of the same or a higher rank; an unknown
    heading below the title, or of unknown rank, is a line like others.  The section ``_other`` has no lines."""
    named = _known_titles(lines, titles).withColumn("opens", F.col("section").isNotNull())
    w = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = F.struct("section", "level")
    parts = named.withColumn("part", F.sum(F.col("opens").cast("int")).over(w)).withColumn("head", F.last(F.when(F.col("opens"), part), ignorenulls=True).over(w))
    closes = ~F.col("opens") & F.col("is_heading") & F.coalesce(F.col("level") <= F.col("head.level"), F.lit(False))
    inside = Window.partitionBy("document_id", "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = parts.withColumn("closed", F.max(closes.cast("int")).over(inside)).where("part > 0 AND NOT opens AND closed = 0")
    return kept.where(F.col("head.section") != "_other").select("document_id", "line_no", F.col("head.section").alias("section"), "text")


def cv_titles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(document_id, line_no, title, is_name): the first unknown heading before any known section; it is a name if it has two to five
    words, at most 60 letters and no digit or sign of an address."""
    named = _known_titles(lines, titles)
    own = F.col("section").isNotNull() & (F.col("section") != "_other")
    facts = named.groupBy("document_id").agg(
        F.min(F.when(own, F.col("line_no"))).alias("first"), F.min(F.when(F.col("section").isNull() & F.col("is_heading"), F.struct("line_no", "text"))).alias("t")
    )
    title = F.trim("t.text")
    name = F.size(F.split(title, r"\s+")).between(2, 5) & (F.length(title) <= 60) & ~title.rlike("[0-9@:/]")
    return facts.where(F.col("t").isNotNull() & (F.col("first").isNull() | (F.col("t.line_no") < F.col("first")))).select(
        "document_id", F.col("t.line_no").alias("line_no"), title.alias("title"), name.alias("is_name")
    )


def heading_parents(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """headings(document_id, line_no, level from 1) with ``parent``: line number of the nearest earlier heading of a smaller level, null
    at the top; levels beyond ``deepest`` count as that."""
    w = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least("level", F.lit(deepest))
    above = [F.last(F.when(level < k, F.col("line_no")), ignorenulls=True).over(w) for k in range(1, deepest + 1)]
    return headings.withColumn("_above", F.array(*above)).withColumn("parent", F.get("_above", level - 1)).drop("_above")


def cv_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items of lists written in one line."""
    items = df.select(id_col, F.posexplode(F.split(text_col, ITEM_SPLIT)).alias("item_no", "item"))
    return items.select(id_col, "item_no", F.trim("item").alias("item")).where("item <> ''")


def requirement_plan(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, title, required_skills, preferred_skills, ...) -> (job_id, requirement_type, requirement, required)."""
    def part(col: str, kind: str, required: bool):
        return F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("requirement_type"), v.alias("requirement"), F.lit(required).alias("required")))

    title = F.array(F.struct(F.lit("title").alias("requirement_type"), F.col("title").alias("requirement"), F.lit(False).alias("required")))
    return jobs.select("job_id", F.inline(F.concat(title, part("required_skills", "skill", True), part("preferred_skills", "skill", False))))


def assess(requirements: DataFrame, texts: DataFrame, least: float = 0.0) -> DataFrame:
    """requirements(req_id, token), texts(doc_id, token), each token once -> (req_id, doc_id, have, status): explicit with all
    tokens, partial with some and at least the share ``least`` of them; other pairs are missing and have no row.

    Tokens are numbered by rarity.  Of the ``need`` tokens of a requirement ``enough`` must be met; then of the rarest
    ``need - enough + e`` at least ``e`` are, for any ``e`` up to ``enough``.  With ``e`` half of ``enough`` a text must share several
    of the rarer tokens before it makes a pair; the most frequent tokens make none and are only looked up for pairs that are left."""
    common = texts.join(requirements.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    by_rarity = Window.partitionBy("req_id").orderBy(F.coalesce("n", F.lit(0)), "token")
    size = F.count("*").over(Window.partitionBy("req_id"))
    ranked = requirements.join(common, "token", "left").withColumn("rank", F.row_number().over(by_rarity)).withColumn("need", size)
    ranked = ranked.withColumn("enough", F.greatest(F.lit(1), F.ceil(F.col("need") * F.lit(least) - 1e-9)))
    ranked = ranked.withColumn("e", F.ceil(F.col("enough") / 2)).withColumn("leads", F.col("rank") <= F.col("need") - F.col("enough") + F.col("e"))
    leading = ranked.where("leads").join(texts, "token").groupBy("req_id", "doc_id").agg(
        F.count("*").alias("first"), *[F.any_value(c).alias(c) for c in ("need", "enough", "e")]
    )
    pairs = leading.where(F.col("first") >= F.col("e")).drop("e")
    rest = pairs.select("req_id", "doc_id").join(ranked.where(~F.col("leads")).select("req_id", "token"), "req_id").join(texts, ["doc_id", "token"])
    rest = rest.groupBy("req_id", "doc_id").agg(F.count("*").alias("more"))
    have = pairs.join(rest, ["req_id", "doc_id"], "left").withColumn("have", F.col("first") + F.coalesce("more", F.lit(0)))
    return have.where(F.col("have") >= F.col("enough")).select(
        "req_id", "doc_id", "have", F.when(F.col("have") == F.col("need"), "explicit").otherwise("partial").alias("status")
    )


#: Kinds of requirements: column of jobs, importance, field of a CV that should state it, other fields that may.
KINDS = (
    ("job_title", "title", "required", "work_experience", ("summary",)),
    ("skill", "required_skills", "required", "skills", ("work_experience", "summary", "certifications", "education")),
    ("skill", "preferred_skills", "preferred", "skills", ("work_experience", "summary", "certifications", "education")),
    ("education", "required_education", "required", "education", ("certifications",)),
    ("certification", "required_certifications", "required", "certifications", ("education", "skills", "summary")),
    ("language", "required_languages", "required", "languages", ()),
)
YEARS = "experience_years"


def job_plan(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, title, required_skills, preferred_skills, required_education, required_certifications, required_languages,
    minimum_years_experience) -> (job_id, no, requirement_type, requirement, importance, primary, searched), in the order of the
    job; years of experience are a requirement of their own.  Null lists are empty; a null title is none."""

    def part(kind: str, column: str, importance: str, primary: str, others: tuple[str, ...]) -> Column:
        values = F.array_compact(F.array("title")) if column == "title" else F.coalesce(F.col(column), F.array().cast("array<string>"))
        searched = F.array(*map(F.lit, (primary, *others)))
        return F.transform(
            values,
            lambda v: F.struct(
                F.lit(kind).alias("requirement_type"), v.alias("requirement"), F.lit(importance).alias("importance"), F.lit(primary).alias("primary"), searched.alias("searched")
            ),
        )

    years = F.concat(F.regexp_replace(F.col("minimum_years_experience").cast("string"), r"\.0$", ""), F.lit(" years"))
    field = F.lit("work_experience")
    experience = F.array_compact(
        F.array(
            F.when(
                years.isNotNull(),
                F.struct(F.lit(YEARS).alias("requirement_type"), years.alias("requirement"), F.lit("required").alias("importance"), field.alias("primary"), F.array(field).alias("searched")),
            )
        )
    )
    rows = jobs.select("job_id", F.posexplode(F.concat(*[part(*k) for k in KINDS], experience)).alias("no", "r"))
    return rows.select("job_id", "no", "r.*")


#: Requirements of a job whose states go into one number, bits of each, and what a bit says: a text of the primary field has all
#: words, one of another searched field has, one of the primary field has a part, a searched text shares a script, the primary field was found.
BLOCK, BITS = 12, 5
_WHOLE, _ELSEWHERE, _PART, _SCRIPT, _THERE = (1 << i for i in range(BITS))


def _either(masks: Column) -> Column:
    return F.aggregate(masks, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _where(which) -> Column:
    """A number with the first bit of each requirement for which ``which(requirement, place)`` holds."""
    return _either(F.transform("asked", lambda r, i: F.when(which(r, i), F.call_function("shiftleft", F.lit(1).cast("long"), i * BITS)).otherwise(0)))


def _blocks(asked: DataFrame) -> DataFrame:
    """(job_id, block, asked, fields, words): the requirements of a job in order, ``BLOCK`` at a time; which of them search a field,
    name it first, search it with either script, and want a word."""
    r = F.struct("no", "requirement_type", "requirement", "importance", "primary", "searched", "wanted", "ar", "la")
    jobs = asked.where("job_id IS NOT NULL").groupBy("job_id").agg(F.sort_array(F.collect_list(r)).alias("all"))
    starts = F.sequence(F.lit(1), F.size("all"), F.lit(BLOCK))
    blocks = jobs.select("job_id", F.posexplode(F.transform(starts, lambda k: F.slice("all", k, BLOCK))).alias("block", "asked"))

    def searching(f: Column) -> Column:
        def searches(r):
            return F.array_contains(r["searched"], f)

        return F.struct(
            _where(lambda r, i: searches(r)).alias("any"), _where(lambda r, i: r["primary"] == f).alias("first"),
            _where(lambda r, i: searches(r) & r["ar"]).alias("ar"), _where(lambda r, i: searches(r) & r["la"]).alias("la"),
        )

    fields = F.array_distinct(F.flatten(F.transform("asked", lambda r: F.concat(r["searched"], F.array(r["primary"])))))
    words = F.array_distinct(F.flatten(F.transform("asked", lambda r: r["wanted"])))
    return blocks.select(
        "*", F.map_from_arrays(fields, F.transform(fields, searching)).alias("fields"),
        F.map_from_arrays(words, F.transform(words, lambda w: _where(lambda r, i: F.array_contains(r["wanted"], w)))).alias("words"),
    )


def _with_states(pairs: DataFrame) -> DataFrame:
    """What a text, or a field that was found, says of the requirements, in one number."""
    none = F.lit(0).cast("long")
    pairs = pairs.withColumn("f", F.try_element_at("fields", F.col("cv_field")))
    met = _either(F.transform("held", lambda w: F.coalesce(F.try_element_at("words", w), none))).bitwiseAND(F.col("f.any"))
    pairs = pairs.withColumn("met", F.when(~F.col("found"), met).otherwise(0))

    def whole(r: Column, i: Column) -> Column:
        asked = F.call_function("shiftright", F.col("met"), i * BITS).bitwiseAND(F.lit(1)) != 0
        return asked & (F.size(F.filter("held", lambda w: F.array_contains(r["wanted"], w))) == F.size(r["wanted"]))

    pairs = pairs.withColumn("whole", F.when(F.col("met") != 0, _where(whole)).otherwise(0))
    first = F.col("f.first")
    script = F.when(F.col("ar"), F.col("f.ar")).otherwise(0).bitwiseOR(F.when(F.col("la"), F.col("f.la")).otherwise(0))
    elsewhere = F.col("whole").bitwiseAND(F.bitwise_not(first))
    line = F.col("whole").bitwiseAND(first) * _WHOLE + elsewhere * _ELSEWHERE + F.col("met").bitwiseAND(first) * _PART + script * _SCRIPT
    return pairs.withColumn("states", F.coalesce(F.when(F.col("found"), first * _THERE).otherwise(line), none))


def assess_jobs(
    plan: DataFrame, applications: DataFrame, texts: DataFrame, found: DataFrame, stop: tuple[str, ...] = (), languages: dict[str, str] | None = None
) -> DataFrame:
    """plan (see ``job_plan``), applications(job_id, document_id), texts(document_id, cv_field, text_no, text) and the fields that
    were found in a CV, found(document_id, cv_field) -> (job_id, document_id, no, requirement_type, requirement, importance, status,
    reason, fields, words).

    The first that holds decides: the requirement has no comparable words (insufficient); a text of the primary field has all
    of them (explicit); one of another searched field has (partial); some text of the primary field has a part (partial); the
    primary field was not found (insufficient); requirement and searched texts share no script (insufficient; languages are
    exempt); else it is missing.  Years of experience are not reckoned (insufficient).  ``languages`` are other names of languages.

    Texts, found fields and applications are dealt out by CV once; all else happens there.  A text meets the requirements of a job in
    one row and what it says of them is one number for each ``BLOCK``, so neither words nor pairs of words are shuffled."""
    names = F.create_map(*[F.lit(x) for kv in (languages or {}).items() for x in kv]).cast("map<string,string>")
    stops = F.array(*map(F.lit, stop)).cast("array<string>")

    def tokens(c: str) -> Column:
        return F.array_distinct(cv_tokens(F.coalesce(F.col(c), F.lit("")), stops))

    def named(words: Column) -> Column:
        return F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w))

    is_language = F.col("requirement_type") == "language"
    wanted = F.when(F.col("requirement_type") == YEARS, F.array().cast("array<string>")).when(is_language, F.array_distinct(named(tokens("requirement")))).otherwise(tokens("requirement"))
    blocks = _blocks(plan.select("*", wanted.alias("wanted"), *_scripts("requirement")))

    number, text = texts.schema["text_no"].dataType, F.lit(None).cast("string")
    lines = texts.select("document_id", "cv_field", F.lit(False).alias("found"), "text_no", F.col("text").cast("string").alias("text"))
    lines = lines.unionByName(found.select("document_id", "cv_field", F.lit(True).alias("found"), F.lit(None).cast(number).alias("text_no"), text.alias("text")))
    lines = lines.where("document_id IS NOT NULL AND cv_field IS NOT NULL").repartition("document_id")
    held = F.array_union(tokens("text"), named(tokens("text"))) if languages else tokens("text")
    # rows of one number are one text
    one = Window.partitionBy("document_id", "cv_field", "found", "text_no")
    lines = lines.select("*", held.alias("held"), *_scripts("text")).withColumn("held", F.flatten(F.collect_list("held").over(one)))

    key = ["job_id", "document_id", "block"]
    pairs = applications.select("job_id", "document_id").join(lines.drop("text", "text_no"), "document_id", "left").join(blocks, "job_id")
    pairs = _with_states(pairs)
    telling = F.when(F.col("states").bitwiseAND(sum((_ELSEWHERE | _PART) << BITS * i for i in range(BLOCK))) != 0, F.struct("cv_field", "held", "states"))
    said = pairs.groupBy(*key).agg(F.bit_or("states").alias("states"), F.collect_set(telling).alias("telling"))
    rows = said.join(blocks.select("job_id", "block", "asked"), ["job_id", "block"]).select("job_id", "document_id", "states", "telling", F.posexplode("asked").alias("i", "r"))

    def says(states: Column, bit: int) -> Column:
        return F.call_function("shiftrightunsigned", states, F.col("i") * BITS).bitwiseAND(F.lit(bit)) != 0

    def told(bit: int) -> Column:
        return F.filter("telling", lambda t: says(t["states"], bit))

    rows = rows.select("job_id", "document_id", "states", "telling", "i", "r.*")
    outcome = (
        F.when(F.col("requirement_type") == YEARS, _outcome("insufficient", "years not reckoned"))
        .when(F.size("wanted") == 0, _outcome("insufficient", "no comparable words"))
        .when(says(F.col("states"), _WHOLE), _outcome("explicit", "all in the primary field"))
        .when(says(F.col("states"), _ELSEWHERE), _outcome("partial", "all in another field"))
        .when(says(F.col("states"), _PART), _outcome("partial", "a part in the primary field"))
        .when(~says(F.col("states"), _THERE), _outcome("insufficient", "primary field not found"))
        .when(~is_language & ~says(F.col("states"), _SCRIPT), _outcome("insufficient", "other script"))
        .otherwise(_outcome("missing", "not stated"))
    )
    others = F.array_sort(F.array_distinct(F.transform(told(_ELSEWHERE), lambda t: t["cv_field"])))
    met = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(told(_PART), lambda t: t["held"])), lambda w: F.array_contains("wanted", w))))
    rows = rows.withColumn("o", outcome)
    where = F.when(F.col("o.reason") == "all in another field", others).when(F.col("o.status").isin("explicit", "partial"), F.array("primary"))
    part = F.when(F.col("o.reason") == "a part in the primary field", met)
    return rows.select(
        "job_id", "document_id", "no", "requirement_type", "requirement", "importance", "o.status", "o.reason", where.alias("fields"), part.alias("words")
    )


_ARABIC, _LATIN = "[\u0621-\u064a]", "[A-Za-z\u00c0-\u024f]"


def _scripts(column: str) -> tuple[Column, Column]:
    """Whether a text has Arabic and Latin letters."""
    return tuple(F.coalesce(F.col(column).rlike(p), F.lit(False)).alias(a) for p, a in ((_ARABIC, "ar"), (_LATIN, "la")))


def _outcome(status: str, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def job_overview(rows: DataFrame) -> DataFrame:
    """Rows of ``assess_jobs`` -> (job_id, document_id, overall, explicit, partial, insufficient, missing): of the required ones any missing
    is a gap, then any insufficient, then all explicit, else it is partly evidenced."""
    required = F.col("importance") == "required"

    def any_of(status: str) -> Column:
        return F.coalesce(F.bool_or(required & (F.col("status") == status)), F.lit(False))

    overall = (
        F.when(any_of("missing"), "gaps_identified").when(any_of("insufficient"), "insufficient_information")
        .when(F.coalesce(F.bool_and(F.when(required, F.col("status") == "explicit")), F.lit(True)), "required_requirements_explicitly_met").otherwise("partially_evidenced")
    )
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("explicit", "partial", "insufficient", "missing")]
    return rows.groupBy("job_id", "document_id").agg(overall.alias("overall"), *counts)


def overall_match(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, status, required): required missing, then insufficient, then all explicit, else partial."""
    def any_of(s: str):
        return F.coalesce(F.bool_or(F.col("required") & (F.col("status") == s)), F.lit(False))

    return rows.groupBy(key).agg(
        F.when(any_of("missing"), "missing_required").when(any_of("insufficient"), "insufficient")
        .when(F.bool_and(F.col("status") == "explicit"), "full").otherwise("partial").alias("match")
    )


def language_alias(df: DataFrame, aliases: DataFrame, column: str = "language") -> DataFrame:
    """Canonical names of languages; unknown ones stay, in lower case."""
    low = F.lower(F.trim(column))
    a = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
    return df.withColumn("_low", low).join(a, F.col("_low") == F.col("_alias"), "left").withColumn(
        column, F.coalesce("_name", "_low")
    ).drop("_low", "_alias", "_name")


def cv_observations(cvs: DataFrame) -> DataFrame:
    """cvs(document_id, sections, undated, untitled) -> what a reader should know of each."""
    notes = F.array_compact(
        F.array(
            F.when(~F.array_contains("sections", "experience"), "no experience section"),
            F.when(~F.array_contains("sections", "education"), "no education section"),
            F.when(F.col("undated") > 0, "undated entries"),
            F.when(F.col("untitled") > 0, "entries without a title"),
        )
    )
    return cvs.select("document_id", F.explode(notes).alias("observation"))


_LEVELS = "native|fluent|advanced|intermediate|beginner|basic"
_YEAR = r"(?<!\d)((?:19|20)\d\d)(?!\d)"
_RANGE = r"(?i)((?:19|20)\d\d)\s*(?:-|–|to)\s*((?:19|20)\d\d|present|now|current)"


def cv_languages(items: DataFrame) -> DataFrame:
    """items(document_id, item) -> language and level, where one is named."""
    level = F.lower(F.regexp_extract("item", f"(?i)\\b({_LEVELS})\\b", 1))
    name = F.trim(F.regexp_replace(F.regexp_replace("item", f"(?i)\\b({_LEVELS})\\b", ""), r"[()\-–:,]", " "))
    return items.select("document_id", name.alias("language"), F.nullif(level, F.lit("")).alias("level")).where("language <> ''")


def cv_certs(items: DataFrame) -> DataFrame:
    """items(document_id, item) -> certificate and its year: the one at the end, which is no part of the name, else the first."""
    at_end = rf"[(\s,–-]*{_YEAR}\)?\s*$"
    last = F.nullif(F.regexp_extract("item", at_end, 1), F.lit(""))
    return items.select(
        "document_id",
        F.trim(F.regexp_replace("item", at_end, "")).alias("certificate"),
        F.coalesce(last, F.regexp_extract("item", _YEAR, 1)).try_cast("int").alias("year"),
    )


def cv_education(lines: DataFrame) -> DataFrame:
    """lines(document_id, line_no, text) of an education section: a line with a degree opens a block -> degree, institution, years."""
    degree = F.col("text").rlike(r"(?i)\b(bachelor|master|ph\.?d|doctor|diploma|b\.?sc|m\.?sc|mba)\b|بكالوريوس|ماجستير|دكتوراه|دبلوم")
    w = Window.partitionBy("document_id").orderBy("line_no")
    blocks = lines.withColumn("block", F.sum(degree.cast("int")).over(w)).where("block > 0")
    school = F.col("text").rlike(r"(?i)\b(university|college|institute|school)\b|جامعة|كلية|معهد")
    return blocks.groupBy("document_id", "block").agg(
        F.min_by("text", "line_no").alias("degree"),
        F.min_by(F.when(school, F.col("text")), F.when(school, F.col("line_no"))).alias("institution"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: F.regexp_extract_all(x["text"], F.lit(_YEAR), F.lit(1))))).alias("years"),
    )


def cv_experience(lines: DataFrame) -> DataFrame:
    """lines of an experience section: a line with a range of years is an entry; its header is the rest of the line, or the line before;
    title and organisation only from "X at Y"."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    rows = lines.withColumn("before", F.lag("text").over(w)).where(F.col("text").rlike(_RANGE))
    rest = F.trim(F.regexp_replace(F.regexp_replace("text", _RANGE, ""), r"^[\s,|()–-]+|[\s,|()–-]+$", ""))
    header = F.when(rest != "", rest).otherwise(F.trim("before"))
    end = F.lower(F.regexp_extract("text", _RANGE, 2))
    return rows.withColumn("header", header).select(
        "document_id", "line_no", "header",
        F.nullif(F.trim(F.regexp_extract("header", r"(?i)^(.+?)\s+at\s+(.+)$", 1)), F.lit("")).alias("title"),
        F.nullif(F.trim(F.regexp_extract("header", r"(?i)^(.+?)\s+at\s+(.+)$", 2)), F.lit("")).alias("organisation"),
        F.regexp_extract("text", _RANGE, 1).cast("int").alias("start"),
        end.try_cast("int").alias("end"), end.isin("present", "now", "current").alias("current"),
    )


def cv_contact(lines: DataFrame) -> DataFrame:
    """lines(document_id, line_no, text) -> candidates (document_id, field, ord, key, method) of name (the first line of 2 to 5 words
    without a digit), e-mail and phone, to be resolved like any other field."""
    from parchment.functions.text import emails, phones

    t = F.col("text")
    mails = lines.select("document_id", F.lit("email").alias("field"), "line_no", F.explode(emails(t)).alias("key"))
    calls = lines.select("document_id", F.lit("phone").alias("field"), "line_no", F.explode(phones(t)).alias("key"))
    n = F.size(F.split(F.trim(t), r"\s+"))
    named = lines.where(n.between(2, 5) & ~t.rlike(r"[\d@]")).groupBy("document_id").agg(F.min_by("text", "line_no").alias("key"), F.min("line_no").alias("line_no"))
    names = named.select("document_id", F.lit("name").alias("field"), "line_no", F.trim("key").alias("key"))
    return mails.unionByName(calls).unionByName(names).select(
        "document_id", "field", F.col("line_no").alias("ord"), "key", F.lit("labeled_line").alias("method")
    )
