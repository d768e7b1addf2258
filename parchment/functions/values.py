"""Values in text and on rows: numbers, currencies, periods, units, display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the pay readers, in order of precedence.
CURRENCY_TOKENS = {
    "SAR": ("sar", "s.r", "sr", "ريال", "ر.س", "riyal", "riyals"),
    "USD": ("usd", "us$", "$", "dollar", "dollars"),
    "EUR": ("eur", "€", "euro", "euros"),
    "GBP": ("gbp", "£", "pound", "pounds"),
    "AED": ("aed", "dirham", "درهم"),
    "EGP": ("egp", "جنيه"),
}
BARE_TOKENS = ("sr", "$", "€", "£")
MONTHLY_WORDS = (
    "per month", "a month", "monthly", "/month", "/mo", "month)", "month:",
    "شهري", "شهريا", "شهرياً", "الشهري", "بالشهر", "في الشهر",
)
ANNUAL_WORDS = (
    "per year", "a year", "per annum", "annual", "annually", "yearly", "/year", "/yr",
    "سنوي", "سنويا", "سنوياً", "السنوي", "في السنة",
)
TOTAL_WORDS = (
    "total compensation", "total pay", "including bonus", "incl. bonus", "with bonuses", "gross total",
    "total salary", "total monthly salary including", "allowances, bonuses", "bonuses, overtimes",
    "package", "الإجمالي", "شامل", "البدلات", "مكافآت", "إجمالي",
)
BASE_WORDS = (
    "base salary", "basic salary", "base pay", "basic pay", "excluding bonus", "without bonuses",
    "الراتب الأساسي", "الأساسي",
)
SALARY_WORDS = (
    "salary", "salaries", "wage", "wages", "pay", "compensation",
    "راتب", "الراتب", "رواتب", "أجر", "الأجر", "أجور",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value reckoned once a row, however often ``use`` names it; Spark repeats an expression inside lambdas."""
    return F.transform(F.array(value), use)[0]


def any_word(text: Column, found: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text in any case: one pass of one pattern."""
    return has_word(F.lower(text), found)


def has_word(low: Column, found: tuple[str, ...]) -> Column:
    """The same for a text in small letters."""
    return low.rlike(words_pattern(found))


def read_number(raw: Column) -> Column:
    """Thousands by commas, spaces or dots of three digits; not positive is null."""
    c = F.replace(F.replace(raw, F.lit("٬"), F.lit(",")), F.lit(" "), F.lit(""))
    thousands = c.rlike(r"^\d{1,3}(\.\d{3})+$")
    n = F.when(thousands, F.replace(c, F.lit("."), F.lit(""))).otherwise(F.replace(c, F.lit(","), F.lit("")))
    value = F.when(n.rlike(r"^\d+(\.\d+)?$"), n.try_cast("double"))
    return F.when(value > 0, value)


def find_currency(text: Column) -> Column:
    """The first currency in order whose word is in the text; four signs match inside words."""
    return currency_of(F.lower(text))


def currency_of(low: Column) -> Column:
    """The same for a text in small letters; one pattern of all words sorts out the texts without any."""
    out = F.lit(None).cast("string")
    for code, tokens in reversed(CURRENCY_TOKENS.items()):
        out = F.when(low.rlike(_currency_pattern(tokens)), code).otherwise(out)
    return F.when(low.rlike(_currency_pattern([t for ts in CURRENCY_TOKENS.values() for t in ts])), out)


def _currency_pattern(tokens) -> str:
    whole = words_pattern([t for t in tokens if t not in BARE_TOKENS], "(?<![a-z])", "(?![a-z])")
    return "|".join([whole, *(f"\\Q{t}\\E" for t in tokens if t in BARE_TOKENS)])


def words_pattern(tokens, before: str = "", after: str = "") -> str:
    """One of the words, between two conditions if there are any; a place is looked at further only if a word's first letter stands there."""
    first = "".join(sorted({"\\" + t[0] if not t[0].isalnum() else t[0] for t in tokens}))
    return f"(?=[{first}]){before}(?:{'|'.join(f'\\Q{t}\\E' for t in tokens)}){after}"


def find_period(text: Column) -> Column:
    return period_of(F.lower(text))


def period_of(low: Column) -> Column:
    return F.when(has_word(low, MONTHLY_WORDS), "monthly").when(has_word(low, ANNUAL_WORDS), "annual")


def find_basis(text: Column) -> Column:
    return F.coalesce(basis_of(F.lower(text)), F.lit("unspecified"))


def basis_of(low: Column) -> Column:
    """The basis that a text in small letters states, else null."""
    return F.when(has_word(low, TOTAL_WORDS), "total_compensation").when(has_word(low, BASE_WORDS), "base_salary")


def mentions_salary(text: Column) -> Column:
    return any_word(text, SALARY_WORDS)


def convert_unit(value: Column, unit: Column, to: Column) -> Column:
    """Days and weeks, months and years, monthly and annual pay of one currency; other pairs give null."""
    money = r"^(sar|riyal)_(monthly|annual)$"
    same_money = unit.rlike(money) & to.rlike(money) & (F.split(unit, "_")[0] == F.split(to, "_")[0])
    pair = F.concat_ws(">", unit, to)
    return (
        F.when(unit == to, value)
        .when(pair == "day>week", value / 7)
        .when(pair == "week>day", value * 7)
        .when(pair == "month>year", value / 12)
        .when(pair == "year>month", value * 12)
        .when(same_money & unit.endswith("_monthly"), value * 12)
        .when(same_money & unit.endswith("_annual"), value / 12)
    )


def monthly_money(amount: Column, currency: Column, period: Column, is_percentage: Column) -> Column:
    """Struct (amount, problem): a monthly amount, or the name of what is missing."""
    problem = (
        F.when(is_percentage, "percentage")
        .when(amount.isNull(), "no amount")
        .when(currency.isNull(), "no currency")
        .when(period.isNull(), "no period")
        .when(~period.isin("monthly", "annual"), "other period")
    )
    monthly = F.when(period == "annual", amount / 12).otherwise(amount)
    return F.struct(F.when(problem.isNull(), monthly).alias("amount"), problem.alias("problem"))


def base_duration(count: Column, unit: Column, qualifier: Column) -> Column:
    """Struct (value, unit): weeks as days, years as months; the unit keeps its qualifier."""
    value = F.when(unit == "week", count * 7).when(unit == "year", count * 12).otherwise(count)
    base = F.when(unit.isin("day", "week"), "day").when(unit.isin("month", "year"), "month")
    return F.struct(value.alias("value"), F.concat_ws(" ", qualifier, base).alias("unit"))


def display_number(value: Column) -> Column:
    return F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def similarity_pct(score: Column) -> Column:
    """Half to even, as the percentages are shown."""
    return F.bround(score * 100).cast("int")


def opt_int(raw: Column) -> Column:
    """A whole number from digits or a whole float, else null."""
    number = raw.try_cast("double")
    return F.when(raw.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), number.cast("long"))


def opt_str(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def citation(*parts: Column) -> Column:
    """Parts joined by dashes; null parts are left out, and without any a fixed text stands."""
    out = F.concat_ws(" — ", *parts)
    return F.when(out == "", "unidentified article").otherwise(out)


def contract_type(text: Column) -> Column:
    """Open-ended is looked for first, for its Arabic name holds the other's."""
    low = F.lower(text)
    return F.when(low.rlike("indefinite|unlimited|open[- ]ended|غير محدد"), "indefinite").when(
        low.rlike("fixed[- ]term|limited|definite|محدد"), "fixed_term"
    )


def normalized_money(amount: Column, currency: Column, period: Column) -> Column:
    return F.concat_ws(" ", currency, F.format_string("%s", F.regexp_replace(amount.cast("string"), r"\.0$", "")), period)


def normalized_duration(count: Column, unit: Column, qualifier: Column) -> Column:
    return F.concat_ws(" ", F.regexp_replace(count.cast("string"), r"\.0$", ""), qualifier, unit)
