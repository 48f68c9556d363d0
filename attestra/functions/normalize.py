"""Scalar normalizers as Column expressions: a value that can't be understood is null."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from attestra.functions.exact import all_lower, let, py_trim, similarity, title_case
from attestra.functions.policy import COUNTRIES, DEGREES, SIMILAR_PERCENT, SKILLS, lookup

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Calling code -> digits of the national number, least and most (public numbering plan facts, widely kept).
CALLING = {"44": (9, 10), "33": (9, 9), "49": (6, 11), "34": (9, 9), "39": (8, 11), "91": (10, 10), "61": (9, 9), "81": (9, 10), "86": (10, 11), "55": (10, 11), "31": (9, 9), "41": (9, 9), "46": (7, 10), "353": (7, 9), "65": (8, 8)}
NANP = r"^[2-9](?!11)\d{2}[2-9](?!11)\d{6}$"


def phone(raw: Column) -> Column:
    """E.164: numbers of the North American plan, or behind a plus sign those of the listed calling codes."""
    return let(F.regexp_replace(py_trim(raw), r"(?i)\s*(?:ext\.?|x|#)\s*\d{1,6}$", ""), lambda bare: let(F.regexp_replace(bare, r"\D", ""), lambda digits: _phone(bare, digits)))


def _phone(bare: Column, digits: Column) -> Column:
    clean = bare.rlike(r"^\+?[\d\s().\-/]+$")
    national = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    here = F.when(national.rlike(NANP) & ~bare.startswith("+"), F.concat(F.lit("+1"), national))
    plus = F.when((F.length(digits) == 11) & digits.startswith("1") & F.substring(digits, 2, 10).rlike(NANP), F.concat(F.lit("+"), digits))
    abroad = F.coalesce(plus, *[
        F.when(digits.rlike(rf"^{code}[1-9]\d{{{low - 1},{high - 1}}}$"), F.concat(F.lit("+"), digits)) for code, (low, high) in CALLING.items()
    ])
    return F.when(clean, F.when(bare.startswith("+"), abroad).otherwise(here))


@lru_cache(maxsize=1)
def _iso(spark: SparkSession) -> dict[str, str]:
    """Lower-case names and codes of the ISO 3166 countries that the JVM knows."""
    locale = spark._jvm.java.util.Locale
    out: dict[str, str] = {}
    for code in locale.getISOCountries():
        country = locale("", code)
        for name in (code, country.getISO3Country(), country.getDisplayCountry(locale.ENGLISH)):
            out.setdefault(name.lower(), code)
    return out


def country(raw: Column, spark: SparkSession | None = None) -> Column:
    """Alpha-2 code by alias, code or English name; no fuzzy match."""
    spark = spark or SparkSession.getActiveSession()
    names = {k: v for k, v in _iso(spark).items() if k not in COUNTRIES} | COUNTRIES
    known = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in names.items())), F.lit("\x1e"), F.lit("\x1f"))
    return F.try_element_at(known, F.lower(py_trim(raw)))


def month(raw: Column) -> Column:
    """``YYYY-MM``, ``present`` or null. Missing parts are those of January 2000."""
    return let(F.lower(py_trim(raw)), _month)


def _month(low: Column) -> Column:
    number = lambda s: F.lpad((F.array_position(F.lit(MONTHS), F.substring(s, 1, 3))).cast("string"), 2, "0")
    full = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"

    def of(pattern: str, year: int | None, mon: int | None, named: bool) -> Column:
        y = F.regexp_extract(low, pattern, year) if year else F.lit("2000")
        m = F.regexp_extract(low, pattern, mon) if mon else F.lit("01")
        m = number(m) if named else F.lpad(m, 2, "0")
        return F.when(low.rlike(pattern) & m.between("01", "12"), F.concat(y, F.lit("-"), m))

    day = r"(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?"
    return F.when(low.rlike(r"^(present|current|now|ongoing)$"), F.lit("present")).otherwise(F.coalesce(
        of(r"^(\d{4})[-/.](\d{1,2})(?:[-/.]%s)?(?:[t ].*)?$" % day, 1, 2, False),
        of(r"^(\d{4})$", 1, None, False),
        of(r"^(\d{1,2})/(\d{4})$", 2, 1, False),
        of(r"^(\d{1,2})[-/.]%s[-/.](\d{4})$" % day, 2, 1, False),
        of(r"^%s[-/.](\d{1,2})[-/.](\d{4})$" % r"(?:1[3-9]|2\d|3[01])", 2, 1, False),
        of(r"^%s,?[\s\-/]+(?:%s,?\s+)?(\d{4})$" % (full, day), 2, 1, True),
        of(r"^%s\s+%s,?\s+(\d{4})$" % (day, full), 2, 1, True),
        of(r"^(\d{4})[\s\-/]+%s$" % full, 1, 2, True),
        of(r"^%s$" % full, None, 1, True),
        F.when(low.rlike(r"^(?:0?[1-9]|[12]\d|3[01])$"), F.lit("2000-01")),
    ))


def date_range(raw: Column) -> Column:
    """struct(start, end), cut once at a dash or the letters ``to``."""
    return let(F.split(raw, r"(?U)\s*(?:-|–|—|to)\s*", 2), lambda parts: F.struct(
        month(F.get(parts, F.lit(0))).alias("start"), month(F.get(parts, F.lit(1))).alias("end")))


def skill(raw: Column) -> Column:
    """Canonical name by alias, then the most similar canonical name (the first of equals), else as written (all-lower text in title case)."""
    return let(py_trim(raw), _skill)


def _skill(text: Column) -> Column:
    aliases = {alias: name for name, known in SKILLS.items() for alias in known}
    close = F.array(*[F.struct(similarity(text, F.lit(n), SIMILAR_PERCENT).alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(SKILLS)])
    best = F.array_max(F.filter(close, lambda x: x["score"] >= SIMILAR_PERCENT))["name"]
    return F.when(text != "", F.coalesce(
        lookup(aliases, F.lower(text)), F.when(F.length(text) >= 2, best), F.when(all_lower(text), title_case(text)).otherwise(text)
    ))


def skills(raw: Column) -> Column:
    """Canonical names of an array, distinct, in order of first sight."""
    return F.array_distinct(F.filter(F.transform(raw, skill), lambda x: x.isNotNull()))


def email(raw: Column) -> Column:
    text = F.lower(py_trim(raw))
    return F.when(text.contains("@") & F.substring_index(text, "@", -1).contains("."), text)


def years(raw: Column) -> Column:
    text = py_trim(raw)
    plain = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
    return F.when(plain.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"), plain.try_cast("double"))


def degree(raw: Column) -> Column:
    key = F.regexp_replace(F.upper(raw), r"[^\p{L}\p{N}]", "")
    return F.coalesce(lookup(DEGREES, key), py_trim(raw))


def location(loc: Column) -> Column:
    return F.struct(loc["city"].alias("city"), loc["region"].alias("region"), F.when(loc["country"] != "", country(loc["country"])).alias("country"))


def experience(x: Column) -> Column:
    def or_raw(v: Column) -> Column:
        return F.coalesce(month(v), v)

    return F.struct(
        x["title"].alias("title"), x["company"].alias("company"), or_raw(x["start"]).alias("start"),
        F.when(x["end"] == "present", x["end"]).otherwise(or_raw(x["end"])).alias("end"), x["summary"].alias("summary"),
    )


def education(x: Column) -> Column:
    year = py_trim(x["end_year"])
    return F.struct(
        x["institution"].alias("institution"), degree(x["degree"]).alias("degree"), x["field"].alias("field"),
        F.when(year != "", year).alias("end_year"),
    )

