"""Queries that put the driver's tables through the source adapters and normalizers, with their SQL.

Rows of a table are written as the texts of CSV, JSON, résumé and note files, one file a row, and scanned like files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import normalize as N
from attestra.functions.policy import COUNTRIES, SKILLS
from attestra.operators.evidence import normalize_all
from attestra.sources import files as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    """Concatenation of Columns and plain strings."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def as_files(rows: DataFrame, key: str, content: Column) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("record_id"), F.col(key).cast("long").alias("record_ord"), content.alias("text"))


def shown(x: Column, names: list[str]) -> Column:
    """Members of a struct joined by bars, nulls as tildes."""
    return F.when(x.isNotNull(), F.array_join(F.array(*[x[n] for n in names]), "|", "~"))


def flat(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        F.col("record_id").cast("long").alias("record_id"), "obs_ord", "field", "method", "v_str", "raw_value",
        shown(F.col("v_loc"), ["city", "region", "country"]).alias("place"),
        shown(F.col("v_exp"), ["title", "company", "start", "end", "summary"]).alias("work"),
        shown(F.col("v_edu"), ["institution", "degree", "field", "end_year"]).alias("study"),
    )


def claims_sql(source: str, claims: str, raw: bool = False) -> str:
    """Rows of the list expression ``claims`` of structs over ``source``, which has a column ``line``; those of null ``f`` are left out."""
    return f"""
select record_id, (1000 * line + p)::int as obs_ord, x.f as field, x.m as method, x.v as v_str, {"x.raw as raw_value, " * raw}x.place as place, x.work as work, x.study as study
from (select record_id, line, unnest(l) as x, generate_subscripts(l, 1) - 1 as p
      from (select *, list_filter({claims}, lambda x: x.f is not null) as l from {source}))"""


def one_sql(field: str, method: str, v: str, raw: str | None = None, when: str = "true", place: str = "null", work: str = "null", study: str = "null") -> str:
    return (
        f"{{'f': case when {when} then '{field}' end, 'm': '{method}', 'v': ({v})::varchar, 'raw': ({raw or v})::varchar,"
        f" 'place': ({place})::varchar, 'work': ({work})::varchar, 'study': ({study})::varchar}}"
    )


def list_sql(*claims: str) -> str:
    return "[" + ", ".join(claims) + "]"


# --- CSV --------------------------------------------------------------------------------------------

def csv_scan(spark, sf_dir):
    k = F.col("c_custkey")
    plain = text(
        "candidate_id,Name,EMAIL,title,company,current_company,notes\r\n", k, ',"Ms ""', F.col("c_name"), '"" Q",', F.when(k % 4 == 0, "  ").otherwise(text("c", k, "@Mail.example")),
        ",", F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), ",", F.when(k % 2 == 0, "").otherwise(text("N", F.col("c_nationkey"))), ",Alt,\"two\nlines\"\r\n",
    )
    other = text("﻿id,full_name,phone,title\n", k, ",", F.col("c_name"), ", (415) 555-0142 ,", F.col("c_mktsegment"), "\n\nx", k, "\n")
    return flat(S.structured(S.csv_rows(as_files(table(spark, sf_dir, "customer"), "c_custkey", F.when(k % 5 == 0, other).otherwise(plain)))))


_S = "structured_field"
_CSV = claims_sql("""(select c_custkey as record_id, 0 as line, * from customer union all select c_custkey, 1, * from customer where c_custkey % 5 = 0)""", "case when line = 1 then " + list_sql(
    one_sql("candidate_id", _S, "'x' || record_id")) + " when record_id % 5 = 0 then " + list_sql(
    one_sql("candidate_id", _S, "record_id"), one_sql("full_name", _S, "c_name"), one_sql("phones", _S, "'(415) 555-0142'", "' (415) 555-0142 '"), one_sql("headline", _S, "c_mktsegment")) + " else " + list_sql(
    one_sql("candidate_id", _S, "record_id"), one_sql("full_name", _S, "'Ms \"' || c_name || '\" Q'"), one_sql("emails", _S, "'c' || record_id || '@Mail.example'", when="record_id % 4 <> 0"),
    one_sql("headline", _S, "c_mktsegment || ' at ' || case when record_id % 2 = 0 then 'Alt' else 'N' || c_nationkey end", "c_mktsegment", "record_id % 3 <> 0")) + " end", raw=True)


# --- JSON -------------------------------------------------------------------------------------------

def json_scan(spark, sf_dir):
    k = F.col("c_custkey")
    parts = F.array_join(F.filter(F.array(
        F.when(k % 4 == 0, text('"id": "C', k, '"')).otherwise(text('"candidateId": ', k)),
        F.when(k % 3 == 0, text('"fullName": "', F.col("c_name"), '"')).otherwise(text('"firstName": "Ann", "lastName": "R', k, '"')),
        F.when(k % 2 == 0, text('"emailAddress": "a', k, '@x.example"')).otherwise(text('"emailAddress": "", "email": "b', k, '@x.example"')),
        text('"phone": "+1 415 555 0142", "jobTitle": null, "title": "', F.col("c_mktsegment"), '"'),
        F.when(k % 3 == 0, text('"location": {"city": "T', F.col("c_nationkey"), '", "state": "", "region": "R", "country": "Utopia"}')).when(k % 3 == 1, text('"location": "Land ', F.col("c_nationkey"), '"')),
        F.lit('"skills": ["js", "  ", "Python"]'),
        text('"workHistory": [{"title": "Clerk", "employer": "E', k, '", "startDate": "2019-03", "endDate": "present", "summary": "did"}, "noise", {"jobTitle": "Temp", "company": "F", "start": "2018"}]'),
        text('"education": [{"school": "U', F.col("c_nationkey"), '", "degree": "BS", "major": "Math", "endYear": 2016}, 7]'),
        text('"githubUrl": "github.com/u', k, '", "linkedin": ""'),
        text('"yearsExperience": ', k % 20),
    ), lambda x: x.isNotNull()), ", ")
    content = F.when(k % 7 == 0, "{ not valid json ,,,").when(k % 11 == 0, "[1, 2]").otherwise(text("{", parts, "}"))
    return flat(S.semi_structured(as_files(table(spark, sf_dir, "customer"), "c_custkey", content))).drop("raw_value")


_J = "semi_structured"
_JSON = claims_sql("(select c_custkey as record_id, 0 as line, * from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0)", list_sql(
    one_sql("candidate_id", _J, "case when record_id % 4 = 0 then 'C' else '' end || record_id"),
    one_sql("full_name", _J, "case when record_id % 3 = 0 then c_name else 'Ann R' || record_id end"),
    one_sql("emails", _J, "case when record_id % 2 = 0 then 'a' else 'b' end || record_id || '@x.example'"), one_sql("phones", _J, "'+1 415 555 0142'"), one_sql("headline", _J, "c_mktsegment"),
    one_sql("location", _J, "null", when="record_id % 3 < 2", place="case when record_id % 3 = 0 then 'T' || c_nationkey || '|R|Utopia' else '~|~|Land ' || c_nationkey end"),
    one_sql("skills", _J, "'js'"), one_sql("skills", _J, "'Python'"),
    one_sql("experience", _J, "null", work="'Clerk|E' || record_id || '|2019-03|present|did'"), one_sql("experience", _J, "null", work="'Temp|F|2018|~|~'"),
    one_sql("education", _J, "null", study="'U' || c_nationkey || '|BS|Math|2016'"), one_sql("links", _J, "'github.com/u' || record_id"),
    one_sql("years_experience", _J, "record_id % 20", when="record_id % 20 <> 0")))


# --- résumés and notes --------------------------------------------------------------------------------

def resume_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    content = text(
        F.when(k % 3 == 0, text("cv s", k, "@mail.example")).otherwise(F.col("s_name")), "\ns", k, "@mail.example | (415) 555-01", F.lpad((k % 100).cast("string"), 2, "0"),
        " | T\r\nhttps://linkedin.com/in/s", k, ", github.com/s", k, ".\nSkills:\nold, words\nSummary\nWorked in 2019 and 2020.\nskills\nTools: Python, SQL • Go, (Rust)\n",
        "EXPERIENCE:\nClerk, Acme ", F.col("s_nationkey"), " (Jan 2019 - Present)\n• sold, things (all)\nGlobex Corp Berlin, Berlin\nAnalyst Mar 2015 - Dec 2018\n",
        "Education\nB.S. Mathematics, Town College, 2016\nTech Institute, Pune\nM.Tech Physics, CGPA 9 2018\n",
    )
    return flat(S.resume(as_files(table(spark, sf_dir, "supplier"), "s_suppkey", content))).drop("raw_value")


_R, _P = "regex_prose", "labeled_prose"
_FREE = list_sql(
    one_sql("emails", _R, "'s' || record_id || '@mail.example'", when="record_id % 3 = 0"), one_sql("emails", _R, "'s' || record_id || '@mail.example'"),
    one_sql("phones", _R, "'415) 555-01' || lpad((record_id % 100)::varchar, 2, '0')"), one_sql("links", _R, "'https://linkedin.com/in/s' || record_id"), one_sql("links", _R, "'github.com/s' || record_id"),
    *[one_sql("skills", _P, f"'{s}'") for s in ("Python", "SQL", "Go", "Rust")])
_RESUME = f"""
with s as (select s_suppkey as record_id, 0 as line, * from supplier)
{claims_sql("s", _FREE)}
union all select record_id, 1000000, 'education', '{_P}', null, null, null, 'Town College|B.S|Mathematics|2016' from s
union all select record_id, 1000002, 'education', '{_P}', null, null, null, 'Tech Institute|M.Tech|~|2018' from s
union all select record_id, 2000000, 'experience', '{_P}', null, null, 'Clerk|Acme ' || s_nationkey || '|2019-01|present|~', null from s
union all select record_id, 2000003, 'experience', '{_P}', null, null, 'Analyst|Globex Corp|2015-03|2018-12|~', null from s
union all select record_id, 3000000, 'full_name', '{_R}', s_name, null, null, null from s where record_id % 3 <> 0"""


def notes_scan(spark, sf_dir):
    k = F.col("c_custkey")
    content = text(
        "Call 2024-03-01 about role\nName: Ann ", k, "\nCELL : (415) 555-0", F.lpad((k % 1000).cast("string"), 3, "0"), "\nEmail: n", k, "@mail.example\nLocation: Land ", F.col("c_nationkey"),
        "\nTitle:  \nShe may use o", k, "@mail.example or github.com/n", k, ".; seen at github.com/n", k, "\nOther: x", k, "@mail.example 4155550", F.lpad((k % 1000).cast("string"), 3, "0"), "\n",
    )
    return flat(S.notes(as_files(table(spark, sf_dir, "customer"), "c_custkey", content))).drop("raw_value")


_NOTES = claims_sql("(select c_custkey as record_id, 0 as line, * from customer)", list_sql(
    one_sql("full_name", _P, "'Ann ' || record_id"), one_sql("phones", _P, "'(415) 555-0' || lpad((record_id % 1000)::varchar, 3, '0')"), one_sql("emails", _P, "'n' || record_id || '@mail.example'"),
    one_sql("location", _P, "null", place="'~|~|Land ' || c_nationkey"), one_sql("emails", _R, "'o' || record_id || '@mail.example'"),
    one_sql("links", _R, "'github.com/n' || record_id"), one_sql("links", _R, "'github.com/n' || record_id")))


# --- normalizers --------------------------------------------------------------------------------------

NANP_SQL = r"^[2-9](?:[02-9]\d|1[02-9])[2-9](?:[02-9]\d|1[02-9])\d{4}$"


def phone_sql(raw: str) -> str:
    """The phone rule in SQL, over an expression that is evaluated several times."""
    bare = rf"regexp_replace(trim({raw}), '\s*(?:ext\.?|x|#)\s*\d{{1,6}}$', '', 'i')"
    digits = rf"regexp_replace({bare}, '\D', '', 'g')"
    abroad = " or ".join(rf"regexp_matches({digits}, '^{code}[1-9]\d{{{low - 1},{high - 1}}}$')" for code, (low, high) in N.CALLING.items())
    return rf"""case when not regexp_matches({bare}, '^\+?[\d\s().\-/]+$') then null
        when starts_with({bare}, '+') then case when length({digits}) = 11 and starts_with({digits}, '1') and regexp_matches(substr({digits}, 2), '{NANP_SQL}') or {abroad} then '+' || {digits} end
        when length({digits}) = 10 and regexp_matches({digits}, '{NANP_SQL}') then '+1' || {digits}
        when length({digits}) = 11 and starts_with({digits}, '1') and regexp_matches(substr({digits}, 2), '{NANP_SQL}') then '+' || {digits} end"""


def turned(key: Column, forms: list) -> Column:
    """The form of the key's turn."""
    return F.get(F.array(*[f if isinstance(f, Column) else F.lit(f) for f in forms]), (key % len(forms)).cast("int"))


def turned_sql(key: str, forms: list[str]) -> str:
    return f"[{', '.join(forms)}][{key} % {len(forms)} + 1]"


def phone_forms(spark, sf_dir):
    k = F.col("c_custkey")
    last = F.lpad((k % 10000).cast("string"), 4, "0")
    raw = turned(k, [text("(415) 555-", last), text("+1 415-555-", last), text("415.555.", last), text("+1415555", last), "call me maybe", "123", "", text("+44 20 7946 ", last),
                     text("(115) 555-", last), text("1-415-555-", last, " ext. 12"), text("+49 30 9018", last), text("+999 415 555 ", last)])
    return table(spark, sf_dir, "customer").select("c_custkey", N.phone(raw).alias("e164"))


_PHONES = "select c_custkey, " + turned_sql("c_custkey", [
    *["'+1415555' || lpad((c_custkey % 10000)::varchar, 4, '0')"] * 4, "null", "null", "null", "'+44207946' || lpad((c_custkey % 10000)::varchar, 4, '0')", "null",
    "'+1415555' || lpad((c_custkey % 10000)::varchar, 4, '0')", "'+49309018' || lpad((c_custkey % 10000)::varchar, 4, '0')", "null"]) + " as e164 from customer"


def country_forms(spark, sf_dir):
    k = F.col("c_custkey")
    raw = turned(k, ["USA", "United States", " uk ", "US", "Narnia", "fra", "Germany", "u.s.", "", "INDIA", "br", "Ivory Coast", "zz"])
    return table(spark, sf_dir, "customer").select("c_custkey", N.country(raw, spark).alias("country"))


_COUNTRY = "select c_custkey, " + turned_sql("c_custkey", ["'US'", "'US'", "'GB'", "'US'", "null", "'FR'", "'DE'", "'US'", "null", "'IN'", "'BR'", "'CI'", "null"]) + " as country from customer"


def country_aliases(spark, sf_dir):
    """Every alias of the table, in several spellings, for every region."""
    names = F.explode(F.array(*[F.lit(x) for x in COUNTRIES]))
    return table(spark, sf_dir, "region").select("r_regionkey", names.alias("alias")).select("r_regionkey", "alias", N.country(F.upper(text(" ", F.col("alias"), "\t")), spark).alias("country"))


_ALIASES = "select r_regionkey, alias, country from region, (values " + ", ".join(f"('{a}', '{c}')" for a, c in COUNTRIES.items()) + ") as v(alias, country)"


def month_forms(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    raw = turned(k, [f("MMM yyyy"), f("MMMM yyyy"), f("yyyy-MM"), f("MM/yyyy"), f("yyyy"), f("MMM. d, yyyy"), f("d MMMM yyyy"), f("yyyy/MM/dd"), f("MM/dd/yyyy"), "Present", " ONGOING ", "garbage", "", f("MMM-yyyy"),
                     f("yyyy MMMM"), f("yyyy-MM-dd'T'HH:mm")])
    return table(spark, sf_dir, "orders").select("o_orderkey", N.month(raw).alias("month"))


_M = "strftime(o_orderdate, '%Y-%m')"
_MONTH = "select o_orderkey, " + turned_sql("o_orderkey", [_M, _M, _M, _M, "strftime(o_orderdate, '%Y-01')", _M, _M, _M, _M, "'present'", "'present'", "null", "null", _M, _M, _M]) + " as month from orders"


def date_ranges(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    a, b = F.date_format(d, "MMM yyyy"), F.date_format(F.add_months(d, 30), "MMMM yyyy")
    raw = turned(k, [text(a, " - ", b), text(a, " – ", b), text(a, "—", b), text(a, " to ", b), a, text(a, " - Present"), text("garbage - ", b)])
    return table(spark, sf_dir, "orders").select("o_orderkey", N.date_range(raw).alias("r")).select("o_orderkey", F.col("r.start").alias("begins"), F.col("r.end").alias("ends"))


_E = "strftime(o_orderdate + interval 30 month, '%Y-%m')"
_RANGE = f"select o_orderkey, {turned_sql('o_orderkey', [_M, _M, _M, _M, _M, _M, 'null'])} as begins, {turned_sql('o_orderkey', [_E, _E, _E, _E, 'null', chr(39) + 'present' + chr(39), _E])} as ends from orders"


def skill_words(df: DataFrame) -> DataFrame:
    """Words of part names and, as misspelt skills, each with a canonical name's neighbour."""
    near = F.array(*[F.lit(x) for x in ("JavaScrpt", "Kubernets", "PostgreSQLs", "Machine Learnin", "REST API", "k8s", "JS", " react.js ", "Rust", "java", "Graph-QL", "", "TypeScripts", "nodejs", "élan vital")])
    return df.select(F.explode(F.concat(F.split("p_name", " "), near)).alias("token")).distinct()


def normalize_skill(spark, sf_dir):
    return skill_words(table(spark, sf_dir, "part")).select("token", N.skill(F.col("token")).alias("skill"))


def ratio_sql(pairs: str) -> str:
    """(a, b, score) of a relation (a, b): the share of the longest common subsequence in both lengths, times 200."""
    return f"""
    with recursive step as (
        select a, b, 1 as i, list_transform(range(length(b) + 1), lambda x: 0) as row_ from {pairs}
        union all
        select a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
            lambda x: case when substr(b, x, 1) = substr(a, i, 1) then row_[x] + 1 else row_[x + 1] end))))
        from step where i <= length(a))
    select a, b, 200.0 * row_[length(b) + 1] / (length(a) + length(b)) as score from step where i = length(a) + 1"""


_NAMES = "(values " + ", ".join(f"('{n}', {i})" for i, n in enumerate(SKILLS)) + ") as v(name, i)"
_ALIAS = "(values " + ", ".join(f"('{a}', '{n}')" for n, some in SKILLS.items() for a in some) + ") as w(alias, name)"
_NEAR = ", ".join(f"'{x}'" for x in ("JavaScrpt", "Kubernets", "PostgreSQLs", "Machine Learnin", "REST API", "k8s", "JS", " react.js ", "Rust", "java", "Graph-QL", "", "TypeScripts", "nodejs", "élan vital"))
_SKILL = f"""
with tokens as (select distinct unnest(list_concat(string_split(p_name, ' '), [{_NEAR}])) as token from part),
pairs as (select trim(token) as a, name as b, i from tokens, {_NAMES} where length(trim(token)) >= 2),
scores as ({ratio_sql('pairs')}),
best as (select a, arg_max(b, struct_pack(s := score, n := -i)) as name from scores join pairs using (a, b) where score >= 88 group by a)
select token, case when trim(token) = '' then null else coalesce(w.name, best.name, case when token = lower(token) then
    list_reduce(list_transform(string_split(trim(token), ' '), lambda x: upper(x[1]) || x[2:]), lambda a, b: a || ' ' || b) else trim(token) end) end as skill
from tokens left join {_ALIAS} on alias = lower(trim(token)) left join best on best.a = trim(token)"""


def skill_lists(spark, sf_dir):
    given = F.concat(F.split("p_name", " "), F.array(F.lit("js"), F.lit("JavaScript"), F.lit(" "), F.element_at(F.split("p_name", " "), 1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(N.skills(given), "|").alias("skills"))


_LISTS = """select p_partkey, array_to_string(list_concat(list_transform(words, lambda w: upper(w[1]) || w[2:]), ['JavaScript']), '|') as skills
from (select p_partkey, case when string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2] then [string_split(p_name, ' ')[1]] else string_split(p_name, ' ') end as words from part)"""

DEGREE_FORMS = ["B.S.", "bsc", "Bachelor of Science", "Ph.D", "mba", " M.Tech. ", "Diploma ", "B.A", "b s"]


def degrees(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.degree(turned(F.col("c_custkey"), DEGREE_FORMS)).alias("degree"))


_DEGREE = "select c_custkey, " + turned_sql("c_custkey", ["'B.S.'", "'B.S.'", "'B.S.'", "'Ph.D.'", "'MBA'", "'M.Tech'", "'Diploma'", "'B.A.'", "'B.S.'"]) + " as degree from customer"


def normalized(spark, sf_dir):
    """Raw evidence of every field from customers, normalized: dropped rows stay, with a note."""
    k = F.col("c_custkey")
    m = "structured_field"
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), k.alias("record_ord"), "c_custkey", "c_name")
    said = S.emit(who.withColumn("x", F.lit(0)), "recruiter_csv", F.array(
        S.claim("phones", m, turned(k, ["(415) 555-0142", "nonsense"])), S.claim("emails", m, turned(k, [text(" A", k, "@Mail.Example "), "no-at.example", "x@nodot"])),
        S.claim("skills", m, turned(k, ["js", " ", "Rust"])), S.claim("years_experience", m, turned(k, ["7", "7.5", "1_0", "many"])),
        S.claim("location", m, None, v_loc=F.struct(F.lit("T").alias("city"), F.lit(None).cast("string").alias("region"), turned(k, [F.lit("uk"), F.lit("Narnia"), F.lit("")]).alias("country"))),
        S.claim("experience", m, None, v_exp=F.struct(F.lit("Clerk").alias("title"), F.lit("E").alias("company"), turned(k, ["Mar 2019", "long ago"]).alias("start"), turned(k, ["present", "2020", "soon"]).alias("end"), F.lit(None).cast("string").alias("summary"))),
        S.claim("education", m, None, v_edu=F.struct(F.lit("U").alias("institution"), F.lit("bsc").alias("degree"), F.lit("Math").alias("field"), turned(k, [" 2016 ", " "]).alias("end_year"))),
        S.claim("full_name", m, text("  ", F.col("c_name"), "\t")),
    ))
    out = normalize_all(said)
    return flat(out).drop("method", "raw_value").join(out.select(F.col("record_id").cast("long").alias("record_id"), "obs_ord", "v_num", "dropped", "note"), ["record_id", "obs_ord"])


def _normal_sql(pos: int, field: str, v_str: str = "null", v_num: str = "null", place: str = "null", work: str = "null", study: str = "null", dropped: str = "false", note: str = "null") -> str:
    return (f"select c_custkey as record_id, {pos}::int as obs_ord, '{field}' as field, ({v_str})::varchar as v_str, ({v_num})::double as v_num, ({place})::varchar as place, ({work})::varchar as work,"
            f" ({study})::varchar as study, {dropped} as dropped, ({note})::varchar as note from customer")


_K = "c_custkey"
_NORMAL = " union all ".join([
    _normal_sql(0, "phones", turned_sql(_K, ["'+14155550142'", "'nonsense'"]), dropped=f"{_K} % 2 = 1", note=turned_sql(_K, ["null", "'unparseable phone'"])),
    _normal_sql(1, "emails", turned_sql(_K, [f"'a' || {_K} || '@mail.example'", "'no-at.example'", "'x@nodot'"]), dropped=f"{_K} % 3 > 0", note=turned_sql(_K, ["null", "'malformed email'", "'malformed email'"])),
    _normal_sql(2, "skills", turned_sql(_K, ["'JavaScript'", "' '", "'Rust'"]), dropped=f"{_K} % 3 = 1", note=turned_sql(_K, ["null", "'empty skill'", "null"])),
    _normal_sql(3, "years_experience", v_num=turned_sql(_K, ["7.0", "7.5", "10.0", "null"]), dropped=f"{_K} % 4 = 3", note=turned_sql(_K, ["null", "null", "null", "'non-numeric years'"])),
    _normal_sql(4, "location", place=turned_sql(_K, ["'T|~|GB'", "'T|~|~'", "'T|~|~'"])),
    _normal_sql(5, "experience", work="'Clerk|E|' || " + turned_sql(_K, ["'2019-03'", "'long ago'"]) + " || '|' || " + turned_sql(_K, ["'present'", "'2020-01'", "'soon'"]) + " || '|~'"),
    _normal_sql(6, "education", study="'U|B.S.|Math|' || " + turned_sql(_K, ["'2016'", "'~'"])),
    _normal_sql(7, "full_name", "c_name"),
])


def years_forms(spark, sf_dir):
    k = F.col("event_id")
    raw = turned(k, [F.get_json_object("props", "$.k"), text(" ", k, ".5 "), "1_000", "seven", "", "-3", "1e2"])
    return table(spark, sf_dir, "events").select("event_id", N.years(raw).alias("years"))


_YEARS = "select event_id, " + turned_sql("event_id", ["json_extract_string(props, '$.k')::double", "(event_id::varchar || '.5')::double", "1000.0", "null", "null", "-3.0", "100.0"]) + " as years from events"

QUERIES = {
    "csv_scan": csv_scan, "json_scan": json_scan, "resume_scan": resume_scan, "notes_scan": notes_scan, "phone_forms": phone_forms, "country_forms": country_forms, "country_aliases": country_aliases,
    "month_forms": month_forms, "date_ranges": date_ranges, "normalize_skill": normalize_skill, "skill_lists": skill_lists, "degrees": degrees, "normalize_all": normalized, "years_forms": years_forms,
}
ORACLES = {
    "csv_scan": _CSV, "json_scan": _JSON, "resume_scan": _RESUME, "notes_scan": _NOTES, "phone_forms": _PHONES, "country_forms": _COUNTRY, "country_aliases": _ALIASES,
    "month_forms": _MONTH, "date_ranges": _RANGE, "normalize_skill": _SKILL, "skill_lists": _LISTS, "degrees": _DEGREE, "normalize_all": _NORMAL, "years_forms": _YEARS,
}
