"""Queries that merge customers' evidence to records and shape them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.exact import ROUND4_SQL
from attestra.functions.policy import strength_sql
from attestra.operators import resolve as R
from attestra.operators.evidence import live, normalize_all, shaped
from attestra.plans.engine import run_batch
from attestra.plans.projection import canonical_view, project, validate
from attestra.plans.scans import table, text, turned, turned_sql
from attestra.sources import files as S
from attestra.sources.shared import materialize, shared_path


def round4_sql(value: str) -> str:
    return ROUND4_SQL.replace("{v}", value)


def keyed(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("cluster_id", F.col("record_id")).withColumn("member", F.col("record_id"))


def said(rows: DataFrame, source: str, turn: int, *claims: Column) -> DataFrame:
    found = S.emit(rows, source, F.array(*claims))
    return shaped(found.withColumn("source_ord", F.lit(turn)))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four sources say of each customer."""
    k, m = F.col("c_custkey"), "structured_field"
    who = table(spark, sf_dir, "customer").select(k.cast("string").alias("record_id"), k.alias("record_ord"), "c_custkey", "c_name", "c_mktsegment")
    given = lambda when, claim: F.when(when, claim)
    place = F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("region"), F.lit("usa").alias("country"))
    work = F.struct(F.lit("Clerk").alias("title"), F.lit("E").alias("company"), F.lit("Mar 2019").alias("start"), F.lit("present").alias("end"), F.lit(None).cast("string").alias("summary"))
    csv = said(who, "recruiter_csv", 0, given(k % 2 == 0, S.claim("candidate_id", m, text("C", k))), S.claim("full_name", m, F.col("c_name")),
               given(k % 5 != 0, S.claim("emails", m, text("c", k, "@x.example"))), given(k % 7 != 0, S.claim("phones", m, text("(415) 555-", F.lpad((k % 10000).cast("string"), 4, "0")))),
               S.claim("headline", m, F.col("c_mktsegment")))
    ats = said(who, "ats_json", 1, S.claim("headline", "semi_structured", "Lead"), S.claim("years_experience", "semi_structured", None, v_num=(k % 30).cast("double")),
               S.claim("skills", "semi_structured", "py"), S.claim("experience", "semi_structured", None, v_exp=work), S.claim("links", "semi_structured", text("github.com/u", k)))
    cv = said(who, "resume", 2, S.claim("skills", "regex_prose", "golang"), given(k % 3 == 0, S.claim("headline", "regex_prose", "Lead")))
    notes = said(who, "recruiter_notes", 3, S.claim("skills", "labeled_prose", "Python"), given(k % 3 == 0, S.claim("location", "labeled_prose", None, v_loc=place)),
                 S.claim("phones", "labeled_prose", "nonsense"), S.claim("links", "regex_prose", "https://example.com/b"), S.claim("hobby", "regex_prose", "chess"))
    return keyed(normalize_all(csv.unionByName(ats).unionByName(cv).unionByName(notes)))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' records, written."""
    return materialize(R.merge(materialize(customers(spark, sf_dir), "evidence")), "merged")


def merge(spark, sf_dir):
    m = merged(spark, sf_dir)
    value = lambda n: F.col(f"{n}.value")
    return m.select(
        F.col("cluster_id").cast("long").alias("entity"), value("candidate_id").alias("candidate_id"), F.col("candidate_id.confidence").alias("candidate_conf"),
        F.get("candidate_id.provenance", F.lit(0))["decision"].alias("candidate_why"), value("full_name").alias("full_name"), F.array_join(value("emails"), ",").alias("emails"), F.array_join(value("phones"), ",").alias("phones"),
        value("headline").alias("headline"), F.col("headline.confidence").alias("headline_conf"), F.array_join(F.get("headline.provenance", F.lit(0))["conflicted_with"], ",").alias("headline_against"),
        value("years_experience").alias("years"), F.array_join(value("skills"), ",").alias("skills"), F.col("skills.confidence").alias("skills_conf"), F.col("location.value.country").alias("country"),
        F.col("links.value.github").alias("github"), F.array_join(F.col("links.value.other"), ",").alias("other_links"), F.col("links.confidence").alias("links_conf"),
        F.size(value("education")).alias("n_education"), F.size(value("experience")).alias("n_experience"), "overall_confidence",
    )


_STRENGTHS = {n: f"{strength_sql(repr(s), repr(m))}" for n, (s, m) in {
    "csv": ("recruiter_csv", "structured_field"), "ats": ("ats_json", "semi_structured"), "cv": ("resume", "regex_prose"), "said": ("recruiter_notes", "labeled_prose"), "free": ("recruiter_notes", "regex_prose")}.items()}
_BOTH = round4_sql("(1.0::double - (1.0::double - ats) * (1.0::double - said))")
_ALONE = lambda s: round4_sql(f"(1.0::double - (1.0::double * (1.0::double - {s})))")
_LOST = round4_sql("(1.0::double - (1.0::double * (1.0::double - ats)) * case when k % 3 = 0 then (1.0::double - cv) else 1.0::double end)")
_MEAN = lambda values: round4_sql(f"(list_reduce(list_prepend(0.0::double, {values}), lambda a, b: a + b) / len({values}))")
_RECORDS = f"""
with s as (select {", ".join(f"{v} as {n}" for n, v in _STRENGTHS.items())}),
base as (
    select c_custkey as k, c_name, c_mktsegment, 'c' || c_custkey || '@x.example' as mail, '+1415555' || lpad((c_custkey % 10000)::varchar, 4, '0') as phone, s.* from customer, s),
scored as (
    select *, {round4_sql(f"(1.0::double * (1.0::double - 0.45::double * {_LOST}))")} as headline_conf, {_MEAN(f"[{_ALONE('cv')}, {_BOTH}]")} as skills_conf, {_ALONE('ats')} as ats_conf, {_ALONE('said')} as said_conf,
        {_MEAN("[ats, free]")} as links_conf,
        case when k % 5 <> 0 then 'email:' || mail when k % 7 <> 0 then 'phone:' || phone end as match_key from base),
record as (
    select k as entity, case when k % 2 = 0 then 'C' || k when match_key is not null then 'gen-' || substr(sha1(match_key), 1, 12) end as candidate_id,
        case when k % 2 = 0 then 1.0::double when match_key is not null then 0.3::double else 0.0::double end as candidate_conf,
        case when k % 2 = 0 then 'chose value from recruiter_csv (structured_field)' when match_key is not null then 'generated from strongest match key (no source id)' end as candidate_why,
        c_name as full_name, case when k % 5 <> 0 then mail else '' end as emails, case when k % 7 <> 0 then phone else '' end as phones, c_mktsegment as headline, headline_conf,
        case when k % 3 = 0 then 'ats_json,resume' else 'ats_json' end as headline_against, (k % 30)::double as years, 'Go,Python' as skills, skills_conf,
        case when k % 3 = 0 then 'US' end as country, 'github.com/u' || k as github, 'https://example.com/b' as other_links, links_conf, 0::int as n_education, 1::int as n_experience, ats_conf, said_conf
    from scored),
records as (
    select *, list_filter([case when candidate_id is not null then candidate_conf end, 1.0::double, case when emails <> '' then 1.0::double end, case when phones <> '' then 1.0::double end,
        case when country is not null then said_conf end, links_conf, headline_conf, ats_conf, skills_conf, ats_conf], lambda x: x is not null) as filled from record)
"""
_MERGE = _RECORDS + f"select * exclude (filled, ats_conf, said_conf), {_MEAN('filled')} as overall_confidence from records"


def id_fallback(spark, sf_dir):
    """Records of which nobody gave an id."""
    made = merged(spark, sf_dir).where(F.get("candidate_id.provenance", F.lit(0))["method"] == "inferred")
    return made.select(F.col("cluster_id").cast("long").alias("entity"), F.col("candidate_id.value").alias("candidate_id"), F.get("candidate_id.provenance", F.lit(0))["raw_value"].alias("match_key"))


_FALLBACK = _RECORDS + "select k as entity, 'gen-' || substr(sha1(match_key), 1, 12) as candidate_id, match_key from scored where k % 2 = 1 and match_key is not null"


def live_filter(spark, sf_dir):
    return live(customers(spark, sf_dir)).groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))


_LIVE = """select field, source, count(*) as n from (
    select unnest(['full_name', 'headline', case when c_custkey % 2 = 0 then 'candidate_id' end, case when c_custkey % 5 <> 0 then 'emails' end, case when c_custkey % 7 <> 0 then 'phones' end]) as field, 'recruiter_csv' as source from customer
    union all select unnest(['headline', 'years_experience', 'skills', 'experience', 'links']), 'ats_json' from customer
    union all select unnest(['skills', case when c_custkey % 3 = 0 then 'headline' end]), 'resume' from customer
    union all select unnest(['skills', 'links', 'hobby', case when c_custkey % 3 = 0 then 'location' end]), 'recruiter_notes' from customer) where field is not null group by all"""


def typos(spark, sf_dir):
    """E-mails with a likely typo, with an unrelated second one, or alone."""
    k = F.col("c_custkey")
    who = table(spark, sf_dir, "customer").select(k.cast("string").alias("record_id"), k.alias("record_ord"), "c_custkey")
    good = said(who, "recruiter_csv", 0, S.claim("emails", "structured_field", text("user", k, ".name@example.com")))
    other = said(who, "recruiter_notes", 1, S.claim("emails", "labeled_prose", turned(k, [text("user", k, ".name@exmaple.con"), text("aa", k, "@personal.org"), F.lit(None).cast("string")])))
    ev = keyed(normalize_all(good.unionByName(other.where("v_str is not null"))))
    found = R.resolve_multi(R.camps(ev))
    return found.select(
        F.col("cluster_id").cast("long").alias("entity"), F.array_join(F.transform("values", lambda v: v["v_str"]), ",").alias("emails"), "confidence",
        F.array_join(F.transform("provenance", lambda p: p["decision"]), "|").alias("decisions"))


_TYPOS = f"""
with s as (select {_STRENGTHS["said"]} as said), c as (select c_custkey as k, 'user' || c_custkey || '.name@example.com' as good, {turned_sql("c_custkey", ["'user' || c_custkey || '.name@exmaple.con'", "'aa' || c_custkey || '@personal.org'", "null"])} as other, {_ALONE("said")} as conf from customer, s)
select k as entity, case when k % 3 = 1 then other || ',' || good else good end as emails, case when k % 3 = 1 then {round4_sql("((0.0::double + conf + 1.0::double) / 2)")} else 1.0::double end as confidence,
    case when k % 3 = 1 then 'included from recruiter_notes|' else '' end || 'included from recruiter_csv' || case when k % 3 = 0 then '; suppressed likely typo ''' || other || '''' else '' end as decisions from c"""


def link_records(spark, sf_dir):
    """Links of pages, twenty pages' worth to a record, by three sources."""
    k = F.col("page_id")
    url = turned(k, [text("https://www.linkedin.com/in/u", k), text("github.com/u", k), text("https://dribbble.com/u", k), F.col("url")])
    rows = table(spark, sf_dir, "pages").select(F.floor(k / 20).cast("string").alias("record_id"), k.alias("record_ord"), k.cast("int").alias("obs_ord"), url.alias("v_str"), turned(k, ["recruiter_notes", "ats_json", "resume"]).alias("source"))
    ev = keyed(shaped(rows.withColumn("field", F.lit("links")).withColumn("method", F.lit("regex_prose")).withColumn("raw_value", F.col("v_str"))))
    found = R.resolve_links(ev)
    return found.select(
        F.col("cluster_id").cast("long").alias("entity"), "value.linkedin", "value.github", "value.portfolio", F.array_join("value.other", " ").alias("other"), "confidence",
        F.array_join(F.transform("provenance", lambda p: p["decision"]), "|").alias("decisions"))


_LINKS = f"""
with said as (
    select page_id // 20 as entity, page_id, {turned_sql("page_id", ["'https://www.linkedin.com/in/u' || page_id", "'github.com/u' || page_id", "'https://dribbble.com/u' || page_id", "url"])} as u, {turned_sql("page_id", ["'recruiter_notes'", "'ats_json'", "'resume'"])} as source from pages),
scored as (
    select *, {strength_sql("source", "'regex_prose'")} as s, case when lower(u) like '%linkedin.com%' then 'linkedin' when lower(u) like '%github.com%' then 'github'
        when regexp_matches(lower(u), 'portfolio|behance|dribbble') then 'portfolio' else 'other' end as slot from said),
best as (select *, row_number() over (partition by entity, slot order by s desc, page_id) as r, row_number() over (partition by entity, slot, u order by page_id) as again from scored),
kept as (select *, case slot when 'linkedin' then 1 when 'github' then 2 when 'portfolio' then 3 else 4 end as place from best where slot <> 'other' and r = 1 or slot = 'other' and again = 1)
select entity, max(u) filter (slot = 'linkedin') as linkedin, max(u) filter (slot = 'github') as github, max(u) filter (slot = 'portfolio') as portfolio,
    coalesce(string_agg(u, ' ' order by u) filter (slot = 'other'), '') as other, {_MEAN("list(s order by place, u)")} as confidence,
    string_agg(case when slot = 'other' then 'other link' else slot || ' link from ' || source end, '|' order by place, u) as decisions
from kept group by entity"""

CONFIG = {
    "include_confidence": True, "on_missing": "null",
    "fields": [
        {"path": "id", "from": "candidate_id", "type": "string", "required": True},
        {"path": "primary_email", "from": "emails[0]", "type": "string", "required": True},
        {"path": "second_email", "from": "emails[1]", "on_missing": "omit"},
        {"path": "country", "from": "location.country", "type": "string"},
        {"path": "skill_names", "from": "skills[].name", "type": "string[]"},
        {"path": "skill_scores", "from": "skills[].confidence", "type": "string[]"},
        {"path": "years", "from": "years_experience", "type": "string"},
        {"path": "github", "from": "links.github", "type": "string"},
        {"path": "first_job", "from": "experience[0].title", "type": "number"},
        {"path": "place", "from": "location", "type": "object"},
        {"path": "studies", "from": "education", "type": "object[]", "on_missing": "omit"},
        {"path": "nothing", "from": "no.such[3]", "on_missing": "error"},
    ],
}


def projection(spark, sf_dir):
    found = project(canonical_view(merged(spark, sf_dir)), CONFIG)
    at = lambda path: F.get_json_object("profile", path)
    return found.select(
        F.col("cluster_id").cast("long").alias("entity"), at("$.id").alias("id"), at("$.primary_email").alias("primary_email"), F.col("profile").contains('"second_email"').alias("has_second"), at("$.country").alias("country"),
        at("$.skill_names").alias("skill_names"), at("$.years").cast("double").alias("years"), at("$.github").alias("github"), at("$.first_job").alias("first_job"), F.col("profile").contains('"studies"').alias("has_studies"),
        F.col("profile").contains('"nothing": null').alias("nothing_is_null"), at("$._confidence.primary_email").cast("double").alias("email_confidence"), at("$._confidence.skill_names").cast("double").alias("skill_confidence"),
        at("$.overall_confidence").cast("double").alias("overall"), "valid", F.array_join("problems", "; ").alias("problems"),
    )


_PROJECTION = _RECORDS + f"""
select entity, candidate_id as id, nullif(emails, '') as primary_email, false as has_second, country, '["Go","Python"]' as skill_names, years, github, 'Clerk' as first_job, false as has_studies, true as nothing_is_null,
    case when emails <> '' then 1.0::double else 0.0::double end as email_confidence, skills_conf as skill_confidence, {_MEAN('filled')} as overall, false as valid,
    array_to_string(list_filter([case when candidate_id is null then 'required field ''id'' is missing/null' end, case when emails = '' then 'required field ''primary_email'' is missing/null' end,
        'field ''skill_scores'' expected string[], got list', 'field ''years'' expected string, got float', 'field ''first_job'' expected number, got str'], lambda x: x is not null), '; ') as problems
from records"""


def full_view(spark, sf_dir):
    """The default projection with confidence and provenance."""
    found = project(canonical_view(merged(spark, sf_dir)), {"include_confidence": True, "include_provenance": True})
    at = lambda path: F.get_json_object("profile", path)
    keys = F.array_join(F.json_object_keys("profile"), ",")
    return found.select(
        F.col("cluster_id").cast("long").alias("entity"), keys.alias("keys"), at("$.location").alias("location"), at("$.links.linkedin").alias("linkedin"), at("$.links.other").alias("other_links"), at("$.education").alias("education"),
        at("$.skills[1].name").alias("second_skill"), at("$.skills[1].sources").alias("second_sources"), at("$.experience").alias("experience"), at("$.overall_confidence").cast("double").alias("overall"),
        F.size(F.from_json(at("$.provenance"), "array<struct<field:string>>")).alias("n_provenance"), at("$.provenance[0].field").alias("first_field"), "valid",
    )


_FULL = _RECORDS + f"""
select entity, 'candidate_id,full_name,emails,phones,location,links,headline,years_experience,skills,experience,education,overall_confidence,provenance' as keys,
    '{{"city":null,"region":null,"country":' || case when country is null then 'null' else '"US"' end || '}}' as location, null::varchar as linkedin, '["https://example.com/b"]' as other_links, '[]' as education, 'Python' as second_skill,
    '["ats_json","recruiter_notes"]' as second_sources, '[{{"title":"Clerk","company":"E","start":"2019-03","end":"present","summary":null}}]' as experience, {_MEAN('filled')} as overall,
    (8 + (candidate_id is not null)::int + (emails <> '')::int + (phones <> '')::int + (country is not null)::int)::int as n_provenance,
    case when candidate_id is not null then 'candidate_id' else 'full_name' end as first_field, true as valid
from records"""

def validated(spark, sf_dir):
    """The projected records' JSON texts against the same configuration."""
    found = validate(project(canonical_view(merged(spark, sf_dir)), CONFIG).select(F.col("cluster_id").cast("long").alias("entity"), "profile"), CONFIG)
    return found.select("entity", F.array_join("problems", "; ").alias("problems"))


def batch(spark, sf_dir):
    """Two records of each nation, in files of their own: a table of two rows, and notes that share its e-mail for every other nation."""
    k = F.col("n_nationkey")
    csv = text("id,name,email,title,company\n", k, ",", F.col("n_name"), ",n", k, "@x.example,Clerk,Acme\n", k, ',"",other', k, '@x.example,,')
    notes = text("Name: ", F.col("n_name"), " N\nEmail: ", F.when(k % 2 == 0, text("N", k, "@X.example")).otherwise(text("m", k, "@x.example")), "\nLocation: uk")
    kinds = F.explode(F.array(F.struct(F.lit("recruiter_csv").alias("kind"), csv.alias("value")), F.struct(F.lit("recruiter_notes").alias("kind"), notes.alias("value"))))
    nations = table(spark, sf_dir, "nation")
    path = shared_path(spark, "files")
    nations.select("n_nationkey", kinds.alias("x")).select("n_nationkey", "x.*").coalesce(1).write.partitionBy("kind", "n_nationkey").text(path)
    names = [r[0] for r in nations.select("n_nationkey").orderBy("n_nationkey").collect()]
    sources = {f"a{n}": {"recruiter_csv": f"{path}/kind=recruiter_csv/n_nationkey={n}", "fax": "no such source", "ats_json": f"{path}/missing"} for n in names}
    sources |= {f"b{n}": {"recruiter_notes": f"{path}/kind=recruiter_notes/n_nationkey={n}"} for n in names}
    at = lambda path: F.get_json_object("profile", path)
    return run_batch(spark, sources).select(
        F.array_join("cluster", ",").alias("members"), at("$.candidate_id").alias("candidate_id"), at("$.full_name").alias("full_name"), at("$.emails").alias("emails"), at("$.headline").alias("headline"),
        at("$.location.country").alias("country"), "valid")


_BATCH = """
select case when n_nationkey % 2 = 0 then 'a' || n_nationkey || ',b' || n_nationkey else 'a' || n_nationkey end as members, n_nationkey::varchar as candidate_id, n_name as full_name,
    '["n' || n_nationkey || '@x.example","other' || n_nationkey || '@x.example"]' as emails, 'Clerk at Acme' as headline, case when n_nationkey % 2 = 0 then 'GB' end as country, true as valid from nation
union all
select 'b' || n_nationkey, 'gen-' || substr(sha1('email:m' || n_nationkey || '@x.example'), 1, 12), n_name || ' N', '["m' || n_nationkey || '@x.example"]', null, 'GB', true from nation where n_nationkey % 2 = 1"""

QUERIES = {
    "merge": merge, "id_fallback": id_fallback, "live_filter": live_filter, "typo_suppression": typos, "resolve_links": link_records, "projection": projection, "default_projection": full_view, "validate": validated, "run_batch": batch,
}
ORACLES = {
    "merge": _MERGE, "id_fallback": _FALLBACK, "live_filter": _LIVE, "typo_suppression": _TYPOS, "resolve_links": _LINKS, "projection": _PROJECTION, "default_projection": _FULL,
    "validate": f"select entity, problems from ({_PROJECTION})", "run_batch": _BATCH,
}
