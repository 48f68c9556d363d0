"""Queries over the driver's tables as evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import normalize as N
from attestra.functions.exact import ROUND4_SQL
from attestra.functions.policy import SOURCE_TRUST, strength, strength_sql
from attestra.operators import resolve as R
from attestra.operators.cluster import blocking_keys, clusters, listing, star_edges
from attestra.operators.evidence import normalize_all, shaped
from attestra.plans.scans import phone_sql
from attestra.sources.files import EMAIL, PHONE, contacts, digits, emit, matches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round4_sql(value: str) -> str:
    return ROUND4_SQL.replace("{v}", value)


def nor_sql(strengths: str) -> str:
    """Noisy-OR of a list of strengths in its order."""
    return round4_sql(f"(1.0::double - list_reduce(list_prepend(1.0::double, list_transform({strengths}, lambda s: 1.0::double - s)), lambda a, b: a * b))")


def customer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers say their segment, orders their priority: conflicting headlines of one entity."""
    said = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("record_id"), F.lit("recruiter_csv").alias("source"), F.lit(0).alias("source_ord"), F.lit(0).alias("obs_ord"),
        F.lit("headline").alias("field"), F.lit("structured_field").alias("method"), F.col("c_mktsegment").alias("v_str"))
    ordered = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("record_id"), F.lit("ats_json").alias("source"), F.lit(1).alias("source_ord"), F.col("o_orderkey").cast("int").alias("obs_ord"),
        F.lit("headline").alias("field"), F.lit("semi_structured").alias("method"), F.col("o_orderpriority").alias("v_str"))
    return shaped(said.unionByName(ordered).withColumn("raw_value", F.col("v_str"))).withColumn("cluster_id", F.col("record_id")).withColumn("member", F.col("record_id"))


def resolve_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.resolve_single(R.camps(customer_evidence(spark, sf_dir)))
    p = F.col("provenance")[0]
    return found.select(
        F.col("cluster_id").cast("long").alias("entity"), F.col("value.v_str").alias("headline"), "confidence", p["source"].alias("source"),
        F.array_join(p["conflicted_with"], ",").alias("conflicted_with"), p["decision"].alias("decision"))


_HEADLINES = f"""
with ev as (
    select c_custkey as entity, 'recruiter_csv' as source, 0 as so, 0 as oo, c_mktsegment as v, {strength_sql("'recruiter_csv'", "'structured_field'")} as s, 1.0::double as trust, 'structured_field' as method from customer
    union all
    select o_custkey, 'ats_json', 1, o_orderkey, o_orderpriority, {strength_sql("'ats_json'", "'semi_structured'")}, 0.9::double, 'semi_structured' from orders),
camps as (
    select entity, lower(trim(v)) as k, list(s order by so, oo) as ss, max(trust) as trust, min(so * 10000000000 + oo) as seen, list(distinct source order by source) as sources,
        arg_min(v, so * 10000000000 + oo) as v, arg_max(source, s) as src, arg_max(method, s) as method from ev group by all),
scored as (select *, {nor_sql("ss")} as nor from camps),
ranked as (select *, row_number() over (partition by entity order by nor desc, trust desc, length(k), seen) as r from scored),
lost as (select entity, flatten(list(ss order by seen)) as ss, list_sort(list_distinct(flatten(list(sources)))) as sources from ranked where r > 1 group by entity),
out as (
    select w.entity, w.v as headline, case when l.ss is null then w.nor else {round4_sql(f"(w.nor * (1.0::double - 0.45::double * {nor_sql('l.ss')}))")} end as confidence, w.src as source,
        array_to_string(coalesce(l.sources, []), ',') as conflicted_with, w.method, l.sources
    from ranked w left join lost l using (entity) where w.r = 1)
"""


def resolve_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in SOURCE_TRUST])
    turn = (F.col("event_id") % 4).cast("int")
    ev = shaped(table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("record_id"), F.get(names, turn).alias("source"), turn.alias("source_ord"), F.col("event_id").cast("int").alias("obs_ord"),
        F.lit("skills").alias("field"), F.lit("regex_prose").alias("method"), F.col("event_type").alias("v_str"), F.col("event_type").alias("raw_value"),
    )).withColumn("cluster_id", F.col("record_id")).withColumn("member", F.col("record_id"))
    found = R.resolve_multi(R.camps(ev))
    return found.select(F.col("cluster_id").cast("long").alias("user_id"), F.col("confidence").alias("field_confidence"), F.posexplode(F.arrays_zip("values", "provenance", "item_confidences")).alias("pos", "x")).select(
        "user_id", "field_confidence", "pos", F.col("x.values.v_str").alias("skill"), F.col("x.item_confidences").alias("confidence"),
        F.col("x.provenance.source").alias("source"), F.array_join("x.provenance.corroborated_by", ",").alias("corroborated_by"))


_SOURCE_SQL = "['" + "', '".join(SOURCE_TRUST) + "'][event_id % 4 + 1]"
_MULTI = f"""
with ev as (select user_id, event_id, event_id % 4 as so, {_SOURCE_SQL} as source, event_type as v from events),
st as (select *, {strength_sql("source", "'regex_prose'")} as s from ev),
camps as (
    select user_id, lower(v) as k, list(s order by so, event_id) as ss, arg_max(source, s) as source, arg_min(v, -s) as skill, list(distinct source order by source) as sources from st group by all),
scored as (select *, {nor_sql("ss")} as confidence, row_number() over (partition by user_id order by k) - 1 as pos from camps),
mean as (select user_id, {round4_sql("(list_reduce(list_prepend(0.0::double, list(confidence order by k)), lambda a, b: a + b) / count(*))")} as field_confidence from scored group by user_id)
select user_id, field_confidence, pos::int as pos, skill, confidence, source, array_to_string(list_filter(sources, lambda x: x <> source), ',') as corroborated_by
from scored join mean using (user_id)"""


def contact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("record_id"), F.col("doc_id").alias("record_ord"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("record_id"), (F.col("page_id") + 1_000_000_000).alias("record_ord"), F.col("html").alias("text"))
    return normalize_all(emit(docs.unionByName(pages), "resume", *contacts(F.col("text"))))


def extract_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(matches(F.col("text"), EMAIL)).alias("pos", "email"))


def extract_phones(spark, sf_dir):
    found = F.filter(matches(F.col("text"), PHONE), lambda m: digits(m) >= 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("pos", "phone"))


def normalize_email(spark, sf_dir):
    return extract_emails(spark, sf_dir).select("doc_id", "pos", N.email(F.col("email")).alias("email"))


def normalize_phone(spark, sf_dir):
    return extract_phones(spark, sf_dir).select("doc_id", "pos", "phone", N.phone(F.col("phone")).alias("e164"))


def normalize_month(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.month(day).alias("month"))


def normalize_country(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", N.country(F.col("n_name"), spark).alias("country"))


def normalize_years(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.years(F.get_json_object("props", "$.k")).alias("years"))


def strengths(spark, sf_dir):
    ev = customer_evidence(spark, sf_dir)
    return ev.groupBy("source", "method").agg(F.count(F.lit(1)).alias("n")).select("source", "method", "n", strength(F.col("source"), F.col("method")).alias("strength"))


def blocking(spark, sf_dir):
    return blocking_keys(contact_evidence(spark, sf_dir)).select("record_id", "key")


def stars(spark, sf_dir):
    return star_edges(blocking_keys(contact_evidence(spark, sf_dir))).select(F.col("u.record_id").alias("record_id"), F.col("v.record_id").alias("hub"))


def entities(spark, sf_dir):
    return clusters(contact_evidence(spark, sf_dir)).select("record_id", "cluster_id")


def cluster_listing(spark, sf_dir):
    """Clusters with their members, numbered in order of the first member."""
    found = listing(clusters(contact_evidence(spark, sf_dir)))
    order = F.transform(F.array_sort(F.transform(F.col("all"), lambda c: F.struct(c["o"].alias("o"), c["m"].alias("m")))), lambda c: c["m"])
    whole = found.agg(F.collect_list(F.struct(F.col("cluster_ord").alias("o"), F.array_join("cluster", ",").alias("m"))).alias("all"))
    return whole.select(F.posexplode(order).alias("place", "members"))


def regroup(spark, sf_dir):
    """E-mails and phones of each cluster's records, put together."""
    evidence = contact_evidence(spark, sf_dir)
    said = evidence.where(F.col("field").isin("emails", "phones"))
    return said.join(clusters(evidence), "record_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("record_id").alias("n_records"))


def links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.link_slot(F.col("url")).alias("slot"))


_PHONES = "list_filter(regexp_extract_all(text, '\\+?\\d[\\d\\s().\\-]{7,}\\d'), lambda m: length(regexp_replace(m, '\\D', '', 'g')) >= 10)"
_EMAILS = f"regexp_extract_all(text, '{EMAIL}')"

_CONTACTS = f"""
with recursive texts as (
    select 'd' || doc_id as record_id, doc_id as ord, text from documents union all select 'p' || page_id, page_id + 1000000000, html from pages),
said as (
    select record_id, ord, {_EMAILS} as emails, {_PHONES} as phones, regexp_matches(text, '(?i)(?:linkedin\\.com|github\\.com)/[^\\s,;|]') as linked from texts),
records as (select record_id, ord from said where len(emails) > 0 or len(phones) > 0 or linked),
numbers as (select record_id, ord, unnest(phones) as m from said),
keys as (
    select distinct record_id, ord, 'email:' || lower(unnest(emails)) as key from said
    union select record_id, ord, 'phone:' || {phone_sql("m")} from numbers where {phone_sql("m")} is not null),
hubs as (select key, min(struct_pack(o := ord, r := record_id)) as hub from keys group by key),
walk as (
    select record_id as a, record_id as b from keys
    union select w.a, k.record_id from walk w join keys x on x.record_id = w.b join keys k on k.key = x.key),
found as (select a as record_id, arg_min(b, ord) as cluster_id, min(ord) as cluster_ord from walk join records on records.record_id = b group by a),
members as (select r.record_id, coalesce(f.cluster_id, r.record_id) as cluster_id, coalesce(f.cluster_ord, r.ord) as cluster_ord from records r left join found f using (record_id))
"""

QUERIES = {
    "resolve_single": resolve_single, "resolve_multi": resolve_multi, "extract_emails": extract_emails, "extract_phones": extract_phones,
    "normalize_email": normalize_email, "normalize_phone": normalize_phone, "normalize_month": normalize_month, "normalize_country": normalize_country,
    "normalize_years": normalize_years, "strength": strengths, "blocking_keys": blocking, "star_edges": stars,
    "clusters": entities, "cluster_listing": cluster_listing, "regroup": regroup, "link_slot": links,
}
ORACLES = {
    "resolve_single": _HEADLINES + """
select entity, case when confidence >= 0.3 then headline end as headline, confidence, source, conflicted_with,
    'chose value from ' || source || ' (' || method || ')' || case when len(coalesce(sources, [])) > 0 then '; outranked ' || array_to_string(sources, ', ') || ' on source/method trust' else '' end as decision
from out""",
    "resolve_multi": _MULTI,
    "extract_emails": f"select doc_id, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as email from (select doc_id, {_EMAILS} as l from documents)",
    "extract_phones": f"select doc_id, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as phone from (select doc_id, {_PHONES} as l from documents)",
    "normalize_phone": f"select doc_id, pos, phone, {phone_sql('phone')} as e164 from (select doc_id, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as phone from (select doc_id, {_PHONES} as l from documents))",
    "blocking_keys": _CONTACTS + "select record_id, key from keys",
    "star_edges": _CONTACTS + "select distinct record_id, hub.r as hub from keys join hubs using (key) where hub.r <> record_id",
    "clusters": _CONTACTS + "select record_id, cluster_id from members",
    "cluster_listing": _CONTACTS + "select string_agg(record_id, ',' order by record_id) as members, (row_number() over (order by cluster_ord) - 1)::int as place from members group by cluster_id, cluster_ord",
    "regroup": _CONTACTS + "select cluster_id, count(*) as n_claims, count(distinct record_id) as n_records from (select record_id, unnest(list_concat(emails, phones)) as x from said) join members using (record_id) group by cluster_id",
    "normalize_country": "select n_nationkey, n_name, null::varchar as country from nation",
    "normalize_email": f"select doc_id, (generate_subscripts(l, 1) - 1)::int as pos, lower(unnest(l)) as email from (select doc_id, {_EMAILS} as l from documents)",
    "normalize_month": "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month from orders",
    "normalize_years": "select event_id, json_extract_string(props, '$.k')::double as years from events",
    "strength": "select 'recruiter_csv' as source, 'structured_field' as method, count(*) as n, 1.0::double as strength from customer union all select 'ats_json', 'semi_structured', count(*), 0.9::double * 0.85::double from orders",
    "link_slot": "select page_id, case when lower(url) like '%linkedin.com%' then 'linkedin' when lower(url) like '%github.com%' then 'github' when regexp_matches(lower(url), 'portfolio|behance|dribbble') then 'portfolio' else 'other' end as slot from pages",
}
