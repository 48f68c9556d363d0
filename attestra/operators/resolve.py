"""Conflict resolution: evidence of a cluster to one record, each field with value, confidence and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.exact import let, noisy_or, ordered_mean4, py_trim, round4, similar
from attestra.functions.policy import CONFLICT_PENALTY, EMIT_FLOOR, FIELDS, MULTI, SIMILAR_PERCENT, SINGLE, strength, trust
from attestra.sources.shared import materialize

ORDER = ["member", "source_ord", "obs_ord"]
PROVENANCE = "struct<source:string,method:string,raw_value:string,corroborated_by:array<string>,conflicted_with:array<string>,decision:string>"
VALUE_COLUMN = {"location": "v_loc", "years_experience": "v_num", "experience": "v_exp", "education": "v_edu"}


def _json_key(x: Column, names: list[str]) -> Column:
    """Sorted keys, spaced separators, as grouping and order of structured values need."""
    parts = []
    for n in sorted(names):
        text = F.regexp_extract(F.to_json(F.struct(x[n].alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)
        parts.append(F.concat(F.lit(f'"{n}": '), F.when(x[n].isNull(), "null").otherwise(text)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def value_key() -> Column:
    """Values of one key are one camp."""
    return F.coalesce(
        F.when(F.col("v_loc").isNotNull(), _json_key(F.col("v_loc"), ["city", "region", "country"])),
        F.when(F.col("v_exp").isNotNull(), _json_key(F.col("v_exp"), ["title", "company", "start", "end", "summary"])),
        F.when(F.col("v_edu").isNotNull(), _json_key(F.col("v_edu"), ["institution", "degree", "field", "end_year"])),
        F.lower(py_trim(F.col("v_str"))), F.col("v_num").cast("string"),
    )


def camps(evidence: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Live evidence by (cluster, field, value): ordered strengths, best and first claim, sources, confidence.

    ``evidence`` has ``cluster`` and ``member`` (order of the record in the cluster).
    """
    claim = F.struct(
        *ORDER, strength(F.col("source"), F.col("method")).alias("strength"), "source", "method", "raw_value",
        "v_str", "v_num", "v_loc", "v_exp", "v_edu",
    )
    rows = evidence.where(~F.col("dropped") & F.col("field").isin(FIELDS)).withColumn("value_key", value_key())
    grouped = rows.groupBy(cluster, "field", "value_key").agg(F.sort_array(F.collect_list(claim)).alias("claims"))
    strengths = F.transform("claims", lambda c: c["strength"])
    best = F.array_min(F.transform("claims", lambda c, i: F.struct((-c["strength"]).alias("s"), i.alias("i"))))
    return grouped.select(
        cluster, "field", "value_key", F.col("claims")[0].alias("first"), F.get("claims", best["i"]).alias("best"), strengths.alias("strengths"),
        noisy_or(strengths).alias("confidence"), F.array_max(F.transform("claims", lambda c: trust(c["source"]))).alias("trust"),
        F.array_sort(F.array_distinct(F.transform("claims", lambda c: c["source"]))).alias("sources"),
        F.transform("claims", lambda c: c["raw_value"]).alias("raws"),
    )


def combine(agree: Column, dissent: Column) -> Column:
    """Noisy-OR of agreeing strengths, lowered by that of dissenting ones."""
    base = noisy_or(agree)
    return F.when(F.size(dissent) == 0, base).otherwise(round4(base * (F.lit(1.0) - F.lit(CONFLICT_PENALTY) * noisy_or(dissent))))


def _others(camp: Column) -> Column:
    return F.array_except(camp["sources"], F.array(camp["best"]["source"]))


def resolve_single(found: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The strongest camp of each single-valued field; ties by trust, then shorter key, then first seen."""
    camp = F.struct("first", "value_key", "best", "strengths", "confidence", "trust", "sources")
    by_field = found.where(F.col("field").isin(SINGLE)).groupBy(cluster, "field").agg(F.sort_array(F.collect_list(camp)).alias("camps"))
    rank = F.array_min(F.transform("camps", lambda c, i: F.struct(
        (-c["confidence"]).alias("a"), (-c["trust"]).alias("b"), F.length(c["value_key"]).alias("c"), i.alias("i"))))
    won = by_field.withColumn("won", F.get("camps", rank["i"])).withColumn(
        "lost", F.filter("camps", lambda c: c["value_key"] != F.col("won.value_key"))
    ).withColumn("confidence", combine(F.col("won.strengths"), F.flatten(F.transform("lost", lambda c: c["strengths"]))))
    agree = _others(F.col("won"))
    against = F.array_sort(F.array_distinct(F.flatten(F.transform("lost", lambda c: c["sources"]))))
    decision = F.concat(
        F.lit("chose value from "), "won.best.source", F.lit(" ("), "won.best.method", F.lit(")"),
        F.when(F.size(agree) > 0, F.concat(F.lit("; corroborated by "), F.array_join(agree, ", "))).otherwise(""),
        F.when(F.size(against) > 0, F.concat(F.lit("; outranked "), F.array_join(against, ", "), F.lit(" on source/method trust"))).otherwise(""),
    )
    kept = F.col("confidence") >= EMIT_FLOOR
    prov = F.struct(
        F.col("won.best.source").alias("source"), F.col("won.best.method").alias("method"), F.col("won.best.raw_value").alias("raw_value"),
        agree.alias("corroborated_by"), against.alias("conflicted_with"), decision.alias("decision"),
    )
    none = F.array().cast(f"array<{PROVENANCE}>")
    return won.select(cluster, "field", F.when(kept, F.col("won.first")).alias("value"), "confidence", F.when(kept, F.array(prov)).otherwise(none).alias("provenance"))


def suppress_typos(items: Column) -> Column:
    """Drop a value that is similar to an earlier kept one of higher confidence; note it with that one."""
    n = F.size(items)
    order = F.transform(
        F.array_sort(F.transform(items, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i")))), lambda x: x["i"]
    )

    def step(state: Column, i: Column) -> Column:
        me = F.get(items, i)
        hit = F.filter(state["kept"], lambda k: (me["confidence"] < F.get(items, k)["confidence"]) & similar(me["value"]["v_str"], F.get(items, k)["value"]["v_str"], SIMILAR_PERCENT))
        gone = F.size(hit) > 0
        return F.struct(
            F.when(gone, state["kept"]).otherwise(F.array_append(state["kept"], i)).alias("kept"),
            F.when(gone, F.array_append(state["typos"], F.struct(F.get(hit, 0).alias("k"), me["value"]["v_str"].alias("v")))).otherwise(state["typos"]).alias("typos"),
        )

    zero = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast("array<struct<k:int,v:string>>").alias("typos"))
    state = F.aggregate(order, zero, step)
    noted = let(state, lambda s: F.transform(F.array_sort(s["kept"]), lambda k: F.get(items, k).withField("decision", F.concat(
        F.get(items, k)["decision"],
        F.array_join(F.transform(F.filter(s["typos"], lambda t: t["k"] == k), lambda t: F.concat(F.lit("; suppressed likely typo '"), t["v"], F.lit("'"))), ""),
    ))))
    return F.when(n < 2, items).otherwise(noted)


def resolve_multi(found: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """All camps of each multi-valued field in order of key, each with its confidence."""
    camp = F.struct("value_key", "best", "confidence", "sources")
    by_field = found.where(F.col("field").isin(MULTI)).groupBy(cluster, "field").agg(F.sort_array(F.collect_list(camp)).alias("camps"))

    def item(c: Column) -> Column:
        others = _others(c)
        return F.struct(
            c["best"].alias("value"), c["confidence"].alias("confidence"), others.alias("others"),
            F.concat(F.lit("included from "), c["best"]["source"], F.when(F.size(others) > 0, F.concat(F.lit("; also in "), F.array_join(others, ", "))).otherwise("")).alias("decision"),
        )

    items = by_field.withColumn("items", F.transform("camps", item)).withColumn(
        "items", F.when(F.col("field") == "emails", suppress_typos(F.col("items"))).otherwise(F.col("items"))
    )
    prov = F.transform("items", lambda x: F.struct(
        x["value"]["source"].alias("source"), x["value"]["method"].alias("method"), x["value"]["raw_value"].alias("raw_value"),
        x["others"].alias("corroborated_by"), F.array().cast("array<string>").alias("conflicted_with"), x["decision"].alias("decision"),
    ))
    confs = F.transform("items", lambda x: x["confidence"])
    return items.select(cluster, "field", F.transform("items", lambda x: x["value"]).alias("values"), ordered_mean4(confs).alias("confidence"), prov.alias("provenance"), confs.alias("item_confidences"))


SLOTS = ["linkedin", "github", "portfolio"]


def link_slot(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("linkedin.com"), "linkedin").when(low.contains("github.com"), "github").when(low.rlike("portfolio|behance|dribbble"), "portfolio").otherwise("other")


def resolve_links(evidence: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One link per known slot by strength, the other links distinct and sorted."""
    rows = evidence.where(~F.col("dropped") & (F.col("field") == "links"))
    claim = F.struct(*ORDER, strength(F.col("source"), F.col("method")).alias("strength"), "source", "method", "raw_value", "v_str", link_slot(F.col("v_str")).alias("slot"))
    got = rows.groupBy(cluster).agg(F.sort_array(F.collect_list(claim)).alias("claims"))

    def best(slot: str) -> Column:
        own = F.filter("claims", lambda c: c["slot"] == slot)
        return let(own, lambda cs: F.get(cs, F.array_min(F.transform(cs, lambda c, i: F.struct((-c["strength"]).alias("s"), i.alias("i"))))["i"]))

    for slot in SLOTS:
        got = got.withColumn(slot, best(slot))
    other = F.filter("claims", lambda c: c["slot"] == "other")
    firsts = F.array_sort(F.transform(F.array_distinct(F.transform(other, lambda c: c["v_str"])), lambda u: F.struct(u.alias("u"))))
    got = got.withColumn("other", F.transform(firsts, lambda x: F.get(F.filter(other, lambda c: c["v_str"] == x["u"]), 0)))
    chosen = F.concat(F.filter(F.array(*SLOTS), lambda c: c.isNotNull()), "other")
    prov = F.transform(chosen, lambda c: F.struct(
        c["source"].alias("source"), c["method"].alias("method"), c["raw_value"].alias("raw_value"), F.array().cast("array<string>").alias("corroborated_by"),
        F.array().cast("array<string>").alias("conflicted_with"),
        F.when(c["slot"] == "other", "other link").otherwise(F.concat(c["slot"], F.lit(" link from "), c["source"])).alias("decision"),
    ))
    value = F.struct(*[F.col(f"{s}.v_str").alias(s) for s in SLOTS], F.transform("other", lambda c: c["v_str"]).alias("other"))
    return got.select(cluster, value.alias("value"), ordered_mean4(F.transform(chosen, lambda c: c["strength"])).alias("confidence"), prov.alias("provenance"))


def merge(evidence: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row per cluster: a struct per field, ``overall_confidence`` and the cluster's ordinal columns.

    Two shuffles: evidence by (cluster, field, value), camps by cluster. The camps are written once and read by two
    branches. Evidence of unknown fields only makes its cluster known.
    """
    found = materialize(camps(evidence, cluster), "camps")
    single, multi, links = resolve_single(found, cluster), resolve_multi(found, cluster), resolve_links(evidence, cluster)
    wide_single = single.groupBy(cluster).agg(*[
        F.max_by(F.struct("value", "confidence", "provenance"), F.when(F.col("field") == n, 1)).alias(n) for n in SINGLE
    ])
    wide_multi = multi.groupBy(cluster).agg(*[
        F.max_by(F.struct("values", "confidence", "provenance", "item_confidences"), F.when(F.col("field") == n, 1)).alias(n) for n in MULTI
    ])
    wide = evidence.select(cluster).distinct().join(wide_single, cluster, "left").join(wide_multi, cluster, "left").join(
        links.select(cluster, F.struct("value", "confidence", "provenance").alias("links")), cluster, "left"
    )
    no_prov, no_conf, zero = F.array().cast(f"array<{PROVENANCE}>"), F.array().cast("array<double>"), F.lit(0.0)
    cols = {}
    for n in SINGLE:
        value = F.col(f"{n}.value.{VALUE_COLUMN.get(n, 'v_str')}")
        cols[n] = F.struct(value.alias("value"), F.coalesce(F.col(f"{n}.confidence"), zero).alias("confidence"), F.coalesce(F.col(f"{n}.provenance"), no_prov).alias("provenance"), no_conf.alias("item_confidences"))
    for n in MULTI:
        part = VALUE_COLUMN.get(n, "v_str")
        values = F.col(f"{n}.values")[part]
        cols[n] = F.struct(F.coalesce(values, F.array()).alias("value"), F.coalesce(F.col(f"{n}.confidence"), zero).alias("confidence"), F.coalesce(F.col(f"{n}.provenance"), no_prov).alias("provenance"), F.coalesce(F.col(f"{n}.item_confidences"), no_conf).alias("item_confidences"))
    empty = F.struct(*[F.lit(None).cast("string").alias(s) for s in SLOTS], F.array().cast("array<string>").alias("other"))
    cols["links"] = F.struct(F.coalesce("links.value", empty).alias("value"), F.coalesce("links.confidence", zero).alias("confidence"), F.coalesce("links.provenance", no_prov).alias("provenance"), no_conf.alias("item_confidences"))
    wide = wide.select(cluster, *[cols[n].alias(n) for n in FIELDS])
    key = F.when(F.size("emails.value") > 0, F.concat(F.lit("email:"), F.get("emails.value", F.lit(0)))).when(
        F.size("phones.value") > 0, F.concat(F.lit("phone:"), F.get("phones.value", F.lit(0))))
    made = F.struct(
        F.concat(F.lit("gen-"), F.substring(F.sha1(key.cast("binary")), 1, 12)).alias("value"), F.lit(0.3).alias("confidence"),
        F.array(F.struct(
            F.lit("derived").alias("source"), F.lit("inferred").alias("method"), key.alias("raw_value"), F.array().cast("array<string>").alias("corroborated_by"),
            F.array().cast("array<string>").alias("conflicted_with"), F.lit("generated from strongest match key (no source id)").alias("decision"),
        )).alias("provenance"), no_conf.alias("item_confidences"),
    )
    wide = wide.withColumn("candidate_id", F.when(F.col("candidate_id.value").isNull() & key.isNotNull(), made).otherwise(F.col("candidate_id")))
    filled = []
    for n in FIELDS:
        v = F.col(f"{n}.value")
        if n in MULTI:
            has = F.size(v) > 0
        elif n == "links":
            has = F.col("links.value.linkedin").isNotNull() | F.col("links.value.github").isNotNull() | F.col("links.value.portfolio").isNotNull() | (F.size("links.value.other") > 0)
        else:
            has = v.isNotNull()
        filled.append(F.when(has, F.col(f"{n}.confidence")))
    return wide.withColumn("overall_confidence", ordered_mean4(F.filter(F.array(*filled), lambda c: c.isNotNull())))
