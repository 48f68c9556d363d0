"""Entry points: one entity from several sources, or many records resolved to entities."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.policy import FIELDS
from attestra.operators.cluster import clusters, listing
from attestra.operators.evidence import normalize_all, shaped
from attestra.operators.resolve import merge
from attestra.plans.projection import canonical_view, project
from attestra.sources.files import ADAPTERS
from attestra.sources.shared import materialize

log = logging.getLogger("attestra")


def extract_sources(spark: SparkSession, record_sources: dict[str, dict[str, str]]) -> DataFrame:
    """Normalized evidence of all records' sources; a source name without adapter is skipped with a warning."""
    out = shaped(spark.createDataFrame([], "record_id string"))
    places: dict[str, dict[str, str]] = {}
    for record, sources in record_sources.items():
        for name, path in sources.items():
            places.setdefault(name, {})[record] = path
    ords = {(record, name): k for record, sources in record_sources.items() for k, name in enumerate(sources)}
    record_ord = {record: k for k, record in enumerate(record_sources)}
    for name, paths in places.items():
        if name not in ADAPTERS:
            log.warning("no adapter for source %s", name)
            continue
        out = out.unionByName(ADAPTERS[name](spark, paths))
    if ords:
        known = spark.createDataFrame([(r, n, k, record_ord[r]) for (r, n), k in ords.items()], "record_id string, source string, k int, o long")
        out = shaped(out.drop("source_ord", "record_ord").join(known, ["record_id", "source"]).withColumnsRenamed({"k": "source_ord", "o": "record_ord"}))
    # Read several times below: written once, it is neither parsed again nor folded into every later expression.
    return materialize(normalize_all(out), "evidence")


def shaped_records(merged: DataFrame, config: dict | None) -> DataFrame:
    """(cluster_id, profile, valid, problems, explain, internal) of merged records; ``internal`` is the whole record as JSON.

    The records are written first, so that the merge isn't folded into every expression of the output.
    """
    merged = materialize(merged, "merged")
    inside = merged.select("cluster_id", F.to_json(F.struct(*FIELDS, "overall_confidence"), {"ignoreNullFields": "false"}).alias("internal"))
    return project(canonical_view(merged), config).join(inside, "cluster_id")


def run(spark: SparkSession, sources: dict[str, str], config: dict | None = None) -> DataFrame:
    """All sources are one entity: one row (cluster_id, profile, valid, problems, explain, internal)."""
    evidence = extract_sources(spark, {"0": sources})
    known = spark.createDataFrame([("0",)], "cluster_id string")
    merged = merge(evidence.withColumn("cluster_id", F.lit("0")).withColumn("member", F.lit("0")).unionByName(
        known.select("cluster_id", F.lit("0").alias("member"), F.lit(True).alias("dropped")), allowMissingColumns=True))
    return shaped_records(merged, config)


def run_batch(spark: SparkSession, record_sources: dict[str, dict[str, str]], config: dict | None = None) -> DataFrame:
    """Records resolved to entities: one row a cluster (cluster, profile, valid, problems, explain), in order of first member."""
    records = spark.createDataFrame([(r, k) for k, r in enumerate(record_sources)], "record_id string, record_ord long")
    evidence = extract_sources(spark, record_sources).unionByName(records.withColumn("dropped", F.lit(True)), allowMissingColumns=True)
    return resolve_evidence(evidence, config)


def resolve_evidence(evidence: DataFrame, config: dict | None = None) -> DataFrame:
    """Normalized evidence to projected clusters."""
    members = clusters(evidence)
    merged = merge(materialize(evidence.join(members, "record_id").withColumn("member", F.col("record_id")), "regrouped"))
    return listing(members).join(shaped_records(merged, config), "cluster_id").orderBy("cluster_ord").select("cluster", "profile", "valid", "problems", "explain")
