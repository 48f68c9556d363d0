"""Entity resolution: records that share an e-mail or phone, directly or through others, are one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.components import connected_components
from attestra.sources.shared import materialize


def blocking_keys(evidence: DataFrame) -> DataFrame:
    """Distinct (record_ord, record_id, key) of live normalized e-mails and phones."""
    kind = F.when(F.col("field") == "emails", "email:").when(F.col("field") == "phones", "phone:")
    return evidence.where(~F.col("dropped") & kind.isNotNull() & F.col("v_str").isNotNull()).select(
        "record_ord", "record_id", F.concat(kind, "v_str").alias("key")
    ).distinct()


def star_edges(keys: DataFrame) -> DataFrame:
    """Each record linked to the first one with its key: as many edges as keys, also for a hot key.

    The hubs are written first, so that no aggregate stands in the join's stage and a hot key's records can be split over tasks.
    """
    hub = materialize(keys.groupBy("key").agg(F.min(F.struct("record_ord", "record_id")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "hubs")
    return keys.join(hub, "key").select(
        F.struct("record_ord", "record_id").alias("u"), F.col("hub").alias("v")
    ).where("u <> v").distinct()


def clusters(evidence: DataFrame) -> DataFrame:
    """(record_id, cluster_id) for every record, singletons too; the cluster is named by its first record.

    The evidence is read twice, for its records and for their keys, which are written.
    """
    records = materialize(evidence.groupBy("record_id").agg(F.min("record_ord").alias("record_ord")), "records")
    keys = materialize(blocking_keys(evidence).drop("record_ord").distinct().join(records, "record_id"), "keys")
    found = connected_components(star_edges(keys.select("record_ord", "record_id", "key")))
    return records.select("record_id", F.struct("record_ord", "record_id").alias("node")).join(found, "node", "left").select(
        "record_id", F.coalesce(F.col("component.record_id"), F.col("record_id")).alias("cluster_id"),
        F.coalesce(F.col("component.record_ord"), F.col("node.record_ord")).alias("cluster_ord"),
    )


def listing(members: DataFrame) -> DataFrame:
    """Clusters with their sorted members, in order of first member."""
    return members.groupBy("cluster_id", "cluster_ord").agg(F.sort_array(F.collect_list("record_id")).alias("cluster"))
