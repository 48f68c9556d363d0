"""Evidence rows: one claim about one field of one record, by one source and method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import normalize as N
from attestra.functions.exact import py_trim

LOCATION = "struct<city:string,region:string,country:string>"
EXPERIENCE = "struct<title:string,company:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:string>"
TYPES = {
    "record_id": "string", "record_ord": "bigint", "source": "string", "source_ord": "int", "obs_ord": "int", "field": "string", "method": "string",
    "v_str": "string", "v_num": "double", "v_loc": LOCATION, "v_exp": EXPERIENCE, "v_edu": EDUCATION, "raw_value": "string",
    "dropped": "boolean", "note": "string",
}


def shaped(df: DataFrame) -> DataFrame:
    """``df`` with every evidence column, typed; absent ones null, not dropped."""
    have = set(df.columns)
    fill = {"dropped": F.lit(False), "record_ord": F.lit(0), "source_ord": F.lit(0), "obs_ord": F.lit(0)}
    return df.select(*[(F.col(c) if c in have else fill.get(c, F.lit(None))).cast(t).alias(c) for c, t in TYPES.items()])


def normalize_all(evidence: DataFrame) -> DataFrame:
    """One projection: values normalized by field; what can't be understood stays as a dropped row with a note."""
    field, text = F.col("field"), F.coalesce(F.col("v_str"), F.col("v_num").cast("string"))
    rules: dict[str, tuple[Column, str]] = {
        "phones": (N.phone(text), "unparseable phone"), "skills": (N.skill(text), "empty skill"), "emails": (N.email(text), "malformed email"),
    }
    value, note = F.when(F.lit(False), text), F.when(F.lit(False), F.lit(""))
    for name, (normal, why) in rules.items():
        value = value.when(field == name, F.coalesce(normal, text))
        note = note.when((field == name) & normal.isNull(), why)
    years = F.coalesce(F.col("v_num"), N.years(F.col("v_str")))
    note = note.when((field == "years_experience") & years.isNull(), "non-numeric years")
    loc = F.coalesce(F.col("v_loc"), F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("region"), F.col("v_str").alias("country")))
    return evidence.select(
        *[F.col(c) for c in TYPES if c not in ("v_str", "v_num", "v_loc", "v_exp", "v_edu", "dropped", "note")],
        F.when(field.isin("location", "years_experience"), F.lit(None)).otherwise(value.otherwise(py_trim(F.col("v_str")))).alias("v_str"),
        F.when(field == "years_experience", years).otherwise(F.col("v_num")).alias("v_num"),
        F.when(field == "location", N.location(loc)).alias("v_loc"),
        F.when((field == "experience") & F.col("v_exp").isNotNull(), N.experience(F.col("v_exp"))).alias("v_exp"),
        F.when((field == "education") & F.col("v_edu").isNotNull(), N.education(F.col("v_edu"))).alias("v_edu"),
        (F.col("dropped") | note.isNotNull()).alias("dropped"), F.coalesce("note", note).alias("note"),
    ).select(*TYPES)


def live(evidence: DataFrame) -> DataFrame:
    return evidence.where(~F.col("dropped"))
