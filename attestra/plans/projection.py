"""Output shape: a configuration compiled to Columns over the merged record, and the check of what comes out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.policy import FIELDS


def canonical_view(merged: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Plain values of all fields, skills as objects, flat ``provenance`` and ``_meta`` with each field's confidence and provenance."""
    s = F.col("skills")
    skill_rows = F.zip_with(F.arrays_zip(s["value"].alias("name"), s["item_confidences"].alias("confidence")), s["provenance"], lambda v, p: F.struct(
        v["name"].alias("name"), v["confidence"].alias("confidence"),
        F.array_sort(F.array_distinct(F.concat(F.array(p["source"]), p["corroborated_by"]))).alias("sources")))
    flat = F.flatten(F.array(*[
        F.transform(F.col(n)["provenance"], _named(n)) for n in FIELDS
    ]))
    meta = F.struct(*[F.struct(F.col(n)["confidence"].alias("confidence"), F.col(n)["provenance"].alias("provenance")).alias(n) for n in FIELDS])
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("city"), none.alias("region"), none.alias("country"))
    value = {n: F.col(n)["value"] for n in FIELDS} | {"skills": skill_rows, "location": F.coalesce(F.col("location")["value"], empty)}
    order = ["candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education"]
    return merged.select(cluster, *[value[n].alias(n) for n in order], "overall_confidence", flat.alias("provenance"), meta.alias("_meta"))


def _named(field: str):
    return lambda p: F.struct(F.lit(field).alias("field"), p["source"].alias("source"), p["method"].alias("method"))


def _found(value: Column, kind: T.DataType) -> Column:
    return F.coalesce(F.size(value) > 0, F.lit(False)) if isinstance(kind, T.ArrayType) else value.isNotNull()


def resolve_path(schema: T.StructType, path: str) -> tuple[Column | None, T.DataType | None]:
    """The Column a path stands for and its type; (None, None) for a path that never resolves."""
    if "[]" in path:
        head, _, sub = path.partition("[].")
        if not re.fullmatch(r"\w+(\.\w+)*", head) or not sub:
            return None, None
        column, kind = resolve_path(schema, head)
        if not isinstance(kind, T.ArrayType):
            return None, None
        element = kind.elementType
        if not isinstance(element, T.StructType):
            return column, kind
        if sub not in element.names:
            return F.transform(column, lambda x: F.lit(None).cast("string")), T.ArrayType(T.StringType())
        return column[sub], T.ArrayType(element[sub].dataType)
    column, kind = None, schema
    for part in path.split("."):
        m = re.fullmatch(r"(\w+)\[(\d+)\]", part)
        key = m[1] if m else part
        if not isinstance(kind, T.StructType) or key not in kind.names:
            return None, None
        column = F.col(key) if column is None else column[key]
        kind = kind[key].dataType
        if m:
            if not isinstance(kind, T.ArrayType):
                return None, None
            column, kind = F.get(column, F.lit(int(m[2]))), kind.elementType
    return column, kind


def to_json_value(value: Column) -> Column:
    """JSON text of any value, nulls kept."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.when(value.isNull(), "null").otherwise(F.substring(text, 2, 1 << 30).substr(F.lit(1), F.length(text) - 2))


PYTHON_TYPE = {T.StringType: "str", T.DoubleType: "float", T.BooleanType: "bool", T.ArrayType: "list", T.StructType: "dict", T.LongType: "int", T.IntegerType: "int"}


def _type_ok(value: Column, kind: T.DataType, declared: str) -> Column:
    element = kind.elementType if isinstance(kind, T.ArrayType) else None
    no_null = ~F.exists(value, lambda x: x.isNull()) if element is not None else F.lit(True)
    return {
        "string": F.lit(isinstance(kind, T.StringType)), "number": F.lit(isinstance(kind, T.NumericType)), "boolean": F.lit(isinstance(kind, T.BooleanType)),
        "object": F.lit(isinstance(kind, T.StructType)), "string[]": F.lit(isinstance(element, T.StringType)) & no_null,
        "object[]": F.lit(isinstance(element, T.StructType)) & no_null,
    }[declared]


TYPE_NAMES = ("string", "number", "boolean", "string[]", "object", "object[]")


def project(view: DataFrame, config: dict | None = None, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, profile as JSON text, valid, problems). A required field with ``on_missing: error`` that is missing fails the job."""
    config = config or {}
    with_conf, with_prov = config.get("include_confidence", False), config.get("include_provenance", False)
    default = config.get("on_missing", "null")
    specs = config.get("fields")
    parts: list[Column] = []
    problems: list[Column] = []
    if not specs:
        names = [c for c in view.columns if c not in (cluster, "_meta") and (with_conf or c != "overall_confidence") and (with_prov or c != "provenance")]
        parts = [F.concat(F.lit(f'"{n}": '), to_json_value(F.col(n))) for n in names]
    confidences: list[Column] = []
    for spec in specs or []:
        out, source = spec["path"], spec.get("from", spec["path"])
        missing = spec.get("on_missing", default)
        value, kind = resolve_path(view.schema, source)
        if value is None:
            value, kind = F.lit(None).cast("string"), T.StringType()
        found = _found(value, kind)
        shown = F.when(found, to_json_value(value)).otherwise("null")
        if missing == "error" and spec.get("required"):
            shown = F.when(found, shown).otherwise(F.raise_error(F.lit(f"required field '{out}' missing (from '{source}')")).cast("string"))
        kept = found | F.lit(missing != "omit")
        parts.append(F.when(kept, F.concat(F.lit(f'"{out}": '), shown)))
        root = source.split(".")[0].split("[")[0]
        if with_conf and root in FIELDS:
            confidences.append(F.when(kept, F.concat(F.lit(f'"{out}": '), F.col("_meta")[root]["confidence"].cast("string"))))
        if spec.get("required"):
            problems.append(F.when(~found, F.lit(f"required field '{out}' is missing/null")))
        if (declared := spec.get("type")) in TYPE_NAMES:
            got = PYTHON_TYPE.get(type(kind), "str")
            problems.append(F.when(found & ~_type_ok(value, kind, declared), F.lit(f"field '{out}' expected {declared}, got {got}")))
    if specs and with_conf:
        if confidences:
            inner = F.array_join(F.filter(F.array(*confidences), lambda x: x.isNotNull()), ", ")
            parts.append(F.when(inner != "", F.concat(F.lit('"_confidence": {'), inner, F.lit("}"))))
        if all(spec["path"] != "overall_confidence" for spec in specs):
            parts.append(F.concat(F.lit('"overall_confidence": '), F.col("overall_confidence").cast("string")))
    text = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", "), F.lit("}"))
    told = F.filter(F.array(*problems), lambda x: x.isNotNull()) if problems else F.array().cast("array<string>")
    return view.select(cluster, text.alias("profile"), (F.size(told) == 0).alias("valid"), told.alias("problems"), F.to_json("_meta", {"ignoreNullFields": "false"}).alias("explain"))


#: Declared type to the test of a variant's type name.
_DECLARED = {
    "string": lambda t: t == "STRING", "number": lambda t: t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "boolean": lambda t: t == "BOOLEAN", "object": lambda t: t.startswith("OBJECT"),
}


def _sure(test):
    return lambda kind: F.coalesce(test(kind), F.lit(False))


def validate(profiles: DataFrame, config: dict | None = None, column: str = "profile") -> DataFrame:
    """``profiles`` with ``problems`` of the JSON texts in ``column`` against the fields that ``config`` asks for, whoever made them.

    A required field must be there and not null; a field that is there must have its declared type. A text that isn't JSON has no fields.
    """
    whole = F.try_parse_json(column)
    told = []
    for spec in (config or {}).get("fields") or []:
        name = spec["path"]
        value = F.try_variant_get(whole, f'$["{name}"]', "variant")
        kind = F.schema_of_variant(value)
        there = value.isNotNull() & (kind != "VOID")
        if spec.get("required"):
            told.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(f"required field '{name}' is missing/null")))
        declared = spec.get("type")
        if declared in TYPE_NAMES:
            test = _DECLARED[declared.removesuffix("[]")]
            if declared.endswith("[]"):
                items = F.try_variant_get(value, "$", "array<variant>")
                fits = kind.startswith("ARRAY") & F.forall(F.transform(items, F.schema_of_variant), _sure(test))
            else:
                fits = test(kind)
            got = F.when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict").otherwise("float")
            told.append(F.when(there & ~fits, F.concat(F.lit(f"field '{name}' expected {declared}, got "), got)))
    found = F.filter(F.array(*told), lambda x: x.isNotNull()) if told else F.array().cast("array<string>")
    return profiles.withColumn("problems", found)
