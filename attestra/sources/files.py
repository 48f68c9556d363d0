"""Source files to evidence. Every adapter takes rows (record_id, record_ord, text) so that one scan serves any number of files.

A file that can't be read as its kind gives no evidence at all; the others are not touched by it.
"""

from __future__ import annotations

import csv
import io
import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import normalize as N
from attestra.functions.exact import py_trim
from attestra.functions.policy import literal_map
from attestra.operators.evidence import EDUCATION, EXPERIENCE, LOCATION, shaped

log = logging.getLogger("attestra")

#: Patterns of contacts, links, degrees, years and section headers in prose.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)\+?\d[\d\s().\-]{7,}\d"
URL = r"(?iU)(?:https?://)?(?:www\.)?(?:linkedin\.com|github\.com)/[^\s,;|]+"
DEGREE = r"(?iU)\b(B\.?S\.?|B\.?A\.?|M\.?S\.?|M\.?A\.?|Ph\.?D\.?|MBA|B\.?Tech|M\.?Tech)\b"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
HEADER = r"(?iU)^\s*(skills|education|experience|summary)\s*:?\s*$"
SPLIT_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Places that end a company's line.
PLACES = (
    r"(?iU)\s+(?:Remote|Pune|Bengaluru|Bangalore|Hyderabad|Mumbai|Delhi|Chennai|New Delhi|Gurgaon|Noida|India|San Francisco|New York|London|Berlin|"
    r"Singapore|Remote/Hybrid|Hybrid|USA|US|UK)\s*$"
)
#: Months and ranges of them.
_MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATED = rf"(?iU)\b({_MON} \d{{4}} ?(?:-|–|—|to| ) ?(?:Present|Current|\d{{4}}|{_MON} \d{{4}}))\b"
#: Labels of notes and headers of tables, with the fields they stand for.
LABELS = {"email": "emails", "phone": "phones", "cell": "phones", "name": "full_name", "location": "location", "title": "headline"}
CSV_COLUMNS = {"candidate_id": "candidate_id", "id": "candidate_id", "name": "full_name", "full_name": "full_name", "email": "emails", "phone": "phones", "title": "headline"}


def null_str() -> Column:
    return F.lit(None).cast("string")


def read_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(record_id, record_ord, content) of the records' files, in one scan; a path is a file or a folder of one.

    Files that aren't there give no row.
    """
    schema = "record_id string, record_ord long, content binary"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    known = []
    for k, (record, path) in enumerate(paths.items()):
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        if fs.exists(place):
            known.append((record, k, fs.makeQualified(place).toString()))
    if not known:
        return spark.createDataFrame([], schema)
    place = spark.createDataFrame(known, "record_id string, record_ord long, place string")
    found = spark.read.format("binaryFile").load(sorted({x[2] for x in known})).select(
        "content", F.explode(F.array("path", F.regexp_replace("path", r"/[^/]*$", ""))).alias("place")
    )
    return found.join(place, "place").select("record_id", "record_ord", "content")


def read_texts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(record_id, record_ord, text) of whole files by record id; files that aren't there or aren't UTF-8 give no row."""
    text = F.col("content").cast("string")
    return read_files(spark, paths).where(F.is_valid_utf8(text)).select("record_id", "record_ord", text.alias("text"))


def lines_of(text: Column) -> Column:
    """Lines as Python's ``splitlines`` cuts them."""
    parts = F.split(text, SPLIT_LINES)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


CLAIM = f"struct<field:string,method:string,v_str:string,v_num:double,v_loc:{LOCATION},v_exp:{EXPERIENCE},v_edu:{EDUCATION},raw_value:string>"


def claim(field, method: str, v_str=None, raw=None, v_num=None, v_loc=None, v_exp=None, v_edu=None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(field).alias("field"), F.lit(method).alias("method"), as_col(v_str).cast("string").alias("v_str"), as_col(v_num).cast("double").alias("v_num"),
        as_col(v_loc).cast(LOCATION).alias("v_loc"), as_col(v_exp).cast(EXPERIENCE).alias("v_exp"), as_col(v_edu).cast(EDUCATION).alias("v_edu"),
        as_col(v_str if raw is None else raw).cast("string").alias("raw_value"),
    ).cast(CLAIM)


def emit(rows: DataFrame, source: str, *claims: Column, base: Column | None = None) -> DataFrame:
    """Claims of a row, given as arrays in order of emission, as evidence; their order counts from ``base``."""
    all_ = F.filter(F.concat(*[F.coalesce(c, F.array().cast(f"array<{CLAIM}>")) for c in claims]), lambda c: c.isNotNull())
    first = F.lit(0) if base is None else base
    return shaped(rows.select("record_id", "record_ord", first.alias("base"), F.posexplode(all_).alias("at", "c")).select(
        "record_id", "record_ord", F.lit(source).alias("source"), (F.col("base") + F.col("at")).alias("obs_ord"), "c.*"
    ))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\D", ""))


def contacts(text: Column, keep: Callable[[Column], Column] = lambda m: F.lit(True)) -> list[Column]:
    """Free e-mails, phones of ten digits or more that ``keep`` lets through, and links."""
    return [
        F.transform(F.filter(matches(text, EMAIL), keep), lambda m: claim("emails", "regex_prose", m)),
        F.transform(F.filter(matches(text, PHONE), lambda m: (digits(m) >= 10) & keep(m)), lambda m: claim("phones", "regex_prose", m)),
        F.transform(matches(text, URL), lambda m: claim("links", "regex_prose", F.regexp_replace(m, r"[.,;]+$", ""), m)),
    ]


def csv_rows(texts: DataFrame) -> DataFrame:
    """(record_id, record_ord, row, cells) of CSV texts with a header; cells are (name, raw, value) in order of the header.

    Of repeated names the last cell counts, short rows have empty cells, longer rows lose what has no name, a byte order mark
    and blank rows are dropped. A text that can't be parsed gives no row.
    """
    def cells(names: list[str], row: list[str]) -> list[dict]:
        found = dict.fromkeys(names)
        found.update(zip(names, row, strict=False))
        return [{"name": n.strip().lower(), "raw": v, "value": (v or "").strip()} for n, v in found.items()]

    def parse(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("name", pa.string()), ("raw", pa.string()), ("value", pa.string())]))
        for batch in batches:
            out: list[tuple] = []
            for record, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    names, *rows = [r for r in csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline="")) if r] or [[]]
                except csv.Error:
                    continue
                out += [(record, k, n, cells(names, row)) for n, row in enumerate(rows)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], kind)],
                ["record_id", "record_ord", "row", "cells"],
            )

    return texts.select("record_id", "record_ord", "text").mapInArrow(
        parse, "record_id string, record_ord long, row long, cells array<struct<name:string,raw:string,value:string>>"
    )


def structured(rows: DataFrame) -> DataFrame:
    """Rows with ``cells`` as evidence, one claim a filled mapped cell; a title with a company becomes both."""
    cell = lambda n: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("cells", lambda c: c["name"] == n), lambda c: c["value"])), -1), F.lit(""))
    rows = rows.withColumn("__company", F.when(cell("company") != "", cell("company")).otherwise(cell("current_company")))
    fields = literal_map(CSV_COLUMNS)

    def said(c: Column) -> Column:
        field = F.try_element_at(fields, c["name"])
        titled = (field == "headline") & (F.col("__company") != "")
        value = F.when(titled, F.concat(c["value"], F.lit(" at "), F.col("__company"))).otherwise(c["value"])
        return F.when(field.isNotNull() & (c["value"] != ""), claim(field, "structured_field", value, c["raw"]))

    return emit(rows, "recruiter_csv", F.transform("cells", said), base=F.col("row") * 1000)


def recruiter_csv(spark: SparkSession, paths: dict[str, str], by_row: bool = False) -> DataFrame:
    """CSV files in one scan; ``by_row`` makes each row a record of its own, else a file's rows are one record."""
    rows = csv_rows(read_texts(spark, paths))
    if by_row:
        return structured(rows.withColumn("record_id", F.concat("record_id", F.lit("#"), "row")).withColumn("record_ord", F.col("row")))
    return structured(rows)


_JSON = (
    "candidateId string, id string, fullName string, firstName string, lastName string, emailAddress string, email string, phoneNumber string, phone string,"
    " jobTitle string, title string, location string, skills string, workHistory string, experience string, education string, linkedin string, linkedInUrl string,"
    " github string, githubUrl string, portfolio string, yearsExperience string, years_experience string"
)
_FALSY = ["", "0", "0.0", "false", "[]", "{}"]


def truthy(*options: Column) -> Column:
    """The first that isn't null, empty, zero, false or an empty container."""
    return F.coalesce(*[F.when(~o.isin(_FALSY), o) for o in options])


def semi_structured(rows: DataFrame) -> DataFrame:
    """JSON objects with alias keys, one a record."""
    top = rows.where(F.ltrim(F.col("text")).startswith("{") & F.try_parse_json("text").isNotNull())
    top = top.select("record_id", "record_ord", F.from_json("text", _JSON).alias("j"))
    top = top.where(F.coalesce(F.col("j.skills"), F.lit("[]")).rlike(r'^(\[|"|null|$)') | ~F.col("j.skills").rlike(r"^-?\d|^true"))
    j = lambda n: F.col(f"j.{n}")
    name = F.coalesce(truthy(j("fullName")), F.when(truthy(j("firstName"), j("lastName")).isNotNull(), F.concat_ws(" ", truthy(j("firstName")), truthy(j("lastName")))))
    m = "semi_structured"
    one = lambda f, v: F.array(F.when(py_trim(v) != "", claim(f, m, v)))
    loc = F.from_json(j("location"), "city string, state string, region string, country string")
    is_object = F.ltrim(j("location")).startswith("{")
    place = F.when(is_object & ~j("location").isin("{}"), F.struct(loc["city"].alias("city"), truthy(loc["state"], loc["region"]).alias("region"), loc["country"].alias("country"))).when(
        (py_trim(j("location")) != "") & ~is_object & ~F.ltrim(j("location")).startswith("["), F.struct(null_str().alias("city"), null_str().alias("region"), j("location").alias("country")))
    skills = F.when(F.ltrim(j("skills")).startswith("["), F.from_json(j("skills"), "array<string>")).otherwise(F.filter(F.split(j("skills"), ""), lambda c: c != ""))
    objects = lambda text: F.filter(F.from_json(text, "array<string>"), lambda x: F.ltrim(x).startswith("{"))

    def work(x: Column) -> Column:
        o = F.from_json(x, "title string, jobTitle string, company string, employer string, start string, startDate string, end string, endDate string, summary string")
        return claim("experience", m, None, x, v_exp=F.struct(
            truthy(o["title"], o["jobTitle"]).alias("title"), truthy(o["company"], o["employer"]).alias("company"), truthy(o["start"], o["startDate"]).alias("start"),
            truthy(o["end"], o["endDate"]).alias("end"), o["summary"].alias("summary")))

    def study(x: Column) -> Column:
        o = F.from_json(x, "institution string, school string, degree string, field string, major string, endYear string, year string")
        return claim("education", m, None, x, v_edu=F.struct(
            truthy(o["institution"], o["school"]).alias("institution"), o["degree"].alias("degree"), truthy(o["field"], o["major"]).alias("field"),
            truthy(o["endYear"], o["year"]).alias("end_year")))

    links = F.array(*[F.when(truthy(j(n)).isNotNull(), claim("links", m, j(n))) for n in ("linkedin", "linkedInUrl", "github", "githubUrl", "portfolio")])
    return emit(
        top, "ats_json", one("candidate_id", truthy(j("candidateId"), j("id"))), one("full_name", name), one("emails", truthy(j("emailAddress"), j("email"))),
        one("phones", truthy(j("phoneNumber"), j("phone"))), one("headline", truthy(j("jobTitle"), j("title"))),
        F.array(F.when(place.isNotNull(), claim("location", m, None, j("location"), v_loc=place))),
        F.transform(F.filter(skills, lambda s: py_trim(s) != ""), lambda s: claim("skills", m, s)),
        F.transform(objects(truthy(j("workHistory"), j("experience"))), work), F.transform(objects(j("education")), study), links,
        one("years_experience", F.coalesce(truthy(j("yearsExperience")), j("years_experience"))),
    )


def section(lines: Column, name: str) -> Column:
    """Lines below the last header of ``name``, up to the next header."""
    marked = F.transform(lines, lambda x, i: F.struct(F.lower(F.regexp_extract(x, HEADER, 1)).alias("h"), i.alias("i")))
    heads = F.filter(marked, lambda x: x["h"] != "")
    at = F.array_max(F.transform(F.filter(heads, lambda x: x["h"] == name), lambda x: x["i"]))
    end = F.coalesce(F.array_min(F.transform(F.filter(heads, lambda x: x["i"] > at), lambda x: x["i"])), F.size(lines))
    return F.when(at.isNotNull(), F.slice(lines, at + 2, F.greatest(end - at - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def _strip(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, rf"^[{chars}]+|[{chars}]+$", "")


def _first_part(x: Column) -> Column:
    return py_trim(F.substring_index(x, ",", 1))


def skill_tokens(lines: Column) -> Column:
    def token(raw: Column) -> Column:
        s = py_trim(raw)
        s = F.when(s.contains(":"), py_trim(F.regexp_replace(s, r"(?s)^[^:]*:", ""))).otherwise(s)
        return F.struct(_strip(s, "() ").alias("s"), py_trim(raw).alias("raw"))

    tokens = F.transform(F.split(F.array_join(lines, "\n"), r"[,•\n]"), token)
    return F.transform(F.filter(tokens, lambda t: (t["s"] != "") & (F.length(t["s"]) < 40)), lambda t: claim("skills", "labeled_prose", t["s"], t["raw"]))


def _with_previous(lines: Column) -> Column:
    kept = F.filter(F.transform(lines, py_trim), lambda x: x != "")
    return F.zip_with(kept, F.concat(F.array(F.lit("")), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))), lambda a, b: F.struct(a.alias("line"), b.alias("prev")))


def _empty_null(x: Column) -> Column:
    return F.when(x != "", x)


def _section_rows(rows: DataFrame, name: str) -> DataFrame:
    """A row per line of a section, with the line before."""
    return rows.select("record_id", "record_ord", section(F.col("lines"), name).alias("own")).select(
        "record_id", "record_ord", F.posexplode(_with_previous(F.col("own"))).alias("obs_ord", "x")
    ).select("record_id", "record_ord", "obs_ord", "x.line", "x.prev")


def _claims(rows: DataFrame, field: str, column: str, base: int) -> DataFrame:
    return shaped(rows.select(
        "record_id", "record_ord", F.lit("resume").alias("source"), (F.col("obs_ord") + base).alias("obs_ord"), F.lit(field).alias("field"),
        F.lit("labeled_prose").alias("method"), F.col(column), F.col("line").alias("raw_value"),
    ))


def education_rows(rows: DataFrame) -> DataFrame:
    """Lines with a degree: the institution stands on the line before or in the same line."""
    found = _section_rows(rows, "education").withColumn("degree", F.regexp_extract("line", DEGREE, 0)).where("degree <> ''")
    found = found.withColumn("parts", F.filter(F.transform(F.split("line", ","), py_trim), lambda p: p != ""))
    found = found.withColumn("cut", F.split(F.coalesce(F.get("parts", F.lit(0)), F.lit("")), DEGREE, 2))
    bare = F.concat(F.get("cut", F.lit(0)), F.coalesce(F.get("cut", F.lit(1)), F.lit("")))
    above = (F.col("prev") != "") & ~F.col("prev").rlike(r"(?iU)^\s*education\s*:?\s*$") & ~F.col("prev").rlike(DEGREE)
    found = found.withColumn("bare", _strip(bare, " .")).withColumn("above", above)
    noisy = F.when(F.size("parts") >= 2, F.get("parts", F.lit(1))).otherwise(F.col("bare"))
    below = py_trim(F.regexp_replace(_strip(F.split(noisy, "[—–|]")[0], r" .,:\-"), r"(?i)\s*(?:CGPA|GPA|CPI).*$", ""))
    second = _strip(F.regexp_replace(F.get("parts", F.lit(1)), YEAR, ""), " ,")
    return _claims(found.withColumn("v_edu", F.struct(
        F.when(F.col("above"), _first_part(F.col("prev"))).otherwise(F.coalesce(_empty_null(second), F.get("parts", F.lit(2)))).alias("institution"),
        F.col("degree"), _empty_null(F.when(F.col("above"), below).otherwise(F.col("bare"))).alias("field"),
        _empty_null(F.regexp_extract("line", YEAR, 0)).alias("end_year"),
    )), "education", "v_edu", 1_000_000)


def experience_rows(rows: DataFrame) -> DataFrame:
    """``Title, Company (range)``, or a title with a range below the line of the company."""
    bullet = r"^(?:\(cid:|•|-|\*)"
    whole = r"^([^,]+),\s*([^(]+)\(([^)]+)\)"
    found = _section_rows(rows, "experience").where(~F.col("line").rlike(bullet) & (F.length("line") <= 100))
    found = found.withColumn("first", F.col("line").rlike(whole)).withColumn("dates", F.regexp_extract("line", DATED, 1))
    title = _strip(F.split("line", DATED, 2)[0], r" \-|,")
    found = found.withColumn("title", F.when(F.col("first"), py_trim(F.regexp_extract("line", whole, 1))).otherwise(title))
    company = F.when((F.col("prev") != "") & ~F.col("prev").rlike(bullet), py_trim(F.regexp_replace(_first_part(F.col("prev")), PLACES, "")))
    found = found.where("first or (dates <> '' and length(title) between 3 and 49)")
    found = found.withColumn("range", N.date_range(F.when(F.col("first"), F.regexp_extract("line", whole, 3)).otherwise(F.col("dates"))))
    return _claims(found.withColumn("v_exp", F.struct(
        "title", F.when(F.col("first"), py_trim(F.regexp_extract("line", whole, 2))).otherwise(company).alias("company"),
        F.col("range.start").alias("start"), F.col("range.end").alias("end"), null_str().alias("summary"),
    )), "experience", "v_exp", 2_000_000)


def resume(rows: DataFrame) -> DataFrame:
    """Résumé text: free contacts, then the sections, and last the first line if it looks like a name."""
    rows = rows.withColumn("lines", lines_of(F.col("text")))
    free = emit(rows, "resume", *contacts(F.col("text")), skill_tokens(section(F.col("lines"), "skills")))
    first = rows.select("record_id", "record_ord", F.get(F.filter(F.transform("lines", py_trim), lambda x: x != ""), F.lit(0)).alias("line"))
    name = shaped(first.where(~F.col("line").contains("@") & (F.size(F.split("line", r"(?U)\s+")) <= 4)).select(
        "record_id", "record_ord", F.lit("resume").alias("source"), F.lit(3_000_000).alias("obs_ord"), F.lit("full_name").alias("field"),
        F.lit("regex_prose").alias("method"), F.col("line").alias("v_str"), F.col("line").alias("raw_value"),
    ))
    return free.unionByName(education_rows(rows)).unionByName(experience_rows(rows)).unionByName(name)


def notes(rows: DataFrame) -> DataFrame:
    """Free text: lines ``Label: value``, then contacts that stand in no line with a colon, and links."""
    rows = rows.withColumn("lines", lines_of(F.col("text"))).withColumn("labeled", F.filter("lines", lambda x: x.contains(":")))
    rows = rows.withColumn("said", F.array_join("labeled", "\n"))
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])

    def label(x: Column) -> Column:
        field = F.try_element_at(known, F.lower(py_trim(F.substring_index(x, ":", 1))))
        rest = py_trim(F.regexp_replace(x, r"(?s)^[^:]*:", ""))
        place = F.struct(null_str().alias("city"), null_str().alias("region"), rest.alias("country"))
        return F.when(field.isNotNull() & (rest != ""), F.when(field == "location", claim("location", "labeled_prose", None, rest, v_loc=place)).otherwise(claim(field, "labeled_prose", rest)))

    return emit(rows, "recruiter_notes", F.transform("labeled", label), *contacts(F.col("text"), lambda m: ~F.col("said").contains(m)))


def pdf_text(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(record_id, record_ord, text) of PDF files in one scan; a file that can't be read gives no row, the others are not touched."""

    def run(batches):
        import pyarrow as pa

        from attestra.sources.pdf import text_of

        for batch in batches:
            out: list[tuple] = []
            for record, k, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append((record, k, text_of(content)))
                except Exception:  # whatever a broken file makes the parser raise discards this file only
                    log.warning("no text from the PDF of record %s", record)
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["record_id", "record_ord", "text"]
            )

    return read_files(spark, paths).select("record_id", "record_ord", "content").mapInArrow(run, "record_id string, record_ord long, text string")


def _resumes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    pdf = {r: p for r, p in paths.items() if p.lower().endswith(".pdf")}
    text = read_texts(spark, {r: p for r, p in paths.items() if r not in pdf})
    return resume(text.unionByName(pdf_text(spark, pdf)) if pdf else text)


#: Source name -> (spark, {record id: path}) -> evidence. Register more sources here.
ADAPTERS: dict[str, Callable[[SparkSession, dict[str, str]], DataFrame]] = {
    "recruiter_csv": recruiter_csv,
    "ats_json": lambda spark, paths: semi_structured(read_texts(spark, paths)),
    "resume": _resumes,
    "recruiter_notes": lambda spark, paths: notes(read_texts(spark, paths)),
}


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
