"""Sources, normalizers, resolution, clustering and validation on small inputs of their own."""

import zlib

import pytest
from pyspark.sql import functions as F

from attestra.functions import normalize as N
from attestra.functions.exact import similarity
from attestra.operators import resolve as R
from attestra.operators.cluster import clusters
from attestra.operators.components import connected_components
from attestra.operators.evidence import shaped
from attestra.plans.projection import canonical_view, project, validate
from attestra.sources import files as S
from attestra.sources import pdf


def said(spark, *rows):
    """Evidence of one entity from (field, value, source, method)."""
    found = spark.createDataFrame([("0", k, *r, r[1]) for k, r in enumerate(rows)], "record_id string, obs_ord int, field string, v_str string, source string, method string, raw_value string")
    return shaped(found).withColumn("cluster_id", F.lit("0")).withColumn("member", F.lit("0"))


def scalars(spark, make, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


# --- normalizers ------------------------------------------------------------------------------------

def test_phones(spark):
    forms = ["(312) 555-0147", "+1 312-555-0147", "312.555.0147", "+13125550147", "1 312 555 0147 ext. 9", "ring me", "123", "", None, "+44 20 7946 0018", "(112) 555-0147", "+1 999"]
    assert scalars(spark, N.phone, forms) == ["+13125550147"] * 5 + [None] * 4 + ["+442079460018", None, None]


def test_countries(spark):
    assert scalars(spark, N.country, ["USA", "united states", " uk ", "US", "DEU", "Utopia", "", None]) == ["US", "US", "GB", "US", "DE", None, None, None]


def test_skills(spark):
    given = ["JS", "k8s", "react.js", "Rust", "Java", "rust belt", "JavaScrip", "TypeScrip", " ", None, "REST API", "x"]
    assert scalars(spark, N.skill, given) == ["JavaScript", "Kubernetes", "React", "Rust", "Java", "Rust Belt", "JavaScript", "TypeScript", None, None, "REST APIs", "X"]


def test_best_score_wins(spark):
    rows = spark.createDataFrame([("abcd", "abce"), ("", ""), ("a", ""), ("kitten", "sitting")], "a string, b string")
    assert [r[0] for r in rows.select(similarity(F.col("a"), F.col("b"), 0)).collect()] == [75.0, 100.0, 0.0, pytest.approx(800 / 13)]


def test_months_and_ranges(spark):
    assert scalars(spark, N.month, ["Jan 2021", "March 2021", "Present", "garbage", "2021-03", "01/2021", None, ""]) == ["2021-01", "2021-03", "present", None, "2021-03", "2021-01", None, None]
    assert [tuple(r) for r in scalars(spark, N.date_range, ["Feb 2020 - Present", "Jun 2018 – Dec 2020", "May 2019"])] == [("2020-02", "present"), ("2018-06", "2020-12"), ("2019-05", None)]


# --- sources ----------------------------------------------------------------------------------------

def test_csv_variants(spark):
    texts = [
        ("a", 0, "\ufeffID,Full_Name,full_name\n1,x,\"Ann \"\"A\"\" Lee\"\n\n2\n3,y,z,extra\n"), ("b", 1, ""), ("c", 2, None), ("d", 3, "name\n"), ("e", 4, "title,company\nClerk,\n,Acme\n"),
    ]
    rows = S.structured(S.csv_rows(spark.createDataFrame(texts, "record_id string, record_ord long, text string")))
    got = [(r["record_id"], r["obs_ord"], r["field"], r["v_str"]) for r in rows.orderBy("record_id", "obs_ord").collect()]
    assert got == [
        ("a", 0, "candidate_id", "1"), ("a", 1, "full_name", "x"), ("a", 2, "full_name", 'Ann "A" Lee'), ("a", 1000, "candidate_id", "2"),
        ("a", 2000, "candidate_id", "3"), ("a", 2001, "full_name", "y"), ("a", 2002, "full_name", "z"), ("e", 0, "headline", "Clerk"),
    ]


def a_pdf(content: bytes) -> bytes:
    body = zlib.compress(content)
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>",
        b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /ToUnicode 6 0 R >>",
        b"<< >>\nstream\n1 beginbfchar <41> <00C4> endbfchar\nendstream",
    ]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (k + 1, p) for k, p in enumerate(parts)) + b"\n%%EOF"


def test_pdf_files(spark, tmp_path):
    content = rb"BT /F1 12 Tf 1 0 0 1 72 720 Tm (Ada Rowe) Tj 0 -14 Td (ada\(x\)@mail.example | \050312\051 555-0147) Tj 0 -14 Td [(Ski) -20 (lls)] TJ T* (Tools: Python) Tj ET"
    (tmp_path / "ok.pdf").write_bytes(a_pdf(content))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "no.pdf").write_bytes(b"text")
    paths = {"a": f"{tmp_path}/ok.pdf", "b": f"{tmp_path}/bad.pdf", "c": f"{tmp_path}/none.pdf", "d": f"{tmp_path}/no.pdf"}
    rows = [(r["record_id"], r["text"]) for r in S.pdf_text(spark, paths).collect()]
    assert rows == [("a", "\u00c4da Rowe\nada(x)@mail.example | (312) 555-0147\nSkills\nTools: Python")]
    claims = {(r["record_id"], r["field"], r["v_str"]) for r in S.ADAPTERS["resume"](spark, paths).collect()}
    assert ("a", "skills", "Python") in claims and ("a", "full_name", "\u00c4da Rowe") in claims and {c[0] for c in claims} == {"a"}
    with pytest.raises(ValueError, match="encrypted"):
        pdf.plain_text(b"%PDF-1.4\ntrailer << /Encrypt 9 0 R >>")


def test_one_scan_serves_many_files(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k} x.txt").write_text(f"Name: N{k}\n")
    paths = {f"r{k}": f"{tmp_path}/{k} x.txt" for k in range(12)} | {"again": f"{tmp_path}/0 x.txt", "gone": f"{tmp_path}/gone.txt"}
    found = S.read_texts(spark, paths)
    assert {r["record_id"]: r["text"] for r in found.collect()} == {f"r{k}": f"Name: N{k}\n" for k in range(12)} | {"again": "Name: N0\n"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


# --- resolution -------------------------------------------------------------------------------------

def test_higher_trust_wins_and_corroboration_counts(spark):
    one = R.merge(said(spark, ("headline", "Clerk", "recruiter_csv", "structured_field"), ("headline", "Lead", "ats_json", "semi_structured"), ("full_name", "Ann", "resume", "regex_prose"))).first()
    two = R.merge(said(spark, ("full_name", "Ann", "resume", "regex_prose"), ("full_name", " ann", "recruiter_csv", "structured_field"))).first()
    assert one["headline"]["value"] == "Clerk" and one["headline"]["provenance"][0]["conflicted_with"] == ["ats_json"]
    assert two["full_name"]["confidence"] > one["full_name"]["confidence"] and two["full_name"]["provenance"][0]["corroborated_by"] == ["resume"]


def test_weak_single_value_is_null(spark):
    got = R.merge(said(spark, ("headline", "Perhaps a clerk", "recruiter_notes", "inferred"))).first()
    assert got["headline"]["value"] is None and got["headline"]["confidence"] == 0.165 and got["headline"]["provenance"] == [] and got["overall_confidence"] == 0.0


def test_emails(spark):
    typo = R.merge(said(spark, ("emails", "ann.lee@brightmail.example", "recruiter_csv", "structured_field"), ("emails", "ann.lee@brightmial.exampel", "recruiter_notes", "labeled_prose"))).first()
    both = R.merge(said(spark, ("emails", "ann@work.example", "recruiter_csv", "structured_field"), ("emails", "al@home.example", "ats_json", "semi_structured"))).first()
    assert typo["emails"]["value"] == ["ann.lee@brightmail.example"] and both["emails"]["value"] == ["al@home.example", "ann@work.example"]


def test_made_ids(spark):
    by_mail = [R.merge(said(spark, ("emails", "a@b.example", "ats_json", "semi_structured"), ("phones", "+13125550147", "ats_json", "semi_structured"))).first()["candidate_id"] for _ in range(2)]
    by_phone = R.merge(said(spark, ("phones", "+13125550147", "ats_json", "semi_structured"))).first()["candidate_id"]
    none = R.merge(said(spark, ("full_name", "Ann", "ats_json", "semi_structured"))).first()["candidate_id"]
    assert by_mail[0] == by_mail[1] and by_mail[0]["value"].startswith("gen-") and len(by_mail[0]["value"]) == 16
    assert by_phone["value"].startswith("gen-") and by_phone["value"] != by_mail[0]["value"] and none["value"] is None


# --- clustering -------------------------------------------------------------------------------------

def test_components_of_random_graphs(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100), (None, 3), (7, None)] + [(200 + k, 201 + k) for k in range(30)]
    label = {x: x for e in edges for x in e if x is not None}
    for _ in label:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}


def test_hot_key_is_one_cluster(spark):
    rows = [(f"r{k:03}", k, "emails", "all@x.example") for k in range(200)] + [("r000", 0, "phones", "+13125550147"), ("z", 999, "phones", "+13125550147"), ("alone", 1000, "full_name", "x")]
    ev = shaped(spark.createDataFrame(rows, "record_id string, record_ord long, field string, v_str string"))
    got = {r["record_id"]: r["cluster_id"] for r in clusters(ev).collect()}
    assert got == {f"r{k:03}": "r000" for k in range(200)} | {"z": "r000", "alone": "alone"}


# --- output -----------------------------------------------------------------------------------------

def test_overall_confidence_is_written_once(spark):
    view = canonical_view(R.merge(said(spark, ("full_name", "Ann", "recruiter_csv", "structured_field"))))
    config = {"include_confidence": True, "fields": [{"path": "overall_confidence", "type": "number"}, {"path": "full_name"}]}
    row = project(view, config).first()
    assert row["profile"].count('"overall_confidence"') == 1 and row["valid"]


def test_validate_any_json(spark):
    config = {"fields": [
        {"path": "a", "type": "string", "required": True}, {"path": "b", "type": "number"}, {"path": "c", "type": "string[]"}, {"path": "d", "type": "object"}, {"path": "e", "type": "object[]"}, {"path": "f", "type": "boolean"},
        {"path": "x.y", "type": "string"},
    ]}
    texts = ['{"a":"s","b":1,"c":["x"],"d":{},"e":[{}],"f":true,"x.y":"1"}', '{"a":null,"b":"1","c":["x",null],"d":[],"e":[1],"f":0,"x.y":2.5}', '{"b":2.5,"c":[],"e":[]}', "nope"]
    got = [r["problems"] for r in validate(spark.createDataFrame([(t,) for t in texts], "profile string"), config).collect()]
    missing = "required field 'a' is missing/null"
    assert got == [[], [missing, "field 'b' expected number, got str", "field 'c' expected string[], got list", "field 'd' expected object, got list", "field 'e' expected object[], got list",
                        "field 'f' expected boolean, got int", "field 'x.y' expected string, got float"], [missing], [missing]]
