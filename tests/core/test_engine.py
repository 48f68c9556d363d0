"""End to end on a fictional person in four sources, with confidences worked out by hand."""

import json

import pytest

import attestra
from attestra import run, run_batch
from attestra.cli import main

CSV = 'candidate_id,name,email,phone,current_company,title\nC-7,Nora Quist,nora.quist@brightmail.example,(312) 555-0147,Brightwell,Staff Engineer\n'
ATS = {
    "candidateId": "A-1", "firstName": "N.", "lastName": "Quist", "emailAddress": "Nora.Quist@brightmail.example", "phoneNumber": "312-555-0147", "jobTitle": "Engineer",
    "location": {"city": "Oakland", "state": "CA", "country": "USA"}, "yearsExperience": 8, "skills": ["js", "Python"], "githubUrl": "https://github.com/nora",
    "workHistory": [{"title": "Engineer", "company": "Brightwell", "startDate": "2021-01", "endDate": "present"}],
    "education": [{"institution": "UC Davis", "degree": "BS", "field": "Math", "endYear": 2016}],
}
RESUME = (
    "Nora B Quist\nnora.quist@brightmail.example | +1 312 555 0147\nlinkedin.com/in/nora\nSkills:\nLanguages: JavaScript, Rust\n"
    "Experience:\nEngineer, Brightwell (Jan 2021 - Present)\nEducation:\nB.S. Math, UC Davis, 2016\n"
)
NOTES = "Spoke 2024-05-11 by phone\nName: Nora Q\nEmail: nora.quist@brightmial.exampel\nLocation: the moon\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    paths = {}
    for name, file, text in (("recruiter_csv", "a.csv", CSV), ("ats_json", "b.json", json.dumps(ATS)), ("resume", "c.txt", RESUME), ("recruiter_notes", "d.txt", NOTES)):
        (d / file).write_text(text, encoding="utf-8")
        paths[name] = str(d / file)
    return paths


def test_gold_profile(spark, files):
    row = run(spark, files, {"include_confidence": True, "include_provenance": True}).first()
    p, meta = json.loads(row["profile"]), json.loads(row["explain"])
    assert p["candidate_id"] == "C-7" and p["full_name"] == "Nora Quist"
    assert meta["full_name"]["confidence"] == 0.5939  # 1 * (1 - .45 * .9024)
    assert p["emails"] == ["nora.quist@brightmail.example"] and p["phones"] == ["+13125550147"]
    assert meta["emails"]["provenance"][0]["decision"].endswith("; suppressed likely typo 'nora.quist@brightmial.exampel'")
    assert p["location"] == {"city": "Oakland", "region": "CA", "country": "US"} and meta["location"]["confidence"] == 0.6325
    assert p["headline"] == "Staff Engineer at Brightwell" and meta["headline"]["confidence"] == 0.6558
    assert meta["links"]["confidence"] == 0.545 and p["links"]["linkedin"] == "linkedin.com/in/nora"
    assert p["years_experience"] == 8.0 and meta["years_experience"]["confidence"] == 0.765
    skills = {s["name"]: s["confidence"] for s in p["skills"]}
    assert skills == {"JavaScript": 0.8719, "Python": 0.765, "Rust": 0.455}
    assert p["education"] == [{"institution": "UC Davis", "degree": "B.S.", "field": "Math", "end_year": "2016"}]
    assert p["experience"] == [{"title": "Engineer", "company": "Brightwell", "start": "2021-01", "end": "present", "summary": None}]
    assert row["valid"]


def test_projection_paths_and_validation(spark, files):
    config = {"include_confidence": True, "on_missing": "omit", "fields": [
        {"path": "name", "from": "full_name", "type": "string", "required": True}, {"path": "mail", "from": "emails[0]", "type": "number"},
        {"path": "skills", "from": "skills[].name", "type": "string[]"}, {"path": "city", "from": "location.city"},
        {"path": "site", "from": "links.portfolio"}, {"path": "none", "from": "emails[9]", "on_missing": "null", "required": True}, {"path": "odd", "from": "skills[]"},
    ]}
    row = run(spark, files, config).first()
    p = json.loads(row["profile"])
    assert list(p) == ["name", "mail", "skills", "city", "none", "_confidence", "overall_confidence"]
    assert p["skills"] == ["JavaScript", "Python", "Rust"] and p["none"] is None and p["city"] == "Oakland"
    assert row["problems"] == ["field 'mail' expected number, got str", "required field 'none' is missing/null"] and not row["valid"]


def test_missing_required_is_an_error(spark, files):
    config = {"fields": [{"path": "x", "from": "links.portfolio", "required": True, "on_missing": "error"}]}
    with pytest.raises(Exception, match="required field 'x' missing"):
        run(spark, files, config).collect()


def test_bad_sources_are_skipped(spark, files, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    row = run(spark, {"ats_json": str(tmp_path / "bad.json"), "recruiter_csv": files["recruiter_csv"], "resume": str(tmp_path / "none.txt"), "fax": "x"}).first()
    assert json.loads(row["profile"])["full_name"] == "Nora Quist"
    empty = json.loads(run(spark, {"ats_json": str(tmp_path / "bad.json")}).first()["profile"])
    assert empty["full_name"] is None and empty["emails"] == []


def test_batch_clusters(spark, files, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"id": "Z", "fullName": "Otto", "email": "otto@example.org"}))
    rows = run_batch(spark, {"r2": {"ats_json": files["ats_json"]}, "r1": {"recruiter_csv": files["recruiter_csv"]}, "r3": {"ats_json": str(tmp_path / "o.json")}}).collect()
    assert [r["cluster"] for r in rows] == [["r1", "r2"], ["r3"]]
    assert json.loads(rows[0]["profile"])["candidate_id"] == "C-7"


def test_same_input_same_output(spark, files):
    rows = [run(spark, files).select("profile", "explain", "internal").first() for _ in range(2)]
    assert rows[0] == rows[1]
    inside = json.loads(rows[0]["internal"])
    assert inside["full_name"]["value"] == "Nora Quist" and inside["skills"]["item_confidences"] and "overall_confidence" in inside


def test_public_names():
    for name in attestra.__all__:
        assert callable(getattr(attestra, name)) or isinstance(getattr(attestra, name), dict)
    with pytest.raises(AttributeError):
        attestra.no_such_name


def test_command_line(spark, files, tmp_path, capsys):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"fields": [{"path": "name", "from": "full_name"}, {"path": "site", "from": "links.portfolio", "required": True}]}))
    out = tmp_path / "o.json"
    assert main(["--recruiter_csv", files["recruiter_csv"], "--config", str(config), "--explain", "--out", str(out)]) == 0
    told = capsys.readouterr()
    assert told.out.strip() == f"wrote {out}" and "[validation] 1 problem(s):" in told.err and "  - required field 'site' is missing/null" in told.err
    made = json.loads(out.read_text())
    assert made["profile"] == {"name": "Nora Quist", "site": None} and made["valid"] is False and "full_name" in made["explain"]
    assert main([]) == 2
