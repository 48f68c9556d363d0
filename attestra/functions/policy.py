"""Trust and reliability of evidence, and the lookup tables of the normalizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
METHOD_RELIABILITY = {"structured_field": 1.00, "semi_structured": 0.85, "labeled_prose": 0.70, "regex_prose": 0.50, "inferred": 0.30}
SOURCE_TRUST = {"recruiter_csv": 1.00, "ats_json": 0.90, "resume": 0.65, "recruiter_notes": 0.55}
UNKNOWN_TRUST = 0.5
CONFLICT_PENALTY = 0.45
EMIT_FLOOR = 0.30
SIMILAR_PERCENT = 88
FIELDS = [
    "candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education",
]
SINGLE = ["candidate_id", "full_name", "headline", "location", "years_experience"]
MULTI = ["emails", "phones", "skills", "experience", "education"]
SKILLS = {
    "JavaScript": ["js", "javascript", "java script", "ecmascript"],
    "TypeScript": ["ts", "typescript", "type script"],
    "Python": ["python", "py", "python3"],
    "Java": ["java"],
    "React": ["react", "react.js", "reactjs"],
    "Node.js": ["node", "node.js", "nodejs"],
    "PostgreSQL": ["postgres", "postgresql", "psql"],
    "Kubernetes": ["k8s", "kubernetes", "kube"],
    "Docker": ["docker"],
    "AWS": ["aws", "amazon web services"],
    "Go": ["go", "golang"],
    "C++": ["c++", "cpp", "cplusplus"],
    "SQL": ["sql"],
    "Machine Learning": ["ml", "machine learning"],
    "REST APIs": ["rest", "rest api", "rest apis", "restful"],
    "GraphQL": ["graphql", "graph ql"],
}
COUNTRIES = {
    "usa": "US", "u.s.a.": "US", "u.s.": "US", "us": "US", "united states": "US", "united states of america": "US", "america": "US",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "uae": "AE", "south korea": "KR", "north korea": "KP", "russia": "RU", "iran": "IR", "vietnam": "VN", "czechia": "CZ",
    "czech republic": "CZ", "ivory coast": "CI",
}
DEGREES = {
    "BS": "B.S.", "BSC": "B.S.", "BACHELOROFSCIENCE": "B.S.", "BA": "B.A.", "MS": "M.S.", "MSC": "M.S.", "MA": "M.A.", "PHD": "Ph.D.",
    "MBA": "MBA", "BTECH": "B.Tech", "MTECH": "M.Tech",
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def trust(source: Column) -> Column:
    return F.coalesce(lookup(SOURCE_TRUST, source), F.lit(UNKNOWN_TRUST))


def strength(source: Column, method: Column) -> Column:
    return trust(source) * lookup(METHOD_RELIABILITY, method)


def strength_sql(source: str, method: str) -> str:
    t = " ".join(f"when '{k}' then {v}::double" for k, v in SOURCE_TRUST.items())
    m = " ".join(f"when '{k}' then {v}::double" for k, v in METHOD_RELIABILITY.items())
    return f"((case {source} {t} else {UNKNOWN_TRUST}::double end) * (case {method} {m} end))"
