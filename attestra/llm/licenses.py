"""License scans: canonical digests of entire texts, hash-joined to the digests of known licences.

Canonical form: lower case, copyright lines dropped (unless nothing else is left), equivalent spellings made one, everything
but letters and digits one space. Entire texts are joined by digest, with the usual titles above them or without; and so that notes
on lines of their own are found, every line's digest is looked up too. A line can only match if it has a word of
a known text, so lines without any of those words are passed over; the words follow from the table. The known texts are a
list of at most ``MOST_KNOWN``, so their digests are broadcast; the documents are not shuffled.

Nulls and empty texts match nothing; repeated rows each give their row; a line that occurs twice counts once; of two known
texts with one digest the first by name counts. Texts of any length are read whole, an empty table gives an empty one, and
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.exact import let
from attestra.llm.common import table
from attestra.llm.license_texts import DIGESTS, NOTES, TEXTS, TITLES

#: Fixed values: (from, to) spellings that canonical texts treat alike, as words without punctuation.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("per cent", "percent"), ("whilst", "while"), ("favour", "favor"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("https", "http"),
]
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[{:])|copyright by |\(c\)|©|all rights reserved)[^\n]*$"
MOST_KNOWN = 10_000

KNOWN = [*TEXTS, *[(name, f"{title}\n\n{text}") for name, text in TEXTS for title in TITLES.get(name, [])], *NOTES]


def canonical(text: Column) -> Column:
    def bare(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "  "))

    low = F.lower(text)
    kept = let(bare(F.regexp_replace(low, COPYRIGHT_LINE, " ")), lambda k: F.when(k == "", bare(low)).otherwise(k))
    # Two spaces between words, so that neighbours that are replaced don't share one.
    out = F.concat(F.lit(" "), kept, F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """Digest of the canonical form; null where that is empty."""
    return let(canonical(text), lambda form: F.when(form != "", F.sha2(form.cast("binary"), 256)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """Digest and license, one row per digest."""
    texts = spark.createDataFrame(known, "license string, text string").coalesce(1).select(digest(F.col("text")).alias("digest"), "license")
    if digests:
        texts = texts.unionByName(spark.createDataFrame(digests, "license string, digest string").coalesce(1))
    return texts.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def telling_words(known: list[tuple[str, str]]) -> list[str]:
    """Of each known text its longest word that no spelling changes: a line of that canonical form has the word."""
    changed = {w for pair in SPELLINGS for side in pair for w in side.split()}
    out = set()
    for _, text in known:
        words = [w for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text.lower())) if w not in changed and w.isascii()]
        out.add(max(words, key=lambda w: (len(w), w), default=""))
    return sorted(out)


def scan(
    docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text",
    digests: list[tuple[str, str]] = DIGESTS,
) -> DataFrame:
    """Per document: ``license`` of the entire text (or null) and ``notes``, the licences its lines name, sorted, joined by commas.

    ``known`` lists texts, ``digests`` canonical digests of entire texts; both by licence.
    """
    if len(known) + len(digests) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    table_ = known_digests(docs.sparkSession, known, digests)
    by_digest = F.create_map(*[F.lit(x) for r in table_.collect() for x in (r["digest"], r["license"])]).cast("map<string,string>")
    telling = F.lit("|".join(telling_words(known)))
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.rlike(F.lower(x), telling))
    named = F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, digest(x))), lambda x: x.isNotNull())
    whole = docs.select(
        F.col(id_col).alias("__id"), digest(F.col(text_col)).alias("digest"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notes"),
    )
    return whole.join(F.broadcast(table_), "digest", "left").select(F.col("__id").alias(id_col), "license", "notes", "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    bare = lambda x: f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'))"
    kept, whole = bare(f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g')"), bare(f"lower({text})")
    out = f"' ' || case when {kept} = '' then {whole} else {kept} end || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _sql_digest(text: str) -> str:
    return f"case when {_sql_canonical(text)} <> '' then sha256({_sql_canonical(text)}) end"


def oracle() -> str:
    """Every line is looked up here."""
    quoted = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in KNOWN)
    listed = ", ".join(f"('{name}', '{value}')" for name, value in DIGESTS)
    return f"""
with known as (
    select digest, min(name) as license from (
        select {_sql_digest("t")} as digest, name from (values {quoted}) as v(name, t)
        union all select digest, name from (values {listed}) as d(name, digest)) group by 1),
docs as (select doc_id, text, {_sql_digest("text")} as digest from documents),
lines as (
    select doc_id, {_sql_digest("line")} as digest
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)),
notes as (
    select doc_id, string_agg(distinct license, ',' order by license) as notes
    from lines join known using (digest) group by doc_id)
select d.doc_id, k.license, coalesce(n.notes, '') as notes, d.digest
from docs d left join known k using (digest) left join notes n on n.doc_id = d.doc_id"""
