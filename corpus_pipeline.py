"""Training-data pipeline: quality rules, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, decontaminate, jaccard, pii, quality
from attestra.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, whole, whatever their columns are named; without a shuffle of rows.

    Null and empty texts fail the rules and go; repeated rows fare alike; a null id has no label; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    verdict = quality.quality(docs, quality.trusted_ids(labels), distrusted=quality.distrusted_ids(labels), keep_row=True)
    return verdict.where("kept").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows of one id are one document and stay together. Null, empty and wordless texts belong to no group and stay, as do rows
    of a null id. Ties cannot occur, as ids differ; an empty table stays empty.
    """
    found = jaccard.join(docs, width=5, percent=80)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark contamination, whole. Null, empty and wordless texts hit nothing and stay; repeated rows fare alike."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and secrets in their texts replaced by their kind; ``n_chars`` follows the text.

    A null text stays null and has null ``n_chars``; an empty text stays empty.
    """
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its id, token ids, their number and the digests of ids and decoded text; a null text is an empty one."""
    return bpe.encode_decode(docs, keep_ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("byte-level bpe", tokenize),
]

#: No stage of hashing, similarity search, automata or token ids can be put in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
