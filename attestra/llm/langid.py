"""Language identification by rank-order n-gram profiles (out-of-place distance).

Texts become lower-case letters with every run of other characters as one separator. A profile is the list
of the most frequent 1- to 3-grams that don't have a separator inside. A document is given the language whose
profile has the least out-of-place distance: the sum over the document's n-grams of the difference in rank, or
the longest distance for an n-gram that the language's profile lacks. Ties go to the language first in order.

Null texts, texts without letters and an empty training set give ``und`` with score 0. Repeated documents
count as often as they occur. Rows without a language are not learned from. An empty table gives an empty one. Texts of any
length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import map_rows, table

PROFILE = 400
#: Characters that are counted together while learning.
LEARN_CHARS = 2_000_000
#: Languages that profiles may be learned for; they and their profiles are broadcast.
MAX_LANGUAGES = 5_000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point + 1 of a letter, else 1, which stands for the separator."""
    if not _LETTER:
        table_ = np.ones(0x110000, np.int64)
        table_[[c for c in range(0x110000) if chr(c).isalpha()]] = 0
        _LETTER.append(np.where(table_ == 0, np.arange(0x110000) + 1, 1))
    return _LETTER[0]


def ngram_codes(text: str | None) -> np.ndarray:
    """A code of each 1- to 3-gram, in no order; 21 bits per character."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[points]
    gap = x == 1
    x = x[~(gap & np.concatenate([[False], gap[:-1]]))]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    pairs = x[:-1] | x[1:] << 21
    triples = (pairs[:-1] | x[2:] << 42)[x[1:-1] != 1]
    return np.concatenate([x[x != 1], pairs, triples])


def ranked(codes: np.ndarray, length: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > 4 * length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        some = counts >= least
        values, counts = values[some], counts[some]
    return values[np.lexsort((values, -counts))[:length]]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of all languages, from the n-gram counts over all given rows.

    Counts are summed per task before the shuffle; what reaches the driver is ``length`` codes per language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        sizes: dict[str, int] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: str) -> None:
            values, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            sizes.pop(lang)
            if lang in totals:
                both = np.concatenate([totals[lang][0], values])
                weights = np.concatenate([totals[lang][1], counts])
                values, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, weights).astype(np.int64)
            totals[lang] = values, counts

        def out(lang: str) -> pa.RecordBatch:
            values, counts = totals.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "code", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = ngram_codes(text)
                waiting.setdefault(lang, []).append(codes)
                sizes[lang] = sizes.get(lang, 0) + len(codes)
                if sizes[lang] > LEARN_CHARS:
                    fold(lang)
                    if len(totals[lang][0]) > LEARN_CHARS:
                        yield out(lang)
        for lang in list(waiting):
            fold(lang)
        for lang in list(totals):
            yield out(lang)

    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    totals = labelled.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = totals.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= length)
    if (n := labelled.select(lang_col).distinct().limit(MAX_LANGUAGES + 1).count()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages ({n})")
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], length: int = PROFILE):
        self.length = length
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranked(ngram_codes(text), self.length)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        rank = self.rank[:, at]
        away = np.where(rank < 0, self.length, np.abs(rank - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (len(own) * self.length)


_CLASSIFIERS: dict = {}


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", length: int = PROFILE) -> DataFrame:
    """Per document the predicted language and a score from 0 to 1; texts stream through without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def per_batch(keys, texts):
        if _CLASSIFIERS.get("of") is not shared.value:
            _CLASSIFIERS.update(of=shared.value, classifier=Classifier(shared.value, length))
        found = [_CLASSIFIERS["classifier"](t) for t in texts]
        return [keys, [f[0] for f in found], [f[1] for f in found]]

    return map_rows(docs.select(id_col, text_col), per_batch, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = learn(docs.where(~F.coalesce(held_out, F.lit(False))).select("text", "lang"))
    return predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def oracle() -> str:
    """N-grams as rows; CRC-32 of an id's digits, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda d: unicode(d)::bigint)), lambda c, b: {step}), 4294967295)"
    return f"""
with texts as (
    select doc_id, lang, {crc} % 4 = 2 as held_out, string_split(regexp_replace(' ' || lower(coalesce(text, '')) || ' ', '[^\\p{{L}}]+', ' ', 'g'), '') as chars from documents),
places as (select doc_id, unnest(list_transform(chars, lambda c: case when c = ' ' then 1 else unicode(c)::bigint + 1 end)) as a, generate_subscripts(chars, 1) as i from texts where len(chars) > 2),
beside as (select doc_id, a, lead(a) over w as b, lead(a, 2) over w as c from places window w as (partition by doc_id order by i)),
grams as (
    select doc_id, a as code from beside where a <> 1
    union all select doc_id, a + b * 2097152 from beside where b is not null
    union all select doc_id, a + b * 2097152 + c * 4398046511104 from beside where c is not null and b <> 1),
counted as (select doc_id, code, count(*) as n from grams group by all),
own as (select doc_id, code, row_number() over (partition by doc_id order by n desc, code) - 1 as r from counted qualify r < {PROFILE}),
learned as (select lang, code, sum(n) as n from counted join texts using (doc_id) where lang is not null and not held_out group by all),
profiles as (select lang, code, row_number() over (partition by lang order by n desc, code) - 1 as r from learned qualify r < {PROFILE}),
langs as (select distinct lang from profiles),
away as (
    select o.doc_id, l.lang, count(*) as m, sum(coalesce(abs(p.r - o.r), {PROFILE}))::bigint as d
    from own o cross join langs l left join profiles p on p.lang = l.lang and p.code = o.code group by all),
best as (select doc_id, lang, 1.0::double - d::double / (m * {PROFILE})::double as score from away qualify row_number() over (partition by doc_id order by d, lang) = 1)
select doc_id, held_out, coalesce(b.lang, 'und') as lang_pred, coalesce(b.score, 0.0::double) as score from texts left join best b using (doc_id)"""
