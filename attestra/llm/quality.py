"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus, in DataFrame operations.

Each text is the bag of its words and word pairs, hashed to ``BUCKETS``. Two multinomials with additive
smoothing are counted over all rows: over the documents that the labels trust and over all documents. A
document's score is the mean over its n-grams of ``log(p_target / p_raw)``, both counted without the document's own
fold of ``FOLDS``, so a trusted document is scored like one that has no label. It passes when the score is at least
the cut that best separates labelled good and bad documents of the same table. Before that stand plain limits on
length and repetition.

Nulls and texts without words have zero counts and fail; without trusted documents, or on an empty table, the two
multinomials are alike and every score is 0. Without good or without bad labelled documents that pass the plain
limits there is no cut. Repeated rows count as often as they occur; repeated labels don't. A null id has no label. Texts of any
length are read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import materialize, table

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Parts of the table by hash of the text, so copies are in one; a document is scored by the counts of the others.
FOLDS = 8
#: Scores are told apart in steps of this size when the cut is sought.
STEP = 0.0001
MIN_WORDS = 50
#: Bytes of trusted ids, 64 for each besides its own length, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 128 << 20

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours(values: Column, body) -> Column:
    """``body`` of each element and the next one; ``values`` should be cheap to name twice."""
    first = F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.transform(first, lambda a, i: body(a, F.get(values, i + 1)))


def hashed_ngrams(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of 1, 2, .. ``width`` words, as an array of arrays."""
    def extend(grams: Column, k: int) -> Column:
        """``grams``: arrays of runs of 1 to ``k`` words."""
        if k == width:
            return grams
        last = F.element_at(grams, -1)
        return _let(F.concat(grams, F.array(_neighbours(last, lambda a, b: F.xxhash64(a, b)))), lambda g: extend(g, k + 1))

    return _let(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda g: extend(g, 1))


def repeated_words(windows: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the text, the first one included.

    ``windows`` are the windows' hashes in text order. Where they are not distinct, they are sorted with their
    places, so equal ones are neighbours; the places found, in order, each cover ``width`` words less what the
    next one covers again.
    """
    def covered(pairs: Column) -> Column:
        same = _neighbours(pairs, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
        return _let(places, lambda p: F.aggregate(
            _neighbours(p, lambda a, b: F.least(b - a, F.lit(width))), F.lit(width), lambda total, step: total + step
        ))

    placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.sort_array(placed), covered))


def ngram_buckets(grams: Column, buckets: int) -> Column:
    """Buckets of the hashes of words and word pairs, the first two of ``grams``."""
    return F.transform(
        F.concat(F.element_at(grams, 1), F.element_at(grams, 2)), lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    )


def fold_of(text: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(folds)).cast("int")


def broadcast_ids(ids: DataFrame) -> DataFrame:
    """Rows with ``__id``, hinted to be broadcast where their bytes allow."""
    size = ids.agg(F.sum(64 + F.octet_length(F.col("__id").cast("string")))).first()[0] or 0
    return F.broadcast(ids) if size <= BROADCAST_BYTES else ids


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``__id`` and ``__text`` of ``docs`` joined to ``ids``."""
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return texts.join(broadcast_ids(ids), "__id", how)


def train(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> list[float]:
    """Log ratio by bucket, nothing held out."""
    return train_folds(docs, trusted, id_col, text_col, buckets, 1)


def train_folds(
    docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, folds: int = FOLDS
) -> list[float]:
    """Log ratio by fold and bucket, one fold after the other, each from the counts of the other folds (of all, where
    there is one). All documents are counted; what reaches the driver is one row per fold and bucket.

    ``trusted`` holds the ids of the target documents. They meet the texts before n-grams are made, so at most ids
    and texts are shuffled, and nothing where the ids are few enough to be broadcast.
    """
    target_ids = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().withColumn("__t", F.lit(1))
    # The same buckets as ``ngram_buckets`` gives, but word by word, so that generated code makes them.
    words = with_ids(docs, target_ids, id_col, text_col, "left").select(
        "__t", (fold_of(F.col("__text"), folds) * buckets).alias("f"), words_of(F.col("__text")).alias("w")
    ).select("__t", "f", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p"))
    one = F.xxhash64("p.a")
    pair = F.when(F.col("p.b").isNotNull(), F.pmod(F.xxhash64(one, F.xxhash64("p.b")), F.lit(buckets)))
    counted = (
        words.select("__t", "f", F.explode(F.array(F.pmod(one, F.lit(buckets)), pair)).alias("b")).where("b is not null")
        .groupBy((F.col("f") + F.col("b")).cast("int").alias("b"))
        .agg(F.count(F.lit(1)).alias("raw"), F.count("__t").alias("target"))
    )
    raw, target = [0] * buckets * folds, [0] * buckets * folds
    # One text instead of a row a bucket, which as Python objects would take a hundred times the memory.
    whole = counted.agg(F.array_join(F.collect_list(F.concat_ws(" ", "b", "raw", "target")), "\n").alias("rows")).first()["rows"]
    for line in whole.splitlines():
        b, n, t = map(int, line.split())
        raw[b], target[b] = n, t
    if folds == 1:
        return log_ratios(raw, target)

    def others(counts: list[int], fold: int) -> list[int]:
        own = counts[fold * buckets : (fold + 1) * buckets]
        return [sum(counts[b::buckets]) - n for b, n in enumerate(own)]

    return [x for k in range(folds) for x in log_ratios(others(raw, k), others(target, k))]


def log_ratios(raw: list[int], target: list[int], smoothing: float = SMOOTHING) -> list[float]:
    import math

    if not sum(target):
        return [0.0] * len(raw)
    # The raw share smooths the target, so a bucket that the target lacks by chance isn't held against it.
    total_raw, total_target = sum(raw) + smoothing * len(raw), sum(target)
    out = []
    for r, t in zip(raw, target, strict=True):
        p_raw = (r + smoothing) / total_raw
        p_target = (t + smoothing * len(raw) * p_raw) / (total_target + smoothing * len(raw))
        out.append(round(math.log(p_target / p_raw), 6))
    return out


def mean_ratio(grams: Column, ratios: list[float], at: Column, folds: int) -> Column:
    """Mean of the ratios of all n-grams, those of the fold that begin at ``at``; 0 without any. The ratios are a literal, folded once."""
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    hashes = F.concat(F.element_at(grams, 1), F.element_at(grams, 2))
    places = F.transform(hashes, lambda h: F.pmod(h, F.lit(len(ratios) // folds)).cast("int") + at)
    n = F.size(F.element_at(grams, 1)) + F.size(F.element_at(grams, 2))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(places, F.lit(0.0), lambda total, p: total + F.get(weights, p)) / n)


def measured(docs: DataFrame, own: list[Column], text_col: str, ratios: list[float], folds: int) -> DataFrame:
    """Columns ``own``, counts, ``score`` and ``base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        *own,
        text.alias("__text"),
        words_of(F.col(text_col)).alias("__words"),
        (fold_of(F.col(text_col), folds) * (len(ratios) // folds)).alias("__at"),
    ).withColumn("__grams", hashed_ngrams(F.col("__words"), 3)).select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _let(F.filter(F.split("__text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
             lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(F.element_at("__grams", 3), 3).cast("long").alias("n_repeat_words"),
        mean_ratio(F.col("__grams"), ratios, F.col("__at"), folds).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def best_cut(good: dict[int, int], bad: dict[int, int]) -> float:
    """Cut with the least sum of the shares of good below it and of bad not below it, from documents by step of score;
    of equal cuts the middle of the widest gap, the lowest first. Without good or without bad, minus infinity."""
    n_good, n_bad = sum(good.values()), sum(bad.values())
    if not n_good or not n_bad:
        return float("-inf")
    steps = sorted({*good, *bad})
    # Errors times both numbers, so they are whole; first that of a cut below all.
    wrong = n_bad * n_good
    least, width, cut = wrong, float("inf"), float("-inf")
    for k, step in enumerate(steps):
        wrong += good.get(step, 0) * n_bad - bad.get(step, 0) * n_good
        after = steps[k + 1] if k + 1 < len(steps) else step + 1
        if wrong < least or wrong == least and after - step > width:
            least, width, cut = wrong, after - step, (step + 1 + after) / 2 * STEP
    return cut


def labelled_cut(scored: DataFrame, trusted: DataFrame, distrusted: DataFrame, id_col: str) -> float:
    """``best_cut`` of the labelled ones of ``scored`` (``__id``, ``score``, ``base_failed``) that pass the plain limits; what reaches
    the driver is one row per step of score."""
    ids = [
        x.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().withColumn("__good", F.lit(good))
        for x, good in ((trusted, True), (distrusted, False))
    ]
    steps = scored.where("not base_failed").select("__id", F.floor(F.col("score") / STEP).alias("step"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in steps.join(broadcast_ids(ids[0].unionByName(ids[1])), "__id").groupBy("__good", "step").count().collect():
        counts[r["__good"]][r["step"]] = r["count"]
    return best_cut(counts[True], counts[False])


def quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = BUCKETS, distrusted: DataFrame | None = None, keep_row: bool = False, folds: int = FOLDS,
) -> DataFrame:
    """Per document: counts, ``base_failed``, ``score`` and ``kept``. Two scans, one shuffle of one row per fold, bucket and task;
    ids and texts are shuffled too where trusted ids are too many to broadcast. Scores are written before the cut is sought.

    ``distrusted``: ids of the documents labelled bad; without them no score is cut. ``keep_row``: a struct ``row`` of all
    columns of ``docs``, whatever their names, stands in place of the id.
    """
    ratios = train_folds(docs, trusted, id_col, text_col, buckets, folds)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep_row else F.col(id_col)
    base = measured(docs.select(own, F.col(text_col).alias("__whole")), [F.col("row" if keep_row else f"`{id_col}`")], "__whole", ratios, folds)
    cut = float("-inf")
    if distrusted is not None:
        base = materialize(base, "scored")
        cut = labelled_cut(base.select(F.col(f"row.`{id_col}`" if keep_row else f"`{id_col}`").alias("__id"), "score", "base_failed"), trusted, distrusted, id_col)
    return base.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.col("quality") == 1).select(id_col)


def distrusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.col("quality") == 0).select(id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scored = quality(table(spark, sf_dir, "documents"), trusted_ids(labels), distrusted=distrusted_ids(labels))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
