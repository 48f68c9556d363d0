"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark text.

Texts and benchmark items are normalised alike: A-Z to lower case, words of letters, digits and bytes
beyond ASCII, joined by single spaces. An item's windows are all its runs of ``window`` words; a shorter item is one
window. Any run of ``window`` words holds one of the item's disjoint pieces of ``(window + 1) // 2`` words whole, so only these
pieces (and short items, whole) are the automaton's patterns, about one node a character of the benchmark. A text is scanned
once; where a piece occurs, the words beside it are held against the item's, which gives exactly the occurring windows that
have the piece. Occurrences map back to words and to code points.

A benchmark of more than ``BLOCK_BYTES`` is scanned for in blocks, each in tasks of its own with one automaton; what texts hit is
merged by the texts' digests, so repeated ids and repeated texts do no harm.

Nulls and texts without words hit nothing; an item without words makes no window; repeated items and
texts count each for themselves; an empty benchmark contaminates nothing. Very long texts are scanned whole. Other columns,
whatever their names, are not read by ``contamination`` and kept as they are by ``keep_clean``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import SLICE, broadcast_if_small, map_arrow, map_rows, materialize, table

WINDOW = 13
#: Bytes of benchmark text in one automaton, which takes about 70 times as much memory in each Python worker.
BLOCK_BYTES = 4 << 20

_KEEP = bytearray(b" " * 256)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _KEEP[_b] = _b
for _b in range(0x41, 0x5B):
    _KEEP[_b] = _b + 32
_KEEP = bytes(_KEEP)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def build_automaton(items: Iterable[tuple], window: int):
    """Patterns `` w1 .. wn `` with the number of their words and what surrounds them: for each distinct surrounding the words
    before, the words behind, least words of a run and the ids of the items that have it. None without any."""
    step = (window + 1) // 2
    found: dict[str, dict[tuple, dict]] = defaultdict(lambda: defaultdict(dict))
    seen: dict[bytes, bytes] = {}
    for item_id, text in items:
        words = [seen.setdefault(w, w) for w in words_of(text)]
        if not words:
            continue
        if len(words) < window:
            pieces = [(0, len(words), len(words))]
        else:
            pieces = [(k, k + step, window) for k in range(0, len(words) - step + 1, step)]
        for begin, end, least in pieces:
            pattern = (b" " + b" ".join(words[begin:end]) + b" ").decode("latin-1")
            reach = least - (end - begin)
            around = (tuple(words[max(0, begin - reach) : begin]), tuple(words[end : end + reach]), least)
            found[pattern][around][item_id] = None
    if not found:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, arounds in found.items():
        automaton.add_word(pattern, (pattern.count(" ") - 1, [(*around, tuple(ids)) for around, ids in arounds.items()]))
    automaton.make_automaton()
    return automaton


def scan(automaton, words: list[bytes], hit: bytearray, items: set) -> None:
    """Mark the words inside occurrences of windows and add the items that occur."""
    if automaton is None or not words:
        return
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    counted = spaces = 0
    for end, (n, arounds) in automaton.iter(line):
        spaces += line.count(" ", counted, end + 1)
        counted = end + 1
        last = spaces - 1
        first = last - n
        for before, behind, least, ids in arounds:
            low, high = first, last
            for word in reversed(before):
                if not low or words[low - 1] != word:
                    break
                low -= 1
            for word in behind:
                if high == len(words) or words[high] != word:
                    break
                high += 1
            if high - low >= least:
                hit[low:high] = b"\x01" * (high - low)
                items.update(ids)


_AUTOMATA: dict = {}


def _automaton(block: tuple, window: int):
    """The automaton of a block (name, broadcast items), built once a worker; a task has one block, so one automaton is held at a time."""
    name, items = block
    if (name, window) not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name, window] = build_automaton(items.value, window)
    return _AUTOMATA[name, window]


def benchmark_blocks(spark: SparkSession, items: DataFrame, item_col: str, text_col: str) -> list:
    """The items as (name, broadcast list), each of BLOCK_BYTES or so; their number follows the benchmark's size."""
    size = items.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64(F.col(item_col), F.col(text_col)), F.lit(n))
    return [
        (uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in items.where(block == i).select(item_col, text_col).collect()]))
        for i in range(n)
    ]


def _word_runs(hit: bytearray) -> list[dict]:
    """Runs of hit words, end exclusive."""
    runs, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        runs.append({"start": at, "end": end})
        at = hit.find(1, end)
    return runs


def _hits_by_digest(docs: DataFrame, blocks: list, text_col: str, window: int) -> DataFrame:
    """(digest, runs, items) of the texts that hit something, over all blocks; each block has its own scan and tasks."""
    def scanned(block):
        def per_batch(digests, texts):
            automaton = _automaton(block, window)
            out = []
            for key, text in zip(digests, texts, strict=True):
                words, items = words_of(text), set()
                hit = bytearray(len(words))
                scan(automaton, words, hit, items)
                if items:
                    out.append((key, _word_runs(hit), sorted(map(str, items))))
            return [list(column) for column in zip(*out, strict=True)] or [[], [], []]

        texts = docs.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col).cast("binary"), 256), F.col(text_col))
        return map_rows(texts, per_batch, "__digest string, runs array<struct<start:long,end:long>>, items array<string>")

    found = scanned(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(scanned(block))
    return found.groupBy("__digest").agg(
        F.flatten(F.collect_set("runs")).alias("__runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items")
    )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per document: words, words hit, items that occur (ids as sorted text) and the hit runs in code points.

    The benchmark's size is measured. In one block, the usual case, the documents stream through without a shuffle; in several,
    what was hit is shuffled and joined to the documents.
    """
    blocks = benchmark_blocks(docs.sparkSession, items, item_col, item_text_col)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, hit_spans array<struct<start:long,end:long>>"

    def finished(keys, texts, hits, names):
        return [
            keys, [len(h) for h in hits], [sum(h) for h in hits], names,
            [_runs(t, h) if any(h) else [] for t, h in zip(texts, hits, strict=True)],
        ]

    if len(blocks) == 1:
        def per_batch(keys, texts):
            automaton = _automaton(blocks[0], window)
            hits, names = [], []
            for text in texts:
                words, found = words_of(text), set()
                hits.append(bytearray(len(words)))
                scan(automaton, words, hits[-1], found)
                names.append(sorted(map(str, found)))
            return finished(keys, texts, hits, names)

        return map_rows(docs.select(id_col, text_col), per_batch, schema)

    def merged(keys, texts, runs, names):
        hits = []
        for text, some in zip(texts, runs, strict=True):
            hits.append(bytearray(len(words_of(text))))
            for r in some or []:
                hits[-1][r["start"] : r["end"]] = b"\x01" * (r["end"] - r["start"])
        return finished(keys, texts, hits, [sorted(n or []) for n in names])

    found = broadcast_if_small(materialize(_hits_by_digest(docs, blocks, text_col, window), "hits"), "__runs")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.sha2(F.col(text_col).cast("binary"), 256).alias("__digest"))
    return map_rows(rows.join(found, "__digest", "left").select("__id", "__text", "__runs", "__items"), merged, schema)


def keep_clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The rows of ``docs``, whole, that the rule doesn't call contaminated; null texts are kept. In one block each batch is
    scanned and filtered in place; in several, contaminated texts are found first and anti-joined by digest."""
    blocks = benchmark_blocks(docs.sparkSession, items, item_col, item_text_col)
    if len(blocks) > 1:
        digest_ = F.sha2(F.col(text_col).cast("binary"), 256)
        texts = docs.select(digest_.alias("__digest"), F.col(text_col).alias("__text")).dropDuplicates(["__digest"])
        dirty = materialize(contamination(texts, items, "__digest", "__text", item_col, item_text_col, window).where(contaminated()).select("__digest"), "dirty")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest_.alias("__digest"))
        return rows.join(broadcast_if_small(dirty, "__digest"), "__digest", "left_anti").select("row.*")
    place = docs.columns.index(text_col)

    def run(batches):
        automaton = _automaton(blocks[0], window)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            clean = []
            for text in batch.column(place).to_pylist():
                words = words_of(text)
                hit = bytearray(len(words))
                scan(automaton, words, hit, set())
                clean.append(not (any(hit) and 20 * sum(hit) >= len(hit)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def _runs(text: str, hit: bytearray) -> list[dict]:
    runs: list[dict] = []
    for k, m in enumerate(_WORD.finditer(text)):
        if hit[k]:
            if k and hit[k - 1]:
                runs[-1]["end"] = m.end()
            else:
                runs.append({"start": m.start(), "end": m.end()})
    return runs


def contaminated(n_words="n_words", n_hit="n_hit"):
    """The rule: at least one hit word and at least a twentieth of the words hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def oracle() -> str:
    """Every run of words of a text against every window, by equality of text."""
    words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
with items as (select item_id, {words("text")} as w from benchmark),
windows as (
    select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s
    from (select item_id, w, least(len(w), {WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from items where len(w) > 0)),
texts as (select doc_id, {words("text")} as w from documents),
runs as (
    select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, (select distinct n from windows) where len(w) >= n)),
hits as (select distinct doc_id, i, n, item_id from runs join windows using (n, s)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct doc_id, item_id::varchar as name from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from texts left join covered using (doc_id) left join named using (doc_id)"""
