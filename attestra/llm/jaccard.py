"""Exact n-gram Jaccard join by signature trees over the buckets of a prefix filter.

Each text is its set of word shingles, hashed to 64 bits. Texts of one set are one representative, known by the
set's digest. Two sets of similarity ``percent`` or more share a member among the first
``n - ceil(percent n / 100) + 1`` of either in any common order, so representatives are bucketed by those members;
shingles that a sample finds frequent come last in the order, which only affects the size of buckets. Of buckets with
the same members one is kept.

In a bucket the representatives stand in signature trees, one for each width of bitmap; a bitmap has 4 to 8 bits a member,
so it stays sparse. A node holds the OR and the AND of its members' bitmaps and their range of sizes. A dual
traversal goes down only pairs of nodes whose largest possible overlap reaches what their least sizes need. What
is left is checked exactly on the whole sets.

Links are sought in rounds, so that a group of near copies doesn't emit its pairs:

1. in buckets of up to ``SMALL`` all pairs that the bounds leave; in larger ones, cut into blocks of about ``BLOCK`` by hash,
   only pairs that join two groups of their block (a forest, fewer pairs than members);
2. where there are several blocks, the same between one delegate of each component in the bucket, until it adds nothing;
3. in buckets that gave pairs and still hold several components, the members with a pair between different ones that the
   bounds leave, in the first bucket that both ends have; their whole sets follow them there, and the links that join
   components are emitted (a forest again). Large components have blocks of their own, which never meet each other.

So no link between components is lost, and no round emits more rows than it has members of buckets: pairs that barely miss
the similarity are told in their bucket.

Nulls, empty texts and texts without words have no shingles and link with nothing; their component is their id. Shorter texts
than a shingle are one shingle. Rows of one id are one document, so all texts of an id are in one component; repeated rows
each give their row. A null id links with nothing and has a null component. Other columns are not read. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from attestra.llm.common import SLICE, broadcast_if_small, discard, map_arrow, materialize, table
from attestra.llm.shingles import shingle_sets
from attestra.operators.components import connected_components

WIDTH = 3
PERCENT = 90
#: The share of documents that are searched for frequent shingles is one in SAMPLE; in how many of them a frequent one is,
#: and how many, the most frequent, are told apart. All three only affect the size of buckets.
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 2, 1 << 22
#: Bits of a bitmap: the power of two from 4 times the members on, within these.
BITS_LOW, BITS_HIGH = 64, 1 << 13
LEAF = 32
#: Buckets up to SMALL give all their pairs at once; above BLOCK they are cut.
SMALL, BLOCK = 8, 2000
#: Keys of a member's first buckets that tell whether a pair has met before; a pair with none in common meets more than once.
FIRST_KEYS = 16
#: Rounds between delegates at most; what they leave is found by the last round.
DELEGATE_ROUNDS = 4
#: Texts hashed together.
STEP_CHARS = 1_000_000


def needed(size: np.ndarray | int, percent: int):
    """Members of the prefix of a set of ``size``."""
    return size - -(-percent * size // 100) + 1


def least_overlap(a, b, percent: int):
    """Members that sets of sizes ``a`` and ``b`` must share."""
    return -(-percent * (a + b) // (100 + percent))


def sets_in_steps(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < STEP_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield from shingle_sets(texts[at:end], width)
        at = end


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def bitmap(members: np.ndarray) -> bytes:
    width = min(max(BITS_LOW, 1 << (4 * len(members) - 1).bit_length()), BITS_HIGH)
    bits = np.zeros(width, np.uint8)
    bits[((members >> np.uint64(17)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps in the last axis, made ``words`` wide by OR of their halves."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def digest_of(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least FREQUENT documents of a sample by hash of the id, and in how many they are; MOST_FREQUENT at most."""
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SAMPLE)) == 0).select(text_col)

    def members(batches):
        for batch in sliced(batches):
            sets = list(sets_in_steps(batch.column(0).to_pylist(), width))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["s"])

    counted = map_arrow(some, members, "s long").groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("c")).where(F.col("c") >= FREQUENT)
    rows = counted.orderBy(F.desc("c"), "s").limit(MOST_FREQUENT).toArrow()
    found = rows["s"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], rows["c"].to_numpy()[order]


def prefix_of(members: np.ndarray, take: int, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first ``take`` members: by hash, those that the sample finds frequent last, the most frequent at the end."""
    if not len(common):
        return members[:take]
    at = np.minimum(np.searchsorted(common, members), len(common) - 1)
    rare = common[at] != members
    first = members[rare][:take]
    if len(first) < take:
        others, often = members[~rare], seen[at[~rare]]
        first = np.concatenate([first, others[np.lexsort((others, often))[: take - len(first)]]])
    return first


def describe(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Per row: id, size of its set, digest of the set, prefix and bitmap; written to the shared folder."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, id_col, text_col, width))

    def run(batches):
        common, seen = frequent.value
        for batch in sliced(batches):
            sizes, digests, prefixes, maps = [], [], [], []
            for members in sets_in_steps(batch.column(1).to_pylist(), width):
                n = len(members)
                sizes.append(n)
                digests.append(digest_of(members) if n else None)
                prefixes.append(prefix_of(members, int(needed(n, percent)), common, seen).view(np.int64) if n else None)
                maps.append(bitmap(members) if n else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary()),
                ],
                ["id", "n", "digest", "prefix", "bits"],
            )

    schema = StructType([
        StructField("id", docs.schema[id_col].dataType), StructField("n", LongType()), StructField("digest", BinaryType()),
        StructField("prefix", ArrayType(LongType())), StructField("bits", BinaryType()),
    ])
    return materialize(map_arrow(docs.select(id_col, text_col), run, schema), "sets")


class Members:
    """Members of a bucket in order of size, their bitmaps in one array for each width."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes]):
        self.sizes = sizes
        words = np.array([len(b) // 8 for b in bits])
        self.words, self.row, self.maps = words, np.zeros(len(bits), np.int64), {}
        for w in np.unique(words).tolist():
            places = np.flatnonzero(words == w)
            self.row[places] = np.arange(len(places))
            self.maps[w] = np.frombuffer(b"".join([bits[k] for k in places]), np.uint64).reshape(-1, w)

    def reach(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the bitmaps of places ``i`` and ``j``, pair by pair, let the sets overlap enough."""
        good = np.zeros(len(i), bool)
        kinds = self.words[i] << 32 | self.words[j]
        for kind in np.unique(kinds).tolist():
            v, w = kind >> 32, kind & 0xFFFFFFFF
            pairs = np.flatnonzero(kinds == kind)
            for part in np.array_split(pairs, len(pairs) * min(v, w) // 4_000_000 + 1):
                p, q = i[part], j[part]
                x, y = folded(self.maps[v][self.row[p]], min(v, w)), folded(self.maps[w][self.row[q]], min(v, w))
                sx, sy = self.sizes[p], self.sizes[q]
                most = np.minimum(sx - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), sy - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
                good[part] = most >= least_overlap(sx, sy, percent)
        return good


class Node:
    __slots__ = ("places", "low", "high", "any", "all", "children")

    def __init__(self, places: np.ndarray, sizes: np.ndarray, bits: np.ndarray | None, children: tuple[Node, ...] = ()):
        self.places, self.children = places, children
        self.low, self.high = int(sizes[places[0]]), int(sizes[places[-1]])
        if children:
            self.any = np.bitwise_or.reduce([c.any for c in children])
            self.all = np.bitwise_and.reduce([c.all for c in children])
        else:
            self.any, self.all = np.bitwise_or.reduce(bits, 0), np.bitwise_and.reduce(bits, 0)


def signature_trees(members: Members) -> list[Node]:
    """One tree for each width of bitmap over the members of that width, which are in order of size."""
    trees = []
    for words, maps in members.maps.items():
        places = np.flatnonzero(members.words == words)
        level = [Node(places[k : k + LEAF], members.sizes, maps[k : k + LEAF]) for k in range(0, len(places), LEAF)]
        while len(level) > 1:
            level = [
                Node(np.concatenate([n.places for n in level[k : k + 4]]), members.sizes, None, tuple(level[k : k + 4]))
                for k in range(0, len(level), 4)
            ]
        trees += level
    return trees


def possible(a: Node, b: Node, percent: int) -> bool:
    """Whether members of the two nodes can overlap enough: a member has at most its size less the bits it has alone."""
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    words = min(len(a.any), len(b.any))
    any_a, all_a, any_b, all_b = (folded(x, words) for x in (a.any, a.all, b.any, b.all))
    most = min(a.high - int(np.bitwise_count(all_a & ~any_b).sum()), b.high - int(np.bitwise_count(all_b & ~any_a).sum()))
    return most >= least_overlap(a.low, b.low, percent)


def dual_traversal(members: Members, labels: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that the bounds leave, of different ``labels``, leaf pair by leaf pair. The caller may join labels meanwhile."""
    trees = signature_trees(members)
    stack = [(a, b) for k, a in enumerate(trees) for b in trees[k:]]
    while stack:
        a, b = stack.pop()
        of_a, of_b = labels[a.places], labels[b.places]
        if (of_a == of_a[0]).all() and (of_b == of_a[0]).all() or not possible(a, b, percent):
            continue
        if not a.children and not b.children:
            good = of_a[:, None] != of_b[None, :]
            if a is b:
                good &= np.triu(np.ones(good.shape, bool), 1)
            i, j = np.nonzero(good)
            i, j = a.places[i], b.places[j]
            sizes = members.sizes
            near = (100 * sizes[i] >= percent * sizes[j]) & (100 * sizes[j] >= percent * sizes[i])
            i, j = i[near], j[near]
            reach = members.reach(i, j, percent)
            yield i[reach], j[reach]
        elif a is b:
            stack += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
        elif len(a.children) >= len(b.children):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, y) for y in b.children]


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two whole sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def pairs_across(sizes, bits, labels, percent: int, sides) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``dual_traversal`` of one bucket; where ``sides`` differ, only pairs across."""
    across = (sides != sides[0]).any()
    for i, j in dual_traversal(Members(sizes, bits), labels, percent):
        yield (i[sides[i] != sides[j]], j[sides[i] != sides[j]]) if across else (i, j)


def bucket_forest(sizes, bits, labels, percent: int, sides, whole: Callable[[int], np.ndarray] | None = None) -> tuple[list[int], list[int]]:
    """Pairs of places in one bucket that join groups; ``whole`` gives the set of a place, then only those that link."""
    first: list[int] = []
    second: list[int] = []
    labels = np.unique(labels, return_inverse=True)[1]
    for i, j in pairs_across(sizes, bits, labels, percent, sides):
        while len(i):
            if whole and not alike(whole(i[0]), whole(j[0]), percent):
                i, j = i[1:], j[1:]
                continue
            first.append(int(i[0]))
            second.append(int(j[0]))
            labels[labels == labels[j[0]]] = labels[i[0]]
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
    return first, second


def bucket_met(sizes, bits, labels, percent: int, sides, firsts: np.ndarray) -> np.ndarray:
    """Places in one bucket with a pair that no bucket before has; ``firsts``: keys before this one's by place, filled up with negative places."""
    met = np.zeros(len(sizes), bool)
    labels = np.unique(labels, return_inverse=True)[1]
    for i, j in pairs_across(sizes, bits, labels, percent, sides):
        new = ~(met[i] & met[j])
        i, j = i[new], j[new]
        new = ~(firsts[i][:, :, None] == firsts[j][:, None, :]).any((1, 2))
        met[i[new]] = met[j[new]] = True
    return np.flatnonzero(met)


def small_pairs(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs, digests (a, b) and ids (u, v), in buckets of up to SMALL, from rows (key, rep, n).

    Pairs whose sizes allow it meet first, each once however many buckets have it; then their bitmaps decide.
    """
    kind = members.schema["rep"].dataType
    small = SMALL

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> pa.RecordBatch:
            keys, sizes, ids = rows["key"].to_numpy(), rows["n"].to_numpy(), rows["rep"].to_pylist()
            found = []
            for k in range(1, min(small, len(keys))):
                i = np.flatnonzero((keys[k:] == keys[:-k]) & (100 * sizes[:-k] >= percent * sizes[k:])).tolist()
                found += [(ids[x], ids[x + k]) if ids[x] <= ids[x + k] else (ids[x + k], ids[x]) for x in i]
            found = sorted(set(found))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], rows["rep"].type) for k in (0, 1)], ["u", "v"])

        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*waiting, batch])
            keys = rows["key"].to_numpy()
            last = np.flatnonzero(keys != keys[-1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield pairs(rows.slice(0, cut))
            waiting = rows.slice(cut).to_batches()
        if waiting:
            yield pairs(pa.Table.from_batches(waiting))

    def reach(batches):
        for batch in sliced(batches):
            k = batch.num_rows
            both = [batch.column(c).to_pylist() for c in (2, 3, 4, 5, 6, 7)]  # digests, sizes and bitmaps of either side
            members = Members(np.array(both[2] + both[3], np.int64), both[4] + both[5])
            some = pa.array(np.flatnonzero(members.reach(np.arange(k), np.arange(k, 2 * k), percent))) if k else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(some) for c in (2, 3, 0, 1)], ["a", "b", "u", "v"])

    met = members.select("key", "rep", "n").repartition("key").sortWithinPartitions("key", "n", "rep")
    met = materialize(map_arrow(met, run, StructType([StructField("u", kind), StructField("v", kind)])).distinct(), "met")
    side = lambda c, k: reps.select(F.col("rep").alias(c), F.col("digest").alias(f"d{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"))
    both = met.join(side("u", 0), "u").join(side("v", 1), "v").where("d0 <> d1").select("u", "v", "d0", "d1", "n0", "n1", "b0", "b1")
    out = StructType([StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("u", kind), StructField("v", kind)])
    least = F.col("a") <= F.col("b")
    return map_arrow(both, reach, out).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(least, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(least, F.col("v")).otherwise(F.col("u")).alias("v")
    )


def _in_cells(members: DataFrame, columns: list[str], each: Callable[[pa.Table, int, int, np.ndarray], object], done: Callable[[pa.Table, list], pa.RecordBatch], out: StructType) -> DataFrame:
    """``done`` of what ``each`` finds in the rows from a to b of every cell with several labels (numbers); ``columns`` of the rows are read.

    A bucket is the rows of one cell in order of size. Rows of a cell with both sides 0 and 1 only meet across.
    """

    def cells(rows: pa.Table) -> pa.RecordBatch:
        cell = rows["cell"].to_numpy()
        labels = np.unique(np.array(rows["label"].to_pylist()), return_inverse=True)[1]
        edge = (np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()
        bounds = zip([0, *edge], [*edge, len(cell)], strict=True)
        return done(rows, [each(rows, a, b, labels[a:b]) for a, b in bounds if b - a > 1 and (labels[a:b] != labels[a]).any()])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*waiting, batch])
            cell = rows["cell"].to_numpy()
            last = np.flatnonzero(cell != cell[-1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield cells(rows.slice(0, cut))
            waiting = rows.slice(cut).to_batches()
        if waiting:
            yield cells(pa.Table.from_batches(waiting))

    sorted_ = members.select("cell", "side", "digest", "rep", "n", "label", "bits", *columns).repartition("cell").sortWithinPartitions("cell", "n", "digest")
    return map_arrow(sorted_, run, out)


def _of(rows: pa.Table, a: int, b: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Sizes, bitmaps and sides of the rows from a to b."""
    part = rows.slice(a, b - a)
    return part["n"].to_numpy(), part["bits"].to_pylist(), part["side"].to_numpy()


def _taken(rows: pa.Table, places: list[int], columns: list[str]) -> list[pa.Array]:
    found = rows.select(columns).take(pa.array(places, pa.int64())).combine_chunks()
    return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in found.columns]


def forests(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs that join groups of their bucket, digests (a, b), ids (u, v) and their cell, from rows (cell, side, digest, rep, n, label, bits)."""
    kind = members.schema["rep"].dataType

    def each(rows, a, b, labels):
        sizes, bits, sides = _of(rows, a, b)
        return [(a + x, a + y) for x, y in zip(*bucket_forest(sizes, bits, labels, percent, sides), strict=True)]

    def done(rows, found):
        digests = rows["digest"].to_pylist()
        pairs = [(q, p) if digests[q] < digests[p] else (p, q) for some in found for p, q in some]
        left, right = (_taken(rows, [pair[k] for pair in pairs], ["digest", "rep", "cell"]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([left[0], right[0], left[1], right[1], left[2]], ["a", "b", "u", "v", "cell"])

    out = StructType([StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("u", kind), StructField("v", kind), StructField("cell", LongType())])
    return _in_cells(members, [], each, done, out)


def members_met(members: DataFrame, percent: int) -> DataFrame:
    """Rows (cell, side, rep, label) of those members that a pair the bounds leave has, in the first bucket of both; from rows with their ``key`` and ``firsts``."""
    names = ["cell", "side", "rep", "label"]

    def each(rows, a, b, labels):
        sizes, bits, sides = _of(rows, a, b)
        key = rows["key"][a].as_py()
        firsts = np.repeat(np.arange(b - a)[:, None], FIRST_KEYS, 1)
        before = np.zeros(firsts.shape, bool)
        for k, keys in enumerate(rows["firsts"].slice(a, b - a).to_pylist()):
            keys = [x for x in keys if x < key]
            firsts[k, : len(keys)] = keys
            before[k, : len(keys)] = True
        # Keys become numbers from 0 on, so that places can stand for none below them.
        firsts[before] = np.unique(firsts[before], return_inverse=True)[1]
        firsts[~before] = -1 - firsts[~before]
        return [a + x for x in bucket_met(sizes, bits, labels, percent, sides, firsts).tolist()]

    def done(rows, found):
        return pa.RecordBatch.from_arrays(_taken(rows, [p for some in found for p in some], names), names)

    return _in_cells(members, ["key", "firsts"], each, done, StructType([members.schema[c] for c in names]))


def linked(members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join groups of their bucket, from rows with their whole ``set``."""
    kind = members.schema["rep"].dataType

    def each(rows, a, b, labels):
        sizes, bits, sides = _of(rows, a, b)
        sets = rows["set"]
        whole = lambda k: np.frombuffer(sets[a + int(k)].as_buffer(), np.uint64)
        return [(a + x, a + y) for x, y in zip(*bucket_forest(sizes, bits, labels, percent, sides, whole), strict=True)]

    def done(rows, found):
        pairs = [pair for some in found for pair in some]
        return pa.RecordBatch.from_arrays([_taken(rows, [pair[k] for pair in pairs], ["rep"])[0] for k in (0, 1)], ["u", "v"])

    return _in_cells(members, ["set"], each, done, StructType([StructField("u", kind), StructField("v", kind)]))


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Whole sets by digest, of the documents of the written table ``ids``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(broadcast_if_small(ids, "id"), "id", "left_semi")

    def members(batches):
        for batch in sliced(batches):
            sets = list(sets_in_steps(batch.column(1).to_pylist(), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "set"]
            )

    # Repeated rows of an id have one set; other texts of an id have digests that no pair has.
    return materialize(
        map_arrow(texts.select("id", "t"), members, StructType([StructField("digest", BinaryType()), StructField("set", BinaryType())])), "members"
    ).groupBy("digest").agg(F.first("set").alias("set"))


def check_pairs(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs of written table ``pairs`` whose whole sets reach the similarity; written."""
    kind = docs.schema[id_col].dataType
    ids = materialize(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), "ids")
    sets = sets_of(docs, ids, id_col, text_col, width)
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("set").alias("y")), "b"
    ).select("u", "v", "x", "y")

    def verify(batches):
        for batch in sliced(batches):
            good = [
                alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            some = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some)], ["u", "v"])

    return materialize(map_arrow(both, verify, StructType([StructField("u", kind), StructField("v", kind)])).distinct(), "links")


def buckets_of(reps: DataFrame) -> DataFrame:
    """Rows (key, c, rep) of the prefix buckets of ``c`` representatives, two or more; of buckets with equal members one."""
    keys = reps.select("rep", F.explode("prefix").alias("key"))
    crowded = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "crowded")
    rows = materialize(keys.join(crowded, "key"), "buckets")
    marks = [F.xxhash64("rep", F.lit(k)) for k in range(3)]
    alike = rows.groupBy("key", "c").agg(
        F.bit_xor(marks[0]).alias("x"), *[F.sum(F.shiftright(m, 32)).alias(f"s{k}") for k, m in enumerate(marks)]
    ).groupBy("c", "x", "s0", "s1", "s2").agg(F.min("key").alias("key"))
    kept = materialize(alike.select("key"), "keys")
    placed = materialize(rows.join(kept, "key", "left_semi").select("key", "c", "rep"), "placed")
    discard(crowded, rows, kept)
    return placed


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, label) of large buckets, dealt to cells in which all pairs of different labels meet.

    A label of BLOCK members or more in a bucket has blocks of its own, the others share blocks; a row goes to a cell for each
    block that its own must meet.
    """
    count = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).withColumn("own", F.when(F.col("m") >= BLOCK, F.col("label")))
    parts = count.groupBy("key", "own").agg(F.sum("m").alias("m")).withColumn("k", F.ceil(F.col("m") / BLOCK).cast("int"))
    parts = materialize(parts.select("key", "own", "k"), "parts")
    every = parts.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda p: F.struct("own", p.alias("part")))).alias("o"))
    every = every.groupBy("key").agg(F.collect_list("o").alias("others"))
    dealt = rows.join(count.select("key", "label", "own"), ["key", "label"]).join(
        parts.withColumnRenamed("own", "own_").withColumnRenamed("key", "key_"), (F.col("key") == F.col("key_")) & F.col("own").eqNullSafe(F.col("own_"))
    ).drop("key_", "own_").join(every, "key")
    mine = F.struct("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int").alias("part"))
    dealt = dealt.withColumn("mine", mine).withColumn(
        "other", F.explode(F.filter("others", lambda o: F.col("own").isNull() | ~o["own"].eqNullSafe(F.col("own"))))
    )
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return dealt.withColumn("cell", F.xxhash64("key", low, high)).withColumn("side", F.when(F.col("mine") == low, 0).otherwise(1))


def several_labels(rows: DataFrame) -> DataFrame:
    """The rows of buckets with more than one label."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return rows.join(mixed, "key", "left_semi")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the least id that links reach, itself included."""
    whole = describe(docs, id_col, text_col, width, percent)
    described = materialize(whole.select("id", "n", "digest"), "described")
    some = whole.where("digest is not null and id is not null")
    copies = materialize(some.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "copies")
    member_of = described.select("id", "n", "digest").join(broadcast_if_small(copies, "rep"), "digest", "left").select(
        "id", "n", "digest", F.coalesce(F.when(F.col("id").isNotNull(), F.col("rep")), "id").alias("rep")
    )
    once = some.join(broadcast_if_small(copies, "rep"), "digest", "left").where("rep is null or rep = id")
    reps = materialize(once.where("rep is null").unionByName(once.where("rep is not null").dropDuplicates(["digest"])).withColumn("rep", F.col("id")), "reps")
    discard(whole)
    some = described.where("digest is not null and id is not null")
    # Texts of one id are one document.
    several = some.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low <> high").select("id")
    edges = materialize(member_of.where("digest is not null").join(several, "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v")), "same")

    placed, written = buckets_of(reps), reps
    reps = reps.select("rep", "digest", "n", "bits")
    sizes = reps.select("rep", "n").distinct()
    ends = ["a", "b", "u", "v"]

    def forests_in(rows: DataFrame) -> DataFrame:
        """Digests, sizes and bitmaps join the rows (cell, side, rep, label) only on their way to the cells."""
        return forests(rows.join(reps, "rep"), percent)

    plain = placed.withColumn("side", F.lit(0)).withColumn("label", F.xxhash64("rep"))
    large = plain.where(F.col("c") > SMALL)
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / BLOCK).cast("long"))
    few = small_pairs(placed.where(F.col("c") <= SMALL).join(sizes, "rep"), reps, percent)
    cell = F.when(F.col("c") > BLOCK, F.xxhash64("key", block)).otherwise(F.col("key"))
    first = materialize(few.withColumn("cell", F.lit(None).cast("long")).unionByName(forests_in(large.withColumn("cell", cell))).distinct(), "first")
    tried = materialize(first.select(*ends).distinct(), "tried")
    # A forest leaves pairs out only beside one that it gives, so buckets that gave none are done, if they were not cut.
    gave = materialize(first.where("cell is not null").select(F.col("cell").alias("key")).distinct(), "gave")
    open_ = large.where(F.col("c") <= BLOCK).join(broadcast_if_small(gave, "key"), "key", "left_semi")
    cut = large.where(F.col("c") > BLOCK)

    def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        labels = found.select(F.col("node").alias("rep"), "component")
        return several_labels(rows.drop("label").join(broadcast_if_small(labels, "rep"), "rep", "left").withColumn(
            "label", F.coalesce("component", "rep")).drop("component"))

    links = check_pairs(docs, tried, id_col, text_col, width, percent)
    found = connected_components(edges.unionByName(links), "u", "v")
    most = placed.agg(F.max("c")).first()[0] or 0
    for _ in range(DELEGATE_ROUNDS if most > BLOCK else 0):
        delegate = F.min(F.struct(F.xxhash64("rep", F.lit(2)).alias("h"), "rep")).alias("d")
        one = labelled(cut, found).groupBy("key", "label").agg(delegate).select("key", "label", "d.*")
        many = one.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        cell = F.xxhash64("key", F.pmod(F.col("h"), F.ceil(F.col("m") / BLOCK).cast("long")))
        again = forests_in(one.join(many, "key").withColumn("cell", cell).withColumn("side", F.lit(0)))
        again = materialize(again.select(*ends).distinct().join(tried, ["a", "b"], "left_anti"), "delegates")
        more = check_pairs(docs, again, id_col, text_col, width, percent)
        tried = materialize(tried.unionByName(again), "tried")
        if more.isEmpty():
            break
        found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), "u", "v")

    left = materialize(labelled(open_.unionByName(cut), found).select("key", "c", "side", "rep", "label"), "left")
    cells = left.where(F.col("c") <= BLOCK).select("key", "side", "rep", "label").withColumn("cell", F.col("key"))
    if most > BLOCK:
        cells = cells.unionByName(blocks_of(left.where(F.col("c") > BLOCK)).select(*cells.columns))
    firsts = left.groupBy("rep").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    met = materialize(members_met(cells.join(firsts, "rep").join(reps, "rep"), percent), "met")
    ids = materialize(met.select(F.col("rep").alias("id")).distinct(), "ids")
    if not ids.isEmpty():
        more = materialize(linked(met.join(reps, "rep").join(sets_of(docs, ids, id_col, text_col, width), "digest"), percent).distinct(), "links")
        if not more.isEmpty():
            found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), "u", "v")
    discard(written, first, tried, gave, left, met, ids, placed, edges, links)
    labels = found.select(F.col("node").alias("rep"), "component")
    return member_of.join(broadcast_if_small(labels, "rep"), "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """All pairs that share a shingle, and all paths of links: fit for small tables only."""
    return f"""
with recursive texts as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (
    select distinct doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) as i from texts where len(w) > 0)),
sizes as (select t.doc_id, count(s)::bigint as n from texts t left join shingles using (doc_id) group by t.doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= {PERCENT} * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as a, doc_id as b from texts union select a, y from reach join both_ways on x = b)
select s.doc_id, s.n as n_shingles, min(r.b) as component_id from sizes s join reach r on r.a = s.doc_id group by all"""
