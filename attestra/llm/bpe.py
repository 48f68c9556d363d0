"""Byte-level BPE as a lazily determinised finite-state transducer, with a streaming decoder.

Encoder. For a merge table whose every token is reachable by merges, a token sequence is the BPE
encoding of its bytes exactly if each adjacent pair ``(t, u)`` re-encodes to itself. That local rule
makes encoding a rational function, so it is run as a transducer:

* the non-deterministic machine has states ``(last token, trie node of the token being read)``; it
  reads bytes and outputs a token when it completes one that is compatible with the last;
* it is determinised on the fly by subset construction: a deterministic state is a set of such states, and a
  transition carries, for each member of the next set, its parent and the token it outputs. A hypothesis dies
  when its trie node has no matching child, so what stays undecided is bounded by the longest tokens, and what
  all open hypotheses agree on is released;
* only the states that the data reaches are built; when the table has grown to ``max_states`` it is
  dropped and built anew, which bounds memory.

Decoder. Token bytes pass an incremental UTF-8 state machine, which releases whole code points and
carries a split one over to the next call.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import held, map_rows, table

BOS = -1
ROOT = 0
#: Two numbers of a hypothesis.
HYPOTHESIS = struct.Struct("ii")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a ``.tiktoken`` file: base64 of the token, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_loop(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """Plain BPE: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """The encoder for one pre-token; ``encode`` returns token ids."""

    #: Bytes after which outputs that no open hypothesis disputes are released.
    COMMIT = 512
    #: A node with at most so many tokens below keeps those that the last token allows, not the last token.
    NARROW = 12
    #: Remembered pairs, above which they are forgotten and judged anew.
    PAIRS = 1 << 17

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks = ranks
        self.max_states = max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.goto: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.has_child: list[bool] = [False]
        #: The tokens below each node, none where they are more than NARROW.
        self.below: list[list[int] | None] = [None]
        for token, rank in ranks.items():
            node, path = ROOT, []
            for b in token:
                nxt = self.goto.get(node << 8 | b)
                if nxt is None:
                    nxt = len(self.token_at)
                    self.goto[node << 8 | b] = nxt
                    self.has_child[node] = True
                    self.token_at.append(-1)
                    self.has_child.append(False)
                    self.below.append([])
                path.append(nxt)
                node = nxt
            self.token_at[node] = rank
            for above in path[:-1]:
                if (some := self.below[above]) is not None:
                    if len(some) < self.NARROW:
                        some.append(rank)
                    else:
                        self.below[above] = None
        self.width = max(ranks.values()) + 1
        self.spines: dict[int, tuple[list, list]] = {}
        #: Rank by pair of tokens.
        self.rank_of = {
            left * self.width + right: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        }
        self._reset()

    def _reset(self) -> None:
        #: A state is its hypotheses in bytes: of each its last token, or -2 less the number of a list of tokens, and its node.
        start = HYPOTHESIS.pack(BOS, ROOT)
        self.state_id = {start: 0}
        self.states = [start]
        self.compatible_pairs: dict[int, bool] = {}
        self.lists: list[tuple[int, ...]] = [()]
        self.list_id: dict[tuple[int, ...], int] = {(): 0}
        self.narrowed: dict[int, int] = {}
        #: Transition ids, -1 where not yet built, in pages of 16 bytes; a state's pages by high half of the byte, 0 the empty one.
        self.page_of = np.zeros((1024, 16), np.int32)
        self.page = np.full((4096, 16), -1, np.int32)
        self.pages = 1
        #: Of each transition: next state, and where its (parent, token) pairs begin and how many there are.
        self.target, self.begin, self.size = (np.zeros(4096, np.int32) for _ in range(3))
        self.parent, self.output = np.zeros(16384, np.int32), np.zeros(16384, np.int32)
        self.transitions = self.pairs = 0

    def _spines(self, token: int) -> tuple[list, list]:
        """Left and right edges of a token's merge tree from the bottom up, as (token, time until which it stands)."""
        known = self.spines.get(token)
        if known is None:
            data = self.bytes_of[token]
            edges = ([(token, 1 << 60)], [(token, 1 << 60)])
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                for side in (0, 1):
                    inner = self._spines(self.ranks[parts[side]])[side]
                    edges[side][:0] = [*inner[:-1], (inner[-1][0], token)]
            known = self.spines[token] = edges
        return known

    def compatible(self, t: int, u: int) -> bool:
        """Whether the BPE encoding of the two tokens' bytes is the two tokens.

        It isn't when, at some time of the merges, the right edge of ``t`` and the left edge of ``u`` that stand
        then can merge before either is merged inwards; at equal rank the pair further left goes first.
        """
        width = self.width
        key = t * width + u
        known = self.compatible_pairs.get(key)
        if known is None:
            right, left, rank_of = self._spines(t)[1], self._spines(u)[0], self.rank_of
            i = j = 0
            known, tops = True, (len(right) - 1, len(left) - 1)
            (a, until_a), (b, until_b) = right[0], left[0]
            while True:
                rank = rank_of.get(a * width + b)
                if rank is not None and rank < until_a and rank <= until_b:
                    known = False
                    break
                if (i, j) == tops:
                    break
                if until_a <= until_b:
                    i += 1
                    a, until_a = right[i]
                else:
                    j += 1
                    b, until_b = left[j]
            if len(self.compatible_pairs) >= self.PAIRS:
                self.compatible_pairs.clear()
            self.compatible_pairs[key] = known
        return known

    def _narrow(self, last: int, node: int) -> int:
        """What of ``last`` still matters below ``node``: the list of all that are allowed if they are few, else itself."""
        below = self.below[node]
        if below is None:
            return last
        key = last * len(self.token_at) + node
        known = self.narrowed.get(key)
        if known is None:
            allowed = tuple(u for u in below if self._allows(last, u))
            number = self.list_id.get(allowed)
            if number is None:
                number = self.list_id[allowed] = len(self.lists)
                self.lists.append(allowed)
            known = self.narrowed[key] = -2 - number
        return known

    def _allows(self, last: int, token: int) -> bool:
        return token in self.lists[-2 - last] if last < BOS else last == BOS or self.compatible(last, token)

    def _build(self, state: int, byte: int) -> int:
        hypotheses, back, done = [], [], None
        for parent, (last, node) in enumerate(HYPOTHESIS.iter_unpack(self.states[state])):
            nxt = self.goto.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token >= 0 and done is None:
                if self._allows(last, token):
                    done = (parent, token)
            if self.has_child[nxt]:
                last = self._narrow(last, nxt)
                if last != -2:
                    hypotheses.append(HYPOTHESIS.pack(last, nxt))
                    back.append((parent, -1))
        if done is None:
            raise ValueError("the merge table has tokens that merges cannot reach")
        hypotheses.append(HYPOTHESIS.pack(done[1], ROOT))
        back.append(done)
        key = b"".join(hypotheses)
        target = self.state_id.get(key)
        if target is None:
            target = self.state_id[key] = len(self.states)
            self.states.append(key)
            if target >= len(self.page_of):
                self.page_of = np.concatenate([self.page_of, np.zeros_like(self.page_of)])
        made, self.transitions = self.transitions, self.transitions + 1
        if made >= len(self.target):
            self.target, self.begin, self.size = (np.concatenate([x, x]) for x in (self.target, self.begin, self.size))
        if self.pairs + len(back) > len(self.parent):
            self.parent, self.output = (np.concatenate([x, x]) for x in (self.parent, self.output))
        self.target[made], self.begin[made], self.size[made] = target, self.pairs, len(back)
        for parent, token in back:
            self.parent[self.pairs], self.output[self.pairs] = parent, token
            self.pairs += 1
        page = self.page_of[state, byte >> 4]
        if page == 0:
            page = self.page_of[state, byte >> 4] = self.pages
            self.pages += 1
            if page >= len(self.page):
                self.page = np.concatenate([self.page, np.full_like(self.page, -1)])
        self.page[page, byte & 15] = made
        return made

    def _trace(self, trail: list[int], hypothesis: int) -> list[tuple[int, int]]:
        """(position, token) of the outputs on the way to a hypothesis, first to last."""
        found = []
        for at in range(len(trail) - 1, -1, -1):
            pair = self.begin[trail[at]] + hypothesis
            hypothesis, token = self.parent[pair], int(self.output[pair])
            if token >= 0:
                found.append((at, token))
        found.reverse()
        return found

    def _release(self, state: int, trail: list[int]) -> list[tuple[int, int]]:
        """(position, token) of what all open hypotheses agree on."""
        ways = [self._trace(trail, h) for h in range(len(self.states[state]) // HYPOTHESIS.size)]
        k = 0
        while all(len(w) > k and w[k] == ways[0][k] for w in ways):
            k += 1
        return ways[0][:k]

    def encode(self, data: bytes) -> list[int]:
        """One pre-token of any length. What all open hypotheses agree on is released every ``COMMIT`` bytes."""
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        state, trail, since = 0, [], 0
        for byte in data:
            made = self.page[self.page_of[state, byte >> 4], byte & 15]
            if made < 0:
                made = self._build(state, byte)
            state = self.target[made]
            trail.append(made)
            since += 1
            if since >= self.COMMIT:
                since = 0
                released = self._release(state, trail)
                if released:
                    out += [token for _, token in released]
                    trail = trail[released[-1][0] + 1 :]
        if trail:
            out += [token for _, token in self._trace(trail, self.size[trail[-1]] - 1)]
        return out

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """Many short pre-tokens at once, each step of the machine for all of them in numpy."""
        if len(self.states) > self.max_states:
            self._reset()
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        lengths = np.array([len(words[i]) for i in order])
        longest = int(lengths[0]) if len(words) else 0
        text = np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in order), np.uint8).reshape(len(words), longest)
        active = [int(n) for n in np.searchsorted(-lengths, -np.arange(longest), "left")]  # words longer than the step
        taken = np.full((len(words), longest), -1, np.int32)
        state = np.zeros(len(words), np.int32)
        for j in range(longest):
            m = active[j]
            column = text[:m, j]
            high, low = column >> 4, column & 15
            made = self.page[self.page_of[state[:m], high], low]
            if len(new := np.flatnonzero(made < 0)):
                for s, b in set(zip(state[new].tolist(), column[new].tolist(), strict=True)):
                    self._build(s, b)
                made[new] = self.page[self.page_of[state[new], high[new]], low[new]]
            taken[:m, j] = made
            state[:m] = self.target[made]
        tokens = np.full((len(words), longest), -1, np.int32)
        hypothesis = np.zeros(len(words), np.int32)
        for j in range(longest - 1, -1, -1):
            m, ended = active[j], active[j + 1] if j + 1 < longest else 0
            made = taken[:m, j]
            hypothesis[ended:m] = self.size[made[ended:]] - 1
            pair = self.begin[made] + hypothesis[:m]
            tokens[:m, j] = self.output[pair]
            hypothesis[:m] = self.parent[pair]
        found = tokens >= 0
        ends = np.cumsum(found.sum(1)).tolist()
        flat = tokens[found].tolist()
        out: list[list[int]] = [[]] * len(words)
        at = 0
        for i, end in zip(order, ends, strict=True):
            out[i] = flat[at:end]
            at = end
        return out


#: Lead byte class -> (continuation bytes that follow, lowest and highest first continuation byte).
def _utf8_classes() -> list[tuple[int, int, int] | None]:
    classes: list[tuple[int, int, int] | None] = [None] * 256
    for b in range(0x80):
        classes[b] = (0, 0, 0)
    for b in range(0xC2, 0xE0):
        classes[b] = (1, 0x80, 0xBF)
    for b in range(0xE0, 0xF0):
        classes[b] = (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF)
    for b in range(0xF0, 0xF5):
        classes[b] = (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF)
    return classes


class StreamDecoder:
    """Token ids in, text out; the machine's state is the bytes of a code point not yet complete."""

    CLASSES = _utf8_classes()

    def __init__(self, bytes_of):
        self.bytes_of = bytes_of
        self.pending = b""

    def _open_tail(self, data: bytes) -> int:
        """Bytes at the end of ``data`` that begin a code point which further bytes may complete."""
        for k in range(1, min(3, len(data)) + 1):
            lead = self.CLASSES[data[-k]]
            if lead is None:
                if 0x80 <= data[-k] <= 0xBF:
                    continue
                return 0
            need, low, high = lead
            if need >= k and (k == 1 or low <= data[-k + 1] <= high):
                return k
            return 0
        return 0

    def feed(self, ids) -> str:
        data = self.pending + b"".join(map(self.bytes_of.__getitem__, ids))
        k = self._open_tail(data)
        self.pending = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class _Memo:
    """A memory of two generations: when the younger is full it becomes the older, and what is used comes back.

    A generation is full at ``bound`` keys, or at ``CHARS`` characters in its keys, as keys can be whole texts.
    """

    CHARS = 8_000_000

    def __init__(self, bound: int):
        self.bound = bound
        self.chars = 0
        self.known: dict = {}
        self.older: dict = {}

    def unknown(self, keys: set) -> list:
        """The keys that neither generation has; those that the older has move to the younger."""
        if len(self.known) + len(keys) > self.bound or self.chars > self.CHARS:
            self.older, self.known, self.chars = self.known, {}, 0
        new = []
        known, older = self.known, self.older
        for key in keys.difference(known):
            self.chars += len(key)
            value = older.get(key)
            if value is None:
                new.append(key)
            else:
                known[key] = value
        return new


class Encoder:
    """Whole texts to packed ids. ``pack`` turns a list of ids into what is joined by ``joiner``.

    In the default pattern a single space before a non-space always begins a pre-token, so texts are first cut there; the packed
    ids of cut pieces are remembered, and only new pieces run the pattern and the transducer. With any other pattern a
    text is one piece.
    """

    INNER_SPACE = re.compile(r" \s")
    CUT = re.compile(r" (?=\S)")
    SHORT = 48
    #: Just below the sizes at which Python doubles a dict.
    PIECES, WORDS = 174_000, 87_000

    def __init__(self, ranks: dict[bytes, int], pattern: str, pack, joiner):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.default = pattern == default_vocabulary()[1]
        self.pack, self.joiner = pack, joiner
        self.pieces = _Memo(self.PIECES)
        self.words = _Memo(self.WORDS)

    @cached_property
    def decimal_bytes(self) -> dict[str, bytes]:
        """Tokens by the decimals of their ids."""
        return {str(rank): token for rank, token in self.transducer.bytes_of.items()}

    def _cut(self, text: str) -> list[str]:
        """The text's pieces; all but the first stand for themselves with a space before."""
        if not self.default:
            return [text]
        parts = text.split(" ")
        if "" in parts or self.INNER_SPACE.search(text):
            parts = self.CUT.split(text)
        return parts

    def _split(self, piece: str) -> list[str]:
        if not self.default:
            return [m[0] for m in self.pattern.finditer(piece) if m[0]]
        if piece[1:].isalpha() and piece[0] == " ":
            return [piece]
        if piece[-1] in ".," and piece[1:-1].isalpha() and piece[0] == " ":
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def _learn(self, pieces: set[str]) -> None:
        new = self.pieces.unknown(pieces)
        split = [self._split(p) for p in new]
        words = self.words.unknown({w for s in split for w in s})
        data = [w.encode("utf-8") for w in words]
        short = [i for i, d in enumerate(data) if len(d) <= self.SHORT]
        for k in range(0, len(short), 50_000):
            some = short[k : k + 50_000]
            for i, ids in zip(some, self.transducer.encode_many([data[i] for i in some]), strict=True):
                self.words.known[words[i]] = self.pack(ids)
        for i, d in enumerate(data):
            if len(d) > self.SHORT:
                self.words.known[words[i]] = self.pack(self.transducer.encode(d))
        known, join = self.words.known, self.joiner.join
        for piece, s in zip(new, split, strict=True):
            self.pieces.known[piece] = known[s[0]] if len(s) == 1 else join([known[w] for w in s])

    def many(self, texts: list[str], step: int = 500) -> Iterator:
        """Packed ids of each text, ``step`` texts or about a million characters at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and end - at < step and (end == at or size < 1_000_000):
                size += len(texts[end])
                end += 1
            cut, pieces = [], set()
            for text in texts[at:end]:
                parts = self._cut(text)
                parts = [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]
                pieces.update(parts)
                cut.append(parts)
            self._learn(pieces)
            known, join = self.pieces.known.__getitem__, self.joiner.join
            for parts in cut:
                yield join(map(known, parts))
            at = end


def pack_decimal(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def pack_u16(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(2, "big") for i in ids)


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@held("bpe", 4)
def _encoder(vocabulary: bytes, pattern: str, kind: str) -> Encoder:
    ranks = read_ranks(vocabulary)
    return Encoder(ranks, pattern, pack_decimal, ",") if kind == "decimal" else Encoder(ranks, pattern, pack_u16, b"")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


DECODE_BLOCK = 8192


def encode_text(text: str | None, vocabulary: bytes, pattern: str) -> list[int]:
    """The ids of one text; null is the empty text."""
    packed = next(_encoder(vocabulary, pattern, "decimal").many([text or ""]))
    return [int(x) for x in packed.split(",")] if packed else []


def encode_decode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None,
    pattern: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """Per row: id, token count, digests of the ids and of the decoded bytes, and on request the ids.

    Nulls and empty texts have no tokens and the digests of nothing. Repeated rows each give a row, other
    columns are not read, and an empty table gives an empty one. The vocabulary, of bounded size, is
    broadcast; every task streams its rows, with no shuffle.
    """
    path, default_pattern = default_vocabulary() if vocabulary_path is None or pattern is None else (None, None)
    pattern = pattern or default_pattern
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary_path or path))

    def per_batch(keys, texts):
        encoder = _encoder(shared.value, pattern, "decimal")
        counts, ids_digests, text_digests, kept = [], [], [], []
        for packed in encoder.many([t or "" for t in texts]):
            ids = packed.split(",") if packed else []
            digest, decoder = hashlib.sha256(), StreamDecoder(encoder.decimal_bytes)
            for at in range(0, len(ids), DECODE_BLOCK):
                digest.update(decoder.feed(ids[at : at + DECODE_BLOCK]).encode("utf-8"))
            digest.update(decoder.finish().encode("utf-8"))
            counts.append(len(ids))
            ids_digests.append(hashlib.sha256(packed.encode("ascii")).hexdigest())
            text_digests.append(digest.hexdigest())
            if keep_ids:
                kept.append(np.fromstring(packed, np.int32, sep=",") if packed else np.zeros(0, np.int32))
        return [keys, counts, ids_digests, text_digests, *([kept] if keep_ids else [])]

    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(df.select(id_col, text_col), per_batch, schema + (", ids array<int>" if keep_ids else ""), holds="bpe")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
