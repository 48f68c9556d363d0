"""HTML extraction by nearest-URL page differencing.

A page becomes the text lines of its blocks. Pages are paired with the page of nearest URL path within the host; the
two pages' lines are aligned by longest common subsequence, and shared lines, which are the site's
and not the page's, are deleted. Elements that are never the article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, comments) are recognised by their names. An exact check follows, as an article may quote what another
quotes: a shared line inside the ``article`` or ``main`` element is restored where it is a sentence, of ``SENTENCE_WORDS`` words
or ``SENTENCE_CHARS`` characters or more; where the pair has half or more of that element's text too, the page is a copy and keeps
all of it; and a page that would lose everything to its pair keeps its own lines.

The pair is the neighbour among the host's distinct paths, sorted, with the longer common part.

Null and empty pages give an empty text; null URLs share one empty host; repeated rows each give their row; an empty table
gives an empty one. Pages of any length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import map_rows, materialize, table

#: Elements that are never the article.
SKIPPED = frozenset(
    "nav footer aside form script style noscript template iframe svg button select textarea dialog head menu object canvas".split()
)
#: Parts of class, id and role names that mark such elements.
MARKS = frozenset(
    "ad ads advert advertisement banner cookie cookies consent notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " comment comments disqus share sharing social related newsletter subscribe popup modal footer promo sponsor sponsored"
    " contentinfo complementary search dialog form widget".split()
)
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main nav ol p pre section summary table tbody tfoot thead title tr ul option head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end may be left out: a new one ends the open one.
AUTO = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A shared line of an article that has so many words, or characters, is a sentence and no furniture of the site.
SENTENCE_WORDS, SENTENCE_CHARS = 5, 40

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b(?P<attrs0>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|</?[A-Za-z][^<>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _skipped(name: str, attrs: str, in_article: bool) -> bool:
    if name in SKIPPED or name == "header" and not in_article:
        return True
    if not attrs:
        return False
    marks = {p.lower() for m in _NAMED.finditer(attrs) for p in _PARTS.split(m[1] or m[2] or m[3] or "")}
    return bool(marks & MARKS) or "header" in marks and not in_article or bool(_HIDDEN.search(attrs))


def text_lines(page: str | None) -> tuple[list[str], list[int]]:
    """Lines of the page's blocks in order, and of each: 0 never the article, 1 other, 2 inside the article element."""
    lines: list[str] = []
    kinds: list[int] = []
    if not page:
        return lines, kinds
    stack: list[tuple[str, int]] = []  # open elements with the kind of their text
    piece: list[str] = []
    at = 0
    kind = 1

    def flush():
        if piece:
            words = entities.unescape("".join(piece)).split()
            piece.clear()
            if words:
                lines.append(" ".join(words))
                kinds.append(kind)

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCKS:
                flush()
            else:
                piece.append(" " if name in ("td", "th") else "")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush_needed = any(x[1] != kind for x in stack[k:]) or (stack[k - 1][1] if k else 1) != kind
                    if flush_needed:
                        flush()
                    del stack[k:]
                    kind = stack[-1][1] if stack else 1
                    break
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th"):
            piece.append(" ")
        if name in VOID:
            continue
        if name in AUTO and stack and stack[-1][0] in AUTO[name]:
            stack.pop()
            kind = stack[-1][1] if stack else 1
        in_article = kind == 2
        if name in ("article", "main") and kind == 0 and not any(n in ("article", "main") for n, _ in stack):
            # An element that was left open before the article doesn't swallow it.
            while stack and stack[-1][1] == 0:
                stack.pop()
            kind = stack[-1][1] if stack else 1
        new = 0 if kind == 0 or _skipped(name, m["attrs"], in_article) else 2 if in_article or name in ("article", "main") else kind
        if new != kind:
            flush()
            kind = new
        stack.append((name, new))
    if at < len(page):
        rest = page[at:]
        piece.append(rest)
    flush()
    return lines, kinds


def shared_lines(own: list[int], other: list[int]) -> list[bool]:
    """Which of ``own`` are in a longest common subsequence with ``other``."""
    shared = [False] * len(own)
    head, tail = 0, 0
    most = min(len(own), len(other))
    while head < most and own[head] == other[head]:
        shared[head] = True
        head += 1
    while tail < most - head and own[-1 - tail] == other[-1 - tail]:
        shared[-1 - tail] = True
        tail += 1
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    both = set(a) & set(b)
    if not both:
        return shared
    places = [head + k for k, x in enumerate(a) if x in both]
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    # Rows of the length table as bit sets: bit j is clear where the length grows at column j.
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        hit = row & masks[x]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # column j - 1 adds nothing
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:  # nor does row i - 1
            i -= 1
        else:
            shared[places[i - 1]] = True
            i, j = i - 1, j - 1
    return shared


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def main_text(lines: list[str], kinds: list[int], shared: list[bool]) -> str:
    """Lines that the difference leaves, and shared ones that the check restores to the article."""
    rows = [(t, k, s) for t, k, s in zip(lines, kinds, shared, strict=True) if k]
    article = [(len(t), s) for t, k, s in rows if k == 2]
    copied = 2 * sum(n for n, s in article if s) >= sum(n for n, _ in article) > 0
    kept = [t for t, k, s in rows if not s or k == 2 and (copied or len(t) >= SENTENCE_CHARS or len(t.split()) >= SENTENCE_WORDS)]
    return "\n".join(kept or [t for t, _, _ in rows])


def nearest_paths(paths: DataFrame) -> DataFrame:
    """Of distinct rows (host, path): ``path`` and ``partner``, its neighbour in the host's sorted paths with the longer common part, or null.

    Paths are sorted by range, so a hot host is spread; of each range the first and last path reach the driver, and
    stand in for the neighbours that its outermost paths have in the ranges beside it.
    """
    ranged = materialize(
        paths.repartitionByRange("host", "path").withColumn("part", F.spark_partition_id()), "paths"
    )
    key = F.struct("host", "path")
    ends = sorted(ranged.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect(), key=lambda r: r["part"])
    kind = "part int, before struct<host:string,path:string>, after struct<host:string,path:string>"
    beside = paths.sparkSession.createDataFrame(
        [(r["part"], ends[k - 1]["high"] if k else None, ends[k + 1]["low"] if k + 1 < len(ends) else None) for k, r in enumerate(ends)], kind
    )
    order = Window.partitionBy("part").orderBy("host", "path")
    near = ranged.select("*", F.lag(key).over(order).alias("prev"), F.lead(key).over(order).alias("next")).join(F.broadcast(beside), "part")

    def choose(hosts, paths_, before, after):
        partners = []
        for host, path, *both in zip(hosts, paths_, before, after, strict=True):
            found = [n["path"] for n in both if n and n["host"] == host]
            partners.append(max(found, key=lambda p: len(commonprefix([path, p])), default=None))
        return [hosts, paths_, partners]

    return map_rows(
        near.select("host", "path", F.coalesce("prev", "before"), F.coalesce("next", "after")), choose, "host string, path string, partner string"
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, URL, main text and its length. Shuffles paths, one page's line hashes a path, and pages' lines."""
    id_kind = dict(pages.dtypes)[id_col]

    def lines_of(keys, urls, htmls, hosts, paths):
        found = [text_lines(h) for h in htmls]
        return [keys, urls, hosts, paths, [f[0] for f in found], [f[1] for f in found]]

    def hashes_of(hosts, paths, keys, htmls):
        return [hosts, paths, keys, [[_hash(x) for x in text_lines(h)[0]] for h in htmls]]

    url = F.coalesce(F.col(url_col), F.lit(""))
    located = pages.select(
        id_col, url_col, html_col, F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("__host"),
        F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(/|\.html?)?([?#].*)?$", "").alias("__path"),
    )
    full = located.where(F.length(html_col) > 0).select(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col(id_col).alias("id"), html_col)
    pairs = nearest_paths(full.select("host", "path").distinct())
    # Of a path's pages the one of least id stands for it.
    one = map_rows(full, hashes_of, f"host string, path string, id {id_kind}, hashes array<long>").groupBy("host", F.col("path").alias("partner")).agg(
        F.min(F.struct("id", "hashes"))["hashes"].alias("other")
    )
    others = pairs.where("partner is not null").join(one, ["host", "partner"]).select("host", "path", "other")
    lines = map_rows(
        located, lines_of, f"id {id_kind}, url string, host string, path string, lines array<string>, kinds array<tinyint>",
    )
    paired = lines.join(others, ["host", "path"], "left").select("id", "url", "lines", "kinds", "other")

    def difference(keys, urls, lines_, kinds_, others_):
        texts = [
            main_text(lines, kinds, shared_lines([_hash(x) for x in lines], other or []))
            for lines, kinds, other in zip(lines_, kinds_, others_, strict=True)
        ]
        return [keys, urls, texts, [len(t) for t in texts]]

    return map_rows(paired, difference, f"`{id_col}` {id_kind}, `{url_col}` string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
