"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeated rows, extra columns."""

import base64
import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from attestra.llm import bpe, chat, common, decontaminate, html, jaccard, langid, licenses, pii, quality, separators
from attestra.sources.shared import shared_path

RNG = random.Random(7)
WORDS = ["the", "of", "Über", "naïve", "漢字", "don't", "x1", "3.14", "--", "%%%", "🙂"] + ["".join(RNG.choice("abcdeinorst") for _ in range(RNG.randint(2, 9))) for _ in range(300)]


def prose(n):
    return "".join(RNG.choice(WORDS) + RNG.choice([" ", " ", " ", "\n", "  ", ", "]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(120) for _ in range(30)]
    near = [base[0] + " tail", base[0], base[1].replace("the", "teh", 1)]
    return [None, "", " \n\t", "one", "two words", *base, *near, base[2], "a" * 5000, prose(20000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, "n_words", "prefix", 1.0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, bits string, kept double")


EMPTY = "doc_id long, text string, lang string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, texts):
    enc = reference()
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, keep_ids=True).collect()}
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == sha(",".join(map(str, ids))) and got[k]["decoded_sha256"] == sha(t or "")
    assert bpe.encode_decode(spark.createDataFrame([], EMPTY)).count() == 0


def test_workers_let_go_of_the_encoder(spark, docs):
    def holding(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe._encoder.cache_info().currsize] * batch.num_rows, pa.int32())], ["n"])

    ids, encoded = docs.select("doc_id").coalesce(1), bpe.encode_decode(docs.coalesce(1))
    for holds, most in (("bpe", 1), ("", 0)):
        encoded.collect()
        assert max(r["n"] for r in common.map_arrow(ids, holding, "n int", holds).collect()) == most


def test_encoder_memory():
    """MB of states and remembered pieces after 40,000 words that occur once: 52.6, and 62.4 while states were tuples of tuples."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(9)) for _ in range(40_000))
    path, pattern = bpe.default_vocabulary()
    encoder = bpe.Encoder(bpe.read_ranks(bpe.vocabulary_bytes(path)), pattern, bpe.pack_decimal, ",")
    tracemalloc.start()
    try:
        ids = next(encoder.many([text]))
        grown = tracemalloc.get_traced_memory()[0] / 1e6
    finally:
        tracemalloc.stop()
    assert [int(x) for x in ids.split(",")] == reference().encode_ordinary(text)
    assert grown < 57


def test_stream_decoder_splits_code_points():
    data = "aé漢🙂z".encode()
    for bad in (data, data[:-2], b"\xff\xf0\x9f", b"\xe0\x80a", b"\xc3"):
        d = bpe.StreamDecoder({k: bytes([k]) for k in range(256)})
        assert "".join(d.feed([b]) for b in bad) + d.finish() == bad.decode("utf-8", "replace")


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_separators(spark, docs, texts, block):
    path = shared_path(spark, "t")
    separators.write_token_files(docs.coalesce(1), path)
    got = separators.scan_token_files(spark, path, block_bytes=block * 16).orderBy("file", "doc").collect()
    want = Counter(len(reference().encode_ordinary(t or "")) for t in texts)
    assert Counter(r["n_tokens"] for r in got) == want and all(r["closed"] for r in got)


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", "a<\\|b <|x|>"), (2, 0, None, None), (2, 0, "assistant", ""), (None, 0, "us\ner%0A<|", "t"), (3, 0, "assistant", "é🙂")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), keep_text=True).collect()}
    for conv in (1, 2, None, 3):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own)) and got[conv]["n_turns"] == len(own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["loss_sha256"] == sha(loss) and got[conv]["loss_chars"] == len(loss)
        assert len(got[conv]["formatted"]) == got[conv]["formatted_chars"]


def test_template_folds_and_refuses():
    assert chat.folded(chat.parse("a{{ 'b' ~ 'c' }}{% if 'x' == 'y' %}d{% else %}e{% endif %}")) == [("text", "abce")]
    for bad in ("{{ x() }}", "{{ m.__class__ }}", "{% for x %}", "{% if a %}", "{{ a | eval }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.folded(chat.parse(bad))


def test_langid(spark):
    rows = [(k, " ".join(RNG.choice(w) for _ in range(60)), lang) for k in range(60) for lang, w in (("en", ["the", "and", "house", "with"]), ("de", ["und", "der", "häuser", "mit"]))]
    data = spark.createDataFrame(rows, EMPTY)
    profiles = langid.learn(data)
    found = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(1, "the house and", ""), (2, "der und häuser", ""), (3, None, ""), (4, "12 !", "")], EMPTY), profiles).collect()}
    assert [found[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and 0 <= found[1]["score"] <= 1
    assert langid.predict(data, langid.learn(spark.createDataFrame([], EMPTY))).where("lang_pred <> 'und'").count() == 0


def test_html(spark):
    page = lambda body: f'<html><head><title>T</title></head><body><nav><a>Menu</a></nav>{body}<div class="comments">no</div><footer>f</footer>'
    rows = [
        (1, "http://a.example/en/10", page("<div>Shared</div><article><h1>A &amp; B</h1><p>x  y<br>z<p>Shared</article>")),
        (2, "http://a.example/en/11", page("<div>Shared</div><div>Own &lt;two&gt;</div>")), (3, None, None), (4, "http://a.example/en/11", ""),
        (5, "http://b.example/x", page("<p>alone")), (6, "http://b.example/x", page("<p>alone")),
    ]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B\nx y z\nShared", 2: "Own <two>", 3: "", 4: "", 5: "alone", 6: "alone"}


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_versions_of_one_url_are_no_pair(spark):
    rows = [(k, "http://a.example/x", f"<p>same text<p>seen on day {k}") for k in (1, 2, 3)]
    assert extracted(spark, rows) == {k: f"same text\nseen on day {k}" for k in (1, 2, 3)}


def test_html_difference_decides_beside_an_article(spark):
    rows = [(k, f"http://a.example/{k}", f"<p>By {k}<article><p>{'own words of page %d ' % k * 3}<p>Read more</article><p>Read on") for k in (1, 2)]
    assert extracted(spark, rows) == {k: f"By {k}\n{('own words of page %d ' % k * 3).strip()}" for k in (1, 2)}
    rows = [(k, f"http://a.example/{k}", f"<p>we all say this one<article><p>{'own words of page %d ' % k * 9}<p>we all say this one</article>") for k in (1, 2)]
    assert extracted(spark, rows) == {k: f"{('own words of page %d ' % k * 9).strip()}\nwe all say this one" for k in (1, 2)}
    rows = [(k, f"http://a.example/{k}", f"<p>top<article><p>a copied text<p>{k}</article>") for k in (1, 2)]
    assert extracted(spark, rows) == {k: f"a copied text\n{k}" for k in (1, 2)}


def test_html_pairs_in_the_whole_host(spark):
    rows = [(k * 5000, f"http://a.example/{w}", f"<p>top of the site<p>own {w}<p>end of the site") for k, w in enumerate(["apple-pie", "bread", "corn-soup", "dill"])]
    rows += [(7, "http://b.example/bread", "<p>top of the site<p>own"), (8, "http://a.example/bread", "<p>top of the site<p>own too<p>end of the site")]
    got = extracted(spark, rows)
    assert got == {0: "own apple-pie", 5000: "own bread", 10000: "own corn-soup", 15000: "own dill", 7: "top of the site\nown", 8: "own too"}


def test_longest_common_subsequence():
    for _ in range(300):
        a, b = ([RNG.randint(0, 4) for _ in range(RNG.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        shared = html.shared_lines(a, b)
        left = [x for x, s in zip(a, shared, strict=True) if s]
        it = iter(b)
        assert len(left) == table[-1][-1] and all(x in it for x in left)


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Ann\n" + mit.upper().replace("SUBLICENSE", "sub-licence"), ""), (2, "x\nLicenced under the Apache License, version 2.0", ""), (3, None, ""), (4, "", "")]
    got = {r["doc_id"]: (r["license"], r["notes"]) for r in licenses.scan(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got[2] == (None, "Apache-2.0") and got[3] == (None, "") and got[4] == (None, "")


def brute_components(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, docs, texts, width, percent):
    base = [RNG.choice(WORDS) for _ in range(150)]
    rows = list(enumerate(texts))
    for k in range(60):
        own = list(base)
        for _ in range(k % 4):
            own[RNG.randrange(len(own))] = RNG.choice(WORDS)
        rows.append((1000 + k, " ".join(own)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(data, width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_empty(spark):
    assert jaccard.join(spark.createDataFrame([], EMPTY)).count() == 0


def test_pii_base_spans():
    def brute(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[ -]", "", m[0])
            if 14 <= len(d) <= 19 and pii._luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        return sorted(out)

    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (377) 555-0271", "+", " ", "-", "a", "7", "é", ".", "q@w.e@r.t"]
    for _ in range(3000):
        t = "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 9)))
        assert pii.base_spans(t) == brute(t), t


def test_pii_field_adds_and_masks(spark):
    data = spark.createDataFrame([(1, "call (212) 555-0142, or ssn 078-05-1120 now", ""), (2, None, ""), (3, "", ""), (4, "in 2019 at 10:30", "")], EMPTY)
    got = {r["doc_id"]: r["spans"] for r in pii.find(data).collect()}
    assert got[1] == "phone:5:19,id:28:39" and got[2] == got[3] == got[4] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask(data).collect()}
    assert masked[1] == "call <PHONE>, or ssn <ID> now" and masked[2] is None and masked[4] == "in 2019 at 10:30"


def test_quality(spark, docs, texts):
    got = {r["doc_id"]: r for r in quality.quality(docs.drop("kept", "n_words"), docs.where("doc_id % 3 = 0").select("doc_id")).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_counts_without_broadcast(spark, docs, texts, monkeypatch):
    def brute(ids):
        raw, target = [0] * 64, [0] * 64
        rows = docs.select("doc_id", quality.ngram_buckets(quality.hashed_ngrams(quality.words_of(docs["text"]), 2), 64).alias("b")).collect()
        for r in rows:
            for b in r["b"]:
                raw[b] += 1
                target[b] += r["doc_id"] in ids
        return quality.log_ratios(raw, target)

    trusted = spark.createDataFrame([(k,) for k in (None, 5, 5, 7, 12, 10**6)], "doc_id long")
    want = brute({5, 7, 12})
    assert quality.train(docs, trusted, "doc_id", "text", 64) == want
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert quality.train(docs, trusted, "doc_id", "text", 64) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quality_cut():
    assert quality.best_cut({5: 1}, {}) == quality.best_cut({}, {5: 1}) == float("-inf")
    assert quality.best_cut({9: 2, 10: 1}, {1: 3, 3: 1}) == pytest.approx(6.5 * quality.STEP)
    assert quality.best_cut({0: 1, 9: 9}, {-5: 1, 4: 1}) == pytest.approx(7 * quality.STEP)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_quality_keeps_clean_texts_without_a_label(spark, sf):
    def marked(text):
        w = text.split()
        return sum(x[-1] in "%$#&*|<>!" for x in w) > 0.3 * len(w) or sum(x.isupper() and len(x) > 1 for x in w) > 0.3 * len(w)

    d = f"/root/testdata/{sf}"
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = [r for r in quality.query(spark, d).collect() if r["doc_id"] not in labelled and not r["base_failed"]]
    clean, junk = ([r["kept"] for r in rows if marked(texts[r["doc_id"]]) == m] for m in (False, True))
    assert sum(clean) >= 0.95 * len(clean)
    assert sum(junk) <= 0.2 * len(junk) or sf == "sf0.001"  # six bad labelled documents set the cut there


def test_decontamination(spark, docs, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, " ".join(words(texts[6])[10:40])), (2, "one"), (3, None), (4, "..."), (10, texts[7].upper()), (5, "never seen words here at all")]
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs.select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        assert (got[k]["n_words"], got[k]["n_hit"], got[k]["items"]) == (len(w), len(hit), sorted(map(str, found)))
