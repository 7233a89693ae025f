"""Each operator against brute force, round trips or the library it wraps, and on awkward inputs."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import chat, decontaminate, html_text, language_id, lines, neardup, pii, spm, topk, wavelet
from weft.llm.common import slices, tokenizer_path
from weft.llm.linkage import components

LONG = "word " * 40_000
ODD = [
    (1, None, "x", "src"),
    (2, "", None, "src"),
    (3, "   \n\t\n", "en", None),
    (4, LONG, "en", "src"),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "en", "src"),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "en", "src"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu xi", "en", "src"),
    (7, "😀 日本語 \u0000 </s>[INST] a@b.co 1.2.3.4", "de", "src"),
]
CLASH = ["lang_pred", "score", "n_tokens", "n_lines", "kept", "errors", "spans", "text_2"]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def none(spark):
    return odd(spark).limit(0)


# language id


def test_language_id_learns_and_answers_odd_rows(spark):
    rows = [(i, t * 5, lang, "s") for i in range(40) for lang, t in (("en", "the thing and other "), ("de", "der schöne hund und "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    assert model.names == ("de", "en")
    got = language_id.identify(odd(spark), model)
    assert got.columns[-2:] == ["lang_pred", "score"] and got.columns.count("score") == 1
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert by[1] == by[2] == by[3] == [("und", 0.0)]
    assert len(by[5]) == 2 and all(0 <= s <= 1 for v in by.values() for _, s in v)
    assert language_id.identify(none(spark), model).count() == 0
    empty = language_id.fit(none(spark))
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), empty).collect()} == {"und"}


def test_language_id_vectors_equal_the_definition():
    e = language_id.Encoder(64)
    text = "Abba, é!"
    vec = e.bundle([text, "", "abba"])
    letter = lambda c: e.letters[e.index[ord(c)]].astype(int)
    blank = e.letters[0].astype(int)
    want = np.zeros(64)
    for word in ("abba", "é"):
        seq = [blank, *map(letter, word), blank]
        for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
            want += np.roll(a, 2) * np.roll(b, 1) * c
    assert (vec[0] == want).all() and not vec[1].any()
    assert (language_id.Encoder(64).bundle(["abba"])[0] == vec[2]).all()
    big = language_id.Encoder(64)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    first = big.bundle([text])
    assert (big.bundle([text, wide])[0] == first[0]).all()


def test_language_id_parts_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdéß1.") for _ in range(rng.randint(1, 30))) for _ in range(n)) for n in (1, 40, 400)] + ["", "x" * 900, " " * 300]
    whole = language_id.Encoder(64).bundle(texts)
    monkeypatch.setattr(language_id, "PART_CHARS", 50)
    assert all("".join(language_id.parted(t)) == t for t in texts)
    assert (language_id.Encoder(64).bundle(texts) == whole).all()


def test_language_id_query_equals_brute_force(spark):
    """Prototypes, cosines and the held-out rule by a plain version, over all documents of the smallest table."""
    from weft.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rolled: dict[str, np.ndarray] = {}
    e = language_id.Encoder()
    letter = lambda c: e._random(32 if c == " " else ord(c)).astype(np.int64)

    def bundled(text):
        grams = collections.Counter()
        for word in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", text or "").lower()):
            padded = f" {word} "
            grams.update(padded[i : i + 3] for i in range(len(word)))
        out = np.zeros(e.dim, dtype=np.int64)
        for g, n in grams.items():
            if g not in rolled:
                rolled[g] = np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])
            out += n * rolled[g]
        return out

    vectors = {r["doc_id"]: bundled(r["text"]) for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in vectors}
    learned = [r for r in rows if r["lang"] and not held[r["doc_id"]]]
    names = sorted({r["lang"] for r in learned})
    proto = np.stack([sum(vectors[r["doc_id"]] for r in learned if r["lang"] == n) for n in names]).astype(float)
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for d, v in vectors.items():
        if v.any():
            cos = proto @ v / np.linalg.norm(proto, axis=1) / np.linalg.norm(v)
            want = (names[int(np.round(cos, 12).argmax())], max(0.0, cos.max()))
        else:
            want = ("und", 0.0)
        assert (got[d]["held_out"], got[d]["lang_pred"]) == (held[d], want[0]) and abs(got[d]["score"] - want[1]) < 1e-9


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    r = language_id.identify(docs.filter(language_id.held_out()), model).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert r > 0.97


# token shards


def test_wavelet_matrix_answers():
    rng = random.Random(4)
    for n, top in ((0, 1), (1, 1), (700, 2), (5000, 300), (1300, 70_000)):
        ids = np.array([rng.randrange(top) for _ in range(n)], dtype="<u4")
        m = wavelet.WaveletMatrix(wavelet.pack([3, None], [n, 0], ids))
        assert (m.tokens() == ids).all() and m.doc_ids() == [3, None] and m.lengths.tolist() == [n, 0]
        for i in rng.sample(range(n), min(n, 60)):
            c = int(ids[i])
            where = np.flatnonzero(ids == c)
            assert m.access(i) == c and m.count(c) == len(where)
            k = rng.randrange(len(where))
            assert m.occurrence(c, k) == where[k]
            a, b = sorted((rng.randrange(n), rng.randrange(n + 1)))
            assert m.count(c, a, b) == ((where >= a) & (where < b)).sum()
        assert m.count(99_999_999) == 0
        with pytest.raises(IndexError):
            m.access(n)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"nope" + b"\0" * 20)


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = ["", " ", "Straße, ÀÉ'S don't can't.", "İstanbul. ŉx", "<|endoftext|> x<|endoftext|>y", "a.b,c. ..x ,y", "ΣΑΣ ΑΣ. é ́x ǅ ªº ½", "A\r\nB\x0b c\x1c\x85e\u2003f", "日本 123 4a5. 😀😀."]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aBé.,'s \n1%ßΣ<|>") for _ in range(40)) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = wavelet.WordEncoder(path)
    assert enc.by_word and [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want
    assert not wavelet.WordEncoder(tokenizer_path("byte_bpe_50k.json")).by_word


def test_token_shards_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    wavelet.write_shards(wavelet.build_shards(odd(spark), path, shard_tokens=100), str(tmp_path / "s"))
    rows = wavelet.read_documents(wavelet.read_shards(spark, str(tmp_path / "s"))).orderBy("start").collect()
    tok = Tokenizer.from_file(path)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc, text, *_) in zip(rows, order, strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    wavelet.write_shards(wavelet.build_shards(none(spark), path), str(tmp_path / "e"))
    assert wavelet.read_documents(wavelet.read_shards(spark, str(tmp_path / "e"))).count() == 0


# SentencePiece


def test_sentencepiece_parity_and_decoding(spark):
    codec = spm.Codec(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = ["", " ", "a  b", " a ", "\n\na\n b", "▁", "a▁▁b", "é 日本 😀\x00", "<s> </s> <0x41>", LONG[:3000]]
    texts += ["".join(rng.choice(["a", "b", " ", "  ", "\n", "▁", "the ", "ing", "日", "é", ".", "😀"]) for _ in range(30)) for _ in range(500)]
    ids, same = codec.encode(texts)
    want = codec.spm.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == want and all(same)
    assert codec.decode(ids) == codec.spm.decode(want)
    whole = [e.ids for e in codec.tok.encode_batch(texts[:10], add_special_tokens=False)]
    assert whole == want[:10]
    got = spm.encode(odd(spark), tokenizer_path("piece_bpe_32k.model"))
    assert got.filter("NOT parity").count() == 0 and got.count() == len(ODD)
    back = spm.decode(got.select("doc_id", "text", "tokens"), tokenizer_path("piece_bpe_32k.model"), to="again")
    assert back.filter("again <> coalesce(text, '')").count() == 0
    assert spm.encode(none(spark), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_sentencepiece_unigram_rebuild(tmp_path):
    """A hand-made unigram model file: the rebuilt tokenizer splits as the library does."""
    import struct

    def field(n, kind, data):
        key = bytes([n << 3 | kind])
        return key + (bytes([len(data)]) + data if kind == 2 else data)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁ab", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("abab", -1.5, 1), ("c", -4.0, 1)]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    body += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x01"))
    (tmp_path / "u.model").write_bytes(body)
    codec = spm.Codec(str(tmp_path / "u.model"))
    assert not codec.parted
    texts = ["ab abab c", "  ab   c ", "", "bab", "abababab"]
    ids, same = codec.encode(texts)
    assert all(same) and [np.frombuffer(b, "<u4").tolist() for b in ids] == codec.spm.encode(texts)


# HTML


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>'</p>'</script></head><body><header>Top</header><nav><ul><li>m</li></ul></nav><div id='cookie-notice'>We use</div>"
    "<main><article><h1>T &amp; U&lt</h1><p>one <i>tw</i>o<br>three<p>four&nbsp;five<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><aside>side</aside><form>f<input></form>"
    "<div class=\"ad-box\">x</div>tail<section class=comments><p>nice</p></section></article></main><div class=sidebar>s</div><footer>f</footer>"
)


def text_of(page):
    root = html_text.parse(page)
    html_text.numbered(root)
    return "\n".join(html_text.blocks(html_text.content_roots(root), set()))


def test_html_blocks():
    assert text_of(PAGE) == "T & U<\none two three\nfour five\na\nb\nc\nd\ntail"
    assert text_of("plain &lt;b") == "plain <b" and text_of("<p>a <b") == "a" and text_of("") == ""
    assert text_of("<div>x<div>y</div>z</div>") == "x\ny\nz"
    assert text_of("a < b <p title='a>b'>c <3 d</p><P>UP</P><!-- no --><p>e<!--x") == "a < b\nc <3 d\nUP\ne"
    assert text_of("<article><p><b>bold<br><p>next</article>after") == "bold\nnext"
    assert text_of("<div>" * 3000 + "deep") == "deep"


def test_tree_matching_counts_nodes():
    tree = lambda s: html_text.parse(s)
    pairs = []
    assert html_text.align(tree("<ul><li>a<li>b<li>c</ul>"), tree("<ul><li>x<li>y</ul><p>z"), pairs) == 4
    assert html_text.align(tree("<div><p>a</p><ul><li>b</ul></div>"), tree("<div><ul><li>b</ul><p>a</p></div>"), []) == 4


def test_wrapper_drops_what_a_host_repeats(spark):
    page = lambda i: f"<body><div>Site of pumps</div><div><p>Story {i} about things</p><p>more {i * 7}</p></div><div>All rights kept</div></body>"
    rows = [(i, f"https://a.example.com/{i}", page(i)) for i in range(12)] + [(100, "https://b.example.com/x", page(0)), (101, None, None), (102, "nohost", ""), (None, "https://a.example.com/n", page(77))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(3)
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[3]["text"] == "Story 3 about things\nmore 21" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[None]["text"] == "Story 77 about things\nmore 539"
    assert got[100]["text"].startswith("Site of pumps\nStory 0") and got[101]["text"] == got[102]["text"] == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def test_wrapper_is_not_decided_by_one_odd_page(spark):
    page = lambda i, *left_out: "<body>" + "".join(x for k, x in enumerate(["<div>Site of pumps</div>", f"<div><p>Story {i} about things</p></div>", "<div>All rights kept</div>"]) if k not in left_out) + "</body>"
    url = lambda i: f"https://a.example.com/{i}"
    for odd_page in (None, "", "<p>Error 500", page(77, 2)):
        rows = [(0, url(0), odd_page)] + [(i, url(i), page(i)) for i in range(1, 13)]
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert [got[i] for i in range(1, 13)] == [f"Story {i} about things" for i in range(1, 13)]
    # no page has all constant blocks
    tags = "section h3 h4 h5 h6 pre blockquote ul ol dl center address".split()
    rows = [(i, url(i), page(i)[:6] + "".join(f"<{t}>Part {t} of all</{t}>" for k, t in enumerate(tags) if k != i) + page(i)[6:]) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} about things" for i in range(12)}


def matched_by_force(a, b):
    """Simple tree matching as it is defined, without shapes, trimming or halving."""
    if a.tag != b.tag:
        return 0
    best = [[0] * (len(b.elements) + 1) for _ in range(len(a.elements) + 1)]
    for i, x in enumerate(a.elements, 1):
        for j, y in enumerate(b.elements, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + matched_by_force(x, y))
    return 1 + best[-1][-1]


def test_tree_matching_equals_brute_force(monkeypatch):
    rng = random.Random(11)

    def tree(depth):
        return f"<{(t := rng.choice(['div', 'ul', 'b']))}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)) + f"</{t}>"

    for cells in (html_text.CELLS, 3):
        monkeypatch.setattr(html_text, "CELLS", cells)
        shapes, memo = {}, {}
        for _ in range(250):
            a, b = html_text.parse(tree(3) + tree(3)), html_text.parse(tree(3) + tree(2))
            pairs = []
            assert html_text.align(a, b, pairs, shapes, memo) == matched_by_force(a, b) == len(pairs)
            assert all(x.tag == y.tag for x, y in pairs) and len({x.index for x, _ in pairs}) == len({y.index for _, y in pairs}) == len(pairs)
            order = sorted((x.index, y.index) for x, y in pairs)
            assert [y for _, y in order] == sorted(y for _, y in order)


def test_tree_matching_has_no_limits():
    for rows in (190, 210, 900):
        a = html_text.parse("<hr>" + "<p><b>x</b></p><div><i>y</i></div>" * rows + "<ul><li>a</ul>")
        b = html_text.parse("<h2>t</h2>" + "<div><b>x</b></div><p><i>y</i></p>" * (rows // 2) + "<ul><li>b</ul>")
        pairs = []
        html_text.align(a, b, pairs)
        assert any(x.tag == "li" and y.tag == "li" for x, y in pairs)
    deep = lambda x: html_text.parse("<div>" * 400 + f"<p>{x}</p><ul><li>z</ul>" + "</div>" * 400)
    pairs = []
    assert html_text.align(deep("a"), deep("b"), pairs) == 404


def test_wrapper_finds_the_content_without_any_marks(spark):
    """Elements and classes that speak for themselves made plain: what the pages of a host share tells the content."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer|header|aside|main|form)(?=[ >])", "<$1div"), ' class="[^"]*"', ""))
    texts = lambda df: {r["page_id"]: r["text"] for r in df.collect()}
    want, got = texts(html_text.extract(pages)), texts(html_text.extract(plain))
    assert got == want and all(want.values())
    # without a host nothing is learned, and the prior alone takes the whole page
    alone = texts(html_text.extract(plain.withColumn("url", F.lit(None).cast("string"))))
    assert all(len(alone[k]) > len(want[k]) for k in want)


def test_class_words_do_not_drop_article_text():
    page = "<article><h1>T</h1><p class='share price'>one</p><p class='related-work'>two</p><div id='header-2'>three</div><section class='login-history'>four</section><math>a+b</math> <object>seen</object><xmp>5 < 6</xmp><div class='ads'>no</div></article>"
    assert text_of(page) == "T\none\ntwo\nthree\nfour\na+b seen5 < 6"
    assert text_of("<body><div class='login'>no</div><div id='header-2'>no</div><p>yes</p></body>") == "yes"


def test_wrapper_takes_odd_pages_and_columns(spark):
    page = lambda i: f"<body><div>Top of it</div><div><p>Story {i} of things</p></div></body>"
    rows = [(i, f"https://a.example.com/{i}", page(i)) for i in range(9)] + [(20, "https://a.example.com/n", None), (21, "https://a.example.com/m", None), (22, "https://a.example.com/l", "<body><div>Top of it</div><div>" + "<p>word</p>" * 30_000 + "<div>" * 3000 + "deep</body>"), (3, "https://a.example.com/3", page(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "n_chars", "refs", "at", "__0"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "host", "refs", "at", "__0", "text", "n_chars"]
    out = sorted(((r["page_id"], r["text"][:18], r["n_chars"]) for r in got.collect()))
    assert out[:2] == [(0, "Story 0 of things", 17), (1, "Story 1 of things", 17)] and [r[0] for r in out].count(3) == 2
    assert out[-3][1:] == out[-2][1:] == ("", 0) or [r[1:] for r in out if r[0] in (20, 21)] == [("", 0)] * 2
    assert [r[2] for r in out if r[0] == 22] == [30_000 * 5 + 4]


# line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.33:
            out.insert(i, rng.choice(letters))
        elif kind < 0.66 and len(out) > 1:
            out.pop(i)
        else:
            out[i] = rng.choice(letters)
    return "".join(out)


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(4000):
        k = rng.randint(1, 3)
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        b = changed(rng, a, rng.randint(0, 4), "abc") if rng.random() < 0.8 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        assert lines.within(a, b, k) == (distance(a, b) <= k)


def spark_hash(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return value - (value >= 2**63) * 2**64


def dedup_by_force(docs, min_chars, tau, exact_chars=None):
    """Lines from exact_chars on that are shorter than min_chars go where an earlier one equals them."""
    seen, short, out = [], set(), {}
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]))):
        if (d, t) in out:
            continue
        keep = []
        for raw in [] if t is None else t.split("\n"):
            x = raw.strip()
            gone = len(x) >= min_chars and any(abs(len(x) - len(y)) <= tau and distance(x, y) <= tau for y in seen)
            if len(x) >= min_chars:
                seen.append(x)
            elif exact_chars is not None and len(x) >= exact_chars:
                gone = x in short
                short.add(x)
            if not gone:
                keep.append(raw)
        out[d, t] = None if t is None else "\n".join(keep)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(30, 45))) for _ in range(12)]
    docs = []
    for d in range(40):
        own = [changed(rng, rng.choice(base), rng.randint(0, 4), "abcdef") if rng.random() < 0.7 else "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 6))]
        docs.append((d, "\n".join(own)))
    docs += [(None, base[0]), (50, None), (51, ""), (5, docs[5][1]), (6, base[1]), (99, "\n".join([base[2]] * 50))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    want = dedup_by_force(docs, lines.MIN_CHARS, lines.TAU)
    got = lines.dedup(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert left == sorted(((d, want[d, t]) for d, t in docs), key=repr)
    assert lines.dedup(df.limit(0)).count() == 0 and lines.dedup(odd(spark)).count() == len(ODD)


def test_line_dedup_blocks_of_a_crowded_segment(spark, monkeypatch):
    """Lines that share a segment but aren't near its first one are still compared with all others, in blocks."""
    monkeypatch.setattr(lines, "BLOCK", 3)
    rng = random.Random(1)
    tails = ["".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(9)]
    docs = [(i, "x" * 15 + t) for i, t in enumerate(tails)] + [(20 + i, "x" * 15 + t[:-1] + "Z") for i, t in enumerate(tails)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [d for d, t in got.items() if not t] and sorted(d for d, t in got.items() if not t) == [20 + i for i in range(9)]


def test_line_dedup_drops_exact_repeats_of_short_lines(spark):
    long = "A line that is long enough for the edit join"
    docs = [(1, f"Les.\nLet.\nab\n\n{long}"), (2, f"  Les. \nab\n\nNew.\n{long}!"), (3, "Les.\nLes.\nabc\nab"), (4, "abc")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 5, 0), 2: ("ab\n\nNew.", 5, 2), 3: ("abc\nab", 4, 2), 4: ("", 1, 1)}


# decontamination


def test_nearest_distance():
    rng = random.Random(6)
    for _ in range(1500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        want = min(distance(p, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1))
        assert decontaminate.nearest(decontaminate.masks(p), len(p), t) == want


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 20)))) for i in range(15)] + [(90, ""), (91, None), (92, "short one"), (93, items_text := "Some Longer item text to find here")]
    docs = [(i, " ".join(word() for _ in range(20)) + " " + changed(rng, rng.choice(items[:15])[1], rng.randint(0, 14), "abc ") + " " + word()) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "Short  ONE"), (73, "a short one b"), (74, "xx " + items_text.upper().replace(" ", "\n ") + " yy"), (75, items_text * 400)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("errors", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["errors"] for r in decontaminate.find(d, it).collect()}
    assert got == {(r["doc_id"], r["item_id"]): r["errors"] for r in decontaminate.find(d, it, block_chars=100).collect()}
    want = {}
    for doc, t in docs:
        for i, x in items:
            p, f = decontaminate.folded(x or ""), decontaminate.folded(t or "")
            if 0 < len(p) < decontaminate.SHORT:
                if p == f:
                    want[doc, i] = 0
            elif p:
                best = decontaminate.nearest(decontaminate.masks(p), len(p), f)
                if best <= decontaminate.budget(p):
                    want[doc, i] = best
    assert got == want and len({e for e in want.values()}) > 3
    clean = {r["doc_id"] for r in decontaminate.clean(d, it).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in want}
    assert decontaminate.find(d.limit(0), it).count() == 0 and decontaminate.find(d, it.limit(0)).count() == 0
    assert decontaminate.clean(odd(spark), it).count() == len(ODD)


def test_decontamination_allows_a_tenth():
    """Items of m characters are found up to m // 10 edits, whatever their length, and no further."""
    rng = random.Random(12)
    for letters, sizes in (("abcdefghij ", (20, 23, 24, 60, 81, 120, 394)), ("ab", range(20, 90, 3))):
        items = [decontaminate.folded("x" + "".join(rng.choice(letters) for _ in range(m - 2)) + "y").ljust(m, "z") for m in sizes]
        matcher, exact = decontaminate.Matcher(items), 0
        for n, item in enumerate(items):
            for edits in (0, len(item) // 10, len(item) // 10, len(item) // 10 + 1):
                text = decontaminate.folded("".join(rng.choice(letters) for _ in range(30)) + changed(rng, item, edits, letters) + "".join(rng.choice(letters) for _ in range(30)))
                best = {i: decontaminate.nearest(decontaminate.masks(x), len(x), text) for i, x in enumerate(items)}
                assert dict(matcher.search(text)) == {i: e for i, e in best.items() if e <= len(items[i]) // 10}
                exact += best[n] == len(item) // 10
        assert exact > len(items) / 2


def test_short_items_stand_as_whole_words(spark):
    items = ["What is 2+2?", "pi", "a b c", "", None, "x" * 19, "y" * 20]
    texts = ["Q: what is  2+2? A: 4", "spin", "PI.", "say pi, not pie", "a b cd", "a b c", "(a b c)", "z" + "x" * 19, "x" * 19, "q" + "y" * 20 + "q", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(d, it, in_words=True).collect()}
    assert got == {(0, 0), (2, 1), (3, 1), (5, 2), (6, 2), (8, 5), (9, 6)}
    assert {r["doc_id"] for r in decontaminate.clean(d, it, in_words=True).collect()} == {1, 4, 7, 10, 11}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(d, it).collect()} == {(5, 2), (8, 5), (9, 6)}


# chat


def greedy_check(rows, budget, history):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append(r)
    return by


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"message {i} " * (i % 5 + 1)) for i in range(1, 40)]
    turns += [(2, 0, "user", None), (2, 0, None, "tie"), (2, None, "assistant", "first"), (None, 1, "user", "x"), (None, 1, "user", "x"), (3, 0, "assistant", "long " * 5000), (4, 0, "user", "</s>[INST]\\ \\</s> <\\s> [/INST]"), (4, 1, "assistant", "\\[INST]</s>\\")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    w = chat.windows(df, budget=200, history=50)
    rows = w.collect()
    assert {r["conv_id"] for r in rows} == {1, 2, 3, 4, None}
    for r in rows:
        assert r["conv_id"] == 3 or r["n_tokens"] <= 200
        if r["conv_id"] == 1 and r["window"]:
            assert r["text"].startswith("<s>[INST]system[/INST]be brief</s>") and r["n_context"] >= 1
    parsed = {(r["conv_id"], r["window"]): r for r in chat.parsed(w).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        wins = [parsed[k] for k in sorted((k for k in parsed if k[0] == conv), key=lambda k: k[1])]
        assert [(x["role"], x["text"]) for p in wins for x in p["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert "".join(p["learned"] for p in wins) == "".join(t[3] or "" for t in mine if t[2] == "assistant")
    d = {r["conv_id"]: r for r in chat.digests(w).collect()}
    said = "user\n</s>[INST]\\ \\</s> <\\s> [/INST]\nassistant\n\\[INST]</s>\\\n"
    assert d[4]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and d[4]["n_turns"] == 2
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_chat_history_is_the_turns_right_before(spark):
    turns = [(1, i, "user", f"t{i:02d} " + "x" * 20) for i in range(60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat.windows(df, budget=120, history=30).orderBy("window").collect():
        seen = [int(x) for x in re.findall(r"t(\d\d) ", r["text"])]
        assert seen == list(range(seen[0], seen[0] + len(seen))) and (r["window"] == 0) == (r["n_context"] == 0)


# near duplicates


def sets_of(text, width):
    w = re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    w = [x for x in w if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups_by_force(docs, width, percent):
    nodes = [(d, sets_of(t, width)) for d, t in docs]
    low = {d: d for d, _ in docs if d is not None}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (a, s) in enumerate(nodes):
        for b, t in nodes[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {d: root(d) for d in low}


def test_shingles_equal_the_definition():
    texts = ["", "  ", "a", "A\tb\x0bc", "one two three four", "One  two three FOUR five", "x " * 30, "é É ß\u00a0x y z", LONG]
    for width in (1, 4, 5):
        s = neardup.Shingler(width).sets(texts)
        assert [len(x) for x in s] == [len(sets_of(t, width)) for t in texts]
    s = neardup.Shingler(4).sets(["a b c d e", "A B c\nd e", "b a c d e"])
    assert (s[0] == s[1]).all() and len(np.intersect1d(s[0], s[2])) == 0


@pytest.mark.parametrize("block", [1024, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    docs, d = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([2, 5, 9, 30, 90, 150, 400]))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(4000)}"
            docs.append((d := d + 1, " ".join(own)))
    docs += [(500, None), (501, ""), (502, None), (503, "Solo"), (504, "solo "), (None, docs[0][1]), (None, docs[0][1]), (3, docs[2][1]), (4, docs[60][1]), (80, docs[9][1]), (80, docs[30][1])]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    want = groups_by_force(docs, 4, 80)
    # an id that has two texts links them
    out = neardup.near_duplicates(df, width=4)
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.near_duplicates(odd(spark)).count() == len(ODD)


def test_threshold_is_inclusive(spark):
    words = [f"w{i}" for i in range(13)]  # 10 shingles; without the last word 9, 9 of 10; with two changed ends 8 of 10
    docs = [(1, " ".join(words)), (2, " ".join(words[:11])), (3, " ".join(words[:10]))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()}
    assert got == {1: 1, 2: 1, 3: 1}  # 8 of 10, and 7 of 8
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame([docs[0], docs[2]], "doc_id long, text string"), width=4).collect()}
    assert got == {1: 1, 3: 3}  # 7 of 10


def test_estimate_is_near_the_jaccard():
    rng = np.random.default_rng(0)
    for n in (90, 400, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.unique(x[: int(n * 0.9)]), np.unique(x[int(n * 0.1) :])
        got = neardup.estimate(neardup.sketch_large(a), neardup.sketch_large(b), len(a), len(b))
        assert abs(float(got) - 0.8) < 0.12


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (10, 9), (9, 10), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 10: 9} | {101 + i: 100 for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# personal data


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_by_force(text):
    out = []
    for kind, p in zip(pii.KINDS, PATTERNS, strict=True):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_patterns_equal_the_definition(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a@.1+- (9)\n_%b") for _ in range(rng.randint(0, 45))) for _ in range(6000)]
    texts += ["4539 1488 0343 6467", "x 4539148803436467y", "a@b.com_c@d.org", "1.2.3.4.5.6.7.8", "é +49 (30) 1234-567 ü", "٣.٣.٣.٣"]
    for t in texts:
        assert pii.written(pii.base_spans(list(pii.hinted_lines(t)))) == base_by_force(t), t
    long = "1" * 300_000 + " " + "a" * 300_000 + "@"
    assert pii.base_spans(list(pii.hinted_lines(long))) == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:200])] + [(999, None), (999, None)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = pii.detect(df, pii.fit(df))
    assert got.count() == 202 and got.columns.count("spans") == 1
    for r in got.collect():
        want = base_by_force(r["text"] or "")
        assert r["base_spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii.fit(df.limit(0)) is None and pii.detect(odd(spark), None).count() == len(ODD)
    assert pii.redact("mail a@b.co now", "email:5:11") == "mail [email] now"


def test_field_adds_a_repeated_number_without_its_sign(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.fit(docs)
    text = "Call +1 (974) 555-3436 now.\nwords here\nOr ring (974) 555-3436 later. And 12 apples"
    found = list(pii.hinted_lines(text))
    assert pii.added_spans(field, [(found, pii.base_spans(found))], [text]) == [[(3, 47, 61)]]
    alone = "Or ring 12 apples"
    found = list(pii.hinted_lines(alone))
    assert pii.added_spans(field, [(found, pii.base_spans(found))], [alone]) == [[]]


def test_messages_are_exact_on_a_chain():
    """Loopy messages on a chain give the true marginals."""
    g = pii.Graph()
    g.add(0, [(0, "1 22 333 4444")], [])
    rng = np.random.default_rng(1)
    f = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)), np.zeros((5, 5)))
    g.skip = []
    got = f.marginals(g, rounds=400, tolerance=1e-12)
    pot = g.matrix() @ f.node
    total = np.zeros((4, 5))
    import itertools

    for ys in itertools.product(range(5), repeat=4):
        w = np.exp(sum(pot[i, y] for i, y in enumerate(ys)) + sum(f.chain[a, b] for a, b in zip(ys, ys[1:], strict=False)))
        for i, y in enumerate(ys):
            total[i, y] += w
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-5)


def test_messages_are_near_exact_on_a_loop():
    """A word far back joined to two others closes a loop; with moderate weights loopy marginals stay near the true ones, and take the same label."""
    import itertools

    rng = np.random.default_rng(4)
    worst = 0
    for _ in range(20):
        g = pii.Graph()
        g.add(0, [(0, "5551234 22 5551234")], [])
        assert g.skip == [(0, 2)] and len(g.chain) == 2
        half = rng.normal(size=(5, 5)) * 0.5
        f = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)) * 0.5, half + half.T)
        got, pot = f.marginals(g, rounds=400, tolerance=1e-12), g.matrix() @ f.node
        total = np.zeros((3, 5))
        for y in itertools.product(range(5), repeat=3):
            w = np.exp(sum(pot[i, k] for i, k in enumerate(y)) + f.chain[y[0], y[1]] + f.chain[y[1], y[2]] + f.skip[y[0], y[2]])
            for i, k in enumerate(y):
                total[i, k] += w
        true = total / total.sum(axis=1, keepdims=True)
        worst = max(worst, np.abs(got - true).max())
    assert worst < 0.1


def test_skip_edges_carry_labels(spark):
    """Ablation: later mentions that no pattern finds are labelled through skip edges, and not without them."""
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    bare = pii.Field(field.node, field.chain, np.zeros_like(field.skip))

    def added(f, text):
        found = list(pii.hinted_lines(text))
        return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(f, [(found, pii.base_spans(found))], [text])[0]]

    text = "Call +1 974 555 3436 now.\nA hundred words on.\nThat was 19745553436 again\nor order 88123456 and 12 apples"
    far = "mail jo.doe@example.com now.\nlater on\nask jo.doe@example about it\nnot ann@example"
    number = "Ring +49301234567 at noon\nwords\nor 0301234567 at night, in 2024"
    assert added(field, number) == [("phone", "0301234567")] and added(bare, number) == []
    assert ("email", "jo.doe@example") in added(field, far) and ("email", "jo.doe@example") not in added(bare, far)
    assert all("88123456" not in t and "apples" not in t for _, t in added(field, text))


# exact top-k


def best_by_force(vecs, k, scale=1024):
    use = {i: [int(np.floor(scale * x)) for x in v] for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in use.items():
        if q % 100 == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in use.items() if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(score[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(3)
    vecs = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.7]) for _ in range(24)]) for i in range(900)]
    vecs += [(1000, None), (1001, []), (1002, [None] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] * 24), (1100, [0.5, 0.5]), (1101, [0.25, 1.0]), (None, [1.0] * 24), (1200, [1e9] * 24)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).repartition(3)
    for kw in ({}, {"block_bytes": 400}):
        got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, **kw).collect())
        assert got == best_by_force(vecs, 10)
    few = df.filter("vec_id < 4 OR vec_id = 100")
    assert topk.search(few, F.col("vec_id") == 100, k=10).count() == 4
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_large_values(spark):
    """Sums beyond doubles and beyond longs: exact up to a long's range, held at its ends behind it."""
    big = [(0, [1e9, 3.0, 0.5]), (1, [1e9, -3.0, 1e5]), (2, [1.5e300, 1.0, 1.0]), (3, [-1e308, 1.0, 1.0]), (4, [2.0**53, 1.0, 1.0]), (100, [1e-3, 0.25, 2.0]), (101, [0.5, 0.5, 0.5]), (200, [1.7e308, 0.0, 0.0]), (102, [0.5, 0.5, 0.5])]
    low, high = -(2**63), 2**63 - 1
    use = {i: [int(x) * 1024 if abs(x) >= 2.0**53 else int(np.floor(x * 1024)) for x in v] for i, v in big}
    want = []
    for q in (0, 100, 200):
        score = sorted((-max(low, min(high, sum(a * b for a, b in zip(use[q], v, strict=True)))), i) for i, v in use.items() if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(score[:4], 1)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>").repartition(2)
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, k=4).collect()) == sorted(want)


def test_max_score_skips_work():
    rng = np.random.default_rng(0)
    scale = np.concatenate([np.full(8, 50.0), np.full(56, 1.0)])
    q = np.round(rng.normal(size=64) * scale)
    block = topk.Block(np.array([0]), np.array([-1]), q[None, :])
    block.start(10)
    mats = [np.round(rng.normal(size=(2000, 64)) * scale) for _ in range(5)]
    for n, m in enumerate(mats):
        block.offer(np.arange(n * 2000, n * 2000 + 2000), m)
    assert block.scored < 0.6 * 10_000 * 64
    score = np.concatenate(mats) @ q
    order = np.lexsort((np.arange(len(score)), -score))[:10]
    assert (block.best[0][1] == order).all()


# plumbing


def test_slices_cover_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": pa.array([None, "x" * 10, "", "y" * 50, "z"]), "b": pa.array(range(5))})
    for limit in (1, 12, 1000):
        parts = list(slices(batch, limit))
        assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in slices(batch.slice(0, 0), 5)] == [0]
