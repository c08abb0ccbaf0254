"""Words, language, quality, quality rules and page text against plain Python and held-out labels."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest_llm import MESSY, SCHEMA, held, make, words
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import htmltext, kernel, langid, linefreq, quality

SPACES = " \t\n\x0b\x0c\r"
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é漢\x85\t\n\x0b \x00", max_size=30)), max_size=8)


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(some):
    data, offsets = kernel.strings(pa.array(some, pa.string()))
    found, hashes = [], {}
    for a, b in kernel.slices(offsets, 16):
        w = kernel.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k in range(b - a):
            own = [bytes(w.data[s:e]).decode() for s, e in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])]
            found.append(own)
            for word, h in zip(own, w.hash[w.first[k] : w.first[k + 1]].tolist(), strict=True):
                assert hashes.setdefault(word, h) == h
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert found == [split((t or "").translate(low)) for t in some]
    assert len(set(hashes.values())) == len(hashes)


def test_slices_cover_all_texts_whole():
    offsets = np.array([0, 5, 5, 100, 101, 130])
    assert list(kernel.slices(offsets, 20)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


# language


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.predict(docs, *langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in got)
    test = [r for r in got if r["held_out"]]
    assert len(test) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.95


def test_a_bounded_sample_teaches_as_well(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, prototypes = langid.learn(docs, sample=10)
    got = langid.predict(docs, langs, prototypes).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


def test_held_out_languages_are_not_learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.withColumn("lang", langid.F.when(langid.held_out(), "zz").otherwise(langid.F.col("lang")))
    a, b = langid.learn(docs), langid.learn(other)
    assert a[0] == b[0] and np.allclose(a[1], b[1])


def test_language_of_messy_rows(messy, nothing):
    model = langid.learn(messy)
    got = {r["doc_id"]: r for r in langid.predict(messy, *model).collect()}
    for k in (1, 2, 3, 9):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
    assert got[7]["lang_pred"] in ("de", "en", "fr") and got[None]["held_out"] is False
    assert langid.predict(nothing, *model).count() == 0
    none = langid.learn(nothing)
    assert none[0] == [] and {r["lang_pred"] for r in langid.predict(messy, *none).collect()} == {"und"}


def test_bundles_do_not_depend_on_company():
    e = langid.Encoder(dimensions=64)
    own, n = e.bundle(["the cat", None, "", "42"])
    alone, _ = langid.Encoder(dimensions=64).bundle(["the cat"])
    assert np.array_equal(own[0], alone[0]) and n.tolist() == [7, 0, 0, 0]
    assert np.array_equal(own[0], brute_bundle(e, "the cat"))


def brute_bundle(e, text):
    """The sum of bound and rotated letter vectors, one trigram after another."""
    code, total = [0], np.zeros(e.dimensions, dtype=int)
    for c in text:
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or code[-1]:
            code.append(x)
    code += [0] if code[-1] else []
    for gram in zip(code, code[1:], code[2:], strict=False):
        v = np.ones(e.dimensions, dtype=int)
        for place, x in enumerate(gram):
            v *= np.roll(e.letters(np.array([x])).astype(int)[0], 2 - place)
        total += v
    return total


@pytest.mark.parametrize("dense", [1 << 24, 1])
def test_bundles_equal_plain_python(monkeypatch, dense):
    monkeypatch.setattr(langid, "_DENSE", dense)
    e = langid.Encoder(dimensions=64)
    texts = ["A b", "漢字かな交じり文", "𐐀𐐁𐐂 𠀀𠀁𠀂𠀃", "Ünï 42 cödé--x", "ﬀ ſ", "z" * 50]
    got, n = e.bundle(texts)
    for t, own, count in zip(texts, got, n, strict=True):
        assert np.array_equal(own, brute_bundle(e, t)) and count > 0


def test_letters_of_all_planes_have_vectors_of_their_own():
    e = langid.Encoder()
    codes = np.array([ord(c) for c in "aåж漢字𐐨𠀀𠀁"] + list(range(0x4E00, 0x4E00 + 600)))
    v = e.letters(np.unique(codes)).astype(int)
    cosine = v @ v.T / e.dimensions
    assert np.abs(cosine - np.eye(len(v))).max() < 0.3


def test_predictions_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12)
    langs, prototypes = langid.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    e = langid.Encoder()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.predict(docs, langs, prototypes).collect():
        v = brute_bundle(e, text[r["doc_id"]]).astype(float)
        cosine = prototypes @ v / max(np.linalg.norm(v), 1e-9)
        want = ("und", 0.0) if not v.any() else (langs[int(cosine.argmax())], min(1.0, max(0.0, cosine.max())))
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-5


# quality


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(got) > 60 and auc > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_risk_needs_no_negative_labels():
    rng = np.random.default_rng(3)
    positive, negative = rng.normal(2, 1, (800, 2)), rng.normal(-2, 1, (800, 2))
    unlabelled = np.concatenate([rng.normal(2, 1, (900, 2)), rng.normal(-2, 1, (2100, 2))])
    model = quality.fit(positive, unlabelled, 0.3)
    assert (model.score(rng.normal(2, 1, (500, 2))) > 0.5).mean() > 0.9 and (model.score(negative) < 0.5).mean() > 0.9


def test_the_prior_is_found_without_negatives():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.85):
        positive = rng.normal(2, 1, (3000, 2))
        unlabelled = np.concatenate([rng.normal(2, 1, (int(6000 * share), 2)), rng.normal(-2, 1, (6000 - int(6000 * share), 2))])
        rng.shuffle(unlabelled)
        assert abs(quality.estimated_prior(positive, unlabelled) - share) < 0.09


def test_scores_and_risk_equal_plain_python():
    some = [None, "", "Good plain text of some words. And more of them here.", "###| 1 2 3 |###\n###| 1 2 3 |###", "one two three four five one two three four five"]
    x = quality.features(pa.array(some))
    for own, text in zip(x, some, strict=True):
        t, w = text or "", split(text)
        size, one = max(1, len(t.encode())), max(1, len(w))
        lines = [y for y in t.split("\n") if y]
        n, _, _, _, inside = base(t)
        plain = [math.log1p(n), size / one, inside / one, len(set(w)) / one, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(y[0].isascii() and y[0].isupper() for y in w) / one]
        plain += [sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) / size, sum(c in "abcdefghijklmnopqrstuvwxyz" for c in t) / size]
        assert np.allclose(own[: len(plain)], plain)
    rng = np.random.default_rng(1)
    p, u, prior = rng.normal(1, 1, (60, 3)), rng.normal(0, 1.4, (200, 3)), 0.4

    def risk(m):
        def f(row):
            return m.bias + sum(m.weights[int(np.searchsorted(e, v)) + k * (quality.BINS + 1)] for k, (e, v) in enumerate(zip(m.edges, row, strict=True)))

        def loss(z):
            return math.log1p(math.exp(-z))

        fp, fu = [f(r) for r in p], [f(r) for r in u]
        return prior * np.mean([loss(z) for z in fp]) + max(0.0, np.mean([loss(-z) for z in fu]) - prior * np.mean([loss(-z) for z in fp])), fp

    first, best = quality.fit(p, u, prior, steps=0), quality.fit(p, u, prior)
    low, f = risk(best)
    assert low < risk(first)[0] - 0.05
    assert np.allclose(best.score(p), [1 / (1 + math.exp(-z)) for z in f])


def test_quality_without_labels_and_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, 0, 0, "x"), (None, 1, 0, "x"), (12, None, None, "x"), (11, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = quality.learn(messy, labels)
    got = quality.score(messy, model).collect()
    assert len(got) == len(MESSY) and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 8]
    assert same[0] == same[1]
    assert quality.score(nothing, model).count() == 0
    assert quality.learn(messy, labels.limit(0)) is None and quality.learn(nothing, labels) is None
    assert {r["score"] for r in quality.score(messy, None).collect()} == {0.5}


def test_features_do_not_depend_on_slices(monkeypatch):
    some = [None, "", "A b c.\nA b c.", "x" * 50, " ", "één | twee\n\n###", "w " * 40]
    whole = quality.features(pa.array(some))
    monkeypatch.setattr(kernel, "SLICE", 8)
    assert np.allclose(whole, np.concatenate([quality.features(pa.array([t], pa.string())) for t in some]))


# quality rules


def base(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def verdicts(rows, limit=10):
    """The contract row by row: lines in more than ``limit`` different documents of a host go."""
    own, holders = [], {}
    for _, t, _, host in rows:
        lines = [(" ".join(split(x)).translate(LOW), len(split(x))) for x in (t or "").split("\n") if split(x)]
        own.append(lines)
        document = frozenset(x for x, _ in lines)
        for x in document:
            holders.setdefault((host or "", x), set()).add(document)
    out = []
    for (_, t, _, host), lines in zip(rows, own, strict=True):
        b = base(t)
        left = b[0] - sum(n for x, n in lines if len(holders[host or "", x]) > limit)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        out.append((*b, failed, not failed and left >= 10 and 100 * left >= 25 * b[0], left))
    return out


def hosts_with_boilerplate():
    rng = random.Random(5)
    rows = []
    for n in range(80):
        lines = [words(rng.randint(1, 12), rng) for _ in range(rng.randint(0, 5))]
        if n % 2:
            lines.insert(rng.randrange(len(lines) + 1), "All rights   RESERVED by the\tsame host")
        if n % 5 == 0:
            lines = ["all rights reserved by the same host"] * 3 + lines[:1]
        rows.append((n, "\n".join(lines), "en", "a" if n % 3 else "b"))
    copy = "\n".join(words(12, rng) for _ in range(4))
    return rows + [(1000 + k, copy, "en", "a") for k in range(40)]


@pytest.mark.parametrize("rows", [hosts_with_boilerplate(), MESSY], ids=["hosts", "messy"])
def test_rules_equal_plain_python(spark, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words"]
    got = linefreq.judged(linefreq.line_stats(spark.createDataFrame(make(rows), SCHEMA))).collect()
    want = [(r[0], *v) for r, v in zip(rows, verdicts(rows), strict=True)]
    assert sorted(map(repr, ((r["doc_id"], *[r[n] for n in names]) for r in got))) == sorted(map(repr, want))
    kept = linefreq.clean(spark.createDataFrame(make(rows), SCHEMA)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(w[0]) for w in want if w[7])
    assert all(len(split(r["text"])) in {w[8] for w in want if w[0] == r["doc_id"]} and r["n_chars"] == len(r["text"]) for r in kept)
    assert rows is MESSY or any(w[8] < w[1] and w[7] for w in want) and any(not w[6] and not w[7] for w in want)


def test_rules_of_copies_and_of_no_rows(spark, nothing):
    rows = [(k, "one line that many copies of a document share\nand another one of them here", "en", "a") for k in range(60)]
    assert linefreq.clean(spark.createDataFrame(make(rows), SCHEMA)).count() == 60
    assert linefreq.judged(linefreq.line_stats(nothing)).count() == 0 and linefreq.clean(nothing).columns == nothing.columns


def test_lines_of_one_template_do_not_hide_each_other(spark):
    rng = random.Random(8)
    top, end = "the header that all pages of this host share", "all rights are reserved by some other company"
    rows = [(k, f"{top}\n{words(20, rng)}\n{end}", "en", "a") for k in range(15)] + [(100 + k, f"{top}\n{words(20, rng)}\n{end}", "en", "b") for k in range(10)]
    rows += [(200 + k, rows[15][1], "en", "b") for k in range(30)]
    kept = {r["doc_id"]: r["text"] for r in linefreq.clean(spark.createDataFrame(make(rows), SCHEMA)).collect()}
    assert kept == {i: t.split("\n")[1] if i < 100 else t for i, t, *_ in rows}


def test_a_block_of_lines_counts_every_document(spark):
    rng = random.Random(12)
    block = [words(12, rng, 10**6) for _ in range(5)]
    rows = [(k, "\n".join([*block, words(60, rng)]), "en", "a") for k in range(1000)]
    stats = linefreq.line_stats(spark.createDataFrame(make(rows), SCHEMA))
    counts = [linefreq.boilerplate(stats, limit).count() for limit in (10, 999, 1000)]
    assert counts == [5, 5, 0]
    got = linefreq.judged(stats).collect()
    assert all(r["kept_words"] == 60 and r["kept"] for r in got)


# pages

LONG = "Here is a sentence of the article that is long enough to be a surge of text, and then some more of it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("plain text &amp; no markup", "plain text & no markup"),
        (f"<nav><a>Home</a></nav><article><h1>T &#233;</h1><p>a\n <b>b</b>\tc</p></article><footer>f</footer>", "T é\na b c"),
        (f"<body><div class='menu'><p>Home</p></div><div><p>{LONG}</p><p>Short.</p></div><div id='sidebar'><p>{LONG}</p></div></body>", f"{LONG}\nShort."),
        (f"<article><p>x</p><aside>no</aside><p>y</p><div class='comments'><p>no</p></div></article>", "x\ny"),
        (f"<article><p>one<p>two<br>lines</article><form><p>{LONG}</p></form>", "one\ntwo lines"),
        ("<article><p>cut <b>off", "cut off"),
        ("<article><p>a < b and c > d</p><script>if (a<b) x='</p>'</script></article>", "a < b and c > d"),
        (f"<main><p>{'word ' * 50_000}</p></main>", ("word " * 50_000).strip()),
        ("<article><p>un<!-- x -->believ<script>1</script>able</p></article>", "unbelievable"),
        (f"<article><p title='{'a' * 5000}>LEAK'>{LONG}</p></article>", LONG),
        ("<article><p>Let <math><mi>x</mi></math> be</p><object>in place</object></article>", "Let x be\nin place"),
        ("<article><p class='ad-free'>keep</p><p class='social-history'>this</p><p class='ad'>not this</p></article>", "keep\nthis"),
        (f"<body><nav>m</nav><div class='entry-header'><h1>Headline</h1></div><div class='entry-content'><p>{LONG}</p></div><div class='sidebar'>{LONG}</div></body>", f"Headline\n{LONG}"),
        (f"<body><p>First.</p><div class='ad'>{LONG}</div><p>{LONG}</p><div class='ad-slot'>Buy</div><p>Last.</p><div id='comments'><p>{LONG}</p></div></body>", f"First.\n{LONG}\nLast."),
        (f"<body><form id='all'><div class='menu'><a>x</a></div><div id='content'><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"{LONG}\n{LONG}"),
        (f"<body><div class='top'>Call us</div><div class='text'><p>{LONG}</p><p>ok</p></div><div class='bottom'>All rights</div></body>", f"{LONG}\nok"),
        (f"<article><p>a</p><div><a>related</a></div><div class='x'><a>link</a></div></article><article><p>{LONG}</p></article>", f"a\nrelated\n{LONG}"),
        (f"<body><article><a>teaser</a></article><div class='story'><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
        (f"<div><nav><ul><li>menu<article><p>{LONG}</p></article></div>", LONG),
        ("<article><p>text <span class='ad'>no</span> more</p><p>end <a href=\"cut", "text more\nend"),
        (f"<article><p>b<p class=promo>no<div>c</div><aside>{LONG}</aside></article>", "b\nc"),
    ],
)
def test_page(page, want):
    assert htmltext.extract(page) == want


class Blocks(HTMLParser):
    """Blocks of the articles of a page, by a parser and a list of what is none of theirs."""

    def __init__(self):
        super().__init__()
        self.out, self.part, self.stack = [], [], []

    def handle_starttag(self, tag, attrs):
        self.end(tag)
        if tag not in ("br", "img", "meta", "link", "hr", "input"):
            self.stack.append((tag, dict(attrs).get("class") or ""))
        if tag == "br":
            self.part.append(" ")

    def handle_endtag(self, tag):
        self.end(tag)
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def end(self, tag):
        if tag in ("p", "h1", "h2", "h3", "div", "li", "ul", "article", "aside", "nav", "footer", "section", "table", "tr", "td", "blockquote", "body"):
            text = " ".join("".join(self.part).split())
            self.part = []
            if text:
                self.out.append(text)

    def handle_data(self, data):
        names = {t for t, _ in self.stack}
        if names & {"article", "main"} and not names & {"nav", "aside", "footer", "form", "script", "style"} and not any(c in ("ad", "ads", "comments", "sidebar", "promo") for _, c in self.stack):
            self.part.append(data)


def test_pages_equal_a_parsers():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        own = Blocks()
        own.feed(page)
        own.end("body")
        assert htmltext.extract(page) == "\n".join(own.out)


def test_regions():
    assert htmltext.regions([0, 0, 90, 5, 0, 0, 0, 3, 0, 0, 0, 200, 0], window=3, surge=80) == [(0, 4), (9, 12)]
    assert htmltext.regions([0, 4, 0, 0, 0, 9], window=2, surge=80) == [(4, 6)] and htmltext.regions([], 3, 80) == []


@given(st.text(alphabet="<>/ap='\"!-& divscript;#x1", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    out = htmltext.extract(page)
    assert isinstance(out, str) and out == out.strip() and "\n\n" not in out


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("*", "1 as text", "2 as n_chars")
    got = htmltext.main_text(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    rows = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in htmltext.main_text(rows).collect()) == ["", "", "x", "x"] and htmltext.main_text(rows.limit(0)).count() == 0
