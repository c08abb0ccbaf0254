"""Pseudonyms, language-model scores, pieces and the pipeline against plain Python."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import MESSY, SCHEMA, make, words

import corpus_pipeline
from codeloom.llm import kernel, lmscore, pii, sptokens
from codeloom.llm import queries as llm_queries
from codeloom.llm.common import cut


def split(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else d * 2 - (9 if d > 4 else 0)
    return total % 10


def mod97(iban):
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def shape(text):
    return "".join("d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else c for c in text)


# pseudonyms

VALUES = {
    "email": ["jane.doe+x@mail.example.org", "A1@b.co"],
    "card": ["4111 1111 1111 1111", "4644348398010899", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"],
    "ip": ["192.168.1.254", "8.8.8.8"],
    "date": ["2024-02-29", "31.12.1999", "02/28/2023", "28/02/2023"],
    "phone": ["+1 (706) 555-3138", "+49 30 123456", "(212) 555-0100"],
    "ssn": ["123-45-6789"],
}
NOT = ["4111 1111 1111 1112", "2023-02-30", "999.1.1.1", "DE00 3704 0044 0532 0130 00", "000-12-3456", "version 1.2.3", "room 12", "5 @ 6", "3.14159"]


def changed(spark, rows):
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymize(frame).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_validity(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    got = changed(spark, [f"Write to {v}, now." for _, v in flat])
    for (kind, v), text in zip(flat, got, strict=True):
        new = re.fullmatch(r"Write to (.*), now\.", text)[1]
        assert new != v and (kind in ("ip", "date") or shape(new) == shape(v)), (kind, v, new)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new)) == 0 and new[0] == v[0]
        elif kind == "iban":
            assert mod97(new) == 1 and new[:2] == v[:2]
        elif kind == "email":
            assert new.split("@")[1] == v.split("@")[1]
        elif kind == "ip":
            assert all(0 <= int(x) <= 255 for x in new.split(".")) and new.count(".") == 3
        elif kind == "date":
            p = [int(x) for x in re.split(r"\D", new)]
            y = next(x for x in p if x > 99)
            rest = [x for x in p if x != y]
            assert any(valid(y, m, d) for m, d in (rest, rest[::-1]))


def valid(y, m, d):
    try:
        return bool(datetime.date(y, m, d))
    except ValueError:
        return False


def test_what_does_not_validate_stays(spark):
    assert changed(spark, [f"See {v} here" for v in NOT]) == [f"See {v} here" for v in NOT]


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    rng = random.Random(8)
    ips = list({f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)})
    days = [str(datetime.date(1999, 1, 1) + datetime.timedelta(k)) for k in range(400)]
    got = changed(spark, ips + days + [f"{x} and again {x}" for x in ips[:20]])
    assert len(set(got[: len(ips)])) == len(ips) and len(set(got[len(ips) : len(ips) + 400])) == 400
    assert got[len(ips) + 400 :] == [f"{x} and again {x}" for x in got[:20]]


def test_another_key_gives_other_pseudonyms(spark):
    frame = spark.createDataFrame([(1, "to 10.1.2.3 on 2020-05-17")], "doc_id long, text string")
    a, b = (pii.pseudonymize(frame, key).first()["text"] for key in ("one", "two"))
    assert a != b


def plain_pseudonym(x, key=pii.KEY):
    """The pseudonym of one value, in plain Python."""

    def characters(t, k):
        a, b = t[: len(t) // 2], t[len(t) // 2 :]
        for r in range(1, pii.ROUNDS + 1):
            z = hashlib.sha512(f"{k}:{r}:{b}".encode()).hexdigest()
            moved = ""
            for i, c in enumerate(a):
                n = int(z[2 * (i % 64) : 2 * (i % 64) + 2], 16)
                low, size = next(((o, s) for o, s, t in ((48, 10, string.digits), (97, 26, string.ascii_lowercase), (65, 26, string.ascii_uppercase)) if c in t), (0, 0))
                moved += chr(low + (ord(c) - low + n) % size) if size else c
            a, b = b, moved
        return a + b

    def number(n, a, b, k):
        x, y = divmod(n, b)
        for r in range(1, pii.ROUNDS + 1):
            x = (x + int(hashlib.md5(f"{k}:{r}a{y}".encode()).hexdigest()[:12], 16)) % a
            y = (y + int(hashlib.md5(f"{k}:{r}b{x}".encode()).hexdigest()[:12], 16)) % b
        return x * b + y

    def refill(t, digits):
        it = iter(digits)
        return "".join(next(it) if c in string.digits else c for c in t)

    def luhn(t):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(t))) % 10

    def mod97(t):
        return int("".join(str(int(c, 36)) for c in t)) % 97

    def whole(name):
        return re.fullmatch(pii.PATTERNS[name], x, re.A)

    digits = "".join(c for c in x if c in string.digits)
    if "@" in x:
        user, at, rest = x.partition("@")
        return characters(user, key + "email") + at + rest
    if whole("ip"):
        v = number(int.from_bytes(bytes(map(int, x.split("."))), "big"), 65536, 65536, key + "ip")
        return ".".join(map(str, v.to_bytes(4, "big")))
    if whole("date"):
        sep, p = re.search("[-/.]", x)[0], re.split("[-/.]", x)
        day_first = len(p[0]) < 4 and (sep == "." or int(p[0]) > 12) and int(p[1]) <= 12
        o = (0, 1, 2) if len(p[0]) == 4 else (2, 1, 0) if day_first else (2, 0, 1)
        try:
            given = datetime.date(*(int(p[k]) for k in o))
        except ValueError:
            return x
        start = datetime.date(1700, 1, 1)
        new = start + datetime.timedelta(number((given - start).days, pii._DAYS_A, pii._DAYS_B, key + "date"))
        out = ["", "", ""]
        for k, v in zip(o, (new.year, new.month, new.day), strict=True):
            out[k] = str(v).zfill(2) if k != o[0] and (p[k].startswith("0") or len(p[k]) == 2) else str(v)
        return sep.join(out)
    if whole("iban"):
        c = x.replace(" ", "")
        if mod97(c[4:] + c[:4]) != 1:
            return x
        y = characters(c[4:], key + "iban")
        new = iter(c[:2] + str(98 - mod97(y + c[:2] + "00")).zfill(2) + y)
        return "".join(" " if k == " " else next(new) for k in x)
    if whole("ssn"):
        return refill(x, characters(digits, key + "ssn"))
    if whole("card"):
        if luhn(digits):
            return x
        y = digits[0] + characters(digits[1:-1], key + "card")
        return refill(x, y + str((10 - luhn(y + "0")) % 10))
    if whole("phone"):
        k = len("".join(c for c in re.search(r"\+\d{1,3}", x)[0] if c.isdigit())) if x.startswith("+") else 0
        return refill(x, digits[:k] + characters(digits[k:], key + "phone"))
    return x


def test_texts_equal_plain_python(spark):
    rng = random.Random(21)
    kinds = ["a.b+c@mail.example.org", "10.200.3.4", "2020-05-17", "17.05.2020", "5/17/1999", "31.02.2021", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001", "+49 30 1234567", "(555) 123-4567", "555-123-4567", "219-09-9999", "4111 1111 1111 1111", "4111111111111112", "378282246310005", "378282246310006"]
    fill = ["and", "to", "-", "_", "EUR", "12", "x", "\n", "(", ").", ",", "A1B2", "é"]
    texts = [rng.choice(["", " "]).join(rng.choice(kinds if rng.random() < 0.4 else fill) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    got = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), count="n").collect()
    for r in got:
        found = re.findall(f"({pii.ANY})", texts[r["doc_id"]], re.A)
        found = [f if isinstance(f, str) else f[0] for f in found]
        assert r["text"] == re.sub(pii.ANY, lambda m: plain_pseudonym(m[0]), texts[r["doc_id"]], flags=re.A), texts[r["doc_id"]]
        assert r["n"] == sum(plain_pseudonym(f) != f for f in found)
    assert sum(r["n"] for r in got) > 100


@pytest.mark.parametrize("text", ["ES9121000418450200051332 EUR", "ES91 2100 0418 4502 0005 1332 I will", "BE68 5390 0754 7034 2 items", "_john@example.com", "- -bob@example.com", "mail:.x@y.org"])
def test_values_are_found_whatever_stands_beside_them(spark, text):
    r = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), count="n").first()
    assert r["n"] == 1 and len(r["text"]) == len(text)


def test_pseudonyms_of_messy_rows(spark, messy, nothing):
    got = pii.pseudonymize(messy, count="n_replaced")
    assert got.columns == [*messy.columns, "n_replaced"]
    assert sorted(repr((r["doc_id"], r["text"], r["n_chars"], r["n_replaced"])) for r in got.collect()) == sorted(repr((i, t, None if t is None else len(t), 0)) for i, t, *_ in MESSY)
    assert pii.pseudonymize(nothing).count() == 0
    long = "filler " * 30_000 + "a.b@c.de" + " filler" * 30_000
    clash = spark.createDataFrame([(1, long, "kept", "kept too", 5)], "doc_id long, text string, __found string, __new string, n_chars int")
    r = pii.pseudonymize(clash).first()
    assert r["__found"] == "kept" and r["__new"] == "kept too" and r["n_chars"] == len(long) and "a.b@c.de" not in r["text"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# language-model scores


def want_scores(rows):
    own = [split(t) for _, t, *_ in rows]
    one = Counter(w for ws in own for w in ws)
    two = Counter(p for ws in own for p in zip(ws, ws[1:]))
    n = sum(one.values())
    out = []
    for (i, *_), ws in zip(rows, own, strict=True):
        s, mine, pairs = 0.0, Counter(ws), Counter(zip(ws, ws[1:]))
        for k, w in enumerate(ws):
            pair = (ws[k - 1], w)
            if k and two[pair] > pairs[pair]:
                s += math.log((two[pair] - pairs[pair]) / (one[pair[0]] - mine[pair[0]]))
            else:
                s += math.log(max(one[w] - mine[w], 0.5) / max(n - len(ws), 1)) + (math.log(0.4) if k else 0)
        out.append((str(i), len(ws), s))
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 19, 40, 0])
def test_scores_equal_plain_python(spark, most):
    rng = random.Random(6)
    rows = [(n, words(rng.randint(0, 60), rng, 90), "en", "s") for n in range(60)] + MESSY
    got = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in lmscore.score(spark.createDataFrame(make(rows), SCHEMA), most=most).collect())
    for g, w in zip(got, want_scores(rows), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 2e-6 + 1e-9 * abs(w[2])


def test_scores_of_no_rows(nothing):
    assert lmscore.score(nothing).count() == 0


def test_packed_counts_come_back_whole(spark):
    some = [0, 1, 2, 255, 256, 70_000, (1 << 21) - 1, 1 << 21, (1 << 31) - 1]
    three = np.array([(a, b, c) for a in some for b in some for c in some], dtype=np.int64)
    rows = spark.createDataFrame(list(zip(*(x.tolist() for x in lmscore._packed(*three.T)), strict=True)), "low long, high int")
    assert [tuple(r) for r in rows.select(*lmscore._unpacked("low", "high")).collect()] == [tuple(x) for x in three.tolist()]


def test_frequent_keys_are_found():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    f = lmscore._Frequent(keys, np.arange(len(keys)).astype(float))
    at = f.find(keys)
    assert (f.keys[at] == keys).all() and (f.values[at] == np.arange(len(keys))).all() and (f.find(keys + 1) == -1).sum() >= len(keys) - 5
    assert lmscore._Frequent(keys[:0], keys[:0]).find(keys).tolist() == [-1] * len(keys)


# pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sptokens.MODEL)


def test_ids_equal_the_librarys(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in sptokens.encode(docs, sptokens.read_model()).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["ids"] == library.encode(r["text"]) and got[r["doc_id"]]["n_tokens"] == len(got[r["doc_id"]]["ids"])
        assert got[r["doc_id"]]["round_trip"]


def test_odd_texts_equal_the_librarys(library):
    rng = random.Random(12)
    some = ["", " ", "   a  b ", "\n\n x\n", "aaaaaaaaaaaaaaaaaaaa", "日本語 テキスト", "é😀‍\x00\x7f", "x" * 3000, "▁ ▁▁a", "tab\there"]
    some += ["".join(rng.choice("etaoin shrdlu.,\n▁é日") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    pieces = sptokens.Pieces(sptokens.read_model())
    for t, ids in zip(some, pieces.encode(some), strict=True):
        assert np.frombuffer(ids, dtype=np.int32).tolist() == library.encode(t), t
    # a small memory changes nothing
    small = sptokens.Pieces(sptokens.read_model())
    sptokens.REMEMBER, before = 50, sptokens.REMEMBER
    try:
        assert [small.encode([t])[0] for t in some] == pieces.encode(some)
    finally:
        sptokens.REMEMBER = before


def test_sums_are_viterbis(library):
    """The forward pass for unigram models against every segmentation."""
    pieces = sptokens.Pieces(sptokens.read_model(), "unigram")
    pieces.scores = {p: -((hash_of(p) % 97) / 7 + 1) for p in pieces.ids}
    found = dict(pieces.segment(sorted(["▁the", "▁then", "▁thence", "▁to", "▁tone", "▁toner"])))

    def best(w):
        if not w:
            return 0.0
        return max(pieces.scores[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces.scores)

    names = {i: p for p, i in pieces.ids.items()}
    for w, ids in found.items():
        path = [names[i] for i in np.frombuffer(ids, dtype=np.int32).tolist()]
        assert "".join(path) == w and abs(sum(pieces.scores[p] for p in path) - best(w)) < 1e-9


def hash_of(p):
    return int.from_bytes(p.encode()[-4:], "big")


def test_pieces_of_messy_rows_and_back(messy, nothing):
    model = sptokens.read_model()
    tokens = sptokens.encode(messy, model)
    rows = tokens.collect()
    assert len(rows) == len(MESSY) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"] or []) for r in rows)
    back = sptokens.decode(tokens, model).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back))) == sorted(map(repr, ((i, t) for i, t, *_ in MESSY)))
    assert sptokens.encode(nothing, model).count() == 0


def test_a_worker_keeps_one_operators_tables():
    made = []
    for key in ("a", "a", "b", "a"):
        kernel.keep(key, lambda key=key: made.append(key))
    assert made == ["a", "b", "a"]
    kernel.forget()
    kernel.keep("a", lambda: made.append("a"))
    assert len(made) == 4


def test_binary_views():
    some = [np.arange(k, dtype=np.uint64) for k in (0, 3, 1)]
    column = pa.array([b"12345678", *[x.tobytes() for x in some]], pa.binary()).slice(1)
    assert [x.tolist() for x in kernel.blobs(column)] == [x.tolist() for x in some]
    assert kernel.blobs(column.slice(0, 0)) == []


# pipeline and queries


def test_pipeline_equals_its_stages(spark, sf_dir):
    """Each stage's rows against plain Python on what the stage before it has kept."""
    from test_groups import brute_leaks, want_groups
    from test_texts import verdicts

    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, by = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, sf_dir), name)
        assert kept.columns == columns
        by[name] = {r["doc_id"]: r for r in kept.collect()}
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert set(by["quality_rules"]) == {r[0] for r, v in zip(rows, verdicts(rows), strict=True) if v[6]}
    rows = [(k, r["text"]) for k, r in by["quality_rules"].items()]
    groups = want_groups(rows, size=5, percent=80)[1]
    assert set(by["near_duplicates"]) == set(groups.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(k, r["text"]) for k, r in by["near_duplicates"].items()]
    leaks = {i for i, _ in brute_leaks(rows, items)}
    assert set(by["decontamination"]) == {k for k, _ in rows} - leaks
    assert set(by["pseudonyms"]) == set(by["decontamination"])
    assert all(len(r["text"]) == r["n_chars"] for r in by["pseudonyms"].values())
    library = sentencepiece.SentencePieceProcessor(model_file=sptokens.MODEL)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {k: library.encode(r["text"]) for k, r in by["pseudonyms"].items()}


def test_stages_of_messy_rows_and_of_no_rows(spark, sf_dir, messy, nothing):
    for docs, some in ((messy, True), (nothing, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, docs, sf_dir), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = out
        assert (out.count() > 0) == some and out.count() == docs.count()
        # what has no text or hardly a word goes first
        assert not {1, 2, 3, 4, 5, 9, 12} & {r["doc_id"] for r in out.collect()}


@pytest.mark.parametrize("name", sorted(llm_queries.QUERIES))
def test_query(spark, sf_dir, name):
    """Every row of the intended table is there, and SQL agrees where it exists."""
    import duckdb

    df = llm_queries.QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert len(got) == (50 if name.startswith("op10") else 200) or name.startswith("op4")
    if name in llm_queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = con.sql(llm_queries.ORACLES[name])
        order = sorted(df.columns)
        assert order == sorted(want.columns)
        place = [want.columns.index(c) for c in order]
        assert sorted(repr([r[c] for c in order]) for r in got) == sorted(repr([r[k] for k in place]) for r in want.fetchall())
