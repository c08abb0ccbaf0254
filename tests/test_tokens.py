import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions.random import Draws, uniform
from codeloom.functions.text import SPECIAL_TOKENS
from codeloom.functions.text import uniform as uniform_column
from codeloom.operators import tokens


def test_windows(spark):
    def want(n, c):
        return [list(range(n))[max(0, min(a, n - c)) :][:c] for a in range(0, n, c)]

    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 4, 5, 10, 11)], "t array<int>").select("t", tokens.windows(F.col("t"), 5).alias("w"))
    for r in df.collect():
        assert r["w"] == want(len(r["t"]), 5)
    last = spark.createDataFrame([(list(range(11)),)], "t array<int>")
    assert [r["window"] for r in tokens.segment(last, "t", 5).orderBy("w").collect()][-1] == [6, 7, 8, 9, 10]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab<UNK>\n", max_size=300), st.integers(0, 9))
def test_cuts_never_split_a_special_token(code, seed):
    ends = tokens.cut_points(code, Draws(seed, "x"))
    assert ends[-1] == len(code) and ends == sorted(ends)
    for t in SPECIAL_TOKENS:
        at = code.find(t)
        while at >= 0:
            assert not any(at < e < at + len(t) for e in ends)
            at = code.find(t, at + 1)
    assert all(1 <= b - a <= 100 + 8 for a, b in zip([0, *ends], ends) if b > a)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=50), st.sampled_from(SPECIAL_TOKENS))
def test_byte_tokenizer_round_trip(text, token):
    text = text.encode("utf-8", "replace").decode() + token + "x"
    t = tokens.ByteTokenizer()
    ids, ends = t.encode(text)
    assert t.decode(ids) == text and len(ids) == len(ends) and ends[-1] == len(text)


def test_keyed_draws_agree(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", uniform_column(7, "t", F.col("id"))).collect()}
    assert got == {k: uniform(7, "t", k) for k in range(50)}
    picks = [Draws(1, k).weighted([1, 2, 5]) for k in range(4000)]
    assert abs(picks.count(2) / 4000 - 5 / 8) < 0.03


def test_encode_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, "def f(x):\n    return x\n" * (i % 7)) for i in range(40)], "doc_id long, text string")
    a = {r["doc_id"]: r["input_ids"] for r in tokens.encode(docs.coalesce(1), tokens.ByteTokenizer()).collect()}
    b = {r["doc_id"]: r["input_ids"] for r in tokens.encode(docs.repartition(5), tokens.ByteTokenizer()).collect()}
    assert a == b and all(x[-1] == tokens.ByteTokenizer().token_id("<EOS>") for x in a.values())


def test_train_bpe(spark, tmp_path):
    docs = spark.createDataFrame([("low lower lowest newer wider 中文 ①",)] * 30, "text string")
    t = tokens.train_bpe(docs, size=60)
    vocab = t.vocabulary()
    assert [vocab[s] for s in SPECIAL_TOKENS] == list(range(8)) and len(vocab) <= 60
    ids, _ = t.encode("lower low")
    assert t.decode(ids) == "lower low" and len(ids) < 9
    assert t.encode("<UNK>")[0] == [vocab["<UNK>"]]
    tokens.save_tokenizer(t, str(tmp_path))
    assert tokens.load_tokenizer(str(tmp_path / "tokenizer.json")).encode("lower low")[0] == ids


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(f"common words here {'rare' + str(k)}",) for k in range(300)], "text string")
    few = tokens.train_bpe(docs, size=400, most=10).vocabulary()
    assert "common" in few and not any(t.startswith("Ġrare1") for t in few)
    with pytest.raises(ValueError):
        tokens.train_bpe(docs, most=1)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs.withColumn("doc_id", F.monotonically_increasing_id()), tokens.ByteTokenizer()).collect()}
    assert len(counts) == 300 and min(counts.values()) == len("common words here rare0")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aé漢😀<UNK>\n", max_size=60))
def test_tokenizers_give_ends_of_characters(text):
    for t, ids_of in ((tokens.CharTokenizer(), lambda c: 1), (tokens.ByteTokenizer(), lambda c: len(c.encode()))):
        ids, ends = t.encode(text)
        want, at = [], 0
        while at < len(text):
            special = next((x for x in SPECIAL_TOKENS if text.startswith(x, at)), None)
            n = 1 if special else ids_of(text[at])
            want += [at] * (n - 1) + [at + len(special or "x")]
            at = want[-1]
        assert ends == want and t.decode(ids) == text


def test_plain_tokens(spark):
    words = ["abc", "中", "+=", "a1", "7", "Ġif", ""]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, id int")
    assert {r["token"] for r in tokens.plain_tokens(df).collect()} == {"abc", "中", "+=", "Ġif", ""}


def test_totals(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("a", [3]), ("b", [])], "s string, input_ids array<int>")
    assert tokens.token_total(df).first()[0] == 3
    assert {(r["s"], r["n_samples"], r["n_tokens"]) for r in tokens.tokens_by(df, "s", F.size("input_ids")).collect()} == {("a", 2, 3), ("b", 1, 0), (None, 3, 3)}


def test_merges_over_spark_are_those_of_one_process(spark, monkeypatch):
    import random
    from collections import Counter

    from codeloom.operators import merges

    draw = random.Random(5)
    for alphabet, longest in (("ab", 12), ("abcdefgh", 9), ("Ġé漢😀x", 6)):
        counts = Counter("".join(draw.choices(alphabet, k=draw.randint(1, longest))) for _ in range(400))
        counts = {w: n * draw.choice([1, 1, 1, 7, 40]) for w, n in counts.items()} | {"aaaaaaa": 3, "a": 1, "abcabcab": 2}
        want = tokens.merge_pairs(dict(sorted(counts.items())), 150)
        rows = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
        for sample, blob in ((1 << 17, 1 << 18), (40, 64), (2, 500)):
            monkeypatch.setattr(merges, "SAMPLE", sample)
            monkeypatch.setattr(merges, "BLOB", blob)
            assert merges.train(rows, len(counts), 150, SPECIAL_TOKENS) == want


def test_training_takes_every_word_and_holds_few(spark, monkeypatch):
    from codeloom.operators import merges

    docs = spark.createDataFrame([(f"common words {'rare' + str(k)} zq zqzq{k}",) for k in range(200)], "text string")
    want = tokens.train_bpe(docs, size=300).model
    monkeypatch.setattr(merges, "SAMPLE", 20)
    monkeypatch.setattr(tokens, "merge_pairs", lambda *a: pytest.fail("all words came to the driver"))
    assert tokens.train_bpe(docs, size=300).model == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab1'!é ´\n\t\x1c\x85\xa0　́st", max_size=30)), max_size=6))
def test_byte_level_counts_are_those_of_whole_texts(texts):
    import unicodedata
    from collections import Counter

    from tokenizers import pre_tokenizers

    whole = pre_tokenizers.ByteLevel(add_prefix_space=False)
    want = Counter(w for t in texts if t for w, _ in whole.pre_tokenize_str(unicodedata.normalize("NFKC", t)))
    assert tokens.byte_level_counts([*texts, *texts]) == want + want
