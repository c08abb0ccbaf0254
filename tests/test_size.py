"""What keeps the queries within memory and time as tables grow."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import catalogue
from codeloom.functions.batches import BYTES_KEY, int_lists, slices
from codeloom.functions.random import Draws, uniform
from codeloom.functions.text import SPECIAL_TOKENS
from codeloom.operators import fim, predict, tokens
from codeloom.plans.corpus import code_corpus

LONG = "def f(x):\n    return x  # é\n" * 8000


@pytest.fixture
def own_setting(spark):
    before = spark.conf.get(BYTES_KEY, None)
    spark.conf.unset(BYTES_KEY)
    yield
    spark.conf.unset(BYTES_KEY) if before is None else spark.conf.set(BYTES_KEY, before)


def longest_batch(docs) -> int:
    count = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), T.LongType())
    return docs.select(count("text").alias("n")).agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", ["tokenize_only", "lexical_check", "header_strip", "split_round_trip", "fim_func", "predict_echo", "clean_pipeline"])
def test_queries_bound_their_batches_in_bytes(spark, sf_dir, own_setting, name):
    docs = spark.range(0, 40, 1, 1).select("id", F.lit(LONG).alias("text"))
    catalogue.QUERIES[name](spark, sf_dir)
    assert longest_batch(docs) <= 8  # of 220 KB each


def test_operators_bound_their_batches_in_bytes(spark, own_setting):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.lit(LONG).alias("text"))
    for use in (
        lambda: tokens.encode(docs, tokens.ByteTokenizer()),
        lambda: tokens.token_counts(docs, tokens.ByteTokenizer()),
        lambda: fim.samples(docs, tokens.ByteTokenizer()),
        lambda: predict.predict(docs.selectExpr("text as prefix", "text as middle", "text as suffix"), lambda: lambda p: [[x] for x in p]),
    ):
        spark.conf.unset(BYTES_KEY)
        use()
        assert longest_batch(docs) <= 8


def test_session_may_bound_batches_itself(spark, own_setting):
    spark.conf.set(BYTES_KEY, "32m")
    docs = spark.createDataFrame([(k, "ab" * k) for k in range(5)], "doc_id long, text string")
    assert [len(r["input_ids"]) for r in tokens.encode(docs, tokens.CharTokenizer()).orderBy("doc_id").collect()] == [1, 3, 5, 7, 9]
    assert spark.conf.get(BYTES_KEY) == "32m"


def test_slices_hold_every_text():
    texts = ["abc", None, "", "x" * 50, "y", "z" * 9, None]
    for most in (1, 4, 10, 1000):
        found = list(slices(texts, most))
        assert [t for a, b in found for t in texts[a:b]] == texts and all(a < b for a, b in found)
    assert list(slices([])) == []
    rows = [[1, 2], [], [0x10FFFF + 5], [7] * 3]
    assert int_lists(rows).to_pylist() == rows and int_lists([]).to_pylist() == []


def test_draws_are_the_keyed_ones():
    for key in ((), ("fim", 7), ("a:b", None, -3)):
        d = Draws(42, *key)
        assert [d.uniform() for _ in range(5)] == [uniform(42, f"draw{n}", *key) for n in range(1, 6)]


def test_tokenizers_compile_their_pattern_once(monkeypatch):
    for t in (tokens.CharTokenizer(), tokens.ByteTokenizer()):
        t.encode("a<EOS>b")
        with monkeypatch.context() as m:
            m.setattr(re, "escape", lambda *a: pytest.fail("compiled again"))
            for text in ("plain", "a<EOS>b<UNK>", "", "é<MASK"):
                assert t.ids(text) == t.encode(text)[0] and t.decode(t.ids(text)) == text
        assert t.decode([]) == "" and t.decode([t.token_id(x) for x in SPECIAL_TOKENS]) == "".join(SPECIAL_TOKENS)


@pytest.mark.parametrize("kind", ["ntp", "line", "func", "multi"])
def test_one_kind_needs_only_its_own_documents(spark, sf_dir, kind):
    rows = code_corpus(spark, sf_dir).withColumnRenamed("content", "text")
    options = {"cutoff": 512, "func_level": True, "multi_line": True}
    want = fim.samples(rows, tokens.CharTokenizer(), **options).where(F.col("strategy") == kind)
    got = fim.samples(rows, tokens.CharTokenizer(), only=kind, **options)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.columns == want.columns
    plain = fim.samples(rows, tokens.CharTokenizer(), only=kind, fim=False, cutoff=512)
    assert plain.isEmpty() == (kind != "ntp")


@pytest.mark.parametrize("name, kind", [("fim_line", "line"), ("fim_multi", "multi"), ("fim_func", "func")])
def test_queries_for_one_kind_ask_before_python(spark, sf_dir, name, kind):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert re.search(r"Filter .*md5", below)


@pytest.mark.parametrize("name, most", [("header_strip", 1), ("clean_pipeline", 2)])
def test_texts_are_not_computed_again_for_each_use(spark, sf_dir, name, most):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"DataFilters: .*", "", plan, flags=re.S)
    assert plan.count("regexp_replace(coalesce(text") <= most
    assert plan.count("ArrowEvalPython") == most
