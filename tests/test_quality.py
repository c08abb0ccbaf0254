from pyspark.sql import functions as F

from codeloom.operators import quality


def one(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_line_length_boundaries(spark):
    short = "x\n" * 30
    texts = [short + "a" * 1000, short + "a" * 1001, "a" * 100 + "\n" + "b" * 100, "a" * 100 + "\n" + "b" * 101, "", " \n　\n"]
    got = one(spark, texts, quality.length_ok(quality.line_statistics(F.col("text"))))
    assert [g[0] for g in got] == [True, False, True, False, False, False]


def test_line_length_against_plain_python(spark):
    texts = ["a\n\n b \n\x1c\n", "\tq", "x\r\ny", " \nz" * 3, "é" * 7]

    def want(t):
        ls = [x for x in t.split("\n") if x.strip()]
        return (len(ls), max(map(len, ls), default=0), sum(map(len, ls)))

    got = one(spark, texts, quality.line_statistics(F.col("text")).alias("s"))
    assert [tuple(g[0]) for g in got] == [want(t) for t in texts]


def test_character_ratio_is_strict(spark):
    texts = ["a" * 99 + "é", "a" * 100 + "é", "", "中——…，", "é", "①"]
    got = one(spark, texts, quality.characters_ok(F.col("text"), 0.99))
    assert [g[0] for g in got] == [False, True, False, True, False, False]


def test_size(spark):
    assert [g[0] for g in one(spark, ["a" * 499, "a" * 500], quality.size_ok(F.col("text")))] == [False, True]


def test_comments_and_strings():
    body = "x = 1\n" * 20
    assert not quality.lexes_clean(body + "# TODO\n")
    assert quality.lexes_clean(body + "# todo\n")
    assert quality.lexes_clean(body + "y = 'TODO'\n")
    assert quality.lexes_clean("")
    assert not quality.lexes_clean("x = (\n")
    assert not quality.lexes_clean("x = 'abc\n")
    half = "a='%s'\n"  # 3 characters around a string of n + 2
    assert quality.lexes_clean(half % "x")
    assert not quality.lexes_clean(half % "xx")
    assert not quality.lexes_clean("a=f'{x}bbbbbbbbb'\n")


def test_syntax_and_empty_functions(spark):
    texts = ["x = 1", "x = = 1", "x\0", "def f():\n  def g(): pass\n  return g", "async def f(): pass", "def f():\n  'd'\n  pass", None]
    got = [tuple(g[0]) for g in one(spark, texts, quality.lexical("text"))]
    assert [g[1] for g in got] == [True, False, False, True, True, True, False]
    assert [g[2] for g in got] == [True, False, False, False, True, True, False]


def test_builtin_filters_run_below_the_udf(spark, tmp_path):
    from codeloom.plans.pipelines import clean

    spark.createDataFrame([("x = 1\n" * 100, "b")], "text string, blob_id string").write.parquet(str(tmp_path / "d"))
    plan = clean(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")
    assert "Exchange" not in plan
