import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions.random import Draws
from codeloom.operators import fim
from codeloom.operators.tokens import ByteTokenizer

CODE = '''import os

# note
def f(a, b):
    """doc"""
    c = [
        a,  # inside
        b,
    ]
    total = sum(c) + \\
        1
    return total

print(f(1, 2))
'''


def test_logical_lines():
    got = fim.logical_lines(CODE)
    assert got[:5] == [[0], [1], [2], [3], [4]] and [5, 6, 7, 8] in got and [9, 10] in got
    assert sorted(k for g in got for k in g) == list(range(CODE.count("\n")))
    assert fim.logical_lines("x = )\n") is None and fim.logical_lines("x = (\n") is None
    assert fim.logical_lines("x = 1") == [[0]]


def greedy(sizes, c):
    """Blocks as ranges of the token stream, filled one line after another."""
    total = sum(s for s in sizes if s <= c)
    edges = [(a, a + c) for a in range(0, total - c + 1, c)]
    if total % c and total > c:
        edges.append((total - c, total))
    elif 0 < total < c:
        edges.append((0, total))
    return edges


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 14), max_size=25), st.integers(3, 12))
def test_pack(sizes, c):
    rows = [fim.Line("x" * n, [k] * n, list(range(1, n + 1))) for k, n in enumerate(sizes) if n <= c]
    stream = [i for r in rows for i in r.ids]
    got = fim.pack(rows, c)
    assert [[i for r in b for i in r.ids] for b in got] == [stream[a:e] for a, e in greedy(sizes, c)]
    for b in got:
        assert all(len(r.text) == len(r.ids) for r in b)
        assert all(r.valid == (len(r.ids) == sizes_of(rows, r)) for r in b)


def sizes_of(rows, part):
    return next(len(r.ids) for r in rows if r.ids[0] == part.ids[0])


def test_block_spans_agree_with_pack(spark):
    rng = random.Random(1)
    rows = [(d, g, rng.randint(1, 14)) for d in range(20) for g in range(rng.randint(1, 20))]
    got = fim.block_spans(spark.createDataFrame(rows, "doc_id int, g int, n_tokens int"), 10).collect()
    for d in range(20):
        at = 0
        for g, n in sorted((r[1], r[2]) for r in rows if r[0] == d and r[2] <= 10):
            r = next(x for x in got if x["doc_id"] == d and x["g"] == g)
            assert (r["first_block"], r["last_block"]) == (at // 10, (at + n - 1) // 10)
            assert r["is_split"] == (at // 10 != (at + n - 1) // 10)
            at += n


def test_samples_put_back_together():
    tokenizer = ByteTokenizer()
    rows = fim.tokenized_lines(CODE, tokenizer, 200)
    block = fim.pack(rows, 10_000)[0]
    text = "".join(r.text for r in block)
    assert text == CODE
    for k in range(60):
        for sample in (fim.line_sample, fim.multi_sample):
            parts = sample(block, Draws(k, "t"))
            if parts:
                assert "".join(parts).replace(" \n", "\n") == CODE.replace(" \n", "\n")
    assert "".join(fim.function_parts(CODE, Draws(1, "f"))) == CODE


def test_function_rules():
    def body(n):
        return "def f():\n" + "    x = 1\n" * n

    d = Draws(1, "f")
    assert fim.function_parts(body(2), d) is None
    assert fim.function_parts(body(3), d)[0] == "def f():\n"
    assert fim.function_parts(body(30), d) is not None and fim.function_parts(body(31), d) is None
    assert fim.function_parts("async " + body(5), d) is None
    assert fim.function_parts("x = 1", d) is None and fim.function_parts("x = (", d) is None
    assert fim.function_parts('def f():\n    """a\n    b\n    c"""\n', d)[1] == ""


def test_line_candidates():
    def line(text, valid=True):
        return fim.Line(text, [0], [len(text)], valid)

    assert fim.line_sample([line("x = 1\n"), line("\n"), line("# c\n")], Draws(1)) is None
    assert fim.line_sample([line("total = first + second\n", False)], Draws(1)) is None
    assert fim.line_sample([line("a" * 400 + "\n")], Draws(1)) is None
    assert fim.line_sample([line("total = first + second\n")], Draws(1)) is not None


def test_budget(spark):
    grid = [(p, m, s) for p in (0, 5, 40, 41, 200) for m in (0, 7, 25) for s in (0, 3, 41, 200)]
    df = spark.createDataFrame(grid, "p int, m int, s int")
    a, b = fim.budget_columns(F.col("p"), F.col("m"), F.col("s"), 100)
    for r in df.select("*", a.alias("a"), b.alias("b")).collect():
        assert (r["a"], r["b"]) == fim.budget(r["p"], r["m"], r["s"], 100)
        assert r["a"] + r["m"] + r["b"] <= 96 and r["a"] <= r["p"] and r["b"] <= r["s"] or r["a"] == 48


def test_function_samples_fit():
    sampler = fim.Sampler(ByteTokenizer(), cutoff=256, func_level=True)
    code = "y = 2\n" * 100 + "def f():\n" + "    x = 1\n" * 5 + "z = 3\n" * 100
    for k in range(40):
        for name, ids, p, m, s in sampler.samples(k, code):
            if name == "func":
                assert len(ids) <= 256 and p + m + s in code


def test_samples_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, CODE * 5) for i in range(30)], "doc_id long, text string")
    runs = [sorted(map(str, fim.samples(docs.repartition(n), ByteTokenizer(), cutoff=200, func_level=True, multi_line=True).collect())) for n in (1, 4)]
    assert runs[0] == runs[1] and runs[0]


def test_ignore_comment():
    rows = fim.tokenized_lines("# a comment line here\nx = 1\n", ByteTokenizer(), 100, ignore_comment=True)
    assert [r.valid for r in rows] == [False, True]
