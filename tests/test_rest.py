import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import predict, sampling
from codeloom.operators.tokens import ByteTokenizer
from codeloom.plans import pipelines
from codeloom.sources import io

GOOD = "import os\n\n\n" + "".join(f"def name_{k}(a, b):\n    return a * {k} + b\n\n\n" for k in range(20))


def test_agreement(spark):
    cases = [
        ("a\nb", "a\nb", True), ("a", "a\nb", True), ("a\nb\nc", "a\nb", True), ("x\nb", "a\nb", False), ("a\nb  \n\n", "a\nb", True),
        ("", "a", False), ("", " \n", True), ("a ", "a", True), ("a \nb", "a\nb", False),
    ]
    df = spark.createDataFrame([(p, m) for p, m, _ in cases], "p string, m string").select(predict.agrees(F.col("p"), F.col("m")))
    assert [r[0] for r in df.collect()] == [w for *_, w in cases]


def test_polarity_splits_rows(spark):
    rows = spark.createDataFrame([("p", f"m{k}", "s", k, [f"m{k % 3}"]) for k in range(9)], "prefix string, middle string, suffix string, sequence_id long, prediction array<string>")
    right, wrong = (predict.keep(rows, w, True) for w in ("correct", "incorrect"))
    assert right.count() + wrong.count() == 9 and right.intersect(wrong).count() == 0 and right.count() == 3
    assert "prediction" in predict.keep(rows, "all").columns
    with pytest.raises(ValueError):
        predict.keep(rows, "some")


def test_prediction_drops_empty_middles_and_batches(spark):
    rows = spark.createDataFrame([(k, "p", "" if k % 4 == 0 else "m", "s") for k in range(100)], "sequence_id long, prefix string, middle string, suffix string").coalesce(1)

    def make():
        def model(prompts):
            assert len(prompts) <= 64
            return [["m", p] for p in prompts]

        return model

    out = predict.predict(rows, make, "external", only_prefix=True)
    assert out.count() == 75 and out.first()["prediction"][1] == "<｜fim▁begin｜>p<｜fim▁hole｜><｜fim▁end｜>"
    assert pipelines.predict_and_keep(rows, make, "native", "correct").count() == 75
    dealt = predict.predict(rows, make, shards=3)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 75
    with pytest.raises(ValueError):
        predict.predict(rows, make, "other")


def test_sampling_sizes(spark):
    rows = [(f"f{n}", f"f{n}-{k}") for n in (4, 5, 6, 15, 25) for k in range(n)]
    df = spark.createDataFrame(rows, "file string, id string")
    got = {r["file"]: r["count"] for r in sampling.sample_exact(df, 0.1, "file", "id").groupBy("file").count().collect()}
    assert got == {"f6": 1, "f15": 2, "f25": 2}
    assert sampling.shuffle_take(spark.range(10), 0.25, "id").count() == 2
    assert sampling.shuffle_take(spark.range(10), None, "id").count() == 10


def test_split_and_shards(spark):
    df = sampling.split(spark.range(2000).withColumnRenamed("id", "doc_id"))
    share = df.where("split = 'validation'").count() / 2000
    assert 0.08 < share < 0.12
    again = sampling.split(spark.range(2000).withColumnRenamed("id", "doc_id").repartition(7))
    assert again.exceptAll(df).count() == 0
    rows = sampling.shard(sampling.number(spark.range(0, 1000, 3).repartition(5), "id"), 3).orderBy("id").collect()
    assert [r["sequence_id"] for r in rows] == list(range(334)) and all(r["shard"] == r["sequence_id"] % 3 for r in rows)


def test_sources_and_cleaning(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.jsonl").write_text("\n".join([json.dumps({"content": GOOD, "blob_id": "1", "x": 2}), "{broken", json.dumps({"content": "x = = 1", "blob_id": "2"})]))
    docs = io.to_documents(io.read_raw(spark, str(raw)))
    assert docs.count() == 2 and io.read_raw(spark, str(raw), keep_corrupt=True).where("_corrupt_record is not null").count() == 1
    out = pipelines.clean(docs)
    assert [(r["blob_id"], r["text"]) for r in out.collect()] == [("1", GOOD + "\n")]
    io.write_parquet(out, str(tmp_path / "clean"), files=1)
    back = io.read_table(spark, str(tmp_path / "clean"))
    assert io.with_file(back).first()["file"].endswith(".parquet")
    io.write_text(back, str(tmp_path / "txt"))
    assert io.read_text(spark, str(tmp_path / "txt")).count() == (GOOD + "\n").count("\n") + 1
    assert io.output_files(7, 3) == 3 and io.text_name("a.parquet") == "a.txt"
    with pytest.raises(ValueError):
        io.read_table(spark, "x.csv")


def test_row_numbers_are_gapless(spark):
    """Wide rows over many partitions, with ties, under adaptive execution as it is by default."""
    n = 120_000
    wide = spark.range(0, n, 1, 32).selectExpr("id", "id div 3 as k", *[f"repeat(cast(id as string), 8) as c{i}" for i in range(12)])
    got = sampling.number(wide, "k").agg(F.count("*"), F.count_distinct("sequence_id"), F.min("sequence_id"), F.max("sequence_id"), F.count_distinct("id")).first()
    assert tuple(got) == (n, n, 0, n - 1, n)
    hot = spark.range(0, 5000, 1, 8).selectExpr("1 as k", "id")
    rows = sampling.number(hot, "k").collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(5000))
    ordered = sorted(sampling.number(spark.range(0, 999, 1, 7).selectExpr("id", "-id as k"), "k").collect(), key=lambda r: r["sequence_id"])
    assert [r["k"] for r in ordered] == sorted(r["k"] for r in ordered)
    assert sampling.number(spark.range(0), "id").count() == 0


def test_samples_are_the_smallest_draws(spark):
    rows = spark.range(20_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else cast(id % 50 as string) end as g")
    drawn = rows.withColumn("u", sampling.uniform(42, "sample", F.col("id"))).collect()
    groups = {}
    for r in drawn:
        groups.setdefault(r["g"], []).append((r["u"], r["id"]))
    want = {i for own in groups.values() for _, i in sorted(own)[: round(0.1 * len(own))]}
    assert {r["id"] for r in sampling.sample_exact(rows, 0.1, "g", "id").collect()} == want
    everything = sampling.sample_exact(rows, 1.0, "g", "id")
    assert everything.count() == 20_000 and sampling.sample_exact(rows.limit(0), 0.5, "g", "id").count() == 0
    u = {r["id"]: r["u"] for r in rows.select("id", sampling.uniform(42, "shuffle", F.col("id")).alias("u")).collect()}
    taken = {r["id"] for r in sampling.shuffle_take(rows, 0.37, "id").collect()}
    assert taken == {i for _, i in sorted((v, k) for k, v in u.items())[:7400]}


def test_arrow_sources(spark, tmp_path):
    import pyarrow as pa

    from codeloom.sources import arrow

    t = pa.table({"text": ["a", "b", "c"], "n": [1, 2, 3]})
    saved = tmp_path / "saved"
    for part, opener in (("train/data-0.arrow", pa.ipc.new_stream), ("train/data-1.arrow", pa.ipc.new_stream), ("test/data-0.arrow", pa.ipc.new_file)):
        (saved / part).parent.mkdir(parents=True, exist_ok=True)
        with pa.OSFile(str(saved / part), "wb") as f, opener(f, t.schema) as w:
            w.write_table(t, max_chunksize=1)
    (saved / "dataset_dict.json").write_text("{}")
    rows = [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(map(tuple, io.read_table(spark, str(saved / "test/data-0.arrow")).collect())) == rows
    assert sorted(map(tuple, io.read_table(spark, str(saved), split="train").collect())) == sorted(rows * 2)
    assert io.read_table(spark, str(saved)).count() == 9
    paths = arrow.files(spark, str(saved))
    assert len(paths) == 3 and sorted(map(tuple, arrow._through_spark(spark, paths).collect())) == sorted(rows * 3)
    reader = arrow.ArrowReader(paths)
    arrow.BATCHES, before = 2, arrow.BATCHES
    try:
        assert sorted((r.begin, r.end) for r in reader.partitions()) == [(0, 1), (0, 1), (0, 2), (2, 3)]
    finally:
        arrow.BATCHES = before
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, str(tmp_path / "none.arrow"))


def test_intermediate_tables_go(spark):
    import os

    from codeloom.functions.durable import cut, discard

    first = cut(spark.range(5), "first")
    second = cut(first.selectExpr("id + 1 as id"), "second", first)
    assert second.count() == 5 and not os.path.exists(first._written)
    discard(second)
    assert not os.path.exists(second._written)


def test_tokenize_pipeline_and_split_sink(spark, tmp_path):
    docs = spark.createDataFrame([(k, GOOD) for k in range(30)], "doc_id long, text string")
    out = pipelines.tokenize(docs, ByteTokenizer(), "fim", cutoff=300, val_size=0.3)
    io.write_split(out, str(tmp_path / "s"))
    train, val = (io.read_split(spark, str(tmp_path / "s"), x) for x in ("train", "validation"))
    assert train.count() + val.count() == out.count() and val.count() > 0 and "prefix" not in train.columns
    assert pipelines.tokenize(docs, ByteTokenizer(), "tokenize", sample_ratio=0.5).count() == 15
    with pytest.raises(ValueError):
        pipelines.tokenize(docs, ByteTokenizer(), "other")


def test_stream_equals_batch(spark, tmp_path):
    from codeloom.streaming.clean import clean_stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text(json.dumps({"content": GOOD + f"x = {k}\n", "blob_id": str(k)}))
    q = clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_trigger=1)
    q.awaitTermination(60)
    want = pipelines.clean(io.to_documents(io.read_raw(spark, str(tmp_path / "in"))))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.exceptAll(want).count() == 0
