"""Near copies, components, decontamination and sharding against brute force."""

from __future__ import annotations

import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import MESSY, SCHEMA, make

import corpus_pipeline
from codeloom.llm import decontam, graph, kernel, linefreq, neardup, sharding


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def want_groups(rows, size=3, percent=85):
    sets = {i: shingles(t, size) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components_of(ids, links)


@pytest.mark.parametrize("block", [128, 3])
def test_groups_equal_brute_force(spark, family, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    sets, want = want_groups(family)
    got = neardup.groups(spark.createDataFrame(make(family), SCHEMA)).collect()
    assert len(got) == len(family)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_groups_of_messy_rows(messy, nothing):
    sets, want = want_groups(MESSY)
    got = neardup.groups(messy).collect()
    assert len(got) == len(MESSY)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert neardup.groups(nothing).count() == 0
    kept = neardup.deduplicate(messy)
    assert kept.columns == messy.columns
    assert sorted(x["doc_id"] or 0 for x in kept.select("doc_id").collect()) == sorted([0, *{i for i in want if want[i] == i}])


def test_pipeline_joins_copies_with_a_block_appended(spark):
    rng = random.Random(6)
    rows = []
    for k in range(6):
        base = [f"u{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(10 * k + i, " ".join(base + [f"u{rng.randrange(10**6)}" for _ in range(n)]), "en", "s") for i, n in enumerate((0, 44, 60))]
    frame = spark.createDataFrame(make(rows), SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(10 * k + i for k in range(6) for i in (0, 2))
    assert sum(r["kept"] for r in neardup.groups(frame).collect()) == 18


def test_a_doc_id_with_several_texts_has_the_smallest(spark):
    text = " ".join(f"u{k}" for k in range(40))
    rows = [(1, "z " + text, "en", "s"), (1, "b c d e f g h", "en", "s"), (1, None, "en", "s"), (2, "b c d e f g h", "en", "s"), (3, "z " + text, "en", "s"), (0, "z " + text, "en", "s")]
    got = neardup.groups(spark.createDataFrame(make(rows), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(0, 39, 0, True), (1, 5, 1, True), (1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False), (3, 39, 0, False)]
    kept = neardup.deduplicate(spark.createDataFrame(make(rows), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"][:3]) for r in kept) == [(0, "z u"), (1, "b c")]


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (1, 50)])
def test_groups_at_other_limits_equal_brute_force(spark, family, shingle, percent):
    def cut(text):
        w = text.lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}

    sets = {i: cut(t) for i, t, *_ in family}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components_of(sorted(sets), links)
    got = neardup.groups(spark.createDataFrame(make(family), SCHEMA), shingle, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 4 < len(set(want.values())) < len(family)


def test_bands_and_agreement_follow_the_limit():
    assert [(neardup.band_rows(p), neardup.least_agreement(p)) for p in (80, 85)] == [(4, 70), (5, 78)]


def test_minima_and_bands_are_what_they_say():
    s = np.arange(1, 900, dtype=np.uint64) * np.uint64(7919)
    want = [min((int(x) * int(a) + int(b)) % 2**64 >> 32 for x in s) for a, b in zip(neardup._A[:3], neardup._B[:3])]
    assert neardup.signature(s)[:3].tolist() == want


def test_components(spark):
    rng = random.Random(2)
    chains = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(200, 260)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    nodes = {x for a, b in chains if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(chains, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == components_of(nodes, [(a, b) for a, b in chains if a != b]) and len(got) == len(nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_leaks(docs, items):
    def cut(t):
        import re

        w = [x for x in re.sub(r"[^\w]|_", " ", (t or "").lower()).split(" ") if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    from collections import Counter

    out = {}
    for i, t, *_ in docs:
        for k, text in items:
            d, b = cut(t), cut(text)
            if i is None or not set(d) & set(b):
                continue
            n, best = min(len(d), len(b)), 0
            need = Counter(b)
            for s in range(len(d) - n + 1):
                best = max(best, sum((Counter(d[s : s + n]) & need).values()))
            if 100 * best >= 80 * (n + len(b) - best):
                out[i, k] = max(best, out.get((i, k), 0))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randint(5, 40)))) for k in range(12)] + [(50, "v1 v2 v1 v2 v1 v2 v1 v2 v1 v2 v1 v2 v1 v2"), (51, "too short"), (52, None)]
    docs = []
    for n in range(60):
        w = [f"v{rng.randrange(60)}" for _ in range(rng.randint(0, 80))]
        if n % 2:
            leak = (items[rng.randrange(13)][1]).split()
            for _ in range(n % 5):
                at = rng.randrange(len(leak))
                if n % 3 == 0:
                    leak[at:at] = ["extra"]
                elif n % 3 == 1 and len(leak) > 1:
                    del leak[0]
                else:
                    leak[-1] = "Changed!"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in leak]
        docs.append((n, " ".join(w), "en", "s"))
    want = brute_leaks(docs, items)
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    frame = spark.createDataFrame(make(docs), SCHEMA)
    got = {(r["doc_id"], r["item_id"]): r["shared"] for r in decontam.matches(frame, bench).collect()}
    assert got == want and len(want) > 10
    left = decontam.decontaminate(frame, bench)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {d[0] for d in docs} - {i for i, _ in want}


def test_windows_hold_what_0_8_leaves_unchanged(spark):
    own = spark.range(1, 400).withColumnRenamed("id", "m").selectExpr("m", f"{decontam._size('m')} as w").collect()
    for m, w in own:
        run = (8 * m // 10) // (m // 45 + 1)
        assert w == 1 or w + max(w // 4, 1) - 1 <= run
        assert w == max(x for x in decontam.SIZES if x == 1 or x + max(x // 4, 1) - 1 <= run)


def test_fingerprints_equal_plain_python(spark):
    rng = random.Random(3)
    g = [rng.getrandbits(64) - 2**63 for _ in range(70)]
    rows = spark.createDataFrame([(g,)], "g array<long>")
    for every in (True, False):
        got = decontam._fingerprints(rows, [1, 2, 4, 8, 16, 32], every).collect()
        want = []
        for w in (1, 2, 4, 8, 16, 32):
            for s in range(0, len(g) - w + 1, 1 if every else max(1, w // 4)):
                f = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in g[s : s + w]) * 2 > w)
                want.append((w, f - 2**64 if f >= 2**63 else f))
        assert [(r["w"], r["f"]) for r in got] == want


def test_index_finds_what_brute_force_finds(spark):
    """Passages of all lengths with a few changed, added or lost words: recall of the index, measured."""
    rng = random.Random(14)
    items = [(k, " ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randint(5, 160)))) for k in range(60)]
    docs = []
    for n in range(250):
        leak = items[rng.randrange(60)][1].split()
        for _ in range(rng.randint(0, 1 + len(leak) // 45)):
            at = rng.randrange(len(leak))
            leak[at : at + rng.randint(0, 1)] = ["changed"] * rng.randint(0, 1)
        leak = leak[rng.randint(0, len(leak) // 10) :]
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(0, 60))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = leak
        docs.append((n, " ".join(w), "en", "s"))
    want = brute_leaks(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(spark.createDataFrame(make(docs), SCHEMA), bench).collect()}
    recall = len(got & set(want)) / len(want)
    print(f"recall of the index: {recall:.4f} of {len(want)}")
    assert got <= set(want) and recall >= 0.9


def test_a_long_repetitive_document(spark):
    bench = spark.createDataFrame([(1, "same " * 40), (2, " ".join(f"a{k}" for k in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame(make([(1, "same " * 60_000, "en", "s"), (2, ("x y z " * 9000) + " ".join(f"a{k}" for k in range(30)), "en", "s")]), SCHEMA)
    began = time.monotonic()
    assert sorted((r["doc_id"], r["item_id"], r["shared"]) for r in decontam.matches(docs, bench).collect()) == [(1, 1, 36), (2, 2, 26)]
    assert time.monotonic() - began < 60


def test_leaks_of_messy_rows(spark, messy, nothing):
    bench = spark.createDataFrame([(1, "same text here twice over and over again ok"), (2, None), (None, "a row without an id but"), (3, "")], "item_id long, text string")
    got = decontam.matches(messy, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in got] == [(8, 1, 1.0)]
    assert decontam.matches(nothing, bench).count() == 0 and decontam.matches(messy, bench.limit(0)).count() == 0
    plan = decontam.matches(messy, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    got = sharding.permute(np.arange(n), n, 9)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or sharding.permute(np.arange(n), n, 8).tolist() != got.tolist()


def test_shards_equal_brute_force(spark):
    """Row numbers, the network and the walk, one row after another."""
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.choice([None, "", "a", "aé", "long " * 9]), "en", "s") for _ in range(137)]

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % 2**64
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) % 2**64
        return x ^ x >> 31

    def place(r, n, key):
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            left, right = r >> half, r & ((1 << half) - 1)
            for k in range(1, sharding.ROUNDS + 1):
                left, right = right, left ^ mixed(right ^ mixed((k + key * 0x9E3779B97F4A7C15) % 2**64)) & ((1 << half) - 1)
            r = left << half | right
            if r < n:
                return r

    own = sorted((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, *_ in rows)
    want = sorted((i, c, s, place(r, len(own), 1) % 40, place(r, len(own), 1) // 40) for r, (i, c, s) in enumerate(own))
    got = sharding.shard(spark.createDataFrame(make(rows), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == want


def test_shards(spark, messy, nothing):
    got = sharding.shard(messy, 4).collect()
    assert len(got) == len(MESSY)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    text = {i: (t or "").encode() for i, t, *_ in MESSY}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 16, zlib.crc32(text[r["doc_id"]])) for r in got)
    again = sharding.shard(messy.repartition(5), 4).collect()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(str([r[k] for k in key]) for r in got) == sorted(str([r[k] for k in key]) for r in again)
    assert sharding.shard(nothing).count() == 0


def test_workers_hold_little_beside_their_texts(monkeypatch):
    monkeypatch.setattr(kernel, "_POWERS", kernel._Powers())
    rng = random.Random(21)
    column = pa.array([" ".join(f"u{rng.randrange(10**5)}" for _ in range(600)) for _ in range(1000)])
    for run in (lambda: sum(len(s) for s in neardup.shingle_sets(column, 5)), lambda: sum(map(len, linefreq._stats(column)))):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 50 << 20
