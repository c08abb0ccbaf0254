"""Near-duplicate groups by MinHash, banding, verification and components.

Words are lower-cased in A-Z; a document's set is its distinct shingles of
``shingle`` words (its whole word sequence if it has fewer words).  Documents
whose sets have 100 * |A and B| >= percent * |A or B| are linked; groups are
connected components.  ``op7_minhash_components`` has 3 words and 85 %, the
pipeline 5 words and 80 %.

1. Documents with equal sets collapse to one representative, so copies, however
   many, cost one row each.
2. 120 universal hash minima of each representative make bands as long as a
   pair at the limit may be: it shares no band with probability 1e-6 at most
   (24 bands of 5 at 0.85: 8e-7; 30 bands of 4 at 0.80: 1.4e-7).
3. In each bucket every member is paired with the bucket's smallest member: as
   many pairs as members.  Pairs whose signatures agree in enough places (78 of
   120 at 0.85, 70 at 0.80; a pair at the limit falls below with probability
   2e-8 at most) are confirmed on their full sets; links make components by
   alternating stars.
4. Buckets whose members then lie in one component are settled: no pair in them
   can change a component.  In any other, members outside its largest component
   are held against all the others, bucket by bucket and in blocks of bounded
   size, so a family of copies is never held against itself.  Pairs in different
   components that share no earlier band are compared by signature and confirmed
   on full sets where it agrees.  So no link that joins components is lost, and
   only links are put out, less than one for each component of a block.

Cases: null texts and texts without words have an empty set, are linked with
nothing and kept; a null doc_id cannot be linked and is kept; rows with one
doc_id are one document, whose text is the smallest of theirs; ties cannot arise, the smallest doc_id stands for its
group; an empty table gives an empty result; other columns are ignored, or in
``deduplicate`` passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel as K
from .common import cut, discard, release, small_batches, small_join, spare, table
from .graph import components

SHINGLE = 3
PERCENT = 85
HASHES = 120
#: Probabilities that a pair at the limit shares no band, and agrees in too few places.
NO_BAND, TOO_FEW = 1e-6, 2e-8
#: Documents, and bytes of their sets, that are compared with as many others at once.
BLOCK, BLOCK_BYTES = 512, 1 << 24
BROADCAST_IDS = 500_000

_RNG = np.random.Generator(np.random.PCG64(85_03))
_A = _RNG.integers(1, 1 << 63, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES).astype(np.uint64)


def band_rows(percent: int) -> int:
    """Minima in a band: the most that divide HASHES and keep to NO_BAND."""
    p = percent / 100
    return max([n for n in range(1, HASHES + 1) if HASHES % n == 0 and (1 - p**n) ** (HASHES // n) <= NO_BAND], default=1)


def least_agreement(percent: int) -> int:
    """Places in which signatures of pairs that are confirmed agree at least."""
    p, below = percent / 100, 0.0
    for k in range(HASHES + 1):
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > TOO_FEW:
            return k
    return HASHES


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    data, offsets = K.strings(column)
    for a, b in K.slices(offsets, K.SMALL_SLICE):
        w = K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k in range(b - a):
            h = w.hash[w.first[k] : w.first[k + 1]]
            if len(h) >= size:
                yield np.unique(K.grams(h, size))
            elif len(h):
                yield K.grams(h, len(h)) ^ np.uint64(len(h))
            else:
                yield h


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes (a * x + b mod 2**64) >> 32."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 512):
            out = np.minimum(out, ((shingles[k : k + 512, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set and its signature; a map without exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.forget()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                n, hi, lo, sig = [], [], [], []
                for s in shingle_sets(b.column("text"), shingle):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        hi.append(int(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                        lo.append(int(K.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "hi", "lo", "sig"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, hi long, lo long, sig binary")


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(documents x bands) keys of signatures."""
    bands = HASHES // rows
    sig = sig.reshape(-1, bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), dtype=np.uint64)
        for k in range(rows):
            key = K.mix(key ^ sig[:, :, k]) + sig[:, :, k]
    return key.astype(np.int64)


def _bands(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        key = band_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32), rows)
        ids = b.column("id").take(pa.array(np.repeat(np.arange(len(key)), key.shape[1])))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), ids], names=["bucket", "id"])


def _agree(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in ("x", "y"))
        keep = np.flatnonzero((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for k, (x, y) in enumerate(zip(K.blobs(b.column("x")), K.blobs(b.column("y")), strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            b = batch.slice(k, 200)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), shingle)], pa.binary())], names=["id", "set"])


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the values x of a and y of b; joins that can be split."""
    left = values.select(F.col("id").alias("a"), F.col(column).alias("x"))
    right = values.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")


def _full_sets(docs: DataFrame, ids: DataFrame, kind: str, shingle: int) -> DataFrame:
    """(id, set) of the documents whose ids are in ``ids`` (doc_id); rows with one doc_id have one text."""
    chosen = small_join(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", BROADCAST_IDS)
    return chosen.mapInArrow(lambda x: _sets(x, shingle), f"id {kind}, set binary").dropDuplicates(["id"])


def confirmed(docs: DataFrame, pairs: DataFrame, kind: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) that reach the similarity on their full sets."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "setids")
    sets = cut(_full_sets(docs, ids, kind, shingle), "sets", ids)
    return cut(_with_both(pairs, sets, "set").mapInArrow(lambda x: _linked(x, percent), f"a {kind}, b {kind}"), "links", sets)


def _across(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links across components between two blocks of a bucket, as pairs of components.

    Pairs whose signatures agree are confirmed on the full sets at once; what a
    link has joined in this task is not compared again, so a task returns fewer
    rows than it has components.  Pairs that share an earlier band are compared
    in that band's bucket.
    """
    sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["set"]]
    size = np.array([len(x) for x in sets])
    names, comp = np.unique(rows["component"].to_numpy(), return_inverse=True)
    least = least_agreement(percent)
    keys = band_keys(sig, band_rows(percent))
    band = int(np.flatnonzero(keys[0] == rows["bucket"].iloc[0])[0])
    block, i, j = rows["block"].to_numpy(), int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = [], []
    for x in left:
        others = right[right > x] if i == j else right
        others = others[(100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])) & (comp[others] != comp[x])]
        others = others[~(keys[others, :band] == keys[x, :band]).any(axis=1)]
        if not len(others):
            continue
        agree = (sig[others] == sig[x]).sum(axis=1)
        order = np.argsort(-agree, kind="stable")
        for y in others[order[: int((agree >= least).sum())]]:
            if comp[y] == comp[x]:
                continue
            at = np.minimum(np.searchsorted(sets[x], sets[y]), size[x] - 1)
            both = int((sets[x][at] == sets[y]).sum())
            if 100 * both >= percent * (size[x] + size[y] - both):
                a.append(names[comp[x]])
                b.append(names[comp[y]])
                comp[comp == comp[y]] = comp[x]
    return pd.DataFrame({"a": pd.array(a, dtype=names.dtype), "b": pd.array(b, dtype=names.dtype)})


def _rest(docs: DataFrame, members: DataFrame, found: DataFrame, reps: DataFrame, kind: str, shingle: int, percent: int) -> DataFrame | None:
    """Pairs of components (a, b) that are linked, from the buckets not yet in one component."""
    placed = members.where("n > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut(placed.select("bucket", "id", "component"), "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    unsettled = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"))
    unsettled = cut(unsettled.where("parts > 1").select("bucket", "largest"), "unsettled")
    if unsettled.isEmpty():
        return None
    placed = cut(placed.join(unsettled, "bucket").select("bucket", "id", "component", (F.col("component") == F.col("largest")).alias("major")), "unsettledplaces", placed, unsettled)
    own = cut(placed.select(F.col("id").alias("doc_id")).distinct(), "unsettledids")
    sets = cut(reps.join(_full_sets(docs, own, kind, shingle), "id"), "unsettledsets", own)
    rows = placed.join(sets, "id")
    most = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("set")) / BLOCK_BYTES)).cast("int")
    counts = rows.groupBy("bucket", "major").agg(most.alias("m")).groupBy("bucket")
    counts = cut(counts.agg(F.sum(F.when(~F.col("major"), F.col("m"))).cast("int").alias("_few"), F.sum(F.when(F.col("major"), F.col("m"))).cast("int").alias("_many")), "blocks")
    # blocks of the largest component come after the others' and meet only those
    h = F.xxhash64("id")
    block = F.when(F.col("major"), F.col("_few") + F.pmod(h, F.col("_many"))).otherwise(F.pmod(h, F.col("_few"))).cast("int")
    last = F.when(F.col("major"), F.col("_few")).otherwise(F.col("_few") + F.col("_many")) - 1
    dealt = placed.join(counts, "bucket").withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("bucket", "id", "component", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    dealt = dealt.join(sets, "id").select("bucket", "component", "sig", "set", "block", "i", "j")
    return cut(dealt.groupBy("bucket", "i", "j").applyInPandas(lambda x: _across(x, percent), f"a {kind}, b {kind}").distinct(), "across", placed, sets, counts)


def _one_text(docs: DataFrame) -> DataFrame:
    """doc_id and text, the smallest one where a doc_id is repeated with several; as many rows as before."""
    h = F.xxhash64("text")
    odd = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("x"), F.max(h).alias("y"), F.count(F.lit(1)).alias("_n"))
    odd = cut(odd.where("x <> y").select("doc_id", "_n"), "manytexts")
    docs = docs.select("doc_id", "text")
    if odd.isEmpty():
        return docs
    least = docs.join(odd, "doc_id").groupBy("doc_id", "_n").agg(F.min("text").alias("text"))
    least = least.select("doc_id", "text", F.explode(F.sequence(F.lit(1), "_n"))).select("doc_id", "text")
    return small_join(docs, odd, "doc_id", "left_anti", BROADCAST_IDS).union(least)


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    spark = small_batches(docs.sparkSession)
    docs = _one_text(docs)
    rows = cut(signatures(docs, shingle), "signatures")
    key = ["n_shingles", "hi", "lo"]
    classes = cut(rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id")).where("id is not null"), "classes")
    reps = classes.join(rows.withColumnRenamed("doc_id", "id"), ["id", *key]).select("id", "sig").dropDuplicates(["id"])
    reps = cut(reps, "representatives")
    release(spark)
    size, least = band_rows(percent), least_agreement(percent)
    bands = cut(reps.mapInArrow(lambda x: _bands(x, size), f"bucket long, id {kind}"), "bands")
    several = cut(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1"), "several")
    members = cut(bands.join(several, "bucket"), "buckets", bands, several)
    release(spark)

    hubs = cut(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "hubpairs")
    agreed = cut(_with_both(hubs, reps, "sig").mapInArrow(lambda x: _agree(x, least), f"a {kind}, b {kind}"), "hubagreed", hubs)
    links = confirmed(docs, agreed, kind, shingle, percent)
    found = cut(components(links), "components", agreed, links)

    more = _rest(docs, members, found, reps, kind, shingle, percent)
    discard(members, reps)
    release(spark)

    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    if more is not None and not more.isEmpty():
        joined = components(more).select(F.col("node").alias("component_id"), F.col("component").alias("_least"))
        named = named.join(joined, "component_id", "left").withColumn("component_id", F.coalesce("_least", "component_id")).drop("_least")
    named = cut(named, "named", classes, found)
    out = rows.drop("sig").join(named, key, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, in the columns of ``docs``; a repeated doc_id once, with the smallest text."""
    found, name = cut(groups(docs, shingle, percent), "groups"), spare(docs, "gone")[0]
    gone = cut(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "duplicates")
    out = small_join(docs, gone, F.col("doc_id") == F.col(name), "left_anti", BROADCAST_IDS)
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(name))
    again = cut(again, "repeated", found)
    if again.isEmpty():
        return out
    # only what is repeated is sorted out
    on = F.col("doc_id") == F.col(name)
    once = small_join(out, again, on, "left_anti", BROADCAST_IDS)
    place, text = spare(docs, "place", "text")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col(text).asc_nulls_last()))
    first = small_join(out, again, on, "left_semi", BROADCAST_IDS).withColumn(text, F.col("text")).withColumn(place, rank).where(F.col(place) == 1)
    return once.union(first.select(*docs.columns))


def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
