"""Benchmark passages in documents, by SimHash windows; DataFrame functions only.

Texts are lower-cased and cut at everything but letters and digits.  A document
is contaminated by an item where a passage as long as the item (the whole
document, if that is shorter) and the item, both as multisets of 5-word
shingles, have

    sum of smaller counts >= 0.8 * sum of larger counts,

the weighted Jaccard similarity.

1. Windows.  Their size follows the item's.  A passage of similarity 0.8 with an
   item of m shingles has at least 0.8 m of them, and m / 45 changes inside at
   most, as a changed word takes five shingles from either side; so some stretch
   of 0.8 m / (m div 45 + 1) shingles is unchanged.  An item's windows have the
   largest power of two W for which such a stretch holds a whole one of the
   document's windows, which begin at every W / 4 th shingle.
2. Fingerprints.  A window's SimHash has a bit where more than half of its
   shingles' hashes have it.  All 64 bits are counted at once, in bit planes:
   the counts of halves are added plane by plane, pair by pair, as columns of
   compiled expressions, and nothing of a window but its number is ever copied.
3. Index.  The fingerprints of all windows of the items are cut into 4 blocks of
   16 bits.  Two fingerprints within 3 bits agree in one block at least, so the
   join on (window size, block, bits) finds every document window within that
   radius, and the distance is then counted.  This is the only source of
   candidates: (document, item) pairs.
4. Verification.  Only candidates are read again.  A shared shingle adds one to
   the similarity's sum for the windows that hold it and not yet as many of its
   kind as the item has; those are a range of beginnings, so a running sum over
   the ends of the ranges gives all windows of a document in one pass.

Cases: null texts, and texts or items of fewer than 5 words, match nothing;
repeated rows of documents are one document, repeated item rows one item (the
rows of a (doc_id, item_id) pair meet in one result, the best); null ids are
left out; ties of windows give the same result; empty tables give an empty
result; other columns are ignored, or in ``decontaminate`` passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_join, spare, table

WORDS = 5
PERCENT = 80
BLOCKS = 4
RADIUS = BLOCKS - 1
#: Sizes of windows.
SIZES = [1, 2, 4, 8, 16, 32]
#: Shingles, or indexed blocks, of all items that are broadcast at most (about 40 bytes each).
BROADCAST_SHINGLES = 1_000_000
#: Candidates that are broadcast at most.
BROADCAST_IDS = 500_000
_BITS = 64 // BLOCKS


def _words(text: str) -> str:
    return f"filter(split(trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')), ' '), w -> w <> '')"


def _shingles(text: str) -> str:
    """SQL: hashes of the successive shingles of a text, none for a short one."""
    at = ", ".join(f"h[i + {k}]" if k else "h[i]" for k in range(WORDS))
    some = f"if(size(h) < {WORDS}, array(), transform(sequence(0, size(h) - {WORDS}), i -> xxhash64({at})))"
    return f"transform(array(transform({_words(text)}, w -> xxhash64(w))), h -> {some})[0]"


def _size(n: str) -> str:
    """SQL: shingles in the windows of an item of ``n`` shingles."""
    run = f"({n} * {PERCENT} div 100) div ({n} * {100 - PERCENT} div {(2 * WORDS - 1) * 100} + 1)"
    return f"element_at(filter(array({', '.join(map(str, SIZES))}), w -> w = 1 or w + greatest(w div 4, 1) - 1 <= {run}), -1)"


def _sum(x: str, y: str, planes: int) -> list[str]:
    """SQL: counts in the bit planes of ``x`` and ``y`` added, for all 64 bits at once."""
    out, carry = [], ""
    for k in range(planes):
        a, b = f"{x}_{k}", f"{y}_{k}"
        out.append(f"({a} ^ {b} ^ {carry})" if carry else f"({a} ^ {b})")
        carry = f"(({a} & {b}) | (({a} ^ {b}) & {carry}))" if carry else f"({a} & {b})"
    return [*out, carry]


def _majority(size: int) -> str:
    """SQL: bits that more than half of ``size`` hashes have, from the planes of their count."""
    k = size.bit_length() - 1
    low = " | ".join(f"c0_{j}" for j in range(k - 1))
    return f"c0_{k}" + (f" | (c0_{k - 1} & ({low}))" if low else "")


def _fingerprints(rows: DataFrame, sizes: list[int], every: bool = False, only: str = "") -> DataFrame:
    """A row (w, f) for every window of ``sizes`` over the shingles ``g`` of each of ``rows``, beside its other columns.

    Windows begin at every quarter of their size, or with ``every`` at every
    shingle; ``only`` names a column with the one size of a row's windows.
    """
    own = [c for c in rows.columns if c != "g"]
    steps = [(w, 1 if every else max(1, w // 4)) for w in sizes]
    places = [f"if(size(g) < {w}{f' or {only} <> {w}' * bool(only)}, array(), transform(sequence(0, size(g) - {w}, {step}), s -> named_struct('w', {w}, 's', s)))" for w, step in steps]
    most = max(sizes)
    out = rows.select(*own, "g", F.expr(f"inline(concat({', '.join(places)}))"))
    out = out.select(*own, "w", *[F.expr(f"if(w > {i}, coalesce(get(g, s + {i}), 0L), 0L)").alias(f"c{i}_0") for i in range(most)])
    # columns that cannot be null make short code; the planes of n counts become those of n / 2 counts
    for planes in range(1, most.bit_length()):
        n = most >> planes
        added = [F.expr(v).alias(f"c{j}_{k}") for j in range(n) for k, v in enumerate(_sum(f"c{2 * j}", f"c{2 * j + 1}", planes))]
        out = out.select(*own, "w", *added)
    return out.select(*own, "w", F.expr("case " + " ".join(f"when w = {w} then {_majority(w)}" for w in sizes) + " else 0L end").alias("f"))


def _blocks(prints: DataFrame) -> DataFrame:
    """Four rows for each fingerprint, with a key of window size, block and bits in the place of w.

    These come from an expansion, not from an array: over it Spark does not try
    to infer filters from the equations of all the columns that made a fingerprint,
    which would take longer than the query.
    """
    keys = [f"(cast(w as bigint) << 24) | {k << _BITS}L | (shiftrightunsigned(f, {_BITS * k}) & {(1 << _BITS) - 1}L)" for k in range(BLOCKS)]
    own = [c for c in prints.columns if c != "w"]
    return prints.select(*own, *[F.expr(x).alias(f"key{k}") for k, x in enumerate(keys)]).unpivot(own, [f"key{k}" for k in range(BLOCKS)], "block", "key").drop("block")


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, its text's hash, the array g of its shingles and the size w of its windows."""
    rows = benchmark.where("item_id is not null").select("item_id", F.xxhash64("text").alias("item_key"), F.expr(_shingles("text")).alias("g"))
    rows = rows.where("size(g) > 0").dropDuplicates(["item_id", "item_key"])
    return rows.withColumn("w", F.expr(_size("size(g)")))


def candidates(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, doc_key, item_id, item_key) with two windows within RADIUS bits."""
    sizes = sorted(r["w"] for r in own.select("w").distinct().collect())
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("doc_key"), F.expr(_shingles("text")).alias("g")).where("size(g) > 0")
    if not sizes:
        return own.select("item_id", "item_key").join(rows.select("doc_id", "doc_key").limit(0)).select("doc_id", "doc_key", "item_id", "item_key")
    index = _blocks(_fingerprints(own.withColumnRenamed("w", "own"), sizes, True, "own")).withColumnRenamed("f", "item_f")
    index = cut(index.select("item_id", "item_key", "item_f", "key").distinct(), "itemblocks")
    asked = _blocks(_fingerprints(rows, sizes))
    near = small_join(asked, index, "key", "inner", BROADCAST_SHINGLES)
    near = near.where(F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))) <= RADIUS)
    return near.select("doc_id", "doc_key", "item_id", "item_key").distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, similarity) of contaminated documents, the best window of each."""
    own = cut(items(benchmark), "items")
    pairs = cut(candidates(docs, own), "candidates")

    # shingles that candidates share with their items
    ids = pairs.select("doc_id", "doc_key").distinct()
    again = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    again = small_join(again, ids, ["doc_id", "doc_key"], "left_semi", BROADCAST_IDS)
    again = again.select("doc_id", "doc_key", F.expr(_shingles("text")).alias("gs")).dropDuplicates(["doc_id", "doc_key"])
    again = again.select("doc_id", "doc_key", F.size("gs").alias("doc_n"), F.posexplode("gs").alias("pos", "g"))
    counted = own.select("item_id", "item_key", F.size("g").alias("item_n"), F.explode("g").alias("g"))
    counted = counted.groupBy("item_id", "item_key", "item_n", "g").agg(F.count(F.lit(1)).cast("int").alias("most"))
    met = small_join(again, counted, "g", "inner", BROADCAST_SHINGLES)
    met = small_join(met, pairs, pairs.columns, "left_semi", BROADCAST_IDS)

    # beginnings of windows in which each of them counts, and the running sum of these
    pair = ["doc_id", "doc_key", "item_id", "item_key", "doc_n", "item_n"]
    places = met.groupBy(*pair, "g", "most").agg(F.sort_array(F.collect_list("pos")).alias("o")).withColumn("n", F.least("doc_n", "item_n"))
    begin = "greatest(if(i >= most, o[i - most] + 1, 0), p - n + 1, 0)"
    ranges = places.select(*pair, "n", F.expr(f"inline(transform(o, (p, i) -> named_struct('a', {begin}, 'b', least(p, doc_n - n) + 1)))")).where("a < b")
    ends = ranges.select(*pair, "n", F.expr("stack(2, a, 1, b, -1) as (s, d)")).groupBy(*pair, "n", "s").agg(F.sum("d").alias("d"))
    running = F.sum("d").over(Window.partitionBy(*pair, "n").orderBy("s"))
    best = ends.select(*pair, "n", running.alias("x")).groupBy(*pair, "n").agg(F.max("x").alias("shared"))
    best = best.where(f"100 * shared >= {PERCENT} * (n + item_n - shared)")
    similarity = F.col("shared") / (F.col("n") + F.col("item_n") - F.col("shared"))
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct(similarity.alias("similarity"), F.col("shared"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.shared").cast("long").alias("shared"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark passage, in the columns of ``docs``."""
    name = spare(docs, "gone")[0]
    gone = cut(matches(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return small_join(docs, gone, F.col("doc_id") == F.col(name), "left_anti", BROADCAST_IDS)


def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
