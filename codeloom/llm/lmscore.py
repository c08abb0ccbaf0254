"""Language-model scores with stupid backoff, from count tables of the corpus.

Words are lower-cased in A-Z.  A document is scored by the rest of the corpus:
with c the counts in all documents, k those in the document itself, N all words
and n the document's,

    S(w | v) = (c(v w) - k(v w)) / (c(v) - k(v))   where the rest has v w,
               0.4 * S(w)                          elsewhere,
    S(w)     = max(c(w) - k(w), 1/2) / max(N - n, 1),

and a first word has S(w); half a word stands for one that the rest never has.
A document's score is the sum of ln S over its words (Brants et al. 2007, order
2).  Since its own counts are taken off, a bigram that occurs once in the corpus
is unseen by the rest: the table of bigrams keeps those with 2 or more, and no
score changes by that.

It is computed as joins: the sum of ln S(w) over words, plus ln 0.4 for every
word but the first, plus for every bigram that the rest has the difference

    ln (c(v w) - k(v w)) - ln (c(v) - k(v)) - ln 0.4 - ln S(w).

Tables are aggregated before they are shuffled and partitioned by hash.  The
most frequent words and bigrams, up to a fixed number each, are broadcast with
their counts; they are the hot keys and cover most words.  The others are
exploded, once for each document with their counts in it, and joined to the
tables by hash, and sums meet by document.

Words are known by 64-bit hashes.  Frequent words have dense numbers, and a
bigram of two of these is their pair, from which both counts follow; other
bigrams are hashed and carry their words through the count.

Cases: a null or empty text has no words, score 0 and a null mean; repeated rows
count each and get the same score; a text of one word has its word's score;
null ids are kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, release, table

BACKOFF = 0.4
#: Bigrams with fewer are the document's own, which its own score does not count.
MIN_COUNT = 2
#: Words, and bigrams, whose counts or values are broadcast at most (16 bytes each).
FREQUENT = 1 << 19
#: Words that a task counts before it puts out partial counts.
FLUSH = 2_000_000
#: Rows of a batch of partial counts.
ROWS = 1 << 16
_BITS = 20
_WORD, _PAIR = np.uint64(1 << 62), np.uint64(1 << 63)
_LOW = np.uint64((1 << 62) - 1)


class _Frequent:
    """Keys with a value each, in the order of their mixed bits; ``starts`` leads to the few that share the first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        mixed = K.mix(keys.astype(np.uint64))
        order = np.argsort(mixed)
        self.keys, self.values = keys[order], values[order]
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(mixed[order] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __reduce__(self):
        return _Frequent, (self.keys, self.values)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys) or not len(keys):
            return out
        first = (K.mix(keys.astype(np.uint64)) >> self.shift).astype(np.int64)
        at, end, open_ = self.starts[first].astype(np.int64), self.starts[first + 1], np.arange(len(keys))
        while len(open_):
            open_ = open_[at[open_] < end[open_]]
            same = self.keys[at[open_]] == keys[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return out


def _slices(column: pa.Array) -> Iterator[tuple[int, int, K.Words, np.ndarray]]:
    data, offsets = K.strings(column)
    for a, b in K.slices(offsets):
        w = K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, w, np.repeat(np.arange(b - a), np.diff(w.first))


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return ((hashes & _LOW) | _WORD).astype(np.int64)


def _pairs(hashes: np.ndarray, owner: np.ndarray, words: _Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of successive words of one text, and the places of first words and of frequent words."""
    place = words.find(_word_keys(hashes))
    at = np.flatnonzero(owner[1:] == owner[:-1])
    left, right = place[at], place[at + 1]
    hashed = (K.grams(hashes, 2)[at] if len(hashes) > 1 else hashes[:0]) | _PAIR
    keys = np.where((left >= 0) & (right >= 0), (left << _BITS) | np.maximum(right, 0), hashed.astype(np.int64))
    return keys, at, place


def _tally(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts; empties ``parts``."""
    x = np.concatenate(parts)
    parts.clear()
    if not len(x):
        return x, x
    x.sort()
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[first], np.diff(np.append(first, len(x)))


def _batches(names: list[str], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Columns in batches of bounded size, since the JVM holds one whole."""
    for k in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(k, ROWS) for c in columns], names=names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, c) partial counts of words."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        for _, _, w, _ in _slices(batch.column("text")):
            held.append(_word_keys(w.hash))
            n += len(w.hash)
            if n >= FLUSH:
                yield from _batches(["g", "c"], [pa.array(x, pa.int64()) for x in _tally(held)])
                n = 0
    if n:
        yield from _batches(["g", "c"], [pa.array(x, pa.int64()) for x in _tally(held)])


def frequent(counts: DataFrame, most: int) -> int:
    """Smallest count c such that at most ``most`` rows have c or more."""
    grade = F.floor(F.log2("c") * 16)
    left, limit = most, None
    for r in counts.groupBy(grade.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect():
        left -= r["n"]
        if left < 0:
            break
        limit = r["c"]
    return limit if limit is not None else 1 << 62


def _broadcast(table: DataFrame):
    """A table of bounded size (g and values) on every executor; it travels as Arrow, not as rows."""
    found = table.toArrow()
    values = [c.to_numpy().astype(float) for c in found.columns[1:]]
    return table.sparkSession.sparkContext.broadcast(_Frequent(found.column(0).to_numpy(), values[0] if len(values) == 1 else np.column_stack(values)))


def _inside(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key occurs in its own text, and the first place of each different one."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = K.mix(keys.astype(np.uint64) + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(mixed)
    mixed = mixed[order]
    starts = np.flatnonzero(np.concatenate(([True], mixed[1:] != mixed[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out, order[starts]


def _packed(*counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three counts in a document, each below 2**31, as two columns.

    The first holds 21 bits of each, the low bytes beside each other, as nearly
    all counts are small and rows compress best where few bytes in a row differ;
    the second holds the 10 bits above, nearly always none.
    """
    low, high = np.zeros(len(counts[0]), dtype=np.int64), np.zeros(len(counts[0]), dtype=np.int64)
    for i, c in enumerate(counts):
        low |= ((c & 0xFF) << (8 * i)) | (((c >> 8) & 0x1FFF) << (24 + 13 * i))
        high |= (c >> 21) << (10 * i)
    return low, high.astype(np.int32)


def _unpacked(low: str, high: str) -> list[Column]:
    """The counts that ``_packed`` put into the columns ``low`` and ``high``."""

    def bits(x: str, at: int, n: int, to: int) -> Column:
        return F.shiftleft(F.shiftright(F.col(x).cast("long"), at).bitwiseAND(F.lit((1 << n) - 1)), to)

    return [bits(low, 8 * i, 8, 0) + bits(low, 24 + 13 * i, 13, 8) + bits(high, 10 * i, 10, 21) for i in range(3)]


def score(docs: DataFrame, backoff: float = BACKOFF, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every document."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    most = min(most, 1 << _BITS)
    text = docs.select("text").where("text is not null")

    # words
    words = text.mapInArrow(_counted, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    words = cut(words, "words")
    total = words.agg(F.sum("c")).first()[0] or 1
    limit = frequent(words, most)
    known = _broadcast(words.where(F.col("c") >= limit).select("g", F.col("c").cast("double")))

    # bigrams: a, b are the words of a hashed one
    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paired: list[np.ndarray] = []
        hashed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = ["g", "a", "b", "c"]

        def flush() -> Iterator[pa.RecordBatch]:
            if paired:
                g, c = _tally(paired)
                none = pa.nulls(len(g), pa.int64())
                yield from _batches(names, [pa.array(g), none, none, pa.array(c, pa.int64())])
            if hashed:
                g, a, b = (np.concatenate(x) for x in zip(*hashed, strict=True))
                hashed.clear()
                g, first, c = np.unique(g, return_index=True, return_counts=True)
                yield from _batches(names, [pa.array(x, pa.int64()) for x in (g, a[first], b[first], c)])

        n = 0
        for batch in batches:
            for _, _, w, owner in _slices(batch.column("text")):
                keys, at, _ = _pairs(w.hash, owner, known.value)
                own = _word_keys(w.hash)
                rare = np.flatnonzero(keys < 0)
                paired.append(keys[keys >= 0])
                hashed.append((keys[rare], own[at[rare]], own[at[rare] + 1]))
                n += len(keys)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    # counted in Python already: to count again before the exchange costs memory and saves few rows
    pairs = text.mapInArrow(bigrams, "g long, a long, b long, c long").repartition("g").groupBy("g").agg(F.sum("c").alias("c"), F.max("a").alias("a"), F.max("b").alias("b"))
    pairs = cut(pairs.where(F.col("c") >= MIN_COUNT), "bigrams")
    release(spark)

    # each bigram with the counts of its words
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = known.value.values.astype(np.int64) if len(known.value.values) else np.zeros(1, dtype=np.int64)
        for b in batches:
            g = b.column("g").to_numpy()
            own = [pa.array(c[g >> _BITS] if len(g) else g), pa.array(c[g & ((1 << _BITS) - 1)] if len(g) else g)]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("c"), *own], names=["g", "c", "ca", "cb"])

    paired = pairs.where("g >= 0").select("g", "c").mapInArrow(counted, "g long, c long, ca long, cb long")
    one = words.select(F.col("g").alias("a"), F.col("c").alias("ca"))
    two = words.select(F.col("g").alias("b"), F.col("c").alias("cb"))
    hashed = pairs.where("g < 0").join(one, "a").join(two, "b").select("g", "c", "ca", "cb")
    values = cut(paired.union(hashed), "values", pairs)
    often = frequent(values, most)
    hot = _broadcast(values.where(F.col("c") >= often))
    rare = words.where(F.col("c") < limit).select("g", "c", F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"))
    release(spark)

    # documents: what is broadcast is summed in place, the other grams are exploded
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    log_off = float(np.log(backoff))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w, owner in _slices(batch.column("text")):
                n = np.diff(w.first)
                rest = np.log(np.maximum(total - n, 1))
                s = np.maximum(n - 1, 0) * log_off - n * rest
                if len(w.hash):
                    keys, at, place = _pairs(w.hash, owner, known.value)
                    k, _ = _inside(owner, w.hash)
                    own = np.flatnonzero(place >= 0)
                    left = np.log(np.maximum(known.value.values[place[own]] - k[own], 0.5))
                    s = s + np.bincount(owner[own], left, minlength=b - a)
                    found = hot.value.find(keys)
                    own = np.flatnonzero(found >= 0)
                    c, ca, cb = hot.value.values[found[own]].T
                    first = at[own]
                    c = c - _inside(owner[first], keys[own])[0]
                    own, first, c, ca, cb = (x[c > 0] for x in (own, first, c, ca, cb))
                    more = np.log(c) - np.log(ca - k[first]) - log_off - np.log(np.maximum(cb - k[first + 1], 0.5)) + rest[owner[first]]
                    s = s + np.bincount(owner[first], more, minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in ("doc_id", "row")], pa.array(n, pa.int64()), pa.array(s, pa.float64())],
                    names=["doc_id", "row", "n_words", "part"],
                )

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w, owner in _slices(batch.column("text")):
                if not len(w.hash):
                    continue
                keys, at, place = _pairs(w.hash, owner, known.value)
                k, _ = _inside(owner, w.hash)
                other = np.flatnonzero(hot.value.find(keys) < 0)
                kk, once = _inside(owner[at[other]], keys[other])
                other, kk = other[once], kk[once]
                word = np.flatnonzero(place < 0)
                word = word[_inside(owner[word], w.hash[word])[1]]
                g = np.concatenate([keys[other], _word_keys(w.hash[word])])
                text = np.concatenate([owner[at[other]], owner[word]])
                ka, kb = (np.concatenate([x, np.zeros(len(word), dtype=np.int64)]) for x in (k[at[other]], k[at[other] + 1]))
                kk = np.concatenate([kk, k[word]])
                order = np.argsort(text, kind="stable")
                columns = (batch.column("row").to_numpy()[a:b][text], g, *_packed(kk, ka, kb))
                yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in columns], names=["row", "g", "low", "high"])

    base = rows.mapInArrow(here, f"doc_id {kind}, row long, n_words long, part double")
    exploded = rows.select("row", "text").mapInArrow(there, "row long, g long, low long, high int")
    cold = values.where(F.col("c") < often).union(rare)
    k, ka, kb = _unpacked("low", "high")
    half = F.lit(0.5)
    more = F.log(F.col("c") - k) - F.log(F.col("ca") - ka) - F.lit(log_off) - F.log(F.greatest(F.col("cb") - kb, half))
    word, seen = F.col("ca") == 0, F.col("c") > k
    value = F.when(word, k * F.log(F.greatest(F.col("c") - k, half))).when(seen, k * more)
    sums = exploded.join(cold, "g").groupBy("row").agg(F.sum(value).alias("rest"), F.sum(F.when(~word & seen, k)).alias("used"))
    copies = rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    out = base.join(copies, "row").join(sums, "row", "left")
    others = F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)))
    rest = (F.coalesce("rest", F.lit(0.0)) + F.coalesce("used", F.lit(0)) * others) / F.col("copies")
    s = F.round(F.col("part") + rest, 6)
    return out.select("doc_id", "n_words", s.alias("log_score"), F.round(F.try_divide(s, F.col("n_words")), 6).alias("mean_log_score"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
