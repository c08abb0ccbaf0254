"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of -1 and +1.  An n-gram's vector binds
(multiplies) its letters' vectors, each rotated by its place; a document
bundles (adds) the vectors of its n-grams; a language's prototype bundles the
unit vectors of its training documents.  A document gets the language whose
prototype, less the mean of all prototypes, has the largest cosine with it.

Letters are lower-cased; every run of other characters is one boundary.  The
bundle of many documents at once is a product of their n-gram counts with the
n-gram vectors, so the cost is a few matrix products.

Learning takes at most ``SAMPLE`` documents of each language, those with the
smallest hash of doc_id among the rows that are not held out and have a
language; all documents, whole, are predicted.

Cases: a null text, or one without letters, is ``und`` with score 0; ties go to
the language first in order; with nothing to learn from all rows are ``und``;
a null doc_id is not held out; repeated rows get the same answer; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel as K
from .common import held_out, small_join, table

DIMENSIONS = 512
ORDER = 3
SAMPLE = 1500
#: Counts of languages are broadcast up to this number.
LANGUAGES = 10_000
UNKNOWN = "und"
_SLICE = 1 << 20
#: n-gram numbers up to this are looked up in a table, others are sorted.
_DENSE = 1 << 24


def _letter_table() -> np.ndarray:
    """For each code point of all planes 0 if it is no letter, else the lower-case letter."""
    codes = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            codes[c] = ord(ch.lower()[0])
    return codes


class Encoder:
    """Bundles of texts; ``seed`` fixes the letters' vectors, which are hashes of the letters."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.codes = _letter_table()
        self.seen = np.zeros(0x110000, dtype=bool)
        self.local = np.zeros(0x110000, dtype=np.int64)

    def letters(self, codes: np.ndarray, place: int = ORDER - 1) -> np.ndarray:
        """Vectors of -1 and +1 of letters, rotated by their place in an n-gram."""
        parts = np.arange(-(-self.dimensions // 64), dtype=np.uint64) + np.uint64(self.seed << 32)
        with np.errstate(over="ignore"):
            bits = K.mix(K.mix(codes.astype(np.uint64))[:, None] + parts * np.uint64(0x9E3779B97F4A7C15))
        bits = np.unpackbits(bits.view(np.uint8), axis=1)[:, : self.dimensions]
        return np.roll(bits.astype(np.int8) * 2 - 1, ORDER - 1 - place, axis=1)

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x dimensions) bundles and the number of n-grams in each."""
        counts = np.zeros(len(texts), dtype=np.int64)
        parts, owners = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            codes = self.codes[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            if not codes.any():
                continue
            codes = np.concatenate(([0], codes, [0]))
            codes = codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))]
            parts.append(codes)
            counts[i] = len(codes) - ORDER + 1
            owners.append((i, counts[i]))
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        if not parts:
            return out, counts
        # letters of these texts are numbered, and n-grams by their letters' numbers
        codes = np.concatenate(parts)
        self.seen[codes] = True
        letters = np.flatnonzero(self.seen)
        self.seen[letters] = False
        self.local[letters] = np.arange(len(letters))
        own, size = self.local[codes], len(letters)
        g = (own[:-2] * size + own[1:-1]) * size + own[2:]
        # without the n-grams that reach from one text into the next
        g = g[np.concatenate([np.arange(len(p) - ORDER + 1) + e for p, e in zip(parts, np.cumsum([0, *map(len, parts[:-1])]), strict=True)])]
        if size**ORDER <= _DENSE:
            there = np.zeros(size**ORDER, dtype=bool)
            there[g] = True
            seen = np.flatnonzero(there)
            number = np.zeros(size**ORDER, dtype=np.int32)
            number[seen] = np.arange(len(seen))
            at = number[g]
        else:
            seen, at = np.unique(g, return_inverse=True)
        placed = [self.letters(letters, k) for k in range(ORDER)]
        # as many texts and n-grams at a time as keep the matrices near 8 M numbers
        ends = np.cumsum([n for _, n in owners])
        for low in range(0, len(seen), 1 << 14):
            some = seen[low : low + (1 << 14)]
            vectors = (placed[0][some // size**2] * placed[1][some // size % size] * placed[2][some % size]).astype(np.float32)
            step = max(1, 8_000_000 // len(some))
            for k in range(0, len(owners), step):
                chosen = owners[k : k + step]
                a, b = ends[k] - chosen[0][1], ends[k + len(chosen) - 1]
                row, column = np.repeat(np.arange(len(chosen)), [n for _, n in chosen]), at[a:b] - low
                if len(seen) > len(some):
                    inside = (column >= 0) & (column < len(some))
                    row, column = row[inside], column[inside]
                h = np.bincount(row * len(some) + column, minlength=len(chosen) * len(some)).reshape(len(chosen), -1)
                out[[i for i, _ in chosen]] += h.astype(np.float32) @ vectors
        return out, counts


def encoder() -> Encoder:
    return K.keep("letters", Encoder)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    _, offsets = K.strings(column)
    for a, b in K.slices(offsets, _SLICE):
        yield a, b, column.slice(a, b - a).to_pylist()


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes less the mean of all."""
    rows = docs.where("lang is not null and text is not null").where(~held_out())
    # rows above a hash that leaves a few more than the sample are no candidates, so a rank is over few rows of a language
    h, share = F.xxhash64("doc_id"), F.least(F.lit(1.0), (1.3 * sample + 200) / F.col("_n"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    few = small_join(rows.select("lang", "doc_id"), sizes, "lang", "inner", LANGUAGES).where(h.cast("double") <= -(2.0**63) + share * 2.0**64)
    rank = Window.partitionBy("lang").orderBy(h, "doc_id")
    top = few.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= sample)
    # one number for each language comes to the driver, and text is read once more only below it
    limits = top.groupBy("lang").agg(F.max(F.xxhash64("doc_id")).alias("most")).collect()
    if not limits:
        return [], np.zeros((0, DIMENSIONS))
    limit = F.create_map(*[F.lit(v) for r in limits for v in (r["lang"], r["most"])])
    chosen = rows.where(F.xxhash64("doc_id") <= F.element_at(limit, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b, texts in _texts(batch.column("text")):
                unit = _unit(encoder().bundle(texts)[0]).astype(np.float64)
                for lang, v in zip(batch.column("lang").slice(a, b - a).to_pylist(), unit, strict=True):
                    total[lang] = total.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"]
        )

    parts = chosen.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "v"))
    sums = parts.groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in sums})
    out = np.zeros((len(langs), DIMENSIONS))
    for r in sums:
        out[langs.index(r["lang"]), r["k"]] = r["v"]
    out = _unit(out)
    return langs, _unit(out - out.mean(axis=0)) if len(langs) > 1 else out


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; a map without exchange."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _texts(batch.column("text")):
                names: list[str] = [UNKNOWN] * len(texts)
                scores = np.zeros(len(texts))
                if langs:
                    v, n = encoder().bundle(texts)
                    cosine = _unit(v) @ prototypes.T
                    best = cosine.argmax(axis=1)
                    for i in np.flatnonzero(n):
                        names[i] = langs[best[i]]
                        scores[i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(names), pa.array(scores)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op1_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *learn(docs))
