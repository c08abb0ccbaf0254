"""Quality rules with cross-document line frequency.

Base rules look at one text.  The verdict then counts, for every host (the
``source`` column) and normalised line (words lower-cased in A-Z and joined by
one space), the distinct documents that hold it; lines in more documents than
the host's limit are boilerplate and are removed; a document that has too few
words left is rejected.

A document counts by its set of normalised lines, so exact copies count once and
any other documents once each; near copies are left to deduplication.

Limit: a line goes where more than ``LIMIT`` documents of its host hold it, at
every size of host and corpus.
Depleted: fewer than MIN_WORDS words left, or under KEEP_PERCENT % of the words.

Cases: a null text has no words, fails the base rules and is not kept; rows
with a null host form one host; repeated rows are copies of one document;
an empty table gives an empty result; other columns are ignored or, in
``clean``, passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, small_batches, small_join, spare, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LIMIT = 10
KEEP_PERCENT = 25
#: Boilerplate lines are broadcast up to this count (16 bytes and a host name each).
BROADCAST_LINES = 200_000
#: Documents to change are broadcast up to this count.
BROADCAST_DOCS = 200_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def line_key(line: bytes) -> int | None:
    """First 60 bits of the md5 of the normalised line; None without a word."""
    words = line.lower().split()
    return int(hashlib.md5(b" ".join(words)).hexdigest()[:15], 16) if words else None


def _repeats(words: K.Words) -> np.ndarray:
    """Words of each text inside a 5-word window that the text holds twice or more."""
    texts = len(words.offsets) - 1
    hashes, n = words.hash, len(words.hash)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= WINDOW:
        owner = np.repeat(np.arange(texts), np.diff(words.first))
        g = K.grams(hashes, WINDOW)
        at = np.flatnonzero(owner[: len(g)] == owner[WINDOW - 1 :])
        with np.errstate(over="ignore"):
            g = K.mix(g[at] + owner[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = at[twice]
        covered += np.bincount(hit, minlength=n + 1) - np.bincount(hit + WINDOW, minlength=n + 1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:n]) > 0)))
    return inside[words.first[1:]] - inside[words.first[:-1]]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<bigint>, line_words array<int>"


def _stats(column: pa.Array) -> list[pa.Array]:
    data, offsets = K.strings(column)
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    keys: list[list[int]] = []
    counts: list[list[int]] = []
    for a, b in K.slices(offsets, K.SMALL_SLICE):
        own = offsets[a : b + 1] - offsets[a]
        chunk = data[offsets[a] : offsets[b]]
        w = K.words(chunk, own, lower=False)
        space = K._SPACE[chunk]
        dup = np.zeros(b - a, dtype=np.int64)
        for k in range(b - a):
            seen, own_keys, own_counts = set(), [], []
            for line in chunk[own[k] : own[k + 1]].tobytes().split(b"\n"):
                ws = line.lower().split()
                if not ws:
                    continue
                if line in seen:
                    dup[k] += 1
                seen.add(line)
                own_keys.append(int(hashlib.md5(b" ".join(ws)).hexdigest()[:15], 16))
                own_counts.append(len(ws))
            keys.append(own_keys)
            counts.append(own_counts)
        for to, x in zip(
            parts,
            (np.diff(w.first), _per_text(~space & ((chunk & 0xC0) != 0x80), own), _per_text(_SYMBOL[chunk], own), dup, _repeats(w)),
            strict=True,
        ):
            to.append(x)
    flat = [pa.array(np.concatenate(p) if p else np.zeros(0, dtype=np.int64), pa.int64()) for p in parts]
    return [*flat, pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]


def line_stats(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, host, the base counts and each line's key and words; a map without exchange."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    own = ["doc_id", "source", *extra]
    names = [*own, *[x.split()[0] for x in STATS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.forget()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *_stats(b.column("text"))], names=names)

    out = docs.select(*own, "text").mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in own], STATS]))
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def boilerplate(stats: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, line) of the lines that stand in more than ``limit`` distinct documents.

    A document counts by the hash of its set of lines.  These are first made
    distinct with a count on each map side, so that a common line or host reaches
    a task as few rows.
    """
    seen = stats.select(F.coalesce("source", F.lit("")).alias("host"), F.array_sort(F.array_distinct("lines")).alias("l"))
    pairs = seen.select("host", F.explode("l").alias("line"), F.xxhash64("l").alias("document"))
    return pairs.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("host", "line")


def judged(stats: DataFrame, keep_percent: int = KEEP_PERCENT, limit: int = LIMIT) -> DataFrame:
    """``stats`` with ``kept_words``, ``kept`` and the ``removed`` line keys."""
    each = cut(stats.withColumn("_row", F.monotonically_increasing_id()), "linestats")
    common = cut(boilerplate(each, limit), "boilerplate")
    found = each.select("_row", F.coalesce("source", F.lit("")).alias("host"), F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    found = found.select("_row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hit = small_join(found, common, ["host", "line"], "inner", BROADCAST_LINES)
    hit = hit.groupBy("_row").agg(F.sum("words").alias("gone"), F.collect_set("line").alias("removed"))
    out = each.join(hit, "_row", "left").withColumn("kept_words", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    depleted = (F.col("kept_words") < MIN_WORDS) | (100 * F.col("kept_words") < keep_percent * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def _key_column(line: Column) -> Column:
    """``line_key`` as an expression."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.trim(F.regexp_replace(low, "[\\x20\\x09-\\x0D]+", " "))
    return F.conv(F.substring(F.md5(norm), 1, 15), 16, 10).cast("long")


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with boilerplate lines removed, in the columns of ``docs``.

    Text and n_chars change only where a line goes.  Documents that need a
    change are the exception, and only they are joined.
    """
    doc, key, kept, gone = spare(docs, "doc", "key", "kept", "gone")
    stats = line_stats(docs.select("doc_id", "source", "text", F.xxhash64("text").alias(key)), extra=[key])
    odd = judged(stats).where("not kept or removed is not null")
    odd = odd.select(F.col("doc_id").alias(doc), key, F.col("kept").alias(kept), F.col("removed").alias(gone))
    odd = cut(odd.dropDuplicates([doc, key]), "lineverdicts")
    on = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key))
    out = small_join(docs, odd, on, "left", BROADCAST_DOCS).where(F.coalesce(kept, F.lit(True)))
    changed = F.col(gone).isNotNull()
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(gone, _key_column(x)))
    out = out.withColumn("text", F.when(changed, F.array_join(lines, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(line_stats(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words"
    )
