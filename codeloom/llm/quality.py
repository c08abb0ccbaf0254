"""Document quality by positive-unlabelled learning.

Trusted positives are training rows labelled 1; the unlabelled set is a sample
of all training rows, whatever their label.  With class prior p and logistic
loss l, the model minimises the non-negative unbiased risk

    p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)])

(Kiryo et al. 2017): while the second part is negative its gradient is turned
round.  f is additive over features of the text, each cut into quantile bins, so
sigmoid(f) estimates the chance of label 1.  The prior is estimated without
negative labels: for any set S of texts the unlabelled share of S is at least
the prior times the positives' share, so the prior is near the smallest quotient
of the two over the sets {f >= t} (Scott 2015), with f of rows that it was
not fitted to.

Learning takes at most ``POSITIVES`` and ``UNLABELLED`` rows, those with the
smallest hash of doc_id; every document, whole, is scored.

Cases: a null text counts as empty; an empty text gets the score of its
features (none of its features is undefined); labels repeated for a document
count once, the largest; without positives every score is the prior 0.5; a null
doc_id is not held out; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import bounded, held_out, table
from .linefreq import _per_text, _repeats

POSITIVES = 12_000
UNLABELLED = 24_000
THRESHOLD = 0.7
#: Least share of the positives from which the prior is read.
TAIL = 0.2
FOLDS = 4
BINS = 24
STEPS = 600


def _bytes(text: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(text)] = True
    return out


_CLASSES = {
    "upper": _bytes(bytes(range(65, 91))),
    "lower": _bytes(bytes(range(97, 123))),
    "digit": _bytes(b"0123456789"),
    "hash_symbols": _bytes(b"#*$%&<>@^~=_\\{}[]"),
    "bars": _bytes(b"|"),
    "shouts": _bytes(b"!?"),
    "stops": _bytes(b".,;:"),
    "newline": _bytes(b"\n"),
    "other": _bytes(bytes(range(128, 256))),
}
FEATURES = ["log_words", "word_length", "repeat", "types", "line_words", "dup_lines", "upper_words", *_CLASSES]


def features(column: pa.Array) -> np.ndarray:
    """(texts x features) of a string column."""
    data, offsets = K.strings(column)
    out = []
    for a, b in K.slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        chunk = data[offsets[a] : offsets[b]]
        w = K.words(chunk, own, lower=False)
        n = np.diff(w.first).astype(float)
        one = np.maximum(n, 1)
        size = np.maximum(np.diff(own), 1).astype(float)
        owner = np.repeat(np.arange(b - a), np.diff(w.first))
        with np.errstate(over="ignore"):
            mixed = K.mix(w.hash + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        _, first = np.unique(mixed, return_index=True)
        types = np.bincount(owner[first], minlength=b - a)
        starts = chunk[w.start] if len(chunk) else chunk
        loud = np.bincount(owner[(starts >= 65) & (starts < 91)], minlength=b - a)
        # lines: hashes of the stretches between line breaks
        breaks = np.flatnonzero(chunk == 10)
        cuts = np.union1d(own[:-1], breaks + 1)
        cuts = cuts[cuts < len(chunk)] if len(chunk) else cuts[:0]
        ends = np.append(cuts[1:], len(chunk)) if len(cuts) else cuts
        line_owner = np.searchsorted(own, cuts, side="right") - 1
        ends = np.maximum(np.where(chunk[ends - 1] == 10, ends - 1, ends), cuts) if len(cuts) else ends
        full = ends > cuts
        lines = np.bincount(line_owner[full], minlength=b - a).astype(float)
        with np.errstate(over="ignore"):
            h = K.mix(K.spans(chunk, cuts[full], ends[full]) + line_owner[full].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        _, first = np.unique(h, return_index=True)
        distinct = np.bincount(line_owner[full][first], minlength=b - a)
        columns = [
            np.log1p(n),
            size / one,
            _repeats(w) / one,
            types / one,
            n / np.maximum(lines, 1),
            1 - distinct / np.maximum(lines, 1),
            loud / one,
            *[_per_text(c[chunk], own) / size for c in _CLASSES.values()],
        ]
        out.append(np.column_stack(columns))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class Model:
    """Additive model over binned features."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float) -> None:
        self.edges, self.weights, self.bias = edges, weights, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k]) + k * (BINS + 1) for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.weights[self.bins(x)].sum(axis=1) + self.bias if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-f))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk by full-batch Adam."""
    edges = []
    for k in range(unlabelled.shape[1]):
        both = np.concatenate([unlabelled[:, k], positive[:, k]])
        edges.append(np.unique(np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1])))
    model = Model(edges, np.zeros(len(edges) * (BINS + 1)), float(np.log(prior / (1 - prior))))
    size = len(model.weights)
    bp, bu = model.bins(positive), model.bins(unlabelled)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        sp = 1 / (1 + np.exp(-(model.weights[bp].sum(axis=1) + model.bias)))
        su = 1 / (1 + np.exp(-(model.weights[bu].sum(axis=1) + model.bias)))
        # loss l(f) = -log s, l(-f) = -log(1 - s); derivatives s - 1 and s
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        gp_positive, gp_negative, gu = prior * (sp - 1) / len(sp), -prior * sp / len(sp), su / len(su)
        if negative < 0:
            dp, du = -gp_negative, -gu
        else:
            dp, du = gp_positive + gp_negative, gu
        grad = np.append(
            np.bincount(bp.ravel(), np.repeat(dp, bp.shape[1]), size) + np.bincount(bu.ravel(), np.repeat(du, bu.shape[1]), size) + decay * model.weights,
            dp.sum() + du.sum(),
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights -= move[:-1]
        model.bias -= float(move[-1])
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from positive and unlabelled rows alone.

    Sets with under ``TAIL`` of the positives are too small to tell.  Each part of
    the rows is scored by a model of the other parts.
    """
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for k in range(FOLDS):
        own, other = (np.arange(len(x)) % FOLDS == k for x in (positive, unlabelled))
        if min(len(positive), len(unlabelled)) <= FOLDS:
            own, other = np.zeros(len(positive), dtype=bool), np.zeros(len(unlabelled), dtype=bool)
        model = fit(positive[~own], unlabelled[~other], 0.5, STEPS // 2)
        own, other = (own, other) if own.any() else (~own, ~other)
        p[own], u[other] = model.score(positive[own]), model.score(unlabelled[other])
    p, u = np.sort(p), np.sort(u)
    if not len(p) or not len(u):
        return 0.5
    limits = np.unique(np.quantile(p, np.linspace(0, 1 - TAIL, 50)))
    above_p, above_u = (1 - np.searchsorted(x, limits) / len(x) for x in (p, u))
    # a quotient counts with its standard error, or the smallest would be the luckiest
    quotient = above_u / above_p
    error = quotient * np.sqrt((1 - above_p) / (above_p * len(p)) + (1 - above_u) / np.maximum(above_u * len(u), 1))
    return float(min(1.0, (quotient + error).min()))


def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the ``most`` rows with the smallest hash of doc_id."""
    n = rows.count()
    if n > most:
        # a threshold a little above the share, then the exact cut on what is left
        limit = int(-(2**63) + 2**64 * min(1.0, 1.3 * most / n + 200 / n))
        rows = rows.where(F.xxhash64("doc_id") <= F.lit(min(limit, 2**63 - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(features(b.column("text")).tolist(), pa.list_(pa.float64()))], names=["h", "x"])

    found = rows.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "h long, x array<double>")
    found = found.orderBy("h", "x").limit(most).toPandas()
    return np.array(found["x"].tolist()).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Model of label 1 from training rows alone; None without a positive."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = marks.where(~held_out())
    train = docs.select("doc_id", "text").where(~held_out())
    chosen = marks.where("quality = 1").select("doc_id")
    if not bounded(chosen, positives):
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    p = _sampled(train.join(chosen, "doc_id", "left_semi"), positives)
    u = _sampled(train, unlabelled)
    if not len(p) or not len(u):
        return None
    return fit(p, u, min(max(estimated_prior(p, u), 0.02), 0.98))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a map without exchange."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                s = model.score(features(b.column("text"))) if model else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
