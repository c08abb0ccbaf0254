"""Byte-pair merges of a corpus of any number of distinct words, the same as merging word by word in one process.

The words stay in Spark, as blobs of symbols.  The driver holds the totals of
adjacent pairs, whose number follows the vocabulary and not the corpus, and
foretells the next merges on a sample of the words.  One pass over all words
applies the foretold merges and returns by how much each of them changes the
totals.  With those the driver checks every merge: it is taken only if it is the
one with the largest total over all words, and where the forecast was wrong the
next pass starts there.  So the sample decides how many passes there are, and
never what is merged.
"""

from __future__ import annotations

import heapq
import keyword
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.durable import cut, discard

#: Words that the driver takes for its forecasts; where there are no more, it merges them all itself.
SAMPLE = 1 << 17
#: Symbols of a blob, and changes of totals that a task holds before it adds them up.
BLOB, HELD = 1 << 18, 1 << 21
#: Merges that one pass applies, and merges that are applied anew in each pass before the words are written with them.
PASS, PENDING = 256, 48
#: Symbols are code points, products of merges above them; a pair or a change is one long.
BITS = 21
PRODUCT = 0x110000
_LOW = (1 << BITS) - 1
STATE = "symbols binary, freq binary"


def pair_key(a: int, b: int) -> int:
    return a << BITS | b


def flat(words: Sequence[str]) -> np.ndarray:
    """Code points of the words, with 0 before, between and after them."""
    return np.frombuffer(f"\0{chr(0).join(words)}\0".encode("utf-32-le", "surrogatepass"), dtype=np.int32)


def word_of(x: np.ndarray) -> np.ndarray:
    """Number of the word of each symbol."""
    return (np.cumsum(x == 0, dtype=np.int64) - 1).astype(np.int32)


def _keys(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at ``at`` inside a word, and where they begin."""
    at = at[(x[at] != 0) & (x[at + 1] != 0)]
    return x[at].astype(np.int64) << BITS | x[at + 1], at


def find(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where the pair stands, from left to right and without overlaps."""
    i = np.flatnonzero(x[:-1] == a)
    i = i[x[i + 1] == b]
    if a == b and len(i) > 1:
        first = np.concatenate(([True], np.diff(i) > 1))
        n = np.arange(len(i))
        i = i[(n - np.maximum.accumulate(np.where(first, n, 0))) % 2 == 0]
    return i


def merge(x: np.ndarray, word: np.ndarray, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
    """Symbols and their words after a merge, and (pairs, their words, sign) of what it changed."""
    i = find(x, a, b)
    if not len(i):
        return x, word, []
    apart = np.concatenate(([True], np.diff(i) > 2))
    old, at = _keys(x, np.concatenate((i[apart] - 1, i, i + 1)))
    changed = [(old, word[at], -1)]
    keep = np.ones(len(x), dtype=bool)
    keep[i + 1] = False
    x = x.copy()
    x[i] = new
    x, word = x[keep], word[keep]
    j = i - np.arange(len(i))
    fresh, at = _keys(x, np.concatenate((j[apart] - 1, j)))
    changed.append((fresh, word[at], 1))
    return x, word, changed


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.add.reduceat(n, first)
    return keys[first][n != 0], n[n != 0]


def pack(counts: DataFrame) -> DataFrame:
    """Blobs of some ``BLOB`` symbols from word and n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blob() -> pd.DataFrame:
            return pd.DataFrame({"symbols": [flat(words).tobytes()], "freq": [np.array(freq, dtype=np.int64).tobytes()]})

        words, freq, size = [], [], 0
        for batch in batches:
            for w, n in zip(batch["word"], batch["n"], strict=True):
                words.append(w)
                freq.append(n)
                size += len(w) + 1
                if size >= BLOB:
                    yield blob()
                    words, freq, size = [], [], 0
        if words:
            yield blob()

    return counts.select("word", "n").mapInPandas(run, STATE)


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for s, f in zip(batch["symbols"], batch["freq"], strict=True):
            x = np.frombuffer(s, dtype=np.int32)
            yield x, word_of(x), np.frombuffer(f, dtype=np.int64)


def totals(state: DataFrame) -> DataFrame:
    """key and n: the total of every pair, and of every symbol under the symbol itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for x, word, freq in _blobs(batches):
            pairs, at = _keys(x, np.arange(len(x) - 1))
            single = np.flatnonzero(x != 0)
            keys, n = added(np.concatenate((keys, pairs, x[single].astype(np.int64))), np.concatenate((n, freq[word[at]], freq[word[single]])))
        yield pd.DataFrame({"key": keys, "n": n})

    return state.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def merged(state: DataFrame, done: Sequence[tuple[int, int, int]]) -> DataFrame:
    """The words after merges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, word, freq in _blobs(batches):
            for m in done:
                x, word, _ = merge(x, word, *m)
            yield pd.DataFrame({"symbols": [x.tobytes()], "freq": [freq.tobytes()]})

    return state.mapInPandas(run, STATE)


def changes(state: DataFrame, done: Sequence[tuple[int, int, int]], steps: Sequence[tuple[int, int, int]]) -> DataFrame:
    """step, key and n: by how much each of ``steps`` changes the total of a pair, after ``done``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for x, word, freq in _blobs(batches):
            for m in done:
                x, word, _ = merge(x, word, *m)
            for step, m in enumerate(steps):
                x, word, changed = merge(x, word, *m)
                for keys, words, sign in changed:
                    held.append((keys | step << 2 * BITS, freq[words] * sign))
                    size += len(keys)
            if size >= HELD:
                held = [added(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield _out(*held[0])
                    held, size = [], 0
        if held:
            yield _out(*added(*map(np.concatenate, zip(*held, strict=True))))

    def _out(keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"step": (keys >> 2 * BITS).astype(np.int32), "key": keys & (1 << 2 * BITS) - 1, "n": n})

    return state.mapInPandas(run, "step int, key long, n long").groupBy("step", "key").agg(F.sum("n").alias("n")).where("n <> 0")


class Names:
    """Texts of symbols; what has the same text is the same symbol."""

    def __init__(self) -> None:
        self.products: list[str] = []
        self.numbers: dict[str, int] = {}

    def text(self, symbol: int) -> str:
        return self.products[symbol - PRODUCT] if symbol >= PRODUCT else chr(symbol)

    def pair(self, key: int) -> tuple[str, str]:
        return self.text(key >> BITS), self.text(key & _LOW)

    def product(self, key: int) -> int:
        text = "".join(self.pair(key))
        if text not in self.numbers:
            if PRODUCT + len(self.products) > _LOW:
                raise ValueError("too many merges")
            self.numbers[text] = PRODUCT + len(self.products)
            self.products.append(text)
        return self.numbers[text]


class Totals:
    """Totals of pairs; the largest comes first, ties by their texts."""

    def __init__(self, totals: dict[int, int | float], names: Names) -> None:
        self.n, self.names, self.made = totals, names, set()
        self.heap = [(-n, names.pair(k), k) for k, n in totals.items() if n > 0]
        heapq.heapify(self.heap)

    def copy(self) -> Totals:
        other = Totals({}, self.names)
        other.n, other.heap = dict(self.n), list(self.heap)
        return other

    def best(self) -> int | None:
        """The pair of the largest total, if there is one above 0."""
        while self.heap:
            n, _, key = self.heap[0]
            if n < 0 and self.n.get(key, 0) == -n:
                return key
            heapq.heappop(self.heap)
        return None

    def change(self, changes: dict[int, int | float]) -> None:
        for key, n in changes.items():
            total = self.n.get(key, 0) + n
            if total > 0:
                self.n[key] = total
                heapq.heappush(self.heap, (-total, self.names.pair(key), key))
            else:
                self.n.pop(key, None)
        if len(self.heap) > 4 * len(self.n) + 1000:
            self.heap = [(-n, self.names.pair(k), k) for k, n in self.n.items()]
            heapq.heapify(self.heap)

    def leading(self, most: int) -> list[int]:
        """Up to ``most`` next merges that are certain whatever the words are.

        They share no symbol, their products are new, and their totals are above
        that of the next pair.  A merge then changes no other one's total, and a
        pair with its product stands where a pair with one of its symbols stood,
        whose total was below all of theirs.
        """
        taken, symbols, made = [], set(), set(self.made)
        out: list[int] = []
        while len(taken) <= most and (key := self.best()) is not None:
            entry = heapq.heappop(self.heap)
            if taken and taken[-1] == entry:
                continue
            taken.append(entry)
            a, b, product = key >> BITS, key & _LOW, "".join(entry[1])
            if a == b or a in symbols or b in symbols or product in made:
                break
            symbols |= {a, b}
            made.add(product)
        for entry in taken:
            heapq.heappush(self.heap, entry)
        for k in range(len(taken) - 1):
            if taken[k][0] < taken[k + 1][0]:
                out = [e[2] for e in taken[: k + 1]]
        return out


class Forecast:
    """The merges to come, from a sample of words with weights and the totals over all words."""

    def __init__(self, words: Sequence[str], freq: Sequence[float]) -> None:
        self.x = flat(words)
        self.word, self.freq = word_of(self.x), np.array(freq, dtype=np.float64)

    def take(self, done: Sequence[tuple[int, int, int]]) -> None:
        for m in done:
            self.x, self.word, _ = merge(self.x, self.word, *m)

    def next(self, now: Totals, most: int) -> list[tuple[int, int, int]]:
        guess, x, word, out = now.copy(), self.x, self.word, []
        while len(out) < most and (key := guess.best()) is not None:
            step = (key >> BITS, key & _LOW, guess.names.product(key))
            out.append(step)
            x, word, changed = merge(x, word, *step)
            rows: dict[int, float] = {}
            if changed:
                keys, n = added(np.concatenate([k for k, _, _ in changed]), np.concatenate([self.freq[w] * sign for _, w, sign in changed]))
                rows = dict(zip(keys.tolist(), n.tolist(), strict=True))
            guess.change(rows | {key: -guess.n[key]})
        return out


def _sample(counts: DataFrame, words: int) -> Forecast:
    """Half of ``SAMPLE`` are the most frequent words, as far as whole grades of frequency fit; the others stand for the rest."""
    grade = F.floor(F.log2("n") * 16)
    half = SAMPLE // 2
    top, least = 0, None
    for r in counts.groupBy(grade.alias("k")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("k")).toLocalIterator():
        if top + r["words"] > half:
            break
        top, least = top + r["words"], r["n"]
    share = max(1, -(-(words - top) // half))
    frequent = F.col("n") >= least if least else F.lit(False)
    rows = counts.where(frequent | (F.pmod(F.xxhash64("word"), F.lit(share)) == 0)).select("word", "n", frequent.alias("f")).toLocalIterator()
    found = [(r["word"], float(r["n"] if r["f"] else r["n"] * share)) for r in rows]
    return Forecast([w for w, _ in found], [n for _, n in found])


def _accepted(now: Totals, steps: Sequence[tuple[int, int, int]], rows: list[dict[int, int]], room) -> list[tuple[int, int, int]]:
    """The steps that are the next merges over all words; ``now`` is brought up to date.

    Merges that are certain together may have been foretold in another order,
    which gives the same words and totals after the last of them.
    """
    done: list[tuple[int, int, int]] = []
    while len(done) < len(steps) and room(done):
        at = len(done)
        if now.best() == pair_key(*steps[at][:2]):
            size = 1
            now.change(rows[at])
            done.append(steps[at])
        else:
            lead = now.leading(len(steps) - at)
            by_key = {pair_key(*m[:2]): m for m in steps[at : at + len(lead)]}
            size = next((k for k in range(2, len(lead) + 1) if set(lead[:k]) == {pair_key(*m[:2]) for m in steps[at : at + k]}), 0)
            if not size or not room([*done, *[by_key[k] for k in lead[: size - 1]]]):
                return done
            for k in range(at, at + size):
                now.change(rows[k])
            done += [by_key[k] for k in lead[:size]]
        now.made |= {now.names.text(m[2]) for m in done[-size:]}
    return done


def train(counts: DataFrame, words: int, size: int, special: Sequence[str]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of the ``words`` words of ``counts`` (word, n): the most frequent pair first, ties by its text."""
    names = Names()
    state = cut(pack(counts), "words")
    first = dict(zip(*(x.to_pylist() for x in totals(state).toArrow().columns), strict=True))
    letters = {chr(k) for k in first if k >> BITS == 0} | {k[0] for k in keyword.kwlist}
    now = Totals({k: n for k, n in first.items() if k >> BITS}, names)
    vocab = {t: i for i, t in enumerate([*special, *sorted(letters)])}
    forecast = _sample(counts, words)
    merges: list[tuple[str, str]] = []
    pending: list[tuple[int, int, int]] = []
    most = 64

    def room(done: Sequence[tuple[int, int, int]]) -> bool:
        return len({names.text(m[2]) for m in done} - vocab.keys()) + len(vocab) < size

    while room([]) and now.best() is not None:
        steps = forecast.next(now, min(most, PASS))
        rows: list[dict[int, int]] = [{} for _ in steps]
        for step, key, n in zip(*(x.to_pylist() for x in changes(state, pending, steps).toArrow().columns), strict=True):
            rows[step][key] = n
        done = _accepted(now, steps, rows, room)
        for a, b, new in done:
            merges.append((names.text(a), names.text(b)))
            vocab.setdefault(names.text(new), len(vocab))
        forecast.take(done)
        pending += done
        most = max(16, 2 * len(done))
        if len(pending) >= PENDING and room([]):
            used, state = state, cut(merged(state, pending), "words")
            discard(used)
            pending = []
    discard(state)
    return vocab, merges
