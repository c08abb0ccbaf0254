"""Tokenizers, encoding with random cuts, windows, and token statistics."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.batches import bounded_batches, int_lists, slices
from codeloom.functions.durable import cut, discard
from codeloom.functions.random import Draws
from codeloom.functions.text import SPECIAL_TOKENS
from codeloom.operators import merges


class Tokenizer(Protocol):
    """What operators ask of a tokenizer; it must survive pickling."""

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and for each the number of characters of the text up to its end."""

    def decode(self, ids: Sequence[int]) -> str: ...

    def token_id(self, token: str) -> int: ...


@lru_cache(maxsize=64)
def _any_of(special: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, special)) or "(?!)")


@dataclass
class CharTokenizer:
    """Code points as ids, special tokens above them; needs no model."""

    special: tuple[str, ...] = SPECIAL_TOKENS
    first_special = 0x110000

    def _plain_ids(self, text: str) -> list[int]:
        return list(map(ord, text))

    def _plain(self, text: str, at: int) -> tuple[list[int], list[int]]:
        return self._plain_ids(text), list(range(at + 1, at + len(text) + 1))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        ends: list[int] = []
        at = 0
        for m in _any_of(self.special).finditer(text):
            for to, x in zip((ids, ends), self._plain(text[at : m.start()], at), strict=True):
                to.extend(x)
            at = m.end()
            ids.append(self.token_id(m[0]))
            ends.append(at)
        if not at:
            return self._plain(text, 0)
        for to, x in zip((ids, ends), self._plain(text[at:], at), strict=True):
            to.extend(x)
        return ids, ends

    def ids(self, text: str) -> list[int]:
        if _any_of(self.special).search(text):
            return self.encode(text)[0]
        return self._plain_ids(text)

    def _plain_text(self, ids: Sequence[int]) -> str:
        return "".join(map(chr, ids))

    def decode(self, ids: Sequence[int]) -> str:
        if not ids or max(ids) < self.first_special:
            return self._plain_text(ids)
        return "".join(chr(i) if i < self.first_special else self.special[i - self.first_special] for i in ids)

    def token_id(self, token: str) -> int:
        return self.first_special + self.special.index(token)


@dataclass
class ByteTokenizer(CharTokenizer):
    """UTF-8 bytes as ids, special tokens above them; needs no model."""

    first_special = 256

    def _plain_ids(self, text: str) -> list[int]:
        return list(text.encode("utf-8", "surrogatepass"))

    def _plain(self, text: str, at: int) -> tuple[list[int], list[int]]:
        ids = self._plain_ids(text)
        if len(ids) == len(text):
            return ids, list(range(at + 1, at + len(text) + 1))
        # a character's bytes but the last end where the one before it ends
        ends: list[int] = []
        for c in text:
            size = len(c.encode("utf-8", "surrogatepass"))
            ends += [at] * (size - 1) + [at + 1]
            at += 1
        return ids, ends

    def _plain_text(self, ids: Sequence[int]) -> str:
        return bytes(ids).decode("utf-8", "replace")

    def decode(self, ids: Sequence[int]) -> str:
        if not ids or max(ids) < 256:
            return self._plain_text(ids)
        data = b"".join(bytes([i]) if i < 256 else self.special[i - 256].encode() for i in ids)
        return data.decode("utf-8", "replace")


@dataclass
class JsonTokenizer:
    """A model file of the ``tokenizers`` library, held as text and built once per worker."""

    model: str
    _built: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"model": self.model, "_built": None}

    @property
    def built(self):
        if self._built is None:
            from tokenizers import Tokenizer as Backend

            self._built = Backend.from_str(self.model)
        return self._built

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        e = self.built.encode(text, add_special_tokens=False)
        return e.ids, [b for _, b in e.offsets]

    def ids(self, text: str) -> list[int]:
        return self.built.encode(text, add_special_tokens=False).ids

    def decode(self, ids: Sequence[int]) -> str:
        return self.built.decode(list(ids), skip_special_tokens=False)

    def token_id(self, token: str) -> int:
        found = self.built.token_to_id(token)
        if found is None:
            raise KeyError(f"the tokenizer has no {token}")
        return found

    def vocabulary(self) -> dict[str, int]:
        return self.built.get_vocab(with_added_tokens=True)


def load_tokenizer(path: str) -> JsonTokenizer:
    with open(path, encoding="utf-8") as f:
        return JsonTokenizer(f.read())


def save_tokenizer(tokenizer: JsonTokenizer, directory: str, bos: str = "<BOS>", eos: str = "<EOS>", unk: str = "<UNK>") -> None:
    """tokenizer.json, and beside it the names of the special tokens."""
    from pathlib import Path

    root = Path(directory)
    root.mkdir(parents=True, exist_ok=True)
    (root / "tokenizer.json").write_text(tokenizer.model, encoding="utf-8")
    names = {"bos_token": bos, "eos_token": eos, "unk_token": unk, "add_bos_token": False, "add_eos_token": False}
    (root / "tokenizer_config.json").write_text(json.dumps(names, indent=1), encoding="utf-8")


def cut_points(code: str, draws: Draws, special: Sequence[str] = SPECIAL_TOKENS, longest: int = 100) -> list[int]:
    """Ends of random pieces of 1..``longest`` characters, never inside a special token."""
    inside: dict[int, int] = {}
    for token in special:
        at = code.find(token)
        while at >= 0:
            inside.update({k: at + len(token) for k in range(at + 1, at + len(token))})
            at = code.find(token, at + len(token))
    ends, at = [], 0
    while True:
        at += 1 + draws.below(longest)
        if at >= len(code):
            return [*ends, len(code)]
        at = inside.get(at, at)
        ends.append(at)


def ids_of(tokenizer: Tokenizer, text: str) -> list[int]:
    """Ids alone; a tokenizer that has ``ids`` need not find where they end."""
    return tokenizer.ids(text) if hasattr(tokenizer, "ids") else tokenizer.encode(text)[0]


def encode_cut(tokenizer: Tokenizer, code: str, draws: Draws) -> list[int]:
    """Ids of the pieces between random cuts: subwords vary with the draws."""
    ids: list[int] = []
    begin = 0
    for end in cut_points(code, draws):
        ids.extend(ids_of(tokenizer, code[begin:end]))
        begin = end
    return ids


def encode(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", seed: int = 42, eos: bool = True) -> DataFrame:
    """key, input_ids, attention_mask: random cuts, then the end token; no windows."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = [tokenizer.token_id("<EOS>")] if eos else []
        for batch in batches:
            keys, texts = (batch.column(k).to_pylist() for k in (0, 1))
            for a, b in slices(texts):
                ids = [encode_cut(tokenizer, t or "", Draws(seed, "tokenize", k)) + end for k, t in zip(keys[a:b], texts[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), int_lists(ids)], names=[key, "input_ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, input_ids array<int>").withColumn("attention_mask", attention_mask(F.col("input_ids")))


def decode(tokens: DataFrame, tokenizer: Tokenizer, column: str = "input_ids") -> DataFrame:
    bounded_batches(tokens.sparkSession)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else tokenizer.decode(x.tolist()))

    return tokens.withColumn("text", text(column))


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def append_end(ids: Column, eos: int) -> Column:
    return F.array_append(ids, F.lit(eos))


def windows(tokens: Column, size: int) -> Column:
    """Array of windows of ``size``; a short last one is the last ``size`` tokens instead."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    one = F.transform(starts, lambda i: F.slice(tokens, F.greatest(F.least(i, n - size), F.lit(0)) + 1, F.lit(size)))
    return F.when(n > 0, one).otherwise(F.array().cast("array<array<int>>"))


def segment(docs: DataFrame, tokens: str, size: int) -> DataFrame:
    """One row for each window, with its number ``w``."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    rows = docs.where(n > 0).select("*", F.posexplode(starts).alias("w", "_at"))
    return rows.withColumn("window", F.slice(tokens, F.greatest(F.least(F.col("_at"), n - size), F.lit(0)) + 1, F.lit(size))).drop("_at")


def token_total(tokens: DataFrame, ids: str = "input_ids") -> DataFrame:
    return tokens.agg(F.coalesce(F.sum(F.size(ids).cast("long")), F.lit(0)).alias("n_tokens"))


def tokens_by(rows: DataFrame, group: str, count: Column) -> DataFrame:
    """Samples and tokens of each group, and of all (a null group)."""
    return rows.rollup(group).agg(F.count(F.lit(1)).alias("n_samples"), F.sum(count.cast("long")).alias("n_tokens"))


#: Letters, Han characters and printable ASCII that is neither letter nor digit.
PLAIN = r"^[\p{L}\x{4e00}-\x{9fff}\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*$"


def plain_tokens(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """Tokens made of letters, Han characters and ASCII signs alone; the empty one counts."""
    return vocabulary.where(F.col(token).rlike(PLAIN))


PRETOKEN = r"\p{L}+| ?[^\s\p{L}\p{N}]+|\p{N}+|\s+"


def pretoken_counts(docs: DataFrame, text: str = "text", pattern: str = PRETOKEN) -> DataFrame:
    """Distinct pre-tokens and their counts, the first stage of vocabulary training."""
    words = F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


#: A space between two characters that are none: a pre-token always begins there.
_BETWEEN = re.compile(r" (?<=\S )(?=\S)")


def byte_level_counts(texts: Sequence[str | None]) -> Counter[str]:
    """Normalised byte-level pre-tokens of some texts and their counts; what stands between such spaces is split once, however often it occurs."""
    import unicodedata

    from tokenizers import pre_tokenizers

    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False)
    parts: Counter[str] = Counter()
    after: Counter[str] = Counter()
    for t in texts:
        if t:
            first, *others = _BETWEEN.split(unicodedata.normalize("NFKC", t))
            parts[first] += 1
            after.update(others)
    for p, n in after.items():
        parts[f" {p}"] += n
    out: Counter[str] = Counter()
    for p, n in parts.items():
        for w, _ in byte_level.pre_tokenize_str(p):
            out[w] += n
    return out


def train_bpe(docs: DataFrame, text: str = "text", size: int = 16000, special: Sequence[str] = SPECIAL_TOKENS, least: int = 1, most: int | None = None) -> JsonTokenizer:
    """Byte-level BPE with NFKC, special tokens first.

    The corpus is reduced in Spark to distinct normalised pre-tokens with their
    counts.  All of them are merged, those that occur ``least`` times: few on
    the driver, more where they lie (``merges``), so that the driver's memory
    follows the vocabulary.  Only a caller who asks for ``most`` of them has
    ``least`` rise until no more are left.
    """
    from tokenizers import Tokenizer as Backend
    from tokenizers import decoders, models, normalizers, pre_tokenizers

    bounded_batches(docs.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].tolist()
            for a, b in slices(texts):
                found = byte_level_counts(texts[a:b])
                yield pd.DataFrame({"word": list(found), "n": list(found.values())}, columns=["word", "n"])

    counts = cut(docs.select(text).mapInPandas(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "pretokens")
    if most is not None:
        least = _least_of(counts, least, most)
    words = counts.where(F.col("n") >= least)
    n = words.count()
    if n <= merges.SAMPLE:
        vocab, pairs = merge_pairs({r["word"]: r["n"] for r in words.orderBy("word").toLocalIterator()}, size, special)
    else:
        vocab, pairs = merges.train(words, n, size, special)
    discard(counts)
    model = Backend(models.BPE(vocab=vocab, merges=pairs, unk_token="<UNK>"))
    model.normalizer = normalizers.NFKC()
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    model.decoder = decoders.ByteLevel()
    model.add_special_tokens(list(special))
    return JsonTokenizer(model.to_str())


def _least_of(counts: DataFrame, least: int, most: int) -> int:
    """The smallest count from ``least`` on that at most ``most`` pre-tokens have or exceed."""
    grades = counts.where(F.col("n") >= least).groupBy(F.floor(F.log2("n") * 16).alias("k")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n"))
    left, fits = most, None
    for r in grades.orderBy(F.desc("k")).toLocalIterator():
        left -= r["words"]
        if left < 0:
            if fits is None:
                raise ValueError(f"no count leaves at most {most} pre-tokens")
            return fits
        fits = r["n"]
    return least


def vocabulary(spark: SparkSession, tokenizer: JsonTokenizer) -> DataFrame:
    """token and id of every entry of a tokenizer; its size does not follow the corpus."""
    return spark.createDataFrame(sorted(tokenizer.vocabulary().items(), key=lambda x: x[1]), "token string, id int")


def token_counts(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens, the length of each whole text in tokens."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": [len(ids_of(tokenizer, t or "")) for t in b[text]]})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, n_tokens long")


def merge_pairs(counts: dict[str, int], size: int, special: Sequence[str] = SPECIAL_TOKENS) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges: the most frequent pair first, ties by its text."""
    import heapq
    import keyword
    from collections import defaultdict

    letters = {c for w in counts for c in w} | {k[0] for k in keyword.kwlist}
    vocab = {t: i for i, t in enumerate([*special, *sorted(letters)])}
    words = [list(w) for w in counts]
    freq = list(counts.values())
    total: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, w in enumerate(words):
        for pair in zip(w, w[1:], strict=False):
            total[pair] += freq[k]
            where[pair].add(k)
    heap = [(-n, pair) for pair, n in total.items()]
    heapq.heapify(heap)
    merges = []
    while heap and len(vocab) < size:
        n, pair = heapq.heappop(heap)
        if -n != total.get(pair, 0):
            continue
        if n == 0:
            break
        joined = pair[0] + pair[1]
        merges.append(pair)
        vocab.setdefault(joined, len(vocab))
        changed = set()
        for k in where.pop(pair):
            old, new, i = words[k], [], 0
            for p in zip(old, old[1:], strict=False):
                total[p] -= freq[k]
                changed.add(p)
            while i < len(old):
                if i + 1 < len(old) and (old[i], old[i + 1]) == pair:
                    new.append(joined)
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            words[k] = new
            for p in zip(new, new[1:], strict=False):
                total[p] += freq[k]
                where[p].add(k)
                changed.add(p)
        total.pop(pair, None)
        for p in changed - {pair}:
            if total[p] > 0:
                heapq.heappush(heap, (-total[p], p))
    return vocab, merges
