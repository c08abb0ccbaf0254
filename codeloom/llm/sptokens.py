"""SentencePiece encoding and decoding with a shared-prefix forward pass.

Texts are marked (a space becomes U+2581, with one more in front) and cut before
every run of marks; no piece crosses such a cut.  The distinct marked words of a
slice of texts are sorted, which lays them out as a trie in depth-first order,
and the forward states of the prefix a word shares with the one before it are
used again.

Every prefix has a forward score, the best over the pieces that can end it of
the score of what is before that piece plus that piece's own.  For a ``unigram``
model the own score is the model's, and the result is Viterbi's path with the
largest sum.  For a ``bpe`` model that sum is not what the model means: merging
is.  There a piece scores 0 where merging leaves it whole and side by side with
the piece before it, and minus infinity elsewhere.  Exactly one path of every
prefix scores 0, the outcome of merging, so only its last piece is kept, and
the pieces that can end a prefix come longest first from an automaton of the
vocabulary.  Hence results equal those of the sentencepiece library for both
kinds.

Characters without a piece become byte pieces, or the unknown piece where the
model has none.

Cases: a null text gives null ids, an empty text no ids; decoding gives back
every valid text, byte for byte, for models without normalisation; texts of any
length are taken whole; repeated rows are encoded each for itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel as K
from .common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Neighbour pairs, and steps of the automaton, that a worker remembers.
REMEMBER = 400_000
#: Distinct words of each of two generations that a worker remembers.
WORDS = 250_000
#: Longer words are not remembered.
LONG = 64


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


class Pieces:
    """Vocabulary of a model file, read from its bytes."""

    def __init__(self, model: bytes, kind: str = "bpe") -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kind = kind
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [-1] * 256
        self.raw: list[bytes] = []
        self.unknown = sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces cross words; this model cannot be encoded word by word")
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.cut = re.compile(f"{alone}|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.after: dict[str, dict[str, bool]] = {}
        self.known = 0
        self.numbers: dict[str, bytes] = {}
        self.begins = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.root: tuple[str, dict, list] = ("", {}, [])
        self.nodes: dict[str, tuple[str, dict, list]] = {}
        self.steps = 0

    def merged(self, text: str) -> list[str]:
        """Pieces that merging leaves of ``text``: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side."""
        if self.known > REMEMBER:
            self.known = 0
            for d in self.after.values():
                d.clear()
        self.known += 1
        fits = self.after[left][right] = self.merged(left + right) == [left, right]
        return fits

    def _step(self, node: tuple[str, dict, list], char: str) -> tuple[str, dict, list]:
        """The automaton's node after one more character.

        A node is the longest end of the text that begins a piece (a single
        character always does), its steps, and the whole pieces that end there
        with their length, ids and what may follow them, the longest first.
        """
        if self.steps > REMEMBER:
            self.steps = 0
            self.nodes.clear()
            self.root[1].clear()
        self.steps += 1
        text = node[0] + char
        while len(text) > 1 and text not in self.begins:
            text = text[1:]
        found = self.nodes.get(text)
        if found is None:
            ends = [text[k:] for k in range(len(text))]
            ends = [p for p in ends if len(p) == 1 or (p in self.ids and self.merged(p) == [p])]
            found = self.nodes[text] = (text, {}, [(len(p), p, self._number(p), self.after.setdefault(p, {})) for p in ends])
        node[1][char] = found
        return found

    def _number(self, piece: str) -> bytes:
        """Ids of a piece, or of a character that has none, as int32 bytes."""
        out = self.numbers.get(piece)
        if out is None:
            data = [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            out = self.numbers[piece] = np.array(data if min(data) >= 0 else [self.unknown], dtype=np.int32).tobytes()
        return out

    @staticmethod
    def _path(numbers: list[bytes], back: list[int]) -> bytes:
        """Ids from the first character to the last, by the pieces that end the best paths."""
        i = len(numbers) - 1
        out = []
        while i:
            out.append(numbers[i])
            i = back[i]
        out.reverse()
        return b"".join(out)

    def segment(self, words: Sequence[str]) -> Iterator[tuple[str, bytes]]:
        """Ids along the best path of each of ``words``, which must be sorted."""
        return self._merging(words) if self.kind == "bpe" else self._summing(words)

    def _merging(self, words: Sequence[str]) -> Iterator[tuple[str, bytes]]:
        state: list[dict[str, bool] | None] = [None]  # by prefix: what may follow its last piece
        nodes, last, numbers, back = [self.root], [""], [b""], [0]
        before = ""
        for w in words:
            same = _shared(w, before)
            del state[same + 1 :], nodes[same + 1 :], last[same + 1 :], numbers[same + 1 :], back[same + 1 :]
            node, i = nodes[same], same
            for char in w[same:]:
                i += 1
                node = node[1].get(char) or self._step(node, char)
                for size, piece, number, follow in node[2]:
                    j = i - size
                    if j:
                        ok = state[j].get(piece)
                        if not (self._fits(last[j], piece) if ok is None else ok):
                            continue
                    nodes.append(node)
                    state.append(follow)
                    last.append(piece)
                    numbers.append(number)
                    back.append(j)
                    break
                else:
                    raise AssertionError("merging has an outcome for every prefix")
            before = w
            yield w, self._path(numbers, back)

    def _summing(self, words: Sequence[str]) -> Iterator[tuple[str, bytes]]:
        floor = min(self.scores.values(), default=0.0) - 10
        total: list[float] = [0.0]
        numbers: list[bytes] = [b""]
        back: list[int] = [0]
        before = ""
        for w in words:
            same = _shared(w, before)
            del total[same + 1 :], numbers[same + 1 :], back[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                best, at, found = None, i - 1, w[i - 1 : i]
                for j in range(max(0, i - self.longest), i):
                    s = self.scores.get(w[j:i], floor if i - j == 1 else None)
                    if s is not None and (best is None or total[j] + s > best):
                        best, at, found = total[j] + s, j, w[j:i]
                total.append(best)
                numbers.append(self._number(found))
                back.append(at)
            before = w
            yield w, self._path(numbers, back)

    def encode(self, texts: Sequence[str | None]) -> list[bytes | None]:
        """Ids of each text as int32 bytes."""
        cut = [None if t is None else self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        new = {w for c in cut if c for w in c}.difference(self.words)
        again = new.intersection(self.older)
        self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new -= again
        self.words.update(self.segment(sorted(new)))
        get = self.words.__getitem__
        out = [None if c is None else b"".join(map(get, c)) for c in cut]
        for w in new:
            if len(w) > LONG:
                del self.words[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; invalid bytes become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _pieces(model: bytes, kind: str) -> Pieces:
    return K.keep(("pieces", hash(model), kind), lambda: Pieces(model, kind))


def encode(docs: DataFrame, model: bytes, kind: str = "bpe", key: str = "doc_id") -> DataFrame:
    """key, ids, n_tokens and round_trip (decoding gives the text back) of every row."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value, kind)
        for batch in batches:
            column = batch.column("text")
            _, offsets = K.strings(column)
            for a, b in K.slices(offsets):
                texts = column.slice(a, b - a).to_pylist()
                found = pieces.encode(texts)
                ids = [None if f is None else np.frombuffer(f, dtype=np.int32) for f in found]
                sizes = [0 if x is None else len(x) for x in ids]
                same = [x is None or pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.frombuffer(b"".join(f for f in found if f), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(a, b - a), lists, pa.array(sizes, pa.int64()), pa.array(same)],
                    names=[key, "ids", "n_tokens", "round_trip"],
                )

    kinds = dict(docs.dtypes)
    return docs.select(key, "text").mapInArrow(run, f"{key} {kinds[key]}, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, model: bytes, kind: str = "bpe", key: str = "doc_id") -> DataFrame:
    """key and text of rows with ids; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value, kind)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                texts = [None if x is None else pieces.decode(np.array(x, dtype=np.int32)) for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    kinds = dict(tokens.dtypes)
    return tokens.select(key, "ids").mapInArrow(run, f"{key} {kinds[key]}, text string")


def op8_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), read_model())
