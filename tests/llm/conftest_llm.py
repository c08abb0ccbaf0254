from __future__ import annotations

import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, row long, g long, size int, sig string, hash long, component string, __gone int"


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def words(n, rng, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make(rows):
    """Rows of documents from (doc_id, text, lang, source), with columns whose names clash."""
    return [(i, t, lang, s, None if t is None else len(t), False, 1, 2, 3, 4, "x", 5, "c", 6) for i, t, lang, s in rows]


MESSY = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", None), (5, "Two words", "de", "b"), (6, "two WORDS", "de", "b"),
    (7, "\x00 nul é漢😀 ﬀ", "fr", "b"), (8, "same text here twice over and over again ok", "en", "c"), (8, "same text here twice over and over again ok", "en", "c"),
    (9, "###!!! ||| 123", "en", "c"), (None, "a row without an id but with several words in it", "en", "c"), (10, "x" * 200_000, "en", "d"),
    (11, "long " * 60_000, "en", "d"), (12, "\n".join(["line"] * 500), None, None),
]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(make(MESSY), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def family(spark):
    """Copies and near copies of a few texts among other texts; the originals come last."""
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(15):
            t = base[:]
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(150)] = f"w{rng.randrange(3000)}"
            rows.append((n, " ".join(t), "en", "s"))
            n += 1
        rows += [(n, " ".join(base), "en", "s"), (n + 1, " ".join(base).upper(), "en", "s")]
        n += 2
    rows += [(n + k, words(rng.randint(1, 60), rng, 3000), "en", "s") for k in range(30)]
    return rows
