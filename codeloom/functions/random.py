"""The keyed draws of ``functions.text.uniform`` in plain Python, for UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence


def uniform(seed: int, tag: str, *key: object) -> float:
    name = ":".join([str(seed), tag, *map(str, key)])
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2.0**32


class Draws:
    """Successive draws under one key: draw n is ``uniform`` with the tag draw<n>."""

    def __init__(self, seed: int, *key: object) -> None:
        self.seed, self.key, self.used = seed, key, 0
        self._head, self._tail = f"{seed}:draw", "".join(f":{k}" for k in key)

    def uniform(self) -> float:
        self.used += 1
        return int.from_bytes(hashlib.md5(f"{self._head}{self.used}{self._tail}".encode()).digest()[:4]) / 2.0**32

    def below(self, n: int) -> int:
        return min(n - 1, int(self.uniform() * n))

    def weighted(self, weights: Sequence[float]) -> int:
        left = self.uniform() * sum(weights)
        for k, w in enumerate(weights):
            left -= w
            if left < 0:
                return k
        return len(weights) - 1
