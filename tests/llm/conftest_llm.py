"""Text makers for tests."""

from __future__ import annotations

import random


def words(rng: random.Random, n: int, of: int = 400) -> str:
    return " ".join(f"w{_letters(rng.randrange(of))}" for _ in range(n))


def _letters(n: int) -> str:
    out = ""
    while True:
        out, n = out + "abcdefghij"[n % 10], n // 10
        if not n:
            return out
