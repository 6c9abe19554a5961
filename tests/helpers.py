"""Values that several tests use."""

from __future__ import annotations

from datetime import datetime

NOW = datetime(2026, 6, 23, 12)


def unit(i: int) -> list[float]:
    return [1.0 if j == i else 0.0 for j in range(8)]
