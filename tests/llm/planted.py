"""Made-up words for planted texts."""

from __future__ import annotations

SYLLABLES = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
