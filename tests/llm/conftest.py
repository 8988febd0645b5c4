from __future__ import annotations

import random

import pytest

WORDS = [
    "".join(random.Random(n).choice("bdfklmnprstv") + random.Random(n + 1).choice("aeiou") for _ in range(1 + n % 3))
    + random.Random(n + 2).choice(["", "n", "sk", "rt"])
    + str(n % 7 or "")
    for n in range(400)
]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame(
            [(i, text, "xx", "s", 1, "row", 0, [1], "d") for i, text in rows],
            "doc_id long, text string, lang string, source string, n_chars long, row_key string, "
            "n int, spans array<int>, digest string",
        )

    return make
