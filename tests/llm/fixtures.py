"""Documents that hold the awkward cases: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, label long, copy int, spans string, toxicity double, b_salt int"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    texts: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "two words"),
        (9, words(9000, 2)), (10, words(50, 3)), (10, words(50, 3)), (None, words(40, 4)), (None, None), (12, "naïve café ΑΣ 日本語 é \x1c <|endoftext|>"),
        (13, words(60, 5) + " mail bob.smith@mail.example.org or +1 (980) 555-6268 now 10.0.0.255 and 4111 1111 1111 1111"), (14, words(200, 6)), (15, words(200, 6).upper()),
    ]
    return [(i, t, "en", "a" if (i or 0) % 2 else None, len(t or ""), 7, 8, 9, "x", 0.5, 3) for i, t in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
