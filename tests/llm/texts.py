"""Small documents with every odd case: nulls, empty and long texts, repeats, ties, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, key string, rep long, kept boolean, shard int, body string, row string"
WORDS = "the of and river stone market seven light paper green house under winter letter signal north field open".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "a", "er", "ing"]) for _ in range(words))


def documents(seed: int = 1, count: int = 30) -> list[tuple]:
    rng = random.Random(seed)
    shared = prose(rng, 80)
    texts: list[tuple[int | None, str | None]] = []
    for i in range(count):
        t = prose(rng, rng.randrange(1, 160))
        if i % 5 == 0:
            t += " " + shared + " " + prose(rng, 20)
        texts.append((i, t))
    for i in range(6):  # near copies
        words = texts[3][1].split() + shared.split()
        words[len(words) // 2] = f"changed{i % 3}"
        texts.append((100 + i, " ".join(words)))
    texts += [
        (200, texts[4][1]), (201, texts[4][1]), (201, texts[4][1]), (202, None), (203, ""), (204, "   "), (205, "two words"),
        (206, "Two  words"), (207, "x" * 5000), (208, "long " * 3000), (None, "nameless text"), (None, None), (209, "漢字とかな 😀 café́\x00"),
    ]
    return [(i, t, "en", "k", 7, True, 3, "other body", "other row") for i, t in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
