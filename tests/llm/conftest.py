from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int) -> list[str]:
    """Words of syllables."""
    return ["".join(rng.choice(("th", "er", "on", "an", "ré", "he", "in", "Ed", "ou", "st")) for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages and lines, nulls, empty and very long texts, ties and odd characters."""
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " \n\t ", "one", "One", "a b c d", "x" * 900, "ab" * 400, "\n\n", "é", "a\x1cb\x85c d e f", "so<|endoftext|>be <|startoftext|> it <|endoftext|>"]
    for k in range(30):
        words = prose(rng, rng.randint(5, 200))
        texts.append("\n".join(" ".join(words[i : i + 30]) for i in range(0, len(words), 30)))
        if k % 3 == 0:
            texts.append(texts[-1])
        if k % 4 == 0:
            for _ in range(3):
                near = list(words)
                for _ in range(max(1, len(words) // 80)):
                    near[rng.randrange(len(near))] = rng.choice(words)
                texts.append(" ".join(near))
    passage = " ".join(prose(rng, 70))
    for _ in range(20):
        texts.append(" ".join(prose(rng, rng.randint(0, 60))) + " " + passage + " " + " ".join(prose(rng, rng.randint(0, 60))))
    base = prose(rng, 120)
    for _ in range(25):  # more than a small bucket's members
        near = list(base)
        for _ in range(3):
            near[rng.randrange(120)] = prose(rng, 1)[0]
        texts.append(" ".join(near))
    texts.append(" ".join(prose(rng, 20_000)))
    line = " ".join(prose(rng, 12))
    for _ in range(12):
        texts.append("\n".join([" ".join(prose(rng, 9)), f"  {line.upper() if rng.random() < 0.3 else line} ", " ".join(prose(rng, 9))]))
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", f"src{i % 3}", None) for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
