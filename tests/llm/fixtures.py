"""Small inputs that the tests of this folder share."""

import random

DOCS = "doc_id long, text string"


def corpus(seed: int = 3, n: int = 120) -> list[tuple[int, str | None]]:
    """Texts with exact copies, near copies, blanks, nulls and one long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    texts: list[str | None] = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5 and (old := rng.choice(texts)):
            split = old.split(" ")
            for _ in range(rng.randint(1, max(1, len(split) // 25))):
                split[rng.randrange(len(split))] = rng.choice(words)
            texts.append(" ".join(split))
        elif kind < 0.55:
            texts.append(rng.choice([None, "", " \n\t ", "x", "Ab cD", "ab cd"]))
        else:
            texts.append(rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([1, 2, 3, 9, 10, 12, 40, 80, 200]))))
    texts.append(" ".join(rng.choices(words, k=9_000)))
    texts.append(texts[-1] + " tail")
    texts.append(texts[-2].replace(" ", "\n"))
    return list(enumerate(texts))


def clashing(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    out = [(i, t, "x", 1, [1], "y", 2.0, True, 5) for i, t in rows]
    return spark.createDataFrame(out, "doc_id long, text string, id string, n int, keys array<int>, recipe string, fill double, kept boolean, item long")
