import random

import pytest

WORDS = [a + b + c for a in ("ba", "ko", "lu", "ñi", "té") for b in ("ra", "so", "mi", "pe") for c in ("n", "st", "", "lo")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple[int, str | None]]:
    """Texts with copies, near copies, shared passages, junk, and every odd case."""
    r = random.Random(4)
    base = [prose(r, r.randint(30, 160)) for _ in range(30)]
    passage = prose(r, 70)
    out: list[str | None] = [*base, None, "", "   \n\t ", "one", "one two", "One TWO", base[0], base[0], base[0].upper()]
    for i in range(12):  # near copies of one text, a word or two apart
        words = base[1].split()
        for _ in range(1 + i % 3):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append(" ".join(words))
    out += [f"{prose(r, 25)} {passage} {prose(r, 25)}" for _ in range(10)]
    out += ["Hent " * 400, "x" * 3000, prose(r, 12_000), "é" * 500, "a b\x1cc　d", prose(r, 40) + "\n" + passage[:-7]]
    return [(7 * i % 1009 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The corpus over several partitions, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", 1, 0.5, True, [1], b"x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n long, score double, h boolean, at array<int>, sig binary").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id is null and text = 'none'")
