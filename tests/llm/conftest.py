import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota", "rho", "tau"]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    """Copies, near copies, a shared passage, nulls, empty and odd texts."""
    r = random.Random(11)
    base = [sentence(r, r.randrange(30, 200)) for _ in range(12)]
    passage = sentence(r, 90)
    rows: list[tuple[int, str | None]] = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[3]), (21, base[3]), (22, None), (23, ""), (24, "  \n\t "), (25, "one"), (26, "one two")]
    words = base[5].split(" ")
    for k in range(30, 36):
        near = list(words)
        for _ in range(1 + k % 3):
            near[r.randrange(len(near))] = "edit" + str(r.randrange(99))
        rows.append((k, " ".join(near)))
    rows += [(40 + k, sentence(r, 20) + "\n" + passage + " " + sentence(r, 15 + k)) for k in range(5)]
    rows += [(50, " ".join(["same"] * 70)), (51, "é" * 600 + " ñandú 漢字 " * 30), (52, sentence(r, 4000)), (53, "one TWO")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with more columns, some of names that operators use inside."""
    rows = [(i, t, "x", i % 3, [i]) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, gram string, length int, marks array<long>").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
