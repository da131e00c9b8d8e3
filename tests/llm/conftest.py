"""Documents that cover the awkward cases, with extra columns named like those the operators use."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, doc string, th string, id string, found string, n_words string, part string, line string"


def made_up(seed: int, n: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    passage = made_up(1, 60)
    base = made_up(2, 120)
    near = base.split()
    near[50] = "changed"
    return [
        (5, base), (3, base), (9, " ".join(near)), (7, f"{made_up(3, 30)} {passage} {made_up(4, 30)}"),
        (2, f"{made_up(5, 15)}\n{passage}\t{made_up(6, 25)}"), (11, None), (12, ""), (13, " \n\t "), (14, "one"), (15, "two words"),
        (16, "same " * 90), (17, made_up(7, 30_000)), (None, made_up(8, 40)), (18, "a b c\n\na b c\n d"),
        (19, "é ü 漢字 x\u0085y Ünï cöde " * 6), (20, passage), (20, passage), (21, passage.upper()),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "x", "y", None, "z", "0", "p", "l") for i, t in awkward_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
