import random

import pytest

WORDS = "the of and to in shore blend tion river stone light under over seven password token data".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 40)) for _ in range(n))


def cases() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, periodic texts, other scripts."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(2, 70)
    texts = [
        base, base, near, None, "", "   ", "a", "a b", passage, f"{prose(3, 20)} {passage}", f"{passage}\n{prose(4, 30)}", "Und " * 300, "ab" * 400, prose(5, 9000),
        "é日本語 " * 40, "line one two\nline one two\nother line here\n\n", base.upper(), f"{base} tail", "x\ty z", prose(1, 118), None, "",
    ]
    return list(enumerate(texts, start=10))


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The cases, with extra columns whose names clash with those that operators use."""
    data = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t), "x", 1, "k") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """Rows that repeat, and rows without a doc_id."""
    data = [(i, t) for i, t in rows[:12]] + [(10, rows[0][1]), (10, "another text of the same id"), (None, rows[0][1]), (None, None)]
    return spark.createDataFrame([(*r, None) for r in data], "doc_id long, text string, lang string")
