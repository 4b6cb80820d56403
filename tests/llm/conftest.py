import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, size string, component_id string"


def words(seed: int, n: int) -> str:
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, near and exact copies, clashing extra columns."""
    base, long = words(1, 120), words(2, 30_000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, words(3, 50) + " " + base[:400]),
        (8, "one"), (9, "one"), (10, "éà ü\u00a0ß 漢字"), (11, "12 34 !!"), (12, words(4, 35)), (12, words(4, 35)), (12, words(5, 90)), (None, words(6, 60)), (None, None),
        (13, "Same line of some words here\nother unique line " + words(7, 8)), (14, "same LINE of some   words here\n\nother text " + words(8, 8)), (15, "same line of some words herf"),
    ]
    data = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), "x", "y", "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
