import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, uid string"
WORDS = [a + b for a in ("lo", "ka", "mi", "te", "ru", "sa", "no", "vi") for b in ("ran", "del", "pos", "tik", "um", "est", "a", "ion")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Prose, copies, near copies, ties, junk, empty, null and long texts; ids repeat and one is null."""
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(20, 120)) + ".") for k in range(60)]
    base = prose(rng, 200).split()
    for k in range(60, 80):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(WORDS)
        rows.append((k, " ".join(near)))
    rows += [(80, None), (81, ""), (82, "  \n\t "), (83, "one"), (84, "one two"), (85, "One two"), (86, prose(rng, 6000)), (87, "x" * 20000)]
    rows += [rows[3], rows[3], (88, rows[4][1]), (4, "another text of the same id"), (None, "a text without id"), (89, "wörld ÄÖ ß　日本 é 🙂, it's <|endoftext|> 12.5"), (90, "a\n" * 40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    full = [(k, t, "en", "s", len(t or ""), 0.5, "k", "u") for k, t in odd_texts]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
