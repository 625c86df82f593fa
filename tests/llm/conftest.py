import random

import pytest


def make_words(seed=0):
    r = random.Random(seed)
    parts = ["an", "ber", "ci", "do", "éa", "fi", "gu", "ha", "in", "ja", "ke", "lo"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) with copies, near copies, empty, null and odd texts."""
    r, vocabulary = random.Random(1), make_words()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, "\n".join(text(r.randint(5, 40)) for _ in range(r.randint(1, 6))), f"s{i % 4}") for i in range(60)]
    for i in range(60, 75):  # near copies of document 3, each with some words changed
        words = rows[3][1].split(" ")
        for _ in range(i % 5):
            words[r.randrange(len(words))] = "changed" + str(i)
        rows.append((i, " ".join(words), "s0"))
    rows += [(75, rows[7][1], "s1"), (76, rows[7][1], "s2"), (77, "", "s1"), (78, None, "s2"), (79, "one two", None), (80, "ONE  two", "s1"), (81, " \n\t", None), (82, "x" * 5000 + " y", "s3")]
    rows += [(83, text(3000), "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    rows = [(i, t, s, None if t is None else len(t), "en", True, 1.5) for i, t, s in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string, kept boolean, score double")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
