import random

import pytest

SYLLABLES = "ka lo mi ren tas ver dun eli por sha".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near copies, short, empty, null and long texts."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(20, 200))) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(12)]
    for i in range(30):
        base = rows[10 + i % 6][1]
        rows.append((200 + i, edited(rng, base, 1 + i % 3)))
    rows += [(300, ""), (301, None), (302, "one two"), (303, "one two"), (304, " \n\t"), (305, prose(rng, 20_000)), (306, "naïve Ünïcode 漢字 " * 30), (307, "x")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows and columns whose names operators might use themselves."""
    rows = [(1, "same text of a few words here", "en", "a", 5, 1, "x", 0.5), (1, "same text of a few words here", "en", "a", 5, 1, "x", 0.5), (1, "another text under the same id number", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (None, "text without an id but with words", "de", "b", 3, 2, "y", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, score double")
