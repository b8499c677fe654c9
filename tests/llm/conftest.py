import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def edited(text: str, seed: int, part: float) -> str:
    r = random.Random(seed)
    return " ".join("x" + str(r.randrange(10**6)) if r.random() < part else w for w in text.split(" "))


def rows() -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, nulls, empty and very long texts, repeated rows."""
    base = prose(1, 120)
    out = [(i, prose(100 + i, 20 + 7 * i), "en", f"s{i % 3}") for i in range(20)]
    out += [(100 + i, base, "en", "hot") for i in range(40)]
    out += [(200 + i, edited(base, i, 0.02), "en", "hot") for i in range(40)]
    out += [(300, None, "en", "s0"), (301, "", "de", None), (302, " \n\t ", None, "s1"), (303, "one two", "en", "s1"), (304, "ONE  two", "en", "s2"), (305, "\n\n", "en", "s2")]
    out += [(306, prose(7, 30_000), "en", "s0"), (307, "é" * 5000, "fr", "s0"), (308, "z\0z " * 40, "en", "s1"), (309, "z\0z " * 39 + "y", "en", "s1")]
    out += [(None, base, "en", None), (400, prose(9, 60), None, "s1"), (400, prose(9, 60), None, "s1"), (401, prose(9, 60) + " tail words", "en", "s2")]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    from llm.session import ready

    ready(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "n", "sid", "own", "row", "source_size", "target", "mix_h", "size", "h", "b", "s", "key", "score_", "hits", "place", "lang_", "position", "start", "value", "slot_"]
    return docs.withColumns({c: F.lit(7) for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
