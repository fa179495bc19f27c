import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in a is that it was for on are with they be at one have this".split()


def text(seed: int, n: int) -> str:
    """Pseudo-random words of a small vocabulary."""
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[seed // 65536 % len(WORDS)] + str(seed // 4096 % 7))
    return " ".join(out)


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, odd white space, nulls, repeated ids and rows, a long text."""
    a, b, c = text(1, 120), text(2, 300), text(3, 90)
    rows = [
        (5, a, "en", "s1"), (6, a, "en", "s1"), (7, a.replace("the", "THE"), "en", "s2"), (8, b + " x " + a, "en", "s2"),
        (9, text(4, 30) + "\n" + b + "\t" + text(5, 30), "de", "s3"), (10, c, None, None), (10, c, None, None), (11, None, "en", "s1"),
        (12, "", "en", "s1"), (13, " \t\n\x0b\x0c\r ", "fr", "s2"), (None, c + " end", "fr", None), (None, None, None, None), (14, "one", "en", "s4"),
        (15, "a b", "en", "s4"), (16, "w " * 400, "en", "s4"), (17, "é ü 日本語 🎉 " * 60, "es", "s5"), (3, b, "en", "s5"), (4, text(6, 5000), "en", "s6"),
        (18, "\n".join([text(7, 9)] * 5 + [text(8, 60)]), "en", "s6"), (10, text(9, 80), "en", "s1"),
    ]
    rows += [(100 + i, a, "en", "hot") for i in range(40)] + [(200 + i, " ".join([*a.split()[:i], f"q{i}", *a.split()[i + 1:]]), "en", "hot") for i in range(40)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with further columns, some of names the operators use."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    return df.withColumns({"n_words": F.lit("mine"), "size": F.lit(1), "ids": F.lit(2), "shard": F.lit("x"), "n": F.lit(None).cast("int"), "kept": F.lit(3), "first": F.lit(1), "key": F.lit(1)}).repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
