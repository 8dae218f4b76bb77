import random

import duckdb
import pytest

WORDS = "the of and to in is ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg ji lk".split()


def tiny_texts():
    """Texts with copies, near copies, shared passages, and odd cases, from a fixed seed."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))
    passage, base = say(70), say(120)
    texts = [say(r.randrange(1, 150)) for _ in range(25)]
    texts += [base, base, base.upper(), base.replace("ab", "zz", 2), base.replace("cd", "yy", 5), base + " tail"]
    texts += [say(20) + " " + passage + " " + say(9), passage, say(3) + "\n" + passage + "\t" + say(40), say(30) + passage[:200]]
    texts += ["", None, "   \n ", "x", "a" * 300, "a" * 120, "one two", "ONE  two", "ñandú über 日本語 " * 20, "ñandú über 日本語 " * 9, "12 34 !?", None]
    return texts


@pytest.fixture(scope="session")
def rows():
    return [(i * 3 + 1, t) for i, t in enumerate(tiny_texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with clashing extra columns."""
    data = [(d, t, "en", "s", len(t or ""), 1, b"z") for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, chunk int, bands binary").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def real(sf):
    """All documents of the smallest supplied table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
