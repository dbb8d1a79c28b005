import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows and odd characters.
EDGES = [
    (None, "a null id with some words in its text", "en", None, 5),
    (900001, None, None, "s1", None),
    (900002, "", "en", "s1", 0),
    (900003, " \n\t\r\x0b\x0c ", "en", "s2", 6),
    (900004, "one", "en", "s2", 3),
    (900005, "same text of four words or more", "en", "s3", 1),
    (900006, "same text of four words or more", "en", "s3", 1),
    (900006, "same text of four words or more", "en", "s3", 1),
    (900007, "SAME text of FOUR words or More", "en", "s3", 1),
    (900008, "ünï 日本語 “quoted” it's <|endoftext|> 12.5% x\x1cy \x85z ́a", "xx", "s3", 1),
    (900009, "word " * 30_000, "en", "s1", 1),
    (900010, "line of words here.\n" * 40, "en", "s1", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Test documents, edge cases, and columns whose names clash with internal ones."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(150) if DATA.exists() else spark.createDataFrame([], SCHEMA)
    clash = {"size": F.lit("x"), "shard": F.lit(-1), "target": F.lit(1), "row": F.lit("r"), "fp": F.lit(0), "__rules": F.lit(0), "key": F.lit(0), "found": F.lit("f")}
    return real.unionByName(spark.createDataFrame(EDGES, SCHEMA)).withColumns(clash).repartition(3).persist()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def copies():
    """Groups of near copies with more and more edits, chains, and a passage that many
    otherwise different texts share."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    out, passage = [], prose(60)
    for _ in range(4):
        base = prose(rng.choice((40, 120, 300)))
        for edits in [0, 0, *range(1, 14)] * 2:
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
    chain = prose(100)
    for i in range(12):
        chain = [*chain[1:], rng.choice(vocabulary)]
        if i % 2:
            out.append(" ".join(chain).upper() if i % 3 else " ".join(chain))
    out += [" ".join(prose(rng.randint(5, 80)) + passage + prose(rng.randint(5, 80))) for _ in range(40)]
    out += [" ".join(prose(k)) for k in (1, 2, 3, 4, 5)] * 2
    rng.shuffle(out)
    return out
