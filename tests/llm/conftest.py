import pytest

from tests.conftest import SF0001

LONG = ("Long text with many words and numbers 0123456789. " * 4000) + "end"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that bear names the operators use themselves.
CLASHES = ["id", "text_hash", "fp", "spans", "_spans", "_id", "_hash", "_row", "score", "held_out", "n", "shard", "ids", "data"]


def edge_rows():
    """Null, empty, blank, repeated, copied, unnamed and very long documents."""
    texts = [None, "", "   ", "...!?", "Same text here, twice.", "Same text here, twice.", LONG, "日本語 ▁ text", "one", "one two"]
    rows = [(1000 + i, t, None if i % 2 else "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "Same text here, twice.", None, None, 22), (None, None, None, None, None),
            (1004, "Another text with the same id.", "en", "s", 30)]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns of clashing names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), COLUMNS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def union_find(n, pairs):
    """Smallest member of the component of each of n items."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]
