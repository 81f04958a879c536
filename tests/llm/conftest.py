import numpy as np
import pytest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, h string"

# Nulls in every column, empty and long texts, ties, repeated rows; n_tokens and h clash with operators' own names.
_REP = "One two three four five six. Seven eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen twenty one more. "
ODD = [
    (1, "Hello there, mail a.b@c.org or 10.0.0.1 now. " + _REP, "en", "s0", 10, 1, "x"),
    (1, "Hello there, mail a.b@c.org or 10.0.0.1 now. " + _REP, "en", "s0", 10, 1, "x"),
    (2, "Hello there, mail a.b@c.org or 10.0.0.1 now. " + _REP, "en", "s0", 10, 1, "x"),
    (3, "Une autre chose. " + _REP + " fin", "fr", None, None, None, None),
    (4, None, "en", "s1", None, None, None),
    (5, "", None, "s1", 0, 0, ""),
    (6, "   \n\t ", "en", "s1", 5, 0, ""),
    (7, "12345 !!! 999", "en", "s1", 5, 0, ""),
    (8, "long " * 60_000, "en", "s1", 300_000, 0, ""),
    (9, "x", "en", "s1", 1, 0, ""),
    (None, "no id here at all, call +1 (726) 555-7857", "en", "s2", 1, 0, ""),
    (None, None, None, None, None, None, None),
    (10, "中文 текст İstanbul <|endoftext|> 's don't I'LL é́", "xx", "s2", 1, 0, ""),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


class Groups:
    """Union-find for brute-force answers."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[self.find(i)] = self.find(j)


@pytest.fixture
def groups():
    return Groups


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(3)
