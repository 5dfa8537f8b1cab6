import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASH = ("_part", "size", "fp", "a", "b", "h", "n", "lines", "_id", "keep_id", "rank", "shard", "copies", "ids", "root", "unit", "d", "at", "key", "declared")


def words(r, n, few=60):
    return " ".join("w" + str(r.randrange(few)) for _ in range(n))


def make_docs(seed=1):
    """Nulls, empty and white texts, copies, near copies, shared lines, one long text and a hot source."""
    r = random.Random(seed)
    shared = ["A line that many documents share, long enough to count as one " + str(i) for i in range(3)]
    rows = [None, "", "   ", "\n\n", "a", "A  b\tc", "a b c", "short line\nshort line"]
    base = [words(r, r.randrange(1, 120)) for _ in range(25)]
    rows += base
    rows += [t.replace(" ", "  ") for t in base[:6]] + [base[0]] * 4
    rows += ["\n".join([words(r, 12, 9999), shared[i % 3].upper() if i % 2 else "  " + shared[i % 3] + " ", words(r, 25, 9999), shared[i % 3]]) for i in range(18)]
    long_line = words(r, 40, 9999)
    rows += [words(r, 5) + "\n" + long_line + "\n" + words(r, 3), long_line.upper() + "\n" + long_line]
    near = words(r, 400, 9999)
    rows += [near, near.replace("w1", "v1", 1), near + " tail"]
    rows.append("\n".join(words(r, 30, 9999) for _ in range(400)))
    rows += ["日本語 テキスト", "ÀÉÎ Straße ŒUVRE", "x" * 3000]
    out = [(i, t, ["en", "de", "fr", None][i % 4] if t else None, None if i % 11 == 3 else "hot" if i % 3 == 0 else f"s{i % 5}", len(t or "")) for i, t in enumerate(rows)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(docs):
    return docs.union(docs.filter("doc_id % 7 = 0"))


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
