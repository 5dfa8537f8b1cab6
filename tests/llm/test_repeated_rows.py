"""Repeated rows, rows of one id with other texts, and rows without an id."""

from pyspark.sql import functions as F
from timeweft.llm.exact_dedup import exact_dedup
from timeweft.llm.line_dedup import drop_common_lines
from timeweft.llm.sharding import rewrite, shard_documents, write_shards
from timeweft.llm.simhash import simhash_groups
from timeweft.llm.token_count import count_tokens

from .conftest import SCHEMA, sorted_rows
from .test_dedup import brute_lines, shown


def both(want, again):
    return sorted([r for r in want if again(r[0])] + want, key=repr)


def test_lines_of_repeated_rows(spark, rows, repeated):
    assert sorted_rows(shown(drop_common_lines(repeated))) == both(brute_lines(rows), lambda i: i % 7 == 0)
    line = "a line that four documents share, one of them in two rows"
    four = [(i, f"{i}\n{line}", "en", "s", 60) for i in range(4)]
    docs = spark.createDataFrame([*four, four[2]], SCHEMA)
    want = brute_lines(four)
    assert all(r[2] == 0 for r in want)
    assert sorted_rows(shown(drop_common_lines(docs))) == both(want, lambda i: i == 2)


LINE = "a line that many documents share and which is long enough"
#: Two rows without an id, two texts of one id, a row that comes again, and four others.
MIXED = [(None, f"first own\n{LINE}", "en", "s", 1), (None, f"{LINE}\nsecond own", "en", "s", 1), (2, f"a\n{LINE}", "en", "s", 1), (2, f"{LINE}\nb\nb", "en", "s", 1)]
MIXED += [(5, f"five\n{LINE}", "en", "s", 1)] * 2 + [(i, f"{i}\n{LINE}", "en", "s", 1) for i in (6, 7, 8)]


def test_lines_of_rows_without_an_id_or_with_the_same(spark):
    got = sorted((r.doc_id or 0, r.kept_text) for r in drop_common_lines(spark.createDataFrame(MIXED, SCHEMA)).collect())
    assert got == sorted([(0, "first own"), (0, "second own"), (2, "a"), (2, "b\nb"), (5, "five"), (5, "five"), (6, "6"), (7, "7"), (8, f"8\n{LINE}")])
    few = spark.createDataFrame([(None, f"{i}\n{LINE}", "en", "s", 1) for i in range(6)], SCHEMA)
    assert all(LINE in r.kept_text for r in drop_common_lines(few).collect())


def test_other_operators_on_such_rows(spark):
    df = spark.createDataFrame(MIXED, SCHEMA)
    texts = sorted(r.text for r in df.collect())
    assert len(sorted_rows(exact_dedup(df))) == 9 and sum(r.kept for r in exact_dedup(df).collect()) == 9
    assert sorted(r.n_bytes for r in count_tokens(df).collect()) == sorted(len(t) for t in texts)
    groups = {(r.doc_id, r.fp): r.component_id for r in simhash_groups(df).collect()}
    assert len(groups) == 8 and all(c is None or c == min(x for (x, f), d in groups.items() if x is not None and d == c) for c in groups.values())


def test_shards_of_such_rows_are_written_once(spark, tmp_path):
    df = spark.createDataFrame(MIXED, SCHEMA)
    placed = shard_documents(df, shards=3, old_shards=2, whole=0.01).cache()
    assert placed.count() == 9
    slots = placed.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r.s == list(range(len(r.s))) for r in slots)
    write_shards(df, placed, f"{tmp_path}/old", "old_shard")
    want = sorted_rows(df)
    assert sorted_rows(spark.read.parquet(f"{tmp_path}/old").select(*df.columns)) == want
    left = rewrite(spark, f"{tmp_path}/old", f"{tmp_path}/new", placed, 3)
    assert left or sorted_rows(spark.read.parquet(f"{tmp_path}/new").select(*df.columns)) == want
