"""Mixing and sharding against their laws."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from timeweft.llm.mixing import mix, mixed_documents, pivot
from timeweft.llm.sharding import affected, capacities, min_cost_flow, rewrite, shard_documents, write_shards

from .conftest import SCHEMA, sorted_rows


def words_in(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows, most=3):
    """Weights in turn over sources by code point, null last; what is above the cap is shared again."""
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + words_in(t)
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        open_ = [s for s in order if s not in capped]
        level = (sum(size.values()) - sum(most * size[s] for s in capped)) / max(1, sum(weight[s] for s in open_))
        more = {s for s in open_ if level * weight[s] > most * size[s]}
        if not more:
            return {s: most * size[s] if s in capped else level * weight[s] for s in order}
        capped |= more


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 9}" if i % 97 else "tiny"
        rows.append((i, " ".join(["w"] * int(r.lognormvariate(3, 1))), "en", s, 0))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7)


def test_mix(many):
    rows, df = many
    want = targets(rows)
    got = mix(df).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    size = {r[0]: words_in(r[1]) for r in rows}
    taken = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.02 * want[s] + 10, (s, t, want[s])
    again = mix(df.repartition(3)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    other = mix(df, seed=8).collect()
    assert sorted((r.doc_id, r.copies) for r in other) != sorted((r.doc_id, r.copies) for r in got)


def test_mix_cases(rows, docs, clashing, empty, repeated):
    a = sorted_rows(mix(docs))
    assert a == sorted_rows(mix(clashing)) and len(a) == len(rows)
    assert mix(empty).count() == 0
    assert mix(repeated).count() == repeated.count()
    total = mixed_documents(docs)
    assert total.columns == docs.columns
    assert total.count() == mix(docs).agg(F.sum("copies")).first()[0]
    assert mixed_documents(clashing).columns == clashing.columns


def test_pivot_keeps_words():
    for seed in range(50):
        r = np.random.default_rng(seed)
        p, m = r.random(80), r.integers(1, 500, 80).astype(float)
        x = pivot(p, m, np.random.default_rng(seed), 16)
        assert abs((x * m).sum() - (p * m).sum()) < 1e-6 and 1 <= ((x > 0) & (x < 1)).sum() <= 16
        y = pivot(p, m, np.random.default_rng(seed))
        assert set(y) <= {0.0, 1.0} and abs((y * m).sum() - (p * m).sum()) <= 60
    mean = np.mean([pivot(np.full(30, 0.3), np.arange(1, 31.0), np.random.default_rng(s), 16) for s in range(3000)], axis=0)
    assert abs(mean - 0.3).max() < 0.05


@pytest.mark.parametrize("mass", [np.arange(1, 11.0), np.array([900.0] + [20.0] * 49), np.arange(1, 31.0), np.exp(np.random.default_rng(3).normal(5, 1, 120))], ids=["ten", "huge", "thirty", "many"])
def test_the_last_group_keeps_every_expectation(mass):
    n = 3000
    got = np.array([pivot(np.full(len(mass), 0.3), mass, np.random.default_rng(s)) for s in range(n)])
    assert set(got.ravel()) <= {0.0, 1.0}
    assert abs(got.mean(0) - 0.3).max() < 5 * (0.3 * 0.7 / n) ** 0.5


@pytest.mark.parametrize("n", [10, 50, 500])
def test_mean_copies_over_seeds(spark, n):
    """Documents of two sources, the large one taken at less than one copy; means over seeds meet target / source_size."""
    r = random.Random(n)
    rows = [(i, " ".join(["w"] * r.randrange(1, 200)), "en", "ab"[i % 5 == 0], 0) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    total, seeds = dict.fromkeys(range(n), 0), 12
    for seed in range(seeds):
        got = mix(df, seed=seed).collect()
        for x in got:
            total[x.doc_id] += x.copies
        for s in "ab":
            own = [x for x in got if x.source == s]
            assert abs(sum(x.taken for x in own) - own[0].target) <= 200
    rate = {x.doc_id: x.target / x.source_size for x in got}
    z = [(total[i] - seeds * rate[i]) / max(1e-9, (seeds * (rate[i] % 1) * (1 - rate[i] % 1)) ** 0.5) for i in range(n) if 1e-6 < rate[i] % 1 < 1 - 1e-6]
    assert max(map(abs, z), default=0) < 5


def test_rows_of_one_id_take_their_own_copies(spark):
    rows = [(i // 2, " ".join([f"w{i}"] * (5 + i)), "en", "s", 0) for i in range(40)] + [(None, f"t {i}", "en", "s", 0) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x.doc_id, x.size): x.copies for x in mix(df).collect() if x.doc_id is not None}
    held = {}
    for x in mixed_documents(df).filter("doc_id is not null").collect():
        held[(x.doc_id, words_in(x.text))] = held.get((x.doc_id, words_in(x.text)), 0) + 1
    assert held == {k: v for k, v in got.items() if v}


def brute_cost(supply, room):
    """Least bytes moved when staying is free and any move costs the same: what doesn't fit at home."""
    return sum(max(0, s - (room[i] if i < len(room) else 0)) for i, s in enumerate(supply))


def test_flow_is_minimal():
    for seed in range(60):
        r = random.Random(seed)
        supply = [r.randrange(0, 100) for _ in range(r.randrange(1, 8))]
        m = r.randrange(1, 9)
        room = capacities(sum(supply), m) if seed % 2 else [r.randrange(0, 100) + sum(supply) // m + 1 for _ in range(m)]
        flow = min_cost_flow(supply, room)
        assert [sum(f for a, _, f in flow if a == i) for i in range(len(supply))] == supply
        assert all(sum(f for _, b, f in flow if b == j) <= room[j] for j in range(m))
        assert sum(f for a, b, f in flow if a != b) == brute_cost(supply, room)
    assert min_cost_flow([3, 4], [4, 4], cost=lambda a, b: 1 - int(a != b)) == [(0, 1, 3), (1, 0, 4)]
    with pytest.raises(ValueError):
        min_cost_flow([5], [4])


def test_shards(many, rows, docs, clashing, empty, repeated):
    data, df = many
    got = shard_documents(df, shards=7, old_shards=5).collect()
    text = {r[0]: r[1] or "" for r in data}
    assert sorted(r.doc_id for r in got) == sorted(text)
    per = {}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        per.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in x) for x in per.values()]
    assert sorted(per) == list(range(7)) and max(sizes) - min(sizes) <= 0.05 * max(sizes)
    for x in per.values():
        assert [r.slot for r in sorted(x, key=lambda r: r.doc_id)] == list(range(len(x)))
    kept = sum(r.size for r in got if r.shard == r.old_shard)
    old = [sum(r.size for r in got if r.old_shard == i) for i in range(5)]
    assert kept >= 0.9 * sum(min(o, c) for o, c in zip(old, capacities(sum(old), 7), strict=False))
    assert sorted_rows(shard_documents(docs, 4, 3)) == sorted_rows(shard_documents(clashing, 4, 3))
    assert shard_documents(empty, 4, 3).count() == 0
    assert shard_documents(repeated, 4, 3).count() == repeated.count()


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 60} " + "x" * (i % 60), None, None, 0) for i in range(1200)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), 3, 2, whole=0.1).collect()
    home = {}
    for r in got:
        home.setdefault(r.doc_id % 60, set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_rewrite_touches_affected_shards_only(spark, many, tmp_path):
    _, df = many
    placed = shard_documents(df, 4, 3)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    write_shards(df, placed.drop("shard"), old, "old_shard")
    untouched = rewrite(spark, old, new, placed, 4)
    assert set(untouched) == set(range(4)) - set(affected(placed))
    back = spark.read.parquet(new)
    want = placed.filter(F.col("shard").isin(affected(placed))).select("doc_id", "shard")
    assert sorted_rows(back.select("doc_id", "shard")) == sorted_rows(want)
