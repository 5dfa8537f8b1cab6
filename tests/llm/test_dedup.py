"""Exact, line, substring and SimHash dedup against plain Python."""

import hashlib
import itertools
import re
from collections import defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F
from timeweft.llm import queries as Q
from timeweft.llm.components import components
from timeweft.llm.exact_dedup import exact_dedup
from timeweft.llm.line_dedup import drop_common_lines
from timeweft.llm.simhash import anchors, bucket_links, fingerprint, simhash_groups
from timeweft.llm.substring_dedup import drop_repeated_passages

from .conftest import SCHEMA, sorted_rows

WS = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WS.sub("", t or "")].append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return sorted(out, key=repr)


def test_exact(rows, docs, clashing, empty, repeated):
    assert sorted_rows(exact_dedup(docs)) == brute_exact(rows)
    assert sorted_rows(exact_dedup(clashing)) == brute_exact(rows)
    assert exact_dedup(empty).count() == 0
    again = exact_dedup(repeated)
    assert again.count() == repeated.count()
    both = [r for r in rows if r[0] % 7 == 0] + rows
    assert sorted_rows(again) == brute_exact(both)


def test_exact_survives_collisions(rows, docs):
    """With a hash of 4 values nearly all texts collide; bytes still decide."""
    weak = lambda digest: (F.conv(F.substring(F.hex(digest), 1, 1), 16, 10).cast("int") % 4).cast("string").cast("binary")
    assert sorted_rows(exact_dedup(docs, hashed=weak)) == brute_exact(rows)


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a", None, None, 1), (3, "a", None, None, 1), (None, "b", None, None, 1)], SCHEMA)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)}


def brute_lines(rows, min_points=40, min_docs=5):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_points:
                held[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def shown(df):
    return df.select("doc_id", F.size("lines"), F.size("dropped"), "kept_text")


def test_lines(rows, docs, clashing, empty, repeated):
    want = brute_lines(rows)
    assert sum(r[2] for r in want) > 5
    assert sorted_rows(shown(drop_common_lines(docs))) == want
    assert sorted_rows(shown(drop_common_lines(clashing))) == want
    assert drop_common_lines(empty).count() == 0
    assert shown(drop_common_lines(repeated)).count() == repeated.count()


def cut_units(text):
    """Lines and clauses, character by character: a unit ends where what is neither mark nor white space follows a mark or line end."""
    out, ended = [], False
    for c in text or "":
        if not out or (ended and c not in ".!?;, \t\n\x0b\x0c\r"):
            out.append("")
            ended = False
        out[-1] += c
        ended = ended or c in ".!?;,\n"
    return out


def brute_passages(rows, least=30):
    """Rows in the order of ids, each unit compared with all that came before."""
    seen, out = {}, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        units = cut_units(t)
        keys = [" ".join(WORD.findall(u.translate(LOWER))) for u in units]
        size = [len(k.split()) for k in keys]
        before = lambda k: seen.get(k)
        link, alone = [], []
        for n, k in enumerate(keys):
            alone.append(size[n] >= least and before(k) is not None and (before(k),))
            seen.setdefault(k, i)
            two = tuple(keys[n : n + 2])
            link.append(len(two) == 2 and before(two) is not None and (before(two),))
            if len(two) == 2:
                seen.setdefault(two, i)
        n, at, removed, stay = 0, 0, [], ""
        while n < len(units):
            last = n
            while link[last]:
                last += 1
            words_ = sum(size[n : last + 1])
            part = "".join(units[n : last + 1])
            if words_ >= least and (last > n or alone[n]):
                removed.append((at, at + len(part), words_, (link[n] or alone[n])[0]))
            else:
                stay += part
            at, n = at + len(part), last + 1
        out.append((i, removed, stay))
    return out


def plain_passages(df):
    return sorted(((r.doc_id, [tuple(x) for x in r.removed], r.kept_text) for r in df.collect()), key=repr)


def test_repeated_passages(rows, docs, clashing, empty, repeated):
    want = sorted(brute_passages(rows), key=repr)
    assert sum(len(r[1]) for r in want) >= 2
    assert plain_passages(drop_repeated_passages(docs)) == want and plain_passages(drop_repeated_passages(clashing)) == want
    assert drop_repeated_passages(empty).count() == 0
    assert plain_passages(drop_repeated_passages(repeated)) == sorted(want + [r for r in want if r[0] % 7 == 0], key=repr)


def test_passages_inside_lines_and_over_short_ones(spark):
    import random

    r = random.Random(4)
    say = lambda n: " ".join(f"x{r.randrange(10**6)}" for _ in range(n))
    clauses = [say(9) + ("," if k % 2 else ".") for k in range(7)]
    verse = "\n".join(say(4) for _ in range(14))
    texts = [f"{say(9)}. {' '.join(clauses)} {say(8)}.", f"{say(5)}. {' '.join(clauses).upper()}  {say(30)}", f"{say(3)}\n{verse}\n{say(3)}", f"{say(40)}\n{verse}\n", say(200)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = plain_passages(drop_repeated_passages(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(brute_passages(rows), key=repr)
    assert [sum(x[2] for x in r[1]) for r in got] == [0, 63, 0, 56, 0] and [x[3] for r in got for x in r[1]] == [0, 2]


def test_passages_of_rows_without_an_id_or_with_the_same(spark):
    passage = ". ".join(f"passage {k} of some words that come again" for k in range(6)) + "."
    rows = [(None, f"one\n{passage}"), (None, f"two two\n{passage}"), (2, f"three\n{passage}"), (2, f"four\nfour\n{passage}"), (2, "own words of a third row")]
    got = drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and [r.doc_id for r in got if passage in r.kept_text] == [2, 2]  # one rank: both keep it
    assert sorted(r.kept_text.replace(passage, "") for r in got) == sorted(["one\n", "two two\n", "three\n", "four\nfour\n", "own words of a third row"])


def test_repeated_passages_are_found_again(spark, data):
    """Of the documents that hold 51 words in a row that an earlier one has too, at least 0.9 hold none afterwards."""
    kept = {r.doc_id: r.kept_text for r in drop_repeated_passages(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()
    windows = lambda t: {tuple(w[k : k + 51]) for w in [(t or "").lower().split()] for k in range(len(w) - 50)}
    seen, held, left = set(), 0, 0
    for i, t in rows:
        own = windows(t)
        held += bool(own & seen)
        left += bool(windows(kept[i]) & seen)
        seen |= own
    assert held and left <= 0.1 * held


def brute_fingerprint(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(rows):
    for _, t, *_ in rows:
        assert fingerprint(t) % 2**64 == brute_fingerprint(t)


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(rows, docs, clashing, empty, repeated):
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_groups(docs).collect()}
    assert got == {i: (fp[i], want[i]) for i in fp} and len(set(want.values())) < len(want)
    assert {r.doc_id: r.component_id for r in simhash_groups(clashing).collect()} == want
    assert simhash_groups(empty).count() == 0
    assert {r.doc_id: r.component_id for r in simhash_groups(repeated).collect()} == want


def test_all_close_fingerprints_share_an_anchor(spark):
    import random

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1, 1 << 63]
    pairs = [(x, x ^ (1 << i) ^ (1 << j if j < 64 else 0)) for x in base for i, j in ((r.randrange(64), r.randrange(65)) for _ in range(60))]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "x long, y long")
    out = df.select(F.size(F.array_intersect(anchors("x"), anchors("y"))).alias("n"), F.size(anchors("x")).alias("k"))
    assert out.filter("n = 0").count() == 0 and out.agg(F.max("k")).first()[0] == 33


def test_bucket_links_span_the_bucket():
    import numpy as np

    fps = np.array([0, 1, 3, 7, 15, 1 << 40, 1 << 41, 1 << 20 | 1 << 21 | 1 << 22], np.int64)
    links = bucket_links(fps, 2)
    assert len(links) == 6 and {a for pair in links for a in pair} == set(fps.tolist()) - {1 << 20 | 1 << 21 | 1 << 22}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    import random

    r = random.Random(seed)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    linked = {frozenset(p) for p in pairs}
    nodes = sorted({n for p in pairs for n in p if p[0] != p[1]})
    want = brute_components(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert {x.node: x.root for x in components(spark.createDataFrame(pairs, "src long, dst long")).collect()} == want


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_queries_agree_with_sql(spark, data, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.sql(Q.SQL[name])
    got = Q.QUERIES[name](spark, data)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
