"""Near copies by five-word shingles against all pairs."""

import random

import corpus_pipeline as P
from timeweft.llm.near_copies import near_groups

from .conftest import SCHEMA, words
from .test_dedup import LOWER, WORD, brute_components, brute_fingerprint


def brute_shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_near(rows):
    """All pairs: fingerprints at two bits or less, or 0.8 of the five-word shingles."""
    fp, own = {i: brute_fingerprint(t) for i, t, *_ in rows}, {i: brute_shingles(t) for i, t, *_ in rows}
    return brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2 or bool(own[a]) and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]))


def planted():
    """Edits of a few texts, more than a key's few rows of one of them, passages that many hold, and short texts."""
    r, out = random.Random(8), []
    passage = words(r, 60, 9999)
    for k in range(12):
        base = words(r, 150, 9999).split()
        out.append(" ".join(base))
        for _ in range(40 if k == 0 else 3):
            edit = list(base)
            for _ in range(r.randrange(1, 7)):
                edit[r.randrange(150)] = "v" + str(r.randrange(9999))
            out.append(" ".join(edit))
    out += [passage + " " + words(r, r.randrange(5, 40), 9999) for _ in range(40)]
    out += [passage[: r.randrange(100, 300)].upper() for _ in range(30)] + ["a b c d e f g", "a b c d e f", "a b", "A  b", "", None]
    r.shuffle(out)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


def crowd():
    """Many edits of one text that isn't there: alike, most of them under 0.8, in groups that share an edit, some of them near."""
    r = random.Random(9)
    base, out = words(r, 60, 9999).split(), []
    for k in range(150):
        edit = list(base)
        edit[5 + k % 5 * 10] = f"group{k % 5}"
        for _ in range(1 + k % 3):
            edit[r.randrange(60)] = f"own{r.randrange(9999)}"
        out.append(" ".join(edit))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(out)]


def test_a_crowd_under_the_limit(spark):
    rows = crowd()
    want = brute_near(rows)
    assert 10 < len(set(want.values())) < 140
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r.doc_id: r.component_id for r in near_groups(docs).collect()} == want


def test_planted_near_copies_go(spark):
    rows = planted()
    want = brute_near(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r.doc_id: r.component_id for r in near_groups(docs).collect()} == want
    kept = P.without_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    close = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert sum(i == c for i, c in want.items()) < sum(i == c for i, c in close.items())  # what two bits alone leave
