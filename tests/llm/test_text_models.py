"""Tokens, pieces, languages and pictures against the libraries, brute force and held-out rows."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from timeweft.llm import image_copies as I
from timeweft.llm import language_id as L
from timeweft.llm import sentencepiece_lattice as SP
from timeweft.llm.token_count import count_tokens, counter

from .conftest import SCHEMA, sorted_rows

ODD = ["", " ", "a", "don't we'll I'VE", "x\x1cy z", "a<|endoftext|>b <|startoftext|>", "İ ΣΑΣ ΟΔΟΣ é ﬁ", "日本語 12345 ½", "a" * 3000, "👍🏽 👨‍👩‍👧", "  a   b ", "a\nb\t\tc", "▁x", "tail  "]


def odd_texts(n=80):
    r = random.Random(2)
    spans = [(32, 127), (0xA0, 0x250), (0x370, 0x5FF), (0x900, 0xD7FF), (0x1F300, 0x1F700)]
    return ODD + ["".join(chr(r.randrange(*r.choice(spans))) for _ in range(80)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(10**5 + i, t, None, None, 0) for i, t in enumerate(odd_texts())] + [(10**6, None, None, None, 0)], SCHEMA)


def test_token_counts(odd, docs, clashing, empty, repeated):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in count_tokens(odd.union(docs)).join(odd.union(docs).select("doc_id", "text"), "doc_id").collect():
        t = r.text or ""
        assert r.n_tokens == len(library.encode(t, add_special_tokens=False).ids), t
        assert r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 2048)
    assert sorted_rows(count_tokens(docs)) == sorted_rows(count_tokens(clashing))
    assert count_tokens(empty).count() == 0 and count_tokens(repeated).count() == repeated.count()


def test_merging_by_hand():
    c = counter("word_bpe_49k.json").words
    for word in ("the", "thethethe", "zzzzzzzzzz", "ération"):
        ids = [c.inner[b] for b in word.encode()]
        ids[-1] = c.last[word.encode()[-1]]
        while True:  # the plain way: look for the lowest rank each time
            ranked = [(c.rules[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in c.rules]
            if not ranked:
                break
            i = min(ranked)[1]
            ids[i : i + 2] = [c.rules[ids[i], ids[i + 1]][1]]
        assert c.count(word.encode()) == len(ids)


@pytest.fixture(scope="module")
def pieces():
    return SP.load("piece_bpe_32k.model")


def test_encoding_is_the_librarys(odd, docs, clashing, empty, repeated, pieces):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    both = odd.union(docs)
    for few in (1 << 18, 50):  # with most words from the relations, and with most from the workers
        for r in SP.encode(both, pieces, most_words=few).join(both.select("doc_id", "text"), "doc_id").collect():
            t = r.text or ""
            assert list(r.ids) == library.encode(t), t
            assert r.restored == ("▁" not in t)
    back = {r.doc_id: r.text for r in SP.decode(SP.encode(both, pieces), pieces).collect()}
    assert all(back[r.doc_id] == (r.text or "").replace("▁", " ")[: None if "▁" not in (r.text or "") else None] for r in both.collect() if "▁" not in (r.text or ""))
    assert sorted_rows(SP.encode(docs, pieces)) == sorted_rows(SP.encode(clashing, pieces))
    assert SP.encode(empty, pieces).count() == 0 and SP.encode(repeated, pieces).count() == repeated.count()


def test_long_words_take_the_heap(pieces):
    r = random.Random(3)
    for n in (1, 2, 24, 25, 70, 500):
        word = "".join(r.choice("etaoin") for _ in range(n))
        plain = list(word)
        while True:
            scored = [(-pieces.index[a + b][0], i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if a + b in pieces.index]
            if not scored:
                break
            i = min(scored)[1]
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        assert pieces.encode_word(word) == [pieces.index[p][1] for p in plain]


def test_unigram_fold_is_viterbi(spark):
    """Every segmentation of short words by brute force; the fold finds the best score."""
    table = [("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -3.2), ("aba", -4.1), ("c", -5.0), ("abc", -6.5), ("bc", -4.9)]
    p = SP.Pieces(tuple((s, i, w) for i, (s, w) in enumerate(table)), (), 99, "unigram")
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randrange(1, 8))) for _ in range(60)})
    got = {x.word: x.ids for x in SP.fold(SP.lattice(spark.createDataFrame([(w,) for w in words], "word string"), p), p).collect()}
    score = dict(table)

    def best(w):
        if not w:
            return 0.0
        ways = [score[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in score]
        return max(ways or [-16.5 + best(w[1:])])

    for w in words:
        total = sum(table[i][1] if i != 99 else -16.5 for i in got[w])
        assert abs(total - best(w)) < 1e-9 and got[w] == p.encode_word(w), w


def sentence(r, lang):
    stock = {"en": "the of and with that from tion ing was for", "de": "der die und mit nicht ein ung heit sch auf", "fr": "le la des une pour que ment eau dans est", "es": "el los las que una con para cion del por"}
    return " ".join(r.choice(stock[lang].split()) for _ in range(r.randrange(3, 30)))


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    part = F.xxhash64("doc_id") % 2 == 0
    model = L.fit(docs.filter(part))
    rows = docs.filter(~part).select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    got = L.identify(rows, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").collect()
    assert len(got) > 50 and sum(r.text_language == r.lang for r in got) / len(got) >= 0.97
    assert sum(r.language == r.lang for r in got) / len(got) >= 0.97


def test_priors_decide_where_the_text_is_silent(spark):
    r = random.Random(1)
    rows = [(i, sentence(r, "de"), "de", "host1", 0) for i in range(40)] + [(100 + i, sentence(r, "fr"), "fr", "host2", 0) for i in range(40)] + [(999, "12 34", None, "host2", 0), (1000, None, "de", None, 0), (1001, "привет мир как дела сегодня", None, None, 0), (1002, "", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.id: x for x in L.identify(df.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")), L.fit(df)).collect()}
    assert (got[999].language, got[999].text_language) == ("fr", "und") and got[1000].language == "de"
    assert got[1001].language == "und"
    kept = {x.doc_id for x in L.keep_known(df, L.fit(df)).collect()}
    assert kept >= {r[0] for r in rows[:80]} and 1001 not in kept


def brute_language(rows, model, temper=0.3, strength=5.0):
    """The formula of ``identify`` row by row, with plain sums over all other rows."""
    langs = [*model.languages, "und"]
    n = len(langs)
    soft = lambda v: (np.exp(v - v.max()) / np.exp(v - v.max()).sum())
    at = []
    for _, text, declared, host in rows:
        scores, count = model.scores(text)
        labels = (host or "").split(".")
        parts = {"declared": declared.lower() if declared else None, "host": host, "suffix": labels[-1] if len(labels) > 1 else None, "domain": ".".join(labels[-2:]) if len(labels) > 1 else None}
        at.append((scores * temper if count > 1 else np.zeros(n), soft(scores * temper) if count > 1 else np.zeros(n), parts))
    every = sum((s for _, s, _ in at), np.zeros(n))
    out = []
    for score, own, parts in at:
        rest = lambda c: np.maximum(sum((s for _, s, p in at if p[c] == parts[c] and p[c] is not None), np.zeros(n)) - (own if parts[c] is not None else 0), 0)  # noqa: E731,B023
        smooth = lambda held, prior: (held + prior * strength) / (held.sum() + strength)
        prior = smooth(rest("host"), smooth(rest("domain"), smooth(every, np.full(n, 1 / n))))
        total = score + np.log(np.maximum(prior, 1e-12))
        others = np.maximum(every - own, 0)
        for c in ("declared", "suffix"):
            if parts[c] is not None:
                held = rest(c)
                share = max(held.sum() / max(1e-9, others.sum()), 1e-9)
                total = total + np.log(np.maximum((held + share * strength) / (others + strength), 1e-12))
        post = soft(total)
        out.append((langs[int(post.argmax())], float(post.max())))
    return out


def test_language_agrees_with_the_formula(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(40).collect()
    model = L.fit(spark.read.parquet(f"{data}/documents.parquet"))
    hosts = ["a.example.fr", "b.example.fr", "example.de", "local", None]
    rows = [(r.doc_id, [r.text[:60], "12", None, "zz qq"][i % 4], [r.lang, None, "xx"][i % 3], hosts[i % 5]) for i, r in enumerate(docs)]
    got = {r.id: r for r in L.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string"), model).collect()}
    for row, (language, confidence) in zip(rows, brute_language(rows, model), strict=True):
        assert got[row[0]].language == language and abs(got[row[0]].confidence - confidence) < 1e-9


def test_language_cases(docs, clashing, empty, repeated):
    model = L.fit(docs)
    assert L.keep_known(empty, model).count() == 0 and L.fit(empty).languages == ()
    assert L.keep_known(clashing, model).columns == clashing.columns
    assert sorted_rows(L.keep_known(docs, model)) == sorted_rows(L.keep_known(clashing, model).select(*docs.columns))
    assert L.keep_known(repeated, model).count() >= L.keep_known(docs, model).count()
    ids = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    assert {r.language for r in L.identify(ids, L.fit(empty)).collect()} == {"und"}


def test_page_evidence(spark):
    page = '<!DOCTYPE html><html class="x" lang="FR-fr"><head><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>le &amp; la</p></body></html>'
    assert L.parse_page(page, page, "https://user@www.Example.org:8080/x") == (L.visible_text(page), "fr", "www.example.org")
    assert "var" not in L.visible_text(page) and "le & la" in L.visible_text(page)
    assert L.parse_page(None, None, None) == ("", None, None)


def png(img):
    rows = b"".join(bytes([1]) + np.diff(np.concatenate([[0], line.astype(int)])).astype(np.uint8).tobytes() for line in img)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_picture_formats():
    img = np.clip(I.draw(3), 0, 255).astype(np.uint8)
    assert (I.decode_picture(png(img)) == img).all()
    assert (I.decode_picture(b"P5 64 64 255\n" + img.tobytes()) == img).all()
    assert all(I.decode_picture(x) is None for x in (None, b"", b"P5 9 9 255\nxx", b"GIF89a", b"\x89PNG\r\n\x1a\nrest"))


def pgm(img):
    img = np.clip(np.rint(img), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % img.shape[::-1] + img.tobytes()


def test_copies_of_pictures(spark):
    rows = [(i, I.page_picture(i)) for i in range(160)]
    turned = [(1000 + i, pgm(np.rot90(I.draw(i)))) for i in range(8)]
    smaller = [(2000 + i, pgm(I._resized(I.draw(20 + i)[None], 0.8)[0])) for i in range(4)]
    odd = [(5000, None), (5001, b""), (5002, b"junk"), (5003, b"junk"), (5004, pgm(np.zeros((64, 64)))), (5005, pgm(np.zeros((5, 5)))), (0, rows[0][1])]
    df = spark.createDataFrame([*rows, *turned, *smaller, *odd], "image_id long, image binary").withColumn("digest", F.lit("x"))
    got = I.copy_classes(df).collect()
    assert len(got) == len(rows) + len(turned) + len(smaller) + len(odd)
    cls = {r.image_id: r.class_id for r in got}
    edits = Counter()
    for i in range(160):
        if i % 8 == 7:
            edits[i // 8 % 4] += cls[i] == cls[i - 7]
        else:
            assert cls[i] == i, "a picture of its own"
    assert edits[1] == edits[2] == edits[3] == 5 and edits[0] >= 3
    assert sum(cls[1000 + i] == i for i in range(7)) >= 6
    assert sum(cls[2000 + i] == 20 + i for i in range(4) if (20 + i) % 8 != 7) >= 2
    assert cls[5002] == cls[5003] == 5002 and [cls[i] for i in (5000, 5001, 5004, 5005)] == [5000, 5001, 5004, 5005]
    assert I.copy_classes(df.filter("false")).count() == 0


def test_every_picture_of_a_large_group_is_found(spark):
    r = np.random.default_rng(1)
    one = I.draw(1)
    rows = [(i, pgm(one + r.normal(0, 1, one.shape))) for i in range(60)] + [(100 + i, pgm(I.draw(100 + i))) for i in range(20)]
    cls = {x.image_id: x.class_id for x in I.copy_classes(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert {cls[i] for i in range(60)} == {0} and all(cls[100 + i] == 100 + i for i in range(20))


def test_every_kind_of_edit_is_found(spark):
    kinds = {"crop": lambda i: I.page_picture(i + 7, 0), "brightness": lambda i: I.page_picture(i + 7, 1), "box": lambda i: I.page_picture(i + 7, 2), "noise": lambda i: I.page_picture(i + 7, 3)}
    kinds |= {"turn": lambda i: pgm(np.rot90(I.draw(i))), "smaller": lambda i: pgm(I._resized(I.draw(i)[None], 0.8)[0])}
    kinds |= {"corner": lambda i: pgm(I.draw(i)[:50, :50])}
    rows, number = [], 0
    for k, edit in enumerate(kinds.values()):
        for _ in range(40):
            rows += [(number, pgm(I.draw(number))), (100_000 + number, edit(number))]
            number += 8
    cls = {r.image_id: r.class_id for r in I.copy_classes(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(cls[i] == i for i in range(0, number, 8)), "no false class"
    found = {kind: sum(cls[100_000 + i] == i for i in range(320 * k, 320 * (k + 1), 8)) for k, kind in enumerate(kinds)}
    assert all(n >= 36 for n in found.values()), found


def plain_classes(rows, least=3, step=6.0):
    """Classes by comparing all descriptors that agree on a key, and union-find."""
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, set()).add((r.image_id, r.geo, r.rest))
    votes = {}
    for held in by_key.values():
        for a, ga, ra in held:
            for b, gb, rb in held:
                if a < b and (int(ra) ^ int(rb) if (ra < 0) == (rb < 0) else (ra ^ rb) & 2**64 - 1).bit_count() <= I.DISTANCE:
                    turn = ((gb >> 2 & 31) - (ga >> 2 & 31)) % I.TURNS
                    ratio, angle = I.SCALES[ga & 3] / I.SCALES[gb & 3], turn * 2 * np.pi / I.TURNS
                    ax, ay = ga >> 23 & 65535, ga >> 7 & 65535
                    sx = (gb >> 23 & 65535) - ratio * (np.cos(angle) * ax - np.sin(angle) * ay)
                    sy = (gb >> 7 & 65535) - ratio * (np.sin(angle) * ax + np.cos(angle) * ay)
                    for g in range(4):
                        votes.setdefault((a, b, turn, (gb & 3) - (ga & 3), g, np.floor((sx + g % 2 * step / 2) / step), np.floor((sy + g // 2 * step / 2) / step)), set()).add(ga)
    root = {}

    def find(n):
        while root.get(n, n) != n:
            n = root[n]
        return n

    for (a, b, *_), corners in votes.items():
        if len(corners) >= least:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in {r.image_id for r in rows}}


def test_crowded_keys_lose_no_class(spark):
    """Keys that many pictures share, of which a picture agrees with few: by hand, against all pairs."""
    r = random.Random(5)
    rows = []
    for i in range(120):
        family = r.randrange(30)
        for c in range(3):  # corners of a family agree on a shift, at places of their own
            key = 1000 + (family % 6) * 3 + c
            rows.append((i, (100 + 40 * c + 300 * (family // 6)) << 23 | (200 + 300 * (family % 5)) << 7 | r.choice([0, 0, 0, 6]) << 2, key, r.choice([-1, -1, 2**40 - 1])))
    df = spark.createDataFrame([(*x, "x") for x in rows], "image_id long, geo long, key long, rest long, digest string")
    want = plain_classes(df.collect())
    assert 1 < len(set(want.values())) < 120
    for near, block in ((2, 4), (10, 256), (3, 16)):
        got = {n: n for n in want} | {x.node: x.root for x in I.components(I.links(df, near=near, block=block)).collect()}
        assert got == want
    assert I.links(df.filter("false")).count() == 0


def test_classes_of_pictures_against_all_pairs(spark):
    pages = spark.range(0, 96).withColumnRenamed("id", "page_id")
    pictures = I.page_pictures(pages)
    want = plain_classes(I.table_keys(I.descriptors(pictures)).collect())
    got = {x.image_id: (x.class_id, x.class_size) for x in I.copy_classes(pictures).collect()}
    size = Counter(want.get(i, i) for i in range(96))
    assert got == {i: (want.get(i, i), size[want.get(i, i)]) for i in range(96)}


def test_pages_without_an_id_keep_their_rows(spark):
    pages = spark.createDataFrame([(0,), (None,), (7,), (None,), (7,)], "page_id long").withColumn("image_id", F.lit("x"))
    got = Counter(tuple(r) for r in I.copy_classes(I.page_pictures(pages)).collect())
    assert got == {(0, 0, 1): 1, (7, 7, 2): 2, (None, None, 1): 2} or got == {(0, 0, 3): 1, (7, 0, 3): 2, (None, None, 1): 2}
    assert I.page_pictures(pages.filter("false")).count() == 0
