"""Token counts: byte-pair merging that counts merges and emits no identifiers."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker remembers; when full it starts anew.
REMEMBERED = 1 << 19
#: Lower-case forms that the library uses and Python's str.lower() does not (final sigma, two newer letters).
LOWER = (("\u03a3", "\u03c3"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))


class Counts(dict):
    """Word -> number of tokens, found by merging on first sight."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.whole = {}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rules = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        chars = _byte_chars()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + end] for c in chars]

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode())
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n
        return n

    def count(self, data: bytes) -> int:
        """Symbols minus merges. A heap holds the adjacent pairs by rank, then place; links skip what has been merged."""
        n = len(data)
        if n < 2:
            return n
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rules, heap = self.rules, []
        for i in range(n - 1):
            if rule := rules.get((ids[i], ids[i + 1])):
                heap.append((rule[0], i, rule[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rules.get((ids[i], ids[j]), (-1, -1)) != (rank, made):
                continue
            ids[i], ids[j] = made, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if rule := rules.get((made, ids[k])):
                    heapq.heappush(heap, (rule[0], i, rule[1]))
            h = before[i]
            if h >= 0 and (rule := rules.get((ids[h], made))):
                heapq.heappush(heap, (rule[0], h, rule[1]))
        return left


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 shows it, else the next character from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def _newer(kind: str) -> str:
    """Spans of code points that the pattern module takes for letters (or numbers) and Python's own tables, which have the
    library's version of Unicode, don't know yet."""
    import regex

    match, out = regex.compile(rf"\p{{{kind}}}").match, []
    for i in range(0x80, 0x110000):
        if unicodedata.category(chr(i)) == "Cn" and match(chr(i)):
            if out and out[-1][1] == i - 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


class Counter:
    """Counts the tokens of a text as the vocabulary's library does without begin and end tokens.

    ``\\s`` is Unicode's White_Space there; Python's own ``\\s`` holds U+001C to U+001F too. Over all code points the
    counts agree but for a few unassigned ones, which the library composes with the character before.
    """

    def __init__(self, spec: dict):
        import regex

        self.words = Counts(spec)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        known = pattern.replace(r"\s", r"\p{White_Space}")
        self.any = regex.compile(known)
        newer = {k: _newer(k) for k in "LN"}
        self.newer = re.compile(f"[{newer['L']}{newer['N']}]") if any(newer.values()) else None
        for k, spans in newer.items():  # in a negated class, what is newer joins the rest
            known = known.replace(rf"[\p{{{k}}}]", rf"[\p{{{k}}}--[{spans}]]" if spans else rf"[\p{{{k}}}]")
        rest = r"[^\p{White_Space}\p{L}\p{N}]"
        self.careful = regex.compile("(?V1)" + known.replace(rest, rf"[{rest}{newer['L']}{newer['N']}]"))
        self.ascii = re.compile(pattern.replace(r"\s", r"\t-\r ").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))

    def __call__(self, text: str) -> int:
        if self.special is None or not (parts := self.special.findall(text)):
            return self.plain(text)
        return len(parts) + sum(map(self.plain, self.special.split(text)))

    def plain(self, text: str) -> int:
        """White space never joins a match, so the step that turns runs of it into one blank changes no count."""
        if text.isascii():
            found = self.ascii.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            for upper, lower in LOWER:
                text = text.replace(upper, lower)
            text = text.lower()
            found = (self.careful if self.newer and self.newer.search(text) else self.any).findall(text)
        return sum(map(self.words.__getitem__, found))


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        return Counter(json.load(f))


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; over: more than ``limit`` tokens.

    One pass without a shuffle. ``vocabulary`` is the name of a file of public tokenizers that
    every executor has. Each worker keeps the counts of at most ``REMEMBERED`` words.

    *Cases.* Null text: 0 bytes, 0 tokens. Special strings inside a text count as one token
    each, as in the library. A word of any length costs n log n. Empty table: no rows. Repeated
    rows: one result each. Other columns are ignored, whatever their names.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in it:
            n = pa.array([count(t) for t in b.column(2).to_pylist()], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.record_batch([b.column(0), b.column(1), n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.octet_length(full).cast("long").alias("n_bytes"), full.alias("text"))
    return rows.mapInArrow(batches, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
