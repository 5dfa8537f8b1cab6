"""SentencePiece encoding and decoding over a relational lattice of words."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, worker_cache

BLANK = "▁"
#: A word's boundaries fill a 64-bit mask; longer words take the worker's fold.
LONGEST = 60
#: Words of a worker's own that it remembers; when full it starts anew.
REMEMBERED = 1 << 17
#: The score and id of what is no piece.
NONE = (float("-inf"), -1)
#: Documents in one outgoing Arrow batch.
BATCH = 256


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: ``(piece, id, score)``, the ids of the 256 byte pieces (none: []), the unknown's id, and the kind, ``bpe`` or ``unigram``."""

    rows: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...] = ()
    unknown: int = 0
    kind: str = "bpe"
    others: tuple[int, ...] = ()
    index: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self.index.update({p: (s, i) for p, i, s in self.rows})

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)

    @cached_property
    def words(self) -> str:
        """A pattern of units that no piece reaches across: a run of blanks with what follows, split between letters and others where no piece mixes them."""
        mixed = any(len({c.isalpha() for c in p.lstrip(BLANK)}) > 1 for p, _, _ in self.rows)
        if any(BLANK in p.lstrip(BLANK) for p, _, _ in self.rows):
            raise ValueError("a piece holds a blank after another character")
        return rf"{BLANK}*[^{BLANK}]+|{BLANK}+" if mixed else rf"{BLANK}*\p{{L}}+|{BLANK}*[^\p{{L}}{BLANK}]+|{BLANK}+"

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        return self._merge(word) if self.kind == "bpe" else self._viterbi(word)

    def _merge(self, word: str) -> list[int]:
        """The best-scored, leftmost pair first: a scan over few parts, a heap with links over many."""
        if len(word) <= 24:
            return self._merge_short(word)
        n, index = len(word), self.index
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-index[p][0], i, i + 2) for i in range(n - 1) if (p := word[i : i + 2]) in index]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (p := word[i : end[stop]]) in index:
                    heapq.heappush(heap, (-index[p][0], i, end[stop]))
            if (h := before[i]) >= 0 and (p := word[h:stop]) in index:
                heapq.heappush(heap, (-index[p][0], h, stop))
        out, i = [], 0
        while i < n:
            p = word[i : end[i]]
            out += [index[p][1]] if p in index else self.fallback(p)
            i = end[i]
        return out

    def _merge_short(self, word: str) -> list[int]:
        index = self.index
        get = index.get
        parts = list(word)
        score = [get(a + b, NONE)[0] for a, b in zip(word, word[1:], strict=False)]
        while score:
            best = max(score)
            if best == NONE[0]:
                break
            i = score.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del score[i]
            if i:
                score[i - 1] = get(parts[i - 1] + parts[i], NONE)[0]
            if i < len(score):
                score[i] = get(parts[i] + parts[i + 1], NONE)[0]
        return [x for p in parts for x in ((index[p][1],) if p in index else self.fallback(p))]

    def _viterbi(self, word: str) -> list[int]:
        best = [(0.0, -1)]
        lowest = min((s for _, _, s in self.rows), default=0.0) - 10.0
        for i in range(1, len(word) + 1):
            options = [(best[j][0] + self.index[word[j:i]][0], j) for j in range(max(0, i - self.longest), i) if word[j:i] in self.index]
            best.append(max(options or [(best[i - 1][0] + lowest, i - 1)], key=lambda o: (o[0], -o[1])))
        out, i = [], len(word)
        while i:
            j = best[i][1]
            out.append([self.index[word[j:i]][1]] if word[j:i] in self.index else self.fallback(word[j:i]))
            i = j
        return [x for part in reversed(out) for x in part]

    @cached_property
    def spelled(self) -> dict[int, bytes]:
        table = {i: p.replace(BLANK, " ").encode() for p, i, _ in self.rows} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return table | {i: b"" for i in self.others} | {self.unknown: " ⁇ ".encode()}

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(model: str) -> Pieces:
    """Reads a ``.model`` of the public tokenizers. The identity normaliser with a dummy prefix is the one supported."""
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(model), "rb") as f:
        spec.ParseFromString(f.read())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("this normaliser isn't supported")
    kinds = {1: "unigram", 2: "bpe"}
    rows = tuple((p.piece, i, p.score) for i, p in enumerate(spec.pieces) if p.type in (1, 4))
    own = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 6}
    byte_ids = tuple(own[f"<0x{b:02X}>"] for b in range(256)) if own else ()
    others = tuple(i for i, p in enumerate(spec.pieces) if p.type == 3)
    unknown = next(i for i, p in enumerate(spec.pieces) if p.type == 2)
    return Pieces(rows, byte_ids, unknown, kinds[spec.trainer_spec.model_type], others)


def escaped(text: str = "text"):
    """Blanks written as the pieces have them, with the dummy prefix; nothing for nothing."""
    full = F.coalesce(F.col(text), F.lit(""))
    return F.when(full != "", F.concat(F.lit(BLANK), F.replace(full, F.lit(" "), F.lit(BLANK)))).otherwise("")


def frequent_words(docs: DataFrame, pieces: Pieces, most: int, text: str = "text") -> DataFrame:
    """At most ``most`` words of up to ``LONGEST`` characters, the commonest of all texts.

    Counts combine before the shuffle. The driver sees a histogram of the counts' logarithms
    (under 1,100 rows) and picks the step above which no more than ``most`` words lie.
    """
    words = docs.select(F.explode(F.regexp_extract_all(escaped(text), F.lit(pieces.words), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.char_length("word") <= LONGEST)
    words = cut(words.select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")))
    room, least = most, 1 << 20
    for step, n in sorted(((r["step"], r["count"]) for r in words.groupBy("step").count().collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, step
    return words.filter(F.col("step") >= least).select("word")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word, edges``: of each distinct word (``LONGEST`` characters or fewer) the substrings that are pieces.

    Substrings up to the longest piece are exploded and equi-joined to the piece table (a
    vocabulary, so its size is fixed and it may be broadcast); single characters stay without a
    match, as byte or unknown ids. Edges ``(cost, from, to, ids)`` are grouped by word.
    """
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame([(p, i, float(s)) for p, i, s in pieces.rows], "piece string, id int, score double"))
    n = F.char_length("word")
    cuts = f"transform(sequence(0, char_length(word) - 1), i -> transform(sequence(1, least({pieces.longest}, char_length(word) - i)), l -> struct(i as a, i + l as b)))"
    spans = words.filter(n > 0).select("word", F.explode(F.expr(f"flatten({cuts})")).alias("s")).select("word", "s.a", "s.b", F.expr("substring(word, s.a + 1, s.b - s.a)").alias("piece"))
    found = spans.join(table, "piece", "left").filter(F.col("id").isNotNull() | (F.col("b") - F.col("a") == 1))
    if pieces.byte_ids:
        ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
        other = F.transform(F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda k: F.element_at(ids, F.conv(F.substring(F.hex(F.col("piece")), k * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
    else:
        other = F.array(F.lit(pieces.unknown))
    lowest = min((s for _, _, s in pieces.rows), default=0.0) - 10.0
    edge = F.struct(F.coalesce(-F.col("score"), F.lit(-lowest)).alias("cost"), F.col("a"), F.col("b"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(other).alias("ids"))
    return found.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def fold(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """``word, ids`` from ``lattice``: a fold with ``aggregate`` over each word's edges.

    A unigram model takes Viterbi: per position the cheapest way to reach it. A BPE model's
    segmentation isn't the path of least cost, so there the fold merges: its state is the mask of
    boundaries still standing, and each step takes the best-scored, leftmost edge that spans
    exactly two standing neighbours. Both give what the model's own library gives.
    """
    n = "char_length(word)"
    if pieces.kind == "bpe":
        sort = "array_sort(transform(filter(edges, e -> e.b - e.a > 1), e -> struct(e.cost, e.a, shiftleft(1L, e.a) | shiftleft(1L, e.b) as ends, shiftleft(1L, e.b) - shiftleft(2L, e.a) as inner)))"
        step = "(m, i) -> m & ~coalesce(get(filter(multi, e -> (m & e.ends) = e.ends and bit_count(m & e.inner) = 1), 0).inner, 0L)"
        edges = edges.withColumn("multi", F.expr(sort))
        edges = edges.withColumn("mask", F.expr(f"aggregate(if({n} > 1 and size(multi) > 0, sequence(1, least({n} - 1, {n})), array()), shiftleft(1L, {n} + 1) - 1, {step})"))
        taken = "filter(edges, e -> (mask & (shiftleft(1L, e.a) | shiftleft(1L, e.b))) = (shiftleft(1L, e.a) | shiftleft(1L, e.b)) and (mask & (shiftleft(1L, e.b) - shiftleft(2L, e.a))) = 0)"
    else:
        best = "array_min(transform(filter(edges, e -> e.b = i), e -> struct(e.cost + p[e.a].cost as cost, e.a as a)))"
        edges = edges.withColumn("reach", F.expr(f"aggregate(sequence(1, {n}), array(struct(0.0D as cost, -1 as a)), (p, i) -> concat(p, array({best})))"))
        edges = edges.withColumn("at", F.expr(f"aggregate(sequence(1, {n}), array({n}), (s, i) -> if(s[0] > 0, concat(array(reach[s[0]].a), s), s))"))
        taken = "filter(edges, e -> array_contains(at, e.a) and array_contains(at, e.b) and reach[e.b].a = e.a)"
    ordered = f"array_sort(transform({taken}, e -> struct(e.a as a, e.ids as ids)))"
    return edges.select("word", F.expr(f"flatten(transform({ordered}, e -> e.ids))").alias("ids"))


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Encoder(dict):
    """Word -> ids, packed: the broadcast words, and with the same rules worked out here those that are rarer."""

    def __init__(self, pieces: Pieces, words: list[str], ids: list[bytes]):
        super().__init__(zip(words, ids, strict=True))
        import regex

        self.pieces, self.known = pieces, len(self)
        self.any = regex.compile(pieces.words)
        self.ascii = re.compile(pieces.words.replace(r"\p{L}", "A-Za-z").replace("A-Za-z+", "[A-Za-z]+") if r"\p{L}" in pieces.words else pieces.words)
        self.own: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.own.get(word)
        if ids is None:
            if len(self.own) >= REMEMBERED:
                self.own.clear()
            ids = packed(self.pieces.encode_word(word))
            if len(word) <= LONGEST:
                self.own[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = (self.ascii if text.isascii() else self.any).findall(BLANK + text.replace(" ", BLANK))
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)


def _split(lists: pa.ListArray) -> list[bytes]:
    flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy()
    return [flat[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _encoder(shared, pieces_shared) -> Encoder:
    """One for each worker and broadcast; an earlier one goes."""
    held, key = worker_cache("encoder"), shared.value["key"]
    if key not in held:
        held.clear()
        held[key] = Encoder(pieces_shared.value, shared.value["words"], shared.value["ids"])
    return held[key]


def encode(docs: DataFrame, pieces: Pieces, most_words: int = 1 << 18, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, ids, restored`` for each row of ``docs``: the ids of the whole text, and whether decoding them gives it back.

    *Plan.* Words are units that no piece reaches across. The ``most_words`` commonest are
    encoded as relations (``lattice``, ``fold``) and broadcast, which their number and length
    bound. A second pass looks words up; those that are rarer are encoded in the worker
    with the same rules, so neither the dictionary nor a shuffle grows with the data.

    *Cases.* Null or empty text: no ids. Characters that are no piece: their UTF-8 bytes' ids, or the
    unknown id in a model without byte pieces. A word of any length costs n log n. Empty table: no rows. Repeated rows:
    one result each. The character U+2581 counts as a blank, as in the library, so such a text isn't restored. Other columns are ignored.
    """
    import uuid

    sc = docs.sparkSession.sparkContext
    found = fold(lattice(frequent_words(docs, pieces, most_words, text), pieces), pieces).toArrow()
    ids = [x for part in found["ids"].chunks for x in _split(part)]
    words = sc.broadcast({"key": uuid.uuid4().hex, "words": found["word"].to_pylist(), "ids": ids})
    model = sc.broadcast(pieces)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(words, model)
        for big in it:
            for at in range(0, big.num_rows, BATCH):
                b = big.slice(at, BATCH)
                texts = b.column(1).to_pylist()
                ids = [encoder.encode(t) for t in texts]
                same = [encoder.pieces.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.record_batch([b.column(0), flat, pa.array(same, pa.bool_())], names=["doc_id", "ids", "restored"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>, restored boolean")


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``doc_id, text`` for each row of ``encoded``. Null ids: null. No ids: empty text. Bytes that aren't UTF-8: U+FFFD. An id that the model doesn't have is an error."""
    model = encoded.sparkSession.sparkContext.broadcast(pieces)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = model.value.decode
        for b in it:
            yield pa.record_batch([b.column(0), pa.array([None if x is None else spell(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(batches, f"doc_id {encoded.schema[key].dataType.simpleString()}, text string")
