"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, ranked, text_key

EPS = 1e-9
#: Documents that a group leaves undecided, its smallest open ones; they meet those of other groups.
LEAVE = 16


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, sid, n_docs, source_size, target`` from rows with ``source, size``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share
    the sum of all sizes. A target stops at ``most`` times its source's size; the level at
    which the rest share the excess rises until none is above. A round of that is one
    aggregate over the table of sources, which gives the driver three numbers; sources are
    ranked by a range shuffle, so their number isn't bound by a task either.
    """
    src = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    src = cut(ranked(src, [F.col("source").asc_nulls_last()], [], rank="sid"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("top", F.col("source_size") * F.lit(float(most)))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        above = F.col("w") * F.lit(level) > F.col("top")
        n, full, rest = src.agg(F.count_if(above), F.sum(F.when(above, F.col("top")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - full) / rest
    return src.select("source", "sid", "n_docs", "source_size", F.least("top", F.col("w") * F.lit(level)).alias("target"))


def pivot(p: np.ndarray, mass: np.ndarray, rng: np.random.Generator, leave: int = 0) -> np.ndarray:
    """Rounds all but ``leave`` of the probabilities ``p`` to 0 or 1; no expectation changes.

    The largest open item is paired with a mixture of all smaller ones: a step moves words from one side to the other, the mixture's shares
    the same either way, with the odds that leave expectations unchanged, until one item is decided. So ``sum(p * mass)`` stays as it is. Only without
    ``leave`` the last item, the smallest if the rest had room for the larger ones, takes its own coin.
    """
    order = np.argsort(-mass, kind="stable")
    q, m = p[order].copy(), mass[order].astype(float)
    for i in range(len(q)):
        while EPS < q[i] < 1 - EPS:
            k = i + 1 + np.flatnonzero((q[i + 1 :] > EPS) & (q[i + 1 :] < 1 - EPS))
            if len(k) < max(1, leave):
                break
            own, held = q[k], m[k]
            share = held * own * (1 - own)
            share /= share.sum()
            up = min((1 - q[i]) * m[i], (own * held / share).min())  # words that can go from the mixture to i
            down = min(q[i] * m[i], ((1 - own) * held / share).min())  # and from i to the mixture
            moved = up if rng.random() * (up + down) < down else -down
            q[i] += moved / m[i]
            q[k] = np.clip(own - moved * share / held, 0.0, 1.0)
        if not leave and EPS < q[i] < 1 - EPS:
            q[i] = float(rng.random() < q[i])
    closed = (q <= EPS) | (q >= 1 - EPS)
    out = np.empty_like(q)
    out[order] = np.where(closed, np.round(q), q)
    return out


def _settle(seed: int, level: int, fan_in: int):
    """Pivots one group; what it draws depends on the seed, the level and the group only. A source's last group is rounded in full."""

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
        at = [seed, level, table["sid"][0].as_py(), table["bucket"][0].as_py()]
        p, mass, rng = table["p"].to_numpy().copy(), table["size"].to_numpy(), np.random.default_rng(at)
        last = table["n_docs"][0].as_py() <= fan_in * (fan_in // LEAVE) ** level
        p = pivot(p, mass, rng, 0 if last else LEAVE)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return settle


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, fan_in: int = 128, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken, h1, h2`` (the text's hash).

    A document should be taken target / source_size times (at most ``most``): the whole part
    for sure, the fraction by pivotal dependent rounding in words, so that a source's taken
    words come near its target: the rest after the last rounding is that of its smallest documents. The same rows, seed and fan-in
    give the same copies, however rows are dealt to tasks.

    *Plan.* One pass over the texts leaves ids, sources and sizes. Documents of a source are
    hashed into groups of about ``fan_in``; each leaves at most ``LEAVE`` undecided documents, and
    those meet ``fan_in / LEAVE`` groups at a time, level by level. In a source's last group all are decided. Every document's expected copies are target / source_size. A group holds about ``fan_in`` rows, however hot its source.

    *Cases.* Null text: size 0; documents of size 0 take copies by their own coin and no words.
    A null source is a source of its own. A source of size 0 has target 0 and no copies. Empty table:
    no rows. Repeated rows: rounded apart, each within the limits. Other columns are ignored.
    """
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), *text_key(F.col(text)))
    sized = cut(sized)
    src = cut(source_targets(sized, weights, most))
    a, b = sized.alias("a"), src.alias("b")
    rows = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.sid", "b.n_docs", "b.source_size", "b.target")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    own = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "sid"), F.lit(2**30)) / F.lit(float(2**30))
    rows = rows.withColumn("p", F.when(F.col("size") == 0, (own < F.col("p")).cast("double")).otherwise(F.col("p")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n_docs") / F.lit(fan_in))))
    most_docs = src.agg(F.max("n_docs")).first()[0] or 0
    depth = 1
    while most_docs > fan_in * (fan_in // LEAVE) ** (depth - 1):
        depth += 1
    decided, schema = [], rows.schema
    for level in range(depth):
        rows = cut(rows.groupBy("sid", "bucket").applyInArrow(_settle(seed, level, fan_in), schema))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(rows.filter(~open_))
        rows = rows.filter(open_).withColumn("bucket", F.floor(F.col("bucket") / F.lit(fan_in // LEAVE)))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h1", "h2")


def mixed_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    *Cases.* Those of ``mix``; documents that it takes no copy of go. Rows of one id with other texts or sources take their own copies; rows with the same id, source and text
    take the least that the mix gave one of them. Null ids are told apart by source and text.
    """
    source, text = options.get("source", "source"), options.get("text", "text")
    own = ["doc_id", "source", "h1", "h2"]
    taken = mix(docs, key=key, **options).groupBy(*own).agg(F.min("copies").cast("int").alias("copies")).filter("copies > 0")
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in own], F.col("copies").alias("_copies"))
    same = docs[key].eqNullSafe(taken["_doc_id"]) & docs[source].eqNullSafe(taken["_source"])
    for h, c in zip(text_key(docs[text]), ("_h1", "_h2"), strict=True):
        same = same & (h == taken[c])
    rows = docs.join(taken.hint("shuffle_hash"), same)
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken["_copies"])).alias("__copy")).drop("__copy")
