"""Language ID: text likelihoods, declared language, address suffix and host priors, fused by Bayes."""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, worker_cache, written

#: Hashed letter trigrams.
BUCKETS = 1 << 15
UNKNOWN = "und"
CHUNK = 1 << 20
#: Rows that a worker turns into Python objects at a time.
BATCH = 256
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 97 + b - 65 if 65 <= b <= 90 else 32 for b in range(256))
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """The codes of a text's letter trigrams, a chunk at a time; words are set apart by one blank."""
    data = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    a = np.frombuffer(data, np.uint8)
    for i in range(0, len(a) - 2, CHUNK):
        x = a[i : i + CHUNK + 2].astype(np.uint32)
        yield ((x[:-2] << 10) ^ (x[1:-1] << 5) ^ x[2:]) & (BUCKETS - 1)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigrams in each language; the last row is a uniform background, the unknown."""

    languages: tuple[str, ...]
    table: np.ndarray

    def scores(self, text: str | None) -> tuple[np.ndarray, int]:
        total, n = np.zeros(len(self.languages) + 1), 0
        for codes in trigrams(text):
            held = np.bincount(codes, minlength=BUCKETS)
            total += self.table @ held
            n += len(codes)
        return total, n


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = 2000, smoothing: float = 0.05) -> TextModel:
    """A model from ``rows`` labelled rows (and their exact repeats): those with the least hashes of id and text.

    That number is the one bound on a sample here; rows without a label or a text don't count. Workers count the trigrams of whole texts; the driver gets the sums,
    one number at most for each language and bucket. Empty table: a model without languages.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    named = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("l"), F.col(text).alias("t"), F.pmod(F.xxhash64(F.lit("fit"), key, full), F.lit(2**40)).alias("h"))
    share = int(min(1.0, 4 * rows / max(1, named.count())) * 2**40)  # a first cut, so that few hashes are sorted
    some = named.filter(F.col("h") < share)
    last = some.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    few = some.filter(F.col("h") <= F.lit(-1 if last is None else last)).select("l", "t")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        counts: dict[str, np.ndarray] = {}
        for b in it:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                for codes in trigrams(text):
                    own += np.bincount(codes, minlength=BUCKETS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["l", "at", "n"])

    sums = few.mapInArrow(batches, "l string, at int, n long").groupBy("l", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(sums["l"])))
    counts = np.full((len(languages) + 1, BUCKETS), smoothing)
    counts[-1] = 1.0
    for i, name in enumerate(languages):
        own = sums[sums["l"] == name]
        counts[i, own["at"].to_numpy()] += own["n"].to_numpy()
    return TextModel(languages, np.log(counts / counts.sum(1, keepdims=True)))


def visible_text(page: str | None) -> str:
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> tuple[DataFrame, dict]:
    """Rows and options for ``identify`` from raw pages: the text is what a reader sees."""
    rows = pages.select(F.col(key).alias("id"), F.col(html).alias("text"), F.col(html).alias("declared"), F.col(url).alias("host"))
    return rows, {"parse": parse_page}


def parse_page(page: str | None, declared: str | None, url: str | None) -> tuple[str, str | None, str | None]:
    found, at = _DECLARED.search(declared or ""), _HOST.match(url or "")
    return visible_text(page), found[1].lower() if found else None, at[1].lower() if at else None


def parse_plain(text: str | None, declared: str | None, host: str | None) -> tuple[str, str | None, str | None]:
    return text or "", declared.lower() if declared else None, host


def identify(rows: DataFrame, model: TextModel, parse=parse_plain, temper: float = 0.3, strength: float = 5.0) -> DataFrame:
    """``id, language, confidence, text_language, declared, suffix, host`` for each row of ``rows`` (``id, text, declared, host``).

    *Evidence.* A row's log-posterior is the sum of its trigrams' log-likelihood (times ``temper``, for
    neighbouring trigrams aren't independent), that of its declared language and address suffix
    (the last label of the host's name) given the language, and a host prior. The tables of the last three are
    sums of the text posteriors over all rows, by grouped aggregation: hosts are smoothed by their domain, domains by
    the whole (``strength`` rows' worth each). A row's own posterior is taken out of the counts that it meets, so no evidence counts twice.

    *Plan.* One pass parses and scores whole texts and leaves a narrow table; the aggregates hold one number for
    each language, so they combine before the shuffle. They are written as tables, so a join back broadcasts one whose size allows it
    and can otherwise be split where a host is hot.

    *Cases.* Null or letterless text: no text evidence, so the priors decide; ``text_language`` is ``und``. Text that fits the
    uniform background better than any language: ``und``. Missing declaration, host or suffix: no evidence. Empty table: no rows. Repeated
    rows: one result each. A model without languages: all ``und``. Other columns are ignored.
    """
    langs = [*model.languages, UNKNOWN]
    n = len(langs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        for b in (big.slice(i, BATCH) for big in it for i in range(0, big.num_rows, BATCH)):
            out = []
            for text, declared, host in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                seen, said, at = parse(text, declared, host)
                scores, count = model.scores(seen)
                letters = count > 1
                out.append(((scores if letters else np.zeros(n)).tolist(), letters, said, at))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.list_(pa.float64())), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["id", "score", "letters", "declared", "host"])

    rows = rows.select("id", "text", "declared", "host")
    kind = rows.schema["id"].dataType.simpleString()
    seen = cut(rows.mapInArrow(batches, f"id {kind}, score array<double>, letters boolean, declared string, host string"))
    labels = F.split("host", r"\.")
    seen = seen.withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)))
    seen = seen.withColumn("domain", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")))
    soft = _softmax(F.transform("score", lambda s: s * F.lit(temper)))
    seen = seen.withColumn("soft", F.when(F.col("letters"), soft).otherwise(F.array(*[F.lit(0.0)] * n)))

    def sums(by: list[str], name: str) -> DataFrame:
        held = seen.filter(F.col(by[0]).isNotNull()) if by else seen
        held = held.groupBy(*by).agg(*[F.sum(F.get("soft", F.lit(i))).alias(f"_{i}") for i in range(n)])
        return held.select(*[F.col(c).alias(f"{name}_{c}") for c in by], F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(n)]).alias(name))

    everywhere = F.array(*[F.lit(float(x)) for x in sums([], "n_all").first()["n_all"]])  # a number for each language
    out = seen
    for by in ("host", "domain", "suffix", "declared"):
        out = out.join(written(sums([by], f"n_{by}")), F.col(by) == F.col(f"n_{by}_{by}"), "left")
    none = F.array(*[F.lit(0.0)] * n)

    def less_own(c: str) -> Column:
        return F.zip_with(F.coalesce(c, none), "soft", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(counts: Column, prior: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, prior, lambda c, p: (c + p * F.lit(strength)) / (total + F.lit(strength)))

    whole = smoothed(everywhere, F.array(*[F.lit(1.0 / n)] * n))
    prior = smoothed(less_own("n_host"), smoothed(less_own("n_domain"), whole))

    others = F.zip_with(everywhere, F.col("soft"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    every = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)

    def given(c: str) -> Column:
        """P(value | language) in all other rows, smoothed towards the value's share of them."""
        held = less_own(c)
        share = F.greatest(F.aggregate(held, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.lit(1e-9), every), F.lit(1e-9))
        table = F.zip_with(held, others, lambda a, b: (a + share * F.lit(strength)) / (b + F.lit(strength)))
        return F.transform(table, lambda p: F.log(F.greatest(p, F.lit(1e-12))))

    total = F.when(F.col("letters"), F.transform("score", lambda s: s * F.lit(temper))).otherwise(none)
    for part in (F.transform(prior, lambda p: F.log(F.greatest(p, F.lit(1e-12)))), F.when(F.col("declared").isNotNull(), given("n_declared")).otherwise(none), F.when(F.col("suffix").isNotNull(), given("n_suffix")).otherwise(none)):
        total = F.zip_with(total, part, lambda a, b: a + b)
    out = out.withColumn("post", _softmax(total))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("post")
    alone = F.when(F.col("letters"), F.get(names, F.array_position("score", F.array_max("score")).cast("int") - 1)).otherwise(F.lit(UNKNOWN))
    return out.select("id", F.get(names, F.array_position("post", best).cast("int") - 1).alias("language"), best.alias("confidence"), alone.alias("text_language"), "declared", "suffix", "host")


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    parts = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(parts, lambda p: p / total)


def document_evidence(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows for ``identify`` from documents: ``lang`` is the declared language, ``source`` the host."""
    return docs.select(F.col(key).alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def known(language: Column, confidence: Column, least: float = 0.5) -> Column:
    return (language != UNKNOWN) & (confidence >= least)


def keep_known(docs: DataFrame, model: TextModel, least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (``text, lang, source``) whose language is known with a posterior of ``least`` or more.

    Rows with the same id stay or go together: they go only if all of them are rejected.
    """
    found = identify(document_evidence(docs, key), model).filter(known(F.col("language"), F.col("confidence"), least)).select(F.col("id").alias("_id")).distinct()
    return docs.join(found.hint("shuffle_hash"), docs[key].eqNullSafe(found["_id"]), "left_semi")
