"""Operator 3: language identification.

Features: character n-grams (1 to 3) of the lower-cased text, hashed to BUCKETS columns; term
frequency is the n-gram's share of the text's n-grams, times the inverse document frequency.
Document frequencies cover every training document.  Model: sparse multinomial logistic regression
fitted with FTRL-proximal under L1 and L2 penalties, on a bounded sample of training documents
(about SAMPLE for each language, drawn by a hash of the identifier), four fifths to fit and one
fifth to calibrate: one temperature divides the logits so that the scores' log-loss is least.

Training documents are those with a language, an identifier and crc32(identifier as text) mod 3
other than 1; a prediction sees the text alone.

Prediction is a sum of weights over a text's n-grams, so it is a narrow map over whole texts: one
table of BUCKETS x languages weights is broadcast.

Cases: null texts and texts without a letter give `und` with score 0; without any training document
everything is `und`; null languages are not learned; ties go to the first language by name; rows
that repeat are treated alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, stage, text_buffers

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Sampled training documents for each language (the expected number; a sample twice as large is cut).
SAMPLE = 600
UNKNOWN = "und"
#: ``keep_known``: share of the way from chance to certainty that a score must have gone.
LEAST = 0.2
#: Bytes of texts, or characters of one longer text, whose n-grams are held at once.
SLICE = 1 << 18
#: Features are multiplied by it, so that FTRL's steps suit shares of an n-gram among thousands.
SCALE = 30.0
#: Unicode's category L: neither digits and numerals in any form nor marks.
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, n-grams of each text); a text's n-grams lie together."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(code)
    stop = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(n)
    out = np.zeros((n, len(ORDERS)), np.uint16)
    ok = np.zeros((n, len(ORDERS)), bool)
    h = np.zeros(n, np.uint64)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            nxt = np.zeros(n, np.uint64)
            nxt[: n - k if k < n else 0] = code[k:]
            h = (h ^ (nxt + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if k + 1 in ORDERS:
                j = ORDERS.index(k + 1)
                out[:, j] = (h * np.uint64(0xBF58476D1CE4E5B9)) >> shift
                ok[:, j] = place + k < stop
    per_char = ok.sum(axis=1)
    ends = np.concatenate([[0], np.cumsum(per_char)])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return out[ok], np.diff(ends[edges])


def slices(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of one text of any length, those of SLICE characters at once."""
    text, reach = text.lower(), max(ORDERS) - 1
    for a in range(0, len(text), SLICE):
        b = a + SLICE
        buckets, _ = grams([text[a : b + reach]])
        yield buckets[: len(buckets) - len(grams([text[b : b + reach]])[0])]  # what begins at b or later comes last


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, inverse document frequency and temperature included
    bias: np.ndarray

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias, (len(counts), 1)).astype(np.float64)
        some = np.flatnonzero(counts)
        if len(some):
            first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            out[some] += np.add.reduceat(self.weights[buckets], first, axis=0, dtype=np.float64) / counts[some, None]
        return out

    def read(self, texts: list[str]) -> np.ndarray:
        """The logits of a chunk: texts of at most SLICE bytes together, or one text."""
        if len(texts) != 1:
            return self.logits(*grams(texts))
        total, n = np.zeros(len(self.bias)), 0
        for buckets in slices(texts[0]):
            total += self.weights[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return (self.bias + total / max(n, 1))[None]


def statistics(training: DataFrame) -> tuple[int, np.ndarray, list[tuple[str, int, np.ndarray, np.ndarray]]]:
    """(documents, document frequency of each bucket, sample), in one pass over all training texts.

    A task sends at most BUCKETS sums, and the driver gets BUCKETS sums and the sample.
    """
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    total = sum(sizes.values())
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, SAMPLE / n))) for k, n in sorted(sizes.items())], F.lit(0.0)) if sizes else F.lit(0.0)
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(11).cast("long")), 11) / float(1 << 53)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12).cast("long")), F.lit(5)).cast("int")

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            offsets, _ = text_buffers(batch.column(0))
            texts = [t or "" for t in batch.column(0).to_pylist()]
            lang, taken, part = (batch.column(i).to_pylist() for i in (1, 2, 3))

            def row(r, own, n):
                return pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([lang[r]], pa.string()), pa.array([part[r]], pa.int32()), pa.array([own.tolist()], pa.list_(pa.int32())), pa.array([n.tolist()], pa.list_(pa.int32()))], names)

            for i, j in chunks(offsets, SLICE):
                if j - i == 1:
                    n = sum((np.bincount(b, minlength=BUCKETS) for b in slices(texts[i])), np.zeros(BUCKETS, np.int64))
                    own = np.flatnonzero(n)
                    total[own] += 1
                    if taken[i]:
                        yield row(i, own, n[own])
                    continue
                buckets, counts = grams(texts[i:j])
                owner = np.repeat(np.arange(j - i), counts)
                for a in range(0, j - i, 32):  # a dense block of rows marks what occurs in each
                    lo, hi = np.searchsorted(owner, [a, a + 32])
                    seen = np.zeros((32, BUCKETS), bool)
                    seen[owner[lo:hi] - a, buckets[lo:hi]] = True
                    total += seen.sum(axis=0)
                ends = np.cumsum(counts)
                for r in range(i, j):
                    if taken[r]:
                        own, n = np.unique(buckets[ends[r - i] - counts[r - i] : ends[r - i]], return_counts=True)
                        yield row(r, own, n)
        used = np.flatnonzero(total)
        none = [pa.nulls(len(used), t) for t in (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used]), *none], names)

    names = ["bucket", "df", "lang", "fold", "own", "counts"]
    found = stage(training.select("text", "lang", (draw < share).alias("taken"), fold.alias("fold")).mapInArrow(lean(count), "bucket int, df long, lang string, fold int, own array<int>, counts array<int>"), "language-statistics")
    df = np.zeros(BUCKETS, np.int64)
    for r in found.where("bucket is not null").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]
    sample: dict[str, list] = {}
    for r in found.where("lang is not null").select("lang", "fold", "own", "counts").collect():
        sample.setdefault(r["lang"], []).append((r["lang"], r["fold"], r["own"], r["counts"]))
    return total, df, [(k, f, np.array(o, np.int64), np.array(c, np.int64)) for lang in sorted(sample) for k, f, o, c in sorted(sample[lang])[: 2 * SAMPLE]]


def ftrl(sample, idf: np.ndarray, languages: list[str], alpha=0.3, beta=1.0, l1=0.003, l2=0.1, epochs=3, seed=5):
    """FTRL-proximal: per coordinate step sizes; L1 keeps weights at exactly 0, L2 shrinks the rest."""
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(rows):
        zz, nn = z[rows], n[rows]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(sample)):
            lang, _, own, counts = sample[i]
            rows = np.append(own, BUCKETS)  # the last coordinate is the bias
            x = np.append(counts / max(1, counts.sum()) * idf[own], 1.0)
            w = weights(rows)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[languages.index(lang)] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log-loss, by golden section on its logarithm.

    The rule of succession holds for the labels: of n texts, one more than seen is taken to be of any
    language, so that a sample without errors gives no certainty beyond its size.
    """
    doubt = 1 / (len(labels) + 2)

    def loss(t):
        s = logits / np.exp(t)
        top = s.max(axis=1)
        right = (1 - doubt) * s[np.arange(len(s)), labels] + doubt * s.mean(axis=1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - right))

    low, high, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame) -> Model | None:
    key = F.col("doc_id").cast("long")
    training = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(key)).select(key.alias("doc_id"), "text", "lang")
    total, df, sample = statistics(training)
    languages = sorted({s[0] for s in sample})
    if not languages:
        return None
    idf = SCALE * (np.log((1 + total) / (1 + df)) + 1)
    fit = [s for s in sample if s[1]] or sample
    weights, bias = ftrl(fit, idf, languages)
    check = [s for s in sample if not s[1]] or sample
    logits = np.array([(c / max(1, c.sum()) * idf[o]) @ weights[o] + bias for _, _, o, c in check])
    t = temperature(logits, np.array([languages.index(s[0]) for s in check]))
    return Model(languages, (weights * idf[:, None] / t).astype(np.float32), bias / t)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            lang, score = [], []
            offsets, _ = text_buffers(batch.column(1))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(offsets, SLICE):
                some = [bool(_LETTER.search(t)) for t in texts[i:j]]
                if model is None:
                    lang += [UNKNOWN] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                s = model.read(texts[i:j])
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                lang += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some, strict=True)]
                score += [x if ok else 0.0 for x, ok in zip(p.max(axis=1).tolist(), some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on ``docs`` and applied to all of them."""
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def least_score(languages: int, least: float = LEAST) -> float:
    """The score from which on a language is no guess: ``least`` of the way from chance, which of k
    languages scores 1 / k, to 1.  With one language there is nothing to guess."""
    return 1 / languages + least * (1 - 1 / languages)


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``least_score``, columns as they
    were; trained on ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        held = model.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            offsets, _ = text_buffers(column)
            texts, ok = [t or "" for t in column.to_pylist()], []
            for i, j in chunks(offsets, SLICE):
                if held is None:
                    ok += [False] * (j - i)
                    continue
                s = held.read(texts[i:j])
                top = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                ok += [bool(_LETTER.search(t)) and p >= least_score(len(held.languages), least) for t, p in zip(texts[i:j], top.tolist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
