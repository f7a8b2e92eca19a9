"""Operator 10: document quality by hierarchical empirical Bayes.

Level 0, the document: a logistic regression on counts of the whole text (character classes, word
lengths, repetition), fitted by Newton's method on a bounded, hashed sample of labelled documents.
Levels above: hosts (column ``source``) and paths within a host (host and ``lang``).  A site's mean
document evidence is shrunk toward the level above with the strength that the data show:

    posterior(site) = (sum of evidence + k * prior) / (documents + k),   k = within / between variance

with the variances from grouped moments over all documents (method of moments), the host's prior
being the global mean and the path's prior its host's posterior.  Sparse sites thus stay near the
global prior.  A document's quality exchanges the classifier's prior for its path's:

    logit(quality) = logit(p_doc) + logit(posterior(path)) - logit(global mean)

Sums are grouped aggregates with partial sums, so a host with any share of the rows is one row by
the time it is shuffled; the driver gets a handful of moments.

Cases: null texts count as empty; null hosts and languages are sites of their own; with no labels,
or labels of one kind, evidence is 1/2 everywhere; labels without document, and repeated ones (the
mean counts), do no harm; rows that repeat each count; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, span_hashes, spans_of, stage, text_buffers

#: Labelled documents that the classifier is fitted on (expected number).
SAMPLE = 20_000
KEEP = 0.5
#: Sites (host and path) that are broadcast; more are joined in so many copies each.
MOST_SITES, SALTS = 200_000, 16

_CLASSES = {
    "lower": range(0x61, 0x7B),
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "space": (0x20,),
    "break": (0x0A, 0x0D),
    "stop": (0x2E, 0x2C, 0x3B, 0x3A),
    "bar": (0x7C,),
    "shout": (0x21, 0x3F),
    "sign": (0x23, 0x24, 0x25, 0x26, 0x2A, 0x40, 0x5E, 0x7E, 0x5F, 0x3D, 0x2B),
    "bracket": (0x28, 0x29, 0x3C, 0x3E, 0x5B, 0x5D, 0x7B, 0x7D),
    "high": range(0x80, 0x100),
}
FEATURES = ("log_bytes", *(f"share_{c}" for c in _CLASSES), "word_length", "long_words", "distinct_words", "repeated_lines", "line_length", "caps_words")
_ONE_HOT = np.zeros((256, len(_CLASSES)), np.float32)
for _j, _c in enumerate(_CLASSES.values()):
    _ONE_HOT[list(_c), _j] = 1
_NON_SPACE = np.ones(256, bool)
_NON_SPACE[[32, *range(9, 14)]] = False
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[[10, 13]] = False


def _segment_sum(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[before[1:]] - total[before[:-1]]


def _distinct(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Different hashes within each row."""
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(before) - 1).astype(np.float64)


def batch_features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    out = np.zeros((len(size), len(FEATURES)))
    out[:, 0] = np.log1p(size)
    k = 1 + len(_CLASSES)
    for j in range(len(_CLASSES)):
        out[:, 1 + j] = _segment_sum(_ONE_HOT[data, j], offsets) / some
    starts, ends, before = spans_of(_NON_SPACE[data], offsets)
    words = np.maximum(np.diff(before), 1)
    length = (ends - starts).astype(np.float64)
    out[:, k] = _segment_sum(length, before) / words
    out[:, k + 1] = _segment_sum(length > 14, before) / words
    out[:, k + 2] = _distinct(span_hashes(data, starts, ends), before) / words
    ups = np.concatenate([[0], np.cumsum(_ONE_HOT[data, 1])])
    lows = np.concatenate([[0], np.cumsum(_ONE_HOT[data, 0])])
    out[:, k + 5] = _segment_sum((ups[ends] - ups[starts] > 1) & (lows[ends] == lows[starts]), before) / words
    starts, ends, before = spans_of(_NOT_BREAK[data], offsets)
    lines = np.maximum(np.diff(before), 1)
    out[:, k + 3] = np.where(np.diff(before) > 0, 1 - _distinct(span_hashes(data, starts, ends), before) / lines, 0)
    out[:, k + 4] = np.log1p(_segment_sum((ends - starts).astype(np.float64), before) / lines)
    return out


class Classifier:
    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -12, 12)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Classifier:
    """Newton's method for logistic regression with an L2 penalty on all but the intercept."""
    if len(y) == 0 or y.min() == y.max():
        return Classifier(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([np.ones((len(y), 1)), np.clip((x - mean) / scale, -8, 8)])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w)


def _features_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(0))
            f = [batch_features(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]) for i, j in chunks(offsets, CHUNK_BYTES)]
            f = np.concatenate(f) if f else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(np.arange(0, f.size + 1, len(FEATURES), dtype=np.int32), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), lists], [*columns, "features"])

    own = docs.select(F.col("text"), *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(run, f"{kinds}, features array<double>")


def _with_evidence(rows: DataFrame, model: Classifier) -> DataFrame:
    names = [c for c in rows.columns if c != "features"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "features")

    def run(batches):
        for batch in batches:
            flat = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(model.predict(flat.reshape(-1, len(FEATURES))))], [*names, "p_doc"])

    return rows.mapInArrow(run, f"{kinds}, p_doc double")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, prior: Column) -> float:
    """within / between variance of site means by the method of moments; sites: n, s, q (sum of
    evidence and of its squares).  Large where sites do not differ."""
    r = sites.select("n", "s", "q", prior.alias("m")).agg(
        F.count("*").alias("sites"), F.sum("n").alias("n"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inner"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("outer")
    ).first()
    if not r["sites"] or r["n"] <= r["sites"]:
        return 1e9
    within = r["inner"] / (r["n"] - r["sites"])
    between = (r["outer"] - r["sites"] * within) / r["n"]
    return float(min(1e9, max(1.0, within / between))) if between > 1e-12 and within > 0 else (1e9 if within > 0 else 1.0)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, host, path, p_doc, host_posterior, path_posterior, quality, keep."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    features = stage(_features_of(rows, ["doc_id", "host", "path"]), "quality-features")

    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(21).cast("long")), 11) / float(1 << 53)
    taken = features.join(known.where(draw < min(1.0, sample / max(n, 1))), "doc_id").orderBy("doc_id").select("features", "y").limit(2 * sample).toPandas()
    x = np.array(taken["features"].tolist()).reshape(-1, len(FEATURES))
    model = fit(x, taken["y"].to_numpy(np.float64))

    evidence = _with_evidence(features, model)
    paths = stage(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    top = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (top["s"] / top["n"]) if top["n"] else 0.5
    k = strength(hosts, F.lit(mean))
    hosts = stage(hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_posterior")), "hosts")
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = strength(both, F.col("host_posterior"))
    sites = stage(both.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior")), "sites")
    shift = _logit(F.col("p_doc")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    if sites.count() <= MOST_SITES:
        joined = evidence.join(F.broadcast(sites), same)
    else:  # a site may hold a third of the rows: each of its rows meets one of SALTS copies of it
        salt = F.pmod(F.xxhash64("doc_id", "p_doc"), F.lit(SALTS)).cast("int")
        copies = sites.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = evidence.withColumn("salt", salt).join(copies, same & (F.col("salt") == F.col("copy")))
    quality = 1 / (1 + F.exp(-shift))
    return joined.select("doc_id", "host", "path", "p_doc", "host_posterior", "path_posterior", quality.alias("quality"), (quality >= KEEP).alias("keep"))
