"""Classification: metrics, operating points, splits, weights, text features, pooling."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as C
from ..functions.ship import ship
from ..functions.text import once


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1 of either class, macro f1 and the correlation (mcc)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    f1, f0 = _rate(2 * tp, 2 * tp + fp + fn), _rate(2 * tn, 2 * tn + fn + fp)
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns({
        "n_records": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"),
        "n_sensitive": F.col("tp") + F.col("fn"),
        "accuracy": _rate(tp + tn, tp + fp + tn + fn),
        "precision_sensitive": _rate(tp, tp + fp),
        "recall_sensitive": _rate(tp, tp + fn),
        "precision_other": _rate(tn, tn + fn),
        "recall_other": _rate(tn, tn + fp),
        "f1_sensitive": f1,
        "f1_macro": (f1 + f0) / 2,
        "mcc": _rate(tp * tn - fp * fn, root),
    })


RANGES = 64


def running(rows: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds running totals (column -> name) of rows in the order of a numeric column, ties in one
    step: ``rows`` has each value once.

    Values are cut into ranges at approximate quantiles.  Totals run within a range and start at the
    totals of the ranges before, of which there are RANGES + 1, so no task orders all rows.
    """
    cuts = sorted(set(rows.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    own, totals = "__range", rows.withColumn("__range", part)
    by = totals.groupBy(own).agg(*[F.sum(c).alias(f"__{n}") for c, n in sums.items()])
    before = Window.orderBy(F.desc(own) if descending else F.asc(own)).rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(own, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums.values()])
    within = Window.partitionBy(own).orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = totals.join(F.broadcast(by), own)
    return out.select(*rows.columns, *[(F.sum(c).over(within) + F.col(f"__{n}")).alias(n) for c, n in sums.items()])


def curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg, tp, fp): cumulative counts at each distinct score, from the highest.  Rows
    are counted by score first, and the distinct scores are ordered range by range."""
    by = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running(by, "score", {"pos": "tp", "neg": "fp"}, descending=True)


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(auroc, pr_auc): null if there is one class only.  AUROC counts ties half; PR-AUC is the
    step sum of precision over recall."""
    c = curve(df, label, score)
    sums = c.agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("won"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(F.when(both, F.col("won") / (F.col("p") * F.col("n"))).alias("auroc"), F.when(both, F.col("area") / F.col("p")).alias("pr_auc"))


def operating_points(df: DataFrame, label: str = "label", score: str = "score", floor: float = 0.95, reach: float = 0.90) -> DataFrame:
    """Threshold of the best F1 (the lowest on ties), recall at 95 % precision, precision at 90 %
    recall; null where unattainable."""
    c = curve(df, label, score)
    total = df.agg(F.count_if(F.col(label) == 1).alias("p"))
    points = c.crossJoin(F.broadcast(total)).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _rate(F.col("tp"), F.col("p")).alias("recall"))
    points = points.withColumn("f1", _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    best = F.max(F.struct("f1", (-F.col("score")).alias("s")))
    return points.agg(
        (-best["s"]).alias("best_f1_threshold"),
        best["f1"].alias("best_f1"),
        F.max(F.when(F.col("precision") >= floor, F.col("recall"))).alias("recall_at_95prec"),
        F.max(F.when(F.col("recall") >= reach, F.col("precision"))).alias("prec_at_90recall"),
    )


# ---------------------------------------------------------------- baselines, splits, weights


def majority(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Adds pred: the class of more than half of the training rows, else 0."""
    top = train.agg((F.sum(label) > F.count("*") / 2).cast("int").alias("pred"))
    return test.crossJoin(F.broadcast(top))  # one row


def split(df: DataFrame, key: str, strata: list[str], seed: int = 42, test: float = 0.20, validation: float = 0.125) -> DataFrame:
    """Adds split: exact shares within each stratum, in the order of a hash of the key.

    The test share is rounded up, and the validation share of what is left too.  A row's place
    comes from counts over PREFIXES hash ranges and its place within its range, so no stratum is
    ordered in one task.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("__h", h).withColumn("__r", F.substring("__h", 1, 2))
    counts = rows.groupBy(*strata, "__r").agg(F.count("*").alias("__c"))
    up = Window.partitionBy(*strata).orderBy("__r")
    counts = counts.select(*strata, "__r", (F.sum("__c").over(up) - F.col("__c")).alias("__base"), F.sum("__c").over(Window.partitionBy(*strata)).alias("__n"))
    within = F.row_number().over(Window.partitionBy(*strata, "__r").orderBy("__h", key))
    same = None
    rows = rows.withColumn("__at", within).alias("x")
    counts = counts.alias("y")
    for c in (*strata, "__r"):
        test_eq = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        same = test_eq if same is None else same & test_eq
    out = rows.join(counts, same).select("x.*", "y.__base", "y.__n").withColumn("__at", F.col("__at") + F.col("__base"))
    n_test = F.ceil(F.col("__n") * F.lit(str(test)).cast("decimal(10,4)"))
    n_val = F.ceil((F.col("__n") - n_test) * F.lit(str(validation)).cast("decimal(10,4)"))
    out = out.withColumn("split", F.when(F.col("__at") <= n_test, "test").when(F.col("__at") <= n_test + n_val, "validation").otherwise("train"))
    return out.drop("__h", "__r", "__at", "__base", "__n")


def strat_weights(df: DataFrame, strata: list[str]) -> DataFrame:
    """Adds weight: one over the rows of the stratum.  Strata are counted, then joined back."""
    counts = df.groupBy(*strata).agg((1.0 / F.count("*")).alias("weight"))
    return df.join(counts, strata)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """A sample of about n rows with chances in proportion to their weight: adds copies, the expected
    number rounded down, and one more with the chance of what is left."""
    total = df.agg(F.sum(weight).alias("__total"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / float(1 << 53)
    rate = n * F.col(weight) / F.col("__total")
    whole = F.floor(rate)
    return df.crossJoin(F.broadcast(total)).withColumn("copies", (whole + (u < rate - whole).cast("long"))).drop("__total").where("copies > 0")


def split_distribution(df: DataFrame, strata: list[str]) -> DataFrame:
    return df.groupBy("split", *strata).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text features


def word_terms(text: Column, most: int = 2) -> Column:
    """Lower-cased words of two or more word characters, and runs of two of them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs) if most > 1 else words


def char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams within words padded with a space on either side."""
    words = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    none = F.array().cast("array<string>")

    def grams(w, n):
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.when(F.length(w) == F.lit(least) - 1, F.array(w)).otherwise(none) if n == least else none)

    return F.flatten(F.transform(words, lambda w: F.concat(*[grams(w, n) for n in range(least, most + 1)])))


def tfidf(docs: DataFrame, key: str, terms: Column, max_features: int = 100_000, sublinear: bool = True) -> DataFrame:
    """(key, term, weight): 1 + ln tf, times ln((1 + n) / (1 + df)) + 1, rows scaled to length 1.

    Terms are the ``max_features`` most frequent in the corpus (then by name).
    """
    tf = docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(max_features)
    idf = df.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weight = (1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")) * F.col("idf")
    rows = tf.join(idf, "term").select(key, "term", weight.alias("w"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def logistic_baseline(train: DataFrame, label: str = "label", text: str = "text", kind: str = "word", max_features: int = 100_000, iterations: int = 1000):
    """A fitted Spark ML pipeline on TF-IDF terms, classes weighed evenly; scores with ``transform``."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    rows = with_terms(train, text, kind)
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    weight = F.lit(0.0)
    for k, c in counts.items():
        weight = F.when(F.col(label) == k, n / (len(counts) * c)).otherwise(weight)
    ship(train.sparkSession)
    reg = 1.0 / max(n, 1)
    rows = rows.select("terms", F.col(label).cast("double").alias(label), weight.alias("__w"))
    vocabulary = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=max_features).fit(rows)
    counted = vocabulary.transform(rows).drop("terms").persist()
    try:
        idf = IDF(inputCol="counts", outputCol="weights").fit(counted)
        scale = Normalizer(inputCol="weights", outputCol="features")
        ready = scale.transform(idf.transform(counted))
        if set(counts) == {0, 1}:
            last = descend(ready, label, "__w", len(vocabulary.vocabulary), reg, iterations)
        else:
            last = LogisticRegression(labelCol=label, weightCol="__w", regParam=reg, maxIter=iterations, standardization=False).fit(ready)
    finally:
        counted.unpersist()
    return PipelineModel([vocabulary, idf, scale, last])


#: Rows of a block of ``descend``: a worker holds one block at a time.
BLOCK = 500


def _packed(rows) -> Iterator[tuple]:
    """Blocks (ends, indices, values, labels, weights) of (features, label, weight)."""
    ends, indices, values, y, w = [0], [], [], [], []

    def block():
        return np.array(ends), np.concatenate(indices).astype(np.int32), np.concatenate(values), np.array(y), np.array(w)

    for x, label, weight in rows:
        indices.append(x.indices)
        values.append(x.values)
        ends.append(ends[-1] + len(x.indices))
        y.append(label)
        w.append(weight)
        if len(y) == BLOCK:
            yield block()
            ends, indices, values, y, w = [0], [], [], [], []
    if y:
        yield block()


def _losses(blocks, at: np.ndarray) -> Iterator[tuple[float, float, np.ndarray]]:
    """(weight, loss, gradient) of a task's blocks; the intercept stands last."""
    total, loss, gradient = 0.0, 0.0, np.zeros(len(at))
    for ends, indices, values, y, w in blocks:
        sums = np.concatenate([[0.0], np.cumsum(values * at[indices])])
        z = sums[ends[1:]] - sums[ends[:-1]] + at[-1]
        loss += float(w @ (np.logaddexp(0.0, z) - y * z))
        rest = w * (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y)
        gradient[:-1] += np.bincount(indices, np.repeat(rest, np.diff(ends)) * values, len(at) - 1)
        gradient[-1] += rest.sum()
        total += float(w.sum())
    yield total, loss, gradient


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, iterations: int, history: int = 10) -> tuple[np.ndarray, int]:
    """The minimum of a smooth convex function by L-BFGS, and the iterations it took: until the
    gradient is below 1e-6 or three steps in a row gain less than 1e-9 of the value."""
    (f, g), idle = value(at), 0
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for done in range(iterations):
        if np.linalg.norm(g) <= 1e-6:
            return at, done
        d, factors = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d = d - a * y
            factors.append(a)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(factors), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, low, high = float(g @ d), 0.0, np.inf
        step = 1.0 if steps else min(1.0, 1.0 / np.linalg.norm(g))
        for _ in range(40):  # weak Wolfe conditions, by bisection
            f_next, g_next = value(at + step * d)
            if f_next > f + 1e-4 * step * slope:
                high = step
            elif g_next @ d < 0.9 * slope:
                low = step
            else:
                break
            step = 2 * low if np.isinf(high) else (low + high) / 2
        if f_next > f:  # nothing left to gain at this precision
            return at, done
        steps = [*steps, (step * d, g_next - g)][-history:]
        gain, at, f, g = f - f_next, at + step * d, f_next, g_next
        idle = idle + 1 if gain <= 1e-9 * abs(f) else 0
        if idle == 3 or steps[-1][0] @ steps[-1][1] <= 0:
            return at, done + 1
    return at, iterations


def descend(rows: DataFrame, label: str, weight: str, size: int, reg: float, iterations: int):
    """Spark's logistic regression of labels 0 and 1 on sparse features, without scaling them: the
    same function is minimised, but Spark does so over features divided by their deviation, which
    makes the penalty of rare terms so steep that hundreds of steps are needed.  Rows are packed once
    and stay on the executors, a task a core; a step sends a vector there and one back from each."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import DenseVector

    sc = rows.sparkSession.sparkContext
    blocks = rows.select("features", label, weight).repartition(sc.defaultParallelism).rdd.mapPartitions(_packed).persist(StorageLevel.MEMORY_AND_DISK)

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast(at)
        parts = blocks.mapPartitions(lambda x: _losses(x, sent.value)).collect()
        sent.destroy()
        total = sum(x[0] for x in parts)
        free = np.append(at[:-1], 0.0)
        return sum(x[1] for x in parts) / total + 0.5 * reg * float(free @ free), sum(x[2] for x in parts) / total + reg * free

    try:
        at, _ = minimise(value, np.zeros(size + 1), iterations)
    finally:
        blocks.unpersist()
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"LogisticRegression_{uuid.uuid4().hex[:12]}", _py2java(sc, DenseVector(at[:-1])), float(at[-1]))
    return LogisticRegressionModel(made)


def with_terms(df: DataFrame, text: str = "text", kind: str = "word") -> DataFrame:
    return df.withColumn("terms", word_terms(F.col(text)) if kind == "word" else char_terms(F.col(text)))


# ---------------------------------------------------------------- inference

_INFERRED = T.StructType([T.StructField("pred", T.IntegerType()), T.StructField("score", T.DoubleType())])

#: Logits of a batch of texts, one list of numbers a text.
Predict = Callable[[list[str]], list[list[float]]]


def infer(df: DataFrame, load: Callable[[], Predict], text: str = "text", batch: int = 64) -> DataFrame:
    """Adds pred (the class of the largest logit) and score (the softmax probability of class 1, or of
    the predicted class if there is no class 1).

    ``load`` gives the model, tokenising and truncation included, and is called once a task.  Texts
    come in batches; null texts count as empty.
    """

    @F.arrow_udf(_INFERRED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = None
        for rows in batches:
            predict = predict or load()
            pred, score = [], []
            for i in range(0, len(rows), batch):
                logits = np.asarray(predict([t or "" for t in rows.slice(i, batch).to_pylist()]), dtype=np.float64)
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                p, best = e / e.sum(axis=1, keepdims=True), logits.argmax(axis=1)
                pred += best.tolist()
                score += (p[:, 1] if p.shape[1] > 1 else p[:, 0]).tolist()
            yield pa.StructArray.from_arrays([pa.array(pred, pa.int32()), pa.array(score, pa.float64())], ["pred", "score"])

    ship(df.sparkSession)
    return df.withColumn("__inferred", once(run(F.col(text)))).select(*df.columns, "__inferred.*")


def experiment_report(predicted: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Confusion counts and metrics of each experiment, as one table."""
    return metrics(confusion(predicted, label, by=by))


def collate(intervals: list[tuple[str, DataFrame]], key: str = "experiment_id") -> DataFrame:
    """Intervals (key, metric, mean, ci_lo, ci_hi) of several phases: one row an experiment and phase
    with a map from metric to its interval; experiments without any are left out."""
    out = None
    for phase, rows in intervals:
        by = rows.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("mean", "ci_lo", "ci_hi").alias("ci"))))).alias("bootstrap_ci"))
        by = by.select(F.lit(phase).alias("phase"), key, "bootstrap_ci")
        out = by if out is None else out.unionByName(by)
    return out


def grid_status(spark: SparkSession, finished: DataFrame) -> DataFrame:
    """The grid with each experiment's status: done, "failed (code)" or missing.  ``finished``:
    experiment_id, return_code, accuracy; of repeated runs the best code and figure count."""
    last = finished.groupBy("experiment_id").agg(F.min(F.struct(F.col("return_code").alias("rc"), (-F.coalesce(F.col("accuracy").cast("double"), F.lit(-1.0))).alias("a"), "accuracy")).alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("r.rc") == 0, "done").otherwise(F.concat(F.lit("failed ("), F.col("r.rc").cast("string"), F.lit(")")))
    return experiment_grid(spark).join(last, "experiment_id", "left").select("model_name", "pooling", "experiment_id", status.alias("status"), F.col("r.accuracy").alias("accuracy"))


# ---------------------------------------------------------------- pooling, experiments


def pool(df: DataFrame, how: str, states: str = "states", mask: str = "mask") -> Column:
    """Pooled vector of token states (array of vectors) under a mask: cls, mean or max."""
    s, m = F.col(states), F.col(mask)
    if how == "cls":
        return F.transform(F.element_at(s, 1), lambda x: x.cast("double"))
    live = F.transform(F.filter(F.arrays_zip(s.alias("v"), m.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    width = F.size(F.element_at(s, 1))
    column = lambda i: F.transform(live, lambda v: F.get(v, i).cast("double"))
    if how == "max":
        return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_max(column(i)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(column(i), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(live), F.lit(1)))


def pool_rows(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, dim, mean, max) of vectors stored one a row, grouped by a column."""
    return rows.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean_x"), F.max("x").cast("double").alias("max_x"))


def experiment_grid(spark: SparkSession, done: DataFrame | None = None) -> DataFrame:
    """(model_name, pooling, experiment_id): all encoders by all poolings, without those done."""
    models = spark.createDataFrame([(m,) for m in C.ENCODERS], "model_name string")
    grid = models.crossJoin(spark.createDataFrame([(p,) for p in C.POOLINGS], "pooling string"))  # 18 rows
    grid = grid.withColumn("experiment_id", experiment_id(F.col("model_name"), F.col("pooling")))
    return grid.join(done.select("experiment_id").distinct(), "experiment_id", "left_anti").select("model_name", "pooling", "experiment_id") if done is not None else grid


def experiment_id(model: Column, pooling: Column) -> Column:
    return F.concat(F.replace(model, F.lit("/"), F.lit("_")), F.lit("__"), pooling)


def phase_deltas(first: DataFrame, second: DataFrame, metrics: list[str], key: str = "experiment_id") -> DataFrame:
    """Experiments of both phases, with second minus first; null where either is missing or 0."""
    a = first.select(key, *[F.col(m).alias(f"{m}_1") for m in metrics])
    b = second.select(key, *[F.col(m).alias(f"{m}_2") for m in metrics])
    real = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    return a.join(b, key).withColumns({f"{m}_delta": F.when(real(f"{m}_1") & real(f"{m}_2"), F.col(f"{m}_2") - F.col(f"{m}_1")) for m in metrics})


def deployment_summary(points: DataFrame, keys: list[str], position: str = "position", name: str = "experiment_id") -> DataFrame:
    """(key, experiment, value): the best of each column without nulls and NaN; first in position on ties."""
    long = points.select(F.col(name).alias("experiment_id"), F.col(position).alias("position"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys])).alias("x")).select("experiment_id", "position", "x.key", "x.value")
    best = long.where("value is not null and not isnan(value)").groupBy("key").agg(F.max(F.struct("value", (-F.col("position")).alias("p"), "experiment_id")).alias("b"))
    return best.select("key", F.col("b.experiment_id").alias("experiment_id"), F.col("b.value").alias("value"))


def phase_tradeoff(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """Best of either phase side by side, keys of either kept."""
    a = first.select(key, F.col("value").alias("phase1"))
    b = second.select(key, F.col("value").alias("phase2"))
    return a.join(b, key, "full_outer").withColumn("delta", F.col("phase2") - F.col("phase1"))


def cohen_kappa(a: DataFrame, b: DataFrame, key: str = "index", label: str = "is_sensitive") -> DataFrame:
    """(n, observed, expected, kappa) of two annotators on the rows both have."""
    both = a.select(key, F.col(label).cast("string").alias("x")).join(b.select(key, F.col(label).cast("string").alias("y")), key)
    cells = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    xs = cells.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("a"))
    ys = cells.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("b"))
    chance = xs.join(ys, "v").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    rows = n.crossJoin(chance)  # one row each
    observed, expected = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return rows.select("n", observed.alias("observed"), expected.alias("expected"), F.coalesce(F.try_divide(observed - expected, 1 - expected), F.lit(1.0)).alias("kappa"))
