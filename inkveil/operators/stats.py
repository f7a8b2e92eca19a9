"""Aggregates over scored rows: means, intervals, tests, frontiers, linkage, bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as C
from ..functions.ship import ship
from .classify import running
from .score import METRICS


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; there is none among Spark's functions.  For few rows."""
    return x.map(lambda v: math.erfc(v) if v is not None and v == v else None)


def means(scored: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def breakdown(scored: DataFrame, policy: str = "policy", kind: str = "artifact_kind", metrics: list[str] = METRICS) -> DataFrame:
    """Means for each policy over all rows (kind null, level "overall") and for each kind, in one
    pass with grouping sets."""
    view = scored.select(F.col(policy).alias("policy"), F.col(kind).alias("kind"), *metrics)
    out = view.groupingSets([[F.col("policy")], [F.col("policy"), F.col("kind")]], F.col("policy"), F.col("kind")).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], F.grouping("kind").alias("g"))
    return out.select("policy", "kind", F.when(F.col("g") == 1, "overall").otherwise("by_kind").alias("level"), "n", *metrics)


# ---------------------------------------------------------------- bootstrap


def _poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) draws from uniform ones."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, u, "right").astype(np.float64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def bootstrap(rows: DataFrame, metrics: list[str], replicates: int = 2000, seed: int = 42, alpha: float = 0.05, linear: bool = False) -> DataFrame:
    """(metric, mean, ci_lower, ci_upper) by resampling with replacement.

    Each replicate weighs each row by a Poisson(1) draw from a hash of seed, replicate and row, so
    there is no join and no row moves: a task adds up the weights and weighted values of all
    replicates, and what is shuffled is one partial sum a replicate and task.  (Weights in place of
    n draws from n rows agree for large n; a replicate's mean divides by its own weight.)  Nulls
    count in neither.  Bounds are elements of the sorted means, at int(R alpha / 2) and
    int(R (1 - alpha / 2)), or linear percentiles.
    """
    ship(rows.sparkSession)
    key = F.xxhash64(*[F.col(c) for c in rows.columns], F.monotonically_increasing_id())
    m, names = len(metrics), ["replicate", *[f"w{i}" for i in range(len(metrics))], *[f"s{i}" for i in range(len(metrics))]]

    def add(batches):
        weight, total = np.zeros((replicates, m)), np.zeros((replicates, m))
        draw = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            values = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(m)], 1)
            there = ~np.isnan(values)
            values = np.where(there, values, 0.0)
            for a in range(0, len(keys), 256):
                w = _poisson((_mixed(keys[a : a + 256, None] ^ draw[None, :]) >> np.uint64(11)) / float(1 << 53))
                weight += w.T @ there[a : a + 256]
                total += w.T @ values[a : a + 256]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(weight[:, i]) for i in range(m)), *(pa.array(total[:, i]) for i in range(m))], names)

    sums = rows.select(key.alias("key"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(metrics)]).mapInArrow(add, "replicate int, " + ", ".join(f"{n} double" for n in names[1:]))
    drawn = sums.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names[1:]])
    per = drawn.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.when(F.col(f"w{i}") > 0, F.col(f"s{i}") / F.col(f"w{i}")).alias("v")) for i, c in enumerate(metrics)])).alias("x")).select("x.metric", "x.v").where("v is not null")
    mean = rows.agg(*[F.avg(c).alias(c) for c in metrics]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("mean")) for c in metrics])).alias("x")).select("x.metric", "x.mean")
    return mean.join(_bounds(per, replicates, alpha, linear), "metric")


def _bounds(per: DataFrame, replicates: int, alpha: float, linear: bool) -> DataFrame:
    """(metric, ci_lower, ci_upper) of (metric, v), one number a replicate."""
    if linear:
        return per.groupBy("metric").agg(F.percentile("v", alpha / 2).alias("ci_lower"), F.percentile("v", 1 - alpha / 2).alias("ci_upper"))
    lo, hi = max(0, int(replicates * alpha / 2)), min(replicates - 1, int(replicates * (1 - alpha / 2)))
    ordered = per.groupBy("metric").agg(F.sort_array(F.collect_list("v")).alias("v"))
    last = F.size("v") - 1
    return ordered.select("metric", F.get("v", F.least(F.lit(lo), last)).alias("ci_lower"), F.get("v", F.least(F.lit(hi), last)).alias("ci_upper"))


def classification_bootstrap(df: DataFrame, label: str = "label", pred: str = "pred", score: str = "score", replicates: int = 1000, seed: int = 42, alpha: float = 0.05, digits: int = 4) -> DataFrame:
    """(metric, mean, ci_lo, ci_hi, n): accuracy, macro and sensitive F1, mcc, AUROC and PR-AUC over
    resamples, means and linear percentiles of the n replicates that have both classes.

    Rows alike in label, prediction and score (a probability, taken to ``digits`` decimals) are one
    cell, and a replicate weighs a cell of c rows by a Poisson(c) draw.  There are at most
    4 (10 ** digits + 1) cells, whatever the input; they are broadcast and replicates dealt out.
    """
    spark = df.sparkSession
    ship(spark)
    cells = df.where(F.col(label).isNotNull()).groupBy(F.round(F.col(score).cast("double"), digits).alias("s"), (F.col(label) == 1).alias("y"), (F.col(pred) == 1).alias("p")).agg(F.count("*").alias("c")).orderBy(F.desc("s"), "y", "p").toPandas()
    held = spark.sparkContext.broadcast((cells["s"].to_numpy(float), cells["y"].to_numpy(bool), cells["p"].to_numpy(bool), cells["c"].to_numpy(float)))
    names = ["accuracy", "f1_macro", "f1_sensitive", "mcc", "auroc", "pr_auc"]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.column(0).to_pylist():
                s, y, p, c = held.value
                found = weighted_metrics(s, y, p, np.random.default_rng([seed, r]).poisson(c).astype(float))
                out += [(n, v) for n, v in zip(names, found, strict=True)] if found else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["metric", "v"])

    per = spark.range(replicates).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "metric string, v double")
    return per.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", alpha / 2).alias("ci_lo"), F.percentile("v", 1 - alpha / 2).alias("ci_hi"), F.count("*").alias("n"))


def weighted_metrics(score: np.ndarray, label: np.ndarray, pred: np.ndarray, weight: np.ndarray) -> list[float] | None:
    """accuracy, macro F1, F1, mcc, AUROC and PR-AUC of weighted rows in falling order of score; None
    if there is one class only."""
    pos, neg = weight * label, weight * ~label
    p, n = pos.sum(), neg.sum()
    if not p or not n:
        return None
    tp, fp = pos[pred].sum(), neg[pred].sum()
    fn, tn = p - tp, n - fp
    ratio = lambda a, b: float(a / b) if b else 0.0
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    mcc = ratio(tp * tn - fp * fn, math.sqrt((tp + fp) * p) * math.sqrt((tn + fn) * n))
    last = np.append(score[1:] != score[:-1], True)  # ties share a threshold
    up, down = np.cumsum(pos)[last], np.cumsum(neg)[last]
    step_up, step_down = np.diff(up, prepend=0), np.diff(down, prepend=0)
    auroc = float((step_down * (up - step_up / 2)).sum() / (p * n))
    seen = up + down > 0
    pr_auc = float((step_up[seen] * up[seen] / (up + down)[seen]).sum() / p)
    return [ratio(tp + tn, p + n), (f1 + f0) / 2, f1, mcc, auroc, pr_auc]


# ---------------------------------------------------------------- tests


def two_proportion_z(df: DataFrame, x1: str = "x1", n1: str = "n1", x2: str = "x2", n2: str = "n2") -> DataFrame:
    """Adds p1, p2, z_stat, p_value, significant_at_05; pooled standard error, rounded to 6 and 4
    digits; without rows or spread z is 0 and p is 1."""
    a, b, n, m = (F.col(c).cast("double") for c in (x1, x2, n1, n2))
    empty = (n == 0) | (m == 0)
    p1, p2 = F.when(empty, 0.0).otherwise(F.try_divide(a, n)), F.when(empty, 0.0).otherwise(F.try_divide(b, m))
    pool = F.try_divide(a + b, n + m)
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))
    none = empty | F.coalesce(se == 0, F.lit(True))
    df = df.withColumn("__p1", p1).withColumn("__p2", p2).withColumn("__none", none).withColumn("__z", F.when(none, 0.0).otherwise((p1 - p2) / se))
    df = df.withColumn("__p", erfc(F.abs("__z") / math.sqrt(2)))
    out = {
        "p1": F.when(F.col("__none"), F.col("__p1")).otherwise(F.round("__p1", 6)),
        "p2": F.when(F.col("__none"), F.col("__p2")).otherwise(F.round("__p2", 6)),
        "z_stat": F.round("__z", 4),
        "p_value": F.when(F.col("__none"), 1.0).otherwise(F.round("__p", 6)),
        "significant_at_05": ~F.col("__none") & (F.col("__p") < 0.05),
    }
    return df.withColumns(out).drop("__p1", "__p2", "__none", "__z", "__p")


def mcnemar(a: DataFrame, b: DataFrame, key: str, metric: str, threshold: float = 0.5, p_value: bool = True) -> DataFrame:
    """Paired test with continuity correction: rows of a and b meet on ``key``."""
    both = a.select(key, F.col(metric).alias("__a")).join(b.select(key, F.col(metric).alias("__b")), key)
    wins = (F.col("__a") > threshold) & (F.col("__b") <= threshold)
    losses = (F.col("__a") <= threshold) & (F.col("__b") > threshold)
    out = both.agg(F.count_if(wins).alias("a_wins"), F.count_if(losses).alias("b_wins"), F.count_if(~wins & ~losses).alias("ties"))
    n = F.col("a_wins") + F.col("b_wins")
    out = out.withColumn("chi2", F.when(n == 0, 0.0).otherwise(F.pow(F.abs(F.col("a_wins") - F.col("b_wins")) - 1.0, 2) / n))
    return out.withColumn("p_value", F.when(n == 0, 1.0).otherwise(erfc(F.sqrt(F.col("chi2") / 2)))) if p_value else out


def wilcoxon(pairs: DataFrame, diff: str = "diff", least: int = 5) -> DataFrame:
    """One-sided signed-rank test that differences are above 0: (n, w_plus, p_value).

    Zeros go, ties share their mean rank.  The ranks come from counts by absolute value, so only
    one row for each distinct difference is ordered.  p is exact for up to 25 pairs without ties,
    else normal with tie correction; it is null below ``least`` pairs.
    """
    d = pairs.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).select(F.abs(diff).cast("double").alias("v"), (F.col(diff) > 0).cast("long").alias("up"))
    by = running(d.groupBy("v").agg(F.count("*").alias("c"), F.sum("up").alias("up")), "v", {"c": "so_far"})
    ranked = by.select("c", "up", (F.col("so_far") - F.col("c") + (F.col("c") + 1) / 2.0).alias("rank"))
    out = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.pow("c", 3) - F.col("c")), F.lit(0.0)).alias("__t"))

    @F.pandas_udf(T.DoubleType())
    def p(n: pd.Series, w: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(int(a), float(b), float(c)) if a >= least else None for a, b, c in zip(n, w, t, strict=True)], dtype="float64")

    return out.withColumn("p_value", p("n", "w_plus", "__t")).drop("__t")


def signed_rank_p(n: int, w: float, ties: float) -> float:
    """P(W+ >= w) under no difference."""
    if n <= 25 and ties == 0 and w == int(w):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return sum(ways[int(w) :]) / 2**n
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 0.5 * math.erfc((w - n * (n + 1) / 4) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 else 1.0


# ---------------------------------------------------------------- frontiers and summaries


MOST_POLICIES = 10_000


def dominance(policies: DataFrame, name: str = "policy", x: str = "privacy_score", y: str = "utility_score") -> DataFrame:
    """(winner, loser): at least as good on both axes and better on one.  One row a policy goes in,
    and no more than MOST_POLICIES: each is held against each."""
    if (n := policies.count()) > MOST_POLICIES:
        raise ValueError(f"{n} policies to hold against one another")
    a, b = policies.alias("a"), policies.alias("b")
    ax, ay, bx, by = F.col(f"a.{x}"), F.col(f"a.{y}"), F.col(f"b.{x}"), F.col(f"b.{y}")
    return a.join(F.broadcast(b), (F.col(f"a.{name}") != F.col(f"b.{name}")) & (ax >= bx) & (ay >= by) & ((ax > bx) | (ay > by))).select(F.col(f"a.{name}").alias("winner"), F.col(f"b.{name}").alias("loser"))


def frontier(policies: DataFrame, name: str = "policy", **axes) -> DataFrame:
    """The policies that none dominates."""
    return policies.join(dominance(policies, name, **axes).select(F.col("loser").alias(name)).distinct(), name, "left_anti")


def pairwise_summary(judged: DataFrame, by: list[str], winner: str = "winner") -> DataFrame:
    """Wins (A), losses (B), ties, their rates, and the win rate among the decided."""
    w = F.upper(F.coalesce(F.col(winner), F.lit("TIE")))
    out = judged.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(w == "A").alias("wins"), F.count_if(w == "B").alias("losses"), F.count_if(~w.isin("A", "B")).alias("ties"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({"win_rate": rate(F.col("wins"), F.col("total")), "loss_rate": rate(F.col("losses"), F.col("total")), "tie_rate": rate(F.col("ties"), F.col("total")), "decisive_win_rate": rate(F.col("wins"), F.col("wins") + F.col("losses"))})


# ---------------------------------------------------------------- linkage and guarantees


def linkage_pairs(results: DataFrame, placeholders: str = "placeholders", by: list[str] | None = None) -> DataFrame:
    """Pairs of documents that share a placeholder, over all pairs.  A placeholder's documents are
    counted, never paired up."""
    by = by or []
    n = results.groupBy(*by).agg(F.count("*").alias("n"))
    shared = results.select(*by, F.explode(F.map_keys(placeholders)).alias("ph")).groupBy(*by, "ph").agg(F.count("*").alias("k"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    dark = F.col("ph").startswith("<SUPPRESSED:")
    linked = shared.groupBy(*by).agg(F.sum(F.when(~dark, pairs).otherwise(0.0)).alias("linked"), F.sum(F.when(dark, pairs).otherwise(0.0)).alias("dark"))
    both = n.join(linked, by, "left") if by else n.crossJoin(linked)  # one row each without groups
    total = F.col("n") * (F.col("n") - 1) / 2
    rate = lambda c: F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), total), F.lit(0.0))
    return both.select(*by, "n", rate("linked").alias("linked_pair_rate"), rate("dark").alias("suppressed_link_rate"))


def linkage_determinism(results: DataFrame, placeholders: str = "placeholders") -> DataFrame:
    """How often a value has one placeholder, and a placeholder one value, over the corpus."""
    pairs = results.select(F.explode(placeholders).alias("ph", "value")).distinct()
    values = pairs.groupBy("value").agg(F.count("*").alias("k")).agg(F.count("*").alias("unique_values_seen"), F.count_if(F.col("k") > 1).alias("values_with_multiple_placeholders"))
    names = pairs.groupBy("ph").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("placeholders_mapping_multiple_values"))
    rate = 1.0 - F.col("values_with_multiple_placeholders") / F.greatest(F.col("unique_values_seen"), F.lit(1))
    return values.crossJoin(names).withColumn("within_corpus_determinism_rate", rate)  # one row each


def suppress_guarantee(results: DataFrame, out: str = "out_text") -> DataFrame:
    """Adds, for each row, high-risk spans checked, those that occur in the output, and the rate."""
    high = F.filter("spans", lambda s: s["pattern"].isin(*C.HIGH_RISK_REWRITE))
    bad = F.filter(high, lambda s: (s["text"] != "") & F.col(out).contains(s["text"]))
    results = results.withColumn("high_risk_spans_checked", F.size(high)).withColumn("violations", F.size(bad))
    rate = F.coalesce(F.try_divide(F.col("violations"), F.col("high_risk_spans_checked")), F.lit(0.0))
    prefixes = F.transform(bad, lambda s: F.concat(F.substring(s["text"], 1, 8), F.lit("…")))
    return results.withColumns({"violation_rate": rate, "guarantee_holds": F.col("violations") == 0, "violation_prefixes": prefixes})


def information_bounds(rates: DataFrame, exact: str = "exact_match_rate", fmt: str = "format_match_rate") -> DataFrame:
    """-log2(1 - rate) in bits; infinite at rate 1."""
    bits = lambda r: F.when(r >= 1.0, F.lit(float("inf"))).otherwise(-F.log2(1.0 - r))
    return rates.withColumn("i_exact_lower_bound_bits", bits(F.col(exact))).withColumn("i_format_lower_bound_bits", bits(F.col(fmt)))


def space_bits(label: str | None) -> float:
    base, length = C.VALUE_SPACES.get(label, C.DEFAULT_SPACE)
    return length * math.log2(base)


def recovery_bounds(spark: SparkSession) -> DataFrame:
    """(placeholder_type, log2_space, exact_recovery_upper_bound)."""
    return spark.createDataFrame([(t, space_bits(t), 2.0 ** -space_bits(t)) for t in C.VALUE_SPACES], "placeholder_type string, log2_space double, exact_recovery_upper_bound double")


def operator_bounds(spark: SparkSession) -> DataFrame:
    """One row an operator: recovery bounds, disclosure weight, linkage, bits leaked."""
    kinds = math.log2(C.TYPE_VOCABULARY)
    bits = {"SUPPRESS": kinds, "ABSTRACT": kinds + math.log2(10), "SUMMARIZE": 0.0, "CANONICALIZE": kinds + 1.0, "GENERALIZE": math.log2(5)}
    exact = {"default": 2.0 ** -space_bits(None), "million": 2.0 ** -math.log2(10**6), "none": 0.0}
    rows = [(op, exact[e], f, w, det, bits[op]) for op, e, f, w, det in C.OPERATOR_BOUNDS]
    return spark.createDataFrame(rows, "op string, exact_recovery_upper_bound double, format_recovery_upper_bound double, type_disclosure_weight double, linkage_deterministic boolean, bits_leaked double")


def conditioned_bounds(recalls: DataFrame, recall: str = "detector_recall") -> DataFrame:
    """Each operator's bounds given a detector's recall: what escapes detection leaks whole."""
    r = F.col(recall)
    rows = recalls.crossJoin(F.broadcast(operator_bounds(recalls.sparkSession)))  # five operators
    return rows.select("op", r.alias("detector_recall"), F.col("exact_recovery_upper_bound").alias("epsilon_operator"), (r * F.col("exact_recovery_upper_bound") + (1.0 - r)).alias("epsilon_conditioned"), (F.col("bits_leaked") + (1.0 - r) * F.lit(space_bits(None))).alias("bits_leaked_upper_bound"))


# ---------------------------------------------------------------- coverage of detectors


def detector_recall(fixtures: DataFrame, expected: str = "expected_type") -> DataFrame:
    """By expected type: found, total, recall, up to two missed texts.  Needs detected rows."""
    hit = F.exists("spans", lambda s: s["pattern"] == F.col(expected))
    missed = F.slice(F.sort_array(F.collect_list(F.when(~F.col("hit"), F.col("text")))), 1, 2)
    return fixtures.withColumn("hit", hit).groupBy(F.col(expected).alias("expected_type")).agg(F.count_if("hit").alias("detected"), F.count("*").alias("total"), F.avg(F.col("hit").cast("double")).alias("recall"), missed.alias("missed"))


def false_positive_rate(benign: DataFrame) -> DataFrame:
    some = F.size("spans") > 0
    return benign.agg(F.count("*").alias("total"), F.count_if(some).alias("flagged"), F.coalesce(F.avg(some.cast("double")), F.lit(0.0)).alias("false_positive_rate"), F.slice(F.sort_array(F.collect_list(F.when(some, F.col("text")))), 1, 5).alias("examples"))


def coverage_report(fixtures: DataFrame, benign: DataFrame, keys: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row: overall_recall, recall_by_type, weak_types, missed (two a type), false positives (rate
    and five examples), key-aware redaction, kinds and their misses, and what the recall implies.

    ``fixtures``: expected_type, text, spans; ``benign``: text, spans; ``keys``: key, redacted;
    ``kinds``: expected_kind, artifact_kind, text.  Fixtures are small tables by nature.
    """
    by = detector_recall(fixtures)
    recall = by.agg(
        (F.sum("detected") / F.sum("total")).alias("overall_recall"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("expected_type", "recall")))).alias("recall_by_type"),
        F.sort_array(F.collect_list(F.when(F.col("recall") < 1, F.col("expected_type")))).alias("weak_types"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.size("missed") > 0, F.struct("expected_type", "missed"))))).alias("missed"),
    )
    wrong = false_positive_rate(benign).select("false_positive_rate", F.col("examples").alias("false_positive_examples"))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    by_key = keys.agg(share(F.col("redacted")).alias("key_aware_rate"), F.sort_array(F.collect_list(F.when(~F.col("redacted"), F.col("key")))).alias("key_misses"))
    right = F.col("artifact_kind") == F.col("expected_kind")
    by_kind = kinds.agg(share(right).alias("kind_accuracy"), F.sort_array(F.collect_list(F.when(~right, F.struct("expected_kind", "artifact_kind", F.substring("text", 1, 60).alias("text"))))).alias("kind_misses"))
    out = recall.crossJoin(wrong).crossJoin(by_key).crossJoin(by_kind)  # one row each
    return out.withColumn("implication", privacy_implication(F.col("overall_recall")))


def privacy_implication(recall: Column) -> Column:
    """What a detector's recall means: the share of spans that escapes, and the bound it sets."""
    missed = 1.0 - recall
    return F.struct(missed.alias("missed_span_rate"), missed.alias("epsilon_suppress_conditioned"))
