"""Evaluations: policies over a corpus, scored and compared; benchmarks with answers and judges."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd  # here, as the type hints of tagger's function are looked up in the module
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.ship import ship
from ..functions.text import once
from ..operators import attack, batch, detect, rewrite, routing, score, stats

#: A policy takes a detected, classified frame and returns the rows of ``rewrite.transform``.
Policy = Callable[[DataFrame], DataFrame]


def prepare(df: DataFrame, text: str = "text") -> DataFrame:
    """Detected and classified rows."""
    return routing.prepare(df, text)


def handle(df: DataFrame, keep: list[str], policy: str = "routed", kinds: list[str] | None = None, text: str = "text", salt: Column | str = rewrite.DEFAULT_SALT, key_aware: bool = True) -> DataFrame:
    """``prepare``, a routed policy and, if a metric is kept, ``score`` in one call of one Python
    worker: adds the columns ``keep`` of what those add.  Rows of other kinds than ``kinds`` go.
    Where other policies need the spans too, ``prepare`` and ``apply`` are for it."""
    ship(df.sparkSession)
    fields = tuple(dict.fromkeys([*keep, "artifact_kind"]))
    call = batch.handling(dict(routing.table(policy)), fields, None if kinds is None else frozenset(kinds), key_aware)
    out = df.withColumn("__done", once(call(F.col(text), F.lit(salt) if isinstance(salt, str) else salt)))
    if kinds is not None:
        out = out.where(F.col("__done.artifact_kind").isin(*kinds))
    return out.select(*df.columns, *[F.col(f"__done.{f}").alias(f) for f in keep])


class Routed:
    """The policy of ``rewrite.transform`` under a table of routes."""

    def __init__(self, policy: str, text: str, salt: Column | str, key_aware: bool, name: str | None):
        self.policy, self.given, self.name = policy, (text, salt, key_aware), name or policy

    def __call__(self, df: DataFrame) -> DataFrame:
        return rewrite.transform(routing.route(df, self.policy), self.name, *self.given).drop("ops")

    def call(self) -> Column:
        return rewrite.rewriting(routing.ops(self.policy), *self.given)

    def result(self, done: Column) -> Column:
        return F.struct(*rewrite.transformed(done, routing.ops(self.policy), self.name))


def routed(policy: str = "routed", text: str = "text", salt: Column | str = rewrite.DEFAULT_SALT, key_aware: bool = True, name: str | None = None) -> Policy:
    return Routed(policy, text, salt, key_aware, name)


def naive(text: str = "text") -> Policy:
    return lambda df: rewrite.masked(df, text)


def external(name: str, replace: Callable[[DataFrame], DataFrame], text: str = "text") -> Policy:
    """A policy from any function that adds out_text (a named-entity tagger, a language model); a
    null result leaves the text as it was."""

    def run(df: DataFrame) -> DataFrame:
        out = replace(df)
        return out.select(
            *df.columns,
            F.lit(name).alias("policy"),
            F.coalesce("out_text", F.col(text)).alias("out_text"),
            F.create_map().cast("map<string,string>").alias("placeholders"),
            F.array(F.when(F.col("out_text").isNull(), f"{name.upper()}_ERROR").otherwise(name.upper())).alias("operators_applied"),
            F.create_map().cast("map<string,int>").alias("operator_counts"),
            F.lit(0).alias("high_risk_span_count"),
            F.lit(0).alias("high_risk_suppress_count"),
            F.lit(0).alias("high_risk_abstract_count"),
        )

    return run


def language_model(generate: attack.Generate, model: str, text: str = "text") -> Policy:
    """The text as a language model rewrites it; fewer than five characters, or an error, count as
    no answer."""
    system = "Rewrite the text so that it can be shown to strangers. Replace every password, key, token, personal detail, internal address, host and path by a short description in angle brackets; keep everything else, line breaks included, as it is. Answer with the rewritten text only."

    def replace(df: DataFrame) -> DataFrame:
        asked = attack.ask(df, generate, model, system, text)
        return asked.withColumn("out_text", F.when(F.length("answer") >= 5, F.col("answer"))).drop("answer", "error")

    return external("language_model", replace, text)


def tagger(find: Callable[[str], list[tuple[int, int, str]]], name: str = "entity_tagger", text: str = "text", window: int | None = None) -> Policy:
    """A policy from an entity tagger: (start, end, label) of a text's entities become <LABEL>.  The
    tagger gets the whole text, or its first ``window`` characters (100,000 for spaCy)."""

    def replace(df: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            def one(t):
                try:
                    for s, e, label in sorted(find((t or "")[:window]), reverse=True):
                        t = t[:s] + f"<{label}>" + t[e:]
                    return t
                except Exception:  # the row keeps its text
                    return None

            return texts.map(one)

        return df.withColumn("out_text", run(F.col(text)))

    return external(name, replace, text)


#: What a policy adds to a row.
RESULT = ["policy", "out_text", "placeholders", "operators_applied", "operator_counts", "high_risk_span_count", "high_risk_suppress_count", "high_risk_abstract_count"]


def beside(prepared: DataFrame, policies: list[Policy]) -> DataFrame:
    """All policies' results side by side: one row a document, with a struct result_0, result_1 and
    so on.  A policy keeps the rows and columns it is given, so documents are prepared once for all
    of them, and nothing is joined or kept.  Routed policies are called in one projection, and so by
    one Python worker a task."""
    own = prepared.columns
    fused = {i: p for i, p in enumerate(policies) if isinstance(p, Routed)}
    rows = prepared.select(*own, *[once(p.call()).alias(f"__done_{i}") for i, p in fused.items()])
    rows = rows.select(*own, *[p.result(F.col(f"__done_{i}")).alias(f"result_{i}") for i, p in fused.items()])
    for i, p in enumerate(policies):
        if i not in fused:
            rows = p(rows).select(*rows.columns, F.struct(*RESULT).alias(f"result_{i}"))
    return rows


def apply(prepared: DataFrame, policies: list[Policy]) -> DataFrame:
    """All policies' results, one row a document and policy, in one pass over the documents."""
    if len(policies) == 1:
        return policies[0](prepared)
    rows = beside(prepared, policies)
    rows = rows.withColumn("result", F.explode_outer(F.array(*[f"result_{i}" for i in range(len(policies))])))
    return rows.select(*prepared.columns, "result.*")


def ablations(text: str = "text", salt: str = rewrite.DEFAULT_SALT) -> list[Policy]:
    return [
        routed("routed", text, salt),
        naive(text),
        routed("abstract_only", text, salt),
        routed("suppress_only", text, salt),
        routed("routed", text, salt, key_aware=False, name="no_key_aware"),
    ]


_held: list[DataFrame] = []


def _hold(df: DataFrame) -> DataFrame:
    _held.append(df.persist())
    return df


def release() -> None:
    """Let go of the rows that earlier evaluations of this process hold, once their results are
    written."""
    while _held:
        _held.pop().unpersist()


def evaluate(df: DataFrame, policies: list[Policy], text: str = "text", kind: str = "artifact_kind") -> DataFrame:
    """Mean scores by policy, overall and by kind, in one pass over the documents."""
    return stats.breakdown(score.score(apply(prepare(df, text), policies), text), kind=kind)


def report(df: DataFrame, policies: list[Policy], key: str, text: str = "text", replicates: int = 2000, metrics: tuple[str, ...] = ("privacy_score", "utility_score", "pareto_score")) -> dict[str, DataFrame]:
    """The automatic evaluation: breakdown, intervals, paired tests of the first policy against the
    others, frontier.  Scored rows are persisted until ``release``, as each figure is a query of its
    own."""
    scored = _hold(score.score(apply(prepare(df, text), policies), text))
    names = [r[0] for r in scored.select("policy").distinct().orderBy("policy").collect()]
    first = "routed" if "routed" in names else names[0]
    tests = None
    for other in (n for n in names if n != first):
        for m in metrics:
            t = stats.mcnemar(scored.where(F.col("policy") == first), scored.where(F.col("policy") == other), key, m).select(F.lit(other).alias("against"), F.lit(m).alias("metric"), "*")
            tests = t if tests is None else tests.unionByName(t)
    overall = stats.means(scored, ["policy"])
    intervals = None
    for n in names:
        i = stats.bootstrap(scored.where(F.col("policy") == n).select(key, *score.METRICS), score.METRICS, replicates).select(F.lit(n).alias("policy"), "*")
        intervals = i if intervals is None else intervals.unionByName(i)
    return {"breakdown": stats.breakdown(scored), "intervals": intervals, "tests": tests, "frontier": stats.frontier(overall), "dominance": stats.dominance(overall)}


# ---------------------------------------------------------------- reconstruction


_ATTEMPTS = 'Answer with JSON and nothing else: {"attempts": [{"%s, "reconstructed_value": "...", "confidence": "high|medium|low"}]}. Give one entry for each, and "low" where you can only guess.'
TYPED_SYSTEM = "A text had its sensitive values replaced by placeholders such as <EMAIL:1a2b>: the type of the value, then a code that is the same wherever the value was. From the type and all that stands around it, work out what each value most likely was, letter by letter. " + _ATTEMPTS % 'placeholder": "..."'
SUPPRESSED_SYSTEM = "A text had its secrets replaced by marks such as <SUPPRESSED:GITHUB_TOKEN>, which tell a secret's type and nothing else; equal marks may stand for different secrets. Using what such secrets look like and what the text gives away, suggest a value for each mark. " + _ATTEMPTS % 'placeholder": "..."'
BLIND_SYSTEM = "A text had its sensitive values replaced by <REDACTED>, without type or code. Work out from the text around each mark what it most likely was, in the order in which they stand, counting from 1. " + _ATTEMPTS % 'index": 1'


#: The key's name while attempts are scored.
_KEY = "attacked_row"


def _rewritten(results: DataFrame, generate: attack.Generate, model: str, where: Column) -> list[Column]:
    """Attempts at the rewritten rows of a condition: at typed placeholders and at suppressed marks.

    A mark tells a secret's type alone and names nothing, so no placeholder stands for it: its values
    are the high-risk spans of the rows in which those were suppressed.
    """
    prompt = F.concat(F.lit("Text:\n"), F.substring("out_text", 1, 6000))
    dark = F.map_filter("placeholders", lambda k, _: k.startswith("<SUPPRESSED:"))
    typed = F.map_filter("placeholders", lambda k, _: ~k.startswith("<SUPPRESSED:"))
    listed = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("placeholder"), e["value"].alias("original_value"))).cast(attack.TARGETS)
    marks = listed(dark)
    if {"spans", "high_risk_suppress_count"} <= set(results.columns):
        high = F.filter("spans", lambda s: s["pattern"].isin(*C.HIGH_RISK_REWRITE))
        own = F.transform(high, lambda s: F.struct(rewrite.suppress(s["pattern"]).alias("placeholder"), s["text"].alias("original_value"))).cast(attack.TARGETS)
        marks = F.array_distinct(F.concat(marks, F.when(F.col("high_risk_suppress_count") > 0, own).otherwise(F.array().cast(attack.TARGETS))))
    return [attack.attempting(generate, model, system)(F.when(where & (F.size(x) > 0), prompt), x) for system, x in ((TYPED_SYSTEM, listed(typed)), (SUPPRESSED_SYSTEM, marks))]


def _masked(generate: attack.Generate, model: str, where: Column) -> list[Column]:
    """Attempts at the masks of the rows of a condition."""
    prompt = F.concat(F.lit("Text:\n"), F.substring("out_text", 1, 6000), F.lit("\n\nThere are "), F.size("spans").cast("string"), F.lit(" of them."))
    masks = F.transform("spans", lambda s: F.struct(F.lit("<REDACTED>").alias("placeholder"), s["text"].alias("original_value"))).cast(attack.TARGETS)
    return [attack.attempting(generate, model, BLIND_SYSTEM, by_place=True)(F.when(where & (F.size("spans") > 0), prompt), masks)]


def _attempts(results: DataFrame, key: str, made: list[Column]) -> DataFrame:
    rows = results.select(F.col(key).alias(_KEY), *[once(x).alias(f"made_{i}") for i, x in enumerate(made)])
    every = F.flatten(F.filter(F.array(*[f"made_{i}" for i in range(len(made))]), lambda x: x.isNotNull()))
    rows = rows.select(_KEY, F.explode_outer(every).alias("a")).where("a is not null")
    return attack.score_attempts(rows.select(_KEY, "a.*")).withColumnRenamed(_KEY, key)


def reconstruct(results: DataFrame, key: str, generate: attack.Generate, model: str) -> DataFrame:
    """Attempts of a generator at the rewritten rows of one policy, scored: at typed placeholders and,
    with a prompt of their own, at suppressed ones.  Documents whose call fails have no attempts."""
    return _attempts(results, key, _rewritten(results, generate, model, F.lit(True)))


def attempt_any(results: DataFrame, key: str, generate: attack.Generate, model: str) -> DataFrame:
    """Attempts at rows of any policies: blind ones where all that was done is masking, else typed and
    suppressed ones."""
    masked = (F.size("operators_applied") == 1) & (F.coalesce(F.get("operators_applied", F.lit(0)), F.lit("")) == "NAIVE_MASK")
    return _attempts(results, key, _rewritten(results, generate, model, ~masked) + _masked(generate, model, masked))


def reconstruct_blind(results: DataFrame, key: str, generate: attack.Generate, model: str) -> DataFrame:
    return _attempts(results, key, _masked(generate, model, F.lit(True)))


# ---------------------------------------------------------------- coverage of the detector


def coverage(fixtures: DataFrame, benign: DataFrame, keys: DataFrame, kinds: DataFrame) -> DataFrame:
    """``stats.coverage_report`` of this package's own detector, routing and key-aware redaction.

    ``fixtures``: expected_type, text; ``benign``: text; ``keys``: text, key; ``kinds``:
    expected_kind, text.
    """
    canonical = prepare(keys).withColumn("ops", F.array(F.lit("CANONICALIZE")))
    redacted = rewrite.transform(canonical).select("key", F.col("out_text").contains("<SECRET_VALUE:").alias("redacted"))
    return stats.coverage_report(detect.detect(fixtures), detect.detect(benign), redacted, prepare(kinds))


def tagger_coverage(fixtures: DataFrame, find: Callable[[str], list[tuple[int, int, str]]], labels: dict[str, str]) -> DataFrame:
    """``stats.detector_recall`` of an entity tagger: its labels stand for patterns by ``labels``; a
    text that it fails on has no entities."""
    kind = "array<struct<pattern:string>>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [{"pattern": labels[x]} for _, _, x in find(t or "") if x in labels]
            except Exception:  # counted as missed
                return []

        return texts.map(one)

    return stats.detector_recall(fixtures.withColumn("spans", run(F.col("text"))))


# ---------------------------------------------------------------- judged pairs


ANSWER_SYSTEM = 'You help with technical requests, some details of which are hidden. Say what is wrong, why, and what to do next, from what can be seen. Answer with JSON and nothing else: {"primary_issue": "...", "likely_cause": "...", "next_action": "..."}'
JUDGE_SYSTEM = 'Two answers, A and B, were given to a request whose original you see. Which one would help the person more with it? Do not reward length. Answer with JSON and nothing else: {"winner": "A|B|TIE", "reason": "one sentence"}'


def _answering(generate: attack.Generate, model: str):
    return attack.asking(generate, model, ANSWER_SYSTEM, attack.coerce_answer, attack.ANSWER_FIELDS, 3)


def answer(results: DataFrame, generate: attack.Generate, model: str, text: str = "out_text", cut: int = 6000) -> DataFrame:
    """Adds answer (struct) and error, three tries a row."""
    asked = once(_answering(generate, model)(F.substring(text, 1, cut)))
    return results.withColumn("__asked", asked).select(*results.columns, "__asked.answer", "__asked.error")


def judge(pairs: DataFrame, generate: attack.Generate, model: str, original: str = "text", a: str = "answer_a", b: str = "answer_b", cut: int = 3000) -> DataFrame:
    """Adds judgment (struct<winner, reason>) and error; an error is a tie."""
    prompt = F.concat(F.lit("Original:\n"), F.substring(original, 1, cut), F.lit("\n\nA:\n"), F.to_json(a), F.lit("\n\nB:\n"), F.to_json(b))
    asked = once(attack.asking(generate, model, JUDGE_SYSTEM, attack.read_judgment, ["winner", "reason"], 3)(prompt))
    return pairs.withColumn("__asked", asked).select(*pairs.columns, F.col("__asked.answer").alias("judgment"), "__asked.error")


def benchmark(prepared: DataFrame, key: str, policies: list[Policy], generate: attack.Generate, answer_model: str, judge_model: str, first: str = "routed", text: str = "text") -> DataFrame:
    """(key, artifact_kind, baseline, winner, reason): the first policy's answers (A) against each
    other policy's (B), in one pass: a document's answers stand in its row."""
    rows, n = beside(prepared, policies), range(len(policies))
    ask = _answering(generate, answer_model)
    rows = rows.select(key, "artifact_kind", text, *[F.col(f"result_{i}.policy").alias(f"policy_{i}") for i in n], *[once(ask(F.substring(F.col(f"result_{i}.out_text"), 1, 6000))).alias(f"asked_{i}") for i in n])
    answers = F.array(*[F.struct(F.col(f"policy_{i}").alias("policy"), F.col(f"asked_{i}.answer").alias("answer")) for i in n])
    rows = rows.select(key, "artifact_kind", text, answers.alias("answers"))
    own, others = (F.filter("answers", test) for test in (lambda x: x["policy"] == first, lambda x: x["policy"] != first))
    pairs = rows.select(key, "artifact_kind", text, F.get(own, F.lit(0))["answer"].alias("answer_a"), F.explode_outer(others).alias("other")).where("answer_a is not null and other is not null")
    judged = judge(pairs.select(key, "artifact_kind", text, "answer_a", F.col("other.policy").alias("baseline"), F.col("other.answer").alias("answer_b")), generate, judge_model, text)
    return judged.select(key, "artifact_kind", "baseline", F.col("judgment.winner").alias("winner"), F.col("judgment.reason").alias("reason"))


def benchmark_summary(judged: DataFrame) -> DataFrame:
    """By baseline, overall (kind null) and by kind, in one pass: judging is the costly part."""
    level = lambda overall, kind: F.struct(F.lit(overall).alias("overall"), kind.cast("string").alias("artifact_kind"))
    rows = judged.withColumn("__level", F.explode(F.array(level(True, F.lit(None)), level(False, F.col("artifact_kind")))))
    out = stats.pairwise_summary(rows.select("baseline", "winner", F.col("__level.overall").alias("overall"), F.col("__level.artifact_kind").alias("artifact_kind")), ["baseline", "overall", "artifact_kind"])
    return out.select("baseline", *[c for c in out.columns if c not in ("baseline", "overall", "artifact_kind")], "artifact_kind")
