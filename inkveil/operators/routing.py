"""Routing: the artifact kind of a text, and the rewriting operators for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.ship import ship
from ..functions.text import col, count_matches, lines, once
from .batch import prepared
from .detect import is_frame, pattern_counts


def _any(spans: Column, family: str) -> Column:
    names = [p.name for p in C.PATTERNS if p.family == family]
    return F.exists(spans, lambda s: s["pattern"].isin(*names))


def metadata(text: Column, spans: Column) -> Column:
    """Hits are counted with repetitions."""
    every = lines(text)
    return F.struct(
        F.size(F.filter(every, is_frame)).alias("frame_hits"),
        count_matches(text, C.EXCEPTION).alias("exception_hits"),
        count_matches(text, C.CONFIG_KEY).alias("config_key_hits"),
        F.size(every).alias("n_lines"),
        F.size(spans).alias("total_spans"),
        pattern_counts(spans).alias("pattern_counts"),
    )


def kind(meta: Column, spans: Column) -> Column:
    """Stack traces first; then more than one family; then the one family there is."""
    stack = _any(spans, "stack") | (meta["frame_hits"] >= 2) | ((meta["exception_hits"] >= 1) & (meta["n_lines"] >= 3))
    network, credential, path, identifier = (_any(spans, f) for f in ("network", "credential", "path", "identifier"))
    keys = meta["config_key_hits"] >= 3
    families = sum((x.cast("int") for x in (stack, network, credential, path, identifier, keys)), F.lit(0))
    return (
        F.when(stack, "stack_trace")
        .when(families >= 2, "mixed_artifact")
        .when(network, "network_artifact")
        .when(keys, F.when(credential, "secret_blob").otherwise("config_blob"))
        .when(credential, "secret_blob")
        .when(identifier, "identifier_blob")
        .when(path, "filesystem_trace")
        .when(F.size(spans) == 0, "clean_text")
        .otherwise("mixed_artifact")
    )


def prepare(df: DataFrame, text: str = "text") -> DataFrame:
    """``detect`` and ``classify`` in one pass: adds spans, metadata and artifact_kind."""
    ship(df.sparkSession)
    own = df.columns
    return df.withColumn("__prepared", once(prepared(col(text)))).select(*own, "__prepared.*")


def classify(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds artifact_kind and metadata to a detected frame."""
    df = df.withColumn("metadata", once(metadata(F.coalesce(col(text), F.lit("")), col(spans))))
    return df.withColumn("artifact_kind", once(kind(F.col("metadata"), col(spans))))


def table(policy: str = "routed") -> list[tuple[str, list[str]]]:
    """(kind, operators) of a policy."""
    uniform = {"abstract_only": ["ABSTRACT"], "suppress_only": ["SUPPRESS"]}
    return [(k, own if policy not in uniform or not own else uniform[policy]) for k, own in C.ROUTES.items()]


def routes(spark: SparkSession, policy: str = "routed") -> DataFrame:
    """(artifact_kind, ops): the operators of each kind under a policy, eight rows.

    ``routed`` is the full table; ``abstract_only`` and ``suppress_only`` use one operator for all
    kinds but clean text.
    """
    return spark.createDataFrame(table(policy), "artifact_kind string, ops array<string>")


def ops(policy: str = "routed") -> Column:
    """The operators of artifact_kind under a policy; unknown kinds go as mixed ones."""
    names = lambda x: F.array(*[F.lit(o) for o in x]).cast("array<string>")
    by_kind = F.create_map(*[x for k, o in table(policy) for x in (F.lit(k), names(o))])
    return F.coalesce(F.try_element_at(by_kind, F.col("artifact_kind")), names(C.ROUTES["mixed_artifact"]))


def route(df: DataFrame, policy: str = "routed") -> DataFrame:
    """Adds ``ops``."""
    return df.withColumn("ops", ops(policy))


def operator_specs(spark: SparkSession) -> DataFrame:
    rows = [(op, *spec) for op, spec in C.OPERATORS.items()]
    return spark.createDataFrame(rows, "op string, preserves array<string>, removes array<string>, privacy_level string")
