"""Sources and sinks: manifests, prompt files, datasets, shards, reports, resumable outputs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<index: bigint, prompt_text: string, artifact_kind: string>"
MANIFEST = f"name string, selected_count bigint, artifact_counts map<string, bigint>, records array<{RECORD}>"
PROMPTS = "dataset string, unique_prompts array<string>"
DATASET = "prompt_text string, label int, strat_key string"
EXTERNAL = "prompt_text string, sensitive boolean"
ANNOTATIONS = "index bigint, prompt_text string, category string, is_sensitive boolean"
ANSWER = "struct<primary_issue: string, likely_cause: string, next_action: string>"
ATTEMPT = "struct<placeholder: string, placeholder_type: string, original_value: string, reconstructed_value: string, confidence: string, exact_match: boolean, format_match: boolean, category_match: boolean>"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One JSON document a file (or an array of rows), or one a line, under an explicit schema.  Files
    of lines can be split among tasks; a document over many lines is read by one."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(position, index, prompt_text, artifact_kind, name, selected_count), one row a record; kinds
    default to "unknown"."""
    rows = read_json(spark, path, MANIFEST, lines).select("name", "selected_count", F.posexplode("records").alias("position", "r"))
    return rows.select("position", "r.index", "r.prompt_text", F.coalesce("r.artifact_kind", F.lit("unknown")).alias("artifact_kind"), "name", "selected_count")


def read_prompts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(dataset, prompt_index, prompt_text); prompts count from 0."""
    return read_json(spark, path, PROMPTS, lines).select(F.coalesce("dataset", F.lit("unknown")).alias("dataset"), F.posexplode("unique_prompts").alias("prompt_index", "prompt_text"))


def read_dataset(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return read_json(spark, path, DATASET, lines)


def read_external(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(prompt_text, label); rows without a label go."""
    return labelled(read_json(spark, path, EXTERNAL, lines))


def labelled(df: DataFrame, flag: str = "sensitive") -> DataFrame:
    return df.where(F.col(flag).isNotNull()).withColumn("label", F.col(flag).cast("int")).drop(flag)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, ANNOTATIONS)


def shard(manifest: DataFrame, start: int = 0, end: int | None = None, limit: int | None = None, position: str = "position") -> DataFrame:
    """Rows at positions start <= p < end, then the first ``limit`` of those."""
    p = F.col(position)
    stops = [x for x in (end, start + limit if limit is not None else None) if x is not None]
    return manifest.where((p >= start) & (p < min(stops)) if stops else p >= start)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; one of our own
    only where that is absent and all runs in one process."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        sc.setCheckpointDir(d)
    return d


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Replaces what ``path`` holds.  The new result is written beside it and takes its place by
    renaming, so a failed write leaves the old one; between the two renames the path is absent."""
    spark, mark = df.sparkSession, uuid.uuid4().hex[:12]
    new, old = (f"{path.rstrip('/')}.{mark}-{x}" for x in ("new", "old"))
    df.write.format(fmt).save(new)
    fs, p = _files(spark, path)
    if fs.exists(p):
        fs.rename(p, _files(spark, old)[1])
    if not fs.rename(_files(spark, new)[1], p):
        raise OSError(f"{new} could not be renamed to {path}")
    fs.delete(_files(spark, old)[1], True)


def remaining(todo: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resume(todo: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "index", guard: str | None = None, every: int | None = None) -> DataFrame:
    """Run ``work`` on the rows that ``path`` doesn't hold, about ``every`` rows at a time (all at once
    if None), and append each part's results; returns all.

    A part is done when its marks (key and part) are written under ``path``/done: rows without
    output have marks too and are not done again, and output of a part that failed before its marks
    is not read.  ``guard`` is a hash of the manifest: results of another manifest are an error.
    """
    spark = todo.sparkSession
    rows, marks = f"{path}/rows", f"{path}/done"
    if exists(spark, marks):
        done = spark.read.parquet(marks)
        if guard is not None and done.where(~F.col("manifest_hash").eqNullSafe(F.lit(guard))).limit(1).count():
            raise ValueError("results are of another manifest")
        todo = remaining(todo, done, key)
    left = todo.count()
    parts = 0 if not left and exists(spark, marks) else max(1, -(-left // every)) if every else 1
    share = F.pmod(F.xxhash64(key), F.lit(parts))
    run = uuid.uuid4().hex[:12]
    for i in range(parts):
        some, part = todo.where(share == i) if parts > 1 else todo, f"{run}-{i}"
        work(some).withColumn("part", F.lit(part)).write.mode("append").parquet(rows)
        some.select(key, F.lit(part).alias("part"), F.lit(guard).cast("string").alias("manifest_hash")).write.mode("append").parquet(marks)
    whole = spark.read.parquet(marks).select("part").distinct()
    return spark.read.parquet(rows).join(F.broadcast(whole), "part", "left_semi").drop("part")  # one row a part


LOG = "at timestamp, line string"


def log(spark: SparkSession, path: str, line: str) -> None:
    """Appends one line to a log."""
    spark.createDataFrame([(line.rstrip(),)], "line string").select(F.current_timestamp().alias("at"), "line").coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path).orderBy("at", "line")


def _joined(rows: DataFrame, value: Column, position: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v"))))
    return F.array_join(F.transform(ordered, lambda x: x["v"]), ",")


def manifest_hash(manifest: DataFrame, position: str = "position", index: str = "index") -> DataFrame:
    """(manifest_hash): sha256 of the indices as compact JSON in manifest order.  The hash is of one
    string, so the indices (and nothing else) of a manifest meet in one row."""
    return manifest.agg(F.sha2(F.concat(F.lit("["), _joined(manifest, F.col(index).cast("string"), position), F.lit("]")), 256).alias("manifest_hash"))


def stable_hash(manifest: DataFrame, position: str = "position", index: str = "index") -> DataFrame:
    """(stable_hash): sha256 of name, count and indices as JSON with sorted keys; null stays null."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.max("name").alias("n"))), r'(?s)^\{"n":(.*)\}$', 1)
    escape = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    quoted = F.array_join(F.transform(F.split(quoted, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(escape(c))), "")
    body = F.concat(
        F.lit('{"name": '), F.when(F.max("name").isNull(), F.lit("null")).otherwise(quoted), F.lit(', "records": ['),
        F.replace(_joined(manifest, F.col(index).cast("string"), position), F.lit(","), F.lit(", ")),
        F.lit('], "selected_count": '), F.coalesce(F.max("selected_count").cast("string"), F.lit("null")), F.lit("}"),
    )
    return manifest.agg(F.sha2(body, 256).alias("stable_hash"))


def merge_shards(shards: list[DataFrame], key: str = "index") -> DataFrame:
    """All shards' rows by index; repeated rows stay."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.orderBy(key)


def merge_and_summarise(shards: list[DataFrame]) -> dict[str, DataFrame]:
    """The shards' judged rows (index, artifact_kind, baseline, winner) by index, and the summaries of
    all of them by baseline, overall and by kind.  Repeated rows stay and count."""
    from ..operators import stats

    rows = merge_shards(shards)
    return {"rows": rows, "summary": stats.pairwise_summary(rows, ["baseline"]), "by_artifact": stats.pairwise_summary(rows, ["artifact_kind", "baseline"])}


def join_reports(a: DataFrame, b: DataFrame, key: str, columns: list[str], prefixes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two by-kind reports side by side, kinds of either, missing figures 0."""
    left = a.select(key, *[F.col(c).alias(f"{prefixes[0]}_{c}") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"{prefixes[1]}_{c}") for c in columns])
    return left.join(right, key, "full_outer").select(key, *[F.coalesce(f"{p}_{c}", F.lit(0.0)).alias(f"{p}_{c}") for p in prefixes for c in columns])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
