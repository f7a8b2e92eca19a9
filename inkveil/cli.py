"""Command line: scan, sanitize, evaluate, ablate, attack, judge, merge."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import attack, detect, stats
from .plans import evaluation as E
from .sources import io


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkveil")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "sanitize", "evaluate", "ablate", "attack", "judge"):
        c = sub.add_parser(name)
        c.add_argument("--manifest", required=True)
        c.add_argument("--output", required=True)
        c.add_argument("--start-index", type=int, default=0)
        c.add_argument("--end-index", type=int)
        c.add_argument("--limit", type=int)
        c.add_argument("--salt", default="inkveil")
        if name == "evaluate":
            c.add_argument("--n-bootstrap", type=int, default=2000)
        if name in ("attack", "judge"):
            c.add_argument("--host", default="http://127.0.0.1:11434")
            c.add_argument("--model", required=True)
            c.add_argument("--judge-model")
            c.add_argument("--resume", action="store_true")
            c.add_argument("--checkpoint-every", type=int)
    m = sub.add_parser("merge")
    m.add_argument("--inputs", nargs="+", required=True)
    m.add_argument("--output", required=True)
    return p


def run(spark: SparkSession, argv: list[str], generate: attack.Generate | None = None) -> DataFrame | dict[str, DataFrame]:
    """Runs a command, writes its result as JSON under --output and returns it."""
    a = _parser().parse_args(argv)
    if a.command == "merge":
        parts = [spark.read.parquet(x) for x in a.inputs]
        judged = {"artifact_kind", "baseline", "winner"} <= set(parts[0].columns)
        out = io.merge_and_summarise(parts) if judged else {"rows": io.merge_shards(parts)}
        for name, df in out.items():
            io.write_report(df, f"{a.output}/{name}")
        return out
    rows = io.shard(io.read_manifest(spark, a.manifest), a.start_index, a.end_index, a.limit)
    rows = rows.withColumnRenamed("artifact_kind", "manifest_kind")
    text = "prompt_text"
    if a.command == "scan":
        out = detect.scan(rows, text).where("sensitive")
    elif a.command == "sanitize":
        out = E.routed("routed", text, a.salt)(E.prepare(rows, text)).drop("spans", "metadata")
    elif a.command == "ablate":
        out = E.evaluate(rows, E.ablations(text, a.salt), text, "manifest_kind")
    elif a.command == "evaluate":
        out = E.report(rows, [E.routed("routed", text, a.salt), E.naive(text)], "index", text, a.n_bootstrap)
        for name, df in out.items():
            io.write_report(df, f"{a.output}/{name}")
        return out
    else:
        call = generate or attack.http_generate(a.host)
        if a.command == "attack":
            work = lambda todo: E.reconstruct(E.routed("routed", text, a.salt)(E.prepare(todo, text)), "index", call, a.model)
        else:
            work = lambda todo: E.benchmark(E.prepare(todo, text), "index", [E.routed("routed", text, a.salt), E.naive(text)], call, a.model, a.judge_model or a.model, text=text)
        if a.resume:
            guard = io.manifest_hash(rows).first()[0]
            io.log(spark, f"{a.output}/log", f"{a.command} manifest={a.manifest} resume")
            done = io.resume(rows, f"{a.output}/{a.command}-rows", work, guard=guard, every=a.checkpoint_every)
            io.log(spark, f"{a.output}/log", f"{a.command} rows={done.count()}")
        else:
            done = work(rows)
        out = attack.attempt_rates(done, ["placeholder_type"]) if a.command == "attack" else E.benchmark_summary(done)
    io.write_report(out, f"{a.output}/{a.command}")
    return out


def main() -> None:
    import sys

    run(SparkSession.builder.appName("inkveil").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
