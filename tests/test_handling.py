"""Detection, routing, rewriting and scoring in one call give what the steps give one by one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions import catalog as C
from inkveil.operators import batch, routing, score
from inkveil.plans import corpus as K
from inkveil.plans import evaluation as E
from inkveil.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ONE_CALL = ["suppress_guarantee", "routed_texts", "suppress_secrets", "generalize_paths", "canonicalize_keys", "summarize_traces", "operator_counts", "abstracted_texts", "routed_type_disclosure", "routed_transform"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    rows = [t.format(k=k, n=k % 256, nl="\n", bs="\\", HEX16="0A1B2C3D4E5F6071", HEX32="0a1b2c3d4e5f60710a1b2c3d4e5f6071") for k, t in enumerate(K.TEMPLATES)]
    rows += [t for _, t in (*K.POSITIVES, *K.KIND_FIXTURES)] + [t for t, _ in K.KEY_FIXTURES] + K.BENIGN + [None]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("query", ONE_CALL)
def test_one_worker_a_task(spark, query):
    text = plan(Q.QUERIES[query](spark, SF))
    assert text.count("ArrowEvalPython") == 1 and "prepared(" not in text


@pytest.mark.parametrize(("policy", "aware"), [("routed", True), ("routed", False), ("abstract_only", True), ("suppress_only", True)])
def test_one_call_agrees_with_the_steps(spark, policy, aware):
    steps = score.score(E.routed(policy, salt="s", key_aware=aware)(E.prepare(texts(spark))))
    fields = list(batch.HANDLED)
    shown = lambda df: {r[0]: r[1:] for r in df.select("doc_id", *fields).collect()}
    want = shown(steps)
    assert shown(E.handle(texts(spark), fields, policy, salt="s", key_aware=aware)) == want and len(want) > 80
    some = ["secret_blob", "clean_text"]
    kept = E.handle(texts(spark), ["out_text"], policy, some, salt="s", key_aware=aware)
    assert {r["doc_id"]: r["out_text"] for r in kept.collect()} == {k: v[fields.index("out_text")] for k, v in want.items() if v[fields.index("artifact_kind")] in some}


def test_gates_lose_nothing():
    """Texts with other letters and digits: every pattern tried without gates finds the same."""
    r, pos = random.Random(3), [t for _, t in K.POSITIVES]
    odd = "aA0kKKsſiıİé字٣५ \n:=-_.@/"
    some = ["DE" + "".join(r.choice("012٣५A") for _ in range(r.randrange(12, 20))) for _ in range(200)]
    for _ in range(1000):
        t = list(r.choice(pos))
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice(odd)
        some.append(r.choice(["", "é ", "字", "x "]) + "".join(t))
    gates, found = batch.Gates(some), 0
    for t in some:
        every = sorted((m.start(), m.start() - m.end(), prio, m.end(), name, m[0]) for regex, _, _, _, prio, name in batch._compiled() for m in regex.finditer(t))
        assert batch.find(t, gates) == every
        found += len(every)
    assert found > 300


def test_documents_are_dealt_out_by_their_own_number(spark, monkeypatch):
    """A task's documents are far fewer than its prompts would be, as they are longer."""
    monkeypatch.setattr(K, "TEXTS_A_TASK", 10)
    docs = Q.both_texts(spark, SF).where("doc_id >= 0")
    sizes = [r["n"] for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) >= 200 and max(sizes) <= 2 * 10


def test_kinds_of_spans_are_all_others():
    assert set(Q._SPAN_KINDS) == set(C.ROUTES) - {"stack_trace", "config_blob", "filesystem_trace"} and {k for k, _ in routing.table()} == set(C.ROUTES)
