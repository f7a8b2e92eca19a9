"""Operator 2: exact duplicates through a log-structured merge index.

Level 0: each task fills a memtable (digest -> identifiers); a full one is flushed as a run: entries
sorted by digest, and the run's filter.  Within a memtable a hit is compared byte by byte with the
text already there, so a run has one entry for each distinct text.  A run's filter is the sorted set
of its digests' leading bits: some bits name a segment, the next 32 are kept, 4 bytes a digest.

Merge: filters come first.  They alone are shuffled, by segment, and a segment's task returns the
values that more than one run has.  An entry whose value no other run has is final where it is.
Only the others are compacted: of a digest's entries the kept identifier is the smallest, or the
largest for ``keep="max"``.

A group of any size costs one entry a run, so hot groups are reduced before anything is shuffled.
Digests found in several runs are hits: their representatives (one a run) are fetched, through a
Bloom filter over their identifiers, and their bytes are compared.  Should two texts ever share a
digest, they are told apart there and get groups of their own (an entry without any identifier
can't be fetched: its digest decides, and in a clash it is a group of its own).

Cases: null text counts as empty; null identifiers come below all others; if the kept row occurs
more than once, one occurrence is kept; an identifier may repeat with other texts, each text having
its own group; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_ids, free_names, key_filter, lean, may_have, may_hold, split_rows, stage, text_buffers

#: A memtable is flushed at so many bytes of text or identifiers.
MEMTABLE_BYTES, MEMTABLE_IDS = 16 << 20, 50_000

_ENTRY = ["run", "digest", "ids", "best", "n", "size"]
_RUNS = "run string, digest binary, ids array<long>, best long, n long, size long, segment int, filter binary"


def normalise(raw: bytes | None) -> bytes:
    """Lower-cases A-Z only, which is what bytes.lower() does."""
    return (raw or b"").lower()


def segment_bits(rows: int) -> int:
    """Leading bits that name a segment: a segment's share of the rows stays near a million."""
    return min(16, max(6, (rows >> 20).bit_length()))


def filter_values(digests: pa.Array, bits: int) -> np.ndarray:
    """The first ``bits`` + 32 bits of each digest."""
    offsets, data = text_buffers(digests)
    lead = np.zeros((len(digests), 8), np.uint8)
    for k in range(8):
        there = np.diff(offsets) > k
        lead[there, k] = data[offsets[:-1][there] + k]
    return lead.view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits - 32)


def build_runs(docs: DataFrame, keep: str = "min", digest_bytes: int = 32, bits: int = 6) -> DataFrame:
    """Level 0 as a staged table: a row for each distinct text of each run, and a row for each
    segment of a run's filter (those have no digest)."""

    def flush(table: dict):
        run, sign = uuid.uuid4().hex, -1 if keep == "max" else 1
        low = float("-inf")
        rows = sorted(((digest, sorted(ids, key=lambda d: (low if d is None else d) * sign), len(text)) for digest, variants in table.items() for text, ids in variants), key=lambda r: r[0])
        best = [next((d for d in ids if d is not None), None) for _, ids, _ in rows]
        # null identifiers come last, whichever end is kept
        ids = [[d for d in ids if d is not None] + [d for d in ids if d is None] for _, ids, _ in rows]
        digests = pa.array([r[0] for r in rows], pa.binary())
        none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.binary())]
        names = [*_ENTRY, "segment", "filter"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{run}-{i:06d}" for i in range(len(rows))], pa.string()), digests, pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), *none], names
        )
        values = np.unique(filter_values(digests, bits))
        segments, first = np.unique((values >> np.uint64(32)).astype(np.int32), return_index=True)
        parts = [x.astype("<u4").tobytes() for x in np.split(values & np.uint64(0xFFFFFFFF), first[1:])]
        none = [pa.nulls(len(parts), t) for t in (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([run] * len(parts), pa.string()), *none, pa.array(segments), pa.array(parts, pa.binary())], names)

    def fill(batches):
        table, held, n = {}, 0, 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                raw = normalise(raw)
                variants = table.setdefault(hashlib.sha256(raw).digest()[:digest_bytes], [])
                for text, ids in variants:
                    if text == raw:
                        ids.append(doc_id)
                        break
                else:
                    variants.append((raw, [doc_id]))
                    held += len(raw)
                n += 1
                if held >= MEMTABLE_BYTES or n >= MEMTABLE_IDS:
                    yield from flush(table)
                    table, held, n = {}, 0, 0
        if table:
            yield from flush(table)

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(fill), _RUNS), "runs")


def crossing(runs: DataFrame) -> DataFrame:
    """(value): filter values that at least two runs have; staged.  Only filters are shuffled."""

    def meet(batches):
        last, held = None, []

        def found():
            every = np.sort(np.concatenate(held))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            return pa.RecordBatch.from_arrays([pa.array((np.int64(last) << 32) | twice.astype(np.int64))], ["value"])

        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != last:
                    if held:
                        yield found()
                    last, held = segment, []
                held.append(np.frombuffer(raw, "<u4"))
        if held:
            yield found()

    filters = runs.where("filter is not null").select("segment", "filter").repartition("segment").sortWithinPartitions("segment")
    return stage(filters.mapInArrow(lean(meet), "value long"), "crossing")


def fetch(docs: DataFrame, ids: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, digest, size, body) of the documents whose identifiers the filter over ``ids`` does
    not rule out; equal rows of a task are one.  An identifier may have several texts."""
    held = docs.sparkSession.sparkContext.broadcast(key_filter(stage(ids.distinct(), "fetched")))

    def scan(batches):
        seen: set = set()
        for batch in batches:
            batch = batch.filter(pa.array(may_have(held.value, batch.column(0))))
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                body = normalise(raw)
                full = hashlib.sha256(body).digest()
                if (doc_id, full) not in seen:
                    if len(seen) > MEMTABLE_IDS:
                        seen.clear()
                    seen.add((doc_id, full))
                    out.append((doc_id, full[:digest_bytes], len(body), body))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "digest", "size", "body"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(scan), "doc_id long, digest binary, size long, body binary")


def dedup(docs: DataFrame, keep: str = "min", digest_bytes: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row for each row of ``docs``."""
    bits = segment_bits(docs.count())
    runs = build_runs(docs, keep, digest_bytes, bits)
    entries = runs.where("digest is not null").select(*_ENTRY)
    alone, shared = consult(entries, crossing(runs), bits)
    shared = stage(shared, "compacting")

    first = F.max if keep == "max" else F.min
    winner = first(F.struct(F.col("best"), F.col("run"))) if keep == "max" else F.min(F.struct(F.col("best").isNull(), F.col("best"), F.col("run")))
    level1 = stage(shared.groupBy("digest").agg(winner.alias("w"), F.sum("n").alias("group_size"), F.count("*").alias("in_runs")), "compacted")
    groups = level1.select("digest", F.col("w.best").alias("keep_id"), F.col("w.run").alias("winner"), "group_size")
    merged = shared.join(groups, "digest")

    # byte verification of the hits
    reps = stage(shared.join(level1.where("in_runs > 1").select("digest"), "digest", "left_semi").where("best is not null").select("run", "digest", "best", "n", "size"), "representatives")
    texts = fetch(docs, reps.select(F.col("best").alias("doc_id")), digest_bytes)
    of = reps.select(F.col("best").alias("doc_id"), "digest", "size").distinct()
    texts = texts.join(of, ["doc_id", "digest", "size"], "left_semi")
    clash = stage(texts.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low != high").select("digest"), "clashes")
    if not clash.isEmpty():
        variants = texts.join(clash, "digest", "left_semi").select("doc_id", "digest", "size", F.sha2("body", 512).alias("variant")).distinct()
        split = reps.withColumnRenamed("best", "doc_id").join(variants, ["doc_id", "digest", "size"]).withColumnRenamed("doc_id", "best")
        own = split.groupBy("digest", "variant").agg(winner.alias("w"), F.sum("n").alias("group_size")).select("digest", "variant", F.col("w.best").alias("keep_id"), F.col("w.run").alias("winner"), "group_size")
        apart = shared.join(split.select("run", "variant"), "run").join(own, ["digest", "variant"]).drop("variant")
        own_texts = shared.where("best is null").join(clash, "digest", "left_semi").withColumns({"keep_id": F.col("best"), "winner": F.col("run"), "group_size": F.col("n")})
        merged = merged.join(clash, "digest", "left_anti").unionByName(apart).unionByName(own_texts)

    out = alone.withColumns({"keep_id": F.col("best"), "winner": F.col("run"), "group_size": F.col("n")}).unionByName(merged)
    return out.select("digest", "keep_id", "group_size", "run", "winner", F.posexplode("ids").alias("at", "doc_id")).select(
        "doc_id", "keep_id", "group_size", ((F.col("at") == 0) & (F.col("run") == F.col("winner"))).alias("kept"), "digest"
    )


def consult(entries: DataFrame, values: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(entries that only their own run has, entries that other runs may have): narrow scans."""
    held = entries.sparkSession.sparkContext.broadcast(key_filter(values))
    at = entries.columns.index("digest")
    return split_rows(entries, lambda batch: may_hold(held.value, filter_values(batch.column(at), bits)))


def remove(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they were.

    Rows are dropped by identifier; only where an identifier is null or repeats are rows told apart
    by their text.
    """
    decided = stage(dedup(docs, keep), "decisions")
    by_id = decided.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay"))
    odd = stage(by_id.where("doc_id is null or (n > 1 and stay < n)").select("doc_id"), "odd-identifiers")
    out = drop_ids(docs.where("doc_id is not null"), by_id.where("stay < n").select("doc_id"))
    if odd.isEmpty():
        return out
    key = F.col("doc_id").cast("long")
    other, digest = free_names(docs.columns, "other_id", "text_digest")
    some = docs.join(odd.withColumnRenamed("doc_id", other), key.eqNullSafe(F.col(other)), "left_semi")
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = some.withColumn(digest, F.unhex(F.sha2(low.cast("binary"), 256)))
    stay = decided.where("kept").select(F.col("doc_id").alias(other), F.col("digest").alias(f"{digest}_kept")).distinct()
    some = some.join(stay, key.eqNullSafe(F.col(other)) & (F.col(digest) == F.col(f"{digest}_kept")), "left_semi")
    return out.unionByName(some.dropDuplicates(["doc_id", digest]).select(*docs.columns))


class Index:
    """A compacted index that further batches are looked up in: filter, then digest, then bytes."""

    def __init__(self, docs: DataFrame, keep: str = "min"):
        self.docs = docs
        entries = build_runs(docs, keep).where("digest is not null")
        self.level1 = stage(entries.groupBy("digest").agg((F.max if keep == "max" else F.min)("best").alias("keep_id"), F.sum("n").alias("group_size")), "index")
        leading = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
        self.filter = docs.sparkSession.sparkContext.broadcast(key_filter(stage(self.level1.select(leading.alias("value")), "index-filter")))

    def consult(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that the index's filter rules out, others) of (doc_id, digest, body)."""
        held = self.filter
        own = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_digests), "doc_id long, digest binary, body binary")
        return split_rows(own, lambda b: may_hold(held.value, filter_values(b.column(1), 24)))

    def lookup(self, batch: DataFrame) -> DataFrame:
        """(doc_id, keep_id): the indexed document with the same text, or null."""
        new, maybe = self.consult(batch)
        hits = maybe.join(self.level1.select("digest", "keep_id"), "digest", "left")
        kept = fetch(self.docs, hits.where("keep_id is not null").select(F.col("keep_id").alias("doc_id"))).select(F.col("doc_id").alias("keep_id"), "digest", F.col("body").alias("there")).distinct()
        hits = hits.join(kept, ["keep_id", "digest"], "left").select("doc_id", F.when(F.col("body") == F.col("there"), F.col("keep_id")).alias("keep_id"))
        return hits.unionByName(new.select("doc_id", F.lit(None).cast("long").alias("keep_id")))


def _digests(batches):
    for batch in batches:
        text = [normalise(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t).digest() for t in text], pa.binary()), pa.array(text, pa.binary())], ["doc_id", "digest", "body"])
