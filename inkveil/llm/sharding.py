"""Operator 9: shards from a hierarchical weighted hash tree (native: DataFrame functions only).

The tree has regions, racks and shards; a subtree's weight is the sum of its shards'.  A document
descends: among the regions, then among the racks of the region it got, then among that rack's
shards, each child draws -ln(u) / weight with u from a hash of level, child and document, and the
least draw wins.  That is an exponential variable whose rate is the weight, so each level is a
choice in proportion to weight.  Only the children on a document's way are drawn for.

Movement: where a subtree's weight changes, draws change for it alone at its level.  Rows enter a
subtree that grew, or leave one that shrank; among two subtrees that kept their weights no row
moves.  Rows that enter a subtree are dealt out within it by its own weights.

Law ``key``: identifier and number of shards decide; equal texts are thus not held together.  "One
more shard takes rows only into itself" holds where the added shard is a subtree of its own at the
top, as the 25th of ``layout`` is: it opens a region, and other subtrees keep their weights.  A shard
added to a region that has others takes its share into that region, not into itself alone.

Slots number the rows of a shard from 0 without gaps.  Ranking runs within (shard, bucket) and
starts at the running total of the buckets before; a row's bucket mixes its identifier with its
place in the input, so rows without identifier, or with the same, are spread like others.  The
buckets are staged with the rows, so totals and ranks see the same; there are shards x buckets
totals, whatever the input.

Cases: null identifiers hash as the hash's seed, so they share a shard; repeated identifiers share
a shard and get slots of their own; null text has no bytes (size 8); an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LAW = "key"
ROWS_PER_BUCKET = 1 << 20
#: Totals (shards x buckets) that are broadcast; beyond, they are joined by their key.
MOST_TOTALS = 1 << 20


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(n_shards: int, shards_per_rack: int = 4, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards fill a rack, racks a region, in order; a further shard leaves the others in place."""
    weights = weights or {}
    return [Leaf(s // (shards_per_rack * racks_per_region), s // shards_per_rack, s, weights.get(s, 1.0)) for s in range(n_shards)]


def tree(leaves: list[Leaf]) -> list[dict[int, dict[int, float]]]:
    """For each level (regions, racks, shards): parent -> {child: weight}; the root is 0."""
    levels = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for x in leaves:
        if x.weight > 0:
            for level, (parent, child) in enumerate(((0, x.region), (x.region, x.rack), (x.rack, x.shard))):
                levels[level][parent][child] += x.weight
    return levels


def descend(key: Column, level: int, children: dict[int, dict[int, float]], parent: Column) -> Column:
    """The child of ``parent`` with the least draw; u has 53 bits of the hash and is never 0."""
    table = F.create_map(*[x for p, of in sorted(children.items()) for x in (F.lit(p), F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in sorted(of.items())]))])

    def draw(c):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level).cast("long"), c["child"].cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["child"].alias("child"))

    return F.array_min(F.transform(F.element_at(table, parent), draw))["child"]


def assign(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: a region, a rack in it, a shard in that."""
    at = F.lit(0)
    for level, children in enumerate(tree(leaves)):
        at = descend(key, level, children, at)
    return at


def shard(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    if buckets is None:
        rows, buckets = docs.count(), 16
        while buckets * len(leaves) * ROWS_PER_BUCKET < rows:
            buckets *= 2
    key = F.col("doc_id").cast("long")
    placed = docs.select(key.alias("doc_id"), "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        assign(F.col("doc_id"), leaves).alias("shard"),
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket"),
        (assign(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    placed = stage(placed, "placed")
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    if buckets * len(leaves) <= MOST_TOTALS:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + F.col("rank")).alias("slot"), "grown_shard")
    )
