"""Operator 8: near-duplicates by SimHash, with tiled exact comparison.

Fingerprint: texts are lower-cased (A-Z), words are runs of non-space, shingles are w words joined
by a space (a shorter text is one shingle; none at all has fingerprint zero).  XXH64 of every
shingle, repeats included, is computed in numpy over whole batches; a bit of the fingerprint is 1
if it is set in over half of them.

Links: equal fingerprints are one node, named by their smallest identifier, before anything is
compared.  Nodes meet in groups that cannot separate a link:

* ``near_duplicates`` (links: at most r differing bits): such nodes agree on at least one of r + 1
  bit bands, so a group is a band and its value; a group of very many nodes is cut again by bands of
  its other bits, by the same argument.
* ``similar`` (links: fingerprints within SIMILAR_RADIUS bits and shingle sets of a similarity of
  0.8 or more): no bands of 64 bits hold pairs that far apart together, so a group is an equal band
  of minima of the same hashes; the similarity comes from a sketch of 240 minima.

A group's nodes are ordered by population count and cut into tiles; a unit of work is a pair of
tiles, and pairs whose population counts differ by more than the radius are left out.  A unit
compares tile with tile by exclusive-or and bit counts, block by block under the same rule, and
returns a star for each connected part, not its links, so that a dense group costs as many rows as
it has nodes.  A group has at most MOST_TILES tiles, so no node is copied more often than that.

Components: minima over star edges (large-star and small-star in turn) until nothing changes; a
component is named by its smallest identifier.

Cases: null text counts as empty; rows without identifier get a fingerprint and component null;
of rows that repeat an identifier each gets a row back, with the component of its own text; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, drop_ids, lean, mix, spans_of, stage, text_buffers

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Nodes of a tile, tiles of a group, and nodes of the blocks compared at once.
TILE, MOST_TILES, BLOCK = 2048, 64, 256
#: A group of more tiles than this is cut by further bands first.
CUT_AGAIN = 64
#: ``similar``: words of a shingle; least similarity; the sketch's error (two standard deviations of
#: 0.015 at 0.8); bits that fingerprints of similar texts may differ by (10 on average at 0.8, 3 deviation).
WIDE, SIMILARITY, SLACK, SIMILAR_RADIUS = 5, 0.8, 0.03, 16
#: Minima of a sketch, and of a band's key: 10 bands of 3 minima (each over 8 of the sketch's) miss a
#: pair of similarity 0.8 once in 1300.
BINS, BANDS, IN_BAND = 240, 10, 3

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[s : s + n] for each span, all spans in step."""
    m = len(starts)
    if not m:
        return np.zeros(0, np.uint64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    word8 = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    word4 = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    seed = np.uint64(seed)
    lengths = lengths.astype(np.int64)
    at = starts.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        h = np.full(m, seed + _P5, np.uint64)
        long = np.flatnonzero(lengths >= 32)
        if len(long):
            n, p = lengths[long], at[long].copy()
            acc = [np.full(len(long), s, np.uint64) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            stripes = n // 32
            for k in range(int(stripes.max())):
                live = np.flatnonzero(stripes > k) if k else slice(None)
                q = p[live]
                for j in range(4):
                    acc[j][live] = _round(acc[j][live], word8[q + 8 * j])
                p[live] = q + 32
            x = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[long], at[long] = x, p
        h += lengths.astype(np.uint64)
        left = lengths % 32
        for k in range(3):
            live = np.flatnonzero(left >= 8 * (k + 1))
            if not len(live):
                break
            q = at[live]
            h[live] = _rot(h[live] ^ _round(np.zeros(len(live), np.uint64), word8[q]), 27) * _P1 + _P4
            at[live] = q + 8
        left %= 8
        live = np.flatnonzero(left >= 4)
        if len(live):
            q = at[live]
            h[live] = _rot(h[live] ^ (word4[q].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at[live] = q + 4
        left %= 4
        for k in range(3):
            live = np.flatnonzero(left > k)
            if len(live):
                q = at[live]
                h[live] = _rot(h[live] ^ (raw[q].astype(np.uint64) * _P5), 11) * _P1
                at[live] = q + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def batch_shingles(offsets: np.ndarray, data: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have shingles, shingles of each, their hashes row by row) of a text buffer."""
    starts, ends, before = spans_of(~_SPACE[data], offsets)
    words = np.diff(before)
    # words one after the other, a space after each: a shingle is then one run of bytes
    sizes = ends - starts
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(int(place[-1]), 32, np.uint8)
    keep = ~_SPACE[data]
    flat[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = LOWER[data[keep]]
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    rows = np.flatnonzero(shingles)
    count = shingles[rows]
    first = np.cumsum(count) - count
    begin = np.arange(int(count.sum())) + np.repeat(before[rows] - first, count)
    end = begin + np.repeat(np.minimum(words[rows], width), count)
    return rows, count, xxh64(flat, place[begin], place[end] - 1 - place[begin])


def batch_fingerprints(offsets: np.ndarray, data: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """One fingerprint a row of a text buffer."""
    return _majority(len(offsets) - 1, *batch_shingles(offsets, data, width))


def _majority(n: int, rows: np.ndarray, count: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if len(rows):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total = np.add.reduceat(bits, np.cumsum(count) - count, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * total > count[:, None], axis=1).view(">u8").astype(np.uint64).ravel()
    return out


_NONE = np.uint64(2**64 - 1)


def _sketches(n: int, rows: np.ndarray, count: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n x BINS bytes, 0 where no hash fell; n x BANDS keys; which keys there are)."""
    least = np.full(n * BINS, _NONE, np.uint64)
    bins = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    np.minimum.at(least, np.repeat(rows, count) * BINS + bins.astype(np.int64), h)
    least = least.reshape(n, BINS)
    marks = (mix(least) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    marks[least == _NONE] = 0
    minima = least.reshape(n, BANDS * IN_BAND, -1).min(axis=2).reshape(n, BANDS, IN_BAND)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
    for k in range(IN_BAND):
        keys = mix(keys ^ minima[:, :, k])
    return marks, keys, (minima != _NONE).any(axis=2)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp as a signed long of the same bits); no shuffle."""

    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            fps = [batch_fingerprints(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], width) for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps or [np.zeros(0, np.uint64)]).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, fp long")


def sketched(docs: DataFrame, width: int = WIDE) -> DataFrame:
    """(doc_id, fp, mark, sketch, bands): fingerprints with sketches of the same shingles; ``mark``
    is a hash of the sketch.  No shuffle."""

    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                n = j - i
                found = batch_shingles(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], width)
                marks, keys, there = _sketches(n, *found)
                whole = xxh64(marks.ravel(), np.arange(n) * BINS, np.full(n, BINS))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n), pa.array(_majority(n, *found).view(np.int64)), pa.array(whole.view(np.int64)), pa.array([m.tobytes() for m in marks], pa.binary()),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32), pa.array(keys[there].view(np.int64))),
                    ],
                    ["doc_id", "fp", "mark", "sketch", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, fp long, mark long, sketch binary, bands array<long>")


# ---------------------------------------------------------------- links


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Adds links between positions x and y; label[i] is the smallest position i is connected to."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label[:] = nxt


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the shingle sets behind rows of sketches: equal minima among the places where
    either has one, less what bytes agree by chance."""
    some = np.maximum(((a | b) > 0).sum(axis=1), 1)
    same = ((a == b) & (a > 0)).sum(axis=1) / some
    return np.where(some > 1, (same - 1 / 255) / (1 - 1 / 255), same)


def tile_stars(fps: np.ndarray, radius: int, own: np.ndarray | None = None, sketch: np.ndarray | None = None, least: float = 0.0) -> list[tuple[int, int]]:
    """Pairs of positions (member, centre) that connect what the links connect: of all
    fingerprints, or, where ``own`` names two tiles, of those in different ones."""
    pops = np.bitwise_count(fps).astype(np.int64)
    label = np.arange(len(fps))
    sides = [np.flatnonzero(own == k) for k in np.unique(own)] if own is not None else [np.arange(len(fps))] * 2
    if len(sides) < 2:
        return []
    left, right = (s[np.argsort(pops[s], kind="stable")] for s in sides)
    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        low, high = np.searchsorted(pops[right], [pops[a[0]] - radius, pops[a[-1]] + radius + 1])
        for j in range(max(low, i) if own is None else low, high, 4 * BLOCK):
            b = right[j : min(j + 4 * BLOCK, high)]
            x, y = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius)
            x, y = a[x], b[y]
            if sketch is None:
                _unite(label, x, y)
                continue
            for k in range(0, len(x), 8192):
                p, q = x[k : k + 8192], y[k : k + 8192]
                new = label[p] != label[q]
                p, q = p[new], q[new]
                ok = likeness(sketch[p], sketch[q]) >= least
                _unite(label, p[ok], q[ok])
    member = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(member.tolist(), label[member].tolist(), strict=True))


def bands(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 1 bands that cover the bits."""
    n = radius + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _part(x: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _by_bands(rows: DataFrame, value: Column, bits: int, radius: int, k1: Column, k2: Column) -> DataFrame:
    """(node, fp, k1, k2): a row for each band of a value of so many bits, its key joined to k1, k2."""
    n = radius + 1
    keys = [F.struct((k1 * n + k + 1).cast("long").alias("k1"), F.shiftleft(k2, size).bitwiseOR(_part(value, shift, size)).alias("k2")) for k, (shift, size) in enumerate(bands(radius, bits))]
    return rows.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("node", "fp", "k.k1", "k.k2")


def _colliding(light: DataFrame) -> DataFrame:
    """The rows whose group has more than one node, and the group's size; staged."""
    return stage(light.join(light.groupBy("k1", "k2").agg(F.count("*").alias("size")).where("size > 1"), ["k1", "k2"]), "colliding")


def tiled(rows: DataFrame, tile: int, radius: int) -> DataFrame:
    """(k1, k2, t, u, own, node, fp): the units of large groups, each row in those its tile is in.

    A node's place in its group's order is its population count, then a hash.
    """
    pops = rows.groupBy("k1", "k2", F.bit_count("fp").alias("pop"), "size").agg(F.count("*").alias("c"))
    pops = pops.groupBy("k1", "k2", "size").agg(F.sort_array(F.collect_list(F.struct("pop", "c"))).alias("pops"))  # 65 at most
    below = "aggregate(pops, 0L, (a, x) -> a + if(x.pop < {}, x.c, 0L))"
    at = "element_at(filter(transform(pops, (x, i) -> struct(x.pop AS pop, aggregate(slice(pops, 1, i), 0L, (a, y) -> a + y.c) AS before)), x -> x.before <= {}), -1).pop"
    held = stage(pops, "population-counts")
    if held.count() <= 10_000:  # else a join on the group
        held = F.broadcast(held)
    dealt = rows.drop("size").join(held, ["k1", "k2"]).withColumn("pop", F.bit_count("fp"))
    dealt = dealt.withColumn("span", F.greatest(F.lit(tile), F.ceil(F.col("size") / MOST_TILES)).cast("long"))
    rank = F.expr(below.format("pop")) + F.pmod(F.xxhash64("node"), F.expr("element_at(filter(pops, x -> x.pop = pop), 1).c"))
    dealt = dealt.withColumn("own", F.floor(rank / F.col("span")))
    dealt = dealt.withColumn("low", F.expr(at.format("own * span"))).withColumn("high", F.expr(at.format("least((own + 1) * span, size) - 1")))
    others = F.sequence(F.floor(F.expr(below.format(f"low - {radius}")) / F.col("span")), F.floor((F.expr(below.format(f"high + {radius + 1}")) - 1) / F.col("span")))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("k1", "k2", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "own", "node", "fp")


def units(light: DataFrame, radius: int, tile: int = TILE, cut: bool = True) -> DataFrame:
    """(k1, k2, t, u, own, node, fp): all units of the groups of (node, fp, k1, k2)."""
    zero = F.lit(0).cast("long")
    dealt = _colliding(light)
    out = dealt.where(F.col("size") <= tile).select("k1", "k2", zero.alias("t"), zero.alias("u"), zero.alias("own"), "node", "fp")
    large = dealt.where(F.col("size") > tile)
    if large.isEmpty():
        return out
    if cut and not (huge := large.where(F.col("size") > CUT_AGAIN * tile)).isEmpty():
        for k, (shift, size) in enumerate(bands(radius)):  # what is left of the bits once a band is equal
            rest = F.shiftleft(F.shiftrightunsigned("fp", shift + size), shift).bitwiseOR(_part(F.col("fp"), 0, shift)) if shift + size < 64 else _part(F.col("fp"), 0, shift)
            again = _by_bands(huge.where(F.col("k1") == k + 1), rest, 64 - size, radius, F.col("k1"), F.col("k2"))
            out = out.unionByName(units(again, radius, tile, cut=False))
        large = large.where(F.col("size") <= CUT_AGAIN * tile)
    return out.unionByName(tiled(large, tile, radius))


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect what links of at most ``radius`` bits connect.

    ``nodes``: (node, fp), distinct fingerprints.
    """
    zero = F.lit(0).cast("long")
    return _compare(units(_by_bands(nodes, F.col("fp"), 64, radius, zero, zero), radius, tile), radius)


def similar_links(nodes: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect what links of ``similar`` connect.  ``nodes``: (node, fp, sketch,
    bands); a sketch goes only to the units that its node is in."""
    light = nodes.select("node", "fp", F.lit(0).cast("long").alias("k1"), F.explode("bands").alias("k2"))
    dealt = units(light, SIMILAR_RADIUS, tile, cut=False).join(nodes.select("node", "sketch"), "node")
    return _compare(dealt, SIMILAR_RADIUS, similarity - SLACK)


def _compare(dealt: DataFrame, radius: int, least: float | None = None) -> DataFrame:
    own = ["own", "node", "fp", *(["sketch"] if least is not None else [])]

    def compare(batches):
        for (t, u), cols in _groups(batches, 4):
            sketch = cols[3] if least is not None else None
            stars = tile_stars(cols[2].view(np.uint64), radius, cols[0] if t != u else None, sketch, least or 0.0)
            if stars:
                pairs = cols[1][np.array(stars)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])

    keys = ["k1", "k2", "t", "u"]
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*keys, *own).repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(lean(compare), "a long, b long").where("a != b").distinct()


def _groups(batches, n_keys: int):
    """((t, u), further columns) of each run of equal keys; batches come sorted by the keys."""
    held, last = [], None

    def array(column):
        if pa.types.is_integer(column.type):
            return column.to_numpy()
        return text_buffers(column)[1].reshape(-1, BINS)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [array(batch.column(i)) for i in range(batch.num_columns)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[i]) for c in cols[:n_keys])
            if key != last and held:
                yield last[2:], tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            last = key
            held.append(tuple(c[i:j] for c in cols[n_keys:]))
    if held:
        yield last[2:], tuple(np.concatenate(x) for x in zip(*held, strict=True))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node that has an edge.

    Large-star, then small-star, each a grouped minimum and a join; every round's edges are
    staged in the shared folder.  The number of rounds grows with the logarithm of the longest path.
    """
    edges = stage(edges, "edges")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges = stage(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``docs``."""
    fps = stage(fingerprints(docs, width), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    return _named(fps, nodes, components(links(nodes, radius)), ["fp"])


def similar(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDE) -> DataFrame:
    """doc_id, fp, component_id: as ``near_duplicates``, by similarity of the texts' shingle sets."""
    fps = stage(sketched(docs, width), "sketches")
    nodes = stage(fps.groupBy("fp", "mark").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")).where("node is not null"), "nodes")
    return _named(fps, nodes, components(similar_links(nodes, similarity)), ["fp", "mark"])


def _named(fps: DataFrame, nodes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    # by fingerprint: a node's name is an identifier, which other fingerprints may carry as well
    named = nodes.join(found, "node", "left").select(*keys, F.coalesce("component", "node").alias("component_id"))
    return fps.select("doc_id", *keys).join(named, keys, "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def remove(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each component (of ``similar``, unless others are given)
    the document that names it, and rows without identifier; all columns as they were."""
    found = stage(similar(docs) if found is None else found, "components")
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stay")).where("not stay").select("doc_id")
    return drop_ids(docs, gone)
