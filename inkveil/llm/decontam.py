"""Operator 6: benchmark decontamination with suffix arrays over the training text.

Words: lower-cased (A-Z) runs of digits, letters and non-ASCII characters.  A window is 13
consecutive words of a benchmark item; an item of fewer words is one window.

Training side: every task cuts its documents into shards and builds the suffix array of each by
prefix doubling over word numbers: all suffixes, each as far as benchmark words go on that are
neighbours in the benchmark too.  A match cannot reach beyond that, so chains too short for a window
have no place in the array; that leaves out no match.  Words are compared byte by byte with the
benchmark's before their numbers are believed.

Search: a test suffix is the rest of an item from one of its words on.  Those whose first window
occurs in a shard at all are bisected in its suffix array by whole suffixes; their common prefix
with the two neighbours found is the longest verbatim match, and the stretch of the array around
them that shares a window gives all locations.  Each is extended and reported once, from its first
word on.  Nothing is shuffled: a document's matches are complete in its own task.

The benchmark is the stated query set.  One of up to BLOCK_BYTES of text is broadcast.  A larger one
is written to the shared folder in blocks of about that size; a task reads them in turn for every
GROUP_BYTES of documents and holds one at a time.

Cases: null texts have no words; items without words have no windows; of repeated items each has
its matches, and an item_id counts once however often it repeats; repeated documents each have
theirs; a benchmark without rows leaves all documents clean; an empty table gives no rows; further
columns are kept by ``remove`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, lean, mix, new_path, span_hashes, spans_of, text_buffers

WINDOW = 13
BLOCK_BYTES, GROUP_BYTES = 16 << 20, 32 << 20
#: Pairs of a place and a test suffix that are extended at once.
PAIRS = 1 << 18
GATE_BITS = 22

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(offsets: np.ndarray, data: np.ndarray):
    """Lower-cased bytes, word starts, word ends, words before each row."""
    data = LOWER[data]
    return data, *spans_of(_WORD[data], offsets)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a[a_at : a_at + size] equals b[b_at : ...], for spans of at least one byte."""
    if not len(sizes):
        return np.zeros(0, bool)
    k = _within(sizes)
    equal = a[np.repeat(a_at, sizes) + k] == b[np.repeat(b_at, sizes) + k]
    return np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)


def window_keys(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n word numbers from each place on."""
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h ^ ids[at + k].astype(np.uint64))
    return h


def common_prefix(a: np.ndarray, a_at: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_stop: np.ndarray) -> np.ndarray:
    """Equal words from each pair of places on, up to either's stop."""
    most = np.minimum(a_stop - a_at, b_stop - b_at)
    out, live, k = np.zeros(len(a_at), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        live = live[a[a_at[live] + k] == b[b_at[live] + k]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


class Block:
    """Test items ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.item = [i for i, _ in items]
        offsets, data = text_buffers(pa.array([t or "" for _, t in items], pa.string()))
        self.data, starts, ends, before = words_of(offsets, data)
        self.vocabulary, first, ids = np.unique(span_hashes(self.data, starts, ends), return_index=True, return_inverse=True)
        self.starts, self.sizes = starts[first], (ends - starts)[first]
        #: for each word: its number from 1, the item it is of, and where that begins and ends
        self.ids = ids.astype(np.int64) + 1
        sizes = np.diff(before)
        self.of = np.repeat(np.arange(len(items)), sizes)
        self.first, self.stop = np.repeat(before[:-1], sizes), np.repeat(before[1:], sizes)
        place = np.arange(len(ids))
        need = np.minimum(sizes, window)[self.of]
        #: by length of window: sorted keys, and the test suffixes that begin with each
        self.windows = {}
        for n in np.unique(need).tolist():
            at = place[(need == n) & (self.stop - place >= n)]
            keys = window_keys(self.ids, at, n)
            order = np.argsort(keys, kind="stable")
            self.windows[n] = (keys[order], at[order])
        inner = place[place + 1 < self.stop]
        self.pairs = np.unique(self.ids[inner] << 32 | self.ids[inner + 1])
        # the gate is sized by the vocabulary, and only spares exact look-ups
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.gate[(self.vocabulary >> np.uint64(64 - GATE_BITS)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Word hash -> number of the benchmark's word, 0 for none."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.gate[(hashes >> np.uint64(64 - GATE_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes[maybe]
            out[maybe[hit]] = at[hit] + 1
        return out


class Shard:
    """The words of one text buffer, and their suffix array for one block of test items."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.data, self.starts, self.ends, self.before = words_of(offsets, data)
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def chains(self, block: Block, least: int) -> None:
        """Keeps the words of chains of at least ``least``: their numbers, places, and chains' ends."""
        numbers = block.known(self.hashes)
        m = len(numbers)
        if not m:
            self.place = self.ids = self.stop = self.begins = np.zeros(0, np.int64)
            return
        while True:
            joined = np.zeros(m, bool)  # whether the next word goes on
            both = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
            if len(both) and len(block.pairs):
                pair = numbers[both] << 32 | numbers[both + 1]
                at = np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)
                joined[both[block.pairs[at] == pair]] = True
                inner = self.before[(self.before > 0) & (self.before < m)]
                joined[inner - 1] = False  # a document's last word
            end = np.flatnonzero(~joined) + 1
            begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
            some = (numbers[begin] > 0) & (end - begin >= least)
            begin, size = begin[some], (end - begin)[some]
            place = np.repeat(begin, size) + _within(size)
            own = numbers[place] - 1
            right = self.ends[place] - self.starts[place] == block.sizes[own]
            right[right] = same_bytes(self.data, self.starts[place[right]], block.data, block.starts[own[right]], block.sizes[own[right]])
            if right.all():
                break
            numbers[place[~right]] = 0  # another word of the same hash
        self.place, self.ids = place, own + 1
        self.stop = np.repeat(np.cumsum(size), size)
        self.begins = np.repeat(np.cumsum(size) - size, size)

    def sort(self) -> None:
        """The suffix array: ranks by the first 1, 2, 4, ... words until all differ or end."""
        m = len(self.ids)
        here, rank, step = np.arange(m), self.ids, 1
        longest = int((self.stop - here).max()) if m else 0
        while step < longest:
            after = np.where(here + step < self.stop, rank[np.minimum(here + step, m - 1)] + 1, 0)
            _, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
            if int(rank.max()) + 1 == m:
                break
            step *= 2
        self.array = np.argsort(rank, kind="stable")

    def bisect(self, block: Block, test: np.ndarray) -> np.ndarray:
        """How many of the array's suffixes come before each test suffix."""
        low, high = np.zeros(len(test), np.int64), np.full(len(test), len(self.array))
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            p, q = self.array[mid], test[open_]
            n = common_prefix(self.ids, p, self.stop[p], block.ids, q, block.stop[q])
            mine = np.where(p + n < self.stop[p], self.ids[np.minimum(p + n, len(self.ids) - 1)], 0)
            theirs = np.where(q + n < block.stop[q], block.ids[np.minimum(q + n, len(block.ids) - 1)], 0)
            less = mine < theirs
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    def search(self, block: Block) -> np.ndarray:
        """Rows (document, item, first word in document, first word in item, words) of all maximal
        matches that hold a window, in order."""
        out = [np.zeros((0, 5), np.int64)]
        if block.windows:
            self.chains(block, min(block.windows))
            if len(self.ids):
                self.sort()
                for n in block.windows:
                    out += self._matches(block, n)
        found = np.concatenate(out)
        return found[np.lexsort(found.T[::-1])]

    def _matches(self, block: Block, n: int) -> Iterator[np.ndarray]:
        here = np.arange(len(self.ids))
        keys, suffixes = block.windows[n]
        own = np.unique(window_keys(self.ids, here[self.stop - here >= n], n))
        test = suffixes[np.isin(keys, own)]
        if not len(test):
            return
        at = self.bisect(block, test)
        # stretches of the array whose suffixes share n words
        a, b = self.array[:-1], self.array[1:]
        shares = common_prefix(self.ids, a, np.minimum(self.stop[a], a + n), self.ids, b, self.stop[b]) >= n
        stretch = np.concatenate([[0], np.cumsum(~shares)])
        first = np.searchsorted(stretch, np.arange(stretch[-1] + 1), "left")
        last = np.append(first[1:], len(stretch))
        for step in (1, 0):  # the neighbour before, then the one after; of one stretch, if both share a window
            side = at - step
            inside = np.flatnonzero((side >= 0) & (side < len(self.array)))
            p, q = self.array[side[inside]], test[inside]
            hit = inside[common_prefix(self.ids, p, self.stop[p], block.ids, q, block.stop[q]) >= n]
            where = stretch[side[hit]]
            yield from self._locations(block, test[hit], first[where], last[where])
            rest = np.ones(len(test), bool)
            rest[hit] = False
            test, at = test[rest], at[rest]

    def _locations(self, block: Block, test: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
        """The matches of test suffixes with array[low:high], each from its first word on."""
        ends = np.cumsum(high - low)
        i = 0
        while i < len(test):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            sizes = (high - low)[i:j]
            q = np.repeat(test[i:j], sizes)
            p = self.array[np.repeat(low[i:j], sizes) + _within(sizes)]
            longer = (p > self.begins[p]) & (q > block.first[q])
            longer[longer] = self.ids[p[longer] - 1] == block.ids[q[longer] - 1]
            p, q = p[~longer], q[~longer]
            n = common_prefix(self.ids, p, self.stop[p], block.ids, q, block.stop[q])
            word = self.place[p]
            row = np.searchsorted(self.before, word, "right") - 1
            yield np.stack([row, block.of[q], word - self.before[row], q - block.first[q], n], 1)
            i = j


# ---------------------------------------------------------------- documents


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Where the test items are: one broadcast of at most ``block_bytes``, or the files of blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    if size <= block_bytes:
        return [spark.sparkContext.broadcast([tuple(r) for r in items.orderBy("item_id", "text").collect()])]
    path = new_path(spark, "benchmark")
    items.repartition(-(-size // block_bytes), "item_id", "text").write.parquet(path)
    return sorted(spark.read.schema(items.schema).parquet(path).inputFiles())


def load(source, window: int) -> Block:
    if not isinstance(source, str):
        return Block(source.value, window)
    fs, path = pafs.FileSystem.from_uri(source)
    table = pq.read_table(path, filesystem=fs)
    return Block(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), window)


def searched(batches, at: int, sources: list, window: int = WINDOW):
    """(batch, words of each document, matches of each document as (item_id, first word in the
    document, first word in the item, words))."""
    one = load(sources[0], window) if len(sources) == 1 else None

    def search(group):
        words = [np.zeros(b.num_rows, np.int64) for b in group]
        found: list[list[list]] = [[[] for _ in range(b.num_rows)] for b in group]
        for source in sources:
            block = one or load(source, window)
            for k, batch in enumerate(group):
                offsets, data = text_buffers(batch.column(at))
                for i, j in chunks(offsets):
                    shard = Shard(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                    words[k][i:j] = np.diff(shard.before)
                    for row, item, *rest in shard.search(block).tolist():
                        found[k][i + row].append((block.item[item], *rest))
        yield from zip(group, words, found, strict=True)

    group, held = [], 0
    for batch in batches:
        group.append(batch)
        held += batch.column(at).nbytes
        if one or held >= GROUP_BYTES:
            yield from search(group)
            group, held = [], 0
    if group:
        yield from search(group)


MATCHES = "array<struct<item_id: long, doc_word: long, item_word: long, n_words: long>>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, matches: every document with its longest verbatim matches.

    A match has at least ``window`` words, or is a whole shorter item; doc_word and item_word are
    where it begins, counted in words from 0.
    """
    sources = blocks(benchmark, block_bytes)
    fields = ("item_id", "doc_word", "item_word", "n_words")
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))

    def run(batches):
        for batch, words, found in searched(batches, 1, sources, window):
            matches = [[dict(zip(fields, m, strict=True)) for m in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, n_words long, matches {MATCHES}")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, from ``find``'s rows."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["n_words"]).alias("e"))))
    zero = F.lit(0).cast("long")
    hit = F.aggregate(
        spans,
        F.struct(zero.alias("n"), zero.alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["e"]), zero)).alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"],
    )
    items = F.array_sort(F.transform(F.array_distinct(F.transform("matches", lambda m: m["item_id"])), lambda i: i.cast("string")))
    rows = found.select("doc_id", "n_words", F.when(F.size("matches") == 0, zero).otherwise(hit).alias("n_hit"), items.alias("items"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any verbatim match, all their columns as they were.  One hit word
    is enough to go, whatever the document's length."""
    sources, at = blocks(benchmark, block_bytes), docs.columns.index("text")

    def clean(batches):
        for batch, _, found in searched(batches, at, sources):
            yield batch.filter(pa.array([not m for m in found], pa.bool_()))

    return docs.mapInArrow(lean(clean), docs.schema)
