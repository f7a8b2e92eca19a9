"""Operator 5: token counts of a byte-level BPE by rank-synchronous array merging.

Pre-tokens that a worker has not met are held as ragged numpy arrays: all symbols in a row, with
the sequence each belongs to.  Every round finds each sequence's lowest rank with one segmented
minimum, merges every occurrence of that pair in that sequence at once (left to right where they
overlap), and drops the sequences that have nothing left to merge.  What is left of a sequence when
it is dropped is its number of tokens.  A merged symbol's own pairs always rank after the merge
that made it, so merging all occurrences together equals merging them one by one.

A text is cut into units of white space and what follows it; no pre-token reaches from a non-space
into white space, so a text's count is the sum over its units, whose counts the worker remembers.

Cases: null text counts as empty (no tokens); a special string in a text is one token, as the
library's default has it; any length of text or word; identifiers are passed through, nulls and
repetitions included; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's caches; a full cache is emptied, which changes no result.
CACHE = 500_000
#: Bytes of new pre-tokens merged at once.
BATCH_BYTES = 1 << 20
NONE = np.int64(1) << 40
#: Bytes from which on a pre-token is merged by itself, in time that grows with its length.
LONG = 2048

#: White space as the library's patterns have it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OTHER = SPACE.replace("[", "[^")
_UNITS = regex.compile(f"{SPACE}*{OTHER}+|{SPACE}+")
#: The pattern of byte-level pre-tokenizers (a vocabulary that asks for another is refused).
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{SPACE})[^\p{{L}}\p{{N}}])+|{SPACE}+(?!{OTHER})|{SPACE}+")


def byte_symbols() -> list[str]:
    """How byte-level vocabularies write each byte: itself if it shows, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class MergeTable:
    """Pair of symbols -> (rank, merged symbol), as an open-addressing table in numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("not a byte-level vocabulary with the pre-tokenizer's usual pattern and nothing put in front")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ids = model["vocab"]
        self.start = np.array([ids[s] for s in byte_symbols()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        keys = (left << 20) | right
        self.left, self.right = left, right
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # a place's first claimant stays, the others move on
            free = self.keys[at[todo]] == -1
            claim = todo[free]
            places, first = np.unique(at[claim], return_index=True)
            self.keys[places], self.ranks[places] = keys[claim[first]], claim[first]
            todo = todo[self.ranks[at[todo]] != todo]
            at[todo] = (at[todo] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            at[todo] = (at[todo] + 1) % len(self.keys)
        return out


def count_symbols(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """Symbols that survive all merges, for each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = lengths.copy()
    symbols = table.start[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    last = np.ones(len(symbols), bool)
    last[:-1] = owner[1:] != owner[:-1]
    ranks = np.full(len(symbols), NONE, np.int64)
    inner = np.flatnonzero(~last)
    ranks[inner] = table.rank(symbols[inner], symbols[inner + 1])
    ready = np.zeros(len(words), bool)
    for w in np.flatnonzero(lengths > LONG).tolist():  # one sequence's many rounds would hold up the others
        out[w] = count_long(table, words[w])
        ready[w] = True
    if ready.any():
        live = ~ready[owner]
        symbols, owner, ranks = symbols[live], owner[live], ranks[live]
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(ranks, first)
        sizes = np.diff(np.append(first, len(symbols)))
        done = least == NONE
        if done.any():
            out[owner[first[done]]] = sizes[done]
            live = np.repeat(~done, sizes)
            symbols, owner, ranks = symbols[live], owner[live], ranks[live]
            least, sizes = least[~done], sizes[~done]
            if not len(symbols):
                break
        hit = ranks == np.repeat(least, sizes)
        at = np.flatnonzero(hit)
        # in a run of neighbouring hits (a pair of equal symbols) every other one merges
        begins = np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbols[at] = table.merged[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
        now = place[at]
        touched = np.unique(np.concatenate([now, now[now > 0] - 1]))
        ranks[touched] = NONE
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[owner[touched] == owner[touched + 1]]
        ranks[touched] = table.rank(symbols[touched], symbols[touched + 1])
    return out


def count_long(table: MergeTable, word: bytes) -> int:
    """The same for one long sequence, whose rounds touch only the places of their pair: symbols are
    linked, and places are kept by the rank of the pair that begins there.  A rank is complete when
    its turn comes, as new pairs always rank after the merge that made them."""
    symbols = table.start[np.frombuffer(word, np.uint8)].copy()
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    left, places, queue = n, {}, []

    def add(at: np.ndarray) -> None:
        at = at[(at >= 0) & (after[np.maximum(at, 0)] < n)]
        ranks = table.rank(symbols[at], symbols[after[at]])
        at, ranks = at[ranks < NONE], ranks[ranks < NONE]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        new, first = np.unique(ranks, return_index=True)
        for r, some in zip(new.tolist(), np.split(at, first[1:]), strict=True):
            if r not in places:
                places[r] = []
                heapq.heappush(queue, r)
            places[r].append(some)

    add(np.arange(n))
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[(symbols[at] == table.left[r]) & (after[at] < n)]
        at = at[symbols[after[at]] == table.right[r]]
        # in a run of neighbouring pairs (of equal symbols) every other one merges
        linked = np.zeros(len(at), bool)
        linked[1:] = after[at[:-1]] == at[1:]
        run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        symbols[at], symbols[gone] = table.merged[r], -1
        after[at] = after[gone]
        follow = after[at]
        before[follow[follow < n]] = at[follow < n]
        left -= len(at)
        add(np.unique(np.concatenate([at, before[at]])))
    return left


class Counter:
    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.units: dict[str, int] = {}
        self.pre: dict[str, int] = {}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None

    def _learn(self, fresh: list[str]) -> None:
        parts = [_PRE.findall(u) for u in fresh]
        new = list({p for ps in parts for p in ps if p not in self.pre})
        i = 0
        while i < len(new):
            j, held = i, 0
            while j < len(new) and (j == i or held < BATCH_BYTES):
                held += len(new[j])
                j += 1
            words = [w.encode() for w in new[i:j]]
            self.pre.update(zip(new[i:j], count_symbols(self.table, words).tolist(), strict=True))
            i = j
        pre = self.pre
        self.units.update((u, sum(pre[p] for p in ps)) for u, ps in zip(fresh, parts, strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.units) > CACHE:
            self.units.clear()
        if len(self.pre) > CACHE:
            self.pre.clear()
        special, cut = [0] * len(texts), []
        for i, text in enumerate(texts):
            if self.cut and any(x in text for x in self.table.special):
                special[i] = len(self.cut.findall(text))
                cut.append([u for part in self.cut.split(text) for u in _UNITS.findall(part)])
            else:
                cut.append(_UNITS.findall(text))
        fresh = {u for units in cut for u in units}.difference(self.units)
        if fresh:
            self._learn(sorted(fresh))
        get = self.units.__getitem__
        return [s + sum(map(get, units)) for s, units in zip(special, cut, strict=True)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; no shuffle."""
    from .common import chunks, text_buffers

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            offsets, _ = text_buffers(batch.column(1))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [x for i, j in chunks(offsets) for x in own.counts(texts[i:j])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
