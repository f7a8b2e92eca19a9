"""Operator 4: SentencePiece encoding and decoding over a relational lattice.

Normalised text (a space becomes U+2581, one is put in front) is cut into words before each run of
U+2581, and these again between characters that stand next to one another in no piece: no piece
reaches across such a cut, so words are encoded one by one.

Lattice: words' substrings of at most the longest piece's length are exploded and equi-joined to
the piece table, and the edges found are grouped by word and folded with ``aggregate``:

* ``viterbi``: best[j] = max over edges (i, j) of best[i] + score, then the way back; what unigram
  models mean.
* ``merge``: for BPE models, whose scores are merge ranks.  Adding ranks up (Viterbi) does not give
  a BPE model's pieces, so the fold keeps the set of word-internal boundaries as a bit mask and at
  each step takes the lattice's best edge that spans exactly two of the present symbols (first the
  score, then the leftmost), until none is left.  That equals the library.

The words folded this way are the DICTIONARY most frequent (a bound on what is broadcast).  Other
words are folded in the task that meets them, by the same rule over the same piece table: sending
every rare word to a lattice and its pieces back to every document would shuffle more than the
documents themselves.

Characters without a piece become their UTF-8 bytes' pieces, or the unknown piece if the model has
none.  Decoding joins pieces, puts bytes together and drops the space in front.

Cases: null text counts as empty and has no pieces; words of any length; identifiers and other
columns named in ``keep`` are passed through; an empty table gives no rows; U+2581 in a text
decodes as a space, as in the library.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, lean, stage, text_buffers

SPACE = "▁"
DICTIONARY = 1 << 16
#: Characters of a word that the bit mask holds; longer ones are folded in their task.
MASK = 60
#: Entries of a worker's caches; a full cache is emptied.
CACHE = 100_000


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = [i for i in range(n) if sp.is_byte(i)]
        order = sorted({self.score[i] for i in self.plain}, reverse=True)
        ranks = {s: r for r, s in enumerate(order)}
        self.rank = {self.piece[i]: ranks[self.score[i]] for i in self.plain}
        self.id = {self.piece[i]: i for i in self.plain}
        self.longest = max(len(p) for p in self.id)
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        if any(len(p) > 1 and p[i] != SPACE and p[i + 1] == SPACE for p in self.id for i in range(len(p) - 1)):
            self.words = re.compile(r".+", re.S)
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        shown = {i: self.piece[i].replace(SPACE, " ").encode() for i in self.plain}
        self.raw = [shown.get(i, " ⁇ ".encode() if i == self.unknown else b"") for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])

        sizes = np.array([len(x) for x in self.raw], np.int64)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def cut(self, text: str) -> list[str]:
        """The words of a text, without the U+2581 in front where that is the only one: a text
        whose spaces stand alone is simply split at them."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and "\0" not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] if w[:1] == SPACE and w[1:2] not in ("", SPACE, "\0") else "\0" + w for w in self.words.findall(normalise(text))]

    @staticmethod
    def whole(word: str) -> str:
        """The word as the lattice has it; a leading NUL marks one that is kept as it is."""
        return word[1:] if word[:1] == "\0" else SPACE + word

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of a batch: ``counts`` ids each."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)
        raw = self.flat[place].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)]

    def parts(self, word: str) -> list[str]:
        """A word cut where no piece can reach across."""
        out, start, pairs = [], 0, self.pairs
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def fold(self, word: str) -> list[int]:
        """The ``merge`` fold for one word."""
        symbols = self._short(word) if len(word) <= 64 else self._long(word)
        out: list[int] = []
        for s in symbols:
            i = self.id.get(s)
            out += [i] if i is not None else self.fallback(s)
        return out

    def _short(self, word: str) -> list[str]:
        symbols, rank = list(word), self.rank.get
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _long(self, word: str) -> list[str]:
        """The same with a heap and linked symbols: n log n."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := self.rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n:
                    new = symbols[a] + symbols[b]
                    if (r := self.rank.get(new)) is not None:
                        heapq.heappush(heap, (r, a, new))
        return [s for s in symbols if s is not None]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


# ---------------------------------------------------------------- lattice


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, rank, score): as many rows as the vocabulary, whatever the corpus."""
    m = model(path)
    return spark.createDataFrame([(m.piece[i], i, m.rank[m.piece[i]], float(m.score[i])) for i in m.plain], "piece string, id int, rank int, score double")


def edges(words: DataFrame, path: str) -> DataFrame:
    """(word, edges, joins): for each distinct word its lattice.

    edges: (s, e, ids, score, ends, inner), a character without a piece having its bytes' ids;
    joins: those of more than one character, (rank, s, ends, inner), the best first.  ``ends`` has
    the bits of an edge's two boundaries, ``inner`` those of the boundaries between.
    """
    m = model(path)
    size = F.length("word")
    subs = (
        words.select("word")
        .repartition("word")
        .select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
        .select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(m.longest), size - F.col("s")))).alias("n"))
        .select("word", "s", "n", F.expr("substring(word, s + 1, n)").alias("piece"))
    )
    if m.bytes:
        table = F.array(*[F.lit(i) for i in m.bytes])
        code = F.hex(F.encode("piece", "UTF-8"))
        other = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda i: F.element_at(table, F.conv(code.substr(2 * i + 1, F.lit(2)), 16, 10).cast("int") + 1))
    else:
        other = F.array(F.lit(m.unknown))
    found = subs.join(F.broadcast(piece_table(words.sparkSession, path)), "piece", "left").where("id is not null or n = 1")
    lowest = float(min(m.score[i] for i in m.plain)) - 10.0
    end = F.col("s") + F.col("n")
    rows = found.select(
        "word", "s", "n", end.alias("e"), "rank", F.when(F.col("id").isNull(), other).otherwise(F.array("id")).alias("ids"), F.coalesce("score", F.lit(lowest)).alias("score"),
        _bit(F.col("s")).bitwiseOR(_bit(end)).alias("ends"), (_bit(end) - _bit(F.col("s") + 1)).alias("inner"),
    )
    return rows.groupBy("word").agg(
        F.collect_list(F.struct("s", "e", "ids", "score", "ends", "inner")).alias("edges"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.struct("rank", "s", "ends", "inner")))).alias("joins"),
    )


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def fold_merge(lattice: DataFrame) -> DataFrame:
    """(word, ids) for words of at most MASK characters; see the module's text."""

    def fits(x, mask):
        return mask.bitwiseAND(x["ends"]) == x["ends"]

    def step(mask, _):
        first = F.get(F.filter("joins", lambda x: (F.bit_count(mask.bitwiseAND(x["inner"])) == 1) & fits(x, mask)), 0)
        return mask.bitwiseAND(F.bitwise_not(F.coalesce(first["inner"], F.lit(0).cast("long"))))

    steps = F.slice(F.sequence(F.lit(1), F.length("word")), F.lit(1), F.least(F.size("joins"), F.length("word") - 1))
    folded = lattice.select("word", "edges", F.aggregate(steps, _bit(F.length("word") + 1) - 1, step).alias("mask"))
    chosen = F.filter("edges", lambda x: fits(x, F.col("mask")) & (F.col("mask").bitwiseAND(x["inner"]) == 0))
    return folded.select("word", F.flatten(F.transform(F.sort_array(chosen), lambda x: x["ids"])).alias("ids"))


def fold_viterbi(lattice: DataFrame) -> DataFrame:
    """(word, ids): the path with the largest sum of scores, ties to the piece that begins later."""
    kind = "array<struct<score: double, s: int, ids: array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s"), F.array().cast("array<int>").alias("ids"))).cast(kind)

    def step(best, j):
        into = F.transform(F.filter("edges", lambda x: x["e"] == j), lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["ids"].alias("ids")))
        return F.concat(best, F.array(F.array_max(into)).cast(kind))

    best = lattice.select("word", "edges", F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step).alias("best"))
    back = F.aggregate(
        F.sequence(F.lit(1), F.length("word")),
        F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("ids")),
        lambda a, _: F.when(a["at"] <= 0, a).otherwise(F.struct(F.get("best", a["at"])["s"].alias("at"), F.concat(F.get("best", a["at"])["ids"], a["ids"]).alias("ids"))),
        lambda a: a["ids"],
    )
    return best.select("word", back.alias("ids"))


def encode_words(words: DataFrame, path: str, fold: str = "merge") -> DataFrame:
    """(word, ids) for distinct words of at most MASK characters, by the relational lattice; staged.

    While it runs, hash aggregation may hold a task's words (a bounded dictionary's share) instead
    of falling back to sorting after the first few keys.
    """
    spark, key = words.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(DICTIONARY))
    try:
        lattice = edges(words.where(F.length("word").between(1, MASK)), path)
        return stage(fold_viterbi(lattice) if fold == "viterbi" else fold_merge(lattice), "lattice")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def frequent_words(docs: DataFrame, path: str, limit: int = DICTIONARY) -> DataFrame:
    """(word, n): the most frequent words.  A task counts all its words and sends those that it met
    twice; which words are chosen changes where they are folded, not what they become."""

    def count(batches):
        m = model(path)
        held: Counter = Counter()

        def flush():
            parts: Counter = Counter()
            for w, n in held.items():
                if n > 1:
                    for p in m.parts(m.whole(w)):
                        parts[p] += n
            rows = [(p, n) for p, n in parts.items() if n > 1 and len(p) <= MASK]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            offsets, _ = text_buffers(batch.column(0))
            texts = batch.column(0).to_pylist()
            for i, j in chunks(offsets):
                for t in texts[i:j]:
                    if t:
                        held.update(m.cut(t))
                if len(held) > 2 * CACHE:
                    yield flush()
            pa.default_memory_pool().release_unused()
        yield flush()

    counted = docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(limit)


def dictionary(docs: DataFrame, path: str, limit: int = DICTIONARY) -> dict[str, bytes]:
    """Frequent words and their packed ids, at most ``limit`` of them."""
    words = stage(frequent_words(docs, path, limit), "frequent-words")
    found = encode_words(words, path)
    return {r["word"]: np.array(r["ids"], "<u4").tobytes() for r in found.toLocalIterator(prefetchPartitions=True)}


# ---------------------------------------------------------------- documents


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), limit: int = DICTIONARY, with_ids: bool = True) -> DataFrame:
    """The ``keep`` columns, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), decoded_chars and lossless (the ids, decoded, hold the text), and ids (array<int>)
    if ``with_ids``; no shuffle of documents."""
    held = docs.sparkSession.sparkContext.broadcast(dictionary(docs, path, limit))
    names = [*keep, "n_pieces", "ids_crc32", "decoded_chars", "lossless", *(["ids"] if with_ids else [])]

    def run(batches):
        m, known = model(path), held.value
        words: dict[str, bytes] = {}
        rare: dict[str, bytes] = {}

        def word(w: str) -> bytes:
            out = []
            for p in m.parts(m.whole(w)):
                ids = known.get(p)
                if ids is None and (ids := rare.get(p)) is None:
                    ids = rare[p] = array("i", m.fold(p)).tobytes()
                out.append(ids)
            return b"".join(out)

        for batch in batches:
            offsets, _ = text_buffers(batch.column(0))
            for i, j in chunks(offsets, CHUNK_BYTES):
                if len(words) > CACHE:
                    words.clear()
                if len(rare) > CACHE:
                    rare.clear()
                packed = []
                texts = [t or "" for t in batch.column(0).slice(i, j - i).to_pylist()]
                for t in texts:
                    cut = m.cut(t)
                    ids = list(map(words.get, cut))
                    if None in ids:
                        for k, x in enumerate(ids):
                            if x is None:
                                if (x := words.get(w := cut[k])) is None:
                                    x = words[w] = word(w)
                                ids[k] = x
                    packed.append(b"".join(ids))
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                flat = np.frombuffer(b"".join(packed), "<i4")
                back = m.decode(flat, sizes)
                cols = [batch.column(k).slice(i, j - i) for k in range(1, batch.num_columns)]
                cols += [pa.array(sizes), pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names)
                del packed, texts, back, flat, cols
            pa.default_memory_pool().release_unused()

    own = docs.select(F.col("text"), *keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[1:])
    return own.mapInArrow(lean(run), f"{kinds}n_pieces long, ids_crc32 long, decoded_chars long, lossless boolean" + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The ``keep`` columns and text."""

    def run(batches):
        m = model(path)
        for batch in batches:
            column = batch.column(0)
            counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            texts = m.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(texts, pa.string())], [*keep, "text"])

    own = encoded.select(F.col(ids_col), *keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[1:])
    return own.mapInArrow(lean(run), f"{kinds}text string")
