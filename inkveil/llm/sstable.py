"""Operator 1: token ids as sorted-string-table shards.

Documents are encoded, dealt out by ranges of their identifier, sorted, and written as one table
file per range.  A file holds, in this order: data blocks, index, Bloom filter, footer.

* Key: the identifier as 8 bytes, big-endian with the sign bit flipped, so that byte order is
  numeric order; a null identifier has the empty key and so comes first.
* Block: entries in key order; an entry drops the prefix that its key shares with the key before
  (whole keys return every RESTART entries).  Value: the ids as little-endian integers of 2 or 4
  bytes, the smallest width that holds the vocabulary.  Blocks are compressed one by one.
* Index: for each block its first key, place and number of ids: a reader bisects it and then opens
  one block.  The Bloom filter tells most absent keys without opening any.
* Footer: fixed length, at the end, with the places of index and filter and the totals.

Ranges hold about equal bytes of text.  A cut is an identifier; one that holds more rows than a range
should (a repeated identifier, or none) is cut again by a hash of the text.

Cases: null text counts as empty (the end id alone); repeated identifiers are all kept, next to one
another, by a hash of their text and then by ids; an empty table gives no files and no rows; further
columns of the input are not read.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stage

MAGIC = b"IVSST001"
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQB8s")
END_ID = 1
#: Text that a shard holds at most, about; fine ranges a shard, and documents they are sized by.
SHARD_BYTES, PIECES, DOCS_PER_SHARD = 256 << 20, 8, 65536

# ---------------------------------------------------------------- file format


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Entries must come in key order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.docs = self.tokens = 0
        self._open()

    def _open(self) -> None:
        self.block, self.n, self.block_tokens, self.last, self.first = bytearray(), 0, 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.n and len(self.block) >= BLOCK_BYTES:
            self.flush()
        if not self.n:
            self.first = key
        shared = 0
        if self.n % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value
        self.n += 1
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.tokens += len(value) // self.width
        self.block_tokens += len(value) // self.width

    def flush(self) -> None:
        if self.n:
            packed = zlib.compress(bytes(self.block), 1)
            self.out.write(packed)
            self.index.append((self.first, self.at, len(packed), self.block_tokens))
            self.at += len(packed)
            self._open()

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQQ", *x) for k, *x in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.tokens, self.width, MAGIC))


class Reader:
    """Opens index, filter and footer; blocks are read as they are needed."""

    def __init__(self, source):
        self.source = source
        end = source.size() - FOOTER.size
        at, length, bloom_at, self.bits, self.docs, self.tokens, self.width, magic = FOOTER.unpack(source.read_at(FOOTER.size, end))
        if magic != MAGIC:
            raise ValueError("not a table of token ids")
        raw, p = source.read_at(length, at), 0
        self.index = []
        while p < length:
            k = raw[p]
            self.index.append((raw[p + 1 : p + 1 + k], *struct.unpack_from("<QQQ", raw, p + 1 + k)))
            p += 25 + k
        self.first = [x[0] for x in self.index]
        self.bloom = source.read_at((self.bits + 7) // 8, bloom_at)

    def block(self, i: int):
        _, at, length, _ = self.index[i]
        raw, p, key = zlib.decompress(self.source.read_at(length, at)), 0, b""
        while p < len(raw):
            shared, own, n = struct.unpack_from("<BBI", raw, p)
            p += 6
            key = key[:shared] + raw[p : p + own]
            p += own
            yield key, raw[p : p + n]
            p += n

    def scan(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document under this identifier: filter, bisection of the index, one
        block (more only where a key's repetitions run on)."""
        key, found = key_of(doc_id), []
        if not self.may_have(key):
            return found
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.index) and self.first[i] <= key:
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in self.block(i) if k == key]
            i += 1
        return found


def open_table(path: str) -> Reader:
    fs, p = pafs.FileSystem.from_uri(path)
    return Reader(fs.open_input_file(p))


# ---------------------------------------------------------------- encoding

_encoders: dict = {}
#: Entries of a worker's caches, which change no result.
CACHE = 400_000
_PLAIN = 0x250
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """The library's ids by white-space separated word.

    The tokenizer drops white space, and no token, normalisation or special string spans it, so a
    text's ids are those of its words in a row.  Words of Latin letters go straight to the
    library's BPE model after the normaliser's lower-casing and the pre-tokenizer's pattern; any
    other word takes the library's whole path.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shape = [[(x["type"], x.get("pattern", {}).get("Regex")) for x in (spec.get(part) or {}).get(of, [])] for part, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        #: whether words can be taken one by one, as below; another vocabulary's texts are taken whole
        self.by_word = shape == [[("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)], [("Split", PATTERN), ("ByteLevel", None)]]
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.pattern = regex.compile(PATTERN)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def run(self, piece: str) -> bytes:
        if (ids := self.runs.get(piece)) is None:
            if len(self.runs) >= CACHE:
                self.runs.clear()
            shown = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.shown)
            ids = self.runs[piece] = self.pack([t.id for t in self.model.tokenize(shown)])
        return ids

    def word(self, raw: bytes) -> bytes:
        if raw.isascii():
            text = raw.lower().decode()
            plain = True
        else:
            text = raw.decode()
            plain = max(text) < chr(_PLAIN)
            text = text.lower() if plain else text
        if not plain or "<|" in text or len(text) > 200:
            return self.pack(self.whole.encode(raw.decode(), add_special_tokens=False).ids)
        if (ids := self.runs.get(text)) is not None:
            return ids
        if text.isalpha():  # letters only: one match of the pattern
            return self.run(text)
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return self.run(text[:-1]) + self.run(text[-1])
        return b"".join(map(self.run, self.pattern.findall(text)))

    def text(self, raw: bytes) -> bytes:
        if not self.by_word:
            return self.pack(self.whole.encode(raw.decode(), add_special_tokens=False).ids)
        words = raw.split()
        ids = list(map(self.words.get, words))
        if None in ids:
            if len(self.words) >= CACHE // 2:  # what is still in use is taken over from the older half
                self.words, self.older = {}, self.words
            known, older = self.words, self.older
            for i, x in enumerate(ids):
                if x is None:
                    if (x := known.get(w := words[i])) is None:
                        if (x := older.get(w)) is None:
                            x = self.word(w)
                        known[w] = x
                    ids[i] = x
        return b"".join(ids)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def packed(enc: WordEncoder, texts: pa.Array, end_id: int) -> list[bytes]:
    """Each text's ids and ``end_id``, as little-endian integers of the encoder's width."""
    end = enc.pack([end_id])
    return [enc.text(t or b"") + end for t in texts.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids as packed bytes), ``end_id`` appended; no shuffle."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids = packed(enc, batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // enc.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


# ---------------------------------------------------------------- ranges

_LOWEST = -(2**63)


class Ranges:
    """Cuts between ranges, in order; a cut that comes m times leaves m ranges to its identifier."""

    def __init__(self, cuts: list[float]):
        self.cuts = np.array(sorted(min(max(int(c), _LOWEST), -_LOWEST - 1) for c in cuts), np.int64)

    def of(self, ids: pa.Array, salt: np.ndarray) -> np.ndarray:
        """The range of each identifier; ``salt``: a number from 0 to 1 for each row."""
        d = ids.fill_null(_LOWEST).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(self.cuts, d, side) for side in ("left", "right"))
        return np.where(high > low, low + 1 + (salt * (high - low)).astype(np.int64), high)


def _salt(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 30)).cast("int")


def ranges_of(docs: DataFrame, n_shards: int | None, shard_bytes: int) -> tuple[Ranges, np.ndarray]:
    """(fine ranges, the shard of each).  Quantiles of the identifiers, from a sketch, give several
    ranges a shard; neighbours are then joined by bytes of text, which each task adds up."""
    least = 4 * docs.sparkSession.sparkContext.defaultParallelism if n_shards is None else n_shards
    fine = PIECES * max(least, -(-docs.count() // DOCS_PER_SHARD) if n_shards is None else 0)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("double"), F.lit(float(_LOWEST))).alias("k"))
    ranges = Ranges(keys.approxQuantile("k", [i / fine for i in range(1, fine)], 0.1 / fine) if fine > 1 else [])
    n = len(ranges.cuts) + 1

    def add(batches):
        total = np.zeros(n)
        for batch in batches:
            np.add.at(total, ranges.of(batch.column(0), batch.column(1).to_numpy() / (1 << 30)), batch.column(2).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["range", "bytes"])

    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _salt(F.col("text")).alias("salt"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("double").alias("bytes"))
    found = sizes.mapInArrow(add, "range int, bytes double").groupBy("range").agg(F.sum("bytes").alias("bytes")).toPandas()
    total = np.zeros(n)
    total[found["range"].to_numpy()] = found["bytes"].to_numpy()
    shards = n_shards or max(least, int(total.sum() // shard_bytes) + 1)
    middle = np.cumsum(total) - total / 2
    return ranges, np.minimum((middle * shards / max(total.sum(), 1)).astype(np.int32), shards - 1)


# ---------------------------------------------------------------- tables


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, n_shards: int | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; returns (shard, path, n_docs, n_tokens), one row a file, ascending ranges.

    Two passes over identifiers and lengths find the ranges, one over the texts encodes them; only
    packed ids are shuffled, each shard to a partition of its own.  Each file is written under a name
    of the attempt and then renamed, so that a repeated task replaces like with like.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "sst")
    ranges, shard_of = ranges_of(docs, n_shards, shard_bytes)
    width = encoder(tokenizer).width

    def files(batches):
        now, shard, name = None, None, None
        done = []

        def finish():
            now.close()
            now.out.close()
            fs.move(part, whole)
            done.append((shard, f"{folder}/{name}", now.docs, now.tokens))

        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for s, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard:
                    if now:
                        finish()
                    shard, name = s, f"shard-{s:06d}.sst"
                    part, whole = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
                    fs.create_dir(root, recursive=True)
                    now = Writer(fs.open_output_stream(part), width)
                now.add(key_of(doc_id), ids)
        if now:
            finish()
        cols = list(zip(*done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "n_docs", "n_tokens"])

    def place(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            salt = batch.column(1)
            shard = shard_of[ranges.of(batch.column(0), salt.to_numpy() / (1 << 30))]
            ids = packed(enc, batch.column(2), end_id)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), pa.array(ids, pa.binary()), salt], ["shard", "doc_id", "ids", "salt"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _salt(F.col("text")).alias("salt"), "text").mapInArrow(place, "shard int, doc_id long, ids binary, salt int")
    ordered = dealt.repartitionById(int(shard_of.max()) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "salt", "ids")
    return stage(ordered.mapInArrow(files, "shard int, path string, n_docs long, n_tokens long"), "sst-files")


def read(spark: SparkSession, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read the shards back: (doc_id, start, n_tokens, ids_crc32, ids array<int> if ``with_ids``).

    ``files``: what ``write`` returned.  It has a row a file, so the running totals over it are
    small whatever the corpus; each file is then read by one task, block by block.
    """
    rows = sorted(files.collect())
    base, todo = 0, []
    for r in rows:
        todo.append((r["path"], base))
        base += r["n_tokens"]

    def scan(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = open_table(path)
                for i in range(len(table.index)):
                    out = [[], [], [], []]
                    packed = []
                    for key, value in table.block(i):
                        ids = np.frombuffer(value, f"<u{table.width}").astype("<u4")
                        for c, x in zip(out, (id_of(key), start, len(ids), zlib.crc32(ids)), strict=True):
                            c.append(x)
                        if with_ids:
                            packed.append(ids)
                        start += len(ids)
                    cols = [pa.array(c, pa.int64()) for c in out]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32), pa.array(np.concatenate(packed).astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    todo_df = spark.createDataFrame(todo, "path string, start long")
    if todo:
        todo_df = todo_df.repartition(len(todo))
    return todo_df.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def lookup(files: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Point lookups through filter and index; opens only the files' ends and the blocks needed."""
    found: dict[int, list[np.ndarray]] = {}
    for r in sorted(files.collect()):
        table = open_table(r["path"])
        for d in doc_ids:
            if hit := table.get(d):
                found.setdefault(d, []).extend(hit)
    return found
