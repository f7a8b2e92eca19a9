"""The registered queries on the small tables, held against libraries, SQL and brute force; and all
operators on very long texts, among columns whose names they use themselves."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from inkveil.llm import decontam, dedup_lsm, langid, pii_crf, quality, queries, sharding, simhash, sstable, token_count
from inkveil.llm import sentencepiece_lattice as lattice

from test_operators import WORD, brute_components, brute_fp, low

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def table(spark):
    rows = queries.documents(spark, SF).select("doc_id", "text", "lang").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def run(spark, name, columns):
    """The query's rows by doc_id, after a look at its columns."""
    df = queries.QUERIES[name](spark, SF)
    got = dict(df.dtypes)
    assert [c for c in df.columns if c in columns] == list(columns) and {c: got[c] for c in columns} == columns
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_op1(spark, table):
    from tokenizers import Tokenizer

    got = run(spark, "op1_sstable", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    lib, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for d in sorted(table):
        ids = lib.encode(table[d]["text"] or "", add_special_tokens=False).ids + [1]
        assert tuple(got[d])[:4] == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op2(spark, table):
    got = run(spark, "op2_exact_dedup", {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"})
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.execute(queries.ORACLE_SQL["op2_exact_dedup"]).fetchall()
    assert sorted(map(tuple, got.values())) == sorted(want) and len(want) == len(table)


def test_op3(spark, table):
    got = run(spark, "op3_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert set(got) == set(table)
    learned = {r["lang"] for d, r in table.items() if r["lang"] and zlib.crc32(str(d).encode()) % 3 != 1}
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in table[d]["text"] or "")
        assert (r["lang_pred"] in learned) if letters else (r["lang_pred"] == "und")
    held = [d for d, r in got.items() if r["held_out"] and table[d]["lang"] and r["lang_pred"] != "und"]
    assert np.mean([got[d]["lang_pred"] == table[d]["lang"] for d in held]) > 0.9


def test_op4(spark, table):
    import sentencepiece

    got = run(spark, "op4_sentencepiece", {"doc_id": "bigint", "n_pieces": "bigint", "ids_crc32": "bigint", "lossless": "boolean"})
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for d, r in table.items():
        ids = lib.encode(r["text"] or "")
        assert (got[d]["n_pieces"], got[d]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[d]["lossless"] == (lib.decode(ids) == (r["text"] or ""))


def test_op5(spark, table):
    from tokenizers import Tokenizer

    got = run(spark, "op5_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d, r in table.items():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert tuple(got[d])[:4] == (d, len((r["text"] or "").encode()), n, n > 512)


def test_op6(spark, table):
    got = run(spark, "op6_decontamination", {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"})
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(low(r["text"]).decode())
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(r["item_id"])
    hits = 0
    for d, r in table.items():
        w = WORD.findall(low(r["text"]).decode())
        hit, items = np.zeros(len(w), bool), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit[p : p + n] = True
                    items |= found
        n = int(hit.sum())
        hits += n > 0
        assert tuple(got[d])[:6] == (d, len(w), n, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    assert hits


def test_op7(spark, table):
    got = run(spark, "op7_personal_data", {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"})
    for d, r in table.items():
        t, out = r["text"] or "", []
        out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(x := re.sub("[ -]", "", m[0])) <= 19 and pii_crf.luhn(x)]
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        shown = [f"{k}:{s}:{e}" for k, s, e in sorted(out, key=lambda x: (x[1], pii_crf.KINDS.index(x[0])))]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest() and not Counter(shown) - Counter(got[d]["spans"].split(","))
        assert [got[d][f"n_{k}"] for k in pii_crf.KINDS] == [sum(x[0] == k for x in out) for k in pii_crf.KINDS]


def test_op8(spark, table):
    got = run(spark, "op8_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    fps = {d: brute_fp(r["text"]) for d, r in table.items()}
    want = brute_components(fps)
    assert {d: tuple(r)[1:3] for d, r in got.items()} == {d: (f"{fps[d]:016x}", want[d]) for d in table}


def test_op9(spark, table):
    got = run(spark, "op9_hash_tree", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    slots = defaultdict(list)
    for d, r in table.items():
        raw = (r["text"] or "").encode()
        assert tuple(got[d])[1:4] == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= got[d]["shard"] < 24 and got[d]["grown_shard"] in (got[d]["shard"], 24)
        slots[got[d]["shard"]].append(got[d]["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 24


def test_op10(spark, table):
    got = run(spark, "op10_quality", {"doc_id": "bigint", "host": "string", "path": "string", "p_doc": "double", "host_posterior": "double", "path_posterior": "double", "quality": "double", "keep": "boolean"})
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == set(table) and np.mean([got[d]["keep"] == labels[d] for d in labels if d in got]) > 0.8


NAMES = "fp node run digest ids best n size salt shard bucket slot k1 k2 t u own other word matches n_words features host path p_doc quality gone other_id text_digest mark sketch bands label row value at found".split()


@pytest.fixture(scope="module")
def odd(spark):
    """A megabyte of text, single words of hundreds of thousands of letters, digits without end; an
    identifier with several texts; and a column for every name that the operators use."""
    rnd = random.Random(21)
    prose = lambda n: " ".join(rnd.choice("river stone green house table water light small".split()) + str(rnd.randint(0, 99)) for _ in range(n))
    texts = [prose(120_000), "ab" * 150_000, "".join(rnd.choice("abcdefgh") for _ in range(100_000)), "12 345.6 " * 4_000, "é" * 50_000 + " x" * 50_000, prose(60), prose(60), "", None]
    rows = [(1 if i > 6 else i, t, ["en", "xx"][i % 2], f"s{i % 2}", i, *[f"{c}{i}" for c in NAMES]) for i, t in enumerate(texts)]
    rows += [(1, prose(30), None, None, None, *[None for _ in NAMES]), (None, texts[5], "en", "s0", 3, *["x" for _ in NAMES])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES))
    return df.repartition(3), rows


def test_long_texts_and_clashing_columns(spark, odd, tmp_path):
    df, rows = odd
    texts = [r[1] for r in rows]
    n, count = len(rows), lambda x: Counter(r["doc_id"] for r in x.select("doc_id").collect())
    ids = Counter(r[0] for r in rows)
    bench = spark.createDataFrame([(1, " ".join(texts[5].split()[10:40]))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert Counter(r["n_tokens"] for r in token_count.count_tokens(df, P.path("byte_bpe_50k.json")).collect()) == Counter(len(lib.encode(t or "").ids) for t in texts)
    files = sstable.write(df, P.path("word_bpe_49k.json"), n_shards=4)
    assert count(sstable.read(spark, files, with_ids=False)) == ids
    assert Counter(r["fp"] % 2**64 for r in simhash.fingerprints(df).collect()) == Counter(map(brute_fp, texts))
    assert all(count(f(df)) == ids for f in (dedup_lsm.dedup, langid.identify, pii_crf.detect, simhash.similar, lambda x: sharding.shard(x, sharding.layout(24), sharding.layout(25)), lambda x: quality.score(x, labels), lambda x: decontam.find(x, bench), lambda x: lattice.encode(x, P.path("piece_bpe_32k.model"), keep=("doc_id", "word", "value"))))
    hit = {(r["doc_id"], len(r["matches"])) for r in decontam.find(df, bench).collect()}
    assert (5, 1) in hit and (None, 1) in hit and (0, 0) in hit
    for removed, gone in ((dedup_lsm.remove(df), 2), (simhash.remove(df), None), (decontam.remove(df, bench), 2), (langid.keep_known(df), None)):
        assert removed.columns == df.columns and (gone is None or removed.count() == n - gone)
        removed.write.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
