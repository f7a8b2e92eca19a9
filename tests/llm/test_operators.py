"""The operators against brute force, libraries and round trips, on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F

from inkveil.llm import common, decontam, dedup_lsm, langid, pii_crf, quality, sharding, simhash, sstable, token_count
from inkveil.llm import sentencepiece_lattice as lattice

low = lambda t: (t or "").encode().lower()


# ---------------------------------------------------------------- 1


def test_token_tables(spark, docs, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    files = sstable.write(docs, path, n_shards=3)
    got = sstable.read(spark, files).collect()
    assert len(got) == docs.count()
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        if r["doc_id"] is not None:
            assert r["ids"] == lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    found = sstable.lookup(files, [3, 0, 10**9])
    assert len(found[0]) == 2 and found[3][0].tolist() == next(r["ids"] for r in got if r["doc_id"] == 3) and 10**9 not in found


def test_table_blocks(tmp_path):
    import pyarrow.fs as pafs

    path = f"{tmp_path}/t.sst"
    w = sstable.Writer(pafs.LocalFileSystem().open_output_stream(path), 2)
    values = {i * 3 - 500: np.arange(i % 700, dtype="<u2").tobytes() for i in range(1200)}
    for k in sorted(values):
        w.add(sstable.key_of(k), values[k])
    w.close()
    w.out.close()
    t = sstable.open_table(path)
    assert len(t.index) > 5 and {sstable.id_of(k): v for k, v in t.scan()} == values
    assert all(t.get(k)[0].tobytes() == values[k] for k in list(values)[::37])
    assert t.get(-499) == [] and sum(t.may_have(sstable.key_of(k)) for k in range(10**6, 10**6 + 1000)) < 60


def test_token_tables_of_hot_identifiers(spark):
    """Rows without identifier, and those of one identifier, fill several shards and stay in order."""
    rows = [(None, f"null {i}") for i in range(200)] + [(5, f"five {i}") for i in range(200)] + [(i, f"t {i}") for i in range(-50, 50)] + [(2**62, "big"), (-(2**63), "least")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = sstable.write(df, P.path("word_bpe_49k.json"), n_shards=8)
    got = sorted(sstable.read(spark, files).collect(), key=lambda r: r["start"])
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in got) and Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    sizes = [r["n_docs"] for r in files.collect()]
    assert len(sizes) >= 6 and max(sizes) < 150
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_token_tables_empty(spark, empty):
    files = sstable.write(empty, P.path("word_bpe_49k.json"), n_shards=2)
    assert files.count() == 0 and sstable.read(spark, files).count() == 0


# ---------------------------------------------------------------- 2


def brute_groups(rows, keep):
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    return {t: (keep([d for d in ids if d is not None], default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep,pick", [("min", min), ("max", max)])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(docs, keep, pick, digest_bytes):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_groups(rows, pick)
    text = {d: t for d, t in rows}
    got = dedup_lsm.dedup(docs, keep, digest_bytes).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    for r in got:
        keep_id, n = want[low(text[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"]) == (keep_id, n)
    assert sum(r["kept"] for r in got) == len(want) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_remove(docs, empty):
    out = dedup_lsm.remove(docs)
    assert out.columns == docs.columns
    kept = [low(r["text"]) for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {low(r["text"]) for r in docs.collect()}
    assert dedup_lsm.remove(empty).count() == 0 and dedup_lsm.dedup(empty).count() == 0


def test_repeated_identifiers_with_other_texts(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c"), (1, "c"), (None, "b"), (None, "z"), (None, "Z")]
    for parts, keep, pick in ((1, "max", max), (9, "min", min)):
        df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, digest string, other_id int").repartition(parts)
        want = brute_groups(rows, pick)
        got = dedup_lsm.dedup(df, keep).collect()
        assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
        by_text = {hashlib.sha256(t).digest(): v for t, v in want.items()}
        assert all((r["keep_id"], r["group_size"]) == by_text[bytes(r["digest"])] for r in got)
        kept = dedup_lsm.remove(df, keep)
        assert kept.columns == df.columns
        assert Counter((r["doc_id"], low(r["text"])) for r in kept.collect()) == Counter((k, t) for t, (k, _) in want.items())


def test_filters_are_consulted(spark, docs):
    """What only one run has is never shuffled, and an index's filter rules out new texts."""
    df = spark.createDataFrame([(i, f"text {i % 900}") for i in range(1000)], "doc_id long, text string").repartition(4, "doc_id")
    runs = dedup_lsm.build_runs(df)
    entries = runs.where("digest is not null").select(*dedup_lsm._ENTRY)
    assert runs.where("filter is not null").agg(F.sum(F.length("filter"))).first()[0] == 4 * entries.count()
    alone, shared = dedup_lsm.consult(entries, dedup_lsm.crossing(runs), 6)
    crossing = {r[0] for r in entries.groupBy("digest").count().where("count > 1").select("digest").collect()}
    assert {r["digest"] for r in shared.collect()} == crossing and alone.count() + shared.count() == entries.count() and 0 < len(crossing) <= 100
    new, maybe = dedup_lsm.Index(df).consult(spark.createDataFrame([(i, f"text {i}") for i in range(850, 950)], "doc_id long, text string"))
    assert maybe.count() >= 50 and new.count() >= 45


def test_index_lookup(spark, docs):
    index = dedup_lsm.Index(docs)
    batch = spark.createDataFrame([(900, docs.where("doc_id = 5").first()["text"].upper()), (901, "never seen")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in index.lookup(batch).collect()} == {900: 5, 901: None}


# ---------------------------------------------------------------- 3


def test_language(spark, empty):
    rnd = random.Random(4)
    syllables = {"aa": "ka ro mi tu ne".split(), "bb": "schu ber gen ach zwi".split(), "cc": "ção nho lha eir õe".split()}
    word = lambda k: "".join(rnd.choice(syllables[k]) for _ in range(rnd.randint(1, 3)))
    rows = [(i, " ".join(word(k) for _ in range(rnd.randint(3, 60))), k) for i in range(600) for k in ["aabbcc"[i % 3 * 2 : i % 3 * 2 + 2]]]
    rows += [(700, None, "aa"), (701, "123 !", "aa"), (702, "", None), (703, "karomi tune", None), (None, "schuber", "bb"), (704, "² ½ ① Ⅷ ٣", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common.ship(spark)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (700, 701, 702, 704))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600)) and got[None]["held_out"] is False
    held = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97 and got[703]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (700, 701, 702, 704)").count() == 0 and kept.count() > 590
    assert langid.identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in langid.identify(unlabelled).select("lang_pred").collect()} == {"und"}


@pytest.mark.parametrize("size", [1, 2, 3, 50, 10_000])
def test_slices_of_a_long_text(monkeypatch, size):
    text = "Größe İstanbul ΟΔΟΣ und 日本語 🙂 " * 20
    whole, _ = langid.grams([text.lower()])
    monkeypatch.setattr(langid, "SLICE", size)
    assert Counter(np.concatenate(list(langid.slices(text))).tolist()) == Counter(whole.tolist())
    assert list(langid.slices("")) == []


def test_guesses_are_rejected(spark):
    """Texts of none of the learned languages go; clean ones of either stay."""
    rnd = random.Random(9)
    syllables = {"aa": "ka ro mi tu ne".split(), "bb": "schu ber gen ach zwi".split()}
    text = lambda ks, n: " ".join("".join(rnd.choice(syllables[rnd.choice(ks)]) for _ in range(2)) for _ in range(n))
    rows = [(i, text([k], 40), k) for i in range(400) for k in [("aa", "bb")[i % 2]]]
    rows += [(1000 + i, "ωψφλ" * (i + 1), None) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_known(docs).collect()}
    assert kept == set(range(400))
    assert langid.least_score(1) == 1 and langid.least_score(2) == pytest.approx(0.6) and langid.least_score(4) == pytest.approx(0.4)


def test_model_by_plain_loops(spark):
    """n-grams, document frequencies, FTRL and temperature, each written out."""
    rnd, mask = random.Random(12), 2**64 - 1
    rows = [(i, "".join(rnd.choice(["abc ", "Éf"][i % 2] + "xyz") for _ in range(rnd.randint(0, 25))), ["p", "q"][i % 2]) for i in range(90)]

    def buckets(text):
        out, codes = [], [ord(c) for c in text.lower()]
        for i in range(len(codes)):
            h = 0
            for k in range(min(3, len(codes) - i)):
                h = (h ^ (codes[i + k] + 1)) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 29
                out.append((h * 0xBF58476D1CE4E5B9 & mask) >> 48)
        return Counter(out)

    def spark_hash(*xs):
        h = 42
        for x in xs:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
        return h - 2**64 if h >= 2**63 else h

    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    df = Counter(b for r in training for b in buckets(r[1]))
    idf = {b: langid.SCALE * (np.log((1 + len(training)) / (1 + n)) + 1) for b, n in df.items()}
    sample = sorted((lang, spark_hash(i, 12) % 5, sorted(buckets(t)), [buckets(t)[b] for b in sorted(buckets(t))]) for i, t, lang in training)
    shares = [({b: n / max(1, sum(c)) * idf[b] for b, n in zip(o, c, strict=True)} | {"bias": 1.0}, lang, fold) for lang, fold, o, c in sample]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.003, 0.1
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - np.sign(z[key]) * l1) / ((beta + np.sqrt(n[key])) / alpha + l2)

    fit, order = [x for x in shares if x[2]], np.random.default_rng(5)
    for _ in range(3):
        for i in order.permutation(len(fit)):
            x, lang, _ = fit[i]
            w = {(b, k): weight((b, k)) for b in x for k in "pq"}
            s = {k: sum(v * w[b, k] for b, v in x.items()) for k in "pq"}
            total = sum(np.exp(v) for v in s.values())
            for k in "pq":
                for b, v in x.items():
                    g = v * (np.exp(s[k]) / total - (k == lang))
                    sigma = (np.sqrt(n[b, k] + g * g) - np.sqrt(n[b, k])) / alpha
                    z[b, k] += g - sigma * w[b, k]
                    n[b, k] += g * g
    logits = [({k: sum(v * weight((b, k)) for b, v in x.items()) for k in "pq"}, lang) for x, lang, fold in shares if not fold]
    doubt = 1 / (len(logits) + 2)
    losses = {t: sum(np.log(sum(np.exp(v / np.exp(t)) for v in s.values())) - ((1 - doubt) * s[lang] + doubt * sum(s.values()) / 2) / np.exp(t) for s, lang in logits) for t in np.linspace(-4, 4, 801)}
    t = np.exp(min(losses, key=losses.get))
    common.ship(spark)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == ["p", "q"]
    got_t = [weight(("bias", k)) / model.bias[j] for j, k in enumerate("pq") if model.bias[j]]
    assert all(abs(np.log(x / t)) < 0.011 for x in got_t)
    t = got_t[0]
    for b in df:
        for j, k in enumerate("pq"):
            assert model.weights[b, j] == pytest.approx(weight((b, k)) * idf[b] / t, rel=1e-4, abs=1e-6)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "abc def" if zlib.crc32(str(i).encode()) % 3 == 1 else "xyz uvw", "p" if zlib.crc32(str(i).encode()) % 3 == 1 else "q") for i in range(60)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"q"}


# ---------------------------------------------------------------- 4


def test_pieces(docs, texts, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = lattice.encode(docs, path, keep=("doc_id", "slot"), limit=40)
    got = encoded.collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or ""
            assert r["ids"] == lib.encode(t) and r["n_pieces"] == len(r["ids"])
            assert r["lossless"] == (lib.decode(r["ids"]) == t) and r["decoded_chars"] == len(lib.decode(r["ids"]))
    back = {r["doc_id"]: r["text"] for r in lattice.decode(encoded, path).collect()}
    assert all(back[i] == lib.decode(lib.encode(t or "")) for i, t in enumerate(texts))
    assert lattice.encode(empty, path).count() == 0


def test_lattice_folds(spark):
    path = P.path("piece_bpe_32k.model")
    m = lattice.model(path)
    rnd = random.Random(1)
    words = sorted({"▁" + "".join(rnd.choice(["th", "e", "in", "on", "é", "x", "ou", "日", "🙂", "▁"]) for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["ids"] for r in lattice.encode_words(df, path).collect()}
    assert got == {w: m.fold(w) for w in words} and all(m._short(w) == m._long(w) for w in words)

    def viterbi(w):  # the same path by plain dynamic programming
        best = [(0.0, -1, [])]
        low_score = min(m.score[i] for i in m.plain) - 10
        for j in range(1, len(w) + 1):
            into = []
            for i in range(max(0, j - m.longest), j):
                p = w[i:j]
                if p in m.id:
                    into.append((best[i][0] + m.score[m.id[p]], i, [m.id[p]]))
                elif j - i == 1:
                    into.append((best[i][0] + low_score, i, m.fallback(p)))
            best.append(max(into))
        out, j = [], len(w)
        while j > 0:
            out, j = best[j][2] + out, best[j][1]
        return out

    assert {r["word"]: r["ids"] for r in lattice.encode_words(df, path, "viterbi").collect()} == {w: viterbi(w) for w in words}


# ---------------------------------------------------------------- 5


def test_token_counts(docs, texts, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = token_count.count_tokens(docs, path).collect()
    assert len(got) == docs.count() and token_count.count_tokens(empty, path).count() == 0
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or ""
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)


def test_token_counts_on_odd_spaces():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rnd = random.Random(2)
    alphabet = ["a", "Ab", " ", "  ", "\n", "\t", "'s", "'", "1", "é", " ", "　", "\x1c", "\x85", "!", "<|endoftext|>", "<|", "日", "aaaa", "🙂"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    lib = Tokenizer.from_file(path)
    assert token_count.Counter(path).counts(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_long_words():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rnd = random.Random(13)
    words = ["a" * 5000, "ab" * 3000, "é" * 4000 + "x" * 3001, "9" * 5001] + ["".join(rnd.choice(x) for _ in range(n)) for x, n in (("abc", 9000), ("etaoinshrdlu", 60_000), ("aA1é! ", 20_000))]
    lib = Tokenizer.from_file(path)
    assert token_count.Counter(path).counts(words) == [len(e.ids) for e in lib.encode_batch(words, add_special_tokens=False)]
    table = token_count.counter(path).table
    short = ["".join(rnd.choice("abcdetaoin") for _ in range(rnd.randint(1, 60))).encode() for _ in range(500)]
    assert [token_count.count_long(table, w) for w in short] == token_count.count_symbols(table, short).tolist()


# ---------------------------------------------------------------- 6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    w = WORD.findall(low(text).decode())
    hit, found = [False] * len(w), set()
    for i, x in items:
        v = WORD.findall(low(x).decode())
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    found.add(i)
                    hit[p : p + n] = [True] * n
    return len(w), sum(hit), sorted(map(str, found))


def test_decontamination(spark, docs, empty):
    base = docs.where("doc_id = 4").first()["text"]
    words = base.split()
    items = [(1, " ".join(words[3:25])), (2, "Stone LIGHT"), (3, None), (4, ""), (10, " ".join(words[3:25])), (5, "the the the the"), (6, "x " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(500, "noise, " + " ".join(words[3:25]).upper() + " noise " * 600), (501, "stone. light"), (502, "the " * 9), (503, " ".join(words[3:15]))], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(extra)
    want = {r["doc_id"]: brute_hits(r["text"], items) for r in all_docs.collect()}
    for block in (decontam.BLOCK_BYTES, 100):
        got = decontam.summary(decontam.find(all_docs, bench, block_bytes=block)).collect()
        assert len(got) == all_docs.count()
        for r in got:
            n, hit, found = want[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
            assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and r["contaminated"] == (hit > 0 and 20 * hit >= n)
    m = decontam.find(extra, bench).where("doc_id = 500").first()["matches"]
    assert [(x["item_id"], x["doc_word"], x["item_word"], x["n_words"]) for x in m if x["item_id"] == 1] == [(1, 1, 0, len(WORD.findall(items[0][1])))]
    kept = decontam.remove(docs, bench)
    assert kept.columns == docs.columns
    bad = {d for d, (_, h, _) in want.items() if h}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    kept = {r["doc_id"] for r in decontam.remove(all_docs, bench).collect()}
    assert kept == {r["doc_id"] for r in all_docs.collect()} - bad and 500 in bad and 20 * want[500][1] < want[500][0]  # one passage in a long document
    assert decontam.remove(docs, bench.where("false")).count() == docs.count() and decontam.find(empty, bench).count() == 0


# ---------------------------------------------------------------- 7


def test_base_spans():
    e = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    i = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c, p = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(x):
        o = [("email", *m.span()) for m in e.finditer(x)]
        o += [("ip", *m.span()) for m in i.finditer(x) if all(int(q) <= 255 for q in m[0].split("."))]
        o += [("card", *m.span()) for m in c.finditer(x) if 12 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii_crf.luhn(re.sub("[ -]", "", m[0]))]
        o += [("phone", *m.span()) for m in p.finditer(x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(o, key=lambda z: (z[1], pii_crf.KINDS.index(z[0]), z[2]))

    long = ["0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "1.2.3." + "0" * 6000 + "7", "0" * 4000 + "1" * 4000, "+" + "1-" * 5000 + "1", "a" * 6000 + "@b.c"]
    assert [len(pii_crf.base_spans(x)) for x in long] == [1, 0, 1, 0, 0, 1]

    rnd = random.Random(1)
    parts = ["a", "b@", ".", "1", "55", "@", "+", "-", " ", "(", ")", "4111111111111111", "é", "x.y", "@c.d", "+1 ", "256", "0001", "٣"]
    for _ in range(20000):
        x = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        assert pii_crf.base_spans(x) == brute(x), x


def test_field_on_fresh_rows():
    field = pii_crf.train()
    rows = pii_crf.labelled_table(seed=99)
    found = pii_crf.added_spans(field, [t for t, _ in rows], [[] for _ in rows])
    right = sum(set(a) & set(b) == set(b) for (_, b), a in zip(rows, found, strict=True))
    extra = sum(bool(set(a) - set(b)) for (_, b), a in zip(rows, found, strict=True))
    assert right > 0.95 * len(rows) and extra < 0.02 * len(rows)


@pytest.fixture(scope="module")
def field():
    return pii_crf.train()


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("email", "write to john at example dot com today", "john at example dot com"),
        ("email", "mail mary (at) sample (dot) org.", "mary (at) sample (dot) org"),
        ("email", "or peter [at] example.com, please", "peter [at] example.com"),
        ("email", "ask anna[at]sample[dot]com soon", "anna[at]sample[dot]com"),
        ("phone", "call (555) - 123 - 4567 now", "(555) - 123 - 4567"),
        ("phone", "ring 555 - 123 - 4567 today", "555 - 123 - 4567"),
        (None, "look at the dot on the wall", None),
        (None, "see pages 12 - 15 of it", None),
        (None, "on 2024 - 01 - 15 we met", None),
        (None, "we sat at home and ate", None),
    ],
)
def test_spelled_out_and_spaced_spans(spark, field, kind, text, want):
    row = pii_crf.detect(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), field).where("doc_id = 1").first()
    assert [(x["kind"], text[x["start"] : x["end"]], x["added"]) for x in row["found"]] == ([(kind, want, True)] if want else [])
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest() and row["n_email"] == row["n_phone"] == 0


def test_viterbi_is_the_best_path():
    field = pii_crf.train(steps=20)
    rnd = np.random.default_rng(0)
    e = rnd.normal(size=(6, 3, len(pii_crf.LABELS))) * 3
    got = field.decode(e)
    n = len(pii_crf.LABELS)
    for k in range(6):
        score = lambda p: field.transition[-1][p[0]] + sum(e[k, t, p[t]] for t in range(3)) + field.transition[p[0], p[1]] + field.transition[p[1], p[2]]
        best = max(((a, b, c) for a in range(n) for b in range(n) for c in range(n)), key=score)
        assert score(tuple(got[k])) == pytest.approx(score(best))


def test_personal_data(spark, docs, empty):
    rows = [(1, "mail é a.b@c.example.org, call (555) 123-4567 or +1 (377) 555-0271."), (2, "4111 1111 1111 1111 at 10.0.0.256 and 10.0.0.25"), (3, None), (4, "clean, version 3.0")]
    got = {r["doc_id"]: r for r in pii_crf.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[1][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 0, 0, 1]
    assert got[1]["spans"] == "email:7:24,phone:31:45,phone:49:66"
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:7:24,phone:49:66").hexdigest()
    assert [got[2][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [0, 1, 1, 0]
    assert got[3]["spans"] == got[4]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii_crf.detect(docs).count() == docs.count() and pii_crf.detect(empty).count() == 0


# ---------------------------------------------------------------- 8


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text).decode())
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_xxh64():
    data = [random.Random(3).randbytes(n) for n in list(range(120)) * 2]
    size = np.array([len(x) for x in data])
    got = simhash.xxh64(np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(x, seed=42) for x in data]


def test_near_duplicates(docs, texts, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] % 2**64 == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
        else:
            assert r["component_id"] is None
    kept = simhash.remove(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values()) | {None}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar(empty).count() == 0 and simhash.remove(empty).count() == 0


def jaccard(a, b):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t).decode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in (3, 8, 30, 200, 900):
        for _ in range(8):
            base = [rnd.choice(words) for _ in range(n)]
            rows.append(" ".join(base))
            for share in (0.01, 0.03, 0.1):
                w = [rnd.choice(words) if rnd.random() < share else x for x in base]
                rows.append(" ".join(w) + rnd.choice(["", " tail", " and so on"]))
    rows += ["", None, "  ", "one", "ONE", "one two"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    near, lone = 0, set(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            x = jaccard(a, rows[j])
            if x >= 0.84:
                near += 1
                assert got[i] == got[j], (i, j, x)
            if x >= 0.66:
                lone -= {i, j}
    assert near > 40 and len(lone) > 30 and all(got[i] == i for i in lone) and all(sum(v == i for v in got.values()) == 1 for i in lone)
    assert got[len(rows) - 3] == got[len(rows) - 2] == len(rows) - 3  # one, ONE
    kept = {r["doc_id"] for r in simhash.remove(df).collect()}
    assert kept == set(got.values())


def test_units_leave_out_distant_tiles(spark):
    """Tiles of very different population counts meet in no unit, and no node is copied without bound."""
    rnd = random.Random(6)
    fps = {sum(1 << b for b in rnd.sample(range(13, 64), k)) for k in (2, 3, 20, 21, 45) for _ in range(60)}  # equal first bands
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(sorted(fps))], "node long, fp long")
    rows = simhash.units(df.select("node", "fp", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")), 4, tile=20, cut=False).collect()
    pops = defaultdict(list)
    for r in rows:
        pops[r["own"]].append((r["fp"] % 2**64).bit_count())
    tiles = max(pops) + 1
    met = {(r["t"], r["u"]) for r in rows}
    for t in range(tiles):
        for u in range(t, tiles):
            assert (t, u) in met or min(pops[u]) - max(pops[t]) > 4
    far = [(t, u) for t, u in met if min(pops[u]) - max(pops[t]) > 4]  # only by a tile's share of the next count
    assert len(far) < tiles and len(met) < 0.6 * tiles * (tiles + 1) / 2 and (0, tiles - 1) not in met and all(sum(x["node"] == r["node"] for x in rows) <= simhash.MOST_TILES for r in rows[:50])


@pytest.mark.parametrize("cut", [1, 64])
def test_links_of_large_groups(spark, monkeypatch, cut):
    monkeypatch.setattr(simhash, "CUT_AGAIN", cut)
    rnd = random.Random(7)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(150)} | {(centre & 0x1FFF) | rnd.getrandbits(51) << 13 for _ in range(150)}
    nodes = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in nodes.items()], "node long, fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, tile=8)).collect()}
    assert {i: found.get(i, i) for i in nodes} == brute_components(nodes)


def test_links_through_many_tiles(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = {rnd.getrandbits(64) for _ in range(300)} | {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    chain = [rnd.getrandbits(64)]
    for k in range(40):  # each links with its neighbours only
        chain.append(chain[-1] ^ (0b111 << (3 * k % 60)) if k % 20 else chain[-1] ^ 0b1111)
    fps = list(fps | set(chain))
    nodes = {i: f for i, f in enumerate(fps)}
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in nodes.items()], "node long, fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, tile=16)).collect()}
    assert {i: found.get(i, i) for i in nodes} == brute_components(nodes)


# ---------------------------------------------------------------- 9


def test_shards(spark, docs, empty):
    leaves, grown = sharding.layout(24), sharding.layout(25)
    got = sharding.shard(docs, leaves, grown, buckets=3).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count() and sharding.shard(empty, leaves).count() == 0
    slots = defaultdict(list)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key") and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_tree_movement(spark):
    df = spark.range(20000)

    def at(leaves):
        return np.array([r[0] for r in df.select("id", sharding.assign(F.col("id"), leaves).alias("s")).orderBy("id").select("s").collect()])

    a, b = at(sharding.layout(24)), at(sharding.layout(31))
    share = np.bincount(a, minlength=24) / len(a)
    assert abs(share - 1 / 24).max() < 0.01 and ((a == b) | (b >= 24)).all() and abs((b >= 24).mean() - 7 / 31) < 0.02
    heavy = at(sharding.layout(24, weights={5: 3.0}))  # region 0, rack 1
    region, rack = (lambda x: x // 8), (lambda x: x // 4)
    moved = a != heavy
    assert (region(heavy[moved]) == 0).all() and abs((region(heavy) == 0).mean() - 10 / 26) < 0.015
    inside = moved & (region(a) == 0)
    assert (rack(heavy[inside]) == 1).all() and (heavy[inside & (rack(a) == 1)] == 5).all() and abs((heavy == 5).mean() - 3 / 26) < 0.01

    def brute(k, leaves):
        def h(x, seed):
            return xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed=seed)

        def pick(level, of):
            return min((-np.log(((h(c, h(level, h(k, 42))) >> 11) + 0.5) / 2**53) / w, c) for c, w in of.items())[1]

        levels, at = sharding.tree(leaves), 0
        for level, children in enumerate(levels):
            at = pick(level, children[at])
        return at

    assert [brute(k, sharding.layout(24)) for k in range(300)] == a[:300].tolist()
    assert [brute(k, sharding.layout(24, weights={5: 3.0})) for k in range(300)] == heavy[:300].tolist()
    flat = at([sharding.Leaf(0, 0, s) for s in range(24)])  # the tree matters: without it rows go elsewhere
    assert (flat != a).mean() > 0.5


def test_slots_without_identifiers(spark):
    rows = [(None, "same")] * 300 + [(7, "same")] * 50 + [(i, f"t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(df, sharding.layout(3), buckets=8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in slots.values())


# ---------------------------------------------------------------- 10


def test_quality(spark, empty):
    rnd = random.Random(8)
    good = lambda: " ".join(rnd.choice("the river runs under a green bridge in spring".split()) for _ in range(40)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "###$$$", "click|||", "%%%win"]) for _ in range(40))
    rows, labels = [], []
    for i in range(900):
        site = i % 3
        ok = rnd.random() < (0.95, 0.5, 0.1)[site]
        rows.append((i, good() if ok else bad(), f"site{site}", "en"))
        if i % 2:
            labels.append((i, int(ok), 0))
    rows += [(2000, None, None, None), (2001, good(), "rare", "xx"), (0, rows[0][1], "site0", "en")]
    labels += [(1, labels[0][1], 0), (77777, 1, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(docs, lab).collect()
    assert len(got) == len(rows)
    truth = {i: not any(c in rows[i][1] for c in "#$%!|") for i in range(900)}
    unseen = [r for r in got if r["doc_id"] in truth and r["doc_id"] % 2 == 0]
    assert np.mean([r["keep"] == truth[r["doc_id"]] for r in unseen]) > 0.97
    p = defaultdict(list)
    for r in got:
        p[r["host"], r["path"]].append(r)
    mean = np.mean([r["p_doc"] for r in got])
    for (host, path), rs in p.items():
        own = np.mean([r["p_doc"] for r in rs])
        assert min(own, rs[0]["host_posterior"]) - 1e-9 <= rs[0]["path_posterior"] <= max(own, rs[0]["host_posterior"]) + 1e-9
        lo, hi = sorted((np.mean([r["p_doc"] for r in got if r["host"] == host]), mean))
        assert lo - 1e-9 <= rs[0]["host_posterior"] <= hi + 1e-9
    for r in got:  # the change of prior
        logit = lambda x: np.log(x / (1 - x))
        want = 1 / (1 + np.exp(-(logit(r["p_doc"]) + logit(r["path_posterior"]) - logit(mean))))
        assert r["quality"] == pytest.approx(want, abs=1e-6)
    assert quality.score(empty, lab).count() == 0
    flat = quality.score(docs, lab.where("false"))
    assert {round(r["p_doc"], 9) for r in flat.collect()} == {0.5}


def test_quality_by_plain_loops(spark):
    rnd = random.Random(14)
    sites = [(n := rnd.randint(1, 9), sum(q := [rnd.random() for _ in range(n)]), sum(x * x for x in q)) for _ in range(12)]
    mean = sum(s for _, s, _ in sites) / sum(n for n, _, _ in sites)
    total = sum(n for n, _, _ in sites)
    within = sum(q - s * s / n for n, s, q in sites) / (total - len(sites))
    between = (sum(n * (s / n - mean) ** 2 for n, s, _ in sites) - len(sites) * within) / total
    want = min(1e9, max(1.0, within / between)) if between > 1e-12 else 1e9
    df = spark.createDataFrame(sites, "n long, s double, q double")
    assert quality.strength(df, F.lit(mean)) == pytest.approx(want)
    spread = [(100, 100 * m, 100 * (m * m + 0.01)) for m in (0.1, 0.5, 0.9)]
    between = (sum(100 * (m - 0.5) ** 2 for m in (0.1, 0.5, 0.9)) - 3 * (300 * 0.01 / 297)) / 300
    assert quality.strength(spark.createDataFrame(spread, "n long, s double, q double"), F.lit(0.5)) == pytest.approx(max(1.0, 300 * 0.01 / 297 / between))

    x = np.array([[rnd.gauss(0, 1) for _ in quality.FEATURES] for _ in range(200)])
    y = np.array([float(r[0] - r[1] + rnd.gauss(0, 1) > 0) for r in x])
    model = quality.fit(x, y)
    slope = [0.0] * (len(quality.FEATURES) + 1)
    for row, target in zip(x, y, strict=True):
        z = [1.0] + [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(z, model.weights, strict=True))))
        slope = [g + (target - p) * v for g, v in zip(slope, z, strict=True)]
    assert all(abs(g - (w if j else 0)) < 1e-4 for j, (g, w) in enumerate(zip(slope, model.weights, strict=True)))


def test_quality_of_many_sites(spark, monkeypatch):
    rows = [(i, f"the river runs {i}", f"s{i % 3}", None if i % 7 == 0 else "en") for i in range(60)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one = sorted(map(tuple, quality.score(docs, lab).collect()))
    monkeypatch.setattr(quality, "MOST_SITES", 0)
    assert [r[:3] for r in sorted(map(tuple, quality.score(docs, lab).collect()))] == [r[:3] for r in one] and len(one) == 60


# ---------------------------------------------------------------- common


def test_the_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_release_deletes_its_owner_s_tables_only(spark):
    with common.staging_for("one"):
        a = common.stage(spark.range(3), "x")
    with common.staging_for("two"):
        b = common.stage(spark.range(4), "x")
    common.release_staged("one")
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_drop_ids_with_clashing_columns(spark):
    df = spark.createDataFrame([(i if i else None, i, i) for i in range(50)], "doc_id long, gone long, _gone long")
    assert sorted(r["gone"] for r in common.drop_ids(df, df.where("gone % 2 = 0").select("gone")).collect()) == [0, *range(1, 50, 2)]
    assert common.free_names(["Gone", "_gone"], "gone", "x") == ["__gone", "x"]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path, docs, texts):
    import corpus_pipeline
    import sentencepiece

    base = docs.where("doc_id = 9").first()["text"]
    own = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"])
    own.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, base)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rows = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}  # one language: the model is sure
    first = {}
    for i in sorted(rows):
        first.setdefault(low(rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    pairs = {(i, j): jaccard(rows[i], rows[j]) for i in rows for j in rows if i < j}
    assert not [x for x in pairs.values() if 0.66 < x < 0.84]  # none in doubt
    part = {i: i for i in rows}
    for _ in rows:
        for (i, j), x in pairs.items():
            if x > 0.8:
                part[i] = part[j] = min(part[i], part[j])
    rows = {i: t for i, t in rows.items() if part[i] == i}
    rows = {i: t for i, t in rows.items() if not brute_hits(t, [(1, base)])[1]}
    assert set(got) == set(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert all(got[i]["ids"] == lib.encode(t) for i, t in rows.items())


def test_entry_without_this_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import re, sys; sys.modules['inkveil.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'naive_mask' in e.queries() and not [k for k in e.queries() if re.match('op[0-9]', k)] and 'pipeline' not in e.queries()"
    root = Path(__file__).resolve().parents[2]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
