"""Operator 7: personal data, by patterns and a linear-chain conditional random field.

Base spans come from the contract's four patterns with their checks.  The random field adds spans
that the patterns miss (telephone numbers without a plus sign, dotted card numbers, addresses with
a spelled-out sign and the like); an added span never touches a base span.

The field labels words by shape.  A word is a run of non-space.  Candidates are words with a digit,
an @ or a bracketed at or dot, the words of a spelled-out address (local part, at, name, dot, name;
without a dot word only if the at is bracketed, as "look at example.com" is no address), and a lone
hyphen or slash between two words with digits.  Any other word can only be O, a constraint of the
model, so a document's chain falls into independent segments between such words and is decoded
exactly by decoding those.  Segments of equal length are decoded
together by Viterbi in numpy.  The model is trained on the labelled table below (a few hundred
rows once its number slots are filled), by gradient ascent on the penalised log-likelihood.

Counts (n_email ...) and base_sha256 are of the base spans; ``spans`` lists base and added ones.

Cases: null text counts as empty; identifiers are passed through, nulls and repetitions included;
long words and texts are scanned in linear time; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, text_buffers

#: Bytes of text whose words' features are held at once (a longer text is handled alone).
CHUNK = 1 << 18
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits that fails from its start fails from inside it too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, whatever zeros stand in front."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: every match has one @, with the run of local characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind as listed."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(octet(p) for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# ---------------------------------------------------------------- labelled table

#: [kind|text] marks a span; 9 is any digit, C a card number that passes its check, N one that
#: doesn't, H a long hexadecimal string, W any word.
TABLE = (
    "call me at [phone|(999) 999-9999] tomorrow",
    "call [phone|(999) 999 9999] now",
    "W [phone|(999) 999-9999] W",
    "tel. [phone|999-999-9999].",
    "phone: [phone|999-999-9999], W",
    "phone [phone|999.999.9999]",
    "W W [phone|999-999-9999] W",
    "fax [phone|(999)999-9999] W",
    "ring [phone|1-999-999-9999] today",
    "W [phone|+1 (999) 999-9999] W",
    "W [phone|+49 99 9999 9999] W",
    "mobile [phone|0999 999 9999] W",
    "tel [phone|0999 9999999] W",
    "W [email|w.99@w9.example.com] W",
    "W [email|ww@w.org]. W",
    "mail [email|w@w] or W",
    "write to [email|w99@w], W",
    "W [ip|99.999.99.999] W",
    "host [ip|999.99.9.99]: W",
    "W [card|C] W",
    "card [card|C], W",
    "pay with [card|Cdots] W",
    "visa [card|Cdots].",
    "W N W",
    "order N, W",
    "number N. W",
    "W N!! W",
    "W 99 W",
    "W 9 W",
    "in 1999 W",
    "W 9999 W",
    "W 99999 W",
    "version 9. W",
    "version 9.9. W",
    "Version 9.9.9 W",
    "BY-NC 4.0. W",
    "W W-9.9 W",
    "page 99, line 999 W",
    "on 9999-99-99 W",
    "at 99:99:99 W",
    "W 99/99/9999 W",
    "W 999,999 W",
    "W $99.99 W",
    "W 99% W",
    "W 9.99 W",
    "W 99-99 W",
    "W 999-999 W",
    "ISBN 999-9-99-999999-9 W",
    "token = \"H\" W",
    "W password=H W",
    "W AKIAH W",
    "W H W",
    "W 999.999.999.999.999 W",
    "W 999 99 9 W",
    "W 9 9 9 W",
    "W (9) W",
    "W (99) W",
    "W [9] W",
    "item 999-9999 W",
    "W W99 W9W W",
    "W 9999 9999 W",
    "W @ W",
    "W @W99 W",
    "see @W W",
    # spelled-out addresses ({ and } become square brackets) and lone joiners
    "write to [email|W at W dot com] W",
    "mail [email|W at W dot org].",
    "W [email|W at W dot W dot net] W",
    "W [email|W dot W at W dot com], W",
    "W [email|W (at) W (dot) com] W",
    "W [email|W {at} W {dot} org], W",
    "W [email|W {at} W.com] W",
    "W [email|W{at}W{dot}com] W",
    "W [email|W(at)W.org] W",
    "W [email|w99 at W dot com] W",
    "W [email|W@W dot com] W",
    "call [phone|(999) - 999 - 9999] W",
    "W [phone|999 - 999 - 9999] W",
    "tel [phone|999 / 999 - 9999].",
    "look at the dot on W",
    "W at a dot W",
    "W at this dot in W",
    "W (at) the W",
    "W 9 - 9 W",
    "pages 99 - 99 W",
    "W 999 - 999 W",
    "W 9999 - 9999 W",
    "W 9999 - 99 - 99 W",
    "W 99 / 99 W",
    "W 99 / 99 / 9999 W",
)
REPEATS = 8


def labelled_table(seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The rows with their slots filled: (text, spans)."""
    draw = random.Random(seed)

    def card(valid: bool) -> str:
        while True:
            d = draw.choice("3456") + "".join(draw.choice("0123456789") for _ in range(15))
            if luhn(d) is valid:
                return d

    def fill(part: str) -> str:
        part = part.replace("Cdots", ".".join(re.findall("....", card(True))))
        part = re.sub(r"\bC\b", lambda _: card(True), part)
        part = re.sub(r"\bN\b", lambda _: card(False), part)
        part = re.sub(r"H\b", lambda _: "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice((16, 18, 40)))), part)
        part = re.sub(r"W", lambda _: "".join(draw.choice("aeionrst") for _ in range(draw.randint(2, 9))), part)
        part = part.replace("{", "[").replace("}", "]")
        return re.sub(r"9", lambda _: draw.choice("0123456789"), part)

    rows = []
    for row in TABLE:
        for _ in range(REPEATS):
            text, spans = "", []
            for kind, inner, plain in re.findall(r"\[(\w+)\|([^\]]*)\]|([^\[]+|\[)", row):
                piece = fill(inner or plain)
                if kind:
                    spans.append((kind, len(text), len(text) + len(piece)))
                text += piece
            rows.append((text, spans))
    return rows


# ---------------------------------------------------------------- words and features

_EDGE = "\"'.,;:!?*#$&%|<>[]{}"


def trim(word: str) -> tuple[int, int]:
    """The word without punctuation around it, as (start, end)."""
    s = len(word) - len(word.lstrip(_EDGE))
    e = len(word.rstrip(_EDGE))
    return (s, e) if s < e else (0, len(word))


@cache
def _shape_char(c: str) -> str:
    return "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c


def shape(word: str) -> str:
    """Runs of one class with their lengths: (555) -> (d3)."""
    out, last, n = [], "", 0
    for c in [*map(_shape_char, word[:64]), ""]:
        if c == last and c in "dxX":
            n += 1
            continue
        if last:
            out.append(f"{last}{n}" if last in "dxX" else last)
        last, n = c, 1
    return "".join(out)


_WORD = re.compile(r"\S+")
_SPECIAL = re.compile(r"[0-9@]")
_JOINER = re.compile(r"[\[(]?(at|dot)[\])]?", re.I)
_TOP = frozenset("com org net edu gov info io co de fr es it uk eu ch at nl".split())
#: What a text with a spelled-out address has; Arrow reads it too.
SPELLED = r"(?i)dot|[\[(]at[\])]"
_SPELLED = re.compile(SPELLED)
_BRACKETED = re.compile(r"[\[(](?:at|dot)[\])]", re.I)
# from starts of words only and without backtracking, for linear time
_DOTS = r"(?:\s++(?:dot|\(dot\)|\[dot\])\s++\S++)"
_ADDRESS = re.compile(rf"(?<!\S)(?:\S++{_DOTS}*+\s++(?:at\s++\S++{_DOTS}++|(?:\(at\)|\[at\])\s++\S++{_DOTS}*+)|[^\s@]++@\S++{_DOTS}++)", re.I)
_LONE = frozenset("-/\u2013")


def features(words: list[str], before: str, after: str) -> list[list[str]]:
    """Of each word of a segment; before and after are the plain words around it."""
    shapes = [m[1].upper() if (m := _JOINER.fullmatch(w)) else shape(w) for w in words]
    out = []
    for i, (word, own) in enumerate(zip(words, shapes, strict=True)):
        digits = "".join(_DIGITS.findall(word))
        n = len(digits)
        f = ["bias", f"s={own}", f"c={re.sub(r'[0-9]+', '', own)}", f"d={n if n < 5 else 8 if n < 9 else 11 if n < 12 else 15 if n < 16 else 19 if n < 20 else 99}"]
        f += [f"has{c}" for c in "@.-()+/:=" if c in word]
        if 12 <= n <= 19:
            f += [f"luhn={luhn(digits)}", f"luhn={luhn(digits)}|s={own}"]
        parts = word.split(".")
        f.append(f"octets={len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
        f.append(f"p={shapes[i - 1] if i else before.lower()[:32]}")
        f.append(f"n={shapes[i + 1] if i + 1 < len(words) else 'end'}")
        f.append(f"p={shapes[i - 1] if i else 'begin'}|s={own}")
        f.append(f"only={len(words) == 1}|s={own}")
        if i + 1 == len(words):
            f.append(f"a={after.lower()[:32]}")
        if not _SPECIAL.search(word):
            f += [f"w={word.lower()[:32]}", f"top={word.lower().rpartition('.')[2] in _TOP}"]
        out.append(f)
    return out


def segments(text: str) -> list[tuple[list[tuple[int, int]], list[str], str, str]]:
    """(word places, words, word before, word after) for each run of candidates."""
    out, run, last, held, digits = [], [], "", None, False
    spelled = bool(_SPELLED.search(text))
    addresses = _ADDRESS.finditer(text) if spelled else iter(())
    address = next(addresses, None)

    def place(m):
        s, e = trim(m[0])
        return m.start() + s, m.start() + e

    def close(after):
        out.append((run, [text[s:e] for s, e in run], before, after))

    for m in _WORD.finditer(text):
        while address and address.end() <= m.start():
            address = next(addresses, None)
        word = m[0]
        inside = address is not None and address.start() <= m.start()
        marked = bool(_SPECIAL.search(word)) or inside or (spelled and bool(_BRACKETED.search(word)))
        if held and not (marked and _DIGITS.search(word)):
            close(held[0])
            run, held = [], None
        if marked:
            if not run:
                before = last
            if held:
                run.append(place(held))
                held = None
            run.append(place(m))
            digits = bool(_DIGITS.search(word))
        elif run and digits and word in _LONE:
            held = m
        elif run:
            close(word)
            run = []
        last = word
    if run:
        close(held[0] if held else "")
    return out


# ---------------------------------------------------------------- the field


class Field:
    """Weights: emission (feature x label) and transition (label x label, start in the last row)."""

    def __init__(self, names: dict[str, int], emission: np.ndarray, transition: np.ndarray):
        self.names, self.emission, self.transition = names, emission, transition

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(LABELS)))
        for i, f in enumerate(rows):
            known = [self.names[x] for x in f if x in self.names]
            out[i] = self.emission[known].sum(axis=0)
        return out

    def decode(self, emissions: np.ndarray) -> np.ndarray:
        """Viterbi over a batch of segments of one length: (segments, words, labels) -> labels."""
        n, length, _ = emissions.shape
        best = emissions[:, 0] + self.transition[-1]
        back = np.zeros((n, length, len(LABELS)), np.int64)
        for t in range(1, length):
            step = best[:, :, None] + self.transition[None, :-1]
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + emissions[:, t]
        path = np.zeros((n, length), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return path


def _forbidden() -> np.ndarray:
    """I of a kind may only follow B or I of it."""
    bad = np.zeros((len(LABELS) + 1, len(LABELS)), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            bad[:, j] = [x[1:] != to[1:] for x in LABELS] + [True]
    return bad


def train(rows=None, steps: int = 150, rate: float = 0.2, penalty: float = 0.02) -> Field:
    """Gradient ascent (Adam) on log-likelihood less penalty * squared weights; deterministic."""
    data = []
    for text, spans in rows if rows is not None else labelled_table():
        for places, words, before, after in segments(text):
            tags = []
            for s, e in places:
                hit = next(((k, a) for k, a, b in spans if a < e and s < b), None)
                tags.append(0 if not hit else LABELS.index(f"{'I' if tags and prev == hit else 'B'}-{hit[0]}"))
                prev = hit
            data.append((features(words, before, after), tags))
    names = {x: i for i, x in enumerate(sorted({x for f, _ in data for w in f for x in w}))}
    longest, n_labels = max(len(t) for _, t in data), len(LABELS)
    word_of, feature_of = [], []
    tags = np.full((len(data), longest), -1)
    for i, (f, t) in enumerate(data):
        tags[i, : len(t)] = t
        for j, w in enumerate(f):
            word_of += [i * longest + j] * len(w)
            feature_of += [names[x] for x in w]
    word_of, feature_of = np.array(word_of), np.array(feature_of)
    live = tags >= 0
    bad = _forbidden()
    emission, transition = np.zeros((len(names), n_labels)), np.zeros((n_labels + 1, n_labels))
    transition[bad] = -1e4
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (emission, transition)]

    def log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for step in range(1, steps + 1):
        flat = np.zeros((len(data) * longest, n_labels))
        np.add.at(flat, word_of, emission[feature_of])
        e = flat.reshape(len(data), longest, n_labels)
        ahead = np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + transition[-1]
        for t in range(1, longest):
            new = log_sum(ahead[:, t - 1, :, None] + transition[None, :-1], 1) + e[:, t]
            ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
        total = log_sum(ahead[:, -1], 1)
        behind = np.zeros_like(e)
        g_emit, g_move = np.zeros_like(flat).reshape(e.shape), np.zeros_like(transition)
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                more = live[:, t + 1]
                inner = transition[None, :-1] + (e[:, t + 1] + behind[:, t + 1])[:, None, :]
                behind[:, t] = np.where(more[:, None], log_sum(inner, 2), 0)
                pair = np.exp(ahead[:, t, :, None] + inner - total[:, None, None]) * more[:, None, None]
                g_move[:-1] -= pair.sum(axis=0)
                np.add.at(g_move, (tags[more, t], tags[more, t + 1]), 1)
            here = np.exp(ahead[:, t] + behind[:, t] - total[:, None]) * live[:, t, None]
            g_emit[:, t] -= here
            g_emit[live[:, t], t, tags[live[:, t], t]] += 1
            if t == 0:
                g_move[-1] -= here.sum(axis=0)
                np.add.at(g_move[-1], tags[:, 0], 1)
        grad = np.zeros_like(emission)
        np.add.at(grad, feature_of, g_emit.reshape(-1, n_labels)[word_of])
        for w, g, (m, v) in zip((emission, transition), (grad, g_move), moments, strict=True):
            g -= penalty * np.where(w < -1e3, 0, w)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        transition[bad] = -1e4
    return Field(names, emission, transition)


def added_spans(field: Field, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the field finds outside the base spans, text by text; all segments in batches."""
    by_length: dict[int, list[tuple[int, list, np.ndarray]]] = {}
    for i, text in enumerate(texts):
        for places, words, before, after in segments(text):
            by_length.setdefault(len(words), []).append((i, places, field.scores(features(words, before, after))))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for group in by_length.values():
        for (i, places, _), path in zip(group, field.decode(np.stack([s for _, _, s in group])).tolist(), strict=True):
            spans: list[list] = []
            for (s, e), label in zip(places, path, strict=True):
                name = LABELS[label]
                if name[0] == "B":
                    spans.append([name[2:], s, e])
                elif name[0] == "I":
                    spans[-1][2] = e
            out[i] += [tuple(x) for x in spans if not any(x[1] < e and s < x[2] for _, s, e in base[i])]
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_MARK = np.zeros(256, bool)
_MARK[[0x40, *range(0x30, 0x3A)]] = True


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text), found (array of structs)."""
    field = field or train()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            marked = np.concatenate([[0], np.cumsum(_MARK[data])])
            spelled = pc.match_substring_regex(batch.column(1), SPELLED).fill_null(False).to_numpy(zero_copy_only=False)
            some = np.flatnonzero((marked[offsets[1:]] > marked[offsets[:-1]]) | spelled)
            n = len(offsets) - 1
            counts = {k: np.zeros(n, np.int64) for k in KINDS}
            digests, shown, found = [empty] * n, [""] * n, [[] for _ in range(n)]
            for a, b in chunks(offsets, CHUNK):
                rows = some[(some >= a) & (some < b)]
                texts = batch.column(1).take(pa.array(rows)).to_pylist()
                base = [base_spans(t) for t in texts]
                for i, spans, extra in zip(rows.tolist(), base, added_spans(field, texts, base), strict=True):
                    for k, _, _ in spans:
                        counts[k][i] += 1
                    digests[i] = hashlib.sha256(_joined(spans).encode()).hexdigest()
                    every = sorted([(*x, False) for x in spans] + [(*x, True) for x in extra], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                    shown[i] = _joined(x[:3] for x in every)
                    found[i] = [{"kind": k, "start": s, "end": e, "added": a} for k, s, e, a in every]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k]) for k in KINDS), pa.array(digests, pa.string()), pa.array(shown, pa.string()), pa.array(found, kind)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long, added: boolean>>"
    )
