"""The operators on documents of Arrow batches, in plain Python: detection, scanning, routing,
rewriting and scoring.

A document's whole work takes one visit of a Python worker for each of prepare, rewrite and score;
the same steps as nested column expressions are interpreted node by node and took five visits.  The
expressions in ``rewrite``, ``routing`` and ``detect`` remain for single values and for tests.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as C

#: Characters beside A-Z and a-z that ignoring case takes for one of them (long s, Kelvin sign,
#: dotless and dotted i), and the letters they stand for.
ODD_CASE, PLAIN_CASE = "\u017f\u212a\u0131\u0130", "skii"
_ODD = [(a.encode(), b.encode()) for a, b in zip(ODD_CASE, PLAIN_CASE, strict=True)]
#: Rows whose values are Python objects at a time.
ROWS = 500

Span = tuple[int, int, int, int, str, str]  # start, start - end, priority, end, pattern, text


# ---------------------------------------------------------------- detection

#: Patterns without a literal: every match has so many bytes of a class in a row.  Digits beyond
#: ASCII, which \d takes too, are more than one byte each and count as of the class of capitals.
_RUNS = {"discord_token": ("alnum", 24), "credit_card": ("digits", 13), "iban": ("capitals", 15), "crypto_private_key": ("alnum", 51)}
_DIGITS, _CAPITALS = frozenset(b"0123456789"), frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = {"alnum": _DIGITS | _CAPITALS | {x + 32 for x in _CAPITALS}, "digits": _DIGITS, "capitals": _DIGITS | _CAPITALS | frozenset(range(128, 256))}
_RUN_TABLES = {n: bytes(97 if i in own else 32 for i in range(256)) for n, own in _CLASSES.items()}


@cache
def _compiled() -> list[tuple[re.Pattern, bool, tuple[bytes, ...], tuple[str, bytes] | None, int, str]]:
    runs = {n: (kind, b"a" * size) for n, (kind, size) in _RUNS.items()}
    return [(re.compile(p.regex, re.I if p.ignore_case else 0), p.ignore_case, tuple(x.encode() for x in p.literals), runs.get(p.name), i, p.name) for i, p in enumerate(C.PATTERNS)]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _lower(data: bytes) -> bytes:
    """Without the case of letters: literals are of ASCII."""
    if not data.isascii():
        for odd, plain in _ODD:
            data = data.replace(odd, plain)
    return data.lower()


class Gates:
    """The patterns that can match in any of some texts: most are ruled out for all at once.  Bytes
    are searched, as in a text beyond ASCII every letter costs a look-up otherwise."""

    def __init__(self, texts: list[str]):
        whole = _bytes("\n".join(texts))
        low = _lower(whole)
        self.active = []
        for regex, fold, literals, run, prio, name in _compiled():
            where = low if fold else whole
            there = tuple(x for x in literals if x in where)
            if there or (not literals and not (run and run[1] not in whole.translate(_RUN_TABLES[run[0]]))):
                self.active.append((regex, fold, there, run, prio, name))
        self.folds = any(x[1] for x in self.active)

    def of(self, text: str) -> Iterator[tuple[re.Pattern, int, str]]:
        """Those that can match in one of the texts."""
        data = _bytes(text)
        low = _lower(data) if self.folds else data
        for regex, fold, literals, run, prio, name in self.active:
            if literals:
                where = low if fold else data
                for x in literals:
                    if x in where:
                        break
                else:
                    continue
            elif run and run[1] not in data.translate(_RUN_TABLES[run[0]]):
                continue
            yield regex, prio, name


def find(text: str, gates: Gates | None = None) -> list[Span]:
    """All matches of all patterns in one text, by start, then the longer, then the pattern's order."""
    out = []
    for regex, prio, name in (gates or Gates([text])).of(text):
        for m in regex.finditer(text):
            s, e = m.span()
            out.append((s, s - e, prio, e, name, m[0]))
    if len(out) > 1:
        out.sort()
    return out


def disjoint(spans: list[Span]) -> list[Span]:
    """Greedy from the left: a span stays if it begins at or after the end of the last that stayed."""
    kept, last = [], 0
    for x in spans:
        if x[0] >= last:
            kept.append(x)
            last = x[3]
    return kept


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "neg_len", "prio", "end")] + [T.StructField(n, T.StringType()) for n in ("pattern", "text")]))
_INT, _TEXT, _REAL = pa.int32(), pa.string(), pa.float64()


def _parts(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    for at in range(0, len(columns[0]), ROWS):
        yield tuple(c.slice(at, ROWS) for c in columns)


def _lists(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    """A column of lists of structs from lists of tuples."""
    ends, flat = [0], []
    for x in rows:
        flat += x
        ends.append(len(flat))
    columns = list(zip(*flat, strict=True)) or [()] * len(names)
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    return pa.ListArray.from_arrays(pa.array(ends, _INT), values)


def _strings(rows: list) -> pa.Array:
    ends, flat = [0], []
    for x in rows:
        flat += x
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, _INT), pa.array(flat, _TEXT))


def _maps(rows: list, kind: pa.DataType) -> pa.Array:
    ends, keys, values = [0], [], []
    for x in rows:
        keys += x.keys()
        values += x.values()
        ends.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(ends, _INT), pa.array(keys, _TEXT), pa.array(values, kind))


def span_column(rows: list[list[Span]]) -> pa.Array:
    return _lists(rows, SPAN_TYPE.elementType.names, [_INT] * 4 + [_TEXT] * 2)


def _joined(parts: list[pa.Array], empty: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], empty)


SPAN_ARROW = pa.list_(pa.struct([(n, _INT) for n in ("start", "neg_len", "prio", "end")] + [(n, _TEXT) for n in ("pattern", "text")]))


def span_arrays(text: pa.Array, chosen=lambda x: x) -> pa.Array:
    out = []
    for (part,) in _parts(text):
        texts = [t or "" for t in part.to_pylist()]
        gates = Gates(texts)
        out.append(span_column([chosen(find(t, gates)) for t in texts]))
    return _joined(out, SPAN_ARROW)


def span_lists(spans: pa.Array) -> list[list[Span]]:
    """The spans of a slice of rows; a null has none."""
    ends = spans.offsets.to_pylist()
    first = ends[0] if ends else 0
    values = spans.values.slice(first, (ends[-1] if ends else 0) - first)
    rows = list(zip(*(values.field(n).to_pylist() for n in SPAN_TYPE.elementType.names), strict=True))
    return [rows[a - first : b - first] for a, b in zip(ends, ends[1:], strict=False)]


# ---------------------------------------------------------------- scans

SCAN_TYPE = T.StructType([T.StructField("sensitive", T.BooleanType())] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("categories", "matched_patterns", "evidence")])
SHOWN, SHOWN_CHARS = 3, 120
_SCAN_ARROW = pa.struct([("sensitive", pa.bool_())] + [(n, pa.list_(_TEXT)) for n in ("categories", "matched_patterns", "evidence")])


@F.arrow_udf(SCAN_TYPE)
def scanned(text: pa.Array) -> pa.Array:
    """struct<sensitive, categories, matched_patterns, evidence> of a text."""
    out = []
    for (part,) in _parts(text):
        texts = [t or "" for t in part.to_pylist()]
        gates = Gates(texts)
        names, categories, evidence = [], [], []
        for t in texts:
            found, shown = [], []
            for regex, _, name in gates.of(t):
                group, n = min(regex.groups, 1), 0
                for m in regex.finditer(t):
                    shown.append(f"[{name}] {(m[group] or '')[:SHOWN_CHARS]}")
                    n += 1
                    if n == SHOWN:
                        break
                if n:
                    found.append(name)
            names.append(found)
            evidence.append(shown)
            categories.append(sorted({C.CATEGORY[x] for x in found}))
        out.append(pa.StructArray.from_arrays([pa.array([bool(x) for x in names], pa.bool_()), _strings(categories), _strings(names), _strings(evidence)], SCAN_TYPE.names))
    return _joined(out, _SCAN_ARROW)


# ---------------------------------------------------------------- routing

_JAVA, _PYTHON, _EXCEPTION, _KEY = (re.compile(x) for x in (C.JAVA_FRAME, C.PYTHON_FRAME, C.EXCEPTION, C.CONFIG_KEY))


def is_frame(line: str) -> bool:
    return bool(("(" in line and _JAVA.search(line)) or ('File "' in line and _PYTHON.search(line)))


def _framed(text: str) -> bool:
    """Whether any line can be a frame."""
    return "at" in text and "(" in text or 'File "' in text


def exceptions(text: str) -> list[str]:
    return _EXCEPTION.findall(text) if "Exception" in text or "Error" in text or "Traceback" in text else []


def config_keys(text: str) -> list[str]:
    return _KEY.findall(text) if ":" in text or "=" in text else []


def metadata(text: str, spans: list[Span]) -> tuple:
    lines = text.splitlines()
    counts: dict[str, int] = {}
    for name in sorted(x[4] for x in spans):
        counts[name] = counts.get(name, 0) + 1
    frames = sum(map(is_frame, lines)) if _framed(text) else 0
    return frames, len(exceptions(text)), len(config_keys(text)), len(lines), len(spans), counts


def kind(meta: tuple, spans: list[Span]) -> str:
    """Stack traces first; then more than one family; then the one family there is."""
    frames, errors, n_keys, n_lines, total, counts = meta
    there = {C.FAMILY[x] for x in counts}
    keys = n_keys >= 3
    if "stack" in there or frames >= 2 or (errors >= 1 and n_lines >= 3):
        return "stack_trace"
    if len(there) + keys >= 2:
        return "mixed_artifact"
    if "network" in there:
        return "network_artifact"
    if keys:
        return "config_blob"
    for family, name in (("credential", "secret_blob"), ("identifier", "identifier_blob"), ("path", "filesystem_trace")):
        if family in there:
            return name
    return "clean_text" if not total else "mixed_artifact"


_META_INTS = ["frame_hits", "exception_hits", "config_key_hits", "n_lines", "total_spans"]
META_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in _META_INTS] + [T.StructField("pattern_counts", T.MapType(T.StringType(), T.IntegerType()))])
PREPARED_TYPE = T.StructType([T.StructField("spans", SPAN_TYPE), T.StructField("metadata", META_TYPE), T.StructField("artifact_kind", T.StringType())])
_META_ARROW = pa.struct([(n, _INT) for n in _META_INTS] + [("pattern_counts", pa.map_(_TEXT, _INT))])


@F.arrow_udf(PREPARED_TYPE)
def prepared(text: pa.Array) -> pa.Array:
    """struct<spans, metadata, artifact_kind>: detection and classification of a text."""
    out = []
    for (part,) in _parts(text):
        texts = [t or "" for t in part.to_pylist()]
        gates = Gates(texts)
        spans = [disjoint(find(t, gates)) for t in texts]
        meta = [metadata(t, s) for t, s in zip(texts, spans, strict=True)]
        kinds = [kind(m, s) for m, s in zip(meta, spans, strict=True)]
        columns = [pa.array([m[i] for m in meta], _INT) for i in range(5)] + [_maps([m[5] for m in meta], _INT)]
        out.append(pa.StructArray.from_arrays([span_column(spans), pa.StructArray.from_arrays(columns, META_TYPE.names), pa.array(kinds, _TEXT)], PREPARED_TYPE.names))
    return _joined(out, pa.struct([("spans", SPAN_ARROW), ("metadata", _META_ARROW), ("artifact_kind", _TEXT)]))


# ---------------------------------------------------------------- rewriting


class Bank:
    """A document's placeholders: equal values of a type get one name, a name that is taken is drawn
    again until it is free."""

    def __init__(self, salt: str | None, name: Callable[..., str]):
        self.salt, self.name, self.names, self.taken = salt, name, {}, {}

    def get(self, kind: str, value: str) -> str:
        own = self.names.get((kind, value))
        if own is None:
            attempt, own = 0, self.name(self.salt, kind, value)
            while own in self.taken:
                attempt += 1
                own = self.name(self.salt, kind, value, attempt)
            self.names[kind, value] = own
            self.taken[own] = value
        return own


_RX = {n: re.compile(getattr(C, n)) for n in ("BENIGN_KEYWORD", "BENIGN_ENUM", "SENSITIVE_KEY", "KEY_LINE", "CREDENTIAL_PREFIX", "MESSAGE_PATH", "PRIVATE_IP", "KEYWORD_VALUE", "UNIX_USER", "WINDOWS_USER", "PATH_TAIL")}
_IPS = [(k, re.compile(x)) for k, x in C.IP_CLASSES]
_SCHEME = re.compile(r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(.*)$")
_NET = re.compile(r"(?s)^//([^/?#]*)(.*)$")
_DB_NAME = re.compile(r"^[A-Za-z0-9_.-]{1,64}$")
_HIGH_REWRITE, _HIGH_SCORE = frozenset(C.HIGH_RISK_REWRITE), frozenset(C.HIGH_RISK_SCORE)
_URIS = frozenset(C.URI_PATTERNS)


def suppressed(pattern: str) -> str:
    return f"<SUPPRESSED:{C.LABEL.get(pattern, pattern.upper())}>"


def _octets(ip: str) -> str:
    return ".".join(ip.split(".")[:3]) + ".x"


def _ip(bank: Bank, value: str, network: bool) -> str:
    if network:
        return _octets(value) if value.count(".") == 3 else "<IP>"
    return bank.get(next((k for k, x in _IPS if x.search(value)), "IP_PRIVATE"), value)


def _path_parts(value: str) -> list[str]:
    return [p for p in value.replace("\\", "/").split("/") if p]


def _path(bank: Bank, value: str, windows: bool) -> str:
    parts = _path_parts(value)
    if not parts:
        return bank.get("PATH", value)
    n = len(parts)
    kept = min(n, 2)
    home = "Users" in parts[:3] if windows else parts[0] == "home" and n > 1
    root = ("WIN" if windows else "UNIX") + ("_HOME" if home else "_ROOT")
    return bank.get(root, "/".join(parts[: n - kept])) + ("/…/" if n > kept else "/") + "/".join(parts[n - kept :])


def _host(bank: Bank, host: str, network: bool) -> str:
    low = host.lower()
    if low in C.LOCAL_HOSTS:
        return "<LOCALHOST>"
    for k, x in _IPS:
        if x.search(host):
            return _octets(host) if network else bank.get(k, host)
    if low.endswith(C.PRIVATE_SUFFIXES):
        return "<HOST>." + low.rsplit(".", 1)[-1] if network else bank.get("PRIVATE_HOST", host)
    return host


def _uri(bank: Bank, value: str, network: bool) -> str:
    clean = re.sub(r"[\t\n\r]", "", value)
    m = _SCHEME.search(clean)
    scheme, rest = (m[1], m[2]) if m else ("", clean)
    m = _NET.search(rest)
    net, rest = (m[1], m[2]) if m else ("", rest)
    if ("[" in net) != ("]" in net):
        return "<" + (value.split("://", 1)[0].upper() if "://" in value else "URI") + "_MALFORMED>"
    path = re.split("[?#]", rest, maxsplit=1)[0]
    host = net.rsplit("@", 1)[-1].split(":", 1)[0]
    return f"<{(scheme or 'uri').upper()}>://" + _host(bank, host, network) + ("" if path == "/" else path)


def _connection(bank: Bank, value: str) -> str:
    out = []
    for x in value.split(";"):
        if "=" not in x:
            continue
        key, val = (y.strip() for y in x.split("=", 1))
        low = key.lower()
        if low in ("password", "pwd"):
            val = bank.get("DB_PASS", val)
        elif low in ("user id", "uid", "username"):
            val = bank.get("DB_USER", val)
        elif low in ("server", "data source"):
            val = _host(bank, val, False)
        elif low in ("database", "initial catalog") and not _DB_NAME.fullmatch(val):
            val = bank.get("DB_NAME", val)
        out.append(f"{key}={val}")
    return ";".join(out)


def _abstract(bank: Bank, pattern: str, value: str, network: bool) -> str:
    if pattern == "internal_ip":
        return _ip(bank, value, network)
    if pattern in ("unix_path", "windows_path"):
        return _path(bank, value, pattern == "windows_path")
    if pattern in _URIS:
        return _uri(bank, value, network)
    if pattern == "connection_string_kv":
        return _connection(bank, value)
    return bank.get(C.LABEL.get(pattern, pattern.upper()), value)


def _generalize(bank: Bank, value: str, windows: bool, keep_tail: int = 2) -> str:
    parts = _path_parts(value)
    if not parts:
        return bank.get("PATH", value)
    n, first, sep = len(parts), parts[0], "\\" if windows else "/"
    root, skip = "WIN_ROOT" if windows else "UNIX_ROOT", 1
    if windows and n > 2 and parts[1].lower() == "users":
        root, skip = "WIN_HOME", 3
    elif not windows and n > 1 and first == "home":
        root, skip = "UNIX_HOME", 2
    elif not windows and first in C.SYSTEM_ROOTS:
        root = "SYS_" + first.upper()
    begin = max(skip, n - keep_tail)
    rest = "" if n <= begin else sep + ("…" + sep if begin > skip else "") + sep.join(parts[begin:])
    return bank.get(root, sep.join(parts[:skip])) + rest


def benign(value: str) -> bool:
    v = value.strip()
    return bool(_RX["BENIGN_KEYWORD"].search(v) or _RX["BENIGN_ENUM"].search(v))


def homes(text: str) -> str:
    return _RX["WINDOWS_USER"].sub(lambda _: r"C:\Users\<USER>", _RX["UNIX_USER"].sub("/home/<USER>", text))


def _keys(bank: Bank, text: str) -> str:
    """Lines ``key = value`` with a sensitive key and a telling value lose the value."""

    def line(m):
        bare = m[4].strip()
        inner = bare.strip("\"'")
        if not inner or not _RX["SENSITIVE_KEY"].search(m[2]) or benign(inner):
            return m[0]
        quote = bare[0] if bare[0] in "\"'" else ""
        return m[1] + m[2] + m[3] + quote + bank.get("SECRET_VALUE", inner) + quote

    return _RX["KEY_LINE"].sub(line, text)


def _hide_paths(line: str) -> str:
    return _RX["PRIVATE_IP"].sub("<IP_PRIVATE>", _RX["MESSAGE_PATH"].sub("<PATH_REDACTED>", line))


def _message(message: str) -> str:
    out = _RX["CREDENTIAL_PREFIX"].sub("<CREDENTIAL_REDACTED>", _hide_paths(message))
    return out[:300] + ("..." if len(out) > 300 else "")


def _source(line: str) -> str:
    out, at = [], 0
    for s, _, _, e, pattern, _ in disjoint(find(line)):
        out += (line[at:s], f"<{pattern.upper()}>")
        at = e
    return _RX["KEYWORD_VALUE"].sub(r"\1<SECRET_VALUE>", _hide_paths("".join(out) + line[at:]))


def _exception_line(bare: str, exc: str) -> str:
    at = bare.find(exc)
    rest = bare[at + len(exc) :].strip().lstrip(":").strip()
    return bare[:at] + exc + (": " + _message(rest) if rest else "")


def summarize(text: str) -> str:
    """Frames and headers stay, values go."""
    out, skip, after_frame = [], False, False
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            after_frame = False
            out.append("")
            continue
        if bare.lower() in C.LOCALS_HEADERS:
            skip = True
            continue
        if skip and line[0] in " \t":
            continue
        was, skip, after_frame = after_frame, False, False
        if bare in C.TRACE_HEADERS:
            out.append(line)
        elif is_frame(line):
            after_frame = True
            out.append(line)
        elif was and len(line) > 3 and line[:4].isspace():
            if bare.startswith(("raise ", "throw ", "assert ")):
                exc = _EXCEPTION.search(bare)
                out.append("    " + bare.split(None, 1)[0] + (f" {exc[1]}(...)" if exc else "(...)"))
            else:
                out.append(_source(line))
        elif exc := _EXCEPTION.search(bare):
            out.append(_exception_line(bare, exc[1]))
        else:
            out.append(_hide_paths(line))
    return "\n".join(out)


def rewrite(text: str, spans: list[Span], kind: str | None, ops: list[str] | None, bank: Bank, key_aware: bool = True) -> tuple[str, str]:
    """(mode, rewritten text)."""
    if ops is not None and not ops:
        return "none", text
    ops = ops or ()
    if "SUMMARIZE" in ops:
        return "SUMMARIZE", summarize(text)
    mode = "CANONICALIZE" if "CANONICALIZE" in ops else "GENERALIZE" if "GENERALIZE" in ops else "spans"
    if mode == "CANONICALIZE":
        text = homes(text)
        spans = disjoint(find(text))
    plain = mode == "spans"
    suppressing, network = plain and "SUPPRESS" in ops, plain and kind == "network_artifact"
    out, at = [], 0
    for start, _, _, end, pattern, value in spans:
        out.append(text[at:start])
        at = end
        if suppressing and pattern in _HIGH_REWRITE:
            out.append(suppressed(pattern))
        elif mode == "GENERALIZE" and pattern in ("unix_path", "windows_path"):
            more = _RX["PATH_TAIL"].match(text[end : end + 513])
            more = more[1] if more else ""
            at += len(more)
            out.append(_generalize(bank, value + more, pattern == "windows_path"))
        elif mode == "CANONICALIZE" and text[max(start - 60, 0) : start].rstrip().endswith((":", "=")) and benign(value):
            out.append(value)
        else:
            out.append(_abstract(bank, pattern, value, network))
    out.append(text[at:])
    done = "".join(out)
    return mode, _keys(bank, done) if mode == "CANONICALIZE" and key_aware else done


_COUNTS = ["high_risk_span_count", "high_risk_suppress_count", "high_risk_abstract_count"]
REWRITTEN_TYPE = T.StructType(
    [T.StructField("out_text", T.StringType()), T.StructField("placeholders", T.MapType(T.StringType(), T.StringType())), T.StructField("operator_counts", T.MapType(T.StringType(), T.IntegerType()))]
    + [T.StructField(n, T.IntegerType()) for n in _COUNTS]
)
_REWRITTEN_ARROW = pa.struct([("out_text", _TEXT), ("placeholders", pa.map_(_TEXT, _TEXT)), ("operator_counts", pa.map_(_TEXT, _INT))] + [(n, _INT) for n in _COUNTS])


def rewritten_row(text: str, found: list[Span], kind: str | None, ops: list[str] | None, bank: Bank, key_aware: bool) -> tuple:
    """(out_text, placeholders, operator_counts, the three high-risk counts)."""
    mode, done = rewrite(text, found, kind, ops, bank, key_aware)
    high = sum(x[4] in _HIGH_REWRITE for x in found)
    dark = high if mode == "spans" and "SUPPRESS" in (ops or ()) else 0
    n = {"SUPPRESS": dark, "ABSTRACT": len(found) - dark} if mode == "spans" else {} if mode == "none" else {mode: 1}
    told = key_aware or mode != "CANONICALIZE"
    return done, bank.taken, {op: x for op, x in n.items() if x}, high if told else 0, dark, high - dark if mode == "spans" else 0


@F.arrow_udf(REWRITTEN_TYPE)
def rewritten(text: pa.Array, spans: pa.Array, kind: pa.Array, ops: pa.Array, salt: pa.Array, key_aware: pa.Array) -> pa.Array:
    """struct<out_text, placeholders, operator_counts, high-risk counts> of a routed document."""
    from .rewrite import name

    out = []
    for part in _parts(text, spans, kind, ops, salt, key_aware):
        rows = [rewritten_row(t or "", found, k, o, Bank(s, name), aware) for t, found, k, o, s, aware in zip(part[0].to_pylist(), span_lists(part[1]), *(x.to_pylist() for x in part[2:]), strict=True)]
        texts, banks, counts, *highs = zip(*rows, strict=True)
        columns = [pa.array(texts, _TEXT), _maps(banks, _TEXT), _maps(counts, _INT)] + [pa.array(x, _INT) for x in highs]
        out.append(pa.StructArray.from_arrays(columns, REWRITTEN_TYPE.names))
    return _joined(out, _REWRITTEN_ARROW)


# ---------------------------------------------------------------- scoring

METRICS = [
    "residual_matches", "high_risk_residual_matches", "exact_leaks", "high_risk_exact_leaks", "leakage_rate", "structural_risk", "type_disclosure_rate", "linkage_score",
    "safe_token_recall", "exception_recall", "config_key_recall", "frame_recall", "line_ratio", "length_ratio", "privacy_score", "utility_score", "pareto_score",
]
SCORE_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in METRICS])
_SAFE = re.compile(C.SAFE_TOKEN)


def safe_tokens(text: str) -> set[str]:
    return set(_SAFE.findall(text.lower())) if text.isascii() else {x.lower() for x in _SAFE.findall(text)}


def _frames(text: str) -> int:
    if not (_framed(text) or C.FRAME_MARKS[0] in text or C.FRAME_MARKS[1] in text):
        return 0
    return sum(is_frame(x) or C.FRAME_MARKS[0] in x or C.FRAME_MARKS[1] in x for x in text.splitlines())


def _recall(source, candidate) -> float | None:
    return 1.0 if not source else None if candidate is None else len(source & candidate) / len(source)


def _disclosure(ops: list[str] | None, suppressed: int, abstracted: int, n_high: int, n_suppress: int, n_abstract: int) -> float:
    if ops == ["NAIVE_MASK"]:
        return 0.0
    if n_high > 0:
        return (n_suppress * 0.3 + n_abstract * 0.7) / n_high
    return (suppressed * 0.3 + abstracted * 0.7) / (suppressed + abstracted) if suppressed + abstracted > 0 else 0.0


def measures(text: str, out: str | None, spans: list[Span], left: list[Span], disclosure: float) -> tuple:
    """The metrics; those that need an output are null without one."""
    leaked = [x[4] for x in spans if x[5] and out is not None and x[5] in out]
    high_leaks = sum(x in _HIGH_SCORE for x in leaked)
    risk, high_left = 0.0, 0
    for x in left:
        high = x[4] in _HIGH_SCORE
        high_left += high
        risk += 1.0 if high else 0.15
    tokens = [x for x in out.split() if x[0] == "<" and x[-1] == ">"] if out and "<" in out else ()
    bare, at = [], 0
    for x in spans:
        bare.append(text[at : x[0]])
        at = x[3]
    bare.append(text[at:])
    recalls = [_recall(set(f(a)), None if out is None else set(f(out))) for f, a in ((safe_tokens, "".join(bare)), (exceptions, text), (config_keys, text))]
    frames = _frames(text)
    frame_recall = min(_frames(out) / frames, 1.0) if frames and out is not None else 1.0
    line_ratio = min((out.count("\n") + 1) / (text.count("\n") + 1), 1.0) if out is not None else 1.0
    privacy = 1.0 / (1.0 + high_leaks * 5.0 + high_left * 2.0 + risk + disclosure * 0.3)
    utility = None if None in recalls else 0.20 * recalls[0] + 0.25 * recalls[1] + 0.15 * recalls[2] + 0.30 * frame_recall + 0.10 * line_ratio
    return (
        float(len(left)), float(high_left), float(len(leaked)), float(high_leaks), len(leaked) / len(spans) if spans else 0.0, risk, disclosure,
        (len(tokens) - len(set(tokens))) / len(tokens) if tokens else 0.0, *recalls, frame_recall, line_ratio, None if out is None else len(out) / max(len(text), 1),
        privacy, utility, None if utility is None else 0.55 * privacy + 0.45 * utility,
    )


@F.arrow_udf(SCORE_TYPE)
def scores(text: pa.Array, out: pa.Array, spans: pa.Array, ops: pa.Array, suppressed: pa.Array, abstracted: pa.Array, n_high: pa.Array, n_suppress: pa.Array, n_abstract: pa.Array) -> pa.Array:
    """The metrics of a rewritten document, as a struct."""
    parts = []
    for part in _parts(text, out, spans, ops, suppressed, abstracted, n_high, n_suppress, n_abstract):
        outs = part[1].to_pylist()
        gates = Gates([x for x in outs if x])
        rows = []
        for t, o, found, *told in zip(part[0].to_pylist(), outs, span_lists(part[2]), *(x.to_pylist() for x in part[3:]), strict=True):
            rows.append(measures(t or "", o, found, disjoint(find(o, gates)) if o else [], _disclosure(told[0], *(x or 0 for x in told[1:]))))
        parts.append(pa.StructArray.from_arrays([pa.array(c, _REAL) for c in zip(*rows, strict=True)], METRICS))
    return _joined(parts, pa.struct([(n, _REAL) for n in METRICS]))


# ---------------------------------------------------------------- all at once

_BUILT = {
    "artifact_kind": lambda x: pa.array(x, _TEXT),
    "spans": span_column,
    "operators_applied": _strings,
    "out_text": lambda x: pa.array(x, _TEXT),
    "placeholders": lambda x: _maps(x, _TEXT),
    "operator_counts": lambda x: _maps(x, _INT),
    **dict.fromkeys(_COUNTS, lambda x: pa.array(x, _INT)),
    **dict.fromkeys(METRICS, lambda x: pa.array(x, _REAL)),
}
#: What ``handling`` can give of a text.
HANDLED = {
    "artifact_kind": T.StringType(),
    "spans": SPAN_TYPE,
    "operators_applied": T.ArrayType(T.StringType()),
    **{f.name: f.dataType for f in REWRITTEN_TYPE},
    **{f.name: f.dataType for f in SCORE_TYPE},
}


def handled(text: pa.Array, salt: pa.Array, routes: dict[str, list[str]], fields: tuple[str, ...], kinds: frozenset[str] | None, key_aware: bool) -> pa.Array:
    """See ``handling``."""
    from .rewrite import name

    out, scoring = [], not set(fields).isdisjoint(METRICS)
    for part in _parts(text, salt):
        texts, rows = [t or "" for t in part[0].to_pylist()], []
        gates = Gates(texts)
        for t, s in zip(texts, part[1].to_pylist(), strict=True):
            found = disjoint(find(t, gates))
            k = kind(metadata(t, found), found)
            if kinds is None or k in kinds:
                ops = routes.get(k, C.ROUTES["mixed_artifact"])
                rows.append((k, found, ops, *rewritten_row(t, found, k, ops, Bank(s, name), key_aware)))
            else:
                rows.append((k, [], [], None, {}, {}, None, None, None))
        names = ["artifact_kind", "spans", "operators_applied", *REWRITTEN_TYPE.names]
        columns = dict(zip(names, zip(*rows, strict=True), strict=True))
        if scoring:
            gates, scored = Gates([x for x in columns["out_text"] if x]), []
            for t, (_, found, ops, o, _, counts, *highs) in zip(texts, rows, strict=True):
                told = _disclosure(ops, counts.get("SUPPRESS", 0), counts.get("ABSTRACT", 0), *(x or 0 for x in highs))
                scored.append(measures(t, o, found, disjoint(find(o, gates)) if o else [], told))
            columns |= zip(METRICS, zip(*scored, strict=True), strict=True)
        out.append(pa.StructArray.from_arrays([_BUILT[f](columns[f]) for f in fields], list(fields)))
    return _joined(out, pa.struct([(f, _BUILT[f]([]).type) for f in fields]))


def handling(routes: dict[str, list[str]], fields: tuple[str, ...], kinds: frozenset[str] | None = None, key_aware: bool = True) -> Callable[..., Column]:
    """A call that detects, classifies, rewrites and, if a metric is asked for, scores a text: a task
    then has one Python worker, and spans stay in it.  It takes a text and a salt and gives the named
    fields of ``HANDLED``; texts of other kinds than ``kinds`` get their kind alone."""

    @F.arrow_udf(T.StructType([T.StructField(f, HANDLED[f]) for f in fields]))
    def call(text: pa.Array, salt: pa.Array) -> pa.Array:
        return handled(text, salt, routes, fields, kinds, key_aware)

    return call
