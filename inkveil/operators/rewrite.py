"""Rewriting operators.

A document's placeholders are named in the order of their first appearance: equal values of a type
get equal names, and a name that another value holds already is drawn again.  Names are the first
four hexadecimal digits of sha256(salt:type:value), then of sha256(salt:type:value:1) and so on, so
that a salt makes a document's names reproducible.  Documents are rewritten in Arrow batches
(``batch``), in time that grows with the document.  For single values there are expressions: a
replacement is a list of pieces, literal text or a slot (type, value), and ``finish`` names the slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog as C
from ..functions.ship import ship
from ..functions.text import col, found, let, once, slice_text, strip
from .batch import rewritten
from .detect import raw_spans, resolve

PIECES = "array<struct<lit:string,type:string,value:string>>"
NAMED = "array<struct<type:string,value:string,name:string>>"
DEFAULT_SALT = "inkveil"
#: Hexadecimal digits of a name, and draws after which it gets as many more: no document is too long.
DIGITS, DRAWS = 4, 64


# ---------------------------------------------------------------- pieces


def lit(x: Column | str) -> Column:
    x = F.lit(x) if isinstance(x, str) else x
    return F.array(F.struct(x.alias("lit"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value")))


def slot(kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.array(F.struct(F.lit(None).cast("string").alias("lit"), kind.alias("type"), value.alias("value")))


def name(salt: str | None, kind: str, value: str | None, attempt: int = 0) -> str:
    seed = ":".join(x for x in (salt, kind, value, str(attempt) if attempt else None) if x is not None)
    return f"<{kind}:{hashlib.sha256(seed.encode()).hexdigest()[: DIGITS * (1 + attempt // DRAWS)]}>"


_STRING = T.StringType()
_NAMED = T.ArrayType(T.StructType([T.StructField(n, _STRING) for n in ("type", "value", "name")]))


@F.arrow_udf(T.StructType([T.StructField("named", _NAMED), T.StructField("text", _STRING)]))
def finish(pieces: pa.Array, salt: pa.Array, known: pa.Array) -> pa.Array:
    """struct<named, text>: the document's slots with their names, after those already ``known``, in
    the order of their first appearance, and the text.  A name that another slot holds is drawn
    again until it is free.  Null pieces give nulls."""
    lits, kinds, values = (pieces.values.field(i).to_pylist() for i in range(3))
    ends, salts, there = pieces.offsets.to_pylist(), salt.to_pylist(), pieces.is_valid().to_pylist()
    texts, entries, stops, none = [], [], [0], []
    for i, before in enumerate(known.to_pylist()):
        gone = not there[i]
        named = {(x["type"], x["value"]): x["name"] for x in before or []}
        taken, out = set(named.values()), []
        for k in range(ends[i], ends[i + 1]) if not gone else ():
            if kinds[k] is None:
                out.append(lits[k] or "")
                continue
            slot_ = kinds[k], values[k]
            if (own := named.get(slot_)) is None:
                attempt, own = 0, name(salts[i], *slot_)
                while own in taken:
                    attempt += 1
                    own = name(salts[i], *slot_, attempt)
                named[slot_] = own
                taken.add(own)
            out.append(own)
        texts.append(None if gone else "".join(out))
        none.append(gone)
        entries += [] if gone else [(*x, n) for x, n in named.items()]
        stops.append(len(entries))
    columns = list(zip(*entries, strict=True)) or [()] * 3
    rows = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["type", "value", "name"])
    lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), rows, mask=pa.array(none))
    return pa.StructArray.from_arrays([lists, pa.array(texts, pa.string())], ["named", "text"])


def finished(pieces: Column, salt: Column, known: Column | None = None) -> Column:
    """``finish`` of a column of pieces."""
    return finish(pieces.cast(PIECES), salt, F.lit(None).cast(NAMED) if known is None else known)


def placeholders(named: Column) -> Column:
    return F.map_from_entries(F.transform(named, lambda y: F.struct(y["name"], y["value"])))


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each (disjoint) span replaced by a string."""
    inner = F.transform(spans, lambda s, i: F.concat(slice_text(text, F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]), s["start"]), replacement(s)))
    last = F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.element_at(spans, -1)["end"])
    return F.concat(F.array_join(inner, ""), F.substring(text, last + 1, F.length(text)))


# ---------------------------------------------------------------- replacements of one span


def _label(pattern: Column) -> Column:
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in C.LABEL.items()) + ")")
    return F.coalesce(F.element_at(table, pattern), F.upper(pattern))


def suppress(pattern: Column) -> Column:
    return F.concat(F.lit("<SUPPRESSED:"), _label(pattern), F.lit(">"))


def _three_octets(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".x"))


def abstract_ip(value: Column, network: Column) -> Column:
    of_class = F.coalesce(*[F.when(found(value, regex), F.lit(k)) for k, regex in C.IP_CLASSES], F.lit("IP_PRIVATE"))
    octets = F.when(F.size(F.split(value, r"\.", -1)) == 4, _three_octets(value)).otherwise(F.lit("<IP>"))
    return F.when(network, lit(octets)).otherwise(slot(of_class, value))


def path_parts(value: Column) -> Column:
    return F.filter(F.split(F.replace(value, F.lit("\\"), F.lit("/")), "/", -1), lambda p: p != "")


def abstract_path(value: Column, windows: Column) -> Column:
    """The last two parts stay; the root becomes a placeholder of its class.  A path of no more
    than two parts keeps them all, and its placeholder stands for the empty root."""
    return let(path_parts(value), lambda parts: _abstract_parts(value, parts, windows))


def _abstract_parts(value: Column, parts: Column, windows: Column) -> Column:
    n = F.size(parts)
    home = F.when(windows, F.array_contains(F.slice(parts, 1, 3), "Users")).otherwise((F.get(parts, F.lit(0)) == "home") & (n > 1))
    root = F.concat(F.when(windows, F.lit("WIN")).otherwise(F.lit("UNIX")), F.when(home, F.lit("_HOME")).otherwise(F.lit("_ROOT")))
    kept = F.least(n, F.lit(2))
    tail = F.array_join(F.slice(parts, n - kept + 1, kept), "/")
    whole = F.concat(slot(root, F.array_join(F.slice(parts, F.lit(1), n - kept), "/")), lit(F.concat(F.when(n > kept, F.lit("/…/")).otherwise(F.lit("/")), tail)))
    return F.when(n == 0, slot("PATH", value)).otherwise(whole)


def render_host(host: Column, network: Column) -> Column:
    return let(host, lambda h: _render_host(h, network))


def _render_host(host: Column, network: Column) -> Column:
    low = F.lower(host)
    private = F.lit(False)
    for x in C.PRIVATE_SUFFIXES:
        private = private | low.endswith(x)
    out = F.when(low.isin(*C.LOCAL_HOSTS), lit("<LOCALHOST>"))
    for k, regex in C.IP_CLASSES:
        out = out.when(found(host, regex), F.when(network, lit(_three_octets(host))).otherwise(slot(k, host)))
    named = F.when(network, lit(F.concat(F.lit("<HOST>."), F.substring_index(low, ".", -1)))).otherwise(slot("PRIVATE_HOST", host))
    return out.when(private, named).otherwise(lit(host))


_SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(.*)$"


def abstract_uri(value: Column, network: Column) -> Column:
    """<SCHEME>://host/path; user, port, query and fragment go.

    Tabs and line breaks do not count; brackets that do not match in the host part are malformed.
    """
    clean = F.regexp_replace(value, r"[\t\n\r]", "")
    return let(clean, lambda c: let(F.regexp_extract(c, _SCHEME, 1), lambda scheme: _abstract_uri(value, c, scheme, network)))


def _abstract_uri(value: Column, clean: Column, scheme: Column, network: Column) -> Column:
    def whole(rest):
        has_net = rest.startswith("//")
        net = F.when(has_net, F.regexp_extract(rest, r"(?s)^//([^/?#]*)", 1)).otherwise(F.lit(""))
        path = F.regexp_extract(F.when(has_net, F.regexp_extract(rest, r"(?s)^//[^/?#]*(.*)$", 1)).otherwise(rest), r"(?s)^([^?#]*)", 1)
        return let(F.struct(net.alias("net"), path.alias("path")), lambda x: pieces(x["net"], x["path"]))

    def pieces(net, path):
        host = F.substring_index(F.substring_index(net, "@", -1), ":", 1)
        shown = F.concat(F.lit("<"), F.upper(F.when(scheme == "", F.lit("uri")).otherwise(scheme)), F.lit(">://"))
        malformed = (net.contains("[") & ~net.contains("]")) | (net.contains("]") & ~net.contains("["))
        broken = F.concat(F.lit("<"), F.when(value.contains("://"), F.upper(F.substring_index(value, "://", 1))).otherwise(F.lit("URI")), F.lit("_MALFORMED>"))
        return F.when(malformed, lit(broken)).otherwise(F.concat(lit(shown), render_host(host, network), lit(F.when(path == "/", F.lit("")).otherwise(path))))

    return let(F.when(scheme == "", clean).otherwise(F.regexp_extract(clean, _SCHEME, 2)), whole)


def abstract_connection(value: Column) -> Column:
    """Key=value items, one by one; items without = go."""
    items = F.filter(F.transform(F.split(value, ";", -1), strip), lambda x: x.contains("="))

    def item(x, i):
        key = strip(F.substring_index(x, "=", 1))
        val = strip(F.substring(x, F.instr(x, "=") + 1, F.length(x)))
        low = F.lower(key)
        body = (
            F.when(low.isin("password", "pwd"), slot("DB_PASS", val))
            .when(low.isin("user id", "uid", "username"), slot("DB_USER", val))
            .when(low.isin("server", "data source"), render_host(val, F.lit(False)))
            .when(low.isin("database", "initial catalog"), F.when(found(val, r"^[A-Za-z0-9_.-]{1,64}$") & ~val.endswith("\n"), lit(val)).otherwise(slot("DB_NAME", val)))
            .otherwise(lit(val))
        )
        return F.concat(lit(F.concat(F.when(i > 0, F.lit(";")).otherwise(F.lit("")), key, F.lit("="))), body)

    return F.flatten(F.transform(items, item))


def abstract(span: Column, network: Column) -> Column:
    """The pieces that stand for a span."""
    pattern, value = span["pattern"], span["text"]
    return (
        F.when(pattern == "internal_ip", abstract_ip(value, network))
        .when(pattern.isin("unix_path", "windows_path"), abstract_path(value, pattern == "windows_path"))
        .when(pattern.isin(*C.URI_PATTERNS), abstract_uri(value, network))
        .when(pattern == "connection_string_kv", abstract_connection(value))
        .otherwise(slot(_label(pattern), value))
    )


# ---------------------------------------------------------------- paths of frames


def sanitize_frame_path(path: Column) -> Column:
    parts = path_parts(path)
    n = F.size(parts)
    first = F.get(parts, F.lit(0))
    tail = F.concat(F.lit("/…/"), F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), "/"))
    root = F.when(first == "home", F.lit("<UNIX_HOME>")).when(first == "Users", F.lit("<WIN_HOME>")).otherwise(F.concat(F.lit("/"), first))
    return F.when(n <= 2, path).otherwise(F.concat(root, tail))


# ---------------------------------------------------------------- documents


def naive_mask(df: DataFrame, text: str = "text", spans: str = "spans", out: str = "masked_text") -> DataFrame:
    """Every span becomes <REDACTED>."""
    return df.withColumn(out, once(splice(F.coalesce(col(text), F.lit("")), col(spans), lambda s: F.lit("<REDACTED>"))))


def transform(df: DataFrame, policy: str = "routed", text: str = "text", salt: Column | str = DEFAULT_SALT, key_aware: bool = True) -> DataFrame:
    """Adds the rewritten text and what goes with it to a detected, classified, routed frame.

    Needs spans, artifact_kind and ops; adds out_text, placeholders, operators_applied,
    operator_counts and the three high-risk counts.  Of the operators of a kind SUMMARIZE comes
    before CANONICALIZE before GENERALIZE before the span operators.  ``key_aware=False`` leaves out
    the redaction by key names; that variant reports no high-risk counts.
    """
    ship(df.sparkSession)
    own = df.columns
    df = df.withColumn("__done", once(rewriting(F.col("ops"), text, salt, key_aware)))
    return df.select(*own, *transformed(F.col("__done"), F.col("ops"), policy))


def rewriting(ops: Column, text: str = "text", salt: Column | str = DEFAULT_SALT, key_aware: bool = True) -> Column:
    """The call of ``transform``; calls in one projection share a Python worker."""
    return rewritten(col(text), F.col("spans"), F.col("artifact_kind"), ops, F.lit(salt) if isinstance(salt, str) else salt, F.lit(key_aware))


def transformed(done: Column, ops: Column, policy: str) -> list[Column]:
    """The columns that ``transform`` adds, from the call's result."""
    return [
        F.lit(policy).alias("policy"),
        done["out_text"].alias("out_text"),
        done["placeholders"].alias("placeholders"),
        ops.alias("operators_applied"),
        *[done[c].alias(c) for c in ("operator_counts", "high_risk_span_count", "high_risk_suppress_count", "high_risk_abstract_count")],
    ]


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """The naive policy in the same shape as ``transform``."""
    n_high = F.size(F.filter("spans", lambda s: s["pattern"].isin(*C.HIGH_RISK_REWRITE)))
    return naive_mask(df, text, out="out_text").select(
        *df.columns,
        F.lit("naive_mask").alias("policy"),
        "out_text",
        F.create_map().cast("map<string,string>").alias("placeholders"),
        F.array(F.lit("NAIVE_MASK")).alias("operators_applied"),
        F.create_map(F.lit("NAIVE_MASK"), F.size("spans")).alias("operator_counts"),
        n_high.alias("high_risk_span_count"),
        F.lit(0).alias("high_risk_suppress_count"),
        F.lit(0).alias("high_risk_abstract_count"),
    )

