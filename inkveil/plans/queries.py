"""Queries over the supplied tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import lines, once
from ..operators import attack, classify, detect, rewrite, routing, score, stats
from ..sources import io
from . import corpus as K
from . import evaluation as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SALT = "s1"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- oracle building blocks


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PATTERNS = ", ".join(f"({i}, {q(p.name)}, {q(C.re2(p))}, {q(p.category)}, {q(p.family)}, {q(p.label)}, {p.name in C.HIGH_RISK_REWRITE}, {p.name in C.HIGH_RISK_SCORE})" for i, p in enumerate(C.PATTERNS))
PAT = f"pat(prio, name, re, category, family, label, hr_rewrite, hr_score) AS (VALUES {_PATTERNS})"
CORPUS = f"corpus AS ({K.corpus_sql('duckdb')})"
DOCS = "corpus AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def spans_cte(src: str = "corpus", tag: str = "") -> str:
    """pos{tag}: raw spans; kept{tag}: (doc_id, text, l, k) with raw and resolved lists."""
    return f"""
    hit{tag} AS (SELECT doc_id, prio, name, regexp_extract_all(text, re) AS m, string_split_regex(text, re) AS g FROM {src}, pat WHERE regexp_matches(text, re)),
    ix{tag} AS (SELECT doc_id, prio, name, m, g, unnest(range(len(m))) AS i FROM hit{tag}),
    pos{tag} AS (SELECT doc_id, prio, name, m[i + 1] AS t,
        (coalesce(list_sum(list_transform(g[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::BIGINT AS s FROM ix{tag}),
    lst{tag} AS (SELECT doc_id, list({{'s': s, 'e': s + length(t), 'name': name, 't': t}} ORDER BY s, -length(t), prio) AS l FROM pos{tag} GROUP BY doc_id),
    red{tag} AS (SELECT doc_id, l, list_reduce(list_transform(l, lambda x: {{'last': x.e, 'k': [x]}}),
        lambda a, x: CASE WHEN x.k[1].s >= a.last THEN {{'last': x.last, 'k': list_concat(a.k, x.k)}} ELSE a END) AS r FROM lst{tag}),
    kept{tag} AS (SELECT c.doc_id, c.text, r.l, r.r.k AS k FROM {src} c LEFT JOIN red{tag} r ON c.doc_id = r.doc_id)"""


def masked_cte(tag: str = "", src: str = "kept") -> str:
    """(doc_id, text, k, out): each kept span as <REDACTED>; k is null without spans."""
    return f"""masked{tag} AS (SELECT doc_id, text, k, CASE WHEN k IS NULL THEN text ELSE
        list_reduce(list_transform(k, lambda x, i: {{'e': x.e, 'o': CASE WHEN i = 1 THEN substr(text, 1, x.s) || '<REDACTED>' ELSE '' END, 's': x.s}}),
            lambda a, x: {{'e': x.e, 'o': a.o || substr(text, a.e + 1, x.s - a.e) || '<REDACTED>', 's': x.s}}).o || substr(text, k[len(k)].e + 1) END AS out FROM {src})"""


LINES = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'"


def lines_sql(text: str) -> str:
    return f"(CASE WHEN {text} = '' THEN []::VARCHAR[] WHEN regexp_matches({text}, '[\\n\\r]$') THEN list_slice(string_split_regex({text}, {LINES}), 1, -2) ELSE string_split_regex({text}, {LINES}) END)"


def frames_sql(x: str) -> str:
    return f"(regexp_matches({x}, {q(C.JAVA_FRAME)}) OR regexp_matches({x}, {q(C.PYTHON_FRAME)}))"


KINDS_CTE = f"""
    meta AS (SELECT doc_id, text, k, len(list_filter({lines_sql('text')}, lambda x: {frames_sql('x')})) AS frame_hits, len(regexp_extract_all(text, {q(C.EXCEPTION)})) AS exception_hits,
        len(regexp_extract_all(text, {q(C.CONFIG_KEY)})) AS config_key_hits, len({lines_sql('text')}) AS n_lines, coalesce(len(k), 0) AS total_spans FROM kept),
    fam AS (SELECT m.doc_id, bool_or(p.family = 'stack') AS st, bool_or(p.family = 'network') AS nw, bool_or(p.family = 'credential') AS cr, bool_or(p.family = 'path') AS pa, bool_or(p.family = 'identifier') AS idf
        FROM (SELECT doc_id, unnest(k) AS x FROM kept) m JOIN pat p ON m.x.name = p.name GROUP BY m.doc_id),
    flags AS (SELECT m.*, coalesce(st, false) OR frame_hits >= 2 OR (exception_hits >= 1 AND n_lines >= 3) AS stack, coalesce(nw, false) AS network, coalesce(cr, false) AS credential, coalesce(pa, false) AS path, coalesce(idf, false) AS identifier,
        config_key_hits >= 3 AS keyed FROM meta m LEFT JOIN fam f ON m.doc_id = f.doc_id),
    kinds AS (SELECT *, CASE WHEN stack THEN 'stack_trace' WHEN stack::INT + network::INT + credential::INT + path::INT + identifier::INT + keyed::INT >= 2 THEN 'mixed_artifact' WHEN network THEN 'network_artifact'
        WHEN keyed THEN CASE WHEN credential THEN 'secret_blob' ELSE 'config_blob' END WHEN credential THEN 'secret_blob' WHEN identifier THEN 'identifier_blob' WHEN path THEN 'filesystem_trace' WHEN total_spans = 0 THEN 'clean_text' ELSE 'mixed_artifact' END AS artifact_kind FROM flags)"""


def ph(kind: str, value: str) -> str:
    """A placeholder's name in SQL (no collisions)."""
    return f"('<' || {kind} || ':' || substr(sha256('{SALT}:' || {kind} || ':' || {value}), 1, 4) || '>')"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prepare(K.corpus(spark, sf_dir))


# ---------------------------------------------------------------- detection


@query(f"WITH {PAT}, {DOCS}, {spans_cte()} SELECT doc_id, s::INT AS start, (s + length(t))::INT AS \"end\", name AS pattern, t AS span_text FROM pos")
def span_detect(spark, sf_dir):
    docs = K.spread(K.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", detect.every_span("text").alias("spans"))
    return detect.explode_spans(docs, ["doc_id"]).drop("span_no")


@query(f"WITH {PAT}, {CORPUS}, {spans_cte()}, x AS (SELECT doc_id, unnest(k) AS x, generate_subscripts(k, 1) - 1 AS span_no FROM kept) SELECT doc_id, span_no::INT AS span_no, x.s::INT AS start, x.e::INT AS \"end\", x.name AS pattern, x.t AS span_text FROM x")
def span_resolve(spark, sf_dir):
    return detect.explode_spans(detect.detect(K.corpus(spark, sf_dir)), ["doc_id"])


@query(f"WITH {PAT}, corpus AS (SELECT page_id AS doc_id, coalesce(html, '') AS text FROM pages), {spans_cte()}, x AS (SELECT unnest(k) AS x FROM kept) SELECT x.name AS pattern, count(*) AS n FROM x GROUP BY x.name")
def span_by_pattern(spark, sf_dir):
    pages = detect.detect(K.spread(K.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))))
    return detect.explode_spans(pages, ["page_id"]).groupBy("pattern").agg(F.count("*").alias("n"))


_SCAN = f"""WITH {PAT}, {CORPUS}, hit AS (SELECT doc_id, prio, name, category, CASE WHEN regexp_matches(re, '\\([^?]') AND name NOT IN ('credit_card') THEN regexp_extract_all(text, re, 1) ELSE regexp_extract_all(text, re) END AS m FROM corpus, pat WHERE regexp_matches(text, re)),
    ev AS (SELECT doc_id, list(name ORDER BY prio) AS names, list_sort(list_distinct(list(category))) AS cats, flatten(list(list_transform(m[1:3], lambda x: '[' || name || '] ' || substr(coalesce(x, ''), 1, 120)) ORDER BY prio)) AS e FROM hit GROUP BY doc_id)"""


@query(_SCAN + " SELECT c.doc_id, e IS NOT NULL AS sensitive, coalesce(array_to_string(cats, '|'), '') AS categories, coalesce(array_to_string(names, '|'), '') AS matched_patterns, coalesce(array_to_string(e, '|'), '') AS evidence FROM corpus c LEFT JOIN ev ON c.doc_id = ev.doc_id")
def scan_evidence(spark, sf_dir):
    out = detect.scan(K.corpus(spark, sf_dir))
    return out.select("doc_id", "sensitive", *[F.array_join(c, "|").alias(c) for c in ("categories", "matched_patterns", "evidence")])


@query(_SCAN + " SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM ev) GROUP BY category")
def span_by_category(spark, sf_dir):
    return detect.category_counts(detect.scan(K.corpus(spark, sf_dir)))


@query(f"SELECT * FROM (WITH {PAT} SELECT name AS pattern, category, family, label, hr_rewrite AS high_risk_rewrite, hr_score AS high_risk_score FROM pat)")
def pattern_catalogue(spark, sf_dir):
    return detect.categories(spark)


def _set(regex: str, group: int, lower: bool = False) -> str:
    x = f"regexp_extract_all(text, {q(regex)}, {group})"
    return f"array_to_string(list_sort(list_distinct({f'list_transform({x}, lambda y: lower(y))' if lower else x})), '|')"


@query(f"WITH {CORPUS} SELECT doc_id, {_set(C.SAFE_TOKEN, 0, True)} AS safe, {_set(C.EXCEPTION, 1)} AS exceptions, {_set(C.CONFIG_KEY, 1)} AS config_keys FROM corpus")
def token_sets(spark, sf_dir):
    show = lambda c: F.array_join(F.sort_array(c), "|")
    t = F.col("text")
    return K.corpus(spark, sf_dir).select("doc_id", show(detect.safe_tokens(t)).alias("safe"), show(detect.exception_tokens(t)).alias("exceptions"), show(detect.config_keys(t)).alias("config_keys"))


@query(f"WITH {CORPUS} SELECT doc_id, len({lines_sql('text')})::INT AS n_lines, len(list_filter({lines_sql('text')}, lambda x: {frames_sql('x')} OR contains(x, 'JAVA_FRAME method=') OR contains(x, 'PY_FRAME file=')))::INT AS frames FROM corpus")
def frame_counts(spark, sf_dir):
    return K.corpus(spark, sf_dir).select("doc_id", F.size(lines(F.col("text"))).alias("n_lines"), detect.frame_count(F.col("text")).alias("frames"))


@query(f"WITH {PAT}, {DOCS}, {spans_cte()}, {masked_cte()} SELECT doc_id, replace(out, '<REDACTED>', '') AS stripped FROM masked")
def strip_spans(spark, sf_dir):
    docs = detect.detect(K.spread(K.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    return docs.select("doc_id", detect.strip_spans(F.col("text"), F.col("spans")).alias("stripped"))


_RESIDUES = f"corpus AS (SELECT doc_id, value AS text FROM ({K.values_sql(K.RESIDUES, 'duckdb')}))"


@query(f"WITH {PAT}, {_RESIDUES}, {spans_cte()}, {masked_cte()}, again AS (SELECT doc_id, out AS text FROM masked), {spans_cte('again', '2')}, x AS (SELECT unnest(k) AS x FROM kept2) SELECT x.name AS pattern, count(*) AS n FROM x GROUP BY x.name")
def residual_counts(spark, sf_dir):
    texts = K.spread(K.values(spark, sf_dir, K.RESIDUES).withColumnRenamed("value", "text"))
    again = rewrite.naive_mask(detect.detect(texts)).select("doc_id", detect.residual("masked_text").alias("spans"))
    return detect.explode_spans(again, ["doc_id"]).groupBy("pattern").agg(F.count("*").alias("n"))


_KEYWORD_HITS = " + ".join(f"regexp_matches(text, {q(k)})::INT" for k in C.KEYWORDS)


@query(f"SELECT doc_id, (hits > 0)::INT AS pred, round(least(hits / 3.0, 1.0), 6) AS score FROM (SELECT doc_id, {_KEYWORD_HITS} AS hits FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def keyword_predict(spark, sf_dir):
    pred, points = detect.keyword_score(F.coalesce("text", F.lit("")))
    return K.spread(K.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", pred.alias("pred"), F.round(points, 6).alias("score"))


# ---------------------------------------------------------------- routing


@query(f"WITH {PAT}, {CORPUS}, {spans_cte()}, {KINDS_CTE} SELECT doc_id, artifact_kind, frame_hits::INT AS frame_hits, exception_hits::INT AS exception_hits, config_key_hits::INT AS config_key_hits, total_spans::INT AS total_spans FROM kinds")
def artifact_kinds(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", "artifact_kind", *[F.col(f"metadata.{c}").alias(c) for c in ("frame_hits", "exception_hits", "config_key_hits", "total_spans")])


@query(f"WITH {PAT}, {DOCS}, {spans_cte()}, {KINDS_CTE} SELECT artifact_kind, count(*) AS n, sum(total_spans)::BIGINT AS spans FROM kinds GROUP BY artifact_kind")
def artifact_kind_counts(spark, sf_dir):
    docs = E.prepare(K.spread(K.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    return docs.groupBy("artifact_kind").agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans"))


@query(f"WITH {PAT}, {CORPUS}, {spans_cte()}, x AS (SELECT doc_id, unnest(k) AS x FROM kept) SELECT doc_id, x.name AS pattern, count(*)::INT AS n FROM x GROUP BY doc_id, x.name")
def span_pattern_counts(spark, sf_dir):
    docs = detect.detect(K.corpus(spark, sf_dir))
    return docs.select("doc_id", F.explode(detect.pattern_counts(F.col("spans"))).alias("pattern", "n"))


_ROUTES = ", ".join(f"({q(k)}, {q('+'.join(ops))}, {q('' if not ops else 'ABSTRACT')}, {q('' if not ops else 'SUPPRESS')})" for k, ops in C.ROUTES.items())


@query(f"WITH {PAT}, {CORPUS}, {spans_cte()}, {KINDS_CTE}, route(artifact_kind, routed, abstract_only, suppress_only) AS (VALUES {_ROUTES}) SELECT doc_id, artifact_kind, routed, abstract_only, suppress_only FROM kinds JOIN route USING (artifact_kind)")
def pipeline_routing(spark, sf_dir):
    df = prepared(spark, sf_dir).select("doc_id", "artifact_kind")
    for policy in ("routed", "abstract_only", "suppress_only"):
        df = routing.route(df, policy).withColumn(policy, F.array_join("ops", "+")).drop("ops")
    return df


@query(f"SELECT * FROM (VALUES {', '.join(f'({q(op)}, {q("|".join(k))}, {q("|".join(r))}, {q(p)})' for op, (k, r, p) in C.OPERATORS.items())}) AS t(op, preserves, removes, privacy_level)")
def operator_specs(spark, sf_dir):
    return routing.operator_specs(spark).select("op", F.array_join("preserves", "|").alias("preserves"), F.array_join("removes", "|").alias("removes"), "privacy_level")


# ---------------------------------------------------------------- rewriting


@query(f"WITH {PAT}, {DOCS}, {spans_cte()}, {KINDS_CTE}, {masked_cte()} SELECT m.doc_id, artifact_kind, total_spans::INT AS n_spans, out AS masked_text FROM masked m JOIN kinds USING (doc_id)")
def naive_mask(spark, sf_dir):
    docs = E.prepare(K.spread(K.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    return rewrite.naive_mask(docs).select("doc_id", "artifact_kind", F.size("spans").alias("n_spans"), "masked_text")


@query(f"WITH {PAT}, {CORPUS}, {spans_cte()}, {masked_cte()} SELECT doc_id, out AS masked_text FROM masked")
def naive_mask_prompts(spark, sf_dir):
    return rewrite.naive_mask(detect.detect(K.corpus(spark, sf_dir))).select("doc_id", "masked_text")


def _rendered(df: DataFrame, **pieces) -> DataFrame:
    """The identifier and the text of each column of pieces."""
    for name, column in pieces.items():
        df = df.withColumn(name, once(column.cast(rewrite.PIECES)))
    return df.select("doc_id", *[rewrite.finished(F.col(name), F.lit(SALT))["text"].alias(name) for name in pieces])


_IP_KIND = " ".join(f"WHEN regexp_matches(value, {q(r)}) THEN {q(k)}" for k, r in C.IP_CLASSES)


@query(f"SELECT doc_id, {ph(f'CASE {_IP_KIND} ELSE {q("IP_PRIVATE")} END', 'value')} AS typed, regexp_replace(value, '\\.[0-9]+$', '.x') AS network FROM ({K.values_sql(K.IPS, 'duckdb')})")
def abstract_ip(spark, sf_dir):
    v = F.col("value")
    return _rendered(K.values(spark, sf_dir, K.IPS), typed=rewrite.abstract_ip(v, F.lit(False)), network=rewrite.abstract_ip(v, F.lit(True)))


@query(f"""WITH v AS (SELECT doc_id, value, value LIKE '_:%' AS win, list_filter(string_split(replace(value, chr(92), '/'), '/'), lambda x: x <> '') AS p FROM ({K.values_sql(K.PATHS, 'duckdb')})),
    w AS (SELECT *, len(p) AS n, CASE WHEN win THEN CASE WHEN list_contains(p[1:3], 'Users') THEN 'WIN_HOME' ELSE 'WIN_ROOT' END ELSE CASE WHEN p[1] = 'home' AND len(p) > 1 THEN 'UNIX_HOME' ELSE 'UNIX_ROOT' END END AS c FROM v)
    SELECT doc_id, {ph('c', "array_to_string(p[1:n - least(n, 2)], '/')")} || CASE WHEN n > 2 THEN '/…/' ELSE '/' END || array_to_string(p[n - least(n, 2) + 1:n], '/') AS abstracted FROM w""")
def abstract_path(spark, sf_dir):
    v = F.col("value")
    return _rendered(K.values(spark, sf_dir, K.PATHS), abstracted=rewrite.abstract_path(v, v.rlike("^.:")))


def _host(host: str, network: bool) -> str:
    if network:
        return f"(CASE WHEN {host} IN ('localhost', '127.0.0.1') THEN '<LOCALHOST>' WHEN regexp_matches({host}, '^(10|192\\.168|172\\.(1[6-9]|2\\d|3[01]))\\.[0-9.]+$') THEN regexp_replace({host}, '\\.[0-9]+$', '.x') WHEN regexp_matches({host}, '\\.(internal|private|local|corp|lan)$') THEN '<HOST>.' || regexp_extract({host}, '([a-z]+)$', 1) ELSE {host} END)"
    kinds = " ".join(f"WHEN regexp_matches({host}, {q(r)}) THEN {ph(q(k), host)}" for k, r in C.IP_CLASSES)
    return f"(CASE WHEN {host} IN ('localhost', '127.0.0.1') THEN '<LOCALHOST>' {kinds} WHEN regexp_matches({host}, '\\.(internal|private|local|corp|lan)$') THEN {ph(q('PRIVATE_HOST'), host)} ELSE {host} END)"


_URI = f"""SELECT doc_id, upper(regexp_extract(value, '^([a-z+]+):', 1)) AS sch, regexp_extract(value, '^[a-z+]+://(?:[^/@]*@)?([^/:?#]*)', 1) AS host,
    CASE WHEN value LIKE 'jdbc:%' THEN substr(value, 6) ELSE regexp_extract(value, '^[a-z+]+://[^/?#]*([^?#]*)', 1) END AS path FROM ({K.values_sql(K.URIS, 'duckdb')})"""


@query(f"SELECT doc_id, '<' || sch || '>://' || {_host('host', False)} || CASE WHEN path = '/' THEN '' ELSE path END AS typed, '<' || sch || '>://' || {_host('host', True)} || CASE WHEN path = '/' THEN '' ELSE path END AS network FROM ({_URI})")
def abstract_uri(spark, sf_dir):
    v = F.col("value")
    return _rendered(K.values(spark, sf_dir, K.URIS), typed=rewrite.abstract_uri(v, F.lit(False)), network=rewrite.abstract_uri(v, F.lit(True)))


@query(f"SELECT doc_id, {_host('host', False)} AS typed, {_host('host', True)} AS network FROM ({_URI}) WHERE host <> ''")
def render_host(spark, sf_dir):
    host = F.regexp_extract("value", r"^[a-z+]+://(?:[^/@]*@)?([^/:?#]*)", 1)
    hosts = K.values(spark, sf_dir, K.URIS).select("doc_id", host.alias("host")).where("host <> ''")
    return _rendered(hosts, typed=rewrite.render_host(F.col("host"), F.lit(False)), network=rewrite.render_host(F.col("host"), F.lit(True)))


@query(f"""WITH v AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(value, ';'), lambda x: trim(x)), lambda x: contains(x, '='))) AS item, generate_subscripts(list_filter(string_split(value, ';'), lambda x: contains(x, '=')), 1) AS i FROM ({K.values_sql(K.CONNECTIONS, 'duckdb')})),
    kv AS (SELECT doc_id, i, trim(split_part(item, '=', 1)) AS k, trim(substr(item, strpos(item, '=') + 1)) AS v FROM v),
    r AS (SELECT doc_id, i, k || '=' || CASE WHEN lower(k) IN ('password', 'pwd') THEN {ph(q('DB_PASS'), 'v')} WHEN lower(k) IN ('user id', 'uid', 'username') THEN {ph(q('DB_USER'), 'v')}
        WHEN lower(k) IN ('server', 'data source') THEN {_host('v', False)} WHEN lower(k) IN ('database', 'initial catalog') THEN CASE WHEN regexp_matches(v, '^[A-Za-z0-9_.-]+$') THEN v ELSE {ph(q('DB_NAME'), 'v')} END ELSE v END AS o FROM kv)
    SELECT doc_id, string_agg(o, ';' ORDER BY i) AS abstracted FROM r GROUP BY doc_id""")
def abstract_conn_kv(spark, sf_dir):
    return _rendered(K.values(spark, sf_dir, K.CONNECTIONS), abstracted=rewrite.abstract_connection(F.col("value")))


@query(f"WITH {PAT}, {CORPUS}, {spans_cte()}, x AS (SELECT doc_id, unnest(k) AS x FROM kept) SELECT doc_id, x.s::INT AS start, '<SUPPRESSED:' || label || '>' AS suppressed FROM x JOIN pat ON x.name = pat.name")
def suppress_labels(spark, sf_dir):
    spans = detect.explode_spans(detect.detect(K.corpus(spark, sf_dir)), ["doc_id"])
    return spans.select("doc_id", "start", rewrite.suppress(F.col("pattern")).alias("suppressed"))


def _templates(cases: dict[int, str], cols: str = "out_text") -> str:
    """Expected output by template, in SQL over the order's key."""
    body = " ".join(f"WHEN {i} THEN {x}" for i, x in cases.items())
    return f"SELECT o_orderkey AS doc_id, CASE o_orderkey % {len(K.TEMPLATES)} {body} END AS {cols} FROM orders"


_k, _n = "CAST(o_orderkey AS VARCHAR)", "CAST(o_orderkey % 256 AS VARCHAR)"
_text = {i: K.expression(t, "duckdb") for i, t in enumerate(K.TEMPLATES)}
_nl = "chr(10)"
_mail = lambda v: ph(q("EMAIL"), v)
_ROUTED = {
    0: f"'server.port=' || {_k} || {_nl} || 'db_password=' || {ph(q('SECRET_VALUE'), f"('s3cr-' || {_k})")} || {_nl} || 'debug: true' || {_nl} || 'max_rows=100'",
    1: f"'ping 10.1.' || {_n} || '.x and 172.16.' || {_n} || '.x now'",
    2: f"'open ' || {ph(q('UNIX_HOME'), f"('home/u' || {_k})")} || '/…/app' || {_k} || '/main.py failed, see ' || {ph(q('SYS_ETC'), "'etc'")} || '/…/conf.d/x.conf'",
    3: "'key <SUPPRESSED:AWS_ACCESS_KEY> end'",
    4: f"'connect <POSTGRESQL>://<HOST>.internal/orders' || {_k} || ' please'",
    5: f"'Traceback (most recent call last):' || {_nl} || '  File \"/home/u' || {_k} || '/app.py\", line ' || {_k} || ', in run' || {_nl} || '    raise ValueError(...)' || {_nl} || 'ValueError: bad id at <PATH_REDACTED> from <IP_PRIVATE>'",
    6: f"'mail ' || {_mail(f"('user' || {_k} || '@example.com')")} || ' from ' || {ph(q('IP_192_168'), f"('192.168.1.' || {_n})")} || ' now'",
    7: _text[7],
    8: f"'refund for ' || {_mail(f"('customer' || {_k} || '@example.org')")} || ' and card ' || {ph(q('CARD_NUMBER'), q('4111111111111111'))} || ' please'",
    9: f"'use Server=' || {ph(q('PRIVATE_HOST'), f"('db' || {_k} || '.corp')")} || ';Database=sales' || {_k} || '; thanks'",
    10: f"'file ' || {ph(q('WIN_HOME'), f"('C:' || chr(92) || 'Users' || chr(92) || 'bob' || {_k})")} || chr(92) || 'docs' || chr(92) || 'report' || {_k} || '.txt is gone'",
    11: "'token <SUPPRESSED:GITHUB_TOKEN> twice <SUPPRESSED:GITHUB_TOKEN> and key <SUPPRESSED:API_KEY_OPENAI>'",
}


@query(_templates(_ROUTED))
def routed_transform(spark, sf_dir):
    return E.handle(K.corpus(spark, sf_dir), ["out_text"], salt=SALT).drop("text")


def _part(kind: str):
    def run(spark, sf_dir):
        return E.handle(K.corpus(spark, sf_dir), ["out_text"], kinds=[kind], salt=SALT).drop("text")

    return run


for _name, _kind, _i in (("generalize_paths", "filesystem_trace", (2, 10)), ("canonicalize_keys", "config_blob", (0,)), ("summarize_traces", "stack_trace", (5,)), ("suppress_secrets", "secret_blob", (3, 11))):
    QUERIES[_name] = _part(_kind)
    ORACLE_SQL[_name] = f"SELECT * FROM ({_templates(_ROUTED)}) WHERE doc_id % {len(K.TEMPLATES)} IN ({', '.join(map(str, _i))})"

_ABSTRACTED = _ROUTED | {
    0: _text[0],
    2: f"'open ' || {ph(q('UNIX_HOME'), q(''))} || '/home/u' || {_k} || '/projects/app' || {_k} || '/main.py failed, see ' || {ph(q('UNIX_ROOT'), f"('etc/app' || {_k})")} || '/…/conf.d/x.conf'",
    3: f"'key ' || {ph(q('AWS_ACCESS_KEY'), f"('AKIA' || upper(substr(md5({_k}), 1, 16)))")} || ' end'",
    5: f"{ph(q('STACK_TRACE'), q('Traceback (most recent call last)'))} || ':' || {_nl} || '  ' || {ph(q('STACK_TRACE'), f"('File \"/home/u' || {_k} || '/app.py\", line ' || {_k})")} || ', in run' || {_nl} || '    raise ValueError(\"bad ' || {_k} || '\")' || {_nl} || 'ValueError: bad id at ' || {ph(q('UNIX_HOME'), q(''))} || '/home/u' || {_k} || '/data.csv from ' || {ph(q('IP_10'), f"('10.0.0.' || {_n})")}",
    10: f"'file ' || {ph(q('WIN_HOME'), f"('C:/Users/bob' || {_k})")} || '/…/docs/report' || {_k} || '.txt is gone'",
    11: f"'token ' || {ph(q('GITHUB_TOKEN'), f"('ghp_' || md5({_k}) || 'abcd')")} || ' twice ' || {ph(q('GITHUB_TOKEN'), f"('ghp_' || md5({_k}) || 'abcd')")} || ' and key ' || {ph(q('API_KEY_OPENAI'), f"('sk-' || md5({_k}))")}",
}
_SUPPRESSED = _ABSTRACTED | {3: _ROUTED[3], 11: _ROUTED[11]}
_NO_KEYS = _ROUTED | {0: _text[0]}


@query(" UNION ALL ".join(f"SELECT doc_id, {q(p)} AS policy, out_text FROM ({_templates(c)})" for p, c in (("abstract_only", _ABSTRACTED), ("suppress_only", _SUPPRESSED), ("no_key_aware", _NO_KEYS))))
def ablation_transform(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    policies = [E.routed("abstract_only", salt=SALT), E.routed("suppress_only", salt=SALT), E.routed("routed", salt=SALT, key_aware=False, name="no_key_aware")]
    return E.apply(rows, policies).select("doc_id", "policy", "out_text")


# The same from the texts themselves: what stands for a span, in SQL over its text.


def _span_sql(t: str, label: str, name: str, network: str) -> str:
    p = f"list_filter(string_split(replace({t}, chr(92), '/'), '/'), lambda x: x <> '')"
    root = f"CASE WHEN {name} = 'windows_path' THEN CASE WHEN list_contains(({p})[1:3], 'Users') THEN 'WIN_HOME' ELSE 'WIN_ROOT' END ELSE CASE WHEN ({p})[1] = 'home' AND len({p}) > 1 THEN 'UNIX_HOME' ELSE 'UNIX_ROOT' END END"
    path = f"{ph(f'({root})', f"array_to_string(({p})[1:len({p}) - least(len({p}), 2)], '/')")} || CASE WHEN len({p}) > 2 THEN '/…/' ELSE '/' END || array_to_string(({p})[len({p}) - least(len({p}), 2) + 1:len({p})], '/')"
    ip = f"CASE WHEN {network} THEN regexp_replace({t}, '\\.[0-9]+$', '.x') ELSE {ph(f'(CASE {" ".join(f"WHEN regexp_matches({t}, {q(r)}) THEN {q(k)}" for k, r in C.IP_CLASSES)} ELSE {q("IP_PRIVATE")} END)', t)} END"
    host = f"regexp_extract({t}, '^[A-Za-z+]+://(?:[^/@]*@)?([^/:?#]*)', 1)"
    rest = f"CASE WHEN {name} = 'jdbc_url' THEN substr({t}, 6) ELSE regexp_extract({t}, '^[A-Za-z+]+://[^/?#]*([^?#]*)', 1) END"
    uri = f"'<' || upper(regexp_extract({t}, '^([A-Za-z+]+):', 1)) || '>://' || CASE WHEN {network} THEN {_host(host, True)} ELSE {_host(host, False)} END || CASE WHEN {rest} = '/' THEN '' ELSE {rest} END"
    key, val = "trim(split_part(i, '=', 1))", "trim(substr(i, strpos(i, '=') + 1))"
    item = f"CASE WHEN lower({key}) IN ('password', 'pwd') THEN {ph(q('DB_PASS'), val)} WHEN lower({key}) IN ('user id', 'uid', 'username') THEN {ph(q('DB_USER'), val)} WHEN lower({key}) IN ('server', 'data source') THEN {_host(val, False)} WHEN lower({key}) IN ('database', 'initial catalog') THEN CASE WHEN regexp_matches({val}, '^[A-Za-z0-9_.-]+$') THEN {val} ELSE {ph(q('DB_NAME'), val)} END ELSE {val} END"
    conn = f"array_to_string(list_transform(list_filter(list_transform(string_split({t}, ';'), lambda x: trim(x)), lambda x: contains(x, '=')), lambda i: {key} || '=' || {item}), ';')"
    return f"CASE WHEN {name} = 'internal_ip' THEN {ip} WHEN {name} IN ('unix_path', 'windows_path') THEN {path} WHEN {name} IN ({', '.join(map(q, C.URI_PATTERNS))}) THEN {uri} WHEN {name} = 'connection_string_kv' THEN {conn} ELSE {ph(label, t)} END"


_BOTH = f"corpus AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -doc_id - 1, text FROM ({K.corpus_sql('duckdb')}))"
_REPLACED = f"""WITH {PAT}, {_BOTH}, {spans_cte()}, {KINDS_CTE}, x AS (SELECT doc_id, unnest(k) AS x FROM kept),
    y AS (SELECT x.doc_id, x.s, x.e, artifact_kind, hr_rewrite, label, {_span_sql('x.t', 'label', 'x.name', "(artifact_kind = 'network_artifact')")} AS r FROM x JOIN pat ON x.name = pat.name JOIN kinds ON x.doc_id = kinds.doc_id),
    z AS (SELECT doc_id, list({{'s': s, 'e': e, 'r': {{r}}}} ORDER BY s) AS l FROM y GROUP BY doc_id),
    o AS (SELECT c.doc_id, text, CASE WHEN l IS NULL THEN text ELSE list_reduce(list_transform(l, lambda v, i: {{'e': v.e, 'o': CASE WHEN i = 1 THEN substr(text, 1, v.s) || v.r ELSE v.r END, 's': v.s}}),
        lambda a, v: {{'e': v.e, 'o': a.o || substr(text, a.e + 1, v.s - a.e) || v.o, 's': v.s}}).o || substr(text, l[len(l)].e + 1) END AS out_text FROM corpus c LEFT JOIN z ON c.doc_id = z.doc_id)"""
_SUPPRESSING = "('secret_blob', 'mixed_artifact')"


#: Kinds whose spans are replaced one by one.
_SPAN_KINDS = [k for k in C.ROUTES if k not in ("stack_trace", "config_blob", "filesystem_trace")]


def both_texts(spark, sf_dir) -> DataFrame:
    """Documents and derived prompts."""
    docs = K.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return K.spread(docs, K.TEXTS_A_TASK).unionByName(K.corpus(spark, sf_dir).select((-F.col("doc_id") - 1).alias("doc_id"), "text"))


@query(_REPLACED.replace("{r}", "r") + " SELECT doc_id, out_text FROM o")
def abstracted_texts(spark, sf_dir):
    return E.handle(both_texts(spark, sf_dir), ["out_text"], "abstract_only", salt=SALT).drop("text")


@query(_REPLACED.replace("{r}", f"CASE WHEN hr_rewrite AND artifact_kind IN {_SUPPRESSING} THEN '<SUPPRESSED:' || label || '>' ELSE r END") + " SELECT o.doc_id, artifact_kind, out_text FROM o JOIN kinds ON o.doc_id = kinds.doc_id WHERE artifact_kind NOT IN ('stack_trace', 'config_blob', 'filesystem_trace')")
def routed_texts(spark, sf_dir):
    return E.handle(both_texts(spark, sf_dir), ["artifact_kind", "out_text"], kinds=_SPAN_KINDS, salt=SALT).drop("text")


_COUNTED = f"""WITH {PAT}, {_BOTH}, {spans_cte()}, {KINDS_CTE}, x AS (SELECT doc_id, unnest(k) AS x FROM kept),
    h AS (SELECT x.doc_id, count(*) FILTER (hr_rewrite) AS high, count(*) AS n FROM x JOIN pat ON x.name = pat.name GROUP BY x.doc_id),
    c AS (SELECT k.doc_id, artifact_kind, coalesce(high, 0) AS high, coalesce(n, 0) AS n, artifact_kind NOT IN ('stack_trace', 'config_blob', 'filesystem_trace', 'clean_text') AS spans, artifact_kind IN {_SUPPRESSING} AS sup FROM kinds k LEFT JOIN h ON k.doc_id = h.doc_id),
    d AS (SELECT *, CASE WHEN sup THEN high ELSE 0 END AS suppressed, CASE WHEN spans THEN n - CASE WHEN sup THEN high ELSE 0 END ELSE 0 END AS abstracted, CASE WHEN spans AND NOT sup THEN high ELSE 0 END AS high_abstracted FROM c)"""


@query(_COUNTED + """ SELECT doc_id, high::INT AS high_risk_span_count, suppressed::INT AS high_risk_suppress_count, high_abstracted::INT AS high_risk_abstract_count,
    array_to_string(list_filter([CASE artifact_kind WHEN 'stack_trace' THEN 'SUMMARIZE=1' WHEN 'config_blob' THEN 'CANONICALIZE=1' WHEN 'filesystem_trace' THEN 'GENERALIZE=1' END, CASE WHEN suppressed > 0 THEN 'SUPPRESS=' || suppressed END, CASE WHEN abstracted > 0 THEN 'ABSTRACT=' || abstracted END], lambda x: x IS NOT NULL), ',') AS operator_counts FROM d""")
def operator_counts(spark, sf_dir):
    rows = E.handle(both_texts(spark, sf_dir), ["high_risk_span_count", "high_risk_suppress_count", "high_risk_abstract_count", "operator_counts"], salt=SALT)
    shown = F.array_join(F.transform(F.map_entries("operator_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("doc_id", "high_risk_span_count", "high_risk_suppress_count", "high_risk_abstract_count", shown.alias("operator_counts"))


@query(_COUNTED + " SELECT doc_id, round(CASE WHEN high > 0 THEN (0.3 * suppressed + 0.7 * high_abstracted) / high WHEN suppressed + abstracted > 0 THEN (0.3 * suppressed + 0.7 * abstracted) / (suppressed + abstracted) ELSE 0 END, 9)::DOUBLE AS type_disclosure_rate FROM d")
def routed_type_disclosure(spark, sf_dir):
    rows = E.handle(both_texts(spark, sf_dir), ["type_disclosure_rate"], salt=SALT)
    return rows.select("doc_id", F.round("type_disclosure_rate", 9).alias("type_disclosure_rate"))


@query(_REPLACED.replace("{r}", f"CASE WHEN hr_rewrite AND artifact_kind IN {_SUPPRESSING} THEN '<SUPPRESSED:' || label || '>' ELSE r END") + """, hs AS (SELECT x.doc_id, x.t FROM x JOIN pat ON x.name = pat.name WHERE hr_rewrite)
    SELECT o.doc_id, count(hs.t)::INT AS high_risk_spans_checked, count(*) FILTER (contains(out_text, hs.t))::INT AS violations, round(coalesce(count(*) FILTER (contains(out_text, hs.t)) / nullif(count(hs.t), 0)::DOUBLE, 0.0), 9) AS violation_rate, count(*) FILTER (contains(out_text, hs.t)) = 0 AS guarantee_holds
    FROM o JOIN kinds ON o.doc_id = kinds.doc_id LEFT JOIN hs ON o.doc_id = hs.doc_id WHERE artifact_kind NOT IN ('stack_trace', 'config_blob', 'filesystem_trace') GROUP BY o.doc_id""")
def suppress_guarantee(spark, sf_dir):
    out = stats.suppress_guarantee(E.handle(both_texts(spark, sf_dir), ["spans", "out_text"], kinds=_SPAN_KINDS, salt=SALT))
    return out.select("doc_id", "high_risk_spans_checked", "violations", F.round("violation_rate", 9).alias("violation_rate"), "guarantee_holds")


_PH = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, {ph(q(t), v)} AS placeholder, {v} AS original_value FROM orders WHERE o_orderkey % {len(K.TEMPLATES)} = {i}"
    for i, t, v in (
        (0, "SECRET_VALUE", f"('s3cr-' || {_k})"), (2, "UNIX_HOME", f"('home/u' || {_k})"), (2, "SYS_ETC", "'etc'"), (6, "EMAIL", f"('user' || {_k} || '@example.com')"), (6, "IP_192_168", f"('192.168.1.' || {_n})"),
        (8, "EMAIL", f"('customer' || {_k} || '@example.org')"), (8, "CARD_NUMBER", q("4111111111111111")), (9, "PRIVATE_HOST", f"('db' || {_k} || '.corp')"), (10, "WIN_HOME", f"('C:' || chr(92) || 'Users' || chr(92) || 'bob' || {_k})"),
    )
)


@query(_PH)
def placeholders(spark, sf_dir):
    return attack.typed_targets(E.routed("routed", salt=SALT)(prepared(spark, sf_dir)), "doc_id")


@query(f"SELECT doc_id, split_part(substr(placeholder, 2), ':', 1) AS type, count(DISTINCT original_value) AS n FROM ({_PH}) GROUP BY ALL")
def placeholder_type_counts(spark, sf_dir):
    rows = attack.typed_targets(E.routed("routed", salt=SALT)(prepared(spark, sf_dir)), "doc_id")
    return rows.groupBy("doc_id", attack.placeholder_type(F.col("placeholder")).alias("type")).agg(F.count_distinct("original_value").alias("n"))


@query(f"""WITH v AS (SELECT doc_id, value, list_filter(string_split(replace(value, chr(92), '/'), '/'), lambda x: x <> '') AS p FROM ({K.values_sql(K.PATHS, 'duckdb')}))
    SELECT doc_id, CASE WHEN len(p) <= 2 THEN value WHEN p[1] = 'home' THEN '<UNIX_HOME>/…/' || array_to_string(p[-2:], '/') WHEN p[1] = 'Users' THEN '<WIN_HOME>/…/' || array_to_string(p[-2:], '/') ELSE '/' || p[1] || '/…/' || array_to_string(p[-2:], '/') END AS shown FROM v""")
def frame_paths(spark, sf_dir):
    return K.values(spark, sf_dir, K.PATHS).select("doc_id", rewrite.sanitize_frame_path(F.col("value")).alias("shown"))


# ---------------------------------------------------------------- scoring


def naive_scores(spark, sf_dir) -> DataFrame:
    return score.score(E.naive()(prepared(spark, sf_dir)))


_NAIVE = f"""WITH {PAT}, {CORPUS}, {spans_cte()}, {masked_cte()}, again AS (SELECT doc_id, out AS text FROM masked), {spans_cte('again', '2')},
    hr AS (SELECT list(name) AS names FROM pat WHERE hr_score),
    s AS (SELECT m.doc_id, m.text, m.out, coalesce(m.k, []) AS k, coalesce(r.k, []) AS left_k, hr.names FROM masked m JOIN kept2 r ON m.doc_id = r.doc_id, hr),
    a AS (SELECT doc_id, text, out, len(k) AS n, len(list_filter(k, lambda x: contains(out, x.t)))::DOUBLE AS exact_leaks, len(list_filter(k, lambda x: contains(out, x.t) AND list_contains(names, x.name)))::DOUBLE AS high_risk_exact_leaks,
        len(left_k)::DOUBLE AS residual_matches, len(list_filter(left_k, lambda x: list_contains(names, x.name)))::DOUBLE AS high_risk_residual_matches,
        list_filter(string_split_regex(out, '\\s+'), lambda x: x LIKE '<%' AND x LIKE '%>') AS toks FROM s),
    leak AS (SELECT doc_id, text, out, residual_matches, high_risk_residual_matches, exact_leaks, high_risk_exact_leaks, CASE WHEN n > 0 THEN exact_leaks / n ELSE 0.0 END AS leakage_rate,
        high_risk_residual_matches + 0.15 * (residual_matches - high_risk_residual_matches) AS structural_risk, 0.0::DOUBLE AS type_disclosure_rate,
        CASE WHEN len(toks) > 0 THEN (len(toks) - len(list_distinct(toks))) / len(toks)::DOUBLE ELSE 0.0 END AS linkage_score FROM a)"""


@query(_NAIVE + " SELECT doc_id, residual_matches, high_risk_residual_matches, exact_leaks, high_risk_exact_leaks, round(leakage_rate, 9) AS leakage_rate, round(structural_risk, 9) AS structural_risk, type_disclosure_rate, round(linkage_score, 9) AS linkage_score FROM leak")
def leakage_metrics(spark, sf_dir):
    cols = ["residual_matches", "high_risk_residual_matches", "exact_leaks", "high_risk_exact_leaks"]
    return naive_scores(spark, sf_dir).select("doc_id", *cols, F.round("leakage_rate", 9).alias("leakage_rate"), F.round("structural_risk", 9).alias("structural_risk"), "type_disclosure_rate", F.round("linkage_score", 9).alias("linkage_score"))


def _recall(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a})::DOUBLE ELSE 1.0 END"


def _tok(regex: str, col: str, group: int, lower: bool = False) -> str:
    x = f"regexp_extract_all({col}, {q(regex)}, {group})"
    return f"list_distinct({f'list_transform({x}, lambda y: lower(y))' if lower else x})"


_UTILITY = (
    _NAIVE
    + f""", u AS (SELECT *, replace(out, '<REDACTED>', '') AS bare, len(list_filter({lines_sql('text')}, lambda x: {frames_sql('x')})) AS f0, len(list_filter({lines_sql('out')}, lambda x: {frames_sql('x')})) AS f1 FROM leak),
    util AS (SELECT *, {_recall(_tok(C.SAFE_TOKEN, 'bare', 0, True), _tok(C.SAFE_TOKEN, 'out', 0, True))} AS safe_token_recall, {_recall(_tok(C.EXCEPTION, 'text', 1), _tok(C.EXCEPTION, 'out', 1))} AS exception_recall,
        {_recall(_tok(C.CONFIG_KEY, 'text', 1), _tok(C.CONFIG_KEY, 'out', 1))} AS config_key_recall, CASE WHEN f0 > 0 THEN least(f1 / f0::DOUBLE, 1.0) ELSE 1.0 END AS frame_recall,
        least((length(out) - length(replace(out, chr(10), '')) + 1) / (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE, 1.0) AS line_ratio, length(out) / greatest(length(text), 1)::DOUBLE AS length_ratio FROM u),
    sc AS (SELECT *, 1.0 / (1.0 + 5.0 * high_risk_exact_leaks + 2.0 * high_risk_residual_matches + structural_risk + 0.3 * type_disclosure_rate) AS privacy_score,
        0.20 * safe_token_recall + 0.25 * exception_recall + 0.15 * config_key_recall + 0.30 * frame_recall + 0.10 * line_ratio AS utility_score FROM util)"""
)
_UM = ["safe_token_recall", "exception_recall", "config_key_recall", "frame_recall", "line_ratio", "length_ratio"]


@query(_UTILITY + f" SELECT doc_id, {', '.join(f'round({m}, 9) AS {m}' for m in _UM)} FROM sc")
def utility_metrics(spark, sf_dir):
    return naive_scores(spark, sf_dir).select("doc_id", *[F.round(m, 9).alias(m) for m in _UM])


@query(_UTILITY + " SELECT doc_id, round(privacy_score, 9) AS privacy_score, round(utility_score, 9) AS utility_score, round(0.55 * privacy_score + 0.45 * utility_score, 9) AS pareto_score FROM sc")
def pareto_scores(spark, sf_dir):
    return naive_scores(spark, sf_dir).select("doc_id", *[F.round(m, 9).alias(m) for m in ("privacy_score", "utility_score", "pareto_score")])


# ---------------------------------------------------------------- aggregates, on scored rows derived from orders

_SCORED = "SELECT o_orderkey AS idx, CASE o_orderkey % 3 WHEN 0 THEN 'routed' WHEN 1 THEN 'naive_mask' ELSE 'tagger' END AS policy, CASE o_orderkey % 5 WHEN 0 THEN 'config_blob' WHEN 1 THEN 'stack_trace' ELSE 'mixed_artifact' END AS kind, CAST(o_orderkey % 97 AS DOUBLE) / 97 AS privacy_score, CAST(o_orderkey % 89 AS DOUBLE) / 89 AS utility_score FROM orders"
_MET = ["privacy_score", "utility_score"]


def scored(spark, sf_dir) -> DataFrame:
    return K.from_orders(spark, sf_dir, _SCORED)


@query(f"SELECT policy, kind, CASE WHEN grouping(kind) = 1 THEN 'overall' ELSE 'by_kind' END AS level, count(*) AS n, round(avg(privacy_score), 9) AS privacy_score, round(avg(utility_score), 9) AS utility_score FROM ({_SCORED}) GROUP BY GROUPING SETS ((policy), (policy, kind))")
def policy_grouping_sets(spark, sf_dir):
    return stats.breakdown(scored(spark, sf_dir), kind="kind", metrics=_MET).select("policy", "kind", "level", "n", *[F.round(m, 9).alias(m) for m in _MET])


@query(f"SELECT policy, count(*) AS n, round(avg(privacy_score), 9) AS privacy_score, round(avg(utility_score), 9) AS utility_score FROM ({_SCORED}) GROUP BY policy")
def policy_means(spark, sf_dir):
    return stats.means(scored(spark, sf_dir), ["policy"], _MET).select("policy", "n", *[F.round(m, 9).alias(m) for m in _MET])


@query(f"""WITH a AS (SELECT idx, privacy_score AS x, utility_score AS y FROM ({_SCORED})), w AS (SELECT count(*) FILTER (x > 0.5 AND y <= 0.5) AS a_wins, count(*) FILTER (x <= 0.5 AND y > 0.5) AS b_wins, count(*) AS n FROM a)
    SELECT a_wins, b_wins, n - a_wins - b_wins AS ties, round(CASE WHEN a_wins + b_wins = 0 THEN 0.0 ELSE (abs(a_wins - b_wins) - 1.0) * (abs(a_wins - b_wins) - 1.0) / (a_wins + b_wins) END, 9) AS chi2 FROM w""")
def mcnemar_policies(spark, sf_dir):
    s = scored(spark, sf_dir)
    a, b = s.select("idx", F.col("privacy_score").alias("v")), s.select("idx", F.col("utility_score").alias("v"))
    return stats.mcnemar(a, b, "idx", "v", p_value=False).withColumn("chi2", F.round("chi2", 9))


@query()
def mcnemar_p_values(spark, sf_dir):
    s = scored(spark, sf_dir)
    return stats.mcnemar(s.select("idx", F.col("privacy_score").alias("v")), s.select("idx", F.col("utility_score").alias("v")), "idx", "v")


_PROPORTIONS = "SELECT kind, count(*) FILTER (WHERE policy = 'routed' AND privacy_score > 0.5) AS x1, count(*) FILTER (WHERE policy = 'routed') AS n1, count(*) FILTER (WHERE policy <> 'routed' AND privacy_score > 0.5) AS x2, count(*) FILTER (WHERE policy <> 'routed') AS n2 FROM"


@query(f"""WITH t AS ({_PROPORTIONS} ({_SCORED}) GROUP BY kind), p AS (SELECT *, x1 / n1::DOUBLE AS p1, x2 / n2::DOUBLE AS p2, (x1 + x2) / (n1 + n2)::DOUBLE AS pool FROM t)
    SELECT kind, x1, n1, x2, n2, round(p1, 6) AS p1, round(p2, 6) AS p2, round((p1 - p2) / sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n2)), 4) AS z_stat FROM p""")
def two_proportion_z(spark, sf_dir):
    s = scored(spark, sf_dir)
    own, good = F.col("policy") == "routed", F.col("privacy_score") > 0.5
    t = s.groupBy("kind").agg(F.count_if(own & good).alias("x1"), F.count_if(own).alias("n1"), F.count_if(~own & good).alias("x2"), F.count_if(~own).alias("n2"))
    return stats.two_proportion_z(t).drop("p_value", "significant_at_05")


@query()
def two_proportion_p(spark, sf_dir):
    s = scored(spark, sf_dir)
    own, good = F.col("policy") == "routed", F.col("privacy_score") > 0.5
    t = s.groupBy("kind").agg(F.count_if(own & good).alias("x1"), F.count_if(own).alias("n1"), F.count_if(~own & good).alias("x2"), F.count_if(~own).alias("n2"))
    return stats.two_proportion_z(t)


_POLICIES = "SELECT CAST(o_orderpriority AS VARCHAR) AS policy, round(avg(o_orderkey % 97), 6) AS privacy_score, round(avg(o_custkey % 89), 6) AS utility_score FROM orders GROUP BY o_orderpriority"
_DOMINANCE = f"p AS ({_POLICIES}), d AS (SELECT a.policy AS winner, b.policy AS loser FROM p a JOIN p b ON a.policy <> b.policy AND a.privacy_score >= b.privacy_score AND a.utility_score >= b.utility_score AND (a.privacy_score > b.privacy_score OR a.utility_score > b.utility_score))"


def _policies(spark, sf_dir):
    return K.from_orders(spark, sf_dir, _POLICIES.replace("VARCHAR", "STRING"))


@query(f"WITH {_DOMINANCE} SELECT policy FROM p WHERE policy NOT IN (SELECT loser FROM d)")
def pareto_frontier(spark, sf_dir):
    return stats.frontier(_policies(spark, sf_dir)).select("policy")


@query(f"WITH {_DOMINANCE} SELECT * FROM d")
def dominance_pairs(spark, sf_dir):
    return stats.dominance(_policies(spark, sf_dir))


_JUDGED = "SELECT o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN 'config_blob' ELSE 'mixed_artifact' END AS kind, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' ELSE 'a' END AS winner FROM orders"


@query(f"""WITH t AS (SELECT kind, count(*) AS total, count(*) FILTER (upper(winner) = 'A') AS wins, count(*) FILTER (upper(winner) = 'B') AS losses, count(*) FILTER (upper(winner) NOT IN ('A', 'B')) AS ties FROM ({_JUDGED}) GROUP BY kind)
    SELECT *, round(wins / total::DOUBLE, 9) AS win_rate, round(losses / total::DOUBLE, 9) AS loss_rate, round(ties / total::DOUBLE, 9) AS tie_rate, round(coalesce(wins / nullif(wins + losses, 0)::DOUBLE, 0.0), 9) AS decisive_win_rate FROM t""")
def pairwise_summary(spark, sf_dir):
    out = stats.pairwise_summary(K.from_orders(spark, sf_dir, _JUDGED), ["kind"])
    return out.withColumns({c: F.round(c, 9) for c in ("win_rate", "loss_rate", "tie_rate", "decisive_win_rate")})


@query()
def bootstrap_intervals(spark, sf_dir):
    rows = K.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return stats.bootstrap(rows, ["quality", "toxic"], linear=True)


@query("SELECT 'quality' AS metric, round(avg(quality), 9) AS mean FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 9) FROM labels")
def bootstrap_means(spark, sf_dir):
    rows = K.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return stats.bootstrap(rows, ["quality", "toxic"]).select("metric", F.round("mean", 9).alias("mean"))


@query(f"""WITH ph AS ({_PH}), n AS (SELECT count(*) AS n FROM orders), k AS (SELECT placeholder, count(DISTINCT doc_id) AS k FROM ph GROUP BY placeholder)
    SELECT n, round(sum(k * (k - 1) / 2.0) / (n * (n - 1) / 2.0), 9) AS linked_pair_rate, 0.0::DOUBLE AS suppressed_link_rate FROM k, n GROUP BY n""")
def linkage_pairs(spark, sf_dir):
    out = stats.linkage_pairs(E.routed("routed", salt=SALT)(prepared(spark, sf_dir)))
    return out.withColumn("linked_pair_rate", F.round("linked_pair_rate", 9))


@query(f"""WITH ph AS (SELECT DISTINCT placeholder, original_value FROM ({_PH})), v AS (SELECT original_value, count(*) AS k FROM ph GROUP BY 1), p AS (SELECT placeholder, count(*) AS k FROM ph GROUP BY 1)
    SELECT (SELECT count(*) FROM v) AS unique_values_seen, (SELECT count(*) FROM v WHERE k > 1) AS values_with_multiple_placeholders, (SELECT count(*) FROM p WHERE k > 1) AS placeholders_mapping_multiple_values,
        round(1.0 - (SELECT count(*) FROM v WHERE k > 1) / (SELECT count(*) FROM v)::DOUBLE, 9) AS within_corpus_determinism_rate""")
def linkage_determinism(spark, sf_dir):
    out = stats.linkage_determinism(E.routed("routed", salt=SALT)(prepared(spark, sf_dir)))
    return out.withColumn("within_corpus_determinism_rate", F.round("within_corpus_determinism_rate", 9))


_RATES = "SELECT o_orderpriority AS grp, avg(CASE WHEN o_orderkey % 7 < 3 THEN 1 ELSE 0 END) AS exact_match_rate, avg(CASE WHEN o_orderkey % 7 < 7 THEN 1 ELSE 0 END) AS format_match_rate FROM orders GROUP BY o_orderpriority"


@query(f"SELECT grp, round(-log2(1.0 - exact_match_rate), 9) AS exact_bits, format_match_rate >= 1.0 AS format_infinite FROM ({_RATES})")
def mutual_information(spark, sf_dir):
    out = stats.information_bounds(K.from_orders(spark, sf_dir, _RATES))
    return out.select("grp", F.round("i_exact_lower_bound_bits", 9).alias("exact_bits"), (F.col("i_format_lower_bound_bits") == float("inf")).alias("format_infinite"))


_KB = "log2(25.0)"
_DEF = "(20 * log2(62.0))"
_OPS = f"(VALUES ('SUPPRESS', pow(2.0, -{_DEF}), {_KB}), ('ABSTRACT', pow(2.0, -{_DEF}), {_KB} + log2(10.0)), ('SUMMARIZE', 0.0, 0.0), ('CANONICALIZE', pow(2.0, -{_DEF}), {_KB} + 1.0), ('GENERALIZE', 1e-6, log2(5.0))) AS o(op, eps, bits)"


@query(f"SELECT op, r AS detector_recall, round(eps, 9) AS epsilon_operator, round(r * eps + (1.0 - r), 9) AS epsilon_conditioned, round(bits + (1.0 - r) * {_DEF}, 6) AS bits_leaked_upper_bound FROM {_OPS}, (VALUES (1.0::DOUBLE), (0.99), (0.95), (0.9)) AS t(r)")
def operator_bounds(spark, sf_dir):
    recalls = spark.createDataFrame([(1.0,), (0.99,), (0.95,), (0.9,)], "detector_recall double")
    return stats.conditioned_bounds(recalls).select("op", "detector_recall", F.round("epsilon_operator", 9).alias("epsilon_operator"), F.round("epsilon_conditioned", 9).alias("epsilon_conditioned"), F.round("bits_leaked_upper_bound", 6).alias("bits_leaked_upper_bound"))


@query(f"SELECT t AS placeholder_type, round(n * log2(b::DOUBLE), 6) AS log2_space FROM (VALUES {', '.join(f'({q(t)}, {b}::HUGEINT, {n})' for t, (b, n) in C.VALUE_SPACES.items())}) AS v(t, b, n)")
def recovery_bounds(spark, sf_dir):
    return stats.recovery_bounds(spark).select("placeholder_type", F.round("log2_space", 6).alias("log2_space"))


def _sqltext(x: str) -> str:
    return " || chr(10) || ".join(q(p) for p in x.split("\n"))


_POS = "fix(t, text) AS (VALUES " + ", ".join(f"({q(t)}, {_sqltext(x)})" for t, x in K.POSITIVES) + ")"


@query(f"WITH {PAT}, {_POS} SELECT t AS expected_type, count(*) FILTER (regexp_matches(text, re)) AS detected, count(*) AS total, round(avg(regexp_matches(text, re)::INT), 9) AS recall FROM fix JOIN pat ON t = name GROUP BY t")
def fixture_recall(spark, sf_dir):
    return stats.detector_recall(detect.detect(K.positives(spark))).select("expected_type", "detected", "total", F.round("recall", 9).alias("recall"))


@query(f"WITH {PAT}, b(text) AS (VALUES {', '.join(f'({_sqltext(x)})' for x in K.BENIGN)}), f AS (SELECT text, (SELECT bool_or(regexp_matches(b.text, re)) FROM pat) AS hit FROM b) SELECT count(*) AS total, count(*) FILTER (hit) AS flagged, round(avg(hit::INT), 9) AS false_positive_rate FROM f")
def fixture_fp_rate(spark, sf_dir):
    return stats.false_positive_rate(detect.detect(K.benign(spark))).select("total", "flagged", F.round("false_positive_rate", 9).alias("false_positive_rate"))


@query(f"SELECT kind AS expected_kind, count(*) AS total, count(*) AS correct FROM (VALUES {', '.join(f'({q(k)})' for k, _ in K.KIND_FIXTURES)}) AS t(kind) GROUP BY kind")
def fixture_kinds(spark, sf_dir):
    rows = E.prepare(K.kind_fixtures(spark))
    return rows.groupBy("expected_kind").agg(F.count("*").alias("total"), F.count_if(F.col("artifact_kind") == F.col("expected_kind")).alias("correct"))


@query(f"SELECT key, true AS redacted FROM (VALUES {', '.join(f'({q(k)})' for _, k in K.KEY_FIXTURES)}) AS t(key)")
def fixture_keys(spark, sf_dir):
    rows = E.prepare(K.key_fixtures(spark)).withColumn("ops", F.array(F.lit("CANONICALIZE")))
    return rewrite.transform(rows, "routed").select("key", F.col("out_text").contains("<SECRET_VALUE:").alias("redacted"))


# ---------------------------------------------------------------- classification, documents with labels

_LABELS = f"SELECT d.doc_id, quality AS label, ({_KEYWORD_HITS} > 0)::INT AS pred, round(n_chars / 1000.0, 1) AS score, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def labels(spark, sf_dir) -> DataFrame:
    d, lab = K.table(spark, sf_dir, "documents"), K.table(spark, sf_dir, "labels")
    pred, _ = detect.keyword_score(F.coalesce("text", F.lit("")))
    return d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("label"), pred.alias("pred"), F.round(F.col("n_chars") / 1000.0, 1).alias("score"), "lang")


_CM = f"cm AS (SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label <> 1 AND pred = 1) AS fp, count(*) FILTER (label <> 1 AND pred <> 1) AS tn, count(*) FILTER (label = 1 AND pred <> 1) AS fn FROM ({_LABELS}))"


@query(f"WITH {_CM} SELECT * FROM cm")
def confusion_matrix(spark, sf_dir):
    return classify.confusion(labels(spark, sf_dir))


@query(f"""WITH {_CM}, x AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0 FROM cm)
    SELECT round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy, round(f1::DOUBLE, 9) AS f1_sensitive, round(((f1 + f0) / 2)::DOUBLE, 9) AS f1_macro,
        round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0), 0), 9) AS mcc FROM x""")
def classification_metrics(spark, sf_dir):
    return classify.metrics(classify.confusion(labels(spark, sf_dir))).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "f1_sensitive", "f1_macro", "mcc")])


_CURVE = f"c AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM ({_LABELS}) GROUP BY score), v AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c)"


@query(f"WITH {_CURVE} SELECT round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 9)::DOUBLE AS auroc, round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 9)::DOUBLE AS pr_auc FROM v")
def ranking_metrics(spark, sf_dir):
    return classify.ranking_metrics(labels(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"), F.round("pr_auc", 9).alias("pr_auc"))


@query(f"""WITH {_CURVE}, p AS (SELECT score, tp / (tp + fp)::DOUBLE AS pr, tp / sum(pos) OVER ()::DOUBLE AS re FROM v), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM p)
    SELECT (SELECT score FROM f ORDER BY f1 DESC, score LIMIT 1)::DOUBLE AS best_f1_threshold, round(max(f1), 9) AS best_f1, round(max(re) FILTER (pr >= 0.95), 9) AS recall_at_95prec, round(max(pr) FILTER (re >= 0.9), 9) AS prec_at_90recall FROM f""")
def operating_points(spark, sf_dir):
    return classify.operating_points(labels(spark, sf_dir)).select("best_f1_threshold", *[F.round(c, 9).alias(c) for c in ("best_f1", "recall_at_95prec", "prec_at_90recall")])


@query(f"SELECT doc_id, label, (SELECT (sum(label) > count(*) / 2.0)::INT FROM ({_LABELS}) WHERE doc_id % 5 > 0) AS pred FROM ({_LABELS}) WHERE doc_id % 5 = 0")
def majority_baseline(spark, sf_dir):
    rows = labels(spark, sf_dir).select("doc_id", "label")
    return classify.majority(rows.where("doc_id % 5 > 0"), rows.where("doc_id % 5 = 0"))


_SPLIT = f"""r AS (SELECT doc_id, lang, label, row_number() OVER (PARTITION BY lang, label ORDER BY md5('42:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY lang, label) AS n FROM ({_LABELS})),
    t AS (SELECT *, ceil(n * 0.20::DECIMAL(10,4)) AS nt FROM r), sp AS (SELECT doc_id, lang, label, CASE WHEN i <= nt THEN 'test' WHEN i <= nt + ceil((n - nt) * 0.125::DECIMAL(10,4)) THEN 'validation' ELSE 'train' END AS split FROM t)"""


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def stratified_split(spark, sf_dir):
    return classify.split(labels(spark, sf_dir).select("doc_id", "lang", "label"), "doc_id", ["lang", "label"])


@query(f"WITH {_SPLIT} SELECT split, lang, label, count(*) AS n FROM sp GROUP BY ALL")
def split_distribution(spark, sf_dir):
    return classify.split_distribution(classify.split(labels(spark, sf_dir).select("doc_id", "lang", "label"), "doc_id", ["lang", "label"]), ["lang", "label"])


@query(f"SELECT doc_id, lang, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY lang, label), 12) AS weight FROM ({_LABELS})")
def strat_weights(spark, sf_dir):
    rows = classify.strat_weights(labels(spark, sf_dir).select("doc_id", "lang", "label"), ["lang", "label"])
    return rows.select("doc_id", "lang", "label", F.round("weight", 12).alias("weight"))


_TERMS = """w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark), t AS (SELECT item_id, unnest(list_concat(w, list_transform(list_zip(w[1:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS term FROM w),
    tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 100000),
    x AS (SELECT item_id, tf.term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term)"""


@query(f"WITH {_TERMS} SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 9) AS weight FROM x")
def tfidf_weights(spark, sf_dir):
    items = K.table(spark, sf_dir, "benchmark")
    return classify.tfidf(items, "item_id", classify.word_terms(F.col("text"))).withColumn("weight", F.round("weight", 9))


@query(f"WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark), p AS (SELECT item_id, ' ' || w || ' ' AS w FROM w), g AS (SELECT item_id, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substr(w, i, n))))) AS term FROM p) SELECT item_id, term, count(*) AS n FROM g GROUP BY ALL")
def char_terms(spark, sf_dir):
    items = K.table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.explode(classify.char_terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query()
def logistic_baseline(spark, sf_dir):
    d, lab = K.table(spark, sf_dir, "documents"), K.table(spark, sf_dir, "labels")
    rows = d.join(lab, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").alias("label"))
    parts = classify.split(rows, "doc_id", ["label"])
    model = classify.logistic_baseline(parts.where("split = 'train'"))
    scored_rows = model.transform(classify.with_terms(parts.where("split = 'test'")))
    return classify.metrics(classify.confusion(scored_rows, pred="prediction")).select("n_records", "accuracy", "f1_sensitive", "f1_macro", "mcc")


@query("SELECT label, d::INT AS dim, round(avg(x::DOUBLE), 6) AS mean_x, round(max(x)::DOUBLE, 6) AS max_x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY label, d")
def pool_embeddings(spark, sf_dir):
    return classify.pool_rows(K.table(spark, sf_dir, "embeddings"), "label").select("label", "dim", F.round("mean_x", 6).alias("mean_x"), F.round("max_x", 6).alias("max_x"))


_STATES = "SELECT o_orderkey AS doc_id, {a}({a}(CAST(o_orderkey % 7 AS DOUBLE), CAST(o_custkey % 5 AS DOUBLE)), {a}(CAST(o_orderkey % 3 AS DOUBLE), CAST(4 AS DOUBLE)), {a}(CAST(9 AS DOUBLE), CAST(o_custkey % 11 AS DOUBLE))) AS states, {a}(1, 1, CAST(o_orderkey % 2 AS INT)) AS mask FROM orders"
_STATES_DUCK = _STATES.replace("{a}", "list_value")


@query(f"""SELECT doc_id, states[1][1] AS cls_0, round((states[1][1] + states[2][1] + mask[3] * states[3][1]) / (2 + mask[3]), 9) AS mean_0, round((states[1][2] + states[2][2] + mask[3] * states[3][2]) / (2 + mask[3]), 9) AS mean_1,
    greatest(states[1][2], states[2][2], CASE WHEN mask[3] = 1 THEN states[3][2] END) AS max_1 FROM ({_STATES_DUCK})""")
def pool_states(spark, sf_dir):
    rows = K.from_orders(spark, sf_dir, _STATES.replace("{a}", "array"))
    cls, mean, most = (classify.pool(rows, how) for how in ("cls", "mean", "max"))
    return rows.select("doc_id", cls[0].alias("cls_0"), F.round(mean[0], 9).alias("mean_0"), F.round(mean[1], 9).alias("mean_1"), most[1].alias("max_1"))


@query(f"SELECT m AS model_name, p AS pooling, replace(m, '/', '_') || '__' || p AS experiment_id FROM (VALUES {', '.join(f'({q(m)})' for m in C.ENCODERS)}) AS a(m), (VALUES ('cls'), ('mean'), ('max')) AS b(p) WHERE NOT (m = 'roberta-base' AND p = 'cls')")
def experiment_grid(spark, sf_dir):
    done = spark.createDataFrame([("roberta-base__cls",)], "experiment_id string")
    return classify.experiment_grid(spark, done)


_PHASE = "SELECT CAST(o_orderkey AS VARCHAR) AS experiment_id, o_orderkey AS position, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % {a} AS DOUBLE) / {b} END AS accuracy, CAST(o_custkey % {a} AS DOUBLE) / {b} AS auroc FROM orders WHERE o_orderkey % {c} = 0"
_P1, _P2 = _PHASE.format(a=13, b=13, c=2), _PHASE.format(a=11, b=11, c=3)


def _phase(spark, sf_dir, sql):
    return K.from_orders(spark, sf_dir, sql.replace("VARCHAR", "STRING"))


@query(f"SELECT a.experiment_id, round(CASE WHEN a.accuracy <> 0 AND b.accuracy <> 0 THEN b.accuracy - a.accuracy END, 9) AS accuracy_delta, round(CASE WHEN a.auroc <> 0 AND b.auroc <> 0 THEN b.auroc - a.auroc END, 9) AS auroc_delta FROM ({_P1}) a JOIN ({_P2}) b ON a.experiment_id = b.experiment_id")
def phase_delta_join(spark, sf_dir):
    out = classify.phase_deltas(_phase(spark, sf_dir, _P1), _phase(spark, sf_dir, _P2), ["accuracy", "auroc"])
    return out.select("experiment_id", F.round("accuracy_delta", 9).alias("accuracy_delta"), F.round("auroc_delta", 9).alias("auroc_delta"))


_DIFFS = "SELECT o_orderkey % 41 - o_custkey % 37 AS diff FROM orders"


@query(f"""WITH d AS (SELECT abs(diff) AS v, diff > 0 AS up FROM ({_DIFFS}) WHERE diff <> 0), b AS (SELECT v, count(*) AS c, count(*) FILTER (up) AS u FROM d GROUP BY v), r AS (SELECT c, u, sum(c) OVER (ORDER BY v) - c + (c + 1) / 2.0 AS rk FROM b)
    SELECT sum(c)::BIGINT AS n, round(sum(u * rk), 3)::DOUBLE AS w_plus FROM r""")
def wilcoxon_w(spark, sf_dir):
    out = stats.wilcoxon(K.from_orders(spark, sf_dir, _DIFFS))
    return out.select("n", F.round("w_plus", 3).alias("w_plus"))


@query(f"WITH x AS (SELECT experiment_id, position, unnest(['accuracy', 'auroc']) AS key, unnest([accuracy, auroc]) AS value FROM ({_P1})) SELECT key, arg_min(experiment_id, position) AS experiment_id, round(any_value(value), 9) AS value FROM (SELECT *, max(value) OVER (PARTITION BY key) AS m FROM x WHERE value IS NOT NULL) WHERE value = m GROUP BY key")
def deployment_summary(spark, sf_dir):
    return classify.deployment_summary(_phase(spark, sf_dir, _P1), ["accuracy", "auroc"]).withColumn("value", F.round("value", 9))


@query(f"""WITH a AS (SELECT 'accuracy' AS key, max(accuracy) AS phase1 FROM ({_P1}) UNION ALL SELECT 'auroc', max(auroc) FROM ({_P1})), b AS (SELECT 'auroc' AS key, max(auroc) AS phase2 FROM ({_P2}))
    SELECT coalesce(a.key, b.key) AS key, round(phase1, 9) AS phase1, round(phase2, 9) AS phase2, round(phase2 - phase1, 9) AS delta FROM a FULL JOIN b ON a.key = b.key""")
def phase_tradeoff(spark, sf_dir):
    out = classify.phase_tradeoff(classify.deployment_summary(_phase(spark, sf_dir, _P1), ["accuracy", "auroc"]), classify.deployment_summary(_phase(spark, sf_dir, _P2), ["auroc"]))
    return out.select("key", *[F.round(c, 9).alias(c) for c in ("phase1", "phase2", "delta")])


_ANNOTATED = "SELECT o_orderkey AS index, (o_orderkey % {a}) < 2 AS is_sensitive FROM orders"


@query(f"""WITH j AS (SELECT a.is_sensitive AS x, b.is_sensitive AS y FROM ({_ANNOTATED.format(a=5)}) a JOIN ({_ANNOTATED.format(a=4)}) b ON a.index = b.index), t AS (SELECT count(*) AS n, avg((x = y)::INT) AS o, avg(x::INT) AS px, avg(y::INT) AS py FROM j)
    SELECT n, round(o, 9) AS observed, round(px * py + (1 - px) * (1 - py), 9) AS expected, round((o - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))), 9) AS kappa FROM t""")
def cohen_kappa(spark, sf_dir):
    a, b = (K.from_orders(spark, sf_dir, _ANNOTATED.format(a=x)) for x in (5, 4))
    return classify.cohen_kappa(a, b).select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


# ---------------------------------------------------------------- attempts

_TYPES = list(C.VALIDATORS) + ["GITLAB_TOKEN", "PRIVATE_KEY", "UNHEARD_OF"]
_GUESSES = ["sk-{HEX32}", "ghp_{HEX32}", "AKIA{HEX16}", "eyJa.b{k}.c", "/home/user{k}", "C:{bs}Users{bs}bob", "10.0.{n}.3", "192.168.0.{n}", "user{k}@example.com", "db{k}.internal", "4111111111111111", "abc", "", "  10.1.1.{n} ", "a.b.c", "DE89{k}", "0x{HEX32}{HEX16}"]
_ATTEMPTS_SQL = (
    "SELECT o_orderkey AS doc_id, '<' || {type} || ':00ab>' AS placeholder, {guess} AS reconstructed_value, CASE WHEN o_custkey % 3 = 0 THEN '  ' || upper({guess}) ELSE 'other' END AS original_value, CASE o_custkey % 4 WHEN 0 THEN 'high' ELSE 'low' END AS confidence, CASE o_orderkey % 2 WHEN 0 THEN 'SUPPRESS+ABSTRACT' ELSE '' END AS operators FROM orders"
)
_TYPE_CASE = "CASE o_custkey % {n} {cases} END".format(n=len(_TYPES), cases=" ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(_TYPES)))


def _attempts_sql(engine: str) -> str:
    return _ATTEMPTS_SQL.replace("{type}", _TYPE_CASE).replace("{guess}", K.choice(_GUESSES, engine))


def attempts(spark, sf_dir) -> DataFrame:
    return attack.score_attempts(K.from_orders(spark, sf_dir, _attempts_sql("spark")))


_FORMAT = "CASE kind " + " ".join(f"WHEN {q(t)} THEN regexp_matches(v, {q(r)})" for t, r in C.VALIDATORS.items()) + " ELSE v <> '' END"
_BUCKET = "CASE kind " + " ".join(f"WHEN {q(t)} THEN {q(b)}" for t, b in C.BUCKET.items()) + " ELSE '' END"
_CATEGORY = r"""CASE bucket WHEN 'api_token' THEN regexp_matches(g, '[A-Za-z0-9_-]{20,}') WHEN 'filesystem_path' THEN starts_with(g, '/') OR regexp_matches(g, '^[a-z]:\\') WHEN 'network_address' THEN regexp_matches(g, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') OR regexp_matches(g, '\.(internal|local|corp|lan)')
    WHEN 'pii_identifier' THEN contains(g, '@') WHEN 'auth_token' THEN len(string_split(g, '.')) = 3 AND len(list_filter(string_split(g, '.'), lambda x: x = '')) = 0 WHEN 'credential' THEN length(g) >= 4 ELSE false END"""
_SCORED_ATTEMPTS = f"""a0 AS ({_attempts_sql('duckdb')}), a1 AS (SELECT *, regexp_extract(placeholder, '^<(.*):[^:]*>$', 1) AS kind, trim(reconstructed_value) AS v, lower(trim(reconstructed_value)) AS g FROM a0), a2 AS (SELECT *, {_BUCKET} AS bucket FROM a1),
    att AS (SELECT doc_id, kind AS placeholder_type, confidence, operators, g = lower(trim(original_value)) AS exact_match, {_FORMAT} AS format_match, {_CATEGORY} AS category_match FROM a2)"""


@query(f"WITH {_SCORED_ATTEMPTS} SELECT doc_id, placeholder_type, exact_match, format_match, category_match FROM att")
def score_attempts(spark, sf_dir):
    return attempts(spark, sf_dir).select("doc_id", "placeholder_type", "exact_match", "format_match", "category_match")


_AGG = "count(*) AS total_attempts, round(avg(exact_match::INT), 9) AS exact_match_rate, round(avg(format_match::INT), 9) AS format_match_rate, round(avg(category_match::INT), 9) AS category_match_rate, round(coalesce(avg(exact_match::INT) FILTER (confidence = 'high'), 0.0), 9) AS high_confidence_exact_rate"
_RATE_COLS = ["exact_match_rate", "format_match_rate", "category_match_rate", "high_confidence_exact_rate"]


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in _RATE_COLS})


@query(f"WITH {_SCORED_ATTEMPTS} SELECT {_AGG} FROM att")
def attempt_rates(spark, sf_dir):
    return _rounded(attack.attempt_rates(attempts(spark, sf_dir)))


@query(f"WITH {_SCORED_ATTEMPTS} SELECT placeholder_type, {_AGG} FROM att GROUP BY placeholder_type")
def attempts_by_type(spark, sf_dir):
    return _rounded(attack.attempt_rates(attempts(spark, sf_dir), ["placeholder_type"]))


@query(f"WITH {_SCORED_ATTEMPTS} SELECT operators, {_AGG} FROM att GROUP BY operators")
def attempts_by_operators(spark, sf_dir):
    return _rounded(attack.attempt_rates(attempts(spark, sf_dir), ["operators"]))


@query(f"WITH {_SCORED_ATTEMPTS}, o AS (SELECT avg(format_match::INT) AS f, avg(exact_match::INT) AS e FROM att WHERE confidence = 'high'), l AS (SELECT avg(format_match::INT) AS f, avg(exact_match::INT) AS e FROM att WHERE confidence <> 'high') SELECT round(o.f - l.f, 9) AS format_match_gap, round(o.e - l.e, 9) AS exact_match_gap FROM o, l")
def attempt_gaps(spark, sf_dir):
    a = attempts(spark, sf_dir)
    out = attack.rate_gaps(a.where("confidence = 'high'"), a.where("confidence <> 'high'"))
    return out.select(F.round("format_match_gap", 9).alias("format_match_gap"), F.round("exact_match_gap", 9).alias("exact_match_gap"))


_GIVEN = "SELECT o_orderkey AS doc_id, o_custkey % 3 AS position, '<EMAIL:' || CAST(o_custkey % 2 AS VARCHAR) || '>' AS placeholder, CAST(o_custkey % 4 AS INT) AS index, CAST(o_custkey AS VARCHAR) AS reconstructed_value, 'high' AS confidence FROM orders WHERE o_orderkey % 3 > 0"
_TARGETS = "SELECT o_orderkey AS doc_id, '<EMAIL:' || CAST(o_orderkey % 2 AS VARCHAR) || '>' AS placeholder, CAST(o_custkey AS VARCHAR) AS original_value FROM orders"


@query(f"SELECT t.doc_id, t.placeholder, t.original_value, coalesce(a.reconstructed_value, '') AS reconstructed_value, coalesce(a.confidence, 'low') AS confidence, coalesce(a.reconstructed_value, '') = t.original_value AS exact_match FROM ({_TARGETS}) t LEFT JOIN ({_GIVEN}) a ON t.doc_id = a.doc_id AND t.placeholder = a.placeholder")
def typed_attack_join(spark, sf_dir):
    targets, given = (K.from_orders(spark, sf_dir, x.replace("VARCHAR", "STRING")) for x in (_TARGETS, _GIVEN))
    return attack.join_typed(targets, given, "doc_id").select("doc_id", "placeholder", "original_value", "reconstructed_value", "confidence", "exact_match")


_BLIND_SPANS = "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 2 AS INT) AS span_no, CAST(o_custkey AS VARCHAR) AS span_text FROM orders"


@query(f"SELECT s.doc_id, s.span_no::INT AS span_no, s.span_text AS original_value, coalesce(a.reconstructed_value, '') AS reconstructed_value FROM ({_BLIND_SPANS}) s LEFT JOIN ({_GIVEN}) a ON s.doc_id = a.doc_id AND s.span_no = 0")
def blind_attack_join(spark, sf_dir):
    spans, given = (K.from_orders(spark, sf_dir, x.replace("VARCHAR", "STRING")) for x in (_BLIND_SPANS, _GIVEN))
    out = attack.join_blind(spans, given, "doc_id").select("doc_id", "original_value", "reconstructed_value")
    return out.join(spans.select("doc_id", "span_no"), "doc_id").select("doc_id", "span_no", "original_value", "reconstructed_value")


@query()
def format_attack(spark, sf_dir):
    return attack.format_attack(attack.typed_targets(E.routed("routed", salt=SALT)(prepared(spark, sf_dir)), "doc_id"))


def stub(model: str, system: str, prompt: str) -> str:
    """A language model for tests: the same answer to the same prompt, now and then broken."""
    import json
    import re
    import zlib

    h = zlib.crc32(prompt.encode())
    if h % 11 == 0:
        raise TimeoutError("no answer")
    if "winner" in system:
        return "```json\n" + json.dumps({"winner": "AB T"[h % 4], "reason": str(h % 7)}) + "\n```"
    if "primary_issue" in system:
        return json.dumps({"primary_issue": str(h % 5), "likely_cause": "c", "next_action": "n"}) if h % 3 else "- issue\n- cause"
    found = sorted(set(re.findall(r"<[A-Z0-9_]+:[0-9a-f]{4}>", prompt)))
    return "Sure: " + json.dumps({"attempts": [{"placeholder": p, "index": i, "reconstructed_value": "10.0.0.1", "confidence": "low"} for i, p in enumerate(found or ["<REDACTED>"])]})


@query()
def reconstruction_eval(spark, sf_dir):
    both = E.apply(prepared(spark, sf_dir), [E.routed("routed", salt=SALT), E.naive()])
    attempts = E.attempt_any(both.withColumn("doc_id", F.struct("policy", "doc_id")), "doc_id", stub, "m").withColumn("policy", F.col("doc_id.policy"))
    return attack.attempt_rates(attempts, ["policy", "placeholder_type"]).drop("policy")


@query()
def pairwise_benchmark(spark, sf_dir):
    judged = E.benchmark(prepared(spark, sf_dir), "doc_id", [E.routed("routed", salt=SALT), E.naive()], stub, "m", "j")
    return E.benchmark_summary(judged)


@query()
def language_model_policy(spark, sf_dir):
    return E.language_model(stub, "m")(prepared(spark, sf_dir)).select("doc_id", "policy", "out_text")


# ---------------------------------------------------------------- sources

_MANIFEST = "SELECT o_orderkey - 1 AS position, o_orderkey AS index, o_orderpriority AS artifact_kind, 'm' AS name, CAST(7 AS BIGINT) AS selected_count FROM orders"


def manifest(spark, sf_dir) -> DataFrame:
    return K.from_orders(spark, sf_dir, _MANIFEST)


@query(f"SELECT position, index FROM ({_MANIFEST}) WHERE position >= 500 AND position < 700")
def shard_slice(spark, sf_dir):
    return io.shard(manifest(spark, sf_dir), 500, 1000, 200).select("position", "index")


@query(f"SELECT index FROM ({_MANIFEST}) WHERE index NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def resume_antijoin(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return io.remaining(m, m.where("index % 3 = 0")).select("index")


@query(f"SELECT sha256('[' || string_agg(index::VARCHAR, ',' ORDER BY position) || ']') AS manifest_hash FROM ({_MANIFEST})")
def manifest_hash(spark, sf_dir):
    return io.manifest_hash(manifest(spark, sf_dir))


@query(f"SELECT sha256('{{\"name\": \"m\", \"records\": [' || string_agg(index::VARCHAR, ', ' ORDER BY position) || '], \"selected_count\": 7}}') AS stable_hash FROM ({_MANIFEST})")
def stable_manifest_hash(spark, sf_dir):
    return io.stable_hash(manifest(spark, sf_dir))


@query(f"SELECT idx, kind, winner FROM ({_JUDGED}) WHERE idx % 2 = 0 UNION ALL SELECT idx, kind, winner FROM ({_JUDGED}) WHERE idx % 3 = 0")
def shard_merge(spark, sf_dir):
    j = K.from_orders(spark, sf_dir, _JUDGED)
    return io.merge_shards([j.where("idx % 2 = 0"), j.where("idx % 3 = 0")], "idx")


@query("SELECT doc_id, (toxic = 1)::INT AS label FROM labels WHERE doc_id % 4 > 0")
def external_labels(spark, sf_dir):
    rows = K.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("toxic") == 1).alias("sensitive"))
    return io.labelled(rows)


@query(f"WITH a AS (SELECT kind, avg(privacy_score) AS s FROM ({_SCORED}) WHERE kind <> 'stack_trace' GROUP BY kind), b AS (SELECT kind, avg(utility_score) AS s FROM ({_SCORED}) WHERE kind <> 'config_blob' GROUP BY kind) SELECT coalesce(a.kind, b.kind) AS kind, round(coalesce(a.s, 0.0), 9) AS auto_s, round(coalesce(b.s, 0.0), 9) AS recon_s FROM a FULL JOIN b ON a.kind = b.kind")
def report_join(spark, sf_dir):
    s = scored(spark, sf_dir)
    a = s.where("kind <> 'stack_trace'").groupBy("kind").agg(F.avg("privacy_score").alias("s"))
    b = s.where("kind <> 'config_blob'").groupBy("kind").agg(F.avg("utility_score").alias("s"))
    out = io.join_reports(a, b, "kind", ["s"], ("auto", "recon"))
    return out.select("kind", F.round("auto_s", 9).alias("auto_s"), F.round("recon_s", 9).alias("recon_s"))


def _written(df: DataFrame, name: str) -> str:
    """The rows as files of JSON lines in the shared folder."""
    path = f"{io.shared_dir(df.sparkSession)}/inkveil-{uuid.uuid4().hex[:12]}-{name}"
    df.write.json(path)
    return path


@query("SELECT 'm' || (o_orderkey // 100) AS name, (row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1)::INT AS position, o_orderkey AS index, o_orderstatus || ' \"é\"' AS prompt_text, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderpriority END AS artifact_kind, count(*) OVER (PARTITION BY o_orderkey // 100) AS selected_count FROM orders")
def json_manifests(spark, sf_dir):
    """Manifests of up to a hundred prompts, written as JSON and read back."""
    o = K.table(spark, sf_dir, "orders")
    record = F.struct(F.col("o_orderkey").alias("index"), F.concat("o_orderstatus", F.lit(' "é"')).alias("prompt_text"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("artifact_kind"))
    group = F.floor(F.col("o_orderkey") / 100)
    rows = o.groupBy(F.concat(F.lit("m"), group.cast("string")).alias("name")).agg(F.count("*").alias("selected_count"), F.sort_array(F.collect_list(record)).alias("records"))
    return io.read_manifest(spark, _written(rows, "manifests"), lines=True).select("name", "position", "index", "prompt_text", "artifact_kind", "selected_count")


@query("SELECT coalesce(source, 'unknown') AS dataset, (row_number() OVER (PARTITION BY source, doc_id // 50 ORDER BY doc_id) - 1)::INT AS prompt_index, text AS prompt_text FROM documents WHERE text IS NOT NULL")
def json_prompts(spark, sf_dir):
    d = K.table(spark, sf_dir, "documents").where("text is not null")
    rows = d.groupBy(F.col("source").alias("dataset"), F.floor(F.col("doc_id") / 50).alias("g")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("r"))
    rows = rows.select("dataset", F.transform("r", lambda x: x["text"]).alias("unique_prompts"))
    return io.read_prompts(spark, _written(rows, "prompts"), lines=True)


@query("SELECT text AS prompt_text, quality::INT AS label, lang || '-' || quality AS strat_key FROM documents JOIN labels USING (doc_id)")
def json_dataset(spark, sf_dir):
    d, lab = K.table(spark, sf_dir, "documents"), K.table(spark, sf_dir, "labels")
    rows = d.join(lab, "doc_id").select(F.col("text").alias("prompt_text"), F.col("quality").alias("label"), F.concat_ws("-", "lang", F.col("quality").cast("string")).alias("strat_key"))
    return io.read_dataset(spark, _written(rows, "dataset"), lines=True)


@query("SELECT o_orderkey AS index, o_orderkey * 2 AS twice FROM orders WHERE o_orderkey % 7 > 0")
def resumed_run(spark, sf_dir):
    """A run in parts, stopped and taken up again; rows without output are not done twice."""
    path = f"{io.shared_dir(spark)}/inkveil-{uuid.uuid4().hex[:12]}-resumed"
    todo = K.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    work = lambda df: df.where("index % 7 > 0").withColumn("twice", F.col("index") * 2)
    size = todo.count()
    io.resume(todo.where("index % 2 = 0"), path, work, guard="m", every=max(1, size // 3))
    return io.resume(todo, path, work, guard="m", every=max(1, size // 3)).select("index", "twice")


_JUDGED_ROWS = "SELECT o_orderkey AS index, CASE o_orderkey % 5 WHEN 0 THEN 'config_blob' ELSE 'mixed_artifact' END AS artifact_kind, CASE o_custkey % 3 WHEN 0 THEN 'naive_mask' ELSE 'tagger' END AS baseline, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' ELSE 'a' END AS winner FROM orders"
_SHARDS = f"(SELECT * FROM ({_JUDGED_ROWS}) WHERE index % 2 = 0 UNION ALL SELECT * FROM ({_JUDGED_ROWS}) WHERE index % 3 = 0)"
_COUNTS = "count(*) AS total, count(*) FILTER (upper(winner) = 'A') AS wins, count(*) FILTER (upper(winner) = 'B') AS losses, round(coalesce(count(*) FILTER (upper(winner) = 'A') / nullif(count(*) FILTER (upper(winner) IN ('A', 'B')), 0)::DOUBLE, 0.0), 9) AS decisive_win_rate"


@query(f"SELECT NULL AS artifact_kind, baseline, {_COUNTS} FROM {_SHARDS} GROUP BY baseline UNION ALL SELECT artifact_kind, baseline, {_COUNTS} FROM {_SHARDS} GROUP BY artifact_kind, baseline")
def merged_summary(spark, sf_dir):
    j = K.from_orders(spark, sf_dir, _JUDGED_ROWS)
    out = io.merge_and_summarise([j.where("index % 2 = 0"), j.where("index % 3 = 0")])
    rows = out["summary"].withColumn("artifact_kind", F.lit(None).cast("string")).unionByName(out["by_artifact"])
    return rows.select("artifact_kind", "baseline", "total", "wins", "losses", F.round("decisive_win_rate", 9).alias("decisive_win_rate"))


# ---------------------------------------------------------------- inference and experiments


def word_model():
    """A stand-in for an encoder: logits from a text's length and words."""
    return lambda texts: [[(len(t) % 7) / 2, (t.count(" ") % 5) / 2] for t in texts]


_INFERRED = "SELECT doc_id, lang, l.quality AS label, (length(text) % 7) / 2.0::DOUBLE AS a, ((length(text) - length(replace(text, ' ', ''))) % 5) / 2.0::DOUBLE AS b FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents) d LEFT JOIN labels l USING (doc_id)"


def inferred(spark, sf_dir) -> DataFrame:
    d, lab = K.table(spark, sf_dir, "documents"), K.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify.infer(d.select("doc_id", "lang", "text"), word_model).drop("text").join(lab, "doc_id", "left")


@query(f"SELECT doc_id, (b > a)::INT AS pred, round(exp(b) / (exp(a) + exp(b)), 9) AS score FROM ({_INFERRED})")
def batch_inference(spark, sf_dir):
    return inferred(spark, sf_dir).select("doc_id", "pred", F.round("score", 9).alias("score"))


@query(f"SELECT lang, count(*) FILTER (label = 1 AND b > a) AS tp, count(*) FILTER (label <> 1 AND b > a) AS fp, count(*) FILTER (label <> 1 AND NOT b > a) AS tn, count(*) FILTER (label = 1 AND NOT b > a) AS fn, round(avg((label = (b > a)::INT)::INT), 9) AS accuracy FROM ({_INFERRED}) WHERE label IS NOT NULL GROUP BY lang")
def experiment_report(spark, sf_dir):
    out = classify.experiment_report(inferred(spark, sf_dir).where("label is not null"), ["lang"])
    return out.select("lang", "tp", "fp", "tn", "fn", F.round("accuracy", 9).alias("accuracy"))


@query()
def classification_bootstrap(spark, sf_dir):
    return stats.classification_bootstrap(inferred(spark, sf_dir).where("label is not null"))


_RUNS = "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'roberta-base__cls' WHEN 1 THEN 'bert-base-uncased__mean' WHEN 2 THEN 'distilbert-base-uncased__max' ELSE 'unheard_of' END AS experiment_id, CAST(CASE WHEN o_orderkey % 4 = 1 THEN 1 + o_custkey % 2 ELSE o_custkey % 3 END AS INT) AS return_code, CAST(o_custkey % 91 AS DOUBLE) / 91 AS accuracy FROM orders"


@query(f"""WITH g AS (SELECT m AS model_name, p AS pooling, replace(m, '/', '_') || '__' || p AS experiment_id FROM (VALUES {', '.join(f'({q(m)})' for m in C.ENCODERS)}) AS a(m), (VALUES ('cls'), ('mean'), ('max')) AS b(p)), r AS (SELECT experiment_id, return_code, accuracy, row_number() OVER (PARTITION BY experiment_id ORDER BY return_code, accuracy DESC) AS i FROM ({_RUNS}))
    SELECT model_name, pooling, g.experiment_id, CASE WHEN i IS NULL THEN 'missing' WHEN return_code = 0 THEN 'done' ELSE 'failed (' || return_code || ')' END AS status, round(accuracy, 9) AS accuracy FROM g LEFT JOIN r ON g.experiment_id = r.experiment_id AND i = 1""")
def grid_status(spark, sf_dir):
    return classify.grid_status(spark, K.from_orders(spark, sf_dir, _RUNS)).withColumn("accuracy", F.round("accuracy", 9))


_CI = "SELECT CAST(o_orderkey AS VARCHAR) AS experiment_id, 'auroc' AS metric, CAST(o_custkey % 97 AS DOUBLE) / 97 AS mean, 0.0 AS ci_lo, 1.0 AS ci_hi FROM orders WHERE o_orderkey % {a} = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'accuracy', CAST(o_custkey % 89 AS DOUBLE) / 89, 0.0, 1.0 FROM orders WHERE o_orderkey % {b} = 0"
_CI1, _CI2 = _CI.format(a=2, b=4), _CI.format(a=3, b=5)


@query(" UNION ALL ".join(f"SELECT '{p}' AS phase, experiment_id, string_agg(metric || '=' || round(mean * 1000)::INT, ',' ORDER BY metric) AS shown FROM ({c}) GROUP BY experiment_id" for p, c in (("phase1", _CI1), ("phase2", _CI2))))
def collated_intervals(spark, sf_dir):
    o = K.table(spark, sf_dir, "orders")
    phases = [(p, spark.sql(c.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}"), orders=o)) for p, c in (("phase1", _CI1), ("phase2", _CI2))]
    shown = F.array_join(F.transform(F.map_entries("bootstrap_ci"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]["mean"] * 1000).cast("int").cast("string"))), ",")
    return classify.collate(phases).select("phase", "experiment_id", shown.alias("shown"))


@query(f"""WITH {PAT}, {_POS}, b(text) AS (VALUES {', '.join(f'({_sqltext(x)})' for x in K.BENIGN)}), r AS (SELECT t, avg(regexp_matches(text, re)::INT) AS recall, count(*) FILTER (regexp_matches(text, re)) AS d, count(*) AS n FROM fix JOIN pat ON t = name GROUP BY t),
    f AS (SELECT text, (SELECT bool_or(regexp_matches(b.text, re)) FROM pat) AS hit FROM b)
    SELECT round((SELECT sum(d) / sum(n) FROM r), 9) AS overall_recall, (SELECT count(*) FROM r WHERE recall < 1)::INT AS n_weak, round(avg(hit::INT), 9) AS false_positive_rate, string_agg(text, '|' ORDER BY text) FILTER (hit) AS false_positives, 1.0::DOUBLE AS key_aware_rate, 1.0::DOUBLE AS kind_accuracy, round(1 - (SELECT sum(d) / sum(n) FROM r), 9) AS missed_span_rate FROM f""")
def coverage_report(spark, sf_dir):
    out = E.coverage(K.positives(spark), K.benign(spark), K.key_fixtures(spark), K.kind_fixtures(spark))
    return out.select(
        F.round("overall_recall", 9).alias("overall_recall"), F.size("weak_types").alias("n_weak"), F.round("false_positive_rate", 9).alias("false_positive_rate"),
        F.array_join("false_positive_examples", "|").alias("false_positives"), "key_aware_rate", "kind_accuracy", F.round("implication.missed_span_rate", 9).alias("missed_span_rate"),
    )


@query()
def attack_dispatch(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    mixed = E.apply(rows, [E.routed("routed", salt=SALT), E.naive()]).withColumn("doc_id", F.concat_ws("-", "policy", F.col("doc_id").cast("string")))
    return attack.attempt_rates(E.attempt_any(mixed, "doc_id", stub, "m"), ["placeholder_type"])


@query()
def policy_evaluation(spark, sf_dir):
    """All ablation policies, scored and broken down: the whole evaluation in one plan."""
    return E.evaluate(K.corpus(spark, sf_dir), E.ablations())

