"""Detection patterns, families, labels, validators and bounds.

Everything in this module is data.  The patterns are written in the syntax that Python, Java and
RE2 share; ``java`` adds the flags under which Java reads them as Python does.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    name: str
    regex: str
    ignore_case: bool
    literals: tuple[str, ...]  # every match contains one of them (lower-cased if ignore_case); () is no gate
    category: str
    family: str
    label: str


# --- fixed values: patterns, in the order that breaks ties ---
PATTERNS = [
    Pattern("api_key_openai", r"sk-(proj-|svcacct-)?[A-Za-z0-9]{20,}", False, ("sk-",), "API Keys & Tokens", "credential", "API_KEY_OPENAI"),
    Pattern("github_token", r"gh[pousr]_[A-Za-z0-9]{36,}", False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "API Keys & Tokens", "credential", "GITHUB_TOKEN"),
    Pattern("jwt_token", r"eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", False, ("eyJ",), "API Keys & Tokens", "credential", "JWT_TOKEN"),
    Pattern("slack_token", r"xox[baprs]-[A-Za-z0-9\-]{10,}", False, ("xox",), "API Keys & Tokens", "credential", "SLACK_TOKEN"),
    Pattern("stripe_key", r"(sk|pk)_(test|live)_[A-Za-z0-9]{24,}", False, ("k_test_", "k_live_"), "API Keys & Tokens", "credential", "STRIPE_KEY"),
    Pattern("twilio_sid", r"AC[A-F0-9]{32}", False, ("AC",), "API Keys & Tokens", "credential", "TWILIO_SID"),
    Pattern("sendgrid_key", r"SG\.[A-Za-z0-9\-_]{22,}\.[A-Za-z0-9\-_]{43,}", False, ("SG.",), "API Keys & Tokens", "credential", "SENDGRID_KEY"),
    Pattern("google_api_key", r"AIza[0-9A-Za-z\-_]{35}", False, ("AIza",), "API Keys & Tokens", "credential", "GOOGLE_API_KEY"),
    Pattern("firebase_url", r"https://[a-z0-9\-]+\.firebaseio\.com", True, (".firebaseio.com",), "API Keys & Tokens", "network", "FIREBASE_URL"),
    Pattern("telegram_bot_token", r"\d{8,10}:[A-Za-z0-9\-_]{35}", False, (":",), "API Keys & Tokens", "credential", "TELEGRAM_BOT_TOKEN"),
    Pattern("discord_token", r"[MN][A-Za-z0-9]{23}\.[A-Za-z0-9\-_]{6}\.[A-Za-z0-9\-_]{27}", False, (), "API Keys & Tokens", "credential", "DISCORD_TOKEN"),
    Pattern("discord_webhook", r"https://discord(app)?\.com/api/webhooks/\d+/[A-Za-z0-9\-_]+", True, ("/api/webhooks/",), "API Keys & Tokens", "credential", "DISCORD_WEBHOOK"),
    Pattern("npm_token", r"npm_[A-Za-z0-9]{36}", False, ("npm_",), "API Keys & Tokens", "credential", "NPM_TOKEN"),
    Pattern("digitalocean_token", r"dop_v1_[a-f0-9]{64}", False, ("dop_v1_",), "API Keys & Tokens", "credential", "DIGITALOCEAN_TOKEN"),
    Pattern("shopify_token", r"shpat_[a-fA-F0-9]{32}", False, ("shpat_",), "API Keys & Tokens", "credential", "SHOPIFY_TOKEN"),
    Pattern("gitlab_token", r"glpat-[A-Za-z0-9\-_]{20}", False, ("glpat-",), "API Keys & Tokens", "credential", "GITLAB_TOKEN"),
    Pattern("mapbox_token", r"pk\.eyJ1[A-Za-z0-9\-_\.]+", False, ("pk.eyJ1",), "API Keys & Tokens", "credential", "MAPBOX_TOKEN"),
    Pattern("aws_access_key", r"AKIA[0-9A-Z]{16}", False, ("AKIA",), "Cloud Credentials", "credential", "AWS_ACCESS_KEY"),
    Pattern("gcp_credentials", r'"type"\s*:\s*"service_account"', True, ('"service_account"',), "Cloud Credentials", "credential", "GCP_SERVICE_ACCOUNT"),
    Pattern("azure_connection", r"DefaultEndpointsProtocol=https;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]+", True, ("accountname=",), "Cloud Credentials", "credential", "AZURE_CONNECTION"),
    Pattern("private_key_header", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", False, ("PRIVATE KEY-----",), "Cryptographic Material", "credential", "PRIVATE_KEY"),
    Pattern("ssh_public_key", r"ssh-(rsa|dss|ed25519|ecdsa)\s+[A-Za-z0-9+/=]{100,}", False, ("ssh-",), "Cryptographic Material", "credential", "SSH_PUBLIC_KEY"),
    Pattern("certificate", r"-----BEGIN CERTIFICATE-----", False, ("-----BEGIN CERTIFICATE-----",), "Cryptographic Material", "credential", "CERTIFICATE"),
    Pattern("url_with_credentials", r"https?://[^:@\s]+:[^@\s]{4,}@[^\s]+", True, ("http",), "Cryptographic Material", "network", "URL_WITH_CREDS"),
    Pattern("db_connection_string", r'(mongodb(\+srv)?|postgres(ql)?|mysql|redis|mssql|sqlite|oracle):\/\/[^\s"\'<>]+', True, ("://",), "Database Credentials", "network", "DB_CONN"),
    Pattern("jdbc_url", r'jdbc:[a-z]+://[^\s"\']+', True, ("jdbc:",), "Database Credentials", "network", "JDBC_URL"),
    Pattern("connection_string_kv", r"(Server|Data Source)\s*=\s*[^;]+;\s*(Database|Initial Catalog)\s*=\s*[^;]+", True, (";",), "Database Credentials", "network", "CONN_STR"),
    Pattern("internal_ip", r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", False, ("10.", "172.", "192.168."), "Internal Infrastructure", "network", "IP_PRIVATE"),
    Pattern("docker_registry", r'[a-z0-9\-\.]+\.(azurecr\.io|ecr\.[a-z0-9\-]+\.amazonaws\.com|gcr\.io)/[^\s"\']+', True, (".azurecr.io/", ".amazonaws.com/", ".gcr.io/"), "Internal Infrastructure", "network", "DOCKER_REGISTRY"),
    Pattern("kubernetes_secret", r"kind:\s*Secret", True, ("kind:",), "Internal Infrastructure", "network", "K8S_SECRET"),
    Pattern("stack_trace", r'(Traceback \(most recent call last\)|at [a-zA-Z\.]+\([A-Za-z]+\.java:\d+\)|File "[^"]+", line \d+)', False, ("Traceback (", ".java:", 'File "'), "System Internals / Stack Traces", "stack", "STACK_TRACE"),
    Pattern("unix_path", r"(/home/[^\s/]+|/var/www|/etc/[^\s]+|/usr/local/[^\s]+)", False, ("/home/", "/var/www", "/etc/", "/usr/local/"), "System Internals / Stack Traces", "path", "UNIX_PATH"),
    Pattern("windows_path", r'[A-Za-z]:\\[^\s"\'<>]{5,}', False, (":\\",), "System Internals / Stack Traces", "path", "WIN_PATH"),
    Pattern("docker_compose_secret", r"(MYSQL_ROOT_PASSWORD|POSTGRES_PASSWORD|MONGO_INITDB_ROOT_PASSWORD)\s*[:=]\s*\S+", False, ("_PASSWORD",), "CI/CD & DevOps Secrets", "credential", "COMPOSE_SECRET"),
    Pattern("ansible_vault", r"\$ANSIBLE_VAULT;\d+\.\d+", False, ("$ANSIBLE_VAULT;",), "CI/CD & DevOps Secrets", "credential", "ANSIBLE_VAULT"),
    Pattern("email_address", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", False, ("@",), "PII", "identifier", "EMAIL"),
    Pattern("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b", False, (), "PII", "identifier", "CARD_NUMBER"),
    Pattern("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b", False, (), "PII", "identifier", "IBAN"),
    Pattern("wallet_address_eth", r"\b0x[a-fA-F0-9]{40}\b", False, ("0x",), "Financial / Crypto", "identifier", "ETH_ADDRESS"),
    Pattern("crypto_private_key", r"\b[5KL][1-9A-HJ-NP-Za-km-z]{50,51}\b", False, (), "Financial / Crypto", "credential", "CRYPTO_PRIVATE_KEY"),
    Pattern("commented_credential", r"(#|//|/\*)\s*(password|api.?key|secret|token)\s*[:=]\s*\S{4,}", True, ("password", "key", "secret", "token"), "CI/CD & DevOps Secrets", "credential", "COMMENTED_CREDENTIAL"),
    Pattern("proprietary_endpoint", r"https?://[a-z0-9\-]+\.(internal|private|local|corp|lan)(:\d+)?(/[^\s]*)?", True, ("http",), "Internal Infrastructure", "network", "PRIVATE_ENDPOINT"),
    Pattern("ci_secret_var", r"(TRAVIS|CIRCLE|JENKINS|GITHUB_ACTIONS|GITLAB_CI)[_\-]?(TOKEN|SECRET|KEY|PASSWORD)\s*[:=]\s*\S+", True, ("travis", "circle", "jenkins", "github_actions", "gitlab_ci"), "CI/CD & DevOps Secrets", "credential", "CI_SECRET"),
]
PRIORITY = {p.name: i for i, p in enumerate(PATTERNS)}
LABEL = {p.name: p.label for p in PATTERNS}
CATEGORY = {p.name: p.category for p in PATTERNS}
FAMILY = {p.name: p.family for p in PATTERNS}

# --- fixed values: which patterns count as high risk ---
#: when rewriting: all credentials
HIGH_RISK_REWRITE = [p.name for p in PATTERNS if p.family == "credential"]
#: when scoring: without vault headers, with these others
HIGH_RISK_SCORE = [
    p.name
    for p in PATTERNS
    if (p.family == "credential" and p.name != "ansible_vault")
    or p.name in ("credit_card", "db_connection_string", "email_address", "iban", "internal_ip", "jdbc_url", "url_with_credentials", "wallet_address_eth")
]
URI_PATTERNS = ["db_connection_string", "jdbc_url", "url_with_credentials", "firebase_url", "proprietary_endpoint"]

# --- fixed values: line and token patterns ---
JAVA_FRAME = r"^\s*at\s+([A-Za-z0-9_.$<>]+)\(([A-Za-z0-9_.$<>-]+):(\d+)\)\s*$"
PYTHON_FRAME = r'^\s*File "([^"]+)", line (\d+)(?:, in ([A-Za-z0-9_.$<>-]+))?'
EXCEPTION = r"\b([A-Za-z_][A-Za-z0-9_.]*(?:Exception|Error|Traceback))\b"
CONFIG_KEY = r"(?m)^\s*([A-Za-z_][A-Za-z0-9_.-]{1,63})\s*[:=]"
SAFE_TOKEN = r"[A-Za-z_][A-Za-z0-9_.-]{2,}"
FRAME_MARKS = ("JAVA_FRAME method=", "PY_FRAME file=")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# --- fixed values: rewriting ---
BENIGN_KEYWORD = r"(?i)^(true|false|yes|no|null|none|enabled|disabled|on|off|\d{1,10}(\.\d+)?|[0-9a-f]{1,8})$"
BENIGN_ENUM = r"^[A-Z][A-Z0-9_]{1,31}$"
SENSITIVE_KEY = r"(?i)(password|passwd|secret|token|api[_\-]?key|apikey|auth|credential|private[_\-]?key|access[_\-]?key|client[_\-]?secret)"
KEY_LINE = r"(?m)^(\s*)([A-Za-z_][A-Za-z0-9_.\-]{0,63})\s*([=:])\s*(.+)$"
CREDENTIAL_PREFIX = r"\b(sk-|ghp_|ghs_|AKIA|eyJ[A-Za-z0-9]|xox[bpoa]-)"
MESSAGE_PATH = r"""(/(?:home|usr|etc|var|opt|srv|tmp|root|app|workspace|data|mnt|run|proc|Users)[^\s"'`\n,){;\\]{1,300})|([A-Za-z]:\\[^\s"'`\n,){;]{1,300})"""
PRIVATE_IP = r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2[0-9]|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"
KEYWORD_VALUE = r"""(?i)(\b(?:password|passwd|secret|token|api[_\-]?key|apikey|auth(?:_?token)?|credential|private[_\-]?key)\s*=\s*)(["\']?)([^"\')\s,\n]{4,})\2"""
UNIX_USER = r"""/home/[^/\s"'`\n]+"""
WINDOWS_USER = r"""[A-Za-z]:\\Users\\[^\\\s"'`\n]+"""
PATH_TAIL = r"""^([/\\][^\s\n"'`<>()\[\]]{1,512})"""
LOCALS_HEADERS = ("local variables:", "locals:")
TRACE_HEADERS = (
    "Traceback (most recent call last):",
    "During handling of the above exception, another exception occurred:",
    "The above exception was the direct cause of the following exception:",
)
PRIVATE_SUFFIXES = (".internal", ".private", ".local", ".corp", ".lan")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
SYSTEM_ROOTS = ("etc", "var", "usr", "opt", "srv", "proc")
IP_CLASSES = [
    ("IP_10", r"^10\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("IP_172", r"^172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}$"),
    ("IP_192_168", r"^192\.168\.\d{1,3}\.\d{1,3}$"),
]

# --- fixed values: operators by artifact kind ---
KINDS = ["stack_trace", "config_blob", "secret_blob", "network_artifact", "filesystem_trace", "identifier_blob", "mixed_artifact", "clean_text"]
ROUTES = {
    "stack_trace": ["SUMMARIZE"],
    "config_blob": ["CANONICALIZE"],
    "secret_blob": ["SUPPRESS", "ABSTRACT"],
    "network_artifact": ["ABSTRACT"],
    "filesystem_trace": ["GENERALIZE"],
    "identifier_blob": ["ABSTRACT"],
    "mixed_artifact": ["SUPPRESS", "ABSTRACT"],
    "clean_text": [],
}
#: what each operator keeps, what it removes, how private it is
OPERATORS = {
    "SUPPRESS": (["semantic_type"], ["value", "format", "structure", "context"], "maximum"),
    "ABSTRACT": (["semantic_type", "cardinality", "relative_position"], ["value", "exact_format"], "high"),
    "SUMMARIZE": (["exception_type", "frame_count", "method_signatures", "file_names", "line_numbers"], ["variable_values", "message_details", "full_class_hierarchy", "local_state"], "high"),
    "CANONICALIZE": (["key_names", "structure", "benign_scalar_values", "value_types"], ["sensitive_values", "user_identifiers", "credentials", "internal_hosts"], "medium"),
    "GENERALIZE": (["path_tail", "path_depth", "separator_style", "file_extension"], ["absolute_root", "username", "hostname", "intermediate_directories"], "high"),
}

# --- fixed values: attempts at reconstruction ---
VALIDATORS = {
    "API_KEY_OPENAI": r"^sk-[A-Za-z0-9]{20,}$",
    "GITHUB_TOKEN": r"^(ghp_|ghs_|github_pat_)[A-Za-z0-9_]{10,}$",
    "AWS_ACCESS_KEY": r"^AKIA[A-Z0-9]{16}$",
    "JWT_TOKEN": r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$",
    "SLACK_TOKEN": r"^xox[bpoa]-[A-Za-z0-9-]+$",
    "STRIPE_KEY": r"^(sk|pk)_(live|test)_[A-Za-z0-9]{24,}$",
    "UNIX_HOME": r"^/home/[a-z][a-z0-9_-]{0,31}(/.*)?$",
    "UNIX_ROOT": r"^/[a-z][a-z0-9/._-]+$",
    "WIN_HOME": r"^[A-Z]:\\Users\\[A-Za-z][A-Za-z0-9 _-]*",
    "WIN_ROOT": r"^[A-Z]:\\[A-Za-z0-9 _\\.-]+$",
    "IP_10": r"^10\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "IP_172": r"^172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}$",
    "IP_192_168": r"^192\.168\.\d{1,3}\.\d{1,3}$",
    "IP_PRIVATE": r"^(10|172|192\.168)\.\d+\.\d+\.\d+$",
    "EMAIL": r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z]{2,}$",
    "PRIVATE_HOST": r"^[a-z][a-z0-9.-]*\.(internal|local|corp|lan|private)$",
    "DB_PASS": r"^.{6,}$",
    "DB_USER": r"^[A-Za-z][A-Za-z0-9_-]{1,31}$",
    "SECRET_VALUE": r"^.{4,}$",
    "CARD_NUMBER": r"^\d{13,19}$",
    "IBAN": r"^[A-Z]{2}\d{2}[A-Za-z0-9]{1,30}$",
    "ETH_ADDRESS": r"^0x[0-9a-fA-F]{40}$",
    "CRYPTO_PRIVATE_KEY": r"^[A-Za-z0-9+/=]{40,}$",
}
BUCKETS = {
    "api_token": ["API_KEY_OPENAI", "GITHUB_TOKEN", "SLACK_TOKEN", "STRIPE_KEY", "AWS_ACCESS_KEY", "GITLAB_TOKEN", "TELEGRAM_BOT_TOKEN", "DISCORD_TOKEN"],
    "cryptographic_key": ["PRIVATE_KEY", "SSH_PUBLIC_KEY", "CERTIFICATE", "CRYPTO_PRIVATE_KEY"],
    "auth_token": ["JWT_TOKEN"],
    "filesystem_path": ["UNIX_HOME", "UNIX_ROOT", "WIN_HOME", "WIN_ROOT"],
    "network_address": ["IP_10", "IP_172", "IP_192_168", "IP_PRIVATE", "PRIVATE_HOST"],
    "pii_identifier": ["EMAIL"],
    "pii_financial": ["CARD_NUMBER", "IBAN"],
    "credential": ["DB_PASS", "DB_USER", "SECRET_VALUE"],
    "crypto_identifier": ["ETH_ADDRESS"],
}
BUCKET = {t: b for b, types in BUCKETS.items() for t in types}

# --- fixed values: sizes of value spaces, as alphabet and length, or bits ---
VALUE_SPACES = {
    "AWS_ACCESS_KEY": (36, 16),
    "API_KEY_OPENAI": (62, 48),
    "GITHUB_TOKEN": (62, 36),
    "JWT_TOKEN": (62, 80),
    "SLACK_TOKEN": (62, 24),
    "STRIPE_KEY": (62, 24),
    "CRYPTO_PRIVATE_KEY": (2, 256),
    "DB_PASS": (95, 12),
    "DB_USER": (26, 8),
    "EMAIL": (208827064576000000, 1),
    "CARD_NUMBER": (10, 16),
    "ETH_ADDRESS": (2, 160),
    "IBAN": (10, 20),
    "PRIVATE_HOST": (26, 10),
    "SECRET_VALUE": (95, 16),
}
DEFAULT_SPACE = (62, 20)
TYPE_VOCABULARY = 25
#: (operator, exact recovery: "default" space, "million" or "none", format recovery, disclosure weight, deterministic linkage, extra bits beside the type's, factor of type bits)
OPERATOR_BOUNDS = [
    ("SUPPRESS", "default", 0.50, 0.3, False),
    ("ABSTRACT", "default", 0.70, 0.7, True),
    ("SUMMARIZE", "none", 0.0, 0.0, False),
    ("CANONICALIZE", "default", 0.50, 0.5, True),
    ("GENERALIZE", "million", 0.30, 0.2, True),
]

# --- fixed values: keyword classifier ---
KEYWORDS = [
    r"(?i)(api[_\-\s]?key|access[_\-]?token|bearer\s+[a-zA-Z0-9+/]{20,}|Authorization:\s*Bearer|secret[_\-]?key|client[_\-]?secret)",
    r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"(?i)(first[\s_]?name|last[\s_]?name|date[\s_]?of[\s_]?birth|home[\s_]?address|social[\s_]?security)",
    r"(?i)(password\s*[=:]\s*\S+|db[_\-]?pass|mongodb(\+srv)?://[^/\s]+:[^/\s]+@|postgresql://[^/\s]+:[^/\s]+@|mysql://[^/\s]+:[^/\s]+@|connection[_\-]?string|jdbc:[a-z]+://)",
    r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY",
    r"(?i)(private[_\-]?key|-----BEGIN CERTIFICATE)",
    r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b",
    r"(?i)(internal[_\-]?hostname|corp\.|\.internal\b|\.local\b)",
    r"\b4[0-9]{12}(?:[0-9]{3})?\b",
    r"\b5[1-5][0-9]{14}\b",
    r"\b(?:0x)?[0-9a-fA-F]{40}\b",
    r"(?i)(account[_\-]?number|routing[_\-]?number|iban\b|swift\b)",
    r"(?i)(GITHUB_TOKEN|TRAVIS_CI|CIRCLE_CI|JENKINS_|AWS_SECRET|DOCKER_HUB_PASSWORD|NPM_TOKEN|PYPI_TOKEN)",
]

# --- fixed values: experiment grid ---
ENCODERS = ["bert-base-uncased", "roberta-base", "microsoft/deberta-base", "microsoft/codebert-base", "microsoft/unixcoder-base", "distilbert-base-uncased"]
POOLINGS = ["cls", "mean", "max"]


def java(regex: str) -> str:
    """The pattern as Java reads it in Python's way: only a newline ends a line, and classes, word
    boundaries and case are Unicode's."""
    return "(?dUu)" + regex


def re2(p: Pattern) -> str:
    return ("(?i)" if p.ignore_case else "") + p.regex
