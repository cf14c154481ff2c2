"""Names, thresholds, word lists and texts that results depend on.

Everything here is data.  Logic lives in ``functions`` and ``operators``.
"""

# ---- enumerations -----------------------------------------------------------
SCAN_SOURCES = ["semgrep", "sonarqube", "bandit", "phpcs", "sarif"]
SCAN_STATUSES = ["uploaded", "parsing", "scoring", "complete", "failed"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
FINDING_STATUSES = ["pending", "triaged", "suppressed", "reported"]
LABELS = ["true_positive", "false_positive"]
FEEDBACK_SOURCES = ["human", "ai_pseudo", "benchmark", "import"]
TRUSTED_SOURCES = ["human", "benchmark", "import"]
CLASSIFICATIONS = ["confirmed_tp", "likely_tp", "needs_validation", "likely_fp", "confirmed_fp"]
TP_CLASSES = ["confirmed_tp", "likely_tp"]
FP_CLASSES = ["confirmed_fp", "likely_fp"]
OUTCOMES = ["true_positive", "false_positive", "true_negative", "false_negative", "unresolved"]
VERDICTS = ["correct", "incorrect", "partially_correct", "insufficient_context"]
REASON_CODES = [
    "missed_source",
    "missed_sink",
    "missed_sanitizer",
    "incorrect_data_flow",
    "incorrect_precondition",
    "hallucinated_evidence",
    "missing_context",
    "weak_reasoning",
    "other",
]
REVIEWERS = ["offensive", "defensive"]
ADJUDICATOR = "adjudicator"
ACTIVE_RUN_STATUSES = ["queued", "running", "running_with_errors"]
TERMINAL_RUN_STATUSES = ["complete", "complete_with_errors", "failed", "skipped"]
PSEUDO_NOTE_PREFIXES = ["AI training label from", "AI_PROMOTED"]

# ---- feature vector ---------------------------------------------------------
LEGACY_FEATURES = [
    "cwe_id",
    "scanner_severity",
    "file_extension",
    "is_test_file",
    "cyclomatic_complexity",
    "has_sanitizer_in_ast",
    "line_depth_in_function",
    "historical_fp_rate_rule",
    "developer_experience_lvl",
]
DATAFLOW_FEATURES = [
    "reaches_request_input",
    "taint_steps",
    "sanitised_before_sink",
    "attacker_reachable_context",
]
FEATURES = LEGACY_FEATURES + DATAFLOW_FEATURES
TEXT_FEATURES = [
    "scanner_severity",
    "file_extension",
    "developer_experience_lvl",
    "attacker_reachable_context",
]
FEATURE_DEFAULTS = {
    "cwe_id": 0,
    "scanner_severity": "MEDIUM",
    "file_extension": "php",
    "is_test_file": 0,
    "cyclomatic_complexity": 0,
    "has_sanitizer_in_ast": 0,
    "line_depth_in_function": 0,
    "historical_fp_rate_rule": 0.0,
    "developer_experience_lvl": "unknown",
    "reaches_request_input": -1,
    "taint_steps": -2,
    "sanitised_before_sink": -1,
    "attacker_reachable_context": "unknown",
}
SPLIT_STRATEGY = "project_commit_hash_v1"
FEATURE_SCHEMA_VERSION = "source-dataflow-v2"
CONTEXT_FORMAT_VERSION = "compact-v2"
EXPORT_SCHEMA_VERSION = "1.0"

# ---- report parsing ---------------------------------------------------------
SARIF_LEVEL_SEVERITY = {"error": "HIGH", "warning": "MEDIUM", "note": "LOW"}
SEVERITY_SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}

# ---- built-in detection rules: id, cwe, severity, description ----------------
DETECTION_RULES = [
    ("php.laravel.security.sql-injection", 89, "HIGH",
     "SQL statement assembled from dynamic input rather than bound parameters"),
    ("php.security.command-injection", 78, "CRITICAL", "Shell command built from dynamic input"),
    ("php.security.unserialize-user-input", 502, "CRITICAL",
     "unserialize() applied to untrusted data allows object injection"),
    ("php.security.path-traversal", 22, "HIGH",
     "Filesystem path or include target derived from dynamic input"),
    ("php.laravel.security.xss-unescaped-output", 79, "MEDIUM",
     "Dynamic value rendered without HTML escaping"),
    ("php.laravel.security.mass-assignment", 915, "MEDIUM",
     "Model populated directly from request input without an explicit field list"),
    ("php.security.weak-hashing", 327, "LOW", "Cryptographically broken hash function"),
    ("php.security.hardcoded-secret", 798, "HIGH", "Credential committed in source"),
]
DETECTION_MESSAGES = {
    "sql_built": "SQL string is concatenated or interpolated from variables",
    "sql_dynamic": "Raw SQL receives a dynamic value",
    "shell_backtick": "Backtick shell execution",
    "shell_dynamic": "Shell command receives a dynamic value",
    "unserialize_request": "unserialize() called directly on request input",
    "unserialize_dynamic": "unserialize() called on a dynamic value",
    "include_dynamic": "Dynamic include/require can execute arbitrary files",
    "path_built": "File path is concatenated from dynamic parts",
    "path_dynamic": "File operation receives a dynamic path",
    "output_unescaped": "Unescaped dynamic value sent to output",
    "mass_assignment": "Request input passed wholesale into a model write",
    "hash_credential": "() appears to hash a credential",
    "hash_weak": "() is cryptographically broken",
    "secret": "Hard-coded credential in source",
}
SHELL_FUNCTIONS = ["exec", "shell_exec", "system", "passthru", "popen", "proc_open", "pcntl_exec"]
FILE_FUNCTIONS = [
    "file_get_contents", "file_put_contents", "fopen", "unlink", "readfile", "file",
    "copy", "rename", "rmdir", "mkdir", "scandir", "opendir",
]
DB_STATIC_METHODS = ["raw", "select", "statement", "unprepared", "insert", "update", "delete"]
BUILDER_RAW_METHODS = [
    "whereraw", "selectraw", "orderbyraw", "havingraw", "groupbyraw", "joinraw", "fromraw",
]
OUTPUT_ESCAPERS = [
    "e", "htmlspecialchars", "htmlentities", "strip_tags", "json_encode", "urlencode", "rawurlencode",
]
ASSIGNING_METHODS = ["create", "fill", "update", "forcecreate", "firstorcreate", "updateorcreate"]
REQUEST_READ_METHODS = ["all", "input", "get", "query", "post", "json"]
WEAK_HASHES = ["md5", "sha1", "crc32"]
CREDENTIAL_HINTS = ["password", "passwd", "secret", "token", "credential", "apikey", "api_key"]
SECRET_PLACEHOLDERS = ["changeme", "placeholder", "example", "your_", "xxxx"]
SCOPE_SANITIZER_FUNCTIONS = [
    "htmlspecialchars", "htmlentities", "strip_tags", "filter_var",
    "escapeshellarg", "escapeshellcmd", "addslashes", "mysqli_real_escape_string",
]
SCOPE_SANITIZER_METHODS = ["quote", "prepare", "bind", "bindValue", "bindParam", "e"]
EXCLUDED_DIRECTORIES = [
    "vendor", "node_modules", "storage", "bootstrap", "public", ".git", ".github", "dist",
    "build", "coverage", "_ide_helper", ".claude", ".worktrees", ".idea", ".vscode",
]

# ---- dataflow ---------------------------------------------------------------
CWE_SINK_KINDS = {
    22: "path_access", 23: "path_access", 36: "path_access", 73: "path_access",
    78: "command_execution",
    79: "html_output", 80: "html_output", 116: "html_output",
    89: "sql_query",
    502: "deserialization",
    915: "mass_assignment",
}
RULE_SINK_KEYWORDS = [
    (["command", "shell"], "command_execution"),
    (["sql"], "sql_query"),
    (["path", "traversal", "file-inclusion"], "path_access"),
    (["xss", "unescaped"], "html_output"),
    (["deserial", "unserialize"], "deserialization"),
    (["mass-assignment"], "mass_assignment"),
]
SINK_CALLS = {
    "command_execution": ["exec", "passthru", "pcntl_exec", "popen", "proc_open", "shell_exec", "system"],
    "sql_query": ["mysql_query", "pg_query", "sqlite_query", "mysqli_query", "mysqli_real_query",
                  "mysqli_multi_query", "query", "select", "selectraw", "statement", "unprepared", "prepare"],
    "path_access": ["file", "file_get_contents", "file_put_contents", "fopen", "glob", "mkdir", "opendir",
                    "readfile", "rmdir", "scandir", "unlink", "copy", "rename"],
    "deserialization": ["unserialize"],
    "html_output": ["printf", "vprintf"],
    "mass_assignment": ["create", "fill", "forcefill", "update"],
}
REQUEST_SUPERGLOBALS = {
    "_GET": "query", "_POST": "body", "_REQUEST": "request",
    "_COOKIE": "cookie", "_FILES": "file", "_SERVER": "server",
}
REQUEST_METHOD_CONTEXTS = {
    "query": "query", "post": "body", "file": "file", "cookie": "cookie",
    "header": "server", "server": "server",
    "all": "request", "get": "request", "input": "request", "validated": "request",
}
PATH_SANITIZERS = {
    "command_execution": ["escapeshellarg", "escapeshellcmd"],
    "sql_query": ["mysqli_real_escape_string", "mysqli_escape_string", "pg_escape_literal",
                  "pg_escape_string", "sqlite_escape_string", "quote"],
    "html_output": ["htmlspecialchars", "htmlentities", "e"],
    "path_access": ["basename"],
}

# ---- review queue -----------------------------------------------------------
REVIEW_SEVERITY_POINTS = {"CRITICAL": 40, "HIGH": 30, "MEDIUM": 20}
REVIEW_CLASS_POINTS = {
    "confirmed_tp": 15, "likely_tp": 12, "needs_validation": 6, "likely_fp": 3, "confirmed_fp": 0,
}
REVIEW_CSV_COLUMNS = [
    "priority_score", "finding_id", "project_id", "scan_id", "scanner_source", "commit_sha",
    "fingerprint_sha256", "group_sha256", "rule_id", "cwe_id", "file_path", "line_number",
    "severity", "message", "source_excerpt", "model_advisory_probability", "advisory_summary",
    "human_label",
]

# ---- dataset warnings and gate texts ----------------------------------------
WARNING_TEXTS = {
    "train_labels": "The trusted training partition does not contain both labels.",
    "validation_labels": "The trusted validation partition does not contain both labels.",
    "validation_support": "The validation partition has fewer true positives than the deployment support gate requires.",
    "validation_groups": "The validation partition has true positives from fewer independent project groups than the deployment gate requires.",
    "imbalance": "The trusted training partition is imbalanced at %.1f false positives per true positive.",
    "quarantine": "%d weak or unattributed labeled record(s) were quarantined and cannot certify the model.",
    "truncated": "%d review candidate(s) were omitted by the review limit.",
    "ambiguous": "%d labeled row(s) share features with the opposite label.",
    "conflicts": "%d exact finding row(s) were excluded because their labels conflict.",
    "inconsistent": "%d row(s) were excluded because finding and feedback labels disagree.",
}
GATE_TEXTS = {
    "support": "Validation contains only %d true positives; at least %d are required.",
    "groups": "Validation true positives cover only %d project group%s; at least %d are required.",
    "flags": "Candidate flagged only %d validation findings; at least %d are required.",
    "precision": "Candidate precision %.1f%% is below the %.1f%% deployment gate.",
}
