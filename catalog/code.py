"""Queries for detection, code features, dataflow and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import CTE
from winnow import fixed_values as fv
from winnow.functions import fixes, texts
from winnow.operators import dataflow, detect, features
from winnow.sources import files


def q(s: str) -> str:
    """SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def rl(c, pattern):
    return f"regexp_matches({c}, {q(pattern)})"


CTE["code"] = (["code_lines"], f"SELECT *, regexp_replace(text, {q(detect.COMMENT)}, '\\1', 'g') AS code FROM code_lines")
CTE["blank"] = (["code"], f"SELECT *, regexp_replace(code, {q(detect.STRING)}, '\"\"', 'g') AS bare FROM code")
M = fv.DETECTION_MESSAGES
D = detect
#: what each kind of code line (its number) holds, stated by hand: rule, which call of the line, message
HITS = [
    (4, "xss-unescaped-output", 1, M["output_unescaped"]),
    (6, "command-injection", 1, M["shell_dynamic"]),
    (7, "weak-hashing", 1, "md5" + M["hash_credential"]),
    (8, "mass-assignment", 1, M["mass_assignment"]),
    (9, "hardcoded-secret", 1, M["secret"]),
    (10, "path-traversal", 1, M["path_dynamic"]),
    (11, "unserialize-user-input", 1, M["unserialize_request"]),
    (11, "sql-injection", 1, M["sql_built"]),
    (13, "command-injection", 1, M["shell_dynamic"]),
    (13, "command-injection", 2, M["shell_dynamic"]),
    (13, "command-injection", 3, M["shell_dynamic"]),
    (14, "sql-injection", 1, M["sql_built"]),
    (14, "path-traversal", 1, M["path_dynamic"]),
    (15, "xss-unescaped-output", 1, M["output_unescaped"]),
    (16, "command-injection", 1, M["shell_backtick"]),
]
#: sinks: line kind, number on the line, kind, name, traced arguments, shape, variables, request input, fitting sanitizer
SINKS = [
    (4, 1, "html_output", "echo", ['"<b>" . $v2'], "concatenation", "v2", "", False),
    (6, 1, "command_execution", "exec", ['"run " . $v4 . $v2'], "concatenation", "v2,v4", "", False),
    (10, 1, "path_access", "file_get_contents", ["basename($v3)"], "function_call", "v3", "", True),
    (11, 1, "deserialization", "unserialize", ['$_POST["p"]'], "array_access", "", "body", False),
    (11, 2, "sql_query", "select", ['"SELECT 1 FROM t WHERE x = $v1"'], "interpolation", "v1", "", False),
    (13, 1, "command_execution", "system", ["$a"], "variable", "a", "", False),
    (13, 2, "command_execution", "system", ["$v1"], "variable", "v1", "", False),
    (13, 3, "command_execution", "exec", ['"id"'], "literal", "", "", False),
    (13, 4, "command_execution", "exec", ["$v2"], "variable", "v2", "", False),
    (14, 1, "sql_query", "mysqli_query", ['"SELECT " . $v2'], "concatenation", "v2", "", False),
    (14, 2, "path_access", "copy", ["$v1", '"/tmp/c%d"'], "multiple", "v1", "", False),
    (15, 1, "html_output", "echo", ["$x"], "variable", "x", "", False),
    (16, 1, "command_execution", "backtick", ["$v1"], "variable", "v1", "", False),
]
#: assignments that sinks can reach: line kind, variable, variables of the right side, request input, sink kind it cleans for
ASSIGNED = [(1, "v1", "", "query", ""), (2, "v2", "v1", "", ""), (3, "v3", "v2", "", "html_output"), (5, "v4", "", "", ""), (15, "x", "", "request", ""), (17, "v2", "v2", "", "")]


def values(rows, names):
    lit = lambda v: str(v) if isinstance(v, (bool, int)) else q(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") v({names})"


def listed(c):
    return f"list_filter(string_split({c}, ','), lambda x: x <> '')"


def rule_id(short):
    return next(r for r in fv.DETECTION_RULES if r[0].endswith(short))[0]


HITS_SQL = values([(tpl, rule_id(short), n, m) for tpl, short, n, m in HITS], "kind, rule_id, occurrence, message")
CTE["hits"] = (["code_lines"], f"SELECT c.*, v.rule_id, v.occurrence, v.message FROM code_lines c JOIN {HITS_SQL} ON v.kind = c.tpl")
CTE["sinks"] = (["scoped"], f"""
SELECT file_path, line_no, coalesce(s,0) AS scope, sink_no, sink_kind, sink_name, replace(arguments, '%d', CAST(digit AS VARCHAR)) AS arguments, shape, uses, input, clean
FROM scoped JOIN {values([(*r[:4], " | ".join(r[4]), *r[5:]) for r in SINKS], "kind, sink_no, sink_kind, sink_name, arguments, shape, uses, input, clean")} ON v.kind = tpl""")


def rule_sql(short):
    return f"SELECT file_path, line_no AS line_number, rule_id, occurrence, message FROM hits WHERE rule_id = {q(rule_id(short))}"


def _one_rule(short):
    def run(t):
        return detect.scan_lines(t.code_lines, [rule_id(short)]).select("file_path", "line_number", "rule_id", "occurrence", "message")
    return run


for _i, _short in enumerate(["sql-injection", "command-injection", "unserialize-user-input", "path-traversal",
                             "xss-unescaped-output", "mass-assignment", "weak-hashing", "hardcoded-secret"]):
    query(f"det_{_i + 2:02d}_{_short.replace('-', '_')}", "hits", sql=rule_sql(_short))(_one_rule(_short))


@query("det_01_rule_scan", "hits", sql="""
SELECT rule_id, count(*) AS hits, count(DISTINCT file_path) AS files, CAST(sum(length(trim(text))) AS BIGINT) AS snippet_chars FROM hits GROUP BY 1""")
def _(t):
    return detect.scan_lines(t.code_lines).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("file_path").alias("files"),
        F.sum(F.length("snippet")).alias("snippet_chars"))


@query("det_01_files_scanned", "hits", sql="""
, f AS (SELECT file_path, max(line_no) AS lines FROM code_lines GROUP BY 1), n AS (SELECT file_path, count(*) AS findings FROM hits GROUP BY 1)
SELECT f.file_path, f.lines, coalesce(findings,0) AS findings FROM f LEFT JOIN n ON n.file_path=f.file_path""")
def _(t):
    return detect.scan_summary(t.code_lines, detect.scan_lines(t.code_lines))


#: what each kind of code line does to scopes, stated by hand: braces left open or closed, decisions, sanitizers; a kind that opens is a header
BRACES = {0: 1, 18: 1, 19: -1, 20: -1}
DECISIONS = {3: 2, 7: 1, 12: 1}
SANITIZERS = [3]


def by_kind(numbers):
    return "CASE tpl " + " ".join(f"WHEN {k} THEN {v}" for k, v in numbers.items()) + " ELSE 0 END"


CTE["scoped"] = (["code_lines"], f"""
WITH l AS (SELECT *, {by_kind(BRACES)} AS b, {by_kind(DECISIONS)} AS n, tpl IN ({", ".join(map(str, SANITIZERS))}) AS san FROM code_lines)
, d AS (SELECT *, sum(b) OVER (PARTITION BY file_path ORDER BY line_no) AS after, max(line_no) OVER (PARTITION BY file_path) AS eof FROM l)
, span AS (SELECT h.file_path, h.line_no AS s, coalesce(min(e.line_no), any_value(h.eof)) AS e
  FROM d h LEFT JOIN d e ON e.file_path=h.file_path AND e.line_no>h.line_no AND e.after<h.after WHERE h.b=1 GROUP BY 1, 2)
, total AS (SELECT span.file_path, s, e, sum(n) AS n, bool_or(san) AS san FROM span JOIN l ON l.file_path=span.file_path AND line_no BETWEEN s AND e GROUP BY 1, 2, 3)
, inner_most AS (SELECT l.file_path, line_no, max(s) AS s FROM l JOIN total t ON t.file_path=l.file_path AND line_no BETWEEN s AND e GROUP BY 1, 2)
SELECT l.*, i.s, coalesce(l.line_no-i.s, 0) AS depth, 1+coalesce(t.n, 0) AS cc, CASE WHEN t.san THEN 1 ELSE 0 END AS sanitizer
FROM l LEFT JOIN inner_most i ON i.file_path=l.file_path AND i.line_no=l.line_no LEFT JOIN total t ON t.file_path=l.file_path AND t.s=i.s""")


@query("det_10_enclosing_scope", "scoped", sql="SELECT file_path, line_no, coalesce(s,0) AS scope_start, CAST(depth AS INT) AS depth FROM scoped")
def _(t):
    return detect.scope_features(t.code_lines).select("file_path", "line_no", F.coalesce("scope_start", F.lit(0)).alias("scope_start"), F.col("line_depth_in_function").alias("depth"))


@query("det_11_complexity", "scoped", sql="SELECT file_path, line_no, CAST(cc AS INT) AS cyclomatic_complexity FROM scoped")
def _(t):
    return detect.scope_features(t.code_lines).select("file_path", "line_no", "cyclomatic_complexity")


@query("det_12_sanitizer_in_scope", "scoped", sql="SELECT file_path, line_no, sanitizer AS has_sanitizer_in_ast FROM scoped")
def _(t):
    return detect.scope_features(t.code_lines).select("file_path", "line_no", "has_sanitizer_in_ast")


@query("det_13_sink_on_line", "sinks", sql="SELECT file_path, line_no, sink_no, sink_kind, sink_name, arguments FROM sinks")
def _(t):
    found = dataflow.sinks(detect.statements(t.code_lines).withColumn("scope", F.lit(0)), ["file_path"])
    return found.select("file_path", "line_no", "sink_no", "sink_kind", "sink_name", F.array_join("arguments", " | ").alias("arguments"))


@query("det_16_argument_shape", "sinks", sql="SELECT shape, count(*) AS sinks FROM sinks GROUP BY 1")
def _(t):
    rows = t.code_lines.select(F.explode(detect.sinks_in(detect.code_only("text"))).alias("s"))
    return rows.groupBy(detect.arguments_shape("s.arguments").alias("shape")).agg(F.count(F.lit(1)).alias("sinks"))


TRACE_SQL = f"""
, defs AS (SELECT file_path, coalesce(s,0) AS scope, line_no*10 AS pos, var, uses, input, cleans FROM scoped JOIN {values(ASSIGNED, "kind, var, uses, input, cleans")} ON v.kind = tpl)
, ends AS (SELECT *, line_no*10 + sink_no AS pos FROM sinks)
, users AS (SELECT file_path, scope, pos, uses, input, cleans FROM defs UNION ALL SELECT file_path, scope, pos, uses, input, CASE WHEN clean THEN sink_kind ELSE '' END FROM ends)
, edges AS (SELECT u.file_path, u.scope, u.pos, u.var, max(d.pos) AS target FROM (SELECT file_path, scope, pos, unnest({listed('uses')}) AS var FROM users) u
   LEFT JOIN defs d ON d.file_path=u.file_path AND d.scope=u.scope AND d.var=u.var AND d.pos<u.pos GROUP BY 1,2,3,4)
, walk AS (SELECT file_path, scope, pos AS sink, pos FROM ends
   UNION SELECT w.file_path, w.scope, w.sink, e.target FROM walk w JOIN edges e ON e.file_path=w.file_path AND e.scope=w.scope AND e.pos=w.pos WHERE e.target IS NOT NULL)
, agg AS (SELECT k.file_path, k.scope, k.pos AS sink, list_sort(list_distinct(list_filter(list(u.input), lambda x: x <> ''))) AS c, bool_or(u.cleans = k.sink_kind) AS san, count(*) - 1 AS steps,
   bool_or(EXISTS (SELECT 1 FROM edges e WHERE e.file_path=u.file_path AND e.scope=u.scope AND e.pos=u.pos AND e.target IS NULL)) AS un
   FROM walk w JOIN users u ON u.file_path=w.file_path AND u.scope=w.scope AND u.pos=w.pos JOIN ends k ON k.file_path=w.file_path AND k.scope=w.scope AND k.pos=w.sink GROUP BY 1,2,3)
SELECT k.file_path, k.line_no, k.sink_no, k.sink_kind, CAST(len(c)>0 AS INT) AS reaches_request_input, CAST(steps AS INT) AS taint_steps, CAST(san AS INT) AS sanitised_before_sink,
  CASE WHEN len(c)>1 THEN 'mixed' WHEN len(c)=1 THEN c[1] WHEN un THEN 'unknown' ELSE 'none' END AS attacker_reachable_context FROM ends k JOIN agg a ON a.file_path=k.file_path AND a.scope=k.scope AND a.sink=k.pos"""
@query("det_14_request_reachability", "sinks", sql=TRACE_SQL)
def _(t):
    return dataflow.trace(t.code_lines).select(
        "file_path", "line_no", "sink_no", "sink_kind", "reaches_request_input", "taint_steps", "sanitised_before_sink", "attacker_reachable_context")


@query("det_15_attacker_context", "sinks", sql=TRACE_SQL.replace("SELECT k.file_path, k.line_no, k.sink_no, k.sink_kind, CAST", "SELECT attacker_reachable_context, sanitised_before_sink, count(*) AS sinks FROM (SELECT k.file_path, k.line_no, k.sink_no, k.sink_kind, CAST") + ") GROUP BY 1,2")
def _(t):
    return dataflow.trace(t.code_lines).groupBy("attacker_reachable_context", "sanitised_before_sink").agg(F.count(F.lit(1)).alias("sinks"))


@query("det_17_feature_vectors", "scoped", "hits", sql=f"""
, h AS (SELECT h.*, v.cwe_id FROM hits h LEFT JOIN {values([(r[0], r[1]) for r in fv.DETECTION_RULES if r[1] is not None], 'rule, cwe_id')} ON v.rule = h.rule_id)
SELECT h.file_path, h.line_no AS line_number, h.rule_id, h.cwe_id, 'php' AS file_extension, CAST(starts_with(h.file_path,'src/tests/') AS INT) AS is_test_file, CAST(cc AS INT) AS cyclomatic_complexity, sanitizer AS has_sanitizer_in_ast, CAST(depth AS INT) AS line_depth, CAST(0 AS DOUBLE) AS rate, 'unknown' AS author, -2 AS taint_steps
FROM h JOIN scoped s ON s.file_path=h.file_path AND s.line_no=h.line_no""")
def _(t):
    found = detect.scan_lines(t.code_lines)
    vectors = features.build_vectors(found, t.rules.withColumn("historical_fp_rate", F.lit(0.5)), detect.scope_features(t.code_lines))
    v = "feature_vector."
    return vectors.select("file_path", "line_number", "rule_id", "cwe_id", v + "file_extension", v + "is_test_file", v + "cyclomatic_complexity",
                          v + "has_sanitizer_in_ast", F.col(v + "line_depth_in_function").alias("line_depth"), F.col(v + "historical_fp_rate_rule").alias("rate"),
                          F.col(v + "developer_experience_lvl").alias("author"), v + "taint_steps")


@query("ud_01_custom_rule", "code", sql="SELECT file_path, line_no AS line_number, 'team.no-config' AS rule_id, 'config() is read here' AS message FROM code WHERE tpl = 5")
def _(t):
    rule = detect.Rule("team.no-config", None, "LOW", "reads configuration", lambda c: F.when(c.rlike(r"\bconfig\("), "config() is read here"))
    detect.register_rule(rule)
    try:
        return detect.scan_lines(t.code_lines, [rule.id]).select("file_path", "line_number", "rule_id", "message")
    finally:
        detect.RULES.pop(rule.id)


# ---- texts ------------------------------------------------------------------
def redact_sql(e):
    for pattern, marker in texts.SECRET_PATTERNS:
        e = f"regexp_replace({e}, {q(pattern)}, {q(marker.replace('$1', chr(92) + '1'))}, 'g')"
    return e


@query("sc_24_redact_secrets", sql=f"SELECT doc_id, sha256({redact_sql('text')}) AS redacted_sha, contains({redact_sql('text')}, '[REDACTED:API_KEY_OR_TOKEN]') AS redacted FROM documents")
def _(t):
    r = texts.redact("text")
    return t.raw_documents.select("doc_id", F.sha2(r, 256).alias("redacted_sha"), r.contains("[REDACTED:API_KEY_OR_TOKEN]").alias("redacted"))


@query("sc_25_redact_nested", "contexts", sql=f"SELECT finding_id, {redact_sql('context')} AS context FROM contexts")
def _(t):
    nested = F.struct(F.col("context").alias("code"), F.array("context").alias("parts"))
    out = texts.redact_struct(nested, {"code": "text", "parts": "list"})
    return t.contexts.select("finding_id", F.when(out["code"] == out["parts"][0], out["code"]).alias("context"))


@query("sc_26_bounded_text", sql="SELECT doc_id, sha256(CASE WHEN length(text)<=4000 THEN text ELSE rtrim(substr(text,1,4000)) || '...' END) AS excerpt_sha FROM documents")
def _(t):
    return t.raw_documents.select("doc_id", F.sha2(texts.limited("text", 4000), 256).alias("excerpt_sha"))


@query("sc_28_csv_guard", sql="SELECT event_id, CASE WHEN regexp_matches(v, '^\\s*[=+\\-@]') THEN '''' || v ELSE v END AS cell FROM (SELECT event_id, CASE event_id%5 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '@' ELSE '' END || event_type AS v FROM events)")
def _(t):
    v = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", " +", "@", "", "")]), (F.col("event_id") % 5 + 1).cast("int")), "event_type")
    return t.raw_events.select("event_id", texts.csv_safe(v).alias("cell"))


@query("sc_32_suggested_fix", "findings", sql="""
, s AS (SELECT id, cwe_id, regexp_extract(raw_snippet, '( // at [0-9]+)[ ]*$', 1) AS mark FROM findings WHERE trim(raw_snippet, ' ' || chr(9)) <> '')
SELECT id, CASE cwe_id
 WHEN 22 THEN '$root = realpath((string) getenv(''FILE_ROOT''));' || chr(10) || '$checked = realpath($root . ''/'' . $path);' || chr(10)
  || 'if ($root === false || $checked === false || strpos($checked, $root . ''/'') !== 0) {' || chr(10)
  || '    throw new RuntimeException(''The path leaves the file root.'');' || chr(10) || '}' || chr(10) || 'return file_get_contents($checked);' || pad || mark
 WHEN 89 THEN '$statement = $pdo->prepare("SELECT * FROM t WHERE id = ? AND k = ?");' || chr(10) || '$statement->execute([$id, $row->key]);' || chr(10) || '$rows = $statement->fetchAll();'
 WHEN 78 THEN '$process = proc_open([''convert'', $name], [1 => [''pipe'', ''w'']], $pipes);' || chr(10) || '$output = stream_get_contents($pipes[1]);' || chr(10) || 'proc_close($process);'
 WHEN 502 THEN '$data = json_decode($payload, true, 64, JSON_THROW_ON_ERROR);' || pad || mark
 WHEN 327 THEN '$key = (string) getenv(''HASH_KEY'');' || chr(10) || '$hash = hash_hmac(''sha256'', $password, $key);' || pad || mark
 WHEN 79 THEN 'echo htmlspecialchars($title, ENT_QUOTES | ENT_SUBSTITUTE, ''UTF-8'');' || pad || mark END AS after
FROM (SELECT s.*, CASE WHEN a_line=2 THEN '  ' ELSE '' END AS pad FROM s JOIN findings USING (id, cwe_id)) WHERE cwe_id IS NOT NULL""")
def _(t):
    return fixes.with_suggested_fix(t.findings).filter("suggested_fix IS NOT NULL").select("id", "suggested_fix.after")


@query("sc_27_context_payload", "code_lines", sql=f"""
, w AS (SELECT f.doc_id*100000+f.line_no AS id, f.file_path, f.line_no, min(l.line_no) AS a, max(l.line_no) AS b, string_agg(printf('%6d | ', l.line_no) || rtrim(l.text), chr(10) ORDER BY l.line_no) AS code
  FROM code_lines f JOIN code_lines l ON l.file_path=f.file_path AND l.line_no BETWEEN f.line_no-20 AND f.line_no+20 GROUP BY 1,2,3)
SELECT id, sha256({redact_sql('code')}) AS code_sha, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line FROM w""")
def _(t):
    from winnow.plans import context

    f = t.code_lines.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), "file_path", F.col("line_no").alias("line_number"))
    w = context.source_windows(f, t.code_lines)
    return w.select("id", F.sha2("code", 256).alias("code_sha"), "start_line", "end_line")


@query("src_12_source_lines", sql="SELECT doc_id, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY 1")
def _(t):
    return files.explode_lines(t.raw_documents.select("doc_id", "text")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("src_12_source_status", "code_lines", sql="""
, f AS (SELECT file_path, sum(length(text)) AS n FROM code_lines GROUP BY 1)
SELECT file_path, CASE WHEN file_path LIKE 'Vendor/%' OR file_path LIKE '%/public/%' THEN 'excluded' WHEN n>5000 THEN 'skipped' ELSE 'scanned' END AS status FROM f""")
def _(t):
    from winnow.settings import Settings

    sized = t.code_lines.groupBy("file_path").agg(F.sum(F.length("text")).alias("size_bytes"))
    return sized.select("file_path", files.source_file_status("file_path", "size_bytes", Settings(max_file_bytes=5000)).alias("status"))

