"""The adapter tables as DuckDB common table expressions, for the oracle queries."""

FAM = ["php.security.command-injection", "php.security.path-traversal", "php.laravel.security.sql-injection",
       "php.laravel.security.xss-unescaped-output", "php.security.unserialize-user-input", "php.security.weak-hashing"]


def pick(index, values):
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {index} {whens} END)"


def path(s):
    return (f"(CASE {s} % 4 WHEN 0 THEN 'app\\Services\\S' || {s} || '.php' WHEN 1 THEN 'src/tests/S' || {s} || 'Test.php' "
            f"WHEN 2 THEN 'resources/views/s' || {s} || '.blade.php' ELSE 'bin/run' || {s} END)")


SNIP = ['exec("convert " . $name);', "return file_get_contents($path);",
        'DB::select("SELECT * FROM t WHERE id = $id AND k = $row->key");', "echo $title;",
        "$data = unserialize($payload);", "$hash = md5($password);"]
CLASSES = ["confirmed_tp", "likely_tp", "needs_validation", "likely_fp", "confirmed_fp"]
SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE", "NONE"]
CODE = ["function f%d($a) {", '    $v1 = $_GET["k%d"];', "    $v2 = trim($v1) . %d;",
        "    if ($v2 && $v1) { $v3 = htmlspecialchars($v2); } // %d", '    echo "<b>" . $v2; // %d',
        '    $v4 = config("app.name"); // %d', '    exec("run " . $v4 . $v2); // %d',
        "    foreach ($v2 as $i) { $h = md5($password); } // %d", "    User::create($request->all()); // %d",
        '    $api_key = "k%d-winnow-sample-0000";', "    $c = file_get_contents(basename($v3)); // %d",
        '    $d = unserialize($_POST["p"]); DB::select("SELECT 1 FROM t WHERE x = $v1"); // %d',
        "    $n = 40 + %d; return $n ? 1 : 2;",
    '    system($a); system($v1); exec("id"); exec($v2); // %d',
    '    mysqli_query($link, "SELECT " . $v2); copy($v1, "/tmp/c%d");',
    '    $x = request("q%d"); echo $x;',
    "    $o = `ls $v1`; // %d",
    "    $v2 = trim($v2); // %d",
    "    $g%d = function ($v1) use ($v2) {",
    "    }; // %d",
    "} // %d",
]

CTE: dict[str, tuple[list[str], str]] = {}

CTE["f0"] = ([], f"""
SELECT l_orderkey AS scan_id, CAST(l_quantity AS INT) AS a_q, CAST(round(l_discount*100) AS INT) AS a_disc,
  CAST(round(l_tax*100) AS INT) AS a_tax, l_linenumber AS a_line, l_suppkey AS a_supp, l_linestatus='O' AS a_open,
  CAST(l_partkey % 6 AS INT) AS a_fam, CAST(l_partkey % 25 AS INT) AS a_brand, l_returnflag, l_shipdate AS updated_at,
  CAST('0x' || substr(sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT),
    CAST(round(l_extendedprice*100) AS BIGINT), CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT),
    strftime(l_shipdate, '%Y%m%d'))), 1, 14) AS BIGINT) AS id
FROM lineitem""")
CTE["f1"] = (["f0"], f"""
SELECT *, CASE WHEN a_q>=45 THEN 'CRITICAL' WHEN a_q>=30 THEN 'HIGH' WHEN a_q>=15 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN a_q<>7 THEN CAST(a_disc AS DOUBLE)/CAST(10 AS DOUBLE) END AS tp_probability,
  CASE l_returnflag WHEN 'R' THEN 'true_positive' WHEN 'A' THEN 'false_positive' END AS final_label,
  {pick('a_fam', FAM)} || '.b' || a_brand AS rule_id,
  CAST(CASE WHEN a_fam=5 AND a_brand<5 THEN NULL ELSE CASE a_fam WHEN 0 THEN 78 WHEN 1 THEN 22 WHEN 2 THEN 89 WHEN 3 THEN 79 WHEN 4 THEN 502 ELSE 327 END END AS INT) AS cwe_id,
  {path('a_supp')} AS file_path, CAST(a_line*3 AS INT) AS line_number,
  CASE WHEN a_line=5 THEN 'Hard-coded $api_key = "abcdefghij' || a_supp || 'klmnop";' ELSE 'Dynamic value reaches ' || {pick('a_fam', FAM)} END AS message,
  CASE WHEN a_line=6 THEN '   ' WHEN a_line<>7 THEN (CASE WHEN a_line=2 THEN '  ' || chr(9) ELSE '' END) || {pick('a_fam', SNIP)} || (CASE WHEN a_line=2 THEN '  ' ELSE '' END) || ' // at ' || (a_line*3) END AS raw_snippet
FROM f0""")
CTE["findings"] = (["f1"], """
SELECT *, CASE WHEN tp_probability>=0.8 THEN 'true_positive' WHEN tp_probability<=0.15 THEN 'false_positive' END AS predicted_label,
  CASE WHEN final_label IS NOT NULL THEN 'triaged' WHEN tp_probability<=0.15 THEN 'suppressed'
       WHEN tp_probability>=0.8 AND a_open THEN 'reported' ELSE 'pending' END AS status,
  a_q<>50 AS has_vector
FROM f1""")
CTE["scans"] = ([], f"""
SELECT o_orderkey AS id, o_custkey AS project_id, {pick('o_orderkey % 5', ['semgrep','sonarqube','bandit','phpcs','sarif'])} AS source,
  CASE WHEN o_totalprice<2000 THEN '  ' WHEN o_orderkey%2=0 THEN upper(sha1(o_custkey || '-' || strftime(o_orderdate,'%Y%m')))
       ELSE sha1(o_custkey || '-' || strftime(o_orderdate,'%Y%m')) END AS commit_sha,
  o_orderpriority AS branch, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'scoring' ELSE 'uploaded' END AS status,
  o_orderdate AS created_at, o_totalprice AS a_price
FROM orders""")
CTE["projects"] = ([], """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment<>'BUILDING' THEN '/srv/' || lower(c_name) || '/' END AS source_path FROM customer""")
CTE["rules"] = ([], f"""
SELECT {pick('p_partkey % 6', FAM)} || '.b' || (p_partkey % 25) AS external_id,
  CAST(CASE p_partkey % 6 WHEN 0 THEN 78 WHEN 1 THEN 22 WHEN 2 THEN 89 WHEN 3 THEN 79 WHEN 4 THEN 502 ELSE 327 END AS INT) AS cwe_id,
  CAST(p_partkey % 25 AS INT) AS a_brand, min(p_name) AS description FROM part GROUP BY 1,2,3""")
CTE["feedback"] = (["findings"], """
SELECT id, id AS finding_id, a_supp % 7 AS user_id,
  CASE WHEN a_tax=4 AND a_line=2 THEN (CASE WHEN final_label='true_positive' THEN 'false_positive' ELSE 'true_positive' END) ELSE final_label END AS corrected_label,
  CASE WHEN a_line<=4 THEN 'human' WHEN a_line=5 THEN 'benchmark' WHEN a_line=6 THEN 'import' ELSE 'ai_pseudo' END AS source,
  a_tax<8 AS training_eligible,
  CASE WHEN a_line=7 THEN 'AI training label from adjudicator' WHEN a_line=3 THEN 'AI_PROMOTED x' ELSE 'checked' END AS notes, updated_at
FROM findings WHERE final_label IS NOT NULL AND a_tax>0""")
CTE["contexts"] = (["findings"], """
SELECT id AS finding_id, sha256('ctx:' || id) AS context_hash, CASE WHEN a_disc=0 THEN 'compact-v1' ELSE 'compact-v2' END AS format_version,
  '{"code":"$token = \\"abcdefgh' || a_supp || '\\";"}' AS context
FROM findings WHERE a_tax<8""")
CTE["a0"] = (["findings"], """
SELECT f.*, o.reviewer, o.k FROM findings f, (VALUES ('offensive',1),('defensive',2),('offensive',3),('adjudicator',4)) o(reviewer,k)
WHERE a_q>=30 AND (o.k<=2 OR (o.k=3 AND NOT a_open) OR (o.k=4 AND a_disc>=5))""")
CTE["assessments"] = (["a0"], f"""
SELECT id*8+k AS id, id AS finding_id, reviewer, CASE WHEN k=4 THEN 'deterministic-rules-v1' WHEN a_q=40 THEN 'old-model' ELSE 'review-model' END AS model,
  CASE WHEN k=4 THEN 'rules-v1' WHEN a_q=41 THEN 'p0' ELSE 'p1' END AS prompt_version,
  {pick('(a_q+k*3+a_disc) % 5', CLASSES)} AS classification,
  CASE WHEN a_q<>31 THEN CAST((a_q*7+k*13+a_disc) % 101 AS DOUBLE)/CAST(100 AS DOUBLE) END AS confidence,
  CASE (a_q+k*3+a_disc)%3 WHEN 0 THEN true WHEN 1 THEN false END AS attacker_controlled,
  CASE (a_q+k*3+a_disc+1)%3 WHEN 0 THEN true WHEN 1 THEN false END AS sink_reachable,
  CASE (a_q+k*3+a_disc+2)%3 WHEN 0 THEN true WHEN 1 THEN false END AS mitigation_detected,
  CASE (a_q+k*3+a_disc)%4 WHEN 1 THEN ['source'] WHEN 2 THEN ['source','sink'] WHEN 3 THEN ['sanitizer'] END AS missing_evidence,
  sha256((CASE WHEN a_tax<6 THEN 'ctx:' ELSE 'old:' END) || id) AS context_hash,
  CASE WHEN a_q=35 THEN NULL WHEN a_q=36 THEN 0 ELSE CAST(a_q+k AS BIGINT)*1000000000 END AS total_duration,
  CASE WHEN a_q<>33 THEN updated_at + to_minutes(k*10+a_q) END AS completed_at, a_q, a_disc, a_supp, a_line, k AS a_k
FROM a0""")
CTE["assessment_feedback"] = (["assessments"], f"""
SELECT id*2+v-1 AS id, id AS assessment_id, reviewer, a_supp%7 AS user_id,
  {pick('(a_q+v)%4', ['correct','incorrect','partially_correct','insufficient_context'])} AS verdict,
  CASE WHEN (a_q+v)%4 IN (1,2) AND a_line<>5 THEN {pick('(a_q+v)%5', CLASSES)} END AS corrected_classification,
  CASE WHEN a_line=1 THEN ['missed_sink','other'] WHEN a_line=3 THEN ['other','other'] WHEN a_line=4 THEN ['bogus'] END AS reason_codes,
  'looked at $secret = "abcdefghijk"' AS notes, completed_at + to_hours(v) AS reviewed_at
FROM assessments, (VALUES (1),(2)) t(v) WHERE a_disc<=4 AND a_k<=3 AND (v=1 OR a_line<=2)""")
CTE["decisions"] = ([], """
SELECT event_id, ts AS decided_at, user_id AS finding_id,
  CASE WHEN event_type IN ('purchase','error') THEN 'label' WHEN event_type='click' THEN 'undo' ELSE 'heartbeat' END AS action,
  CASE event_type WHEN 'purchase' THEN 'true_positive' WHEN 'error' THEN 'false_positive' END AS label,
  'rule.' || (user_id % 25) AS rule_id FROM events""")
CTE["blame"] = ([], f"""
SELECT {path('s_suppkey')} AS file_path, l.line_no, 'dev-' || s_nationkey || '-' || {pick('s_suppkey % 6', SEGMENTS)} AS author
FROM supplier, (VALUES (3),(6),(9),(12),(15),(18)) l(line_no)""")
CTE["commits"] = ([], """
SELECT o_orderkey AS commit_id, 'dev-' || c_nationkey || '-' || c_mktsegment AS author FROM orders JOIN customer ON o_custkey=c_custkey""")
CTE["code_lines"] = ([], f"""
SELECT {pick('doc_id % 4', ['app/', 'src/tests/', 'Vendor/', 'lib/public/'])} || source || '/D' || doc_id || '.php' AS file_path,
  doc_id, CAST(line_no AS INT) AS line_no, (line_no*5+doc_id) % {len(CODE)} AS tpl, length(t) % 9 AS digit,
  replace({pick(f'(line_no*5+doc_id) % {len(CODE)}', CODE)}, '%d', CAST(length(t) % 9 AS VARCHAR)) || ' // ' || t AS text
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)""")

# ---- derived expressions shared by several oracles ---------------------------
VEC = {
    "cwe_id": "coalesce(cwe_id,0)",
    "scanner_severity": "severity",
    "file_extension": "CASE WHEN a_line=1 THEN 'php' ELSE coalesce(nullif(lower(regexp_extract(file_path, '([a-z]*)$', 1)),''),'php') END",
    "is_test_file": "CAST(a_supp%4=1 AS INT)",
    "cyclomatic_complexity": "a_q%7+1",
    "has_sanitizer_in_ast": "CAST(a_supp%2 AS INT)",
    "line_depth_in_function": "CAST(a_line*2 AS INT)",
    "historical_fp_rate_rule": "CAST(a_brand*400 AS BIGINT)",
    "developer_experience_lvl": "CASE a_supp%4 WHEN 0 THEN 'senior' WHEN 1 THEN 'mid' WHEN 2 THEN 'junior' ELSE 'unknown' END",
    "reaches_request_input": "CASE WHEN a_open THEN -1 ELSE CAST(a_supp%2 AS INT) END",
    "taint_steps": "CASE WHEN a_open THEN -2 ELSE CAST(a_line-1 AS INT) END",
    "sanitised_before_sink": "CASE WHEN a_open THEN -1 ELSE a_q%2 END",
    "attacker_reachable_context": "CASE WHEN a_open THEN 'unknown' ELSE CASE a_line%3 WHEN 0 THEN 'query' WHEN 1 THEN 'body' ELSE 'mixed' END END",
}
SAMPLE = "CAST(to_json({" + ", ".join(f"'{k}': {v}" for k, v in VEC.items()) + "}) AS VARCHAR)"


def fingerprint(alias=""):
    a = alias + "." if alias else ""
    sq = f"regexp_replace(regexp_replace(coalesce({a}raw_snippet,''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '\\s+', ' ', 'g')"
    return (f"sha256(concat({a}rule_id, chr(0), coalesce(CAST({a}cwe_id AS VARCHAR),''), chr(0), replace({a}file_path,'\\','/'), chr(0), "
            f"{a}line_number, chr(0), CASE WHEN {sq}<>'' THEN {sq} ELSE {a}message END))")


def group_key(project="project_id", commit="commit_sha", scan="scan_id"):
    bare = f"trim(coalesce({commit}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(13))"
    return (f"CASE WHEN {bare}='' THEN concat({project}, chr(0), chr(0), 'scan:', {scan}) "
            f"ELSE concat({project}, chr(0), lower({bare})) END")


def bucket(key):
    return f"(CAST('0x' || substr(sha256({key}),1,8) AS BIGINT) % 100)"


CTE["fs"] = (["findings", "scans"], f"""
SELECT f.*, s.project_id, s.source AS scanner_source, s.commit_sha, {group_key('s.project_id','s.commit_sha','f.scan_id')} AS group_key,
  {fingerprint('f')} AS fingerprint, {SAMPLE} AS sample
FROM findings f JOIN scans s ON f.scan_id=s.id""")
CTE["trusted"] = (["fs", "feedback"], """
SELECT f.*, b.source AS label_source, f.final_label AS label FROM fs f JOIN feedback b ON b.finding_id=f.id
WHERE f.has_vector AND b.source IN ('human','benchmark','import') AND b.training_eligible AND b.corrected_label=f.final_label""")
CTE["pseudo"] = (["fs", "feedback"], """
SELECT f.*, b.source AS label_source, f.final_label AS label, b.corrected_label FROM fs f JOIN feedback b ON b.finding_id=f.id
WHERE f.has_vector AND f.final_label IS NOT NULL AND b.source='ai_pseudo' AND b.training_eligible""")
CTE["dedup"] = (["trusted"], """
SELECT * FROM (SELECT *, count(*) OVER w AS duplicate_count, min(label) OVER w AS lo, max(label) OVER w AS hi,
  row_number() OVER (PARTITION BY fingerprint ORDER BY group_key, sample, id) AS rn FROM trusted WINDOW w AS (PARTITION BY fingerprint))
WHERE lo=hi AND rn=1""")
CTE["snapshot"] = (["dedup"], f"""
SELECT *, sha256(sample) AS feature_sha256, CASE WHEN {bucket('group_key')}<20 THEN 'validation' ELSE 'train' END AS split,
  min(label) OVER (PARTITION BY sample) <> max(label) OVER (PARTITION BY sample) AS ambiguous_feature FROM dedup""")
CTE["latest"] = (["assessments"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, reviewer ORDER BY completed_at DESC NULLS LAST, id DESC) AS rn FROM assessments) WHERE rn=1""")


def with_tables(*names, body):
    """Prefix ``body`` with the tables it needs, in dependency order."""
    order: list[str] = []

    def add(name):
        for dep in CTE[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n][1].strip()})" for n in order) + "\n" + body.strip()
