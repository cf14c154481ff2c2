"""Adapter: the driver's tables seen as triage tables.

Only projections, and a join where a domain table really spans two inputs; all
columns are functions of the row, so an unused column costs nothing.  Written as
SQL text because one parsed expression is far cheaper to build than a thousand
Column calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = [
    "php.security.command-injection",
    "php.security.path-traversal",
    "php.laravel.security.sql-injection",
    "php.laravel.security.xss-unescaped-output",
    "php.security.unserialize-user-input",
    "php.security.weak-hashing",
]
FAMILY_CWES = [78, 22, 89, 79, 502, 327]
SNIPPETS = [
    'exec("convert " . $name);',
    "return file_get_contents($path);",
    'DB::select("SELECT * FROM t WHERE id = $id AND k = $row->key");',
    "echo $title;",
    "$data = unserialize($payload);",
    "$hash = md5($password);",
]
CLASSES = ["confirmed_tp", "likely_tp", "needs_validation", "likely_fp", "confirmed_fp"]
VERDICTS = ["correct", "incorrect", "partially_correct", "insufficient_context"]
AUTHOR_SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE", "NONE"]
CODE_LINES = [
    "function f%d($a) {",
    '    $v1 = $_GET["k%d"];',
    "    $v2 = trim($v1) . %d;",
    "    if ($v2 && $v1) { $v3 = htmlspecialchars($v2); } // %d",
    '    echo "<b>" . $v2; // %d',
    '    $v4 = config("app.name"); // %d',
    '    exec("run " . $v4 . $v2); // %d',
    "    foreach ($v2 as $i) { $h = md5($password); } // %d",
    "    User::create($request->all()); // %d",
    '    $api_key = "k%d-winnow-sample-0000";',
    "    $c = file_get_contents(basename($v3)); // %d",
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


LARGE = ["lineitem", "orders", "documents", "conversations", "pages"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table, read as it is stored.

    The test tables have one row group, hence one task.  A local session asks to
    deal the large ones out (``spark.winnow.testdata.spread`` tasks); a cluster,
    whose tables have many row groups, leaves that unset.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("spark.winnow.testdata.spread", None)
    return df.repartition(int(spread)) if spread and name in LARGE else df


def _text(value) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pick(index: str, values) -> str:
    return f"element_at(array({', '.join(_text(v) for v in values)}), cast({index} as int) + 1)"


def _path(supp: str) -> str:
    return (
        f"CASE {supp} % 4 WHEN 0 THEN concat('app\\\\Services\\\\S', {supp}, '.php') "
        f"WHEN 1 THEN concat('src/tests/S', {supp}, 'Test.php') "
        f"WHEN 2 THEN concat('resources/views/s', {supp}, '.blade.php') ELSE concat('bin/run', {supp}) END"
    )


def _columns(df: DataFrame, spec: dict[str, str], keep=()) -> DataFrame:
    return df.selectExpr(*keep, *[f"{expr} AS {name}" for name, expr in spec.items()])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (
        "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, int(l_quantity), bigint(round(l_extendedprice*100)), "
        "bigint(round(l_discount*100)), bigint(round(l_tax*100)), date_format(l_shipdate, 'yyyyMMdd'))"
    )
    base = _columns(table(spark, sf_dir, "lineitem"), {
        "id": f"cast(conv(substr(sha2({key}, 256), 1, 14), 16, 10) as bigint)",
        "scan_id": "l_orderkey",
        "a_q": "int(l_quantity)", "a_disc": "int(round(l_discount*100))", "a_tax": "int(round(l_tax*100))",
        "a_line": "int(l_linenumber)", "a_supp": "l_suppkey", "a_open": "l_linestatus = 'O'",
        "a_brand": "int(l_partkey % 25)", "a_fam": "int(l_partkey % 6)",
        "final_label": "CASE l_returnflag WHEN 'R' THEN 'true_positive' WHEN 'A' THEN 'false_positive' END",
        "updated_at": "cast(l_shipdate as timestamp_ntz)",
    })
    mid = _columns(base, {
        "rule_id": f"concat({_pick('a_fam', FAMILIES)}, '.b', a_brand)",
        "cwe_id": f"CASE WHEN a_fam = 5 AND a_brand < 5 THEN NULL ELSE {_pick('a_fam', FAMILY_CWES)} END",
        "file_path": _path("a_supp"),
        "line_number": "a_line * 3",
        "severity": "CASE WHEN a_q >= 45 THEN 'CRITICAL' WHEN a_q >= 30 THEN 'HIGH' WHEN a_q >= 15 THEN 'MEDIUM' ELSE 'LOW' END",
        "tp_probability": "CASE WHEN a_q <> 7 THEN double(a_disc) / 10D END",
        "message": "CASE WHEN a_line = 5 THEN concat('Hard-coded $api_key = \"abcdefghij', a_supp, 'klmnop\";') "
                   f"ELSE concat('Dynamic value reaches ', {_pick('a_fam', FAMILIES)}) END",
        "raw_snippet": "CASE WHEN a_line = 6 THEN '   ' WHEN a_line <> 7 THEN concat(if(a_line = 2, '  \\t', ''), "
                       f"{_pick('a_fam', SNIPPETS)}, if(a_line = 2, '  ', ''), ' // at ', a_line * 3) END",
    }, ["*"])
    vector = f"""CASE WHEN a_q <> 50 THEN named_struct(
      'cwe_id', cwe_id,
      'scanner_severity', if(a_line = 4, concat(' ', lower(severity), ' '), severity),
      'file_extension', CASE WHEN a_line <> 1 THEN regexp_extract(file_path, '([a-z]*)$', 1) END,
      'is_test_file', int(a_supp % 4 = 1),
      'cyclomatic_complexity', a_q % 7 + 1,
      'has_sanitizer_in_ast', int(a_supp % 2),
      'line_depth_in_function', a_line * 2,
      'historical_fp_rate_rule', double(a_brand * 4) / 100D,
      'developer_experience_lvl', {_pick('a_supp % 4', ['senior', 'Mid', 'junior', ''])},
      'reaches_request_input', CASE WHEN NOT a_open THEN int(a_supp % 2) END,
      'taint_steps', CASE WHEN NOT a_open THEN a_line - 1 END,
      'sanitised_before_sink', CASE WHEN NOT a_open THEN a_q % 2 END,
      'attacker_reachable_context', CASE WHEN NOT a_open THEN {_pick('a_line % 3', ['query', 'body', 'mixed'])} END) END"""
    predicted = "CASE WHEN tp_probability >= 0.8D THEN 'true_positive' WHEN tp_probability <= 0.15D THEN 'false_positive' END"
    names = ["id", "scan_id", "rule_id", "cwe_id", "file_path", "line_number", "severity", "message", "raw_snippet",
             "tp_probability", "final_label", "updated_at"]
    attributes = ["a_q", "a_disc", "a_tax", "a_line", "a_supp", "a_open", "a_brand"]
    return _columns(mid, {
        "feature_vector": vector,
        "predicted_label": predicted,
        "status": "CASE WHEN final_label IS NOT NULL THEN 'triaged' WHEN tp_probability <= 0.15D THEN 'suppressed' "
                  "WHEN tp_probability >= 0.8D AND a_open THEN 'reported' ELSE 'pending' END",
    }, [*names, *attributes])


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    commit = "sha1(concat_ws('-', o_custkey, date_format(o_orderdate, 'yyyyMM')))"
    sources = ["semgrep", "sonarqube", "bandit", "phpcs", "sarif"]
    return _columns(table(spark, sf_dir, "orders"), {
        "id": "o_orderkey",
        "project_id": "o_custkey",
        "source": _pick("o_orderkey % 5", sources),
        "commit_sha": f"CASE WHEN o_totalprice < 2000 THEN '  ' WHEN o_orderkey % 2 = 0 THEN upper({commit}) ELSE {commit} END",
        "branch": "o_orderpriority",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'scoring' ELSE 'uploaded' END",
        "created_at": "cast(o_orderdate as timestamp_ntz)",
        "a_price": "o_totalprice",
    })


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "customer"), {
        "id": "c_custkey", "name": "c_name",
        "source_path": "CASE WHEN c_mktsegment <> 'BUILDING' THEN concat('/srv/', lower(c_name), '/') END",
    })


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rule the parts table mentions."""
    rows = _columns(table(spark, sf_dir, "part"), {
        "external_id": f"concat({_pick('p_partkey % 6', FAMILIES)}, '.b', p_partkey % 25)",
        "cwe_id": _pick("p_partkey % 6", FAMILY_CWES),
        "a_brand": "int(p_partkey % 25)",
    }, ["p_name"])
    return rows.groupBy("external_id", "cwe_id", "a_brand").agg(F.min("p_name").alias("description"))


def feedback(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """Current triage decision per labelled finding; untaxed rows have none."""
    f = findings(spark, sf_dir) if f is None else f
    return _columns(f.filter("final_label IS NOT NULL AND a_tax > 0"), {
        "finding_id": "id",
        "user_id": "a_supp % 7",
        "corrected_label": "CASE WHEN a_tax = 4 AND a_line = 2 THEN if(final_label = 'true_positive', 'false_positive', 'true_positive') "
                           "ELSE final_label END",
        "source": "CASE WHEN a_line <= 4 THEN 'human' WHEN a_line = 5 THEN 'benchmark' WHEN a_line = 6 THEN 'import' ELSE 'ai_pseudo' END",
        "training_eligible": "a_tax < 8",
        "notes": "CASE WHEN a_line = 7 THEN 'AI training label from adjudicator' WHEN a_line = 3 THEN 'AI_PROMOTED x' ELSE 'checked' END",
    }, ["id", "updated_at"])


def contexts(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    f = findings(spark, sf_dir) if f is None else f
    return _columns(f.filter("a_tax < 8"), {
        "finding_id": "id",
        "context_hash": "sha2(concat_ws(':', 'ctx', id), 256)",
        "format_version": "if(a_disc = 0, 'compact-v1', 'compact-v2')",
        "context": "concat('{\"code\":\"$token = \\\\\"abcdefgh', a_supp, '\\\\\";\"}')",
    })


def assessments(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """Reviews of the severe findings; some reviewed twice, some adjudicated."""
    f = findings(spark, sf_dir) if f is None else f
    rows = f.filter("a_q >= 30").selectExpr(
        "*",
        "explode(array_compact(array(named_struct('reviewer', 'offensive', 'k', 1), named_struct('reviewer', 'defensive', 'k', 2), "
        "if(a_open, NULL, named_struct('reviewer', 'offensive', 'k', 3)), "
        "if(a_disc >= 5, named_struct('reviewer', 'adjudicator', 'k', 4), NULL)))) AS offer",
    ).selectExpr("*", "offer.k AS a_k", "a_q + offer.k * 3 + a_disc AS a_mix")

    def tri(shift: int) -> str:
        return f"CASE (a_mix + {shift}) % 3 WHEN 0 THEN true WHEN 1 THEN false END"

    return _columns(rows, {
        "id": "id * 8 + a_k",
        "finding_id": "id",
        "reviewer": "offer.reviewer",
        "model": "CASE WHEN a_k = 4 THEN 'deterministic-rules-v1' WHEN a_q = 40 THEN 'old-model' ELSE 'review-model' END",
        "prompt_version": "CASE WHEN a_k = 4 THEN 'rules-v1' WHEN a_q = 41 THEN 'p0' ELSE 'p1' END",
        "classification": _pick("a_mix % 5", CLASSES),
        "confidence": "CASE WHEN a_q <> 31 THEN double((a_q * 7 + a_k * 13 + a_disc) % 101) / 100D END",
        "attacker_controlled": tri(0), "sink_reachable": tri(1), "mitigation_detected": tri(2),
        "missing_evidence": "CASE a_mix % 4 WHEN 1 THEN array('source') WHEN 2 THEN array('source', 'sink') WHEN 3 THEN array('sanitizer') END",
        "context_hash": "sha2(concat_ws(':', if(a_tax < 6, 'ctx', 'old'), id), 256)",
        "total_duration": "CASE WHEN a_q = 35 THEN NULL WHEN a_q = 36 THEN 0L ELSE bigint(a_q + a_k) * 1000000000L END",
        "completed_at": "CASE WHEN a_q <> 33 THEN updated_at + make_dt_interval(0, 0, a_k * 10 + a_q) END",
    }, ["a_q", "a_disc", "a_supp", "a_line", "a_k"])


def assessment_feedback(spark: SparkSession, sf_dir: str, a: DataFrame | None = None) -> DataFrame:
    """Explicit verdicts of people on reviews; some given twice."""
    a = assessments(spark, sf_dir) if a is None else a
    rows = a.filter("a_disc <= 4 AND a_k <= 3").selectExpr("*", "explode(if(a_line <= 2, array(1, 2), array(1))) AS v")
    return _columns(rows, {
        "id": "id * 2 + v - 1",
        "assessment_id": "id",
        "user_id": "a_supp % 7",
        "verdict": _pick("(a_q + v) % 4", VERDICTS),
        "corrected_classification": f"CASE WHEN (a_q + v) % 4 IN (1, 2) AND a_line <> 5 THEN {_pick('(a_q + v) % 5', CLASSES)} END",
        "reason_codes": "CASE a_line WHEN 1 THEN array('missed_sink', 'other') WHEN 3 THEN array('other', 'other') WHEN 4 THEN array('bogus') END",
        "notes": "'looked at $secret = \"abcdefghijk\"'",
        "reviewed_at": "completed_at + make_dt_interval(0, v)",
    }, ["reviewer"])


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage actions from the event stream: label, undo or heartbeat."""
    return decisions_from(table(spark, sf_dir, "events"))


def decisions_from(events: DataFrame) -> DataFrame:
    return _columns(events, {
        "decided_at": "ts",
        "finding_id": "user_id",
        "action": "CASE WHEN event_type IN ('purchase', 'error') THEN 'label' WHEN event_type = 'click' THEN 'undo' ELSE 'heartbeat' END",
        "label": "CASE event_type WHEN 'purchase' THEN 'true_positive' WHEN 'error' THEN 'false_positive' END",
        "rule_id": "concat('rule.', user_id % 25)",
    }, ["event_id"])


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author of the first lines of each supplier's file."""
    return _columns(table(spark, sf_dir, "supplier"), {
        "file_path": _path("s_suppkey"),
        "line_no": "explode(sequence(3, 18, 3))",
        "author": f"concat_ws('-', 'dev', s_nationkey, {_pick('s_suppkey % 6', AUTHOR_SEGMENTS)})",
    })


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return _columns(o.join(c, o.o_custkey == c.c_custkey), {
        "commit_id": "o_orderkey", "author": "concat_ws('-', 'dev', c_nationkey, c_mktsegment)",
    })


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source file: every line is code with a digit from its text, and the text as a comment."""
    from winnow.sources.files import explode_lines

    lines = explode_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    folders = ["app/", "src/tests/", "Vendor/", "lib/public/"]
    code = f"replace({_pick(f'(line_no * 5 + doc_id) % {len(CODE_LINES)}', CODE_LINES)}, '%d', string(length(text) % 9))"
    return _columns(lines, {
        "file_path": f"concat({_pick('doc_id % 4', folders)}, source, '/D', doc_id, '.php')",
        "text": f"concat({code}, ' // ', text)",
    }, ["doc_id", "line_no"])
