import pytest

from winnow.operators import dataflow, detect


def hits(spark, *lines):
    df = spark.createDataFrame([("f.php", i + 1, t) for i, t in enumerate(lines)], "file_path string, line_no int, text string")
    return {(r["line_number"], r["rule_id"].split(".")[-1]): r["message"] for r in detect.scan_lines(df).collect()}


@pytest.mark.parametrize("line,rule", [
    ('DB::select("SELECT * FROM t WHERE id = $id");', "sql-injection"),
    ("$q->whereRaw('a = ' . $b);", "sql-injection"),
    ("mysqli_query($link, $sql);", "sql-injection"),
    ("exec($cmd);", "command-injection"),
    ("$x = `ls $dir`;", "command-injection"),
    ("unserialize($_COOKIE['a']);", "unserialize-user-input"),
    ("include $page;", "path-traversal"),
    ("file_get_contents('a/' . $b);", "path-traversal"),
    ("echo $name;", "xss-unescaped-output"),
    ("User::create($request->all());", "mass-assignment"),
    ("$h = md5($password);", "weak-hashing"),
    ('$api_key = "sk-live-9f83nfu2b8vd0193ndkq";', "hardcoded-secret"),
])
def test_positive(spark, line, rule):
    assert (1, rule) in hits(spark, line)


@pytest.mark.parametrize("line", [
    'DB::select("SELECT 1");', "exec('ls');", "echo htmlspecialchars($x);", "echo 'plain';", "include 'a.php';",
    "User::create(['a' => 1]);", '$password = "";', '$token = "changeme";', '$secret = "abc";',
    '"password" => "required|string|min:6|confirmed",', '"current_password" => "required|min:8",',
    '"api_token" => "nullable|string|max:255",', 'return ["current_password" => "The current password is incorrect."];',
    "// exec($cmd);", "# echo $x;",
])
def test_negative(spark, line):
    assert hits(spark, line) == {}


def test_messages(spark):
    out = hits(spark, "md5($user->password);", "md5($file);", "unserialize($request->input('p'));", "unserialize($x);")
    assert out[(1, "weak-hashing")] == "md5() appears to hash a credential"
    assert out[(2, "weak-hashing")] == "md5() is cryptographically broken"
    assert out[(3, "unserialize-user-input")] == "unserialize() called directly on request input"
    assert out[(4, "unserialize-user-input")] == "unserialize() called on a dynamic value"


CODE = """<?php
$top = 1;
function a($x) {
    if ($x && $y) {
        foreach ($x as $i) { echo htmlspecialchars($i); }
    }
    return $x ?? $y ? 1 : 2;
}
function b($z) {
    $n = $z->load();
}""".split("\n")


def test_scopes(spark):
    df = spark.createDataFrame([("f.php", i + 1, t) for i, t in enumerate(CODE)], "file_path string, line_no int, text string")
    rows = {r["line_no"]: r for r in detect.scope_features(df).collect()}
    assert rows[2]["scope_start"] is None and rows[2]["cyclomatic_complexity"] == 1 and rows[2]["line_depth_in_function"] == 0
    assert rows[5]["line_depth_in_function"] == 2 and rows[5]["cyclomatic_complexity"] == 1 + 4 and rows[5]["has_sanitizer_in_ast"] == 1
    assert rows[10]["cyclomatic_complexity"] == 1 and rows[10]["has_sanitizer_in_ast"] == 0


FLOW = [
    ("a.php", ["function f() {", "$a = $_GET['x'];", "$b = trim($a);", "$c = 'x' . $b;", "exec($c);", "}"]),
    ("b.php", ["function f() {", "$a = $_POST['x'];", "$a = 'fixed';", "exec($a);"]),
    ("c.php", ["function f() {", "$a = $_GET['x'];", "echo htmlspecialchars($a);"]),
    ("d.php", ["function f() {", "$a = $a . $b;", "exec($a);"]),
    ("e.php", ["function g() {", "$a = $_GET['x'] . $_POST['y'];", "}", "function h() {", "exec($a);"]),
    ("f.php", ["exec('ls' . $_COOKIE['c'] . $request->input('q'));"]),
]


def test_reachability(spark):
    rows = [(f, i + 1, t) for f, ls in FLOW for i, t in enumerate(ls)]
    df = spark.createDataFrame(rows, "file_path string, line_no int, text string")
    out = {r["file_path"]: r for r in dataflow.trace(df).collect()}
    assert out["a.php"]["reaches_request_input"] == 1 and out["a.php"]["attacker_reachable_context"] == "query"
    assert out["a.php"]["taint_steps"] == 3 and out["a.php"]["argument_shape"] == "variable"
    assert out["b.php"]["reaches_request_input"] == 0 and out["b.php"]["attacker_reachable_context"] == "none"
    assert out["c.php"]["sanitised_before_sink"] == 1 and out["c.php"]["reaches_request_input"] == 1
    assert out["d.php"]["reaches_request_input"] == 0 and out["d.php"]["attacker_reachable_context"] == "unknown"
    assert out["e.php"]["reaches_request_input"] == 0
    assert out["f.php"]["attacker_reachable_context"] == "mixed"


@pytest.mark.parametrize("argument,shape", [
    ("", "none"), ('"a $b"', "interpolation"), ("'abc'", "literal"), ("42", "literal"), ("$a", "variable"), ("'a' . $b", "concatenation"),
    ("trim($a)", "function_call"), ("$a->get('x')", "method_call"), ("[$a]", "array"), ("$a['x']", "array_access"), ("$a->b", "property_access"),
    ("$a ? 1 : 2", "conditional"),
])
def test_argument_shape(spark, argument, shape):
    df = spark.createDataFrame([(argument,)], "a string")
    assert df.select(detect.argument_shape("a")).first()[0] == shape


def test_scopes_of_a_long_file(spark, monkeypatch):
    """A file of many blocks has the scopes it would have as one group."""
    monkeypatch.setattr(detect, "SCOPE_BLOCK", 7)
    text = ["function a() {", "if ($x) {", *["$y = 1;"] * 20, "trim($y);" , "for (;;) {}", "}}", "function b() {", *["while ($z) {}"] * 9]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(["<?php", "if ($q) {}", *text], 1)], "file_path string, line_no int, text string")
    got = {r["line_no"]: (r["scope_start"], r["line_depth_in_function"], r["cyclomatic_complexity"]) for r in detect.scope_features(rows).collect()}
    second = 3 + text.index("function b() {")
    assert got[1] == got[2] == (None, 0, 1)
    assert {got[i] for i in range(3, second)} == {(3, i - 3, 3) for i in range(3, second)}
    assert {got[i] for i in range(second, second + 10)} == {(second, i, 10) for i in range(10)}


NESTED = """<?php
abstract class K {
    abstract function m($x);
    abstract function n(
        $x
    ): int;
    public $p = 1;
    function outer($a) { if ($a) { return 1; }
        $f = function ($b) use ($a) {
            return $b && $a;
        };
        $g = fn($z) => $z ? 1 : 2; while ($a) {}
        $h = fn($z) => e2($z); $i = function () { return 1; };
        echo "} {"; // }
        return htmlspecialchars($a);
    } function next() { }
    const C = 1;
}
if ($top) { for (;;) {} }
function open() {
    case(1);""".split("\n")


def test_scopes_end_and_nest(spark, monkeypatch):
    """A line is in the scope that begins last of those it lies in; sums are the whole scope's; blocks change nothing."""
    want = {  # line: start, complexity, sanitizer
        3: (3, 1, 0), 4: (4, 1, 0), 5: (4, 1, 0), 6: (4, 1, 0), 8: (8, 5, 1), 9: (9, 2, 0), 10: (9, 2, 0), 11: (9, 2, 0),
        12: (12, 3, 0), 13: (13, 1, 0), 14: (8, 5, 1), 15: (8, 5, 1), 16: (16, 1, 0), 20: (20, 2, 0), 21: (20, 2, 0)}
    rows = [(f, i, t, f"x{i}") for f in ("a", "b") for i, t in enumerate(NESTED, 1)]
    df = spark.createDataFrame(rows, "file_path string, line_no int, text string, note string")
    for size in (4096, 7, 2, 1):
        monkeypatch.setattr(detect, "SCOPE_BLOCK", size)
        out = detect.scope_features(df)
        assert out.columns == [*df.columns, "scope_start", "line_depth_in_function", "cyclomatic_complexity", "has_sanitizer_in_ast"]
        got = {(r[0], r["line_no"]): r for r in out.collect()}
        assert len(got) == len(rows) and all(r["note"] == f"x{r['line_no']}" for r in got.values())
        for (_, i), r in got.items():
            start, cc, san = want.get(i, (None, 1, 0))
            assert (i, r["scope_start"], r["line_depth_in_function"], r["cyclomatic_complexity"], r["has_sanitizer_in_ast"]) == (i, start, i - start if start else 0, cc, san)


def test_scopes_of_no_lines(spark):
    assert detect.scope_features(spark.createDataFrame([], "file_path string, line_no int, text string")).collect() == []


def lines(spark, *files):
    rows = [(f"{k}.php", i + 1, t) for k, text in enumerate(files) for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file_path string, line_no int, text string")


def test_every_call_of_a_line_is_a_finding(spark):
    code = ("system($a); system($b); exec($c);", "exec(system($q)); exec('ls'); $x = `ls $d` . `id`;", "echo e($x); echo $y; print $z; echo htmlspecialchars($n);",
            "md5($password); sha1($f); md5('x');", "mysqli_query($link, 'SELECT 1'); mysqli_query($link, $s); DB::select($s, [1]);",
            'include $a; include "b.php"; unlink("t/" . $c); fopen($d);', '$secret = "abcdefabcdef1"; $token = "changeme-changeme"; $password = "qwertyqwerty1";')
    got = {}
    for r in detect.scan_lines(lines(spark, "\n".join(code))).orderBy("rule_id", "occurrence").collect():
        got.setdefault((r["line_number"], r["rule_id"].split(".")[-1]), []).append((r["occurrence"], r["message"]))
    assert {k: [n for n, _ in v] for k, v in got.items()} == {
        (1, "command-injection"): [1, 2, 3], (2, "command-injection"): [1, 2, 3, 4], (3, "xss-unescaped-output"): [1, 2], (4, "weak-hashing"): [1, 2, 3],
        (5, "sql-injection"): [1, 2], (6, "path-traversal"): [1, 2, 3], (7, "hardcoded-secret"): [1, 2]}
    assert [m.split("(")[0] for _, m in got[4, "weak-hashing"]] == ["md5", "sha1", "md5"]
    assert [m for _, m in got[2, "command-injection"]][:2] == ["Backtick shell execution"] * 2


def test_a_rule_of_ones_own_may_give_one_message_or_several(spark):
    from pyspark.sql import functions as F

    one = detect.Rule("t.one", None, "LOW", "", lambda c: F.when(c.contains("x"), "m"))
    many = detect.Rule("t.many", 7, "LOW", "", lambda c: F.transform(F.regexp_extract_all(c, F.lit("x"), F.lit(0)), lambda g: F.lit("m")))
    detect.register_rule(one)
    detect.register_rule(many)
    try:
        found = detect.scan_lines(lines(spark, "x x x\ny"), ["t.one", "t.many"]).collect()
    finally:
        detect.RULES.pop("t.one"), detect.RULES.pop("t.many")
    assert sorted((r["rule_id"], r["occurrence"], r["cwe_id"]) for r in found) == [("t.many", 1, 7), ("t.many", 2, 7), ("t.many", 3, 7), ("t.one", 1, None)]


@pytest.mark.parametrize("code,sinks", [
    ("copy($a, f($b, 'x)')); rename($c);", [("copy", ["$a", "f($b, 'x)')"]), ("rename", ["$c"])]),
    ("pg_query($link, $sql); pg_query($only); mysqli_query($l, \"a, $b\", 1);", [("pg_query", ["$sql"]), ("pg_query", ["$only"]), ("mysqli_query", ['"a, $b"'])]),
    ("printf('%s', $a, [1, 2]); vprintf();", [("printf", ["'%s'", "$a", "[1, 2]"]), ("vprintf", [])]),
    ("echo $a, 'b'; print($c); include_once dirname(__FILE__) . '/x';", [("echo", ["$a", "'b'"]), ("print", ["($c)"]), ("include", ["dirname(__FILE__) . '/x'"])]),
    ("$r = `ls $a $b`;", [("backtick", ["$a", "$b"])]),
    ("eval($b); system($a); echo $a;", [("system", ["$a"]), ("echo", ["$a"])]),
    ("$o->exec($a); A::copy($b); function system($c) { }", []),
    ("$s = 'system($x)'; // exec($y)", []),
    ("\\exec($a); $db->query($q)->fetch(); DB::statement('x');", [("exec", ["$a"]), ("query", ["$q"]), ("statement", ["'x'"])]),
])
def test_arguments_by_balanced_brackets(spark, code, sinks):
    found = lines(spark, code).select(detect.sinks_in(detect.code_only("text")).alias("s")).first()["s"]
    assert [(x["name"], x["arguments"]) for x in found] == sinks


def test_methods_that_only_a_hint_makes_sinks(spark):
    from pyspark.sql import functions as F

    df = lines(spark, "User::create($a); $st->execute([$b]); $st->bindValue(1, $c); $pdo->exec($d); system($e);")
    found = {h: [(x["name"], x["arguments"], x["bound"]) for x in df.select(detect.sinks_in(detect.code_only("text"), F.lit(h)).alias("s")).first()["s"]]
             for h in ("mass_assignment", "sql_query", "command_execution")}
    assert found == {
        "mass_assignment": [("create", ["$a"], False)],
        "sql_query": [("execute", ["[$b]"], True), ("bindvalue", ["$c"], True), ("exec", ["$d"], False)],
        "command_execution": [("system", ["$e"], False)]}


def test_statements_go_on_over_open_brackets(spark, monkeypatch):
    code = "<?php\n$x = f(\n  $_GET['a'],\n  [1,\n  2]);\nmysqli_query(\n  $link,\n  $x\n); exec($x);\n)\necho 1;"
    for size in (4096, 2):
        monkeypatch.setattr(detect, "SCOPE_BLOCK", size)
        found = {r["line_no"]: r["_code"].count("\n") for r in detect.statements(lines(spark, code)).collect()}
        assert found == {1: 0, 2: 3, 6: 3, 10: 0, 11: 0}
    traced = {(r["line_no"], r["sink_name"]): r for r in dataflow.trace(lines(spark, code)).collect()}
    assert set(traced) == {(6, "mysqli_query"), (9, "exec"), (11, "echo")}
    assert traced[6, "mysqli_query"]["attacker_reachable_context"] == traced[9, "exec"]["attacker_reachable_context"] == "query"
    monkeypatch.setattr(detect, "STATEMENT_LINES", 3)
    open_file = "f(\n" + "\n".join("exec($a);" for _ in range(9))
    assert {r["line_no"] for r in detect.statements(lines(spark, open_file)).collect()} == {1, *range(4, 11)}


def test_flow_through_reassignments_helpers_and_arguments(spark):
    """T1 to T4, loops, order on one line, single quotes, raw bodies, bound parameters."""
    files = [
        '$x = $_GET["q"];\n$x = trim($x);\necho $x;',
        "$sql = 'a' . $_POST['b'];\nmysqli_query($link, $sql);",
        "$x = request('q');\necho $x;",
        "$d = $_COOKIE['d'];\n$o = `ls $d`;",
        "$a = $a . 'x';\nexec($a);",
        "exec($a); $a = $_GET['x']; exec($a);",
        "$v = $_GET['v'];\necho 'costs $v';",
        "$b = file_get_contents('php://input');\nunserialize($b);",
        "$a = request()->query('x');\n$b = $a;\n$a = 'safe';\ncopy($a, $b);",
        "echo request()->all()['x'], $_POST['y'];",
        "$n = 5;\nprintf('%d', $n);",
    ]
    got = {}
    for r in dataflow.trace(lines(spark, *files)).orderBy("line_no", "sink_no").collect():
        got.setdefault(int(r["file_path"][:-4]), []).append((r["sink_name"], r["reaches_request_input"], r["attacker_reachable_context"], r["taint_steps"], r["argument_shape"]))
    assert got == {
        0: [("echo", 1, "query", 2, "variable")],
        1: [("mysqli_query", 1, "body", 1, "variable")],
        2: [("echo", 1, "request", 1, "variable")],
        3: [("backtick", 1, "cookie", 1, "variable")],
        4: [("exec", 0, "unknown", 1, "variable")],
        5: [("exec", 0, "unknown", 0, "variable"), ("exec", 1, "query", 1, "variable")],
        6: [("echo", 0, "none", 0, "literal")],
        7: [("file_get_contents", 0, "none", 0, "literal"), ("unserialize", 1, "raw_body", 1, "variable")],
        8: [("query", 0, "none", 0, "literal"), ("copy", 1, "query", 3, "multiple")],
        9: [("echo", 1, "mixed", 0, "multiple")],
        10: [("printf", 0, "none", 1, "multiple")],
    }


def test_the_states_of_a_trace_are_few(spark):
    """Many ways through the same assignments are one state each."""
    code = "$a0 = $_GET['x'];\n$b0 = 1;\n" + "\n".join(f"$a{i} = $a{i - 1} . $b{i - 1};\n$b{i} = $a{i - 1} . $b{i - 1};" for i in range(1, 9)) + "\nexec($a8 . $b8);"
    r, = dataflow.trace(lines(spark, code)).collect()
    assert (r["reaches_request_input"], r["taint_steps"]) == (1, 18)
