import hashlib

import pytest
from pyspark.sql import functions as F

from tests.data import FINDING, finding
from winnow.functions import fixes, identity, scoring, texts
from winnow.settings import Settings


def values(df):
    return [tuple(r) for r in df.collect()]


def test_outcome_vs_model(spark):
    rows = [("true_positive", "likely_tp"), ("true_positive", "confirmed_fp"), ("false_positive", "likely_fp"),
            ("false_positive", "confirmed_tp"), ("true_positive", "needs_validation"), (None, "likely_tp")]
    df = spark.createDataFrame(rows, "p string, c string").select(scoring.outcome_vs_model("p", "c"))
    assert [r[0] for r in df.collect()] == [
        "true_positive", "false_positive", "true_negative", "false_negative", "unresolved", "unresolved"]


def test_outcome_vs_human(spark):
    rows = [("true_positive", "confirmed_tp"), ("false_positive", "likely_tp"), ("false_positive", "confirmed_fp"),
            ("true_positive", "likely_fp"), (None, "likely_fp")]
    df = spark.createDataFrame(rows, "l string, c string").select(scoring.outcome_vs_human("l", "c"))
    assert [r[0] for r in df.collect()] == ["true_positive", "false_positive", "true_negative", "false_negative", "unresolved"]


def test_adjudication(spark):
    rows = [("false_positive", 0.10, "confirmed_fp", "confirmed_fp"), ("true_positive", 0.75, "likely_tp", "confirmed_tp"),
            ("true_positive", 0.74, "likely_tp", "confirmed_tp"), ("true_positive", 0.9, "likely_tp", "likely_fp"),
            (None, None, "likely_fp", "likely_fp")]
    df = spark.createDataFrame(rows, "p string, s double, a string, d string")
    df = df.withColumn("c", scoring.adjudicate("p", "s", "a", "d")).withColumn(
        "x", scoring.adjudication_confidence("p", "s", F.lit(1.0), F.lit(1.0), "c"))
    out = values(df.select("c", "x"))
    assert [o[0] for o in out] == ["likely_fp", "likely_tp", "needs_validation", "needs_validation", "needs_validation"]
    assert out[0][1] == 0.96
    assert out[4][1] == 0.8


def test_confidence(spark):
    df = spark.createDataFrame([("50",), ("0.4",), ("n/a",), ("250",), ("-1",), (None,)], "v string")
    assert [r[0] for r in df.select(scoring.normalize_confidence("v")).collect()] == [0.5, 0.4, None, 1.0, 0.0, None]


def test_thresholds(spark):
    s = Settings(rule_min_samples=4)
    df = spark.createDataFrame([(5, 1.0), (4, 0.75), (3, 1.0), (9, 0.70)], "n bigint, r double")
    assert [r[0] for r in df.select(scoring.rule_action("n", "r", s)).collect()] == ["suppress", "review_config", None, None]
    p = spark.createDataFrame([(0.8, True), (0.15, True), (0.5, True), (0.9, False), (None, True)], "p double, c boolean")
    assert [r[0] for r in p.select(scoring.decision("p", "c")).collect()] == ["true_positive", "false_positive", None, None, None]


def test_fingerprint_is_plain_sha256(spark):
    df = spark.createDataFrame([finding(1, file_path="a\\b.php", snippet="  x( $y\t\n ) ; ", cwe_id=None),
                                finding(2, snippet="   ", message="  hello ")], FINDING)
    got = df.select(identity.finding_fingerprint("rule_id", "cwe_id", "file_path", "line_number", "raw_snippet", "message")).collect()
    def digest(*parts):
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()
    assert got[0][0] == digest("php.security.path-traversal", "", "a/b.php", "10", "x( $y ) ;")
    assert got[1][0] == digest("php.security.path-traversal", "89", "src/F2.php", "10", "hello")


def test_group_key_and_split(spark):
    df = spark.createDataFrame([(7, " ABC ", 3), (7, "  ", 3)], "p bigint, c string, s bigint")
    keys = [r[0] for r in df.select(identity.group_key("p", "c", "s")).collect()]
    assert keys == ["7\0abc", "7\0\0scan:3"]
    expected = [int(hashlib.sha256(k.encode()).hexdigest()[:8], 16) % 100 for k in keys]
    assert [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(identity.split_bucket("k")).collect()] == expected
    with pytest.raises(ValueError):
        identity.reviewer_split("p", "c", 51)


def test_missing_features_get_sentinels(spark):
    df = spark.createDataFrame([finding(1, vec=(None,) * 13)], FINDING)
    row = df.select(identity.normalized_vector("feature_vector").alias("v")).select("v.*").first()
    assert tuple(row) == (0, "MEDIUM", "php", 0, 0, 0, 0, 0.0, "unknown", -1, -2, -1, "unknown")


def test_redaction(spark):
    secrets = ['$api_key = "abcdefghijklmnop";', "authorization: Bearer abcdefghijklmnop", "'password' => 'hunter2hunter2'",
               '{"code":"$token = \\"abcdefghijklmnop\\";"}']
    df = spark.createDataFrame([(s,) for s in [*secrets, "$n = 5;"]], "t string")
    once = df.select(texts.redact("t").alias("t"))
    out = [r[0] for r in once.collect()]
    assert "[REDACTED:API_KEY_OR_TOKEN]" in out[0] and "[REDACTED:BEARER_TOKEN]" in out[1] and "[REDACTED:PASSWORD]" in out[2]
    assert all("abcdefghijklmnop" not in o and "hunter2" not in o for o in out)
    assert out[4] == "$n = 5;"
    assert [r[0] for r in once.select(texts.redact("t")).collect()] == out


def test_bounded_and_csv(spark):
    df = spark.createDataFrame([("abcdef",), ("=cmd",), (" +1",), ("ok",)], "t string")
    assert [r[0] for r in df.select(texts.limited("t", 4)).collect()] == ["abcd...", "=cmd", " +1", "ok"]
    assert [r[0] for r in df.select(texts.csv_safe("t")).collect()] == ["abcdef", "'=cmd", "' +1", "ok"]


def test_answers(spark):
    rows = ['{"classification":"likely_tp","confidence":"0.9"}', '{"classification":"likely_tp","reasoning_summary":"a\tb\n"}',
            '{"classification":', "[1]", "text"]
    df = spark.createDataFrame([(r,) for r in rows], "c string").select(texts.parse_answer("c").alias("a"))
    out = [r["a"] for r in df.collect()]
    assert out[0]["classification"] == "likely_tp" and out[1]["reasoning_summary"] == "a\tb\n"
    assert out[2:] == [None, None, None]


def test_paths(spark):
    df = spark.createDataFrame([("a/b.blade.php",), ("x/tests/T.php",), ("y/FooTest.php",), ("bin/run",), ("a\\b\\c.PHP",)], "p string")
    assert [r[0] for r in df.select(scoring.file_extension("p")).collect()] == ["blade.php", "php", "php", "unknown", "PHP"]
    assert [r[0] for r in df.select(scoring.is_test_file("p")).collect()] == [0, 1, 1, 0, 0]
    last = df.select(scoring.path_parts("p").alias("x")).collect()[4]["x"]
    assert (last["directory"], last["file"], last["segments"]) == ("a/b", "c.PHP", ["a", "b"])


def test_suggested_fixes(spark):
    rows = [
        finding(1, cwe_id=89, snippet="""$db->query("SELECT a FROM t WHERE n = '$name' AND k = $row->key AND m = $name");"""),
        finding(2, cwe_id=79, snippet="echo $x . '!';"),
        finding(3, cwe_id=22, snippet="readfile($f); unlink($f . $folder);"),
        finding(4, cwe_id=1),
        finding(5, cwe_id=89, snippet=" "),
        finding(6, cwe_id=78, snippet="exec('tar ' . $archive->name);"),
        finding(7, cwe_id=502, snippet="$d = unserialize($in, ['allowed_classes' => false]);"),
        finding(8, cwe_id=915, snippet="Post::create($request->all());"),
        finding(9, cwe_id=327, snippet="$h = md5($pin);"),
        finding(10, cwe_id=798, snippet="$apiKey = 'not a real one';"),
        finding(11, cwe_id=89, snippet="$db->query($sql);"),
    ]
    out = {r["id"]: r["suggested_fix"] for r in fixes.with_suggested_fix(spark.createDataFrame(rows, FINDING)).collect()}
    after = {i: f["after"].split("\n") for i, f in out.items() if f is not None}
    assert after[1] == ['$statement = $pdo->prepare("SELECT a FROM t WHERE n = ? AND k = ? AND m = ?");', "$statement->execute([$name, $row->key, $name]);", "$rows = $statement->fetchAll();"]
    assert after[2] == ["echo htmlspecialchars($x . '!', ENT_QUOTES | ENT_SUBSTITUTE, 'UTF-8');"]
    assert after[3][1] == "$checked = realpath($root . '/' . $f);" and after[3][-1] == "readfile($checked); unlink($checked . $folder);"
    assert after[6][0] == "$process = proc_open(['tar', $archive->name], [1 => ['pipe', 'w']], $pipes);"
    assert after[8] == ["$allowed = ['title', 'body'];", "Post::create($request->only($allowed));"]
    assert after[9][1] == "$h = hash_hmac('sha256', $pin, $key);"
    assert after[10][:2] == ["$apiKey = getenv('APIKEY');", "if ($apiKey === false) {"]
    assert after[7] == ["$d = json_decode($in, true, 64, JSON_THROW_ON_ERROR);"]
    assert all(out[i] is None for i in (4, 5, 11))


def test_review_priority(spark):
    df = spark.createDataFrame(
        [("CRITICAL", "x.command-injection", "exec($a)", 0.9, ["likely_tp", "confirmed_fp"], 3, 0),
         ("LOW", "x.path-traversal", "", None, ["needs_validation"], 1, 4)],
        "s string, r string, c string, p double, a array<string>, n bigint, tp bigint")
    args = ["s", "r", "c", "p", "a", "n", "tp"]
    out = df.select(scoring.review_priority(*args), scoring.priority_reasons(*args)).collect()
    assert out[0][0] == 40 + 30 + 25 + 5 + 5 + 12 + 20 + 2
    assert out[1][0] == 10 + 10 + 15 + 6
    assert out[1][1] == ["severity_low", "limited_trusted_tp_for_rule", "path_traversal_priority", "ai_needs_validation", "ai_advisory_signal"]


def test_short_and_unquoted_secrets_are_redacted(spark):
    rows = ['password = "abc123"', "token=abcdef0123", "secret: x", "$token = $request->input('t');", "api_key => 'a b c'", "no secrets here"]
    out = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(texts.redact(texts.redact("t"))).collect()]
    assert out == ['password = "[REDACTED:PASSWORD]"', "token=[REDACTED:API_KEY_OR_TOKEN]", "secret: [REDACTED:SECRET]", rows[3], "api_key => '[REDACTED:API_KEY_OR_TOKEN]'", rows[5]]


def test_group_key_ignores_all_white_space(spark):
    df = spark.createDataFrame([(1, "AB", 7), (1, "ab\n", 8), (1, " \t", 9)], "p bigint, c string, s bigint").select(identity.group_key("p", "c", "s"))
    assert [r[0] for r in df.collect()] == ["1\0ab", "1\0ab", "1\0\0scan:9"]
