"""Suggested rewrite of a flagged line, and advice per weakness class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.common import col, trim_all

# Cwe -> what a reviewer should do.
FIX_NOTES = {
    22: "Strip folder parts, resolve the path, and check it is still inside the allowed folder.",
    89: "Move every value into the bindings; names of tables and columns need an allowlist.",
    78: "Pass arguments as an array so that no shell reads them.",
    502: "Use a format that cannot build objects; stored values need migrating.",
    915: "Pass only the fields a user may set.",
    327: "Change this only where the value protects something.",
    798: "Read the value from configuration, and rotate it if it was ever committed.",
    79: "Escape at the place of output.",
}
VALUE = r"\$[A-Za-z_]\w*(?:->\w+)*"
QUERY_TEXT = r'"([^"]*\$[^"]*)"'
PLACEHOLDER_FOR = r"'?\{?(" + VALUE + r")\}?'?"
PROGRAM = r"""(?:exec|system|passthru|shell_exec|popen|proc_open)\s*\(\s*["']\s*([\w./-]+)"""

# Title, risk, remedy, sign of a real hit, sign of a false alarm.
GUIDANCE = [
    (89, "SQL injection", "Queries can be rewritten by whoever sends the input.",
     "Bind values instead of joining strings.", "Request data joined into the statement.", "Bound or constant parts only."),
    (78, "Command injection", "Commands run as the server user.",
     "Use an argument array, or escape each argument.", "Part of the command comes from outside.", "Escaped or constant arguments."),
    (502, "Unsafe deserialization", "Crafted data can build objects with side effects.",
     "Use plain data formats.", "Data crossed a trust boundary.", "The application wrote the data itself."),
    (22, "Path traversal", "Files outside the folder can be read or changed.",
     "Generate names, or resolve and check the path.", "A path part comes from the user.", "Configured or generated path."),
    (79, "Cross-site scripting", "Script runs in another person's browser.",
     "Escape on output.", "User text reaches HTML unescaped.", "Escaped elsewhere, or not HTML."),
    (915, "Mass assignment", "Fields nobody meant to expose can be set.",
     "List the fields that may be set.", "No field list on the model.", "The model lists its fields."),
    (327, "Weak hashing", "Hashes can be guessed or forged.",
     "Use a slow salted hash, or a keyed one.", "Protects a password, token or signature.", "Cache key or checksum."),
    (798, "Hardcoded credential", "Everyone with the source has the secret.",
     "Move it to configuration and rotate it.", "A usable secret is in the source.", "Placeholder or test value."),
]
GUIDANCE_FALLBACK = ("Security finding", "Depends on what the operation can do.",
                     "Validate or encode the value where it is used.", "Untrusted input reaches the operation.",
                     "The value is trusted or checked before.")
GUIDANCE_COLUMNS = ["title", "risk", "fix", "true_positive_sign", "false_positive_sign"]


def first_value(line) -> Column:
    """The first variable of the line with its properties; empty without one."""
    return F.regexp_extract(col(line), VALUE, 0)


def _with(line: Column, value: Column, other: str) -> Column:
    """The line with every use of a value replaced."""
    return F.regexp_replace(line, F.concat(F.lit("\\Q"), value, F.lit("\\E\\b")), F.lit(other.replace("$", "\\$")))


def _inside_root(line: Column) -> Column:
    value = first_value(line)
    guard = F.concat(
        F.lit("$root = realpath((string) getenv('FILE_ROOT'));\n$checked = realpath($root . '/' . "), value, F.lit(");\n"),
        F.lit("if ($root === false || $checked === false || strpos($checked, $root . '/') !== 0) {\n"),
        F.lit("    throw new RuntimeException('The path leaves the file root.');\n}\n"),
    )
    return F.when(value != "", F.concat(guard, _with(line, value, "$checked")))


def _prepared(line: Column) -> Column:
    """The statement's text with a placeholder for every use of a value, and the values in that order."""
    text = F.regexp_extract(line, QUERY_TEXT, 1)
    values = F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))
    code = F.concat(
        F.lit('$statement = $pdo->prepare("'), F.regexp_replace(text, PLACEHOLDER_FOR, "?"), F.lit('");\n$statement->execute(['),
        F.array_join(values, ", "), F.lit("]);\n$rows = $statement->fetchAll();"),
    )
    return F.when(text != "", code)


def _without_shell(line: Column) -> Column:
    value, program = first_value(line), F.regexp_extract(line, PROGRAM, 1)
    code = F.concat(
        F.lit("$process = proc_open(['"), program, F.lit("', "), value, F.lit("], [1 => ['pipe', 'w']], $pipes);\n"),
        F.lit("$output = stream_get_contents($pipes[1]);\nproc_close($process);"),
    )
    return F.when((value != "") & (program != ""), code)


def _from_environment(line: Column) -> Column:
    value = first_value(line)
    name = F.upper(F.regexp_replace(value, r"\W+", ""))
    return F.when(value != "", F.concat(
        value, F.lit(" = getenv('"), name, F.lit("');\nif ("), value, F.lit(" === false) {\n    throw new RuntimeException('"),
        name, F.lit(" is not set.');\n}")))


def _changed(line: Column, pattern: str, replacement: str, before: str = "") -> Column:
    """The line with all matches rewritten, after what they need; null if nothing matches."""
    return F.when(line.rlike(pattern), F.concat(F.lit(before), F.regexp_replace(line, pattern, replacement)))


#: our own rewrites: each yields complete code for a line of its class, or null where the line does not have the form
REWRITES = {
    22: _inside_root,
    89: _prepared,
    78: _without_shell,
    502: lambda ln: _changed(ln, r"\bunserialize\s*\(([^,()]+)[^()]*\)", r"json_decode($1, true, 64, JSON_THROW_ON_ERROR)"),
    915: lambda ln: _changed(ln, r"(\$request|\brequest\(\))->all\(\)", r"$1->only(\$allowed)", "$allowed = ['title', 'body'];\n"),
    327: lambda ln: _changed(ln, r"\b(?:md5|sha1)\s*\(([^()]+)\)", r"hash_hmac('sha256', $1, \$key)", "$key = (string) getenv('HASH_KEY');\n"),
    798: _from_environment,
    79: lambda ln: _changed(ln, r"\b(echo|print)\s+([^;]*\$[^;]*);", r"$1 htmlspecialchars($2, ENT_QUOTES | ENT_SUBSTITUTE, 'UTF-8');"),
}


def with_suggested_fix(f: DataFrame) -> DataFrame:
    """Adds ``suggested_fix``: struct(before, after, note), null for a blank snippet,
    an unknown class, or a line without the form its class is rewritten from.

    The trimmed line is its own projection, so its expression is evaluated once.
    """
    trimmed = f.withColumn("_line", trim_all("raw_snippet"))
    return trimmed.withColumn("suggested_fix", _rewrite(F.col("cwe_id"), F.col("_line"))).drop("_line")


def _rewrite(cwe: Column, line: Column) -> Column:
    after = note = F.lit(None).cast("string")
    for number, build in REWRITES.items():
        after = F.when(cwe == number, build(line)).otherwise(after)
        note = F.when(cwe == number, F.lit(FIX_NOTES[number])).otherwise(note)
    return F.when((line != "") & after.isNotNull(), F.struct(line.alias("before"), after.alias("after"), note.alias("note")))


def guidance_table(spark: SparkSession) -> DataFrame:
    """Eight fixed rows, always small enough to broadcast."""
    return spark.createDataFrame(GUIDANCE, ["guidance_cwe", *GUIDANCE_COLUMNS]).withColumn(
        "guidance_cwe", F.col("guidance_cwe").cast("int")
    )
