"""Detection rules and code features over source lines.

Line-local approximation of what a parser would see: comments are cut and the
first argument of a call decides.  Every call of a line is a finding of its own,
numbered per rule.  All rules are one projection over the lines, so a scan is a
single narrow pass.  Sinks come from the tokens of whole statements: brackets
opened on one line may close on a later one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import scoring
from winnow.functions.common import any_of, col, let

MSG = fv.DETECTION_MESSAGES

# Fixed patterns: they stay inside what Java and RE2 read alike.
STRING = r"""\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"""
COMMENT = rf"({STRING})|//.*$|#.*$"
CALL_START = r"(?:^|[^\w>:$])"
DYNAMIC = (
    r"""\s*(?:"[^"]*\$[^"]*"|(?:"[^"]*"|'[^']*')\s*\.|\$|[A-Za-z_]\w*\s*\(|[A-Za-z_]\w*(?:->|::)\w+\s*\()"""
)
BUILT = r"""\s*(?:"[^"]*\$[^"]*"|(?:"[^"]*"|'[^']*')\s*\.|\$[\w\[\]'">-]+\s*\.\s)"""
REQUEST = (
    r"(?:\$_(?:GET|POST|REQUEST|COOKIE)\b|\$?\w+(?:\(\))?->" + any_of(fv.REQUEST_READ_METHODS) + r"\s*\()"
)
NO_NAME_BEFORE = r"(?<![\w>:$])"


def _calls(names) -> str:
    """Calls of plain functions, wherever on the line: what stands before is looked at, not consumed."""
    return NO_NAME_BEFORE + any_of(names) + r"\s*\("


SQL_CALL = (
    r"(?i)(?:(?:\bDB::" + any_of(fv.DB_STATIC_METHODS) + r"|->" + any_of([*fv.BUILDER_RAW_METHODS, "raw"])
    + r")\s*\(|" + NO_NAME_BEFORE + r"(?:mysqli_query|pg_query)\s*\((?:\$\w+\s*,)?+)"
)
SHELL_CALL = r"(?i)" + _calls(fv.SHELL_FUNCTIONS)
UNSERIALIZE = r"(?i)" + _calls(["unserialize"])
INCLUDE = r"(?i)\b(?:include|require)(?:_once)?\b\s*\(?"
FILE_CALL = r"(?i)" + _calls(fv.FILE_FUNCTIONS)
#: an escaper anywhere in the statement's rest makes the output escaped
OUTPUT = r"(?i)\b(?:echo|print)\b\s*\(?(?![^;]*" + NO_NAME_BEFORE + any_of(fv.OUTPUT_ESCAPERS) + r"\s*\()"
ASSIGN_CALL = r"(?i)(?:::|->)" + any_of(fv.ASSIGNING_METHODS) + r"\s*\("
HASH_CALL = r"(?i)" + NO_NAME_BEFORE + "(" + "|".join(fv.WEAK_HASHES) + r")\s*\("
CREDENTIAL = r"[^)]*(?:\$|->|\[['\"])\w*" + any_of(fv.CREDENTIAL_HINTS)
SECRET = r"""(?i)(?:api_?key|token|secret|password|passwd|credential)\w*['"]?\]?\s*(?:=>|=)\s*['"]([^'"\s|]{12,})['"]"""
PLACEHOLDER = r"(?i)" + any_of(fv.SECRET_PLACEHOLDERS)


def code_only(line) -> Column:
    """The line without comments; string literals stay."""
    return F.regexp_replace(col(line), COMMENT, "$1")


def blank_strings(code) -> Column:
    return F.regexp_replace(col(code), STRING, '""')


@dataclass(frozen=True)
class Rule:
    """A detection rule: ``match`` gives the messages of all hits on a line, in order; one message (or null) counts as one hit."""

    id: str
    cwe: int | None
    severity: str
    description: str
    match: Callable[[Column], Column]


def every(code: Column, start: str, *kinds: tuple[str, str]) -> Column:
    """A message for each match of ``start`` that is followed by one of the kinds (pattern, message), the first that fits."""
    found = [F.regexp_extract_all(code, F.lit(start + f"(?=({pattern})|)(?=" + "|".join(p for p, _ in kinds) + ")"), F.lit(1)) for pattern, _ in kinds]
    out = F.transform(found[-1], lambda g: F.lit(kinds[-1][1]))
    for fits, (_, message) in reversed(list(zip(found[:-1], kinds[:-1]))):
        out = _prefer(fits, message, out)
    return out


def _prefer(fits: Column, message: str, others: Column) -> Column:
    return F.zip_with(fits, others, lambda g, other: F.when(g != "", F.lit(message)).otherwise(other))


def _sql(c):
    return every(c, SQL_CALL, (BUILT, MSG["sql_built"]), (DYNAMIC, MSG["sql_dynamic"]))


def _command(c):
    ticks = F.transform(F.regexp_extract_all(blank_strings(c), F.lit("`[^`]*`"), F.lit(0)), lambda x: F.lit(MSG["shell_backtick"]))
    return F.concat(ticks, every(c, SHELL_CALL, (DYNAMIC, MSG["shell_dynamic"])))


def _unserialize(c):
    return every(c, UNSERIALIZE, (r"\s*" + REQUEST, MSG["unserialize_request"]), (DYNAMIC, MSG["unserialize_dynamic"]))


def _path(c):
    return F.concat(
        every(c, INCLUDE, (DYNAMIC, MSG["include_dynamic"])),
        every(c, FILE_CALL, (BUILT, MSG["path_built"]), (DYNAMIC, MSG["path_dynamic"])),
    )


def _output(c):
    return every(c, OUTPUT, (DYNAMIC, MSG["output_unescaped"]))


def _mass(c):
    return every(c, ASSIGN_CALL, (r"[^;]*" + REQUEST, MSG["mass_assignment"]))


def _hash(c):
    names = F.regexp_extract_all(c, F.lit(HASH_CALL), F.lit(1))
    credential = F.regexp_extract_all(c, F.lit(HASH_CALL + f"(?=({CREDENTIAL})|)"), F.lit(2))
    return F.zip_with(names, credential, lambda n, g: F.concat(n, F.when(g != "", MSG["hash_credential"]).otherwise(MSG["hash_weak"])))


def _secret(c):
    values = F.regexp_extract_all(c, F.lit(SECRET), F.lit(1))
    return F.transform(F.filter(values, lambda v: ~v.rlike(PLACEHOLDER)), lambda v: F.lit(MSG["secret"]))


_MATCHERS = [_sql, _command, _unserialize, _path, _output, _mass, _hash, _secret]
RULES: dict[str, Rule] = {
    rule_id: Rule(rule_id, cwe, severity, words, match)
    for (rule_id, cwe, severity, words), match in zip(fv.DETECTION_RULES, _MATCHERS)
}


def register_rule(rule: Rule) -> None:
    """Add a rule of your own; it joins the same single pass."""
    RULES[rule.id] = rule


def scan_lines(lines: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Normalized findings of every rule on every line; ``occurrence`` numbers the calls of one rule on one line."""
    chosen = [RULES[r] for r in (rules or RULES)]
    code = lines.withColumn("_code", code_only("text"))
    kinds = {r.id: code.select(r.match(F.col("_code")).alias("m")).schema["m"].dataType.typeName() for r in chosen}
    hits = F.flatten(F.array(*[_hits(r, kinds[r.id] == "array") for r in chosen]))
    out = code.withColumn("_hit", F.explode(hits))
    keep = [c for c in lines.columns if c not in ("text", "line_no")]
    return out.select(
        *keep, F.col("_hit.rule_id").alias("rule_id"), F.col("_hit.cwe_id").alias("cwe_id"),
        F.greatest(F.lit(1), F.col("line_no")).alias("line_number"), F.col("_hit.severity").alias("severity"),
        F.col("_hit.message").alias("message"), F.trim("text").alias("snippet"), F.col("_hit.occurrence").alias("occurrence"),
    )


def _hits(rule: Rule, several: bool) -> Column:
    found = rule.match(F.col("_code"))
    messages = found if several else F.array_compact(F.array(found))
    return F.transform(messages, lambda m, i: F.struct(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.cwe).cast("int").alias("cwe_id"),
        F.lit(rule.severity).alias("severity"), m.alias("message"), (i + 1).alias("occurrence"),
    ))


def scan_summary(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Hits per file; files without a hit stay with zero."""
    files = lines.groupBy("file_path").agg(F.max("line_no").alias("lines"))
    hits = found.groupBy("file_path").agg(F.count(F.lit(1)).alias("findings"))
    return files.join(hits, "file_path", "left").fillna(0, subset=["findings"])


# ---- scopes -----------------------------------------------------------------
SCOPE_HEADER = r"\bfunction\b\s*&?\s*\w*\s*\(|\bfn\s*\("
DECISION = r"\b(?:if|elseif|for|foreach|while|case|catch)\b|&&|\|\||\?"
NOT_TERNARY = r"\?\?=?|\?->"
SANITIZER = (
    CALL_START + "(?i:" + "|".join(fv.SCOPE_SANITIZER_FUNCTIONS) + r")\s*\(|->" + any_of(fv.SCOPE_SANITIZER_METHODS) + r"\s*\("
)


#: a function's header, an arrow function's, a brace, the end of a declaration without a body
SCOPE_MARK = SCOPE_HEADER + r"|[{}]|^\s*\)\s*(?::[^;{}()]*)?;"
SCOPE_MARK_AFTER_HEADER = SCOPE_HEADER + r"|[{};]"
#: lines of a file in one block; a longer file is several tasks
SCOPE_BLOCK = 4096


def _scope_changes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Where the innermost scope changes: keys, line_no (from which it holds), _own (holds on that line alone), _at, _scope.

    Running sums of decisions and sanitizers are taken per block of lines; from
    there on only lines with a header or a brace move, and the last of each block.
    An opening brace of level n is closed by the next brace of level n, and after a
    scope's end its parent is the last scope one less deep: both are windows per
    level, in one pass over sorted marks, without a stack.
    """
    code, pos = F.col("_code"), ["line_no", "_i"]
    kind = lambda m: F.when(m.rlike("^(?i)function"), "function").when(m.rlike("^(?i)fn"), "fn").otherwise(F.substring(m, -1, 1))
    marks = F.when(code.rlike(SCOPE_HEADER), F.regexp_extract_all(code, F.lit(SCOPE_MARK_AFTER_HEADER), F.lit(0))).when(
        code.rlike("[{}]|" + r"^\s*\)"), F.regexp_extract_all(code, F.lit(SCOPE_MARK), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = lines.select(*keys, "line_no", blank_strings(code_only("text")).alias("_code")).select(
        *keys, "line_no", F.floor(F.col("line_no") / SCOPE_BLOCK).alias("_block"), F.transform(marks, kind).alias("_marks"),
        F.regexp_count(F.regexp_replace(code, NOT_TERNARY, ""), F.lit(DECISION)).cast("long").alias("_n"), code.rlike(SANITIZER).cast("long").alias("_s"))
    block = Window.partitionBy(*keys, "_block").orderBy("line_no")
    up = block.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "line_no", "_marks", "_n", "_s", F.sum("_n").over(up).alias("_pn"), F.sum("_s").over(up).alias("_ps"),
                       F.lead("line_no").over(block).isNull().alias("_last")).where("_last OR size(_marks) > 0")
    file = Window.partitionBy(*keys)
    above = file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    of_block = lambda c: F.when(F.col("_last"), F.col(c))
    rows = rows.select(*keys, "line_no", "_marks", "_n", "_s", *[(F.col(c) + F.coalesce(F.sum(of_block(c)).over(above), F.lit(0))).alias(c) for c in ("_pn", "_ps")],
                       F.max("line_no").over(file).alias("_eof"), *[F.sum(of_block(c)).over(file).alias("_t" + c[2:]) for c in ("_pn", "_ps")])
    here = file.orderBy(*pos)
    rows = rows.select("*", F.posexplode("_marks").alias("_i", "_mark")).drop("_marks")
    step = F.when(F.col("_mark") == "{", 1).when(F.col("_mark") == "}", -1).otherwise(0)
    rows = rows.withColumn("_head", F.lag(F.struct("_mark", *pos, "_pn", "_ps", "_n", "_s")).over(here)).withColumn(
        "_depth", F.sum(step).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_level", F.when(F.col("_mark") == "{", F.col("_depth")).when(F.col("_mark") == "}", F.col("_depth") + 1))
    rows = rows.withColumn("_close", F.lead(F.struct(*pos, "_pn", "_ps")).over(Window.partitionBy(*keys, "_level").orderBy(*pos)))

    def scope(start, n, s):
        return F.struct(start.cast("long").alias("start"), (n + 1).cast("int").alias("complexity"), (s > 0).cast("int").alias("sanitizer"))

    def change(line, i, deeper, what):
        return F.struct(line.cast("long").alias("_line"), i.alias("_i"), F.lit(deeper).alias("_deeper"), what.alias("_new"))

    c, h, e = F.col, F.col("_head"), F.col("_close")
    body = (c("_mark") == "{") & (h["_mark"] == "function")
    bare = (c("_mark") == ";") & (h["_mark"] == "function")
    arrow = c("_mark") == "fn"
    nothing = F.lit(None).cast("struct<start:bigint,complexity:int,sanitizer:int>")
    whole = scope(h["line_no"], F.coalesce(F.when(bare, c("_pn")), e["_pn"], c("_tn")) - h["_pn"] + h["_n"], F.coalesce(F.when(bare, c("_ps")), e["_ps"], c("_ts")) - h["_ps"] + h["_s"])
    found = F.array_compact(F.array(
        F.when(body | bare, change(h["line_no"], h["_i"], 1, whole)),
        F.when(body & e.isNotNull(), change(e["line_no"], e["_i"], -1, nothing)),
        F.when(bare, change(c("line_no"), c("_i"), -1, nothing)),
        F.when(arrow, change(c("line_no"), c("_i"), 0, scope(c("line_no"), c("_n"), c("_s")))),
    ))
    rows = rows.select(*keys, "_eof", F.explode(found).alias("x")).select(*keys, "_eof", "x.*")
    order = ["_line", "_i"]
    here = file.orderBy(*order)
    rows = rows.withColumn("_deep", F.sum("_deeper").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy(*keys, "_deep").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_scope", F.last(F.when(F.col("_deeper") == 1, F.col("_new")), ignorenulls=True).over(level))
    # an end holds from the line after it; a change is repeated at the start of each later block it holds in
    starts = F.col("_line") + F.when(F.col("_deeper") == -1, 1).otherwise(0)
    rows = rows.withColumn("_from", starts).withColumn("_to", F.coalesce(F.lead("_from").over(here), F.col("_eof")))
    number = lambda x: F.floor(F.col(x) / SCOPE_BLOCK)
    later = F.when(number("_to") > number("_from"), F.transform(F.sequence(number("_from") + 1, number("_to")), lambda b: b * SCOPE_BLOCK))
    at = F.explode(F.concat(F.array("_from"), F.coalesce(later, F.array().cast("array<bigint>"))))
    own = F.when((F.col("_deeper") == 0), F.col("_new"))
    return rows.select(*keys, at.alias("line_no"), "_line", "_i", own.alias("_own"), F.struct(*order, F.col("_scope")).alias("_state"))


def scope_features(lines: DataFrame, file_keys=("file_path",)) -> DataFrame:
    """Per line: enclosing function start, depth in it, its complexity, and whether it sanitises.

    A scope runs from its header's line to the line of its closing brace (to the
    file's end where that is missing); a declaration without a body ends at its
    semicolon, an arrow function with its line.  A line belongs to the scope that
    begins last of those it lies in; complexity and sanitizers are the whole scope's,
    closures in it included.  Files may be of any length: lines meet the changes of
    scope of their own block of lines.
    """
    keys = list(file_keys)
    names = [c for c in lines.columns if c not in (*keys, "line_no")]
    kind = lines.schema["line_no"].dataType
    changes = _scope_changes(lines, keys).withColumn("_is_line", F.lit(False))
    rows = lines.select(*keys, F.col("line_no").cast("long").alias("line_no"), *names, F.lit(True).alias("_is_line"))
    rows = rows.unionByName(changes, allowMissingColumns=True).withColumn("_block", F.floor(F.col("line_no") / SCOPE_BLOCK))
    up = Window.partitionBy(*keys, "_block").orderBy("line_no", "_is_line").rowsBetween(Window.unboundedPreceding, 0)
    single = F.when(F.col("_own").isNotNull() & (F.col("_line") == F.col("line_no")), F.struct("_line", "_i", F.col("_own")))
    rows = rows.withColumn("_near", F.max("_state").over(up)).withColumn("_single", F.max(single).over(up)).where("_is_line")
    alone = (F.col("_single._line") == F.col("line_no")) & F.coalesce(
        (F.col("_near._scope.start") < F.col("line_no")) | (F.col("_near._line") < F.col("line_no")) | (F.col("_single._i") >= F.col("_near._i")), F.lit(True))
    rows = rows.withColumn("_in", F.when(alone, F.col("_single._own")).otherwise(F.col("_near._scope")))
    inside, line = F.col("_in").isNotNull(), F.col("line_no").cast(kind)
    return rows.select(
        *[line.alias(c) if c == "line_no" else F.col(c) for c in lines.columns],
        F.col("_in.start").cast(kind).alias("scope_start"),
        F.when(inside, F.col("line_no") - F.col("_in.start")).otherwise(0).cast("int").alias("line_depth_in_function"),
        F.when(inside, F.col("_in.complexity")).otherwise(1).cast("int").alias("cyclomatic_complexity"),
        F.when(inside, F.col("_in.sanitizer")).otherwise(0).cast("int").alias("has_sanitizer_in_ast"),
    )


# ---- sinks ------------------------------------------------------------------
FUNCTION_SINKS = {
    "command_execution": fv.SINK_CALLS["command_execution"],
    "sql_query": ["mysql_query", "pg_query", "sqlite_query", "mysqli_query", "mysqli_real_query", "mysqli_multi_query"],
    "path_access": fv.SINK_CALLS["path_access"],
    "deserialization": fv.SINK_CALLS["deserialization"],
    "html_output": fv.SINK_CALLS["html_output"],
}
METHOD_SINKS = {"sql_query": ["query", "selectraw", "select", "statement", "unprepared", "prepare"]}
#: a string, a shell string, a name, a variable, an operator that matters, or any character, each with the white space after it
TOKEN = (
    rf"(?s)(?:{STRING}|`(?:[^`\\]|\\.)*`|\$\w+|[A-Za-z_\\][\w\\]*|[0-9]+|\?->|->|::|=>|[=!<>]=+|[-+*/.%&|^?]=|.)\s*"
)
#: methods that are sinks only where the rule says so
HINTED_METHODS = {
    "mass_assignment": fv.SINK_CALLS["mass_assignment"],
    "sql_query": ["exec", "execute", "bindparam", "bindvalue"],
}
STATEMENT_SINKS = {"echo": ("html_output", "echo"), "print": ("html_output", "print"), **{
    w: ("path_access", "include") for w in ("include", "include_once", "require", "require_once")}}
LAST_ARGUMENT = ["mysql_query", "pg_query", "sqlite_query"]
SECOND_ARGUMENT = ["mysqli_query", "mysqli_real_query", "mysqli_multi_query", "bindparam", "bindvalue"]
FIRST_TWO = ["copy", "rename"]
ALL_ARGUMENTS = ["printf", "vprintf", "echo", "execute"]
MAYBE_SINK = r"(?i)`|->|::|\b" + any_of([*STATEMENT_SINKS, *(n for names in FUNCTION_SINKS.values() for n in names)]) + r"\b"


def tokens(code) -> Column:
    return F.regexp_extract_all(col(code), F.lit(TOKEN), F.lit(0))


def split_arguments(rest: Column) -> Column:
    """The arguments at the head of ``rest``, tokens after an opening bracket or a statement's word.

    Depth runs over the tokens; commas at depth zero cut; the closing bracket, a semicolon or the end finishes.
    """
    def step(s, t):
        word, last = F.trim(F.regexp_replace(t, r"\s+$", "")), F.element_at(s["args"], -1)
        added = F.concat(F.slice(s["args"], F.lit(1), F.size(s["args"]) - 1), F.array(F.concat(last, t)))
        deeper, higher, flat = word.isin("(", "[", "{"), word.isin(")", "]", "}"), s["depth"] == 0
        end = s["done"] | (flat & (higher | (word == ";")))
        return F.struct(
            F.when(end, s["depth"]).when(deeper, s["depth"] + 1).when(higher, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            end.alias("done"),
            F.when(end, s["args"]).when(flat & (word == ","), F.concat(s["args"], F.array(F.lit("")))).otherwise(added).alias("args"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.array(F.lit("")).alias("args"))
    args = F.aggregate(rest, start, step, lambda s: s["args"])
    return F.filter(F.transform(args, lambda a: F.regexp_replace(a, r"^\s+|\s+$", "")), lambda a: a != "")


def _named(word: Column, names) -> Column:
    return F.lower(word).isin(list(names))


def sinks_in(code, hint=None) -> Column:
    """All sinks of a statement in order: array of (kind, name, arguments that are traced, bound, nth token, lines before).

    With a hint only sinks of that kind, and the methods that only it makes sinks.
    """
    h = F.lit(None).cast("string") if hint is None else col(hint)
    full = let(tokens(code), lambda raw: let(F.transform(raw, lambda t: F.regexp_replace(t, r"\s+$", "")), lambda words: _sinks(raw, words, h)))
    return F.when(col(code).rlike(MAYBE_SINK), full).otherwise(F.array().cast(
        "array<struct<kind:string,name:string,arguments:array<string>,bound:boolean,nth:int,down:int>>"))


def _sinks(raw: Column, every_token: Column, h: Column) -> Column:
    """The sinks among the tokens of a statement, with and without the white space after them."""
    def describe(t, i):
        return F.when(t.rlike(r"^[A-Za-z_\\`]"), named(t, i))

    def named(t, i):
        before = F.when(i > 0, F.get(every_token, i - 1))
        after = F.get(every_token, i + 1)
        call, method = after == "(", before.isin("->", "?->", "::")
        word = F.lower(F.regexp_replace(t, r"^\\", ""))
        kind = F.when(F.substring(t, 1, 1) == "`", "command_execution")
        for w, (k, _) in STATEMENT_SINKS.items():
            kind = kind.when((word == w) & F.coalesce(~method, F.lit(True)), k)
        plain = F.coalesce(~before.isin("->", "?->", "::", "function", "new"), F.lit(True))
        for k, names in FUNCTION_SINKS.items():
            kind = kind.when(call & plain & _named(word, names), k)
        kind = kind.when(call & method & _named(word, METHOD_SINKS["sql_query"]), "sql_query")
        for k, names in HINTED_METHODS.items():
            kind = kind.when((h == k) & call & method & _named(word, names), k)
        return F.when(kind.isNotNull() & (h.isNull() | (h == kind)), F.struct(kind.alias("kind"), word.alias("word"), i.alias("nth")))

    def traced(x):
        tick = F.substring(x["word"], 1, 1) == "`"
        statement = _named(x["word"], STATEMENT_SINKS)
        args = split_arguments(F.slice(raw, x["nth"] + F.when(statement, 2).otherwise(3), F.greatest(F.lit(0), F.size(raw))))
        one, w = F.slice(args, 1, 1), x["word"]
        chosen = (
            F.when(tick, F.regexp_extract_all(F.get(raw, x["nth"]), F.lit(r"\$\w+"), F.lit(0)))
            .when(w.isin(*LAST_ARGUMENT), F.slice(args, F.greatest(F.size(args), F.lit(1)), 1)).when(w.isin(*SECOND_ARGUMENT), F.slice(args, 2, 1))
            .when(w.isin(*FIRST_TWO), F.slice(args, 1, 2)).when(w.isin(*ALL_ARGUMENTS), args).otherwise(one)
        )
        name = F.when(tick, "backtick")
        for word, (_, n) in STATEMENT_SINKS.items():
            name = name.when(w == word, n)
        before = F.array_join(F.slice(raw, F.lit(1), x["nth"]), "")
        return F.struct(
            x["kind"].alias("kind"), name.otherwise(w).alias("name"), chosen.alias("arguments"), w.isin("execute", "bindparam", "bindvalue").alias("bound"),
            x["nth"].alias("nth"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).alias("down"),
        )

    return F.transform(F.array_compact(F.transform(every_token, describe)), traced)


#: lines of the longest statement; brackets left open beyond are a broken file, whose lines then stand for themselves
STATEMENT_LINES = 256


def statements(lines: DataFrame, keys=("file_path",), extra=()) -> DataFrame:
    """Code joined over open brackets: keys, line_no (of the first line), _code, and ``extra`` columns of the first line.

    The depth before a line is a prefix sum over the few lines of its file that
    leave a bracket open or close one, and only they are sorted.  Lines of one
    line's statements, nearly all, stay where they are; the others are joined.
    """
    keys = list(keys)
    rows = lines.select(*keys, "line_no", code_only("text").alias("_code"), *extra)
    bare = F.regexp_replace(blank_strings("_code"), "`[^`]*`", "")
    net = F.length(F.regexp_replace(bare, r"[^(\[]", "")) - F.length(F.regexp_replace(bare, r"[^)\]]", ""))
    uneven = rows.where(F.col("_code").rlike(r"[()\[\]]")).select(*keys, "line_no", net.alias("_net")).where("_net <> 0")
    up = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    deep = uneven.withColumn("_after", F.sum("_net").over(up))
    # from below: the nearest line further down that closes the last bracket
    below = Window.partitionBy(*keys).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    deep = deep.withColumn("_end", F.last(F.when(F.col("_after") <= 0, F.col("line_no")), ignorenulls=True).over(below))
    opened = deep.where((F.col("_after") > 0) & (F.col("_after") - F.col("_net") <= 0))
    last = F.col("line_no") + F.lit(STATEMENT_LINES - 1)
    spans = opened.select(*keys, F.col("line_no").alias("_of"), F.explode(F.sequence(F.col("line_no"), F.least(F.coalesce("_end", last), last))).alias("line_no"))
    placed = rows.join(spans, [*keys, "line_no"], "left")
    single = placed.where("_of IS NULL").select(*keys, F.col("line_no").cast("int").alias("line_no"), "_code", *extra)
    joined = placed.where("_of IS NOT NULL").groupBy(*keys, "_of").agg(F.array_sort(F.collect_list(F.struct("line_no", "_code", *extra))).alias("_lines"))
    return single.unionByName(joined.select(
        *keys, F.col("_of").cast("int").alias("line_no"), F.array_join(F.transform("_lines", lambda x: x["_code"]), "\n").alias("_code"),
        *[F.col("_lines")[0][c].alias(c) for c in extra],
    ))


def arguments_shape(arguments) -> Column:
    """Shape of a sink's traced arguments: none, multiple, or that of the one."""
    a = col(arguments)
    return F.when(F.size(a) == 0, "none").when(F.size(a) > 1, "multiple").otherwise(argument_shape(F.get(a, 0)))


def argument_shape(argument) -> Column:
    a = F.trim(col(argument))
    bare = blank_strings(a)
    return (
        F.when(a == "", "none")
        .when(a.rlike(r'^"[^"]*\$[^"]*"$'), "interpolation")
        .when(a.rlike(r"""^(?:"[^"]*"|'[^']*'|[0-9.]+|[A-Z_]+|\w+::[A-Z_]+|true|false|null)$"""), "literal")
        .when(a.rlike(r"^\$\w+$"), "variable")
        .when(bare.rlike(r"\?[^?>-].*:"), "conditional")
        .when(bare.rlike(r'(?:""|\$[\w>\[\]-]+|\))\s*\.\s*(?:""|\$|\w)'), "concatenation")
        .when(a.rlike(r"^[A-Za-z_]\w*\s*\("), "function_call")
        .when(a.rlike(r"^(?:\$\w+|\w+)(?:\?->|->|::)\w+\s*\("), "method_call")
        .when(a.rlike(r"^\["), "array")
        .when(a.rlike(r"^\$\w+\["), "array_access")
        .when(a.rlike(r"^\$\w+(?:\?->|->|::\$)\w+"), "property_access")
        .otherwise("expression")
    )


def hinted_kind(cwe, rule_id) -> Column:
    return scoring.sink_hint(cwe, rule_id)
