"""From a sink back to request input through the assignments above it.

Sinks and assignments are tokens of statements, so each has a position.  One
window per variable of a scope finds, for every use, the last assignment strictly
before it; that makes a graph whose edges only go back, of which the states
(place, assignment) reached are the answer.  Every round joins the states with
themselves and keeps what is new, so a chain of n assignments takes log n rounds, and
there are at most as many states as pairs of assignments and sinks of a scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions.common import any_of, col, let
from winnow.operators import detect
from winnow.session import cut_lineage

VARIABLE = r"\$([A-Za-z]\w*)"
SINGLE_QUOTED = r"'(?:[^'\\]|\\.)*'"
SUPERGLOBAL = r"\$(_(?:" + "|".join(n[1:] for n in fv.REQUEST_SUPERGLOBALS) + r"))\b"
REQUEST_CALL = r"(?i)(?:\$(?:request|req)|\brequest\(\))\??->(" + "|".join(fv.REQUEST_METHOD_CONTEXTS) + r")\s*\(|\b(?:Request|Input)::(" + "|".join(
    m for m in fv.REQUEST_METHOD_CONTEXTS if m not in ("server", "validated")) + r")\s*\("
#: the helper by itself; with a method after it, the method says what is read
REQUEST_HELPER = r"(?i)(?<![\w>:$])(request)\s*\((?!\s*\)\s*\??->)"
RAW_BODY = r"""(?i)(?<![\w>:$])file_get_contents\s*\(\s*['"](php://input)['"]"""
NOT_FOLLOWED = ["this", "request", "req"]
#: tokens of a statement fit into this many positions
PLACES = 1 << 24


def _readable(expr: Column) -> Column:
    """The expression without what single quotes keep from being code."""
    return F.regexp_replace(expr, SINGLE_QUOTED, "''")


def expression_vars(expr) -> Column:
    found = F.regexp_extract_all(_readable(col(expr)), F.lit(VARIABLE), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: ~v.isin(NOT_FOLLOWED))))


def expression_contexts(expr) -> Column:
    """Kinds of request input an expression reads directly."""
    e = _readable(col(expr))
    names = {**fv.REQUEST_SUPERGLOBALS, **fv.REQUEST_METHOD_CONTEXTS}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    read = F.concat(
        F.regexp_extract_all(e, F.lit(SUPERGLOBAL), F.lit(1)),
        F.transform(F.regexp_extract_all(e, F.lit(REQUEST_CALL), F.lit(1)), F.lower),
        F.transform(F.regexp_extract_all(e, F.lit(REQUEST_CALL), F.lit(2)), F.lower),
    )
    known = F.transform(F.filter(read, lambda n: n != ""), lambda n: F.element_at(table, n))
    helper = F.transform(F.regexp_extract_all(e, F.lit(REQUEST_HELPER), F.lit(1)), lambda x: F.lit("request"))
    raw = F.transform(F.regexp_extract_all(col(expr), F.lit(RAW_BODY), F.lit(1)), lambda x: F.lit("raw_body"))
    return F.array_distinct(F.concat(known, helper, raw))


def sanitised(expr, kind) -> Column:
    """Does the expression call a sanitizer that fits the sink?"""
    out = F.lit(False)
    for k, names in fv.PATH_SANITIZERS.items():
        call = r"(?i)(?:^|[^\w$])" + any_of(names) + r"\s*\("
        out = F.when(col(kind) == k, col(expr).rlike(call)).otherwise(out)
    return out


def cleaned_kinds(expr) -> Column:
    """The sink kinds that a sanitizer in the expression fits."""
    return F.array_compact(F.array(*[F.when(sanitised(expr, F.lit(k)), F.lit(k)) for k in fv.PATH_SANITIZERS]))


def assignments_in(code) -> Column:
    """All assignments of a statement: array of (var, nth token, right side)."""
    full = let(detect.tokens(code), _assignments)
    return F.when(col(code).rlike(r"\$\w+\s*=[^=>]"), full).otherwise(F.array().cast("array<struct<var:string,nth:int,rhs:string>>"))


def _assignments(raw: Column) -> Column:
    def one(t, i):
        there = t.startswith("$") & F.get(raw, i + 1).rlike(r"^=\s*$")
        return F.when(there, F.struct(F.regexp_extract(t, r"^\$(\w*)", 1).alias("var"), i.alias("nth")))

    return F.transform(F.array_compact(F.transform(raw, one)), lambda x: F.struct(
        x["var"].alias("var"), x["nth"].alias("nth"),
        F.coalesce(F.get(detect.split_arguments(F.slice(raw, x["nth"] + 3, F.greatest(F.lit(0), F.size(raw)))), 0), F.lit("")).alias("rhs")))


def _position(nth) -> Column:
    return F.col("line_no").cast("long") * PLACES + nth


def sinks(scoped: DataFrame, keys) -> DataFrame:
    """One row per sink of the statements (``_code``), of the hinted kind where a ``hint`` column exists; sink_no numbers those of a line."""
    hint = "hint" if "hint" in scoped.columns else None
    rows = scoped.select(*keys, "scope", "line_no", F.explode(detect.sinks_in("_code", hint)).alias("s"))
    rows = rows.select(*keys, "scope", (F.col("line_no") + F.col("s.down")).alias("line_no"), _position(F.col("s.nth")).alias("pos"),
                       "s.kind", "s.name", "s.arguments", "s.bound")
    nth = F.row_number().over(Window.partitionBy(*keys, "line_no").orderBy("pos"))
    return rows.select(*keys, "scope", "line_no", nth.alias("sink_no"), "pos", F.col("kind").alias("sink_kind"), F.col("name").alias("sink_name"), "arguments", "bound")


def scoped_statements(lines: DataFrame, keys) -> DataFrame:
    """Statements with the scope of their first line, and ``hint`` where the lines have one."""
    extra = ["hint"] if "hint" in lines.columns else []
    scopes = detect.scope_features(lines, keys).select(*keys, F.col("line_no").alias("line_no"), F.coalesce("scope_start", F.lit(0)).alias("scope"))
    return detect.statements(lines, keys, extra).join(scopes, [*keys, "line_no"])


def trace(lines: DataFrame, keys=("file_path",)) -> DataFrame:
    """Per sink (line_no, sink_no): reaches_request_input, taint_steps, sanitised_before_sink, attacker context, argument shape.

    ``lines`` has the keys, line_no, text and optionally hint.  ``taint_steps``
    counts the assignments reached.  A variable without an assignment strictly
    before its use is unknown, so a loop of assignments ends there too.
    """
    keys = list(keys)
    here = [*keys, "scope"]
    code = cut_lineage(scoped_statements(lines, keys))
    found = cut_lineage(sinks(code, keys))
    defs = code.select(*here, "line_no", F.explode(assignments_in("_code")).alias("a"))
    defs = defs.select(*here, _position(F.col("a.nth")).alias("pos"), F.col("a.var").alias("var"), F.col("a.rhs").alias("expr"))
    whole = F.array_join("arguments", " , ")
    users = defs.select(*here, "pos", "expr").unionByName(found.select(*here, "pos", whole.alias("expr")))
    uses = users.select(*here, "pos", F.explode(expression_vars("expr")).alias("var"))
    # a use comes before an assignment at its own place, which is then no answer to it
    events = uses.select(*here, "var", "pos", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at")).unionByName(
        defs.select(*here, "var", "pos", F.lit(1).alias("kind"), F.col("pos").alias("at")))
    order = Window.partitionBy(*here, "var").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    answered = events.withColumn("to", F.last("at", ignorenulls=True).over(order)).where("kind = 0")
    answered = cut_lineage(answered.select(*here, "pos", "to"))
    unknown = answered.where("to IS NULL").select(*here, "pos", F.lit(True).alias("open")).distinct()
    facts = users.select(*here, "pos", expression_contexts("expr").alias("contexts"), cleaned_kinds("expr").alias("cleans"))
    nodes = facts.join(unknown, [*here, "pos"], "left")
    reach = cut_lineage(answered.where("to IS NOT NULL").select(*here, "pos", "to").distinct())
    size, before = reach.count(), -1
    while size > before:
        further = reach.select(*here, F.col("pos").alias("to"), F.col("to").alias("_next"))
        step = reach.join(further, [*here, "to"]).select(*here, "pos", F.col("_next").alias("to"))
        reach = cut_lineage(reach.unionByName(step).distinct())
        size, before = reach.count(), size
    ends = found.select(*here, F.col("pos").alias("sink"), "sink_kind")
    seen = ends.select(*here, "sink", "sink_kind", F.col("sink").alias("pos")).unionByName(
        ends.join(reach.withColumnRenamed("pos", "sink"), [*here, "sink"]).select(*here, "sink", "sink_kind", F.col("to").alias("pos")))
    # a sink has few facts: the assignments it reaches
    per_sink = seen.join(nodes, [*here, "pos"]).groupBy(*here, F.col("sink").alias("pos")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("contexts")))).alias("contexts"),
        F.bool_or(F.array_contains("cleans", F.col("sink_kind"))).alias("_clean"),
        F.bool_or(F.coalesce("open", F.lit(False))).alias("_open"),
        (F.count(F.lit(1)) - 1).cast("int").alias("taint_steps"),
    )
    reaches = F.size("contexts") > 0
    return found.join(per_sink, [*here, "pos"]).select(
        *keys, "line_no", "sink_no", "sink_kind", "sink_name", detect.arguments_shape("arguments").alias("argument_shape"),
        reaches.cast("int").alias("reaches_request_input"), "taint_steps",
        (F.col("_clean") | F.col("bound")).cast("int").alias("sanitised_before_sink"),
        F.when(F.size("contexts") > 1, "mixed").when(reaches, F.element_at("contexts", 1))
        .when(F.col("_open"), "unknown").otherwise("none").alias("attacker_reachable_context"),
    )
