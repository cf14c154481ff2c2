"""Redaction, bounded texts, explanations, log lines and structured answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.functions.common import col, let, text, trim_all

# Fixed values: (names, marker).  The opening of the assignment or header stays,
# the value becomes a typed marker, whatever its length, quoted or not.
SECRET_KINDS = [("api[_-]?key|token", "API_KEY_OR_TOKEN"), ("password|passwd", "PASSWORD"), ("secret|credential", "SECRET")]
SECRET_PATTERNS = [
    (r"(?i)(authorization[\"']?\s*[:=]\s*[\"']?bearer\s+)[A-Za-z0-9._~+/-]{8,}=*", "$1[REDACTED:BEARER_TOKEN]"),
]
for _names, _marker in SECRET_KINDS:
    _opening = rf"(?i)((?:{_names})[\w-]*[\"']?[ \t]*(?:=>|=|:)[ \t]*"
    SECRET_PATTERNS += [
        (_opening + r"\\?[\"'])[^\"'\\\[\n][^\"'\\\n]*", f"$1[REDACTED:{_marker}]"),
        (_opening + r")[^\s\"'\\\[$(){},;<>|=:][^\s\"'\\(){},;<>|]*", f"$1[REDACTED:{_marker}]"),
    ]
#: a name that every match begins with
SECRET_NAMES = "(?i)authorization|" + "|".join(_names for _names, _ in SECRET_KINDS)


def redact(value) -> Column:
    """Replace secrets in a text; running it twice changes nothing more."""
    out = col(value)
    for pattern, marker in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, marker)
    return out


def redact_few(value) -> Column:
    """``redact`` for many texts of which few hold a secret: one look at each tells whether its patterns can match."""
    return let(col(value), lambda v: F.when(v.rlike(SECRET_NAMES), redact(v)).otherwise(v))


def redact_list(values) -> Column:
    return F.transform(col(values), redact)


def redact_struct(value, fields: dict) -> Column:
    """Redact the text fields of a typed struct; ``fields`` maps name to text/list/keep."""
    kinds = {"text": redact, "list": redact_list, "keep": lambda c: c}
    v = col(value)
    return F.struct(*[kinds[kind](v.getField(name)).alias(name) for name, kind in fields.items()])


def limited(value, size: int, marker: str = "...") -> Column:
    """Whole text when it fits, else its first characters and a marker."""
    v = col(value)
    return F.when(F.length(v) <= size, v).otherwise(
        F.concat(F.rtrim(F.substring(v, 1, size)), F.lit(marker))
    )


def csv_safe(value) -> Column:
    """Keep a spreadsheet from reading a text cell as a formula."""
    v = col(value)
    return F.when(v.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)


def advisory_summary(assessments) -> Column:
    """reviewer:class(confidence) joined by ' | '."""
    return F.array_join(
        F.transform(
            col(assessments),
            lambda a: F.concat(
                a["reviewer"], F.lit(":"), a["classification"], F.lit("("),
                F.when(a["confidence"].isNull(), "n/a").otherwise(F.format_string("%.4f", a["confidence"])), F.lit(")"),
            ),
        ),
        " | ",
    )


def outcome_reason(reviewer, predicted, outcome) -> Column:
    """One sentence on how a reviewer's verdict relates to the model's."""
    name = F.upper(col(reviewer))
    o = col(outcome)

    def say(fmt: str) -> Column:
        return F.format_string(fmt, name)

    return (
        F.when(col(predicted).isNull(), say("No model prediction yet, so the verdict of %s cannot be scored."))
        .when(o == "true_positive", say("Model predicted a vulnerability; %s found support for it."))
        .when(o == "false_positive", say("Model predicted a vulnerability; %s judged it a false alarm."))
        .when(o == "true_negative", say("Model predicted a false alarm; %s agreed."))
        .when(o == "false_negative", say("Model predicted a false alarm; %s found a vulnerability."))
        .otherwise(say("%s needs more evidence to settle the model's prediction."))
    )


def outcome_short(outcome) -> Column:
    o = col(outcome)
    return (
        F.when(o == "true_positive", "TP").when(o == "false_positive", "FP")
        .when(o == "true_negative", "TN").when(o == "false_negative", "FN").otherwise("?")
    )


def comment_body(message, rule_id, cwe, severity, probability) -> Column:
    return F.concat(
        F.format_string("**Likely true positive (%d%% confidence)**\n\n", F.round(col(probability) * 100).cast("int")),
        text(message),
        F.lit("\n\nRule: `"), text(rule_id), F.lit("` | CWE-"), text(cwe), F.lit(" | Severity: "), text(severity),
    )


def source_window_line(number, line) -> Column:
    return F.format_string("%6d | %s", col(number), F.rtrim(line))


# ---- structured answers -----------------------------------------------------
ANSWER_SCHEMA = (
    "classification string, confidence string, attacker_controlled boolean, sink_reachable boolean, "
    "mitigation_detected boolean, missing_evidence array<string>, supporting_evidence array<string>, "
    "reasoning_summary string"
)


def parse_answer(content) -> Column:
    """Strict JSON first, then once more tolerating raw control characters; else null."""
    c = col(content)
    strict = F.when(F.try_parse_json(c).isNotNull() & (F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")),
                    F.from_json(c, ANSWER_SCHEMA))
    body = F.regexp_replace(c, r"[\x00-\x1F]", " ")
    loose_ok = F.try_parse_json(body).isNotNull() & F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    loose = F.when(loose_ok, F.from_json(c, ANSWER_SCHEMA, {"allowUnquotedControlChars": "true"}))
    return F.coalesce(strict, loose)


# ---- application log --------------------------------------------------------
LOG_PATTERN = r"^\[([^\]]+)\]\s+\w+\.(\w+):\s+(.*?)(?:\s+\{(.*)\})?$"


def parse_log_line(line) -> Column:
    """time, level, message, scan id and a readable detail of one log line."""
    ln = col(line)
    tail = F.regexp_extract(ln, LOG_PATTERN, 4)
    ctx = F.from_json(
        F.when(tail != "", F.concat(F.lit("{"), tail, F.lit("}"))),
        "scan_id bigint, error string, reviewer string, duration_seconds string, prompt_tokens string, "
        "output_tokens string, processed string, total string",
    )
    parts = F.array_compact(
        F.array(
            F.upper(ctx["reviewer"]),
            F.concat(ctx["duration_seconds"], F.lit("s")),
            F.concat(ctx["prompt_tokens"], F.lit(" input tokens")),
            F.concat(ctx["output_tokens"], F.lit(" output tokens")),
            F.concat(ctx["processed"], F.lit("/"), ctx["total"], F.lit(" processed")),
        )
    )
    detail = F.coalesce(
        F.nullif(trim_all(ctx["error"]), F.lit("")), F.nullif(F.array_join(parts, " | "), F.lit(""))
    )
    date = F.regexp_extract(ln, LOG_PATTERN, 1)
    return F.struct(
        F.nullif(date, F.lit("")).alias("date"),
        F.nullif(F.substring(date, 12, 8), F.lit("")).alias("time"),
        F.coalesce(F.nullif(F.lower(F.regexp_extract(ln, LOG_PATTERN, 2)), F.lit("")), F.lit("info")).alias("level"),
        F.coalesce(F.nullif(F.regexp_extract(ln, LOG_PATTERN, 3), F.lit("")), F.lit("log entry")).alias("message"),
        ctx["scan_id"].alias("scan_id"),
        detail.alias("detail"),
    )
