"""Joins between findings and everything around them.

No size is assumed: only the fixed guidance table is broadcast by hint, all
other sides are left to the optimizer and to runtime statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import fixes, scoring, texts
from winnow.functions.common import source_keys
from winnow.operators import latest
from winnow.settings import DEFAULTS, Settings


def with_rule(f: DataFrame, r: DataFrame) -> DataFrame:
    """Rule columns by the scanner's own rule id; findings of unknown rules stay."""
    r = r.select(F.col("external_id"), *[F.col(c).alias(f"rule_{c}") for c in r.columns if c != "external_id"])
    return f.join(r, f["rule_id"] == r["external_id"], "left").drop("external_id")


def with_scan(f: DataFrame, s: DataFrame, p: DataFrame | None = None) -> DataFrame:
    sc = s.select(F.col("id").alias("scan_id"), "project_id", F.col("source").alias("scanner_source"), "commit_sha", "branch")
    if p is None:
        return f.join(sc, "scan_id")
    # scans meet their projects first, so the findings, which are many and wide, move once
    sc = sc.join(p.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "source_path"), "project_id")
    own = [c for c in f.columns if c != "scan_id"]
    return f.join(sc, "scan_id").select("project_id", "scan_id", *own, "scanner_source", "commit_sha", "branch", "project_name", "source_path")


def with_feedback(f: DataFrame, fb: DataFrame) -> DataFrame:
    cols = [c for c in ("corrected_label", "source", "training_eligible", "notes") if c in fb.columns]
    side = fb.select(F.col("finding_id").alias("id"), *[F.col(c).alias(f"feedback_{c}") for c in cols])
    return f.join(side, "id", "left")


def having(f: DataFrame, ctx: DataFrame | None = None, adjudicated: DataFrame | None = None) -> DataFrame:
    """Keep findings that have a context and/or an adjudication."""
    out = f
    if ctx is not None:
        out = out.join(ctx.select(F.col("finding_id").alias("id")), "id", "left_semi")
    if adjudicated is not None:
        a = adjudicated.filter(F.col("reviewer") == fv.ADJUDICATOR)
        out = out.join(a.select(F.col("finding_id").alias("id")), "id", "left_semi")
    return out


def unreviewed(f: DataFrame, ctx: DataFrame, a: DataFrame) -> DataFrame:
    """Findings whose current evidence has no completed adjudication."""
    current = f.join(ctx.select(F.col("finding_id").alias("id"), "context_hash"), "id")
    done = a.filter((F.col("reviewer") == fv.ADJUDICATOR) & F.col("completed_at").isNotNull()).select(
        F.col("finding_id").alias("id"), "context_hash"
    )
    return current.join(done, ["id", "context_hash"], "left_anti")


def fresh(a: DataFrame, ctx: DataFrame) -> DataFrame:
    """Assessments made on the evidence the finding still has."""
    return a.join(ctx.select("finding_id", "context_hash"), ["finding_id", "context_hash"])


def author_level(f: DataFrame, blame: DataFrame, commits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    counts = commits.groupBy("author").agg(F.count(F.lit(1)).alias("commit_count"))
    keys = source_keys(f, blame)
    owners = blame.join(counts, "author", "left").select(
        *keys, F.col("line_no").alias("line_number"), "author", "commit_count"
    )
    out = f.join(owners, [*keys, "line_number"], "left")
    return out.withColumn(
        "developer_experience_lvl", scoring.author_level("commit_count", F.col("author").isNotNull(), s)
    )


def known_rules(r: DataFrame) -> DataFrame:
    """Rules as registered so far, with their rate."""
    return r.select(
        "external_id", "cwe_id", "description",
        (F.col("historical_fp_rate") if "historical_fp_rate" in r.columns else F.lit(0.0)).alias("historical_fp_rate"),
        F.lit(False).alias("is_new"),
    )


def register_rules(f: DataFrame, r: DataFrame) -> DataFrame:
    """Known rules plus one row per rule seen for the first time, rate zero."""
    seen = f.groupBy(F.col("rule_id").alias("external_id")).agg(F.min_by("cwe_id", "id").alias("cwe_id"))
    new = seen.join(r.select("external_id"), "external_id", "left_anti").select(
        "external_id", "cwe_id", F.lit(None).cast("string").alias("description"),
        F.lit(0.0).alias("historical_fp_rate"), F.lit(True).alias("is_new"),
    )
    return known_rules(r).unionByName(new)


def with_guidance(f: DataFrame) -> DataFrame:
    """Advice for the weakness class, or the general advice."""
    g = F.broadcast(fixes.guidance_table(f.sparkSession))  # eight fixed rows
    out = f.join(g, f["cwe_id"] == g["guidance_cwe"], "left").drop("guidance_cwe")
    for name, words in zip(fixes.GUIDANCE_COLUMNS, fixes.GUIDANCE_FALLBACK):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(words)))
    return out


def line_window(f: DataFrame, lines: DataFrame, radius: int, keys=None, together: bool = False, shown=None) -> DataFrame:
    """Lines within ``radius`` of the flagged line, as a sorted array per finding.

    The range join runs as an equi join on blocks of lines: a line goes to the one
    or two blocks whose findings may show it, so a finding meets one block, which
    holds its whole window, and windows are cut where they are joined instead of
    being moved line by line.  A hot file spreads over its blocks.  Without ``keys``
    a file is its path, in its project and commit where both sides know them.
    ``together`` says that rows of an id lie together already, as after a join on it.
    ``shown`` makes a line's ``shown`` from its number and text, once per block and not again for every window.
    """
    keys = list(keys or source_keys(f, lines))
    block = max(1, 4 * radius)

    def block_of(line):
        return F.floor(line / block)

    wanted = f.select("id", *keys, "line_number", block_of(F.col("line_number")).alias("_block")).dropna(subset=[*keys, "_block"])
    near = F.sequence(block_of(F.col("line_no") - radius), block_of(F.col("line_no") + radius))
    side = lines.dropna(subset=[*keys, "line_no"]).select(*keys, F.struct("line_no", "text").alias("_line"), F.explode(near).alias("_block"))
    # at most 6 * radius lines of a file, in the order of its windows
    side = side.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("_line")).alias("_lines"))
    more = ["shown"] if shown else []
    if shown:
        side = side.withColumn("_lines", F.transform("_lines", lambda x: F.struct(
            x["line_no"].alias("line_no"), x["text"].alias("text"), shown(x["line_no"], x["text"]).alias("shown"))))

    def windows(some: DataFrame) -> DataFrame:
        lo, hi = F.greatest(F.lit(1), F.col("line_number") - radius), F.col("line_number") + radius

        def near_by(x):
            return x["line_no"].between(lo, hi)

        row = F.transform(F.filter("_lines", near_by), lambda x: F.struct(
            x["line_no"].alias("line_no"), x["text"].alias("text"), (x["line_no"] == F.col("line_number")).alias("flagged"),
            *[x[n].alias(n) for n in more]))
        return some.join(side, [*keys, "_block"]).filter(F.exists("_lines", near_by)).select("id", row.alias("window"))

    merged = F.array_sort(F.flatten(F.collect_list("window"))).alias("window")
    if together:
        return windows(wanted).groupBy("id").agg(merged)
    # only an id that was flagged more than once has its windows brought together
    again = wanted.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_id")
    same = F.col("id").eqNullSafe(F.col("_id"))
    once = windows(wanted.join(again, same, "left_anti"))
    several = windows(wanted.join(again, same, "left_semi"))
    return once.unionByName(several.groupBy("id").agg(merged))


def shown_line(number, line) -> F.Column:
    """A numbered, redacted line, as it stands in a window's code."""
    return texts.redact_few(texts.source_window_line(number, line))


#: from here on a line's number is as long as a token, so a secret's pattern may reach over the line's end into it
LONG_NUMBER = 10_000_000


def window_code(window, shown: bool = False) -> F.Column:
    """Numbered, redacted source text of a window; ``shown`` says that its lines bring their ``shown_line``.

    A pattern ends with its line, as behind the line's end stand blanks and a short number: lines redacted one by
    one are the redacted text.  Windows with long numbers are redacted as one text.
    """
    whole = texts.redact(F.array_join(F.transform(window, lambda w: texts.source_window_line(w["line_no"], w["text"])), "\n"))
    if not shown:
        return whole
    by_line = F.array_join(F.transform(window, lambda w: w["shown"]), "\n")
    return F.when(F.element_at(window, -1)["line_no"] < LONG_NUMBER, by_line).otherwise(whole)


def reviewer_columns(a: DataFrame, reviewers) -> DataFrame:
    """Latest answer of each named reviewer per finding, one struct column each; one shuffle."""
    row = F.struct("completed_at", "id", "model", "classification", "confidence")
    return a.filter(F.col("reviewer").isin(list(reviewers))).groupBy("finding_id").agg(
        *[F.max(F.when(F.col("reviewer") == r, row)).alias(f"by_{r}") for r in reviewers]
    )


def finding_report(f, s, p, fb, a, lines=None, settings: Settings = DEFAULTS, keys=None) -> DataFrame:
    """Everything one needs to judge a finding, as one nested row.

    Source lines are those of the finding's file, in its scan's project and commit where the lines know theirs.
    """
    rows = with_feedback(with_scan(f, s, p), fb)
    rows = fixes.with_suggested_fix(with_guidance(rows))
    opinions = reviewer_columns(a, fv.REVIEWERS)
    rows = rows.join(opinions.withColumnRenamed("finding_id", "id"), "id", "left")
    if lines is not None:
        rows = rows.join(line_window(rows, lines, settings.report_radius, keys, together=True), "id", "left")
    else:
        rows = rows.withColumn("window", F.lit(None).cast("array<struct<line_no:int,text:string,flagged:boolean>>"))
    parts = scoring.path_parts("file_path")
    root = F.regexp_replace("source_path", r"[/\\]+$", "")
    # every part is worked out as a column of its own and the report only puts them together, so that a reader of some
    # parts has only these worked out, and only what they need of a finding is moved
    made = {
        "_root": root, "_absolute": F.concat(root, F.lit("/"), F.replace("file_path", F.lit("\\"), F.lit("/"))),
        **{f"_{n}": parts[n] for n in ("directory", "file", "segments")}, "_has_code": F.col("window").isNotNull(),
    }
    for r in fv.REVIEWERS:
        it = F.col(f"by_{r}")
        made |= {f"_{r}_available": it.isNotNull(), **{f"_{r}_{n}": it[n] for n in ("model", "classification", "confidence")}}
        made[f"_{r}_outcome"] = F.when(it.isNotNull(), scoring.outcome_vs_model("predicted_label", it["classification"]))
    flat = rows.select("*", *[c.alias(n) for n, c in made.items()])
    reasons = {r: F.when(F.col(f"_{r}_available"), texts.outcome_reason(F.lit(r), "predicted_label", f"_{r}_outcome")) for r in fv.REVIEWERS}
    flat = flat.select("*", *[c.alias(f"_{r}_reason") for r, c in reasons.items()])

    def part(column: str, name: str) -> F.Column:
        return F.col(column).alias(name)

    reviewers = [
        F.struct(
            F.lit(r).alias("reviewer"), *[part(f"_{r}_{n}", n) for n in ("available", "model", "classification", "confidence")],
            part(f"_{r}_outcome", "evaluation_outcome"), part(f"_{r}_reason", "outcome_reason"),
        )
        for r in fv.REVIEWERS
    ]
    return flat.select(
        "id",
        F.struct("rule_id", "cwe_id", "severity", "message", "file_path", "line_number", "status", "final_label",
                 "tp_probability", "predicted_label", "scan_id", part("project_name", "project"), "branch")
        .alias("finding"),
        F.struct("title", "risk").alias("what"),
        F.struct("true_positive_sign", "false_positive_sign", part("feedback_notes", "reviewer_note")).alias("why"),
        F.struct(part("fix", "summary"), part("suggested_fix", "suggestion")).alias("how"),
        F.struct(
            part("project_name", "project"), part("_root", "root"), part("_absolute", "absolute"),
            *[part(f"_{n}", n) for n in ("directory", "file", "segments")],
        ).alias("location"),
        F.struct(part("_has_code", "available"), part("window", "lines")).alias("code"),
        F.array(*reviewers).alias("reviewers"),
    )


def scan_detail(f, r, fb, a, af, scan_id=None, user_id=None, page: int = 1, size: int | None = 100) -> DataFrame:
    """Findings of a scan with rule, trusted label and the latest review of every reviewer.

    Only the viewing user's own verdicts are attached.  ``size=None`` gives all rows.
    """
    order = [fv.ADJUDICATOR, *fv.REVIEWERS]
    rows = f if scan_id is None else f.filter(F.col("scan_id") == scan_id)
    if size is not None:
        rows = rows.orderBy(F.col("tp_probability").desc_nulls_last(), "id").offset((page - 1) * size).limit(size)
    rows = with_feedback(with_rule(rows, r), fb.select("finding_id", "source"))
    rows = rows.withColumn("trusted_final_label", scoring.trusted_label("final_label", "feedback_source"))
    if size is not None:
        # reviews of one page only: its few ids reach the assessments before they are ranked
        a = a.join(rows.select(F.col("id").alias("finding_id")), "finding_id", "left_semi")
    best = latest.latest_assessment(a)
    if user_id is not None:
        mine = af.filter(F.col("user_id") == user_id).select("assessment_id", F.col("verdict").alias("own_verdict"), "reviewed_at", "id")
        mine = latest.latest_feedback(mine).select("assessment_id", "own_verdict")
        best = best.join(mine.withColumnRenamed("assessment_id", "id"), "id", "left")
    else:
        best = best.withColumn("own_verdict", F.lit(None).cast("string"))
    rank = F.when(F.col("reviewer") == order[0], 0).when(F.col("reviewer") == order[1], 1).when(
        F.col("reviewer") == order[2], 2).otherwise(3)
    best = best.select(
        F.col("finding_id"), F.col("reviewer"), rank.alias("position"), "classification", "confidence", "own_verdict"
    )
    joined = rows.join(best, rows["id"] == best["finding_id"], "left").withColumn(
        "review",
        F.when(
            F.col("reviewer").isNotNull(),
            F.struct(
                "position", "reviewer", "classification", "confidence", "own_verdict",
                scoring.outcome_vs_model("predicted_label", "classification").alias("evaluation_outcome"),
                scoring.outcome_vs_human("trusted_final_label", "classification").alias("human_evaluation_outcome"),
            ),
        ),
    )
    keep = ["id", "scan_id", "rule_id", "rule_description", "severity", "tp_probability", "predicted_label",
            "trusted_final_label"]
    # one entry per distinct reviewer name
    return joined.groupBy(*keep).agg(F.array_sort(F.collect_list("review")).alias("reviews"))
