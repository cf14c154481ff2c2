"""The trusted training snapshot: identity, deduplication, ambiguity, split."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import identity
from winnow.operators import filters, joins, latest, metrics, sets
from winnow.operators.onerow import beside
from winnow.settings import DEFAULTS, Settings
from winnow.sinks import files

PAYLOAD = ["id", "scan_id", "project_id", "scanner_source", "commit_sha", "rule_id", "cwe_id", "file_path",
           "line_number", "severity", "fingerprint", "group_key", "sample"]
#: what a representative is chosen by
CORE = ["id", "fingerprint", "group_key", "sample"]


@dataclass
class Snapshot:
    """Deduplicated rows with their split, and the buckets they came from."""

    #: rows without their ambiguity flags, which cost a join
    kept: DataFrame
    deduped: DataFrame
    trusted: DataFrame

    @cached_property
    def rows(self) -> DataFrame:
        return self.kept if "ambiguous_feature" in self.kept.columns else metrics.flag_ambiguous(self.kept)


def identified(f: DataFrame, s: DataFrame) -> DataFrame:
    """Findings with scan, fingerprint, group key and canonical sample, each computed once."""
    rows = joins.with_scan(f, s).withColumn("_v", identity.normalized_vector("feature_vector"))
    return rows.select(
        *f.columns,
        "project_id", "scanner_source", "commit_sha",
        identity.finding_fingerprint("rule_id", "cwe_id", "file_path", "line_number", "raw_snippet", "message")
        .alias("fingerprint"),
        identity.group_key("project_id", "commit_sha", "scan_id").alias("group_key"),
        F.when(F.col("feature_vector").isNotNull(), identity.sample_text("_v")).alias("sample"),
    )


def hashed(f: DataFrame, keep=(), *more: str) -> DataFrame:
    """Findings with identity and canonical sample in place of the columns these are made of, so that joins move
    only those; ``keep`` of PAYLOAD and ``more`` columns stay.  The fingerprint is its 32 bytes here."""
    v = identity.normalized_vector("feature_vector")
    fingerprint = identity.finding_fingerprint("rule_id", "cwe_id", "file_path", "line_number", "raw_snippet", "message")
    own = [c for c in PAYLOAD if c in keep and c in f.columns and c not in ("id", "scan_id")]
    rows = f.select("id", "scan_id", *own, *more, F.unhex(fingerprint).alias("fingerprint"), v.alias("_v"), F.col("feature_vector").isNotNull().alias("_has"))
    return rows.select("id", "scan_id", *own, *more, "fingerprint", F.when(F.col("_has"), identity.sample_text("_v")).alias("sample"))


def in_scan(rows: DataFrame, s: DataFrame, keep=(), *more: str) -> DataFrame:
    """``hashed`` findings with their group key, the wanted columns of their scan, and ``more`` columns."""
    scan = {"project_id": "project_id", "scanner_source": "source", "commit_sha": "commit_sha"}
    side = s.select(F.col("id").alias("scan_id"), *[F.col(c).alias(n) for n, c in scan.items() if n in keep or n != "scanner_source"])
    out = rows.join(side, "scan_id").withColumn("group_key", identity.group_key("project_id", "commit_sha", "scan_id"))
    return out.select(*[c for c in PAYLOAD if c in keep or c in CORE], *more)


def as_text(digest: str) -> F.Column:
    return F.lower(F.hex(digest))


def _labelled_rows(f: DataFrame, s: DataFrame, fb: DataFrame, keep=PAYLOAD) -> DataFrame:
    """Rows with label and its source, where both labels agree; the fingerprint in bytes."""
    side = fb.select(F.col("finding_id").alias("id"), "corrected_label", F.col("source").alias("label_source"))
    rows = hashed(filters.labelled(f), keep, "final_label").join(side, "id").filter(F.col("final_label") == F.col("corrected_label"))
    return in_scan(rows.withColumnRenamed("final_label", "label"), s, keep, "label", "label_source")


def _prepare(rows: DataFrame, percent: int, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """The deduplicated rows, and those without conflict with feature hash and split."""
    deduped = latest.dedupe_findings(rows)
    # written unless read once: the rows, the ambiguity flags and all statistics read it
    staged = deduped if once else files.stage(deduped, "deduped")
    deduped = files.read_of(staged, staged.withColumn("fingerprint", as_text("fingerprint")))
    kept = deduped.filter(~F.col("label_conflict")).drop("label_conflict").select(
        "*", identity.feature_sha256("sample").alias("feature_sha256"),
        identity.training_split("group_key", percent).alias("split"),
    )
    return deduped, kept


def training_snapshot(f: DataFrame, s: DataFrame, fb: DataFrame, percent: int = DEFAULTS.validation_percent, keep=PAYLOAD,
                      once: bool = False) -> Snapshot:
    """Trusted rows: one per fingerprint, contradictions out, whole groups on one side.

    Of PAYLOAD only the columns in ``keep`` move (and id, fingerprint, group_key and sample, which decide).
    ``once`` says that one reader follows, for whom nothing is written.
    """
    if not 1 <= percent <= 50:
        raise ValueError("validation percent must be between 1 and 50")
    ok = fb.filter(F.col("source").isin(["human", "benchmark", "import"]) & F.col("training_eligible"))
    trusted = _labelled_rows(f, s, ok, keep)
    deduped, kept = _prepare(trusted, percent, once)
    return Snapshot(kept, deduped, trusted.withColumn("fingerprint", as_text("fingerprint")))


@dataclass
class PseudoRows:
    included: DataFrame
    candidates: DataFrame
    validation: DataFrame
    inconsistent: DataFrame


def pseudo_rows(f, s, fb, snap: Snapshot, percent: int = DEFAULTS.validation_percent, settings: Settings = DEFAULTS,
                keep=PAYLOAD) -> PseudoRows:
    """Machine-labelled rows for the training side only, capped per class."""
    src = fb.filter((F.col("source") == "ai_pseudo") & F.col("training_eligible"))
    rows = _labelled_rows(f, s, src, keep)
    odd = filters.labelled(f).join(
        src.select(F.col("finding_id").alias("id"), "corrected_label"), "id"
    ).filter(F.col("final_label") != F.col("corrected_label"))
    _, kept = _prepare(rows, percent)
    kept = metrics.flag_ambiguous(kept)
    train = kept.filter(F.col("split") == "train")
    free = sets.minus_fingerprints(train, snap.kept)
    counts = metrics.label_counts(snap.kept.filter(F.col("split") == "train"))
    return PseudoRows(
        included=sets.cap_per_label(free, sets.pseudo_limits(counts, settings)),
        candidates=train,
        validation=kept.filter(F.col("split") == "validation"),
        inconsistent=odd,
    )


def statistics(snap: Snapshot) -> DataFrame:
    """One row: counts of both partitions, exclusions and ambiguity."""
    per_split = metrics.partition_counts(snap.rows)
    cells = []
    for split in ("train", "validation"):
        for c, name in [("samples", "samples"), ("true_positive", "true_positive"), ("false_positive", "false_positive"),
                        ("groups", "groups"), ("true_positive_groups", "tp_groups")]:
            cells.append(F.coalesce(F.max(F.when(F.col("split") == split, F.col(c))), F.lit(0)).alias(f"{split}_{name}"))
    wide = per_split.agg(*cells)
    mixed = metrics.ambiguous_vectors(snap.rows).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("ambiguous_feature_rows"),
        F.count(F.lit(1)).alias("ambiguous_feature_vectors"),
    )
    return beside(wide, metrics.exclusion_stats(snap.deduped), mixed)
