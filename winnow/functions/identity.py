"""Stable identities: fingerprint, group key, hash split, canonical features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions.common import NUL, col, text, trim_all


def slashes(path) -> Column:
    return F.replace(text(path), F.lit("\\"), F.lit("/"))


def finding_fingerprint(rule: str, cwe: str, path: str, line: str, snippet: str, message: str) -> Column:
    """Identity of one scanner hit across repeated scans; takes column names."""
    edge = r"r'^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$'"
    code = f"regexp_replace(regexp_replace(coalesce({snippet}, ''), {edge}, ''), r'\\s+', ' ')".replace("\\\\", "\\")
    return F.expr(
        f"sha2(concat_ws('\\u0000', coalesce({rule}, ''), coalesce(string({cwe}), ''), replace(coalesce({path}, ''), r'\\', '/'), "
        f"coalesce(string({line}), ''), coalesce(nullif({code}, ''), regexp_replace(coalesce({message}, ''), {edge}, ''))), 256)"
    )


def group_key(project_id: str, commit_sha: str, scan_id: str) -> Column:
    """Project and commit; a blank commit falls back to the scan."""
    commit = F.lower(trim_all(commit_sha))
    scan = F.concat(F.col(project_id), F.lit(NUL + NUL + "scan:"), F.col(scan_id))
    return F.when(commit != "", F.concat(F.col(project_id), F.lit(NUL), commit)).otherwise(scan)


def reviewer_group_key(project_id, commit_sha) -> Column:
    """Same hash input as ``group_key`` but without the scan fallback."""
    return F.concat(text(project_id), F.lit(NUL), F.lower(trim_all(commit_sha)))


def packed_hash(digest) -> Column:
    """A text in bytes: lower-case hex as what it says behind a 1, half as long; any other text as it is behind a 0."""
    c = col(digest)
    return F.when(c.rlike(r"\A(?:[0-9a-f]{2})+\z"), F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))


def unpacked_hash(packed) -> Column:
    c = col(packed)
    rest = F.substring(c, 2, 2**31 - 1)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def split_bucket(key) -> Column:
    """0..99 from the first 32 bits of sha256."""
    head = F.substring(F.sha2(col(key), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % 100


def training_split(key, percent: int) -> Column:
    percent = min(50, max(1, percent))
    return F.when(split_bucket(key) < percent, "validation").otherwise("train")


def reviewer_split(project_id, commit_sha, percent: int) -> Column:
    if not 0 <= percent <= 50:
        raise ValueError("validation percent must be between 0 and 50")
    return F.when(
        split_bucket(reviewer_group_key(project_id, commit_sha)) < percent, "validation"
    ).otherwise("train")


def normalized_vector(vector: str, order=None) -> Column:
    """Typed struct of the ordered features with defaults for what is missing."""
    fields = []
    for name in order or fv.FEATURES:
        default = fv.FEATURE_DEFAULTS[name]
        raw = f"{vector}.{name}"
        if name in fv.TEXT_FEATURES:
            case = "upper" if name == "scanner_severity" else "lower"
            value = f"coalesce(nullif({case}(trim({raw})), ''), '{default}')"
        elif name == "historical_fp_rate_rule":
            value = f"coalesce(try_cast({raw} AS double), 0.0D)"
        else:
            value = f"coalesce(try_cast(try_cast({raw} AS double) AS int), {default})"
        fields.append(f"'{name}', {value}")
    return F.expr(f"named_struct({', '.join(fields)})")


def sample_value(vector: str, name: str) -> str:
    """A feature as the canonical sample has it; the rate travels as ten-thousandths."""
    return f"bigint(round({vector}.{name} * 10000))" if name == "historical_fp_rate_rule" else f"{vector}.{name}"


def sample_text(vector: str, order=None) -> Column:
    """Canonical JSON of a normalized vector column."""
    fields = [f"'{n}', {sample_value(vector, n)}" for n in order or fv.FEATURES]
    return F.expr(f"to_json(named_struct({', '.join(fields)}))")


def feature_sha256(sample) -> Column:
    return F.sha2(col(sample), 256)

