"""Tunable thresholds, with the documented defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    min_training_samples: int = 50
    retrain_batch_size: int = 100
    validation_percent: int = 20
    tp_threshold: float = 0.80
    fp_threshold: float = 0.15
    min_deploy_precision: float = 0.80
    min_deploy_flags: int = 5
    min_validation_tp: int = 5
    min_validation_tp_groups: int = 2
    max_pseudo_ratio: float = 0.25
    promote_confidence: float = 0.85
    rule_min_samples: int = 20
    rule_suppress_rate: float = 0.85
    rule_review_rate: float = 0.70
    comment_threshold: float = 0.80
    trees: int = 100
    tree_depth: int = 10
    bagging_ratio: float = 0.5
    forest_cells: int = 200_000_000  # rows times trees grown at once
    forest_groups: int = 10  # at most
    context_radius: int = 20
    report_radius: int = 8
    max_context_chars: int = 24000
    excerpt_chars: int = 4000
    review_run_size: int = 10
    stale_after_seconds: int = 480
    max_file_bytes: int = 0  # no limit
    max_report_bytes: int = 51200 * 1024
    senior_commits: int = 200
    mid_commits: int = 30


DEFAULTS = Settings()
